"""Reading cards, image lists, packs and artifacts; writing results and artifacts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions import text as tx

# What counts as an image, and the versions of artifacts.
IMAGE_FILES = "*.{[jJ][pP][gG],[jJ][pP][eE][gG],[pP][nN][gG],[wW][eE][bB][pP]}"
VERSIONS = {"template": 2, "brand": 1, "knn": 1, "retrieval": 1}
TEXT_COLUMNS = ("name", "category", "description")


def id_key(value) -> Column:
    """An id as text: whole floats lose their fraction, null is empty."""
    return F.regexp_replace(F.trim(F.coalesce(value.cast("string"), F.lit(""))), r"^(-?[0-9]+)\.0+$", "$1")


def read_cards(spark: SparkSession, path: str) -> DataFrame:
    """Cards of a CSV: pos (input order), id, the text columns (missing ones empty) and all further ones.

    Unnamed index columns are dropped; without an id column it fails at once. pos runs on over the files in order
    of their paths; a single file is read by one task since its records may span lines.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = [c for c in rows.columns if not c.startswith("Unnamed:") and not c.startswith("_c")]
    if "id" not in names:
        raise ValueError("the card table has no column id")
    rows = rows.select(*[F.col(f"`{c}`") for c in names], F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_file").orderBy("_at")))
    # One row a file: how many cards the files before it have.
    files = rows.groupBy("_file").agg(F.max("_n").alias("_many"))
    files = files.select("_file", F.coalesce(F.sum("_many").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = rows.join(files, "_file").withColumn("pos", (F.col("_before") + F.col("_n")).cast("bigint")).drop("_at", "_file", "_n", "_before")
    for c in TEXT_COLUMNS:
        rows = rows.withColumn(c, tx.text_of(F.col(c)) if c in names else F.lit(""))
    return rows.withColumn("id", id_key(F.col("id")))


def image_lists(spark: SparkSession, root: str) -> DataFrame:
    """(id, image_paths): the images under root/<id>/, paths in order. Only the listing is read, no image."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_FILES).load(root).select("path")
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("id")).agg(F.sort_array(F.collect_list("path")).alias("image_paths"))


def with_images(cards: DataFrame, lists: DataFrame) -> DataFrame:
    """Adds image_paths (empty without any) and n_images."""
    out = cards.join(lists.withColumnRenamed("id", "_image_id"), id_key(F.col("id")) == F.col("_image_id"), "left").drop("_image_id")
    return out.withColumn("image_paths", F.coalesce("image_paths", F.array().cast("array<string>"))).withColumn("n_images", F.size("image_paths"))


def main_image(paths) -> Column:
    return F.try_element_at(paths, F.lit(1))


def largest_images(images, probed: int = 6, kept: int = 2) -> Column:
    """The largest of the first images; images is array<struct<path,width,height>>, unreadable ones have null sizes."""
    sized = F.filter(F.slice(images, 1, probed), lambda x: (x["width"] * x["height"]).isNotNull())
    order = F.array_sort(F.transform(sized, lambda x, i: F.struct((-(x["width"] * x["height"])).alias("area"), i.alias("i"), x["path"].alias("path"))))
    return F.slice(F.transform(order, lambda x: x["path"]), 1, kept)


def read_pack(spark: SparkSession, path: str, families: DataFrame | None = None) -> DataFrame:
    """Records of a JSON-lines pack, split at line feeds only, with their family (-1 without)."""
    schema = "id string, name string, description string, category string, label int, image_paths array<string>"
    rows = spark.read.text(path, lineSep="\n").where("trim(value) <> ''").select(F.from_json("value", schema).alias("r")).select("r.*")
    if families is None:
        return rows.withColumn("family", F.lit(-1).cast("bigint"))
    f = families.select(F.col("id").cast("string").alias("_fid"), "family")
    return rows.join(f, F.col("id") == F.col("_fid"), "left").drop("_fid").withColumn("family", F.coalesce("family", F.lit(-1).cast("bigint")))


def read_fold_scores(spark: SparkSession, glob: str) -> DataFrame:
    """(id, prob) of the out-of-fold CSV files, the last file's score where an id repeats."""
    rows = spark.read.csv(glob, header=True, schema="id string, prob double").select("id", "prob", F.col("_metadata.file_name").alias("file"))
    return rows.groupBy("id").agg(F.max_by("prob", "file").alias("prob"))


def disjoint_split(rows: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is not in other, rows whose id is): two sides that share no id."""
    ids = other.select("id").distinct()
    return rows.join(ids, "id", "left_anti"), rows.join(ids, "id", "left_semi")


MARKED = r"(?iu)(?<![а-яa-z])бад(?![а-яa-z])|биологически\s+активн|dietary\s+supplement"


def to_transcribe(cards: DataFrame, categories: list[str] | None = None, ids: DataFrame | None = None, unmarked_of: str | None = None, limit: int | None = None) -> DataFrame:
    """The cards whose images are to be read: of some categories, with some ids, the positives of a category whose text has no
    marking (unmarked_of), and of these the first in order of pos."""
    if categories:
        cards = cards.where(F.col("category").isin(*categories))
    if ids is not None:
        cards = cards.join(ids.select("id").distinct(), "id", "left_semi")
    if unmarked_of is not None:
        text = tx.clean(F.concat(tx.text_of(F.col("name")), F.lit(" "), tx.text_of(F.col("description"))))
        cards = cards.where((F.col("category") == unmarked_of) & (F.col("label") == 1) & ~text.rlike(MARKED))
    return cards.orderBy("pos").limit(limit) if limit is not None else cards


def not_done(todo: DataFrame, done: DataFrame) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select("id"), "id", "left_anti")


def append_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def read_artifact(spark: SparkSession, path: str, kind: str) -> dict:
    """A JSON artifact, refused if its version is another. Bounded: configuration and statistics by key, read by the driver."""
    data = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    if data.get("format_version") != VERSIONS[kind]:
        raise ValueError(f"unexpected version of the {kind} artifact: {data.get('format_version')}")
    return data


def brand_tables(spark: SparkSession, data: dict) -> tuple[DataFrame, DataFrame]:
    """The brand artifact as (category, brand, n, pos) and (category, prior)."""
    entries = [(c, b, int(n), int(p)) for c, t in data["categories"].items() for b, (n, p) in t.get("brands", {}).items()]
    priors = [(c, float(t.get("prior", 0.5))) for c, t in data["categories"].items()]
    return spark.createDataFrame(entries, "category string, brand string, n bigint, pos bigint"), spark.createDataFrame(priors, "category string, prior double")


def template_table(spark: SparkSession, data: dict) -> DataFrame:
    """The template artifact as (category, kind, key, n, pos)."""
    entries = [(c, kind, k, int(n), int(p)) for c, kinds in data["categories"].items() for kind, keys in kinds.items() for k, (n, p) in keys.items()]
    return spark.createDataFrame(entries, "category string, kind string, key string, n bigint, pos bigint")


#: Tables of each kind of artifact and the columns that they must have.
TABLES = {
    "retrieval": {"products": ["id", "category", "label", "name_n"], "sha": ["category", "sha", "id", "label"], "dhash": ["category", "words", "id", "label"]},
    "knn": {"vectors": ["id", "category", "vector", "label"], "gates": ["category", "cos_thr", "k", "min_agree"]},
    "brand": {"brands": ["category", "brand", "n", "pos"], "priors": ["category", "prior"]},
    "template": {"keys": ["category", "kind", "key", "n", "pos"]},
}


def _check(kind: str, tables: dict[str, DataFrame]) -> None:
    for name, columns in TABLES[kind].items():
        gone = [c for c in columns if name not in tables or c not in tables[name].columns]
        if gone:
            raise ValueError(f"the {kind} artifact lacks {name}: {', '.join(gone)}")


def save_tables(tables: dict[str, DataFrame], path: str, kind: str) -> None:
    """An artifact as tables under path, and its version; refused if a table or column is missing."""
    _check(kind, tables)
    spark = next(iter(tables.values())).sparkSession
    for name in TABLES[kind]:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(kind, VERSIONS[kind])], "kind string, format_version int").write.mode("overwrite").parquet(f"{path}/version")


def load_tables(spark: SparkSession, path: str, kind: str) -> dict[str, DataFrame]:
    """The tables of an artifact; refused if its kind or version is another or a table or column is missing."""
    found = spark.read.parquet(f"{path}/version").first()
    if found is None or (found["kind"], found["format_version"]) != (kind, VERSIONS[kind]):
        raise ValueError(f"unexpected version of the {kind} artifact: {found}")
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in TABLES[kind]}
    _check(kind, tables)
    return tables


def blend_config(spark: SparkSession, path: str | None) -> dict:
    """weights, thresholds and brand_weights by category key; a file that is absent or no JSON is an empty configuration."""
    if path is None:
        return {}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return {}
    try:
        return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    except ValueError:
        return {}


def blend_table(spark: SparkSession, config: dict) -> DataFrame:
    """The blend configuration as (category_key, weight, cut, brand_weight)."""
    key = lambda c: " ".join(c.lower().replace("ё", "е").split())
    cut = {key(k): float(v) for k, v in config.get("thresholds", {}).items()}
    brand = {key(k): float(v) for k, v in config.get("brand_weights", {}).items()}
    rows = [(key(k), float(w), cut[key(k)], brand.get(key(k), 0.0)) for k, w in config.get("weights", {}).items() if key(k) in cut]
    return spark.createDataFrame(rows, "category_key string, weight double, cut double, brand_weight double")


def write_results(results: DataFrame, path: str) -> None:
    """(id, result) as CSV in order of pos: sorted by range over many files; their names keep the order."""
    results.repartitionByRange("pos").sortWithinPartitions("pos").select("id", "result").write.csv(path, header=True, escape='"')


def read_results(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, escape='"', multiLine=True)
    if rows.columns != ["id", "result"]:
        raise ValueError(f"unexpected header: {rows.columns}")
    return rows


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(id, path, sha, sha1) of image files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_FILES).load(root)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("id"), "path", F.sha2("content", 256).alias("sha"), F.sha1("content").alias("sha1"))


def difference_words(spark: SparkSession, root: str) -> DataFrame:
    """(id, path, words): 256-bit difference hashes as four words; null for files that can't be read.

    Needs an imaging library on the executors; without one it fails when it runs.
    """

    def run(batches):
        import io

        import numpy as np
        import pandas as pd
        from PIL import Image

        for rows in batches:
            words = []
            for content in rows["content"]:
                try:
                    grey = np.asarray(Image.open(io.BytesIO(content)).convert("L").resize((17, 16), Image.LANCZOS), np.int16)
                    words.append(np.packbits(grey[:, 1:] > grey[:, :-1]).view(">u8").astype(np.int64).tolist())
                except OSError:
                    words.append(None)
            yield pd.DataFrame({"id": rows["id"], "path": rows["path"], "words": words})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_FILES).load(root)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("id"), "path", "content").mapInPandas(run, "id string, path string, words array<bigint>")
