"""Label transfer by keys: templates, names, brands, exact hashes and corrections.

A card table has id, pos (input order), name, description, category and, for training, label; the functions
take the normalised fields as columns name_n and desc_n. Tables of statistics are joined by key; Spark
broadcasts them while they are under its threshold and sorts both sides beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.functions.scores import override_prob

# Least group, purity, brand count and smoothing.
MIN_GROUP, MIN_PURITY = 2, 0.9
BRAND_COUNT, BRAND_SMOOTH = 3, 3.0
NO_PRIOR = 0.5
MEMORY_PURITY = 0.8


def with_keys(cards: DataFrame) -> DataFrame:
    """Adds desc_key, name_key and brand_key, so that tables written once serve every lookup without normalising again."""
    return cards.withColumn("desc_key", tx.template_key(F.col("desc_n"))).withColumn("name_key", tx.name_key(F.col("name_n"))).withColumn("brand_key", tx.brand_key(F.col("name_n")))


def _key(cards: DataFrame, name: str) -> Column:
    """A key column of with_keys(), made on the spot where it is missing."""
    if name in cards.columns:
        return F.col(name)
    return {"desc_key": lambda: tx.template_key(F.col("desc_n")), "name_key": lambda: tx.name_key(F.col("name_n")), "brand_key": lambda: tx.brand_key(F.col("name_n")), "desc_digest": lambda: tx.digest(F.col("desc_n"))}[name]()


def key_stats(labelled: DataFrame, key: Column, kind: str, min_group: int = MIN_GROUP) -> DataFrame:
    """(category, kind, key, n, pos) of keys with enough labelled cards."""
    rows = labelled.where(F.col("label").isNotNull()).select("category", key.alias("key"), "label").where("key is not null")
    grouped = rows.groupBy("category", "key").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos"))
    return grouped.where(F.col("n") >= min_group).select("category", F.lit(kind).alias("kind"), "key", "n", "pos")


def template_stats(labelled: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Statistics of description prefixes (kind desc) and name prefixes (kind name)."""
    return key_stats(labelled, _key(labelled, "desc_key"), "desc", min_group).unionByName(key_stats(labelled, _key(labelled, "name_key"), "name", min_group))


def pure_counts(stats: DataFrame, purity: float = MIN_PURITY) -> DataFrame:
    """By category and kind: keys, and how many of them decide each way."""
    v = verdict(F.col("n"), F.col("pos"), 1, purity)
    return stats.groupBy("category", "kind").agg(F.count("*").alias("n_keys"), F.count_if(v == 1).alias("pure_pos"), F.count_if(v == 0).alias("pure_neg"))


def verdict(n: Column, pos: Column, min_group: int = MIN_GROUP, purity: float = MIN_PURITY) -> Column:
    """1 or 0 where a large enough group is nearly of one label, else null."""
    share = pos.cast("double") / n.cast("double")
    return F.when(n >= min_group, F.when(share >= F.lit(purity), 1).when(share <= F.lit(1.0 - purity), 0))


def _looked_up(cards: DataFrame, stats: DataFrame, kind: str, key: Column, min_group: int) -> DataFrame:
    table = stats.where(F.col("kind") == kind).select(F.col("category").alias("_c"), F.col("key").alias("_k"), verdict(F.col("n"), F.col("pos"), min_group).alias(f"_{kind}"), F.col("n").alias(f"_{kind}_n"))
    return cards.withColumn("_key", key).join(table, (F.col("category") == F.col("_c")) & (F.col("_key") == F.col("_k")), "left").drop("_c", "_k", "_key")


def template_transfer(cards: DataFrame, stats: DataFrame, min_group: int = MIN_GROUP, names: bool = True) -> DataFrame:
    """Adds decision (1, 0 or null), transfer_reason and transfer_prob; a description key goes before a name key."""
    out = _looked_up(cards, stats, "desc", _key(cards, "desc_key"), min_group)
    if names:
        out = _looked_up(out, stats, "name", _key(cards, "name_key"), min_group)
    else:
        out = out.withColumn("_name", F.lit(None).cast("int")).withColumn("_name_n", F.lit(None).cast("bigint"))
    word = lambda c: F.when(c == 1, "pos").otherwise("neg")
    reason = F.when(F.col("_desc").isNotNull(), F.concat(F.lit("template_"), word(F.col("_desc")), F.lit("_"), F.col("_desc_n").cast("string"))).when(F.col("_name").isNotNull(), F.concat(F.lit("tname_"), word(F.col("_name")), F.lit("_"), F.col("_name_n").cast("string")))
    out = out.withColumn("decision", F.coalesce("_desc", "_name")).withColumn("transfer_reason", reason)
    return out.withColumn("transfer_prob", override_prob(F.col("decision"))).drop("_desc", "_name", "_desc_n", "_name_n")


def brand_stats(labelled: DataFrame, min_count: int = BRAND_COUNT) -> tuple[DataFrame, DataFrame]:
    """((category, brand, n, pos), (category, prior))."""
    rows = labelled.where(F.col("label").isNotNull())
    priors = rows.groupBy("category").agg(F.avg(F.col("label").cast("double")).alias("prior"))
    brands = rows.select("category", _key(labelled, "brand_key").alias("brand"), "label").where("brand is not null")
    brands = brands.groupBy("category", "brand").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos")).where(F.col("n") >= min_count)
    return brands, priors


def with_brand_prob(cards: DataFrame, brands: DataFrame, priors: DataFrame) -> DataFrame:
    """Adds brand_prob: the brand's smoothed share, else the category's prior, else NO_PRIOR."""
    b = brands.where(F.col("n") >= BRAND_COUNT).select(F.col("category").alias("_c"), F.col("brand").alias("_b"), F.col("n").alias("_n"), F.col("pos").alias("_p"))
    q = priors.select(F.col("category").alias("_qc"), F.col("prior").alias("_prior"))
    out = cards.withColumn("_key", _key(cards, "brand_key")).join(q, F.col("category") == F.col("_qc"), "left").join(b, (F.col("category") == F.col("_c")) & (F.col("_key") == F.col("_b")), "left")
    prob = F.coalesce((F.col("_p") + F.lit(BRAND_SMOOTH) * F.col("_prior")) / (F.col("_n") + F.lit(BRAND_SMOOTH)), F.col("_prior"), F.lit(NO_PRIOR))
    return out.withColumn("brand_prob", prob).drop("_key", "_c", "_b", "_n", "_p", "_qc", "_prior")


def unanimous_keys(labelled: DataFrame, key: Column) -> DataFrame:
    """(category, key, label) of keys whose labels all agree."""
    rows = labelled.where(F.col("label").isNotNull()).select("category", key.alias("key"), "label").where("key is not null and key <> ''")
    return rows.groupBy("category", "key").agg(F.min("label").alias("label"), F.max("label").alias("_top"), F.count("*").alias("n")).where(F.col("label") == F.col("_top")).drop("_top")


def memory_lookup(cards: DataFrame, text_keys: DataFrame, hash_keys: DataFrame | None = None, votes: DataFrame | None = None) -> DataFrame:
    """Adds memory_label and memory_source: the text key (column text_key) first, then the content hash (column sha), then
    the vote of near images (images.memory_votes())."""

    def looked_up(rows: DataFrame, keys: DataFrame | None, column: str, name: str) -> DataFrame:
        if keys is None:
            return rows.withColumn(name, F.lit(None).cast("int"))
        t = keys.select(F.col("category").alias("_c"), F.col("key").alias("_k"), F.col("label").alias(name))
        return rows.join(t, (F.col("category") == F.col("_c")) & (F.col(column) == F.col("_k")), "left").drop("_c", "_k")

    out = looked_up(looked_up(cards, text_keys, "text_key", "_text"), hash_keys, "sha", "_sha")
    if votes is None:
        out = out.withColumn("_near", F.lit(None).cast("int"))
    else:
        out = out.join(votes.select(F.col("id").alias("_v"), F.col("dhash_label").alias("_near")), F.col("id") == F.col("_v"), "left").drop("_v")
    source = F.when(F.col("_text").isNotNull(), "text").when(F.col("_sha").isNotNull(), "sha").when(F.col("_near").isNotNull(), "dhash")
    return out.withColumn("memory_label", F.coalesce("_text", "_sha", "_near")).withColumn("memory_source", source).drop("_text", "_sha", "_near")


def negative_descriptions(labelled: DataFrame) -> DataFrame:
    """(category, key) of descriptions that only unwanted cards have."""
    rows = labelled.where(F.col("label").isNotNull()).select("category", _key(labelled, "desc_digest").alias("key"), "label").where("key is not null")
    return rows.groupBy("category", "key").agg(F.max("label").alias("_top")).where(F.col("_top") == 0).select("category", "key")


def with_negative_description(cards: DataFrame, keys: DataFrame) -> DataFrame:
    """Adds negative_description."""
    k = keys.select(F.col("category").alias("_c"), F.col("key").alias("_k"), F.lit(True).alias("_hit"))
    out = cards.withColumn("_key", _key(cards, "desc_digest")).join(k, (F.col("category") == F.col("_c")) & (F.col("_key") == F.col("_k")), "left")
    return out.withColumn("negative_description", F.coalesce("_hit", F.lit(False))).drop("_c", "_k", "_hit", "_key")


def overlay_labels(cards: DataFrame, corrections: DataFrame | None) -> DataFrame:
    """label from corrections (id, corrected_label) where there is one; without a table nothing changes."""
    if corrections is None:
        return cards
    c = corrections.groupBy(F.col("id").alias("_id")).agg(F.max("corrected_label").alias("_label"))
    return cards.join(c, F.col("id") == F.col("_id"), "left").withColumn("label", F.coalesce("_label", "label")).drop("_id", "_label")


def exact_matches(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """Adds n_exact, exact_low, exact_high and exact_same_name by (category, sha).

    Postings are summed by hash before the join, so a hash that many products share costs one row, and whether
    a product of the same name is among them is asked of (category, sha, name).
    """
    by_hash = postings.groupBy(F.col("category").alias("_c"), F.col("sha").alias("_s")).agg(F.countDistinct("id").alias("n_exact"), F.min("label").alias("exact_low"), F.max("label").alias("exact_high"))
    by_name = postings.where("name_n <> ''").select(F.col("category").alias("_nc"), F.col("sha").alias("_ns"), F.col("name_n").alias("_nn"), F.lit(True).alias("_same")).distinct()
    out = queries.join(by_hash, (F.col("category") == F.col("_c")) & (F.col("sha") == F.col("_s")), "left")
    out = out.join(by_name, (F.col("category") == F.col("_nc")) & (F.col("sha") == F.col("_ns")) & (F.col("name_n") == F.col("_nn")), "left")
    out = out.withColumn("n_exact", F.coalesce("n_exact", F.lit(0).cast("bigint"))).withColumn("exact_same_name", F.coalesce("_same", F.lit(False)))
    return out.drop("_c", "_s", "_nc", "_ns", "_nn", "_same")


def merge_channels(text: DataFrame, labels: DataFrame, other: DataFrame) -> DataFrame:
    """(id, prob, other_prob, ..): scores with a label; where the other channel has none, the text's score."""
    out = text.join(labels, "id").join(other.withColumnRenamed("prob", "_other"), "id", "left")
    return out.withColumn("other_prob", F.coalesce("_other", "prob")).drop("_other")


def mean_by_id(scores: DataFrame) -> DataFrame:
    """Mean score of each id over folds and seeds."""
    return scores.groupBy("id").agg(F.avg("prob").alias("prob"), F.count("*").alias("n_folds"))
