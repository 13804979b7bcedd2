"""Image evidence: 256-bit difference hashes and content hashes, from fingerprints to decisions.

An image is (id, sha, words): its product, the hash of its bytes, and four 64-bit words. Two hashes within distance
d agree in at least one of d + 1 bands of hex digits, so an equality join by band loses no pair. Equal hashes are
one class first. In a band value that many classes share, the digits outside the band are cut into d + 1 bands
again, of which one must agree as well, so that no bucket stays hot and still no pair is lost. Where digits vary too
little for that, as in a category whose keys would bring together an eighth of all pairs, the searches compare all
pairs, each once, in tiles of numpy, over as few bits as tell the distances. Words of which one is null are as good as
unreadable: nothing is within any distance of them. Categories whose pairs are soon compared skip the count of keys.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions.scores import override_prob
from shelfmark.operators import hamming
from shelfmark.operators.transfer import MEMORY_PURITY
from shelfmark.scratch import written

# Distances of the layer, of the memory and of families, and neighbours of an image.
NEAR, NEAR_MEMORY, NEAR_FAMILY, TOP_K = 4, 6, 6, 128
DIGITS = 64
#: Classes that share a band value before its pairs are split further.
HOT = 2048
_PARTS = 64
#: A category with fewer pairs than the first is searched by keys in any case, one with fewer than the second by tiles, a larger one by tiles if keys bring together one pair in so many.
FEW_PAIRS, SOME_PAIRS, ONE_IN = 1 << 20, 1 << 31, 8
#: Rows of a tile on either side, tiles dealt out at once, pairs compared at once (these stay in a core's cache), and near ones ranked at once.
TILE_X, TILE_Y = 4096, 1 << 18
_DEALT, _AT_ONCE, _FOUND = 8192, 1 << 18, 1 << 20


def words_of_grey(grey: Column, width: int = 17) -> Column:
    """Four words from the rows of a 17 x 16 grey image (array<int>): bit set where the pixel to the right is brighter, highest first."""
    bit = lambda i: F.when(F.element_at(grey, i + 2) > F.element_at(grey, i + 1), 1).otherwise(0).cast("bigint")
    place = lambda k: F.floor(k / (width - 1)) * width + k % (width - 1)
    word = lambda n: F.aggregate(F.sequence(F.lit(n * 64), F.lit(n * 64 + 63)), F.lit(0).cast("bigint"), lambda s, k: F.shiftleft(s, 1).bitwiseOR(bit(place(k).cast("int"))))
    return F.array(*[word(n) for n in range(4)])


def hex_code(words: Column) -> Column:
    """64 hex digits."""
    return F.array_join(F.transform(words, lambda w: F.lpad(F.hex(w), 16, "0")), "")


def _readable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("words").isNotNull() & F.forall("words", lambda w: w.isNotNull()))


def _codes(rows: DataFrame) -> DataFrame:
    """The distinct (category, words)."""
    return _readable(rows).select("category", "words").distinct()


def _spread(rows: DataFrame, name: str) -> DataFrame:
    """written(), in a file for each task that runs at once: a few megabytes would all be left to one."""
    # By an expression of its own, as a repartition by the keys of a group by is left out.
    return written(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, F.xxhash64("category", "words")), name)


def _bands(code: Column, length: int, n: int) -> Column:
    edges = [round(i * length / n) for i in range(n + 1)]
    return F.array(*[F.concat(F.lit(f"{i}:"), F.substring(code, a + 1, b - a)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def _without(code: Column, band: Column, n: int) -> Column:
    """The digits outside a band."""
    edges = [round(i * DIGITS / n) for i in range(n + 1)]
    out = F.lit(None).cast("string")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        out = F.when(F.startswith(band, F.lit(f"{i}:")), F.concat(F.substring(code, 1, a), F.substring(code, b + 1, DIGITS - b))).otherwise(out)
    return out


def _keyed(left: DataFrame, right: DataFrame, max_distance: int, by: list[str], hot: int) -> tuple[DataFrame, DataFrame]:
    """((*by, x, key), (*by, y, key)) of sides of distinct (*by, words): a row for each key; words within the distance share one."""
    n = max_distance + 1
    side = lambda rows, name: rows.withColumn("code", hex_code(F.col("words"))).select(*by, F.col("words").alias(name), "code", F.explode(_bands(F.col("code"), DIGITS, n)).alias("band"))
    l, r = side(left, "x"), side(right, "y")
    busy = r.groupBy(*by, "band").count().where(F.col("count") > hot).select(*by, "band", F.lit(True).alias("busy"))

    def keyed(rows: DataFrame) -> DataFrame:
        # Rows of a busy value have n keys of it and another band each, others one key.
        rest = _bands(_without(F.col("code"), F.col("band"), n), DIGITS - DIGITS // n, n)
        keys = F.when(F.col("busy"), F.transform(rest, lambda x: F.concat(F.col("band"), F.lit("/"), x))).otherwise(F.array("band"))
        return rows.join(busy, [*by, "band"], "left").withColumn("key", F.explode(keys)).drop("band", "busy", "code")

    return keyed(l), keyed(r)


def near_codes(left: DataFrame, right: DataFrame, max_distance: int, by: list[str] = ("category",), hot: int = HOT) -> DataFrame:
    """Distinct (*by, x, y, dist) of the words x of left and y of right within the distance, with equal (not null) `by`."""
    by = list(by)
    l, r = _keyed(*[_readable(rows).select(*by, "words").distinct() for rows in (left, right)], max_distance, by, hot)
    near = l.join(r, [*by, "key"]).withColumn("dist", hamming.array_distance(F.col("x"), F.col("y"))).where(F.col("dist") <= max_distance)
    return near.select(*by, "x", "y", "dist").distinct()


def _crowded(left: DataFrame, right: DataFrame, max_distance: int, hot: int = HOT) -> DataFrame | None:
    """The categories in which near_codes() would compare at least one in ONE_IN of all pairs; None if there is none."""
    x, y = _spread(_codes(left), "codes"), _spread(_codes(right), "codes")
    return _met(x, y, _sizes(x, y).where(F.col("pairs") >= FEW_PAIRS), max_distance, hot)


def _sizes(x: DataFrame, y: DataFrame) -> DataFrame:
    """(category, xs, ys, pairs): the rows of both sides and the pairs of codes; x has distinct codes, and y too where it has no _r that is 1 once for each."""
    once = F.count_if(F.col("_r") == 1) if "_r" in y.columns else F.count("*")
    return x.groupBy("category").agg(F.count("*").alias("xs")).join(y.groupBy("category").agg(F.count("*").alias("ys"), once.alias("_codes")), "category").select("category", "xs", "ys", (F.col("xs").cast("double") * F.col("_codes")).alias("pairs"))


def _met(x: DataFrame, y: DataFrame, large: DataFrame, max_distance: int, hot: int = HOT) -> DataFrame | None:
    """_crowded() among the categories of large, from _sizes() of x and y."""
    large = written(large.select("category", "pairs"), "large")
    if large.isEmpty():
        return None
    l, r = _keyed(*[rows.select("category", "words").join(large.select("category"), "category", "left_semi") for rows in (x, y.where("_r = 1") if "_r" in y.columns else y)], max_distance, ["category"], hot)
    # Keys are only counted, so their hashes will do.
    count = lambda rows, name: rows.groupBy("category", F.xxhash64("key").alias("key")).agg(F.count("*").cast("double").alias(name))
    met = count(l, "xk").join(count(r, "yk"), ["category", "key"]).groupBy("category").agg(F.sum(F.col("xk") * F.col("yk")).alias("met"))
    out = written(met.join(large, "category").where(F.col("met") * ONE_IN >= F.col("pairs")).select("category"), "crowded")
    return None if out.isEmpty() else out


def _tiles(x: DataFrame, y: DataFrame, max_distance: int) -> tuple[tuple[DataFrame, DataFrame, bool] | None, tuple[DataFrame, DataFrame] | None]:
    """Both sides dealt to tiles (category, _x, _y) so that each pair meets in one, and whether a row of x has several; both sides of the categories left to keys.

    x and y are _spread(), as _sizes() takes them. None: no category goes that way.
    """
    sizes = written(_sizes(x, y), "sizes")
    some, large = (F.col("pairs") >= FEW_PAIRS) & (F.col("pairs") < SOME_PAIRS), F.col("pairs") >= F.greatest(F.lit(FEW_PAIRS), F.lit(SOME_PAIRS))
    parts = lambda name, size: F.ceil(F.col(name) / size).cast("int").alias(name)
    n, counted = sizes.where(some).select("category", parts("xs", TILE_X), parts("ys", TILE_Y)), sizes.agg(F.count("*").alias("all"), F.count_if(large).alias("large")).first()
    crowded = _met(x, y, sizes.where(large), max_distance) if counted["large"] else None
    if crowded is not None:
        n = written(n.unionByName(sizes.join(crowded, "category").select("category", parts("xs", TILE_X), parts("ys", TILE_Y))), "tiles")
    dealt = n.agg(F.count("*").alias("n"), F.sum(F.col("xs").cast("bigint") * F.col("ys")).alias("total"), F.max("ys").alias("most")).first()
    if not dealt["n"]:
        return None, (x, y)

    def deal(rows: DataFrame, own: str, other: str) -> DataFrame:
        rows = rows.join(n, "category").withColumn(f"_{own}", F.pmod(F.xxhash64("words"), F.col(f"{own}s")).cast("int")).withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        rows = rows.drop("xs", "ys")
        # Columns of their own, as a cogroup of rows with themselves is ambiguous.
        return rows.toDF(*rows.columns).repartition(min(dealt["total"], _DEALT), "category", "_x", "_y")

    tiled = deal(x, "x", "y"), deal(y, "y", "x"), dealt["most"] > 1
    # A category of one side only has nothing to be found.
    rest = sizes.select("category").join(n, "category", "left_anti")
    return tiled, None if dealt["n"] == counted["all"] else tuple(rows.join(rest, "category", "left_semi") for rows in (x, y))


def _words(table: pa.Table) -> np.ndarray:
    if not table.num_rows:
        return np.empty((0, 0), np.uint64)
    return table["words"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).view(np.uint64)


def _packed(x: np.ndarray, y: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Both sides in the fewest words in which distances up to most are the same and greater ones stay greater, and their bits.

    Bits that no row changes go; of those that always change together most + 1 are enough.
    """
    rows = np.concatenate([x, y])
    rows = rows ^ rows[0]
    columns: Counter[bytes] = Counter()
    for w in range(rows.shape[1]):
        changed = int(np.bitwise_or.reduce(rows[:, w]))
        for b in range(64):
            if changed >> b & 1:
                columns[np.packbits((rows[:, w] & np.uint64(1 << b)) != 0).tobytes()] += 1
    bits = [c for c, n in columns.items() for _ in range(min(n, most + 1))]
    kind, size = (np.uint32, 32) if len(bits) <= 32 else (np.uint64, 64)
    words = [np.zeros(len(rows), kind) for _ in range(0, max(1, len(bits)), size)]
    for i, c in enumerate(bits):
        words[i // size] |= np.unpackbits(np.frombuffer(c, np.uint8), count=len(rows)).astype(kind) << kind(i % size)
    return [w[: len(x)] for w in words], [w[len(x) :] for w in words], len(bits)


def _distances(x: np.ndarray, y: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row of x, distances of some rows of x from all of y); beyond most they are only greater than it."""
    xs, ys, bits = _packed(x, y, most)
    step = max(1, _AT_ONCE // len(y))
    for at in range(0, len(x), step):
        out = np.bitwise_count(xs[0][at : at + step, None] ^ ys[0]).astype(np.uint8 if bits < 256 else np.uint16, copy=False)
        for a, b in zip(xs[1:], ys[1:], strict=True):
            out += np.bitwise_count(a[at : at + step, None] ^ b)
        yield at, out


def _first(x: np.ndarray, y: np.ndarray, most: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, distance), by the first two: of each row of x, the first k rows of y within the distance, by distance and place. All of a row come at once."""
    found, n = [], 0
    for at, d in _distances(x, y, most) if len(x) and len(y) else ():
        flat = np.flatnonzero(d <= most)
        found.append((flat // len(y) + at, flat % len(y), d.ravel()[flat].astype(np.int64)))
        n += len(flat)
        if n >= _FOUND or at + len(d) == len(x):
            r, c, v = (np.concatenate(columns) for columns in zip(*found, strict=True))
            found, n = [], 0
            if not len(r):
                continue
            row = np.cumsum(np.diff(r, prepend=r[0]) != 0)
            each = np.bincount(row * (most + 1) + v, minlength=(row[-1] + 1) * (most + 1)).reshape(-1, most + 1)
            reached = np.cumsum(each, axis=1)
            to, before = reached[row, v], (reached - each)[row, v]
            # A row has one distance at most of which some are left out: the first by place stay.
            keep = to <= k
            cut = np.flatnonzero(~keep & (before < k))
            start = np.flatnonzero(np.diff(row[cut], prepend=-1))
            nth = np.arange(len(cut)) - np.repeat(start, np.diff(start, append=len(cut)))
            keep[cut] = before[cut] + nth < k
            yield r[keep], c[keep], v[keep]


def _nearest(max_distance: int, k: int, names: list[str]):
    """Of each row of x, the first k rows of y within the distance, by distance, id and nth."""

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.sort_by([("id", "ascending"), ("nth", "ascending")])
        rows, columns, dists = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for r, c, v in _first(_words(x), _words(y), max_distance, k):
            order = np.argsort(r * (max_distance + 1) + v, kind="stable")
            rows.append(r[order]), columns.append(c[order]), dists.append(v[order].astype(np.int32))
        r, c = np.concatenate(rows), np.concatenate(columns)
        whose, at = np.unique(r, return_index=True)
        found = pa.StructArray.from_arrays([pa.array(np.concatenate(dists)), *[y[name].take(c).combine_chunks() for name in names[1:]]], names)
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(r)).astype(np.int32)), found)
        return pa.table({"category": x["category"].take(whose), "words": x["words"].take(whose), "found": lists})

    return compare


def _named(max_distance: int, k: int):
    """Of the first k rows of y within the distance of each row of x, the least and the greatest id of each name and label."""

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.sort_by([("id", "ascending"), ("nth", "ascending")])
        kinds = y.select(["name_n", "label"]).group_by(["name_n", "label"]).aggregate([])
        kind = np.zeros(y.num_rows, np.int64)
        if y.num_rows:
            place = {(row["name_n"], row["label"]): i for i, row in enumerate(kinds.to_pylist())}
            kind = np.fromiter(map(place.__getitem__, zip(y["name_n"].to_pylist(), y["label"].to_pylist(), strict=True)), np.int64, y.num_rows)
        out = [np.empty((4, 0), np.int64)]
        for r, c, _ in _first(_words(x), _words(y), max_distance, k):
            key = r * kinds.num_rows + kind[c]
            order = np.argsort(key, kind="stable")
            key, c = key[order], c[order]
            start = np.flatnonzero(np.diff(key, prepend=-1))
            out.append(np.stack([key[start] // kinds.num_rows, key[start] % kinds.num_rows, c[start], c[np.append(start[1:], len(c)) - 1]]))
        row, which, first, last = np.concatenate(out, axis=1)
        named = {name: kinds[name].take(which) for name in ("name_n", "label")}
        return pa.table({"category": x["category"].take(row), "words": x["words"].take(row), **named, "first": y["id"].take(first), "last": y["id"].take(last)})

    return compare


def _votes(max_distance: int):
    """Of each row of x, the sums of n and pos of the rows of y within the distance."""

    def count(x: pa.Table, y: pa.Table) -> pa.Table:
        sums = np.zeros((x.num_rows, 2), np.int64)
        each = np.stack([y["n"].to_numpy(), y["pos"].to_numpy()], axis=1).astype(np.float64)
        for at, d in _distances(_words(x), _words(y), max_distance) if x.num_rows and y.num_rows else ():
            sums[at : at + len(d)] = (d <= max_distance).astype(np.float64) @ each
        some = np.flatnonzero(sums[:, 0])
        return pa.table({"category": x["category"].take(some), "words": x["words"].take(some), "n": sums[some, 0], "pos": sums[some, 1]})

    return count


def _cogrouped(x: DataFrame, y: DataFrame, compare, schema: T.StructType) -> DataFrame:
    keys = ["category", "_x", "_y"]
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(compare, schema)


def distinct_fingerprints(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, sha), (id, words)): each product's distinct content hashes and difference hashes; unreadable images have none."""
    return images.where("sha is not null").select("id", "sha").distinct(), images.where("words is not null").select("id", "words").distinct()


def retrieval_index(cards: DataFrame, images: DataFrame) -> dict[str, DataFrame]:
    """Tables of a search: products (id, category, label, name_n), sha (category, sha, id, label, name_n), dhash (category, words, id, label, name_n)."""
    products = cards.where(F.col("label").isNotNull()).select("id", "category", "label", "name_n")
    exact, near = distinct_fingerprints(images)
    return {"products": products, "sha": exact.join(products, "id"), "dhash": near.join(products, "id")}


def _least(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group, in order; a large group is cut to k a part first."""
    part = Window.partitionBy(*by, "_part").orderBy(*order)
    some = rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(_PARTS))).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k).drop("_part")
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k)


def _searched(asked: DataFrame, index: DataFrame, max_distance: int, k: int) -> tuple[tuple[DataFrame, DataFrame, bool] | None, DataFrame | None]:
    """_tiles() of the codes asked for and of the index, and nearest_images() of the categories that are searched by keys. None: there are none."""
    x = _spread(_codes(asked), "asked")
    y = _least(_readable(index).select("category", "words", "id", "label", "name_n"), ["category", "words"], ["id"], k)
    y = _spread(y.withColumn("nth", F.row_number().over(Window.partitionBy("category", "id").orderBy(hex_code(F.col("words"))))), "index")
    tiled, left = _tiles(x, y, max_distance)
    if left is None:
        return tiled, None
    x, y = left
    rows = y.drop("_r").withColumnRenamed("words", "y").join(near_codes(x, y, max_distance), ["category", "y"])
    top = _least(rows, ["category", "x"], ["dist", "id", "nth"], k)
    return tiled, top.select("category", F.col("x").alias("words"), "id", "label", "name_n", "dist", F.col("_r").alias("rank"))


def _ranked(x: DataFrame, y: DataFrame, several: bool, max_distance: int, k: int) -> DataFrame:
    """nearest_images() of tiles, which return each row's k; they are merged where a row has several tiles."""
    names = ["dist", "id", "nth", "label", "name_n"]
    kind = T.StructType([T.StructField("dist", T.IntegerType()), *[T.StructField(n, y.schema[n].dataType) for n in names[1:]]])
    schema = T.StructType([T.StructField(n, x.schema[n].dataType) for n in ("category", "words")] + [T.StructField("found", T.ArrayType(kind))])
    out = _cogrouped(x, y, _nearest(max_distance, k, names), schema)
    if several:
        out = out.groupBy("category", "words").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("found"))
    out = out.select("category", "words", F.posexplode("found").alias("_at", "f"))
    return out.select("category", "words", "f.id", "f.label", "f.name_n", "f.dist", (F.col("_at") + 1).alias("rank"))


def nearest_images(asked: DataFrame, index: DataFrame, max_distance: int = NEAR, k: int = TOP_K) -> DataFrame:
    """(category, words, id, label, name_n, dist, rank): for each difference hash asked for (category, words), the k nearest images of index.

    Nearest first, then by product, then by hash. An image counts once for each product that has it.
    """
    tiled, found = _searched(asked, index, max_distance, k)
    out = ([] if found is None else [found]) + ([] if tiled is None else [_ranked(*tiled, max_distance, k)])
    return reduce(DataFrame.unionByName, out)


def _nearest_names(asked: DataFrame, index: DataFrame, max_distance: int, k: int) -> DataFrame:
    """(category, words, name_n, label, first, last): the least and the greatest product, by name and label, of nearest_images(), or of parts of them."""
    tiled, found = _searched(asked, index, max_distance, k)
    one = lambda rows: rows.select("category", "words", "name_n", "label", F.col("id").alias("first"), F.col("id").alias("last"))
    out = [] if found is None else [one(found)]
    if tiled is not None:
        x, y, several = tiled
        schema = T.StructType([T.StructField(n, rows.schema[c].dataType) for rows, n, c in [(x, "category", "category"), (x, "words", "words"), (y, "name_n", "name_n"), (y, "label", "label"), (y, "first", "id"), (y, "last", "id")]])
        out.append(one(_ranked(x, y, several, max_distance, k)) if several else _cogrouped(x, y, _named(max_distance, k), schema))
    return reduce(DataFrame.unionByName, out)


def perceptual_records(cards: DataFrame, images: DataFrame, index: dict[str, DataFrame], max_distance: int = NEAR, k: int = TOP_K, leave_out: bool = False) -> DataFrame:
    """(query_id, id, label, dist, same_name): of each card the products near any of its images, at their least distance.

    k cuts the images near to one image before products are told apart; leave_out drops a card's own product then.
    """
    asked = distinct_fingerprints(images)[1].join(cards.select("id", "category", F.col("name_n").alias("own_name")), "id").withColumnRenamed("id", "query_id")
    near = nearest_images(asked.select("category", "words"), index["dhash"], max_distance, k)
    rows = asked.join(near, ["category", "words"])
    if leave_out:
        rows = rows.where("query_id <> id")
    return rows.groupBy("query_id", "id").agg(F.min("dist").alias("dist"), F.first("label").alias("label"), F.first(F.col("name_n") == F.col("own_name")).alias("same_name"))


def near_summary(cards: DataFrame, images: DataFrame, index: dict[str, DataFrame], max_distance: int = NEAR, k: int = TOP_K, leave_out: bool = False) -> DataFrame:
    """(query_id, near_low, near_high): the labels of a card's perceptual_records() of its own name.

    Neighbours are summed by hash and name before cards are joined: of a label's products the least and the
    greatest tell whether there is one that isn't the card's.
    """
    asked = distinct_fingerprints(images)[1].join(cards.select("id", "category", "name_n"), "id").withColumnRenamed("id", "query_id")
    near = _nearest_names(asked.select("category", "words"), index["dhash"], max_distance, k)
    first, last = (lambda v, c=c: F.when(F.col("label") == v, F.col(c)) for c in ("first", "last"))
    by = near.groupBy("category", "words", "name_n").agg(F.min(first(0)).alias("zero_first"), F.max(last(0)).alias("zero_last"), F.min(first(1)).alias("one_first"), F.max(last(1)).alias("one_last"))
    any_of = lambda v: F.coalesce((F.col(f"{v}_first") != F.col("query_id")) | (F.col(f"{v}_last") != F.col("query_id")), F.lit(False)) if leave_out else F.col(f"{v}_first").isNotNull()
    out = asked.join(by, ["category", "words", "name_n"]).groupBy("query_id").agg(F.max(any_of("zero")).alias("zero"), F.max(any_of("one")).alias("one")).where("zero or one")
    return out.select("query_id", F.when(F.col("zero"), 0).otherwise(1).alias("near_low"), F.when(F.col("one"), 1).otherwise(0).alias("near_high"))


def exact_summary(cards: DataFrame, images: DataFrame, index: dict[str, DataFrame], leave_out: bool = False) -> DataFrame:
    """(query_id, n_exact (2: two or more), exact_low, exact_high, exact_same): products with one of a card's content hashes.

    Hashes are summed before the join, so one that many products share costs a row: of its products the number,
    the least and the greatest tell whether more than one is left, and counts by label which labels are.
    """
    rows = index["sha"]
    named = rows.groupBy("category", "sha", "name_n").agg(F.count("*").alias("namesakes"))
    by = rows.groupBy("category", "sha").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") == 0).alias("zeros"))
    asked = distinct_fingerprints(images)[0].join(cards.select("id", "category", "label", "name_n"), "id")
    own = (F.col("label").isNotNull() if leave_out else F.lit(False)).cast("int")
    joined = asked.join(by, ["category", "sha"]).join(named, ["category", "sha", "name_n"], "left")
    n, mine = F.col("n") - own, lambda v: F.when(F.col("label") == v, own).otherwise(0)
    # With one product left, it is the one of the two that isn't the card's.
    only = F.when((own == 1) & (F.col("id") == F.col("first")), F.col("last")).otherwise(F.col("first"))
    each = joined.select(
        F.col("id").alias("query_id"), n.alias("n"), F.when(n >= 2, F.col("first")).otherwise(only).alias("a"), F.when(n >= 2, F.col("last")).otherwise(only).alias("b"), (n >= 2).alias("several"),
        (F.col("ones") - mine(1) > 0).alias("one"), (F.col("zeros") - mine(0) > 0).alias("zero"), (F.coalesce("namesakes", F.lit(0)) - own > 0).alias("same"),
    ).where("n > 0")
    out = each.groupBy("query_id").agg(F.max("several").alias("several"), F.min("a").alias("a"), F.max("b").alias("b"), F.max("one").alias("one"), F.max("zero").alias("zero"), F.max("same").alias("exact_same"))
    return out.select("query_id", F.when(F.col("several") | (F.col("a") != F.col("b")), 2).otherwise(1).alias("n_exact"), F.when(F.col("zero"), 0).otherwise(1).alias("exact_low"), F.when(F.col("one"), 1).otherwise(0).alias("exact_high"), "exact_same")


def image_decisions(cards: DataFrame, images: DataFrame, index: dict[str, DataFrame], supplement: str, flammable: str, max_distance: int = NEAR, k: int = TOP_K, leave_out: bool = False) -> DataFrame:
    """(id, image_decision, image_reason, image_prob) of every card, as pipeline.evidence_layer() takes it. A card without images abstains."""
    near = near_summary(cards, images, index, max_distance, k, leave_out)
    exact = exact_summary(cards, images, index, leave_out)
    rows = cards.select("id", "category").join(exact.withColumnRenamed("query_id", "id"), "id", "left").join(near.withColumnRenamed("query_id", "id"), "id", "left")
    decision, reason = hamming.decide(F.col("category"), F.coalesce("n_exact", F.lit(0)), F.col("exact_low"), F.col("exact_high"), F.coalesce("exact_same", F.lit(False)), F.col("near_low"), F.col("near_high"), supplement, flammable)
    rows = rows.select("id", decision.alias("image_decision"), reason.alias("image_reason"))
    return rows.withColumn("image_prob", override_prob(F.col("image_decision")))


def memory_votes(cards: DataFrame, index: DataFrame, max_distance: int = NEAR_MEMORY, purity: float = MEMORY_PURITY) -> DataFrame:
    """(id, dhash_label): the label on which enough labelled images near to a card's main image (words) agree.

    index: category, words, label. Labels are counted by hash before the search.
    """
    counts = _readable(index).where("label is not null").groupBy("category", "words").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos"))
    x, y = _spread(_codes(cards), "asked"), _spread(counts, "counts")
    tiled, left = _tiles(x, y, max_distance)
    out = []
    if tiled is not None:
        schema = T.StructType([*[T.StructField(n, x.schema[n].dataType) for n in ("category", "words")], T.StructField("n", T.LongType()), T.StructField("pos", T.LongType())])
        out.append(_cogrouped(*tiled[:2], _votes(max_distance), schema))
    if left is not None:
        near = near_codes(*left, max_distance).join(left[1].withColumnRenamed("words", "y"), ["category", "y"])
        out.append(near.select("category", F.col("x").alias("words"), "n", "pos"))
    votes = reduce(DataFrame.unionByName, out).groupBy("category", "words").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    share = F.col("pos") / F.col("n")
    label = F.when(F.greatest(share, 1.0 - share) >= purity, F.when(share > 0.5, 1).otherwise(0))
    return cards.where("words is not null").join(votes, ["category", "words"]).select("id", label.alias("dhash_label"))


def hash_edges(images: DataFrame, max_distance: int = NEAR_FAMILY) -> DataFrame:
    """(a, b) that join products whose images (id, words) are within the distance: least products of near hashes, and each to its hash's least."""
    rows = images.where("words is not null").select("id", "words").withColumn("every", F.lit(1))
    classes = rows.groupBy("every", "words").agg(F.min("id").alias("rep"))
    near = near_codes(classes, classes, max_distance, ["every"]).where("x <> y")
    across = near.join(classes.select(F.col("words").alias("x"), F.col("rep").alias("a")), "x").join(classes.select(F.col("words").alias("y"), F.col("rep").alias("b")), "y").where("a < b").select("a", "b")
    return across.unionByName(rows.join(classes.drop("every"), "words").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))).distinct()
