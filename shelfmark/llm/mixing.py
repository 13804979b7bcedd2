"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a fixed 60-bit hash of its id and text. Where a source's target asks for k + f copies of it
(k whole, 0 <= f < 1), each document is taken k times, and once more if its hash is under the source's
threshold. The threshold comes from histograms: sizes summed by source and by the hash's leading digits,
the bucket that crosses the budget found by a running sum, and only that bucket summed again by the next
digits. Nothing is sorted or collected by document: each level shuffles at most BUCKETS sums a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.scratch import written

WORDS = r"[^\x20\x09-\x0D]+"
#: Fixed values of the mix: weights by rank of the source, and the most often a document is repeated.
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: A hash has LEVELS digits of BITS bits.
BITS, LEVELS = 10, 3
BUCKETS = 1 << BITS


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def row_hash(key: Column, text: Column) -> Column:
    """60 bits of MD5 of key, ':' and text (nulls: empty), so that rows without key, or that share one, spread as well."""
    whole = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("bigint")


def _digit(level: int) -> Column:
    return F.shiftrightunsigned("hash", 60 - BITS * (level + 1)).bitwiseAND(BUCKETS - 1).cast("int")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in order of code points, null last, get `weights` in turn, and targets share the sum of all
    sizes by weight; none is above `most` times its source's size: what is over goes to the others by
    weight. In order of size a weight, a source is capped if its cap is not above its share of what the
    sources before it have left, which settles all rounds of resharing at once. One row a source passes
    through one task; documents don't. A source without words has target 0.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", pick.cast("bigint")).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    all_rows, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    ranked = ranked.withColumn("among", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ranked = ranked.withColumn("capped", F.col("cap") * F.col("among") <= F.col("left") * F.col("weight"))
    free = F.when(~F.col("capped"), F.col("rank"))
    ranked = ranked.withColumn("rest", F.max(F.when(free.isNotNull(), F.col("left"))).over(all_rows)).withColumn("sharing", F.max(F.when(free.isNotNull(), F.col("among"))).over(all_rows))
    shared = F.col("weight").cast("double") * F.col("rest").cast("double") / F.col("sharing").cast("double")
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def _bounds(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source_, base, source_size, target, prefix) by source, from rows of source, size and hash: each row is taken
    base times, and once more if the first LEVELS digits of its hash are under prefix."""
    plan = targets(rows, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("base", F.least(F.floor(ratio), F.lit(most)).cast("bigint"))
    plan = written(plan.withColumn("budget", F.greatest(F.lit(0.0), F.col("target") - F.col("base") * F.col("source_size"))).withColumn("source_", F.col("source")).drop("source"), "plan")
    at = plan.select("source_", "base", "source_size", "target", F.col("budget"), F.lit(0).cast("bigint").alias("prefix"))
    for level in range(LEVELS):
        inside = rows.join(at, F.col("source").eqNullSafe(F.col("source_"))).where(F.shiftrightunsigned("hash", 60 - BITS * level) == F.col("prefix"))
        sums = inside.groupBy("source_", _digit(level).alias("digit")).agg(F.sum("size").alias("words"), F.first("budget").alias("budget"))
        order = Window.partitionBy("source_").orderBy("digit")
        sums = sums.withColumn("upto", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        fits = sums.groupBy(F.col("source_").alias("s")).agg(F.max(F.when(F.col("upto") <= F.col("budget"), F.col("upto"))).alias("used"), F.coalesce(F.min(F.when(F.col("upto") > F.col("budget"), F.col("digit"))), F.lit(BUCKETS)).alias("digit"))
        joined = at.join(fits, F.col("source_").eqNullSafe(F.col("s")), "left")
        # A prefix past the last bucket (all of it fits) takes everything below it and leaves nothing inside.
        at = joined.select("source_", "base", "source_size", "target", (F.col("budget") - F.coalesce("used", F.lit(0))).alias("budget"), (F.shiftleft("prefix", BITS) + F.coalesce("digit", F.lit(0))).alias("prefix"))
        at = written(at, "bounds")
    edge = rows.join(at, F.col("source").eqNullSafe(F.col("source_"))).where(F.shiftrightunsigned("hash", 60 - BITS * LEVELS) == F.col("prefix")).groupBy("source_").agg(F.sum("size").alias("edge"))
    edge = edge.select(F.col("source_").alias("s"), "edge")
    # The last bucket goes in if that brings the sum nearer to the target.
    bounds = at.join(edge, F.col("source_").eqNullSafe(F.col("s")), "left").select("source_", "base", "source_size", "target", (F.col("prefix") + F.when(2 * F.col("budget") > F.coalesce("edge", F.lit(0)), 1).otherwise(0)).alias("prefix"))
    # Written, its size is known, and Spark broadcasts it while it is under its threshold instead of shuffling rows.
    return written(bounds, "bounds")


def _copies(rows: DataFrame, bounds: DataFrame, most: int) -> DataFrame:
    extra = (F.shiftrightunsigned("hash", 60 - BITS * LEVELS) < F.col("prefix")).cast("bigint")
    return rows.join(bounds, F.col("source").eqNullSafe(F.col("source_"))).withColumn("copies", F.least(F.col("base") + extra, F.lit(most)))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source, source_size, target, copies) for each row of docs.

    docs has key, text and source; further columns are ignored. A null text has size 0, a null source is a
    source of its own, a null key is a key, and rows that agree in key and text share one decision. copies is 0
    to `most`. The words taken from a source miss its target by no more than the sizes of the rows whose hashes
    share the last bucket, one row at most unless rows agree in key and text. An empty table gives no rows.
    """
    rows = written(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), row_hash(F.col(key), F.col(text)).alias("hash")), "sizes")
    out = _copies(rows, _bounds(rows, weights, most), most)
    return out.select(F.col("key").alias(key), "size", F.col("source").alias(source), "source_size", "target", "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, all columns, each as often as mix() takes it (see there for nulls, repeats and empty tables).

    Texts are not shuffled: only the bounds are joined.
    """
    rows = written(docs.select(F.col(source).alias("source"), word_count(F.col(text)).alias("size"), row_hash(F.col(key), F.col(text)).alias("hash")), "sizes")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"), row_hash(F.col(key), F.col(text)).alias("hash"))
    out = _copies(whole, _bounds(rows, weights, most), most).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")
