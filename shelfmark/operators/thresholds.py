"""Decision thresholds and F1 searches, grouped by score first so that ties count together.

After the grouping a category has as many rows as distinct scores; the running sums of a category run in
two steps, within ranges of the score and over the ranges' totals, so that no category meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranges of a score, the plateau's tolerance, and the threshold without positives.
RANGES = 256
PLATEAU = 1e-12
NO_THRESHOLD = 0.5


def score_groups(rows: DataFrame, by: list[str], prob: str = "prob", label: str = "label") -> DataFrame:
    """(*by, prob, k, tp, positives): at each distinct score, rows and positives from there up."""
    each = rows.where(F.col(prob).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(prob).alias("prob")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("p"))
    each = each.withColumn("range", F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor(F.col("prob") * RANGES).cast("int"))))
    totals = each.groupBy(*by, "range").agg(F.sum("n").alias("rn"), F.sum("p").alias("rp"))
    over = Window.partitionBy(*by).orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    totals = totals.select(*by, "range", F.coalesce(F.sum("rn").over(over), F.lit(0)).alias("above_n"), F.coalesce(F.sum("rp").over(over), F.lit(0)).alias("above_p"), F.sum("rp").over(whole).alias("positives"))
    inside = Window.partitionBy(*by, "range").orderBy(F.desc("prob")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = each.join(totals, [*by, "range"])
    return out.select(*by, "prob", (F.col("above_n") + F.sum("n").over(inside)).alias("k"), (F.col("above_p") + F.sum("p").over(inside)).alias("tp"), "positives")


def best_threshold(rows: DataFrame, by: list[str], prob: str = "prob", label: str = "label") -> DataFrame:
    """(*by, best_f1, threshold): the exact best F1 and the median of the scores, a row each, at its plateau.

    Scores are cut only where they change. Without positives, or where no cut reaches any, (0, NO_THRESHOLD).
    """
    f1 = score_groups(rows, by, prob, label).withColumn("f1", F.when(F.col("positives") > 0, 2.0 * F.col("tp") / (F.col("k") + F.col("positives"))).otherwise(0.0))
    top = f1.groupBy(*by).agg(F.max("f1").alias("best"))
    plateau = f1.join(top, by).where(F.col("f1") >= F.col("best") - PLATEAU)
    return plateau.groupBy(*by).agg(F.max("best").alias("b"), F.percentile("prob", F.lit(0.5)).alias("t")).select(*by, F.when(F.col("b") > 0, F.col("b")).otherwise(0.0).alias("best_f1"), F.when(F.col("b") > 0, F.col("t")).otherwise(NO_THRESHOLD).alias("threshold"))


def best_f1(rows: DataFrame, by: list[str], prob: str = "prob", label: str = "label") -> DataFrame:
    """(*by, best_f1, threshold): the best F1 of all cuts and the highest score, a row's own, that reaches it."""
    f1 = score_groups(rows, by, prob, label).withColumn("f1", 2.0 * F.col("tp") / (F.col("k") + F.col("positives")))
    return f1.groupBy(*by).agg(F.max(F.struct("f1", "prob")).alias("m")).select(*by, F.col("m.f1").alias("best_f1"), F.col("m.prob").alias("threshold"))


def f1_curve(rows: DataFrame, by: list[str], steps: int, first: int = 1, prob: str = "prob", label: str = "label") -> DataFrame:
    """(*by, threshold, tp, fp, fn, f1) at thresholds i / steps, i from first up to steps - first.

    Rows fall into the bucket of the highest threshold that they reach; buckets, not rows, are summed upwards.
    """
    last = steps - first
    at = F.least(F.lit(last), F.floor(F.col(prob) * steps + 1e-9).cast("int"))
    usable = rows.where(F.col(prob).isNotNull() & F.col(label).isNotNull())
    each = usable.groupBy(*by, at.alias("i")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("bigint")).alias("p"))
    keys = each.select(*by).distinct()
    grid = keys.withColumn("i", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("n", F.lit(0).cast("bigint")).withColumn("p", F.lit(0).cast("bigint"))
    full = each.unionByName(grid).groupBy(*by, "i").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    up, whole = Window.partitionBy(*by).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*by)
    full = full.withColumn("k", F.sum("n").over(up)).withColumn("tp", F.sum("p").over(up)).withColumn("pos", F.sum("p").over(whole)).where(F.col("i") >= first)
    f1 = F.when(F.col("k") + F.col("pos") > 0, 2.0 * F.col("tp") / (F.col("k") + F.col("pos"))).otherwise(0.0)
    return full.select(*by, (F.col("i").cast("double") / steps).alias("threshold"), "tp", (F.col("k") - F.col("tp")).alias("fp"), (F.col("pos") - F.col("tp")).alias("fn"), f1.alias("f1"))


def grid_threshold(curve: DataFrame, by: list[str]) -> DataFrame:
    """(*by, best_f1, threshold) from a curve: the median of its plateau."""
    top = curve.groupBy(*by).agg(F.max("f1").alias("best_f1"))
    return curve.join(top, by).where(F.col("f1") >= F.col("best_f1") - PLATEAU).groupBy(*by, "best_f1").agg(F.percentile("threshold", F.lit(0.5)).alias("threshold"))


def robustness(curve: DataFrame, chosen: DataFrame, by: list[str], around: tuple[float, ...] = (0.05, 0.10)) -> DataFrame:
    """The least F1 within each distance of the chosen threshold."""
    near = curve.join(chosen.select(*by, F.col("threshold").alias("_t")), by)
    least = [F.min(F.when(F.abs(F.col("threshold") - F.col("_t")) <= d + 1e-9, F.col("f1"))).alias(f"min_f1_{round(d * 100)}") for d in around]
    return near.groupBy(*by).agg(*least)


def competition_metric(curve: DataFrame, category: str = "category") -> DataFrame:
    """Mean over categories of their best F1 on the curve."""
    return curve.groupBy(category).agg(F.max("f1").alias("best")).agg(F.avg("best").alias("metric"), F.count("*").alias("n_categories"))


def seed_summary(thresholds: DataFrame, by: list[str]) -> DataFrame:
    """Median threshold and mean and deviation of F1 over seeds."""
    return thresholds.groupBy(*by).agg(F.percentile("threshold", F.lit(0.5)).alias("threshold"), F.avg("best_f1").alias("mean_f1"), F.stddev_pop("best_f1").alias("sd_f1"), F.count("*").alias("n_seeds"))


def blend_search(rows: DataFrame, mix: Column, weights: list[float], by: list[str]) -> DataFrame:
    """(*by, w, best_f1, threshold) for each weight; mix is a Column over the row and w."""
    each = rows.withColumn("w", F.explode(F.array(*[F.lit(w) for w in weights]))).withColumn("prob", mix)
    return best_threshold(each, [*by, "w"])


def best_weight(searched: DataFrame, by: list[str]) -> DataFrame:
    """The weight of the highest F1 (the least of equals), with its threshold."""
    top = searched.groupBy(*by).agg(F.min(F.struct((-F.col("best_f1")).alias("f"), "w", "threshold")).alias("m"))
    return top.select(*by, F.col("m.w").alias("w"), (-F.col("m.f")).alias("best_f1"), F.col("m.threshold").alias("threshold"))


def honest_blend(rows: DataFrame, mix: Column, weights: list[float], folds: int) -> DataFrame:
    """(category, f1): weight and threshold chosen on the other folds, applied to each fold, F1 over all of them."""
    others = rows.withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).where(F.col("held") != F.col("fold"))
    chosen = best_weight(blend_search(others, mix, weights, ["category", "held"]), ["category", "held"]).select("category", F.col("held").alias("fold"), "w", F.col("threshold").alias("t"))
    applied = rows.join(chosen, ["category", "fold"]).withColumn("pred", (mix >= F.col("t")).cast("int"))
    tp, fp, fn = F.count_if((F.col("pred") == 1) & (F.col("label") == 1)), F.count_if((F.col("pred") == 1) & (F.col("label") == 0)), F.count_if((F.col("pred") == 0) & (F.col("label") == 1))
    return applied.groupBy("category").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")).withColumn("f1", F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0))
