"""Nearest neighbours by exact cosine within a category, in blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.functions.scores import override_prob

# Neighbours, gate and agreement.
K, COSINE, AGREE = 5, 0.98, 1
#: Vectors of a side of a block.
BLOCK = 4096


def _block(k: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        q, t = (table.filter(pa.array(side == s)) for s in (0, 1))
        out: tuple[list, list, list, list] = ([], [], [], [])
        if len(q) and len(t):
            unit = []
            for part in (q, t):
                x = np.array(part["vector"].to_pylist(), np.float64)
                unit.append(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9))
            ids, labels, queries = t["id"].to_numpy(), t["label"].to_numpy(), q["id"].to_numpy()
            for i in range(0, len(queries), 512):
                sims = unit[0][i : i + 512] @ unit[1].T
                for row, query in zip(sims, queries[i : i + 512].tolist(), strict=True):
                    near = np.flatnonzero((row >= least) & (ids != query))
                    best = near[np.lexsort((ids[near], -row[near]))[:k]]
                    out[0].extend([query] * len(best))
                    out[1].extend(ids[best].tolist())
                    out[2].extend(row[best].tolist())
                    out[3].extend(labels[best].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "cosine": pa.array(out[2], pa.float64()), "label": pa.array(out[3], pa.int32())})

    return run


def top_k(queries: DataFrame, train: DataFrame, k: int = K, least: float = COSINE) -> DataFrame:
    """(query_id, id, cosine, label, rank): each query's nearest train rows of its category from the gate up.

    queries has id, category, vector; train has label as well; a row is never its own neighbour. Both sides
    of a category are dealt to blocks by hash; every pair of blocks gives each query k rows at most, of which
    the best k stay. Vectors that are null, zero or of another length than the block's are left out before.
    """
    usable = F.col("vector").isNotNull() & F.exists("vector", lambda v: v != 0)
    dims = F.size("vector").alias("dim")
    q = queries.where(usable).select("id", "category", dims, "vector", F.lit(None).cast("int").alias("label"), F.lit(0).alias("side"))
    t = train.where(usable).select("id", "category", dims, "vector", F.col("label").cast("int").alias("label"), F.lit(1).alias("side"))
    both = q.unionByName(t)
    sizes = both.groupBy("category", "dim").agg(F.ceil(F.count_if(F.col("side") == 0) / BLOCK).cast("int").alias("qs"), F.ceil(F.count_if(F.col("side") == 1) / BLOCK).cast("int").alias("ts")).where("qs > 0 and ts > 0")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = q.join(sizes, ["category", "dim"]).withColumn("i", own("qs")).withColumn("j", spread("ts"))
    right = t.join(sizes, ["category", "dim"]).withColumn("j", own("ts")).withColumn("i", spread("qs"))
    found = left.unionByName(right).groupBy("category", "dim", "i", "j").applyInArrow(_block(k, least), "query_id bigint, id bigint, cosine double, label int")
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def transfer(cards: DataFrame, found: DataFrame, agree: int = AGREE) -> DataFrame:
    """Adds knn_decision, knn_reason and knn_prob to cards (id): the neighbours' label where all of them, enough, agree."""
    votes = found.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("label").alias("_low"), F.max("label").alias("_high"))
    out = cards.join(votes, F.col("id") == F.col("query_id"), "left")
    decision = F.when((F.col("_n") >= agree) & (F.col("_low") == F.col("_high")), F.col("_low")).cast("int")
    out = out.withColumn("knn_decision", decision)
    reason = F.when(F.col("knn_decision").isNotNull(), F.concat(F.lit("knn_"), F.when(F.col("knn_decision") == 1, "pos").otherwise("neg"), F.lit("_"), F.col("_n").cast("string")))
    return out.withColumn("knn_reason", reason).withColumn("knn_prob", override_prob(F.col("knn_decision"))).drop("_n", "_low", "_high", "query_id")
