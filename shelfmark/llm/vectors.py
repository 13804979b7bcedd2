"""Near-duplicate embeddings: inverted lists with product-quantised residuals propose, exact cosines decide.

Equal vectors of one label become one class first. A coarse quantiser and a codebook for each subspace of
the residuals are fitted on a bounded sample; every class is coded and listed in its nearest cell, and
looks for others in those of its PROBES nearest cells that can hold one: a cell beyond a plane midway
between two centres that is farther than two linked vectors can be holds none. Within a cell, asymmetric
distances from each prober's lookup table to the listed codes rule out what cannot be near: a listed
vector is no farther from its code than its stored error, so by the triangle inequality no pair that meets
in a cell is lost. The rest are compared by cosine in double precision.

Neighbouring cells are one region while it has about REGION classes of a label, so a vector travels once to
each region that it probes. Regions are compared in blocks of bounded size, and a block gives sums of
links by class and a forest of links, not the pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import bound_batches
from shelfmark.operators.graph import connected_components
from shelfmark.scratch import new_path, passing, saved, written

THRESHOLD = 0.93
#: Cells are the root of the number of classes, up to MOST_CELLS. The fit sees four classes a cell, but SAMPLE at least.
SAMPLE, MOST_CELLS = 4096, 1 << 14
#: Classes of a label that a region has on average.
REGION = 4096
LISTED_ONLY, PROBES_ONLY, LISTED_AND_PROBES = 0, 1, 2
PROBES, SUBSPACES, CODES = 8, 8, 32
#: Classes of a side of a block.
BLOCK = 8192


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 9) -> np.ndarray:
    """k centres of the rows of x (fewer rows: the rows)."""
    k = min(k, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest centres of each row, nearest first, ties by index."""
    d = (centres**2).sum(axis=1)[None] - 2 * (x @ centres.T)
    if n == 1:
        return d.argmin(axis=1)[:, None]
    n = min(n, len(centres))
    part = np.sort(np.argpartition(d, n - 1, axis=1)[:, :n], axis=1)
    return np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, axis=1), axis=1, kind="stable"), axis=1)


@dataclass
class Quantiser:
    """Centres of the cells, each cell's region, and for each subspace (a range of dimensions) the codebook of residuals."""

    centres: np.ndarray
    regions: np.ndarray
    cuts: list[int]
    books: list[np.ndarray]

    def encode(self, unit: np.ndarray, probes: int, reach: float) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
        """Probed cells (home first), codes of the residual from home, and the error of the coded vector."""
        cells = nearest(unit, self.centres, probes)
        home = self.centres[cells[:, 0]]
        rest = unit - home
        far = np.stack([((unit - self.centres[c]) ** 2).sum(axis=1) - (rest**2).sum(axis=1) - 2 * reach * np.linalg.norm(self.centres[c] - home, axis=1) for c in cells.T], axis=1)
        codes = np.stack([nearest(rest[:, a:b], book, 1)[:, 0] for a, b, book in zip(self.cuts, self.cuts[1:], self.books, strict=False)], axis=1)
        coded = np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)
        return [c[k].tolist() for c, k in zip(cells, far <= 1e-9, strict=True)], codes.astype(np.uint8), np.linalg.norm(rest - coded, axis=1)

    def distances(self, cell: int, unit: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (probers, listed) by lookup tables."""
        rest = unit - self.centres[cell]
        out = np.zeros((len(unit), len(codes)))
        for m, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books, strict=False)):
            part = rest[:, a:b]
            table = (part**2).sum(axis=1)[:, None] - 2 * part @ book.T + (book**2).sum(axis=1)[None]
            out += table[:, codes[:, m]]
        return np.sqrt(np.maximum(out, 0))


def fit(sample: np.ndarray, cells: int, regions: int = 1) -> Quantiser:
    """A quantiser from unit vectors of one dimension."""
    d = sample.shape[1]
    centres = kmeans(sample, cells)
    rest = sample - centres[nearest(sample, centres, 1)[:, 0]]
    cuts = np.linspace(0, d, min(SUBSPACES, d) + 1).astype(int).tolist()
    near = nearest(centres, kmeans(centres, regions), 1)[:, 0] if regions < len(centres) else np.arange(len(centres))
    return Quantiser(centres, near, cuts, [kmeans(rest[:, a:b], CODES) for a, b in zip(cuts, cuts[1:], strict=False)])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column, all of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(models: dict[int, Quantiser], probes: int, reach: float, names: list[str], kind: str):
    """(.., vector, codes, error, cells, and `at`: of each region that the class probes, whether its home is there)."""

    def run(batches):
        for batch in batches:
            dims = np.array(batch.column(batch.schema.get_field_index("dim")))
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                x = _matrix(part.column(part.schema.get_field_index("embedding")), d)
                if d in models:
                    cells, codes, error = models[d].encode(_unit(x), probes, reach)
                    region = models[d].regions
                else:  # a length that the sample doesn't have: one cell, compared exactly
                    cells, codes, error, region = [[0]] * len(x), np.zeros((len(x), 0), np.uint8), np.zeros(len(x)), np.zeros(1, int)
                at = [[{"region": int(g), "home": bool(g == region[c[0]])} for g in np.unique(region[c])] for c in cells]
                keep = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*keep, pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float32()), pa.array(cells, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.struct([("region", pa.int32()), ("home", pa.bool_())])))],
                    names=[*names, "vector", "codes", "error", "cells", "at"],
                )

    return run


def _compare(models: dict[int, Quantiser], threshold: float, kind: str):
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def run(table: pa.Table) -> pa.Table:
        key = table.schema.field("a").type
        side = table["side"].to_numpy()
        lists, probers = table.filter(pa.array(side != PROBES_ONLY)), table.filter(pa.array(side != LISTED_ONLY))
        sums, links, parent = {}, [], {}

        def root(i):
            while parent.setdefault(i, i) != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        if len(lists) and len(probers):
            dim = table["block"][0]["dim"].as_py()
            model = models.get(dim)
            bytes_of = lambda t, c, k: np.frombuffer(b"".join(t[c].to_pylist()), k).reshape(len(t), -1)
            x, y = (_unit(bytes_of(t, "vector", kind)) for t in (lists, probers))
            xa, ya, xn, yn = (t[c].to_pylist() for c in ("a", "copies") for t in (lists, probers))
            probed, wanted = lists["cells"].to_pylist(), probers["cells"].to_pylist()
            error = lists["error"].to_numpy().astype(float) + 1e-6  # the error travels in single precision
            codes = bytes_of(lists, "codes", np.uint8) if model else None
            asks: dict[int, list[int]] = {}
            for p, c in enumerate(wanted):
                for cell in c:
                    asks.setdefault(cell, []).append(p)
            homes = np.array([c[0] for c in probed])
            for cell in np.unique(homes).tolist():
                here, who = np.flatnonzero(homes == cell), np.array(asks.get(cell, []), int)
                for i0 in range(0, len(who), 256):
                    part = who[i0 : i0 + 256]
                    near = model.distances(cell, y[part], codes[here]) <= reach + error[here][None] + 1e-9 if model else np.ones((len(part), len(here)), bool)
                    q, k = np.nonzero(near)
                    for s in range(0, len(q), 1 << 14):
                        a, b = part[q[s : s + (1 << 14)]], here[k[s : s + (1 << 14)]]
                        yes = np.einsum("ij,ij->i", y[a], x[b]) >= threshold
                        for p, l in zip(a[yes].tolist(), b[yes].tolist(), strict=True):
                            # A pair that meets twice counts once: in the lesser of its two cells, or from the lesser class of one.
                            home = wanted[p][0]
                            if (xa[l] < ya[p]) if home == cell else not (home < cell and home in probed[l]):
                                sums[xa[l]] = sums.get(xa[l], 0) + yn[p]
                                sums[ya[p]] = sums.get(ya[p], 0) + xn[l]
                                u, v = root(xa[l]), root(ya[p])
                                if u != v:
                                    parent[u] = v
                                    links.append((xa[l], ya[p]))
        ids = list(sums)
        return pa.table({"a": pa.array(ids + [u for u, _ in links], key), "b": pa.array([None] * len(ids) + [v for _, v in links], key), "n": pa.array([sums[i] for i in ids] + [0] * len(links), pa.int64())})

    return run


def _models(classes: DataFrame, cells: int | None) -> dict[int, Quantiser]:
    """A quantiser for each length of vectors among the classes with the least hashes."""
    total, labels = classes.agg(F.count("*"), F.countDistinct("label")).first()
    many = min(MOST_CELLS, round(total**0.5))
    sample = classes.orderBy(F.xxhash64("a"), "a").limit(max(SAMPLE, 4 * many)).select("dim", "embedding").toArrow()
    models, dims = {}, sample["dim"].to_numpy()
    for d in np.unique(dims).tolist():
        unit = _unit(_matrix(sample["embedding"].filter(pa.array(dims == d)), d))
        models[d] = fit(unit, cells or max(1, min(many, len(unit) // 4)), max(1, round(total / max(1, labels) / REGION)))
    return models


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, probes: int = PROBES, cells: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) for each row.

    Vectors link if their labels are equal and not null and their cosine is at least threshold; n_links counts
    the other keys linked directly, component_id is the least key that links reach. A vector that is null,
    empty or zero or holds a null or non-finite value links with nothing, nor do vectors of different
    lengths. Rows that repeat a key and its vector are one vector; a key with several vectors joins their
    groups. A row without key links with nothing, has no component and is kept. An empty table gives no
    rows. The quantiser is fitted on the SAMPLE (or more) classes with the least hashes, all rows are indexed; what
    is lost are pairs neither of whose homes is among the other's `probes` cells.
    """
    kind = "<f4" if rows.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    base = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).cast("array<float>" if kind == "<f4" else "array<double>").alias("embedding"))
    whole = F.col("key").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    base = base.withColumn("good", F.coalesce(whole, F.lit(False)))
    # Equal vectors are told by 128 bits of hashes, so that vectors are shuffled once to be classes.
    good = base.where("good").select("key", "label", "embedding", F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit("more"), "embedding").alias("g"))
    by = ["label", "h", "g"]
    copies = good.select(*by, "key").distinct().groupBy(*by).agg(F.min("key").alias("a"), F.count("*").alias("copies"))
    classes = good.groupBy(*by).agg(F.first("embedding").alias("embedding")).join(copies, by).withColumn("dim", F.size("embedding"))
    classes = written(classes.select("label", "a", "copies", "dim", "embedding", "h", "g"), "classes")
    models = _models(classes, cells)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    id_kind, label_kind = base.schema["key"].dataType.simpleString(), base.schema["label"].dataType.simpleString()
    names = ["label", "a", "copies", "dim"]
    bound_batches(rows.sparkSession)
    made = f"label {label_kind}, a {id_kind}, copies bigint, dim int, vector binary, codes binary, error float, cells array<int>, at array<struct<region:int,home:boolean>>"
    path, spark = new_path(rows.sparkSession, "links"), rows.sparkSession
    with passing(spark):  # codes and placements go, links stay
        coded = written(classes.select(*names, "embedding").mapInArrow(_coded(models, probes, reach, names, kind), made), "coded")
        # A region's list and its probers; who lists there also probes there.
        placed = coded.select("*", F.inline("at"))
        at = ["label", "dim", "region"]
        sizes = placed.select(*at, "home").groupBy(*at).agg(F.count_if("home").alias("l"), F.count("*").alias("p")).where("l > 0 and p > 1")
        sizes = sizes.select(*at, F.ceil(F.col("l") / BLOCK).cast("int").alias("ls"), F.ceil(F.col("p") / BLOCK).cast("int").alias("ps"))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("a"), F.col(n)).cast("int")
        both = placed.join(sizes, at)
        # In a region of one block a class that is at home there is a row of both sides.
        one = F.col("ls") * F.col("ps") == 1
        left = both.where(F.col("home") & ~one).withColumn("i", own("ls")).withColumn("j", spread("ps")).withColumn("side", F.lit(LISTED_ONLY))
        right = both.withColumn("j", own("ps")).withColumn("i", spread("ls")).withColumn("side", F.when(F.col("home") & one, F.lit(LISTED_AND_PROBES)).otherwise(PROBES_ONLY))
        right = right.withColumn("codes", F.when(F.col("side") == LISTED_AND_PROBES, F.col("codes")))
        what = [F.struct(*at, "i", "j").alias("block"), "side", "a", "copies", "vector", "cells", "codes", "error"]
        found = left.select(*what).unionByName(right.select(*what)).groupBy("block").applyInArrow(_compare(models, threshold, kind), f"a {id_kind}, b {id_kind}, n bigint")
        found = saved(found, path)
    path = new_path(spark, "components")
    with passing(spark):
        component = saved(connected_components(found.where("b is not null").select("a", "b")), path)
    direct = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    nodes = classes.select(*by, F.col("a").alias("node"), "copies").join(direct, "node", "left").join(component, "node", "left")
    nodes = nodes.select(*by, (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).cast("bigint").alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = good.select("key", *by).join(nodes, by).select("key", "n_links", "component_id")
    out = out.unionByName(base.where(~F.col("good")).select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))
