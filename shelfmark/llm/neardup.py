"""Near-duplicate documents: MinHash bands propose, odd sketches and full shingle sets decide, components gather.

Copies (equal shingle sets) become one class first, so a group of any number of copies costs one class. A
class's MinHash samples give band keys, and their parity bitmap, the odd sketch, from which the bits in
which two sketches differ estimate the classes' similarity.

In every bucket of a band key the member that shares most buckets is the hub. Each other member is held
against its hub on full sets, which leaves what the member lacks of the hub (a bitmap) and has besides.
Members that link to their hub need nothing more. The others are compared with all members of their
hub, in blocks: sketches first, then the exact intersection, which the two differences from the hub
give. So no pair within a group is ever a row; a block gives as many links as it has members at most.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.batches import bound_batches, map_texts, release, slices
from shelfmark.llm.shingles import mix64, text_shingles
from shelfmark.operators.graph import connected_components
from shelfmark.scratch import new_path, passing, saved, written

#: 32 bands of 6 samples: at a similarity of 0.8 some band agrees but for 6 in 100,000 pairs, at 0.85 for 3 in ten millions.
BANDS, ROWS = 32, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Link at intersection / union >= PERCENT / 100.
PERCENT = 85
#: Sketches rule a pair out if their estimate is below the threshold by so much: over four standard errors.
MARGIN = 0.13
#: Keys of texts to be read again that are broadcast (under 64 MB); more are joined.
WANTED = 1 << 19
#: Members of a block, and bytes of their differences from the hub.
BLOCK, BLOCK_BYTES = 512, 8 << 20

_MULTIPLY = (np.random.default_rng(20).integers(0, 1 << 31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = np.random.default_rng(21).integers(0, 1 << 32, SAMPLES, dtype=np.uint32)


def min_samples(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash values of a set of 64-bit hashes."""
    out = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    top = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(top), 1024):
        part = top[i : i + 1024]
        h = (part[None, :] ^ _ADD[:, None]) * _MULTIPLY[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x9E3779B1)
        np.minimum(out, h.min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, different bands never meaning the same."""
    parts = samples.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, r])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each of SKETCH_BITS bits, as 64-bit words."""
    place = mix64(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def most_differing_bits(similarity: float) -> int:
    """Bits that the sketches of two sets at that estimated similarity differ in."""
    return int(SKETCH_BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - similarity) / SKETCH_BITS)))


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the number of differing bits."""
    share = np.minimum(2 * np.asarray(differing) / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log1p(-share)


def _prints(column: pa.Array) -> list[pa.Array]:
    size, prints, sketches, bands = [], [], [], []
    for s in text_shingles(column):
        size.append(len(s))
        if len(s):
            samples = min_samples(s)
            prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            sketches.append(odd_sketch(samples))
            bands.append(band_keys(samples))
        else:
            prints.append(None)
            sketches.append(None)
            bands.append(None)
    return [pa.array(size, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))]


def _sets(column: pa.Array) -> list[pa.Array]:
    sets = list(text_shingles(column))
    return [pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]


def _differences(batches):
    """(.., mine, hubs) with both sets to what the member has of its hub and besides, and the sizes."""
    for batch in batches:
        rows = batch.to_pydict()
        has, besides, shared = [], [], []
        for mine, hubs in zip(rows["mine"], rows["hubs"], strict=True):
            m, h = np.frombuffer(mine, np.uint64), np.frombuffer(hubs, np.uint64)
            at = np.minimum(np.searchsorted(h, m), len(h) - 1)
            both = h[at] == m
            own = np.zeros(len(h), np.uint8)
            own[at[both]] = 1
            has.append(np.packbits(own).tobytes())
            besides.append(m[~both].tobytes())
            shared.append(int(both.sum()))
        sizes = [pa.array([len(x) // 8 for x in rows[c]], pa.int64()) for c in ("mine", "hubs")]
        keep = [batch.column(batch.schema.get_field_index(c)) for c in ("a", "hub", "sketch")]
        yield pa.RecordBatch.from_arrays([*keep, *sizes, pa.array(shared, pa.int64()), pa.array(has, pa.binary()), pa.array(besides, pa.binary())], names=["a", "hub", "sketch", "n_a", "n_hub", "shared", "has", "besides"])


def _bits(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def _besides_bits(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps over those of the further shingles that both sides have somewhere."""
    every = np.unique(np.concatenate(left)) if left else np.zeros(0, np.uint64)
    columns = np.intersect1d(every, np.unique(np.concatenate(right)) if right else every, assume_unique=True)
    out = []
    for side in (left, right):
        bits = np.zeros((len(side), (len(columns) + 7) // 8 * 8), np.uint8)
        for i, s in enumerate(side):
            if len(columns):
                at = np.minimum(np.searchsorted(columns, s), len(columns) - 1)
                bits[i, at[columns[at] == s]] = 1
        out.append(np.packbits(bits, axis=1))
    return out[0], out[1]


def block_links(left: dict, right: dict, percent: int) -> list[tuple]:
    """Pairs of a forest that joins what the links between the two sides of a block join.

    A side has, by member: a (its key), sketch, has, besides and n_a.
    """
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    most = most_differing_bits(max(0.0, percent / 100 - MARGIN))
    ls, rs = (np.array(side["sketch"], np.int64).view(np.uint64) for side in (left, right))
    hl, hr = _bits(left["has"]), _bits(right["has"])
    theirs = [np.frombuffer(x, np.uint64) for x in right["besides"]]
    for i0 in range(0, len(ls), 256):
        part = slice(i0, i0 + 256)
        differ = np.zeros((len(ls[part]), len(rs)), np.uint16)
        for w in range(ls.shape[1]):
            differ += np.bitwise_count(ls[part, w][:, None] ^ rs[None, :, w])
        i, j = np.nonzero(differ <= most)
        if not len(i):
            continue
        bl, br = _besides_bits([np.frombuffer(x, np.uint64) for x in left["besides"][part]], theirs)
        step = max(1, (8 << 20) // (hl.shape[1] + bl.shape[1] + 1))
        for k in range(0, len(i), step):
            a, b = i[k : k + step], j[k : k + step]
            inter = np.bitwise_count(hl[a + i0] & hr[b]).sum(axis=1, dtype=np.int64) + np.bitwise_count(bl[a] & br[b]).sum(axis=1, dtype=np.int64)
            yes = 100 * inter >= percent * (left["n_a"][a + i0] + right["n_a"][b] - inter)
            for x, y in zip((a + i0)[yes].tolist(), b[yes].tolist(), strict=True):
                p, q = root(left["a"][x]), root(right["a"][y])
                if p != q:
                    parent[p] = q
                    links.append((left["a"][x], right["a"][y]))
    return links


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        parts = [table.filter(pa.array(side == k)) for k in (0, 1)]
        kind = table.schema.field("a").type
        if not all(map(len, parts)):
            return pa.table({"a": pa.array([], kind), "b": pa.array([], kind)})
        sides = [{c: t[c].to_pylist() for c in ("a", "sketch", "has", "besides")} | {"n_a": t["n_a"].to_numpy()} for t in parts]
        links = block_links(*sides, percent)
        return pa.table({"a": pa.array([x for x, _ in links], kind), "b": pa.array([y for _, y in links], kind)})

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", also: dict | None = None) -> DataFrame:
    """(key, *also, n_shingles, print, sketch, bands) of each row; print, sketch and bands are null without shingles."""
    return map_texts(docs, key, text, lambda: _prints, "n_shingles bigint, print binary, sketch array<bigint>, bands array<bigint>", also)


def candidates(prints: DataFrame, key: str, percent: int = PERCENT) -> DataFrame:
    """Distinct (a, a_print, sketch, hub, hub_print): the classes that share a bucket, each with the bucket's hub.

    Where two classes are alone in all buckets that they share, and their sketches differ in too many bits
    for the threshold, the pair is left out here: no third class can need it.
    """
    reps = prints.where(F.col("print").isNotNull()).groupBy("print").agg(F.min(key).alias("a"))
    classes = prints.select(F.col(key).alias("a"), "print", "sketch", "bands").join(reps, ["print", "a"])
    spread = classes.select("a", "print", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").count().where("count > 1")
    members = written(spread.join(shared, "bucket"), "members")
    weight = members.groupBy("a").agg(F.sum("count").alias("weight"))
    hubs = members.join(weight, "a").groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("a").alias("hub"), F.col("print").alias("hub_print"))).alias("h")).select("bucket", "h.hub", "h.hub_print")
    pairs = members.join(hubs, "bucket").where("print <> hub_print").groupBy("a", F.col("print").alias("a_print"), "hub", "hub_print").agg(F.max("count").alias("most"))
    pairs = pairs.join(classes.select(F.col("print").alias("a_print"), "sketch"), "a_print")
    pairs = pairs.join(classes.select(F.col("print").alias("hub_print"), F.col("sketch").alias("hub_sketch")), "hub_print")
    differ = F.aggregate(F.zip_with("sketch", "hub_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.where((F.col("most") > 2) | (differ <= most_differing_bits(max(0.0, percent / 100 - MARGIN)))).select("a", "a_print", "sketch", "hub", "hub_print")


def _wanted_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(print, shingles) of the texts whose keys are wanted.

    Up to WANTED keys travel to the executors, and other texts are dropped where they are read; beyond that
    both sides meet by key.
    """
    keys = wanted.select(F.col("key").alias("_key"))
    if wanted.count() <= WANTED:
        keys = F.broadcast(keys)  # counted
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_own"), F.col(text).cast("string").alias("_text"))
    rows = rows.join(keys, F.col("_own") == F.col("_key"), "left_semi").select("_text")

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays(_sets(piece.column(0)), names=["print", "shingles"])
        release()

    bound_batches(docs.sparkSession)
    return rows.mapInArrow(run, "print binary, shingles binary")


def links(docs: DataFrame, prints: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(a, b) between classes, by their least keys, that join all classes which links join."""
    pairs = written(candidates(prints, key, percent), "pairs")
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("hub").alias("key"))).distinct()
    sets = written(_wanted_sets(docs, wanted, key, text).groupBy("print").agg(F.first("shingles").alias("shingles")), "sets")
    both = pairs.join(sets.select(F.col("print").alias("a_print"), F.col("shingles").alias("mine")), "a_print").join(sets.select(F.col("print").alias("hub_print"), F.col("shingles").alias("hubs")), "hub_print")
    kind = prints.schema[key].dataType.simpleString()
    rows = both.select("a", "hub", "sketch", "mine", "hubs").mapInArrow(_differences, f"a {kind}, hub {kind}, sketch array<bigint>, n_a bigint, n_hub bigint, shared bigint, has binary, besides binary")
    rows = written(rows.withColumn("linked", 100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_hub") - F.col("shared"))), "differences")
    direct = rows.where("linked").select("a", F.col("hub").alias("b"))
    held = F.sum((F.length("has") + F.length("besides")).cast("bigint"))
    groups = rows.groupBy("hub").agg(F.count("*").alias("n"), held.alias("held"), F.count_if(~F.col("linked")).alias("open")).where("n > 1 and open > 0")
    groups = groups.select("hub", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("held") / BLOCK_BYTES)).cast("int").alias("blocks"))
    blocked = rows.join(groups, "hub").withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    what = ["hub", "a", "sketch", "n_a", "has", "besides"]
    left = blocked.where("not linked").select(*what, F.lit(0).alias("side"), F.col("own").alias("i"), F.col("other").alias("j"))
    right = blocked.select(*what, F.lit(1).alias("side"), F.col("other").alias("i"), F.col("own").alias("j"))
    # By one value of all three, as rows that a join has already brought together by hub would stay so, whatever their block.
    both = left.unionByName(right).withColumn("block", F.struct("hub", "i", "j")).drop("hub", "i", "j")
    inner = both.groupBy("block").applyInArrow(_compare(percent), f"a {kind}, b {kind}")
    return direct.unionByName(inner)


def _components(docs: DataFrame, prints: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """Components of the links; what was written on the way to them goes."""
    path = new_path(docs.sparkSession, "components")
    with passing(docs.sparkSession):
        return saved(connected_components(links(docs, prints, key, text, percent)), path)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row: kept is the least key of each group of near-duplicates.

    Documents link if 100 * shared >= percent * all of their distinct shingles; a group is all that links
    join. A text that is null or has no word has no shingles and links with nothing; one of fewer than five
    words has one. Rows that repeat a key are one document where their texts agree, and where they don't,
    the key joins their groups. A row without key links with nothing, has no component and is kept. An empty
    table gives no rows. Further columns are ignored.
    """
    prints = written(fingerprints(docs, key, text).withColumn("print", F.when(F.col(key).isNotNull(), F.col("print"))), "prints")
    component = _components(docs, prints, key, text, percent)
    reps = prints.where(F.col("print").isNotNull()).groupBy("print").agg(F.min(key).alias("node"))
    classes = reps.join(component, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    alone = prints.where(F.col("print").isNull()).select(key, "n_shingles", F.col(key).alias("component_id"))
    rows = prints.where(F.col("print").isNotNull()).select(key, "n_shingles", "print").join(classes, "print", "left").select(key, "n_shingles", "component_id").unionByName(alone)
    return rows.select(key, "n_shingles", "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, one of each group of near-duplicates: that with the least key.

    What counts is a row's own text: rows that repeat a key with texts that no links join are of different
    groups, and each group has its row. Of a key's rows without shingles one stays, as does one of rows that
    agree in key and text: that with the least hash of its columns. Rows without key stay.
    """
    keyed = docs.where(F.col(key).isNotNull())
    node = F.unhex(F.md5(F.concat(F.col(key).cast("string"), F.lit("\0"), F.coalesce(F.col(text).cast("string"), F.lit("")))))
    texts = keyed.select(node.alias("node"), F.col(text).alias("text"), F.col(key).alias("own"))
    prints = written(fingerprints(texts, "node", "text", {"own": F.col("own")}), "prints")
    component = _components(texts, prints, "node", "text", percent)
    some = prints.where(F.col("print").isNotNull()).select("node", "own", "print")
    reps = some.groupBy("print").agg(F.min("node").alias("node"), F.min(F.struct("own", "node")).alias("first"))
    first = reps.join(component, "node", "left").groupBy(F.coalesce("component", "node").alias("group")).agg(F.min("first").alias("first")).select("first.node")
    alone = prints.where(F.col("print").isNull()).groupBy("own").agg(F.min("node").alias("node")).select("node")
    kept = first.unionByName(alone).select(F.col("node").alias("_kept"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    # One shuffle by node: the join finds the grouping's rows where they are.
    one = keyed.groupBy(node.alias("_node")).agg(F.min_by(F.struct(*columns), F.xxhash64(*hashed)).alias("_row"))
    return one.join(kept, F.col("_node") == F.col("_kept"), "left_semi").select("_row.*").unionByName(docs.where(F.col(key).isNull()))
