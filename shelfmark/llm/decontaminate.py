"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact weighted shingles.

A window that holds no shingle of any item has similarity 0 with all of them, so only the others are
fingerprinted: around each place where a text has an item's shingle, all windows of the item's size. The
windows of one size that touch are one run, and running sums over the run's signed weights give every window's
fingerprint by a difference, so a run costs its length, not its windows times theirs.

Items whose fingerprint is within RADIUS bits are candidates: of a few wide blocks of bits at least one differs in
no more than RADIUS / blocks. So is every item of whose shingles a window holds the weight that the similarity
asks for, however far the fingerprints are. Candidates are settled by sum(min) / sum(max) over both multisets
of shingles, each shingle weighing the characters of its words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfmark.llm.batches import map_texts, text_filter
from shelfmark.llm.shingles import SHINGLE_WORDS, mix64, shingle_hashes, text_bytes, word_bounds, word_hashes

SIMILARITY = 0.8
#: At a similarity of 0.8 13 of 64 bits differ on average, so the radius finds most windows that are near and nearly
#: all that are nearer; the rest is found by weight.
BITS, RADIUS = 64, 15
#: Blocks of an index of few fingerprints and of one of at least so many.
FEW_BLOCKS, MANY_BLOCKS, MANY = 8, 4, 12_000
#: Words of the items that are looked for in one pass over the documents (their index then takes some 30 MB).
WORDS_A_PASS = 400_000
#: Shingles that are summed at once, starts of a run that are taken at once, and pairs that are expanded at once.
SUM_ROWS, STARTS, PAIRS = 1 << 14, 1 << 11, 1 << 20
_FILTER = 22

_KEEP = np.ones(256, dtype=bool)
_KEEP[[i for i in range(33, 127) if not chr(i).isalnum()]] = False


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and length of every word, without ASCII punctuation, and for each text the words before it."""
    data, offsets = text_bytes(column)
    keep = _KEEP[data]
    gone = np.concatenate([[0], np.cumsum(~keep)])
    data, offsets = data[keep], offsets - gone[offsets]
    starts, ends, counts = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), (ends - starts), counts


class Runs:
    """Shingles of one size over a batch: hash and weight at each word where one starts, in texts of enough words."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, counts: np.ndarray, size: int) -> None:
        n = np.diff(counts)
        hashes, before = shingle_hashes(words, counts, size)
        whole = np.repeat(n >= size, np.diff(before))
        text = np.repeat(np.arange(len(n)), np.diff(before))
        self.hash = hashes[whole]
        self.text = text[whole]
        self.place = (np.arange(len(hashes)) - before[text])[whole]
        self.first = np.searchsorted(self.text, np.arange(len(n) + 1))
        sums = np.concatenate([[0], np.cumsum(lengths)])
        at = counts[self.text] + self.place
        self.weight = sums[at + size] - sums[at] if len(at) else np.zeros(0, np.int64)


def simhash(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of consecutive groups of shingles, groups beginning at starts."""
    bits = np.unpackbits(mix64(hashes + np.uint64(0x51)).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64) * 2 - 1
    return np.packbits(np.add.reduceat(bits * weights[:, None], starts, axis=0) > 0, axis=1).view(np.uint64)[:, 0]


def window_prints(runs: Runs, row: np.ndarray, count: np.ndarray, n: np.ndarray):
    """Yields (run, fingerprint) arrays of windows, in order: of run k those of n[k] shingles that begin at row[k], row[k] + 1, .. (count[k] of them)."""
    long = count + n - 1
    ends, at = np.cumsum(long), 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SUM_ROWS, side="right")))
        size, many = long[at:to], count[at:to]
        begin = np.cumsum(size) - size
        rows = np.repeat(row[at:to] - begin, size) + np.arange(int(size.sum()))
        sums = np.zeros((len(rows) + 1, BITS), np.int64)
        np.cumsum((np.unpackbits(mix64(runs.hash[rows] + np.uint64(0x51)).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64) * 2 - 1) * runs.weight[rows][:, None], axis=0, out=sums[1:])
        run = np.repeat(np.arange(at, to), many)
        start = begin[run - at] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
        yield run, np.packbits(sums[start + n[run]] - sums[start] > 0, axis=1).view(np.uint64)[:, 0]
        at = to


class MultiIndex:
    """All indexed fingerprints within a radius of a queried one, by disjoint blocks of bits.

    If the whole differs in no more than the radius, some block differs in no more than its share of it, rounded
    down. So a query looks into the buckets of all values that near to its own, block by block.
    """

    def __init__(self, prints: np.ndarray, radius: int) -> None:
        self.prints, self.radius, self.looked = prints, radius, 0
        blocks = MANY_BLOCKS if len(prints) >= MANY else FEW_BLOCKS
        wide, reach = BITS // blocks, radius // blocks
        every = np.arange(1 << wide)
        self.masks = every[np.bitwise_count(every) <= reach]
        self.wide, self.blocks = wide, []
        for a in range(0, BITS, wide):
            value = self._value(prints, a)
            order = np.argsort(value, kind="stable")
            self.blocks.append((a, order, np.searchsorted(value[order], np.arange((1 << wide) + 1))))

    def _value(self, prints: np.ndarray, a: int) -> np.ndarray:
        return ((prints >> np.uint64(a)) & np.uint64((1 << self.wide) - 1)).astype(np.int64)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, indexed) pairs; `looked` counts the indexed fingerprints that were compared."""
        found = [np.zeros(0, np.int64)]
        step = max(1, (1 << 18) // len(self.masks))
        for q0 in range(0, len(prints), step):
            part = prints[q0 : q0 + step]
            for a, order, first in self.blocks:
                value = (self._value(part, a)[:, None] ^ self.masks).ravel()
                size = first[value + 1] - first[value]
                some = np.flatnonzero(size)
                value, size = value[some], size[some]
                query = np.repeat(some // len(self.masks), size)
                item = order[np.repeat(first[value] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                self.looked += len(item)
                near = np.bitwise_count(part[query] ^ self.prints[item]) <= self.radius
                found.append((query[near] + q0) * len(self.prints) + item[near])
        both = np.unique(np.concatenate(found))
        return both // max(1, len(self.prints)), both % max(1, len(self.prints))


@dataclass
class Postings:
    """Of the items with one size of shingles: distinct shingles in order, their weights, which items have each, and a filter."""

    keys: np.ndarray
    weights: np.ndarray
    first: np.ndarray
    items: np.ndarray
    filter: np.ndarray


@dataclass
class Index:
    """Items by number: size in words, distinct shingles in order with counts and weights, and the weight of all; postings; fingerprints."""

    ids: list
    sizes: np.ndarray
    shingles: list[np.ndarray]
    counts: list[np.ndarray]
    weights: list[np.ndarray]
    totals: np.ndarray
    by_size: dict[int, Postings]
    prints: MultiIndex


def build(items: list[tuple]) -> Index | None:
    """The index of (id, text) items; items without words are left out. None if none is left."""
    words, lengths, before = words_of(pa.array([t for _, t in items], pa.string()))
    ids, sizes, shingles, counts, weights, totals, prints = [], [], [], [], [], [], []
    parts: dict[int, list[int]] = {}
    for i, (name, _) in enumerate(items):
        own, n = words[before[i] : before[i + 1]], int(before[i + 1] - before[i])
        if not n:
            continue
        size = min(SHINGLE_WORDS, n)
        runs = Runs(own, lengths[before[i] : before[i + 1]], np.array([0, n]), size)
        keys, at, count = np.unique(runs.hash, return_index=True, return_counts=True)
        parts.setdefault(size, []).append(len(ids))
        for made, x in ((ids, name), (sizes, n), (shingles, keys), (counts, count), (weights, runs.weight[at]), (totals, int(runs.weight.sum())), (prints, simhash(runs.hash, runs.weight, np.zeros(1, np.int64))[0])):
            made.append(x)
    if not ids:
        return None
    by_size = {}
    for size, own in parts.items():
        h, w, item = np.concatenate([shingles[i] for i in own]), np.concatenate([weights[i] for i in own]), np.repeat(own, [len(shingles[i]) for i in own])
        order = np.argsort(h, kind="stable")
        keys, first = np.unique(h[order], return_index=True)
        filter_ = np.zeros(1 << _FILTER, dtype=bool)
        filter_[(h & np.uint64((1 << _FILTER) - 1)).astype(np.int64)] = True
        by_size[size] = Postings(keys, w[order][first], np.append(first, len(h)), item[order], filter_)
    return Index(ids, np.array(sizes), shingles, counts, weights, np.array(totals), by_size, MultiIndex(np.array(prints, np.uint64), RADIUS))


def _expand(first: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in key, place in the postings) of all postings of the keys."""
    n = first[key + 1] - first[key]
    return np.repeat(np.arange(len(key)), n), np.repeat(first[key] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _heavy(index: Index, own: Postings, text: np.ndarray, key: np.ndarray, similarity: float) -> set[tuple[int, int]]:
    """(text, item) pairs whose shared places weigh at least the similarity times the item, from (text, key) of each place.

    Equal places of a text are one row that weighs more, so a text costs no more than the postings.
    """
    code, many = np.unique(text * len(own.keys) + key, return_counts=True)
    text, key = code // len(own.keys), code % len(own.keys)
    size = np.cumsum(own.first[key + 1] - own.first[key])
    least = similarity * index.totals * (1 - 1e-9)
    out, at = set(), 0
    while at < len(key):
        # Up to PAIRS at a time, but a text's pairs together.
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + PAIRS, side="right")))
        to = int(np.searchsorted(text, text[to - 1], side="right")) if to < len(key) else len(key)
        k, posting = _expand(own.first, key[at:to])
        k += at
        pair, of = np.unique(text[k] * len(index.ids) + own.items[posting], return_inverse=True)
        weight = np.bincount(of, weights=(many * own.weights[key])[k], minlength=len(pair))
        out |= {divmod(int(p), len(index.ids)) for p in pair[weight >= least[pair % len(index.ids)]]}
        at = to
    return out


def _near(index: Index, own: Postings, runs: Runs, have: np.ndarray, size: int, hit: np.ndarray, key: np.ndarray) -> set[tuple[int, int]]:
    """(text, item) pairs of which a window of the item's size has a fingerprint near the item's."""
    out: set[tuple[int, int]] = set()
    kinds = np.unique(index.sizes[own.items])
    k, posting = _expand(own.first, np.arange(len(own.keys)))
    has = np.unique(k * len(kinds) + np.searchsorted(kinds, index.sizes[own.items[posting]]))  # (key, size) pairs
    order = np.argsort(has % len(kinds), kind="stable")
    of_kind = np.split((has // len(kinds))[order], np.searchsorted((has % len(kinds))[order], np.arange(1, len(kinds))))
    present = np.zeros(len(own.keys), bool)
    present[key] = True
    for long, keys in zip(kinds.tolist(), of_kind, strict=True):
        if not present[keys].any():
            continue
        wanted = np.zeros(len(own.keys), bool)
        wanted[keys] = True
        place = hit[wanted[key]]
        text, place = runs.text[place], runs.place[place]
        # Windows that hold the shingle; at the ends of a text they are moved into it. Touching ranges are one.
        last = np.maximum(have[text] - long, 0)
        low, high = np.minimum(np.maximum(place - long + size, 0), last), np.minimum(place, last)
        new = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (low[1:] > high[:-1] + 1)))
        text, low, high = text[new], low[new], high[np.append(new[1:], len(high)) - 1]
        cuts = (high - low) // STARTS + 1
        nth = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        text, low, high = (np.repeat(x, cuts) for x in (text, low, high))
        low = low + nth * STARTS
        count = np.minimum(high - low + 1, STARTS)
        n = np.minimum(long, have[text]) - size + 1
        for run, prints in window_prints(runs, runs.first[text] + low, count, n):
            q, item = index.prints.within(prints)
            same = index.sizes[item] == long
            out |= set(zip(text[run[q[same]]].tolist(), item[same].tolist(), strict=True))
    return out


def _settle(index: Index, runs: Runs, have: np.ndarray, size: int, t: int, i: int, similarity: float) -> dict | None:
    """The most similar window (ties: the first) of text t and item i, if it is similar enough."""
    long = min(int(index.sizes[i]), int(have[t]))
    n = long - size + 1
    rows = slice(int(runs.first[t]), int(runs.first[t + 1]))
    h, w = runs.hash[rows], runs.weight[rows]
    keys, most, weight = index.shingles[i], index.counts[i], index.weights[i]
    local = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    shared = keys[local] == h
    total, both = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(w * shared)])
    least = similarity * index.totals[i] * (1 - 1e-9)
    best = None
    # What both share weighs no more than the window's places with a shingle of the item.
    for s in np.flatnonzero(both[n:] - both[:-n] >= least).tolist():
        inside = local[s : s + n][shared[s : s + n]]
        common = int((np.minimum(np.bincount(inside, minlength=len(keys)), most) * weight).sum())
        value = common / (int(total[s + n] - total[s]) + int(index.totals[i]) - common)
        if value >= similarity and (best is None or value > best[0]):
            best = (value, s)
    return best and {"item_id": index.ids[i], "similarity": best[0], "start_word": best[1], "end_word": best[1] + long}


def find(index: Index, column: pa.Array, similarity: float) -> list[list[dict]]:
    """Of each text the items found in it, each with its best window (words, end exclusive; ties: the first)."""
    out: list[dict] = [{} for _ in range(len(column))]
    words, lengths, counts = words_of(column)
    have = np.diff(counts)
    for size, own in index.by_size.items():
        runs = Runs(words, lengths, counts, size)
        hit = np.flatnonzero(own.filter[(runs.hash & np.uint64((1 << _FILTER) - 1)).astype(np.int64)])
        key = np.minimum(np.searchsorted(own.keys, runs.hash[hit]), len(own.keys) - 1)
        known = own.keys[key] == runs.hash[hit]
        hit, key = hit[known], key[known]
        if not len(hit):
            continue
        # Few pairs are heavy that the fingerprints don't find.
        for t, i in _near(index, own, runs, have, size, hit, key) | _heavy(index, own, runs.text[hit], key, similarity):
            found = _settle(index, runs, have, size, t, i, similarity)
            if found:
                out[t][i] = found
    return [[o[i] for i in sorted(o)] for o in out]


def passes(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> list[list[tuple]]:
    """(id, text) items in groups of about WORDS_A_PASS words, each small enough to travel to every executor.

    Items without id or text don't count, repeated ones count once. A larger benchmark means more groups.
    """
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null").distinct()
    words = rows.agg(F.sum(F.regexp_count("t", F.lit(r"\S+")).cast("bigint"))).first()[0] or 0
    groups = max(1, -(-words // WORDS_A_PASS))
    out = []
    for g in range(groups):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(groups)) == g)
        out.append(sorted((r["i"], r["t"]) for r in part.collect()))
    return out


def _index(docs: DataFrame, items: list[tuple], similarity: float):
    """What gives, in a worker, a function from texts to their hits."""
    shared = docs.sparkSession.sparkContext.broadcast(build(items))  # one group of passes()

    def make():
        return lambda column: find(shared.value, column, similarity) if shared.value else [[] for _ in range(len(column))]

    return make


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """(key, item_id, similarity, start_word, end_word) for each benchmark item found in a text.

    Words are lower-cased (A-Z) and lose ASCII punctuation. The window is the item's size, or the whole text
    if that is shorter; of windows as similar the first counts. An item of fewer than five words is one
    shingle. Null or empty texts and items without words match nothing; rows that repeat match each; a null
    key stays null; empty tables give no rows.
    """
    kind = benchmark.schema[item].dataType.simpleString()
    schema = f"hits array<struct<item_id:{kind},similarity:double,start_word:bigint,end_word:bigint>>"
    arrow = to_arrow_schema(StructType.fromDDL(schema)).field("hits").type
    out = None
    for items in passes(benchmark, item):
        search = _index(docs, items, similarity)

        def make(search=search):
            look = search()
            return lambda column: [pa.array(look(column), arrow)]

        found = map_texts(docs, key, text, make, schema).where(F.size("hits") > 0).select(key, F.inline("hits"))
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, all columns, in which contaminated() finds no item.

    Rows with a null or empty text or a null key stay, as do all rows without items; rows that repeat go or stay
    together. Nothing is shuffled or joined, and texts go to Python once a pass.
    """
    for items in passes(benchmark, item):
        search = _index(docs, items, similarity)

        def make(search=search):
            look = search()
            return lambda column: pa.array([not hits for hits in look(column)], pa.bool_())

        docs = text_filter(docs, text, make)
    return docs
