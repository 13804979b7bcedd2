"""Token ids packed into fixed-length rows: best fit decreasing over a segment tree of capacities.

Texts become token ids by a public vocabulary read from a path. A text longer than a row is cut into whole
rows and a rest, so nothing is lost. Rests are packed, largest first, each into the fullest row that still
holds it. Packing works within a partition of the input, a bounded number of tokens at a time, so there
is no shuffle, memory is bounded, and a partition made again gives the same rows.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.batches import bound_batches, release, slices
from shelfmark.llm.shingles import mix64, text_bytes, word_hashes

#: Fixed value: how the vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Tokens of a row, and tokens of rests that are packed together.
ROW, WINDOW = 2048, 1 << 20
#: Pieces of text that a task remembers, and the tokens of these (some 17 MB together).
SLOTS, MEMORY = 1 << 19, 1 << 21


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tokens:
    """Token ids of texts. Equal pieces between single blanks are looked up, not merged again.

    A cut before a single blank or line feed with other than white space on both sides is where PATTERN
    cuts anyhow, so the ids are those of the whole text. What is remembered has a fixed size: a piece goes to the
    slot that its hash names, in place of what is there, and its ids to a buffer; when that is full, all is forgotten.
    """

    def __init__(self, ranks: dict[bytes, int], slots: int = SLOTS, memory: int = MEMORY) -> None:
        import tiktoken

        self.coder = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.mask = np.uint64(slots - 1)
        self.key, self.at, self.size = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.full(slots, -1, np.int32)
        self.ids, self.used = np.zeros(memory, np.uint32), 0

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of pieces: of each text, and of each cut."""
        n = len(data)
        space = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 28) & (data <= 31))
        cut = np.zeros(n + 1, dtype=bool)
        i = np.flatnonzero((data == 32) | (data == 10))
        i = i[(i >= 3) & (i + 1 < n)]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        # White space beyond ASCII starts with these bytes; its neighbours are left uncut.
        lead = np.zeros(256, dtype=bool)
        lead[[0xC2, 0xE1, 0xE2, 0xE3]] = True
        good = ~space[i - 1] & ~space[i + 1] & ~lead[data[i + 1]] & ~(lead[data[i - 2]] & (data[i - 1] >= 128)) & ~(lead[data[i - 3]] & (data[i - 1] >= 128))
        good &= ~(first[i] | first[i + 1])
        cut[i[good]] = True
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut[:n])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and for each text the number of ids before it."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = self._cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        # Hashes tell upper from lower case: 0x01 is added where A-Z stands, by hashing the folded bytes with their case.
        keys = mix64(word_hashes(data, starts, ends) ^ _case_hash(data, starts, ends))
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        slot = (distinct & self.mask).astype(np.int64)
        known = (self.key[slot] == distinct) & (self.size[slot] >= 0)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        new, ids = np.flatnonzero(~known), self.ids
        if len(new):
            made = [self.coder.encode_ordinary(data[starts[k] : ends[k]].tobytes().decode("utf-8", "replace")) for k in first[new]]
            size[new] = np.fromiter(map(len, made), np.int64, len(made))
            at[new] = self.used + np.cumsum(size[new]) - size[new]
            fresh = np.fromiter((t for m in made for t in m), np.uint32, int(size[new].sum()))
            if self.used + len(fresh) <= len(ids):
                ids[self.used : self.used + len(fresh)] = fresh
                self.used += len(fresh)
                self.key[slot[new]], self.at[slot[new]], self.size[slot[new]] = distinct[new], at[new], size[new]
            else:
                ids = np.concatenate([ids[: self.used], fresh])
                self.size[:] = -1
                self.used = 0
        size, at = size[which], at[which]
        before = np.concatenate([[0], np.cumsum(size)])
        return ids[np.repeat(at - before[:-1], size) + np.arange(before[-1])], before[np.searchsorted(starts, offsets)]


def _case_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of where A-Z stand within each piece."""
    upper = np.flatnonzero((data >= 65) & (data <= 90))
    piece = np.searchsorted(starts, upper, side="right") - 1
    out = np.zeros(len(starts), np.uint64)
    np.add.at(out, piece, mix64((upper - starts[piece]).astype(np.uint64) + np.uint64(77)))
    return out


class Capacities:
    """A segment tree over room 0..size: how many open rows have so much room, and the least room that is enough."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def _change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, its room) of the least room >= need, which leaves the tree; None if there is none."""
        i, count = need + self.leaves, self.count
        if not count[i]:
            while i and not (i % 2 == 0 and count[i + 1]):
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        self._change(room, -1)
        return row, room


def best_fit_decreasing(sizes: np.ndarray, row: int) -> list[list[int]]:
    """Items of each row. Items go in by size, largest first, ties in order; each into the fullest row that holds it."""
    open_rows, out = Capacities(row), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        found = open_rows.take(n)
        if found is None:
            out.append([i])
            room = row - n
            at = len(out) - 1
        else:
            at, room = found[0], found[1] - n
            out[at].append(i)
        if room:
            open_rows.put(room, at)
    return out


SCHEMA = "shard int, row bigint, n_tokens int, ids binary, cu_seqlens array<int>, position_resets array<int>, piece array<int>"


@dataclass
class _Piece:
    key: object
    number: int
    ids: np.ndarray


def pack(docs: DataFrame, vocabulary: str, row: int = ROW, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Packed rows of all texts.

    Columns: shard and row (the partition of the input and the row in it), n_tokens, ids (little-endian
    uint16, or uint32 if the vocabulary needs it; n_tokens of them, the rest up to `row` being padding that
    is not stored), doc_ids (key of each segment), piece (the segment's number among its text's pieces),
    cu_seqlens (0 and the cumulative segment lengths) and position_resets (where positions start at 0 again:
    the segments' starts). Every token of every text is in exactly one segment. A null or empty text gives
    no segment; a null key stays null in doc_ids; rows that repeat are packed each; an empty table gives no
    rows. vocabulary: a path that the driver can read; its ranks travel to the executors (under 2 MB).
    """
    bound_batches(docs.sparkSession)
    ranks = read_ranks(vocabulary)
    kind = np.dtype("<u2" if len(ranks) <= 1 << 16 else "<u4")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # as long as the vocabulary, whatever the documents
    source = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    fields = T.StructType([*T.StructType.fromDDL(SCHEMA), T.StructField("doc_ids", T.ArrayType(source.schema["_key"].dataType))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, shard, tokens, n = to_arrow_schema(fields), TaskContext.get().partitionId(), Tokens(shared.value), 0
        rests: list[_Piece] = []
        held = 0

        def made(rows: list[list[_Piece]]) -> pa.RecordBatch:
            nonlocal n
            ends = [np.cumsum([0, *(len(p.ids) for p in r)], dtype=np.int32) for r in rows]
            values = [
                pa.array([shard] * len(rows), pa.int32()), pa.array(range(n, n + len(rows)), pa.int64()), pa.array([int(e[-1]) for e in ends], pa.int32()), pa.array([np.concatenate([p.ids for p in r]).astype(kind).tobytes() for r in rows], pa.binary()),
                pa.array([e.tolist() for e in ends], pa.list_(pa.int32())), pa.array([e[:-1].tolist() for e in ends], pa.list_(pa.int32())), pa.array([[p.number for p in r] for r in rows], pa.list_(pa.int32())), pa.array([[p.key for p in r] for r in rows], arrow.field("doc_ids").type),
            ]
            n += len(rows)
            return pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

        def packed() -> pa.RecordBatch:
            nonlocal rests, held
            sizes = np.array([len(p.ids) for p in rests])
            out = made([[rests[i] for i in r] for r in best_fit_decreasing(sizes, row)])
            rests, held = [], 0
            return out

        for batch in batches:
            for piece in slices(batch, "_text"):
                keys = piece.column(0).to_pylist()
                ids, before = tokens.encode(*text_bytes(piece.column(1)))
                whole: list[list[_Piece]] = []
                for i, k in enumerate(keys):
                    own = ids[before[i] : before[i + 1]]
                    for j in range(len(own) // row):
                        whole.append([_Piece(k, j, own[j * row : (j + 1) * row])])
                    if rest := len(own) % row:
                        rests.append(_Piece(k, len(own) // row, own[len(own) - rest :].copy()))
                        held += rest
                    if held >= window:
                        yield packed()
                for j in range(0, len(whole), 512):
                    yield made(whole[j : j + 512])
        if rests:
            yield packed()
        tokens = None
        release()

    order = ["shard", "row", "n_tokens", "doc_ids", "piece", "cu_seqlens", "position_resets", "ids"]
    return source.mapInArrow(run, fields).select(*order)


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed rows as parquet files under path, one folder a shard, rows in order within a file.

    packed is what pack() returns; no row of it has a null; an empty one writes no shard. An existing path is an error.
    """
    packed.sortWithinPartitions("shard", "row").write.partitionBy("shard").parquet(path)


def id_matrix(rows: list, row: int = ROW, pad: int = 0, kind: str = "<u2") -> np.ndarray:
    """(rows, row) matrix of some collected rows' ids, padded."""
    out = np.full((len(rows), row), pad, dtype=kind)
    for i, r in enumerate(rows):
        out[i, : r["n_tokens"]] = np.frombuffer(r["ids"], kind)
    return out


def positions(cu_seqlens: list[int]) -> np.ndarray:
    """Position of each token, from 0 in each segment."""
    ends = np.asarray(cu_seqlens)
    return np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
