"""Quality classification by nearest-neighbour voting over latent-semantic vectors of labelled texts.

Terms of a text: runs of three character classes (which tell prose from tables, shouting and litter),
words by hash, and words about repetition and length by step. Counts are damped, weighted by rarity among
the labelled texts and projected on the leading singular vectors of those. Each text is then compared, by
exact cosines in blocks, with every labelled vector, and its nearest ones vote with their labels.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import map_texts
from shelfmark.llm.shingles import text_bytes, word_bounds, word_hashes

#: Bounds and parameters: labelled texts, latent dimensions, neighbours that vote, power of a similarity.
LABELLED, DIMENSIONS, NEIGHBOURS, POWER = 2500, 48, 9, 6
BLOCK = 256
WORD_TERMS = 1024
_CLASSES = 14
_STEPS = 12

_CLASS = np.full(256, 13, dtype=np.int64)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[32] = 3
_CLASS[[10, 13]] = 4
_CLASS[[9, 11, 12]] = 5
for _i, _s in enumerate((".", ",", "!", "?", "'\"-", "|", "#$%&*@~^<>{}[]\\/_=+")):
    _CLASS[[ord(c) for c in _s]] = 6 + _i
_CLASS[128:] = 0
_TRIPLES = _CLASSES**3
#: Stepped measures: length, distinct words, words that repeat the one before, mean word, distinct lines, letters, capitals among letters.
_MEASURES = 7
TERMS = _TRIPLES + WORD_TERMS + _MEASURES * _STEPS
_MEASURE_WEIGHT = 4.0
#: The measures are few and the other terms many, so theirs weigh more.
MEASURE_BOOST = 3.0


def _stepped(values: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.clip((v * _STEPS).astype(np.int64), 0, _STEPS - 1) + i * _STEPS for i, v in enumerate(values)], axis=1)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, TERMS) float32 counts; the stepped measures count as _MEASURE_WEIGHT."""
    n = len(offsets) - 1
    out = np.zeros((n, TERMS), dtype=np.float32)
    text = np.repeat(np.arange(n), np.diff(offsets))
    kind = _CLASS[data] if len(data) else np.zeros(0, np.int64)
    if len(data) > 2:
        code = (kind[:-2] * _CLASSES + kind[1:-1]) * _CLASSES + kind[2:]
        same = text[:-2] == text[2:]
        out[:, :_TRIPLES] = np.bincount(text[:-2][same] * _TRIPLES + code[same], minlength=n * _TRIPLES).reshape(n, _TRIPLES)
    starts, ends, counts = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(counts))
    out[:, _TRIPLES : _TRIPLES + WORD_TERMS] = np.bincount(owner * WORD_TERMS + (words % np.uint64(WORD_TERMS)).astype(np.int64), minlength=n * WORD_TERMS).reshape(n, WORD_TERMS)
    have = np.diff(counts)
    each = np.maximum(have, 1)
    again = np.bincount(owner[1:][(words[1:] == words[:-1]) & (owner[1:] == owner[:-1])], minlength=n) if len(words) else np.zeros(n)
    order = np.lexsort((words, owner))
    first = np.ones(len(words), dtype=bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][first], minlength=n)
    letters = np.bincount(text[kind <= 1], minlength=n)
    capitals = np.bincount(text[kind == 1], minlength=n)
    size = np.diff(offsets)
    lines = _distinct_lines(data, offsets)
    # Distinct words fall as texts grow, so they are measured as a power of the number of words.
    spread = np.log(np.maximum(distinct, 1)) / np.log(np.maximum(have, 2))
    measures = [np.log2(size + 1) / 18, np.clip((spread - 0.4) / 0.6, 0, 0.999), again / each, np.minimum(size / each / 24, 0.999), lines, letters / np.maximum(size, 1), capitals / np.maximum(letters, 1)]
    out[np.arange(n)[:, None], _TRIPLES + WORD_TERMS + _stepped(measures)] = _MEASURE_WEIGHT
    return out


def _distinct_lines(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    share = np.ones(len(offsets) - 1)
    for i in range(len(share)):
        lines = data[offsets[i] : offsets[i + 1]].tobytes().split(b"\n")
        share[i] = len(set(lines)) / len(lines)
    return np.minimum(share, 0.999)


@dataclass
class Model:
    """Weights of the terms, the projection, and the labelled vectors (unit length) with their labels."""

    weights: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.weights
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        z = x @ self.project
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, z: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors by similarity; the prior without any similar one."""
        out = np.full(len(z), self.prior)
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(z), BLOCK):
            cosine = z[i : i + BLOCK] @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(float) ** POWER
            total = weight.sum(axis=1)
            vote = (weight * self.labels[near]).sum(axis=1)
            # One neighbour's worth of the prior smooths the votes.
            out[i : i + BLOCK] = (vote + 0.5 * self.prior) / (total + 0.5)
        return np.clip(out, 0, 1)


def fit(counts: np.ndarray, labels: np.ndarray, seed: int = 1) -> Model | None:
    """A model from the term counts and labels (0 to 1) of labelled texts; None without any."""
    if not len(labels):
        return None
    weights = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    weights[_TRIPLES + WORD_TERMS :] *= MEASURE_BOOST
    x = np.log1p(counts) * weights
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    k = min(DIMENSIONS, *x.shape)
    q = np.linalg.qr(x @ np.random.default_rng(seed).normal(size=(x.shape[1], min(k + 12, *x.shape))).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    _, _, v = np.linalg.svd(q.T @ x, full_matrices=False)
    model = Model(weights, np.ascontiguousarray(v[:k].T).astype(np.float32), np.zeros((0, k), np.float32), labels.astype(float), float(labels.mean()))
    model.vectors = model.embed(counts)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of the LABELLED usable labelled keys with the least hashes.

    labels has key and label (null labels and keys don't count; repeated keys count by their mean label). A key
    without a document gives nothing; one with several texts takes one of them, always the same. Only the sampled
    counts reach the driver, as they are: a text has the same terms here as where it is scored.
    """
    chosen = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y"), usable.alias("u")).where("u and k is not null and y is not null")
    chosen = chosen.groupBy("k").agg(F.avg("y").alias("y")).withColumn("h", F.xxhash64("k")).orderBy("h", "k").limit(LABELLED)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(chosen), "k")  # at most LABELLED rows

    def make():
        def apply(column: pa.Array) -> list[pa.Array]:
            counts = term_counts(*text_bytes(column))
            return [pa.array([np.flatnonzero(c).astype(np.uint16).tobytes() + c[c != 0].tobytes() for c in counts], pa.binary())]

        return apply

    made = map_texts(rows, "k", "t", make, "counts binary", {"y": F.col("y")}).groupBy("k", "y").agg(F.min("counts").alias("counts")).collect()
    made.sort(key=lambda r: str(r["k"]))
    counts = np.zeros((len(made), TERMS), np.float32)
    for i, r in enumerate(made):
        n = len(r["counts"]) // 6  # places of the terms that occur (2 bytes each), then their counts (4 bytes each)
        counts[i, np.frombuffer(r["counts"], np.uint16, n)] = np.frombuffer(r["counts"], np.float32, n, 2 * n)
    return counts, np.array([r["y"] for r in made])


def classify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", also: dict | None = None) -> DataFrame:
    """(key, *also, score) for each row: the vote of its whole text's nearest labelled neighbours, 0 to 1.

    A null text counts as an empty one, which is scored by its measures like any other. Without a model (no
    labelled texts) every score is 0.5. Rows that repeat get the same score; a null key stays null; an empty
    table gives no rows.
    """

    def make():
        def apply(column: pa.Array) -> list[pa.Array]:
            scores = []
            for i in range(0, len(column), BLOCK):
                part = column.slice(i, BLOCK)
                scores.append(model.score(model.embed(term_counts(*text_bytes(part)))) if model else np.full(len(part), 0.5))
            return [pa.array(np.concatenate(scores) if scores else np.zeros(0))]

        return apply

    return map_texts(docs, key, text, make, "score double", also)
