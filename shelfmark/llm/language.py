"""Language identification by a byte convolutional network, trained in numpy and applied to fixed-length windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.batches import map_texts, text_filter
from shelfmark.llm.shingles import text_bytes

#: The network: bytes of a window, embedding, filter widths and filters of each width.
WINDOW, EMBED, WIDTHS, FILTERS = 512, 12, (2, 3, 4), 12
WIDEST = max(WIDTHS)
STEP = WINDOW - WIDEST + 1
#: Bounds of the training sample: texts in all (but one at least of each language), of a language, and characters of a text.
PASSAGES, TEXTS, CHARS = 1 << 14, 256, 1200
#: Steps of training for up to so many languages; for more, in proportion.
STEPS, LANGUAGES = 260, 64
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the two-byte letters U+00C0 to U+00DE."""
    out = _FOLD[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) > 1 else np.zeros(0, np.int64)
    upper = second[(data[second] >= 0x80) & (data[second] <= 0x9E)]
    out[upper] += 32
    return out


def training_texts(docs: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(language, passage) pairs from the usable rows: for each language, of each of TEXTS hash buckets (of fewer,
    if PASSAGES asks for it) the row with the least hash of its key, and of that CHARS characters from a hashed
    place. Rows without key, text or language don't take part.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"), usable.alias("u")).where("u and k is not null and l is not null")
    texts = max(1, min(TEXTS, PASSAGES // max(1, rows.select("l").distinct().count())))
    rows = rows.withColumn("h", F.xxhash64("k"))
    least = rows.where("t is not null").groupBy("l", F.pmod("h", F.lit(texts)).alias("b")).agg(F.min("h").alias("h")).select("l", "h")
    place = F.lit(1) + F.pmod(F.xxhash64(F.lit("place"), "h"), F.greatest(F.length("t") - CHARS, F.lit(1))).cast("int")
    picked = rows.join(F.broadcast(least), ["l", "h"]).groupBy("l", "h").agg(F.min(F.substring("t", place, F.lit(CHARS))).alias("t"))  # at most PASSAGES keys, or one a language
    return sorted((r["l"], r["t"]) for r in picked.where(F.col("t").rlike(r"\p{L}")).collect())


class Network:
    """Embedding, convolutions of several widths, max pooling, rectifier, softmax."""

    def __init__(self, classes: list[str], seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.classes = classes
        self.embed = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = r.normal(0, 1 / np.sqrt(WIDEST * EMBED), (WIDEST * EMBED, n)).astype(np.float32)
        self.mask = np.zeros_like(self.filters)  # a filter of width w sees the first w bytes
        for i, w in enumerate(WIDTHS):
            self.mask[: w * EMBED, i * FILTERS : (i + 1) * FILTERS] = 1
        self.filters *= self.mask
        self.bias = np.zeros(n, np.float32)
        self.out = r.normal(0, 0.3, (n, len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def train(self, windows: np.ndarray, labels: np.ndarray, steps: int = 260, batch: int = 48, rate: float = 0.01, seed: int = 4) -> None:
        r = np.random.default_rng(seed)
        names = ("embed", "filters", "bias", "out", "out_bias")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        by_class = [np.flatnonzero(labels == c) for c in range(len(self.classes))]
        for t in range(1, steps + 1):
            pick = np.array([r.choice(by_class[c]) for c in r.integers(0, len(self.classes), batch)])
            x = windows[pick].copy()
            for row in x:  # also learn from short texts
                if r.random() < 0.4:
                    row[int(r.integers(24, WINDOW)) :] = 0
            y = labels[pick]
            e = self.embed[x]
            cols = np.lib.stride_tricks.sliding_window_view(e.reshape(batch, -1), WIDEST * EMBED, axis=1)[:, ::EMBED]
            z = np.ascontiguousarray(cols).reshape(batch * STEP, -1) @ self.filters
            z = z.reshape(batch, STEP, -1)
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None], axis=1)[:, 0] + self.bias
            h = np.maximum(top, 0)
            p = softmax(h @ self.out + self.out_bias)
            d = p.copy()
            d[np.arange(batch), y] -= 1
            d /= batch
            g = {"out": h.T @ d + 1e-4 * self.out, "out_bias": d.sum(axis=0)}
            dh = (d @ self.out.T) * (top > 0)
            g["bias"] = dh.sum(axis=0)
            seen = cols[np.arange(batch)[:, None], at]  # batch, filter, input
            g["filters"] = np.einsum("bfi,bf->if", seen, dh) * self.mask
            de = np.einsum("bf,if->bfi", dh, self.filters).reshape(batch, -1, WIDEST, EMBED)
            g["embed"] = np.zeros_like(self.embed)
            for k in range(WIDEST):
                np.add.at(g["embed"], x[np.arange(batch)[:, None], at + k], de[:, :, k])
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                step = rate * min(1, 3 * (1 - t / (steps + 1))) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
                setattr(self, k, (getattr(self, k) - step).astype(np.float32))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What each pair of bytes adds to each filter, at the first two places of its window and at the next two."""
        each = [self.embed @ self.filters[k * EMBED : (k + 1) * EMBED] for k in range(WIDEST)]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, -1)
        return pair(each[0], each[1]), pair(each[2], each[3])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the windows that cover each text; neighbours share WIDEST - 1 bytes."""
    n = np.maximum(-(-(np.diff(offsets) - WIDEST + 1) // STEP), (np.diff(offsets) > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), n)
    start = offsets[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STEP
    return start, np.minimum(start + WINDOW, offsets[text + 1]), text


def window_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < end[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


def predict(net: Network, tables: tuple, data: np.ndarray, offsets: np.ndarray, block: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Mean class probabilities of each text, weighted by the bytes of its windows (zeros without bytes), and its windows."""
    n = len(offsets) - 1
    sums, weight = np.zeros((n, len(net.classes))), np.zeros(n)
    start, end, text = cut(data, offsets)
    first, second = tables
    one = np.empty((STEP, block, first.shape[1]), np.float32)
    two = np.empty_like(one)
    data = fold(data)
    for i in range(0, len(start), block):
        x = window_bytes(data, start[i : i + block], end[i : i + block]).astype(np.intp)
        pairs = np.ascontiguousarray((x[:, :-1] * 256 + x[:, 1:]).T)
        k = pairs.shape[1]
        np.take(first, pairs[:STEP], axis=0, out=one[:, :k], mode="clip") if k == block else one.__setitem__((slice(None), slice(0, k)), first[pairs[:STEP]])
        np.take(second, pairs[2 : STEP + 2], axis=0, out=two[:, :k], mode="clip") if k == block else two.__setitem__((slice(None), slice(0, k)), second[pairs[2 : STEP + 2]])
        np.add(one, two, out=one)
        p = softmax(np.maximum(one[:, :k].max(axis=0) + net.bias, 0) @ net.out + net.out_bias)
        w = (end[i : i + block] - start[i : i + block]).astype(float)
        np.add.at(sums, text[i : i + block], p * w[:, None])
        np.add.at(weight, text[i : i + block], w)
    return sums / np.maximum(weight, 1)[:, None], np.bincount(text, minlength=n)


def fit(pairs: list[tuple[str, str]], steps: int | None = None) -> Network | None:
    """A network from (language, passage) pairs; None without any. Steps: as STEPS and LANGUAGES say, unless given."""
    if not pairs:
        return None
    classes = sorted({l for l, _ in pairs})
    data, offsets = text_bytes(pa.array([t for _, t in pairs]))
    start, end, text = cut(data, offsets)
    net = Network(classes)
    steps = steps or STEPS * max(LANGUAGES, len(classes)) // LANGUAGES
    net.train(window_bytes(fold(data), start, end), np.array([classes.index(pairs[i][0]) for i in text]), steps)
    return net


def identify(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text", also: dict | None = None) -> DataFrame:
    """(key, *also, lang_pred, score, n_windows) for each row, from its whole text.

    score is the mean probability of lang_pred over the text's windows. A text that is null or has no letter
    is UNKNOWN with score 0, and so is every text if net is None (nothing to learn from). Rows that repeat get
    the same answer, ties go to the language first in order, a null key stays null, and an empty table gives
    no rows.
    """

    def make():
        tables = net.tables() if net else None

        def apply(column: pa.Array) -> list[pa.Array]:
            data, offsets = text_bytes(column)
            if net is None or not len(data):
                n = len(column)
                return [pa.nulls(n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int64))]
            p, windows = predict(net, tables, data, offsets)
            best = p.argmax(axis=1)
            return [pa.array([net.classes[b] if w else None for b, w in zip(best, windows)], pa.string()), pa.array(p.max(axis=1)), pa.array(windows, pa.int64())]

        return apply

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    also = also or {}
    rows = map_texts(docs, key, text, make, "pred string, p double, n_windows bigint", also | {"_letters": letters})
    known = F.col("_letters") & F.col("pred").isNotNull()
    return rows.select(key, *also, F.when(known, F.col("pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, F.col("p")).otherwise(0.0).alias("score"), "n_windows")


def keep_known(docs: DataFrame, net: Network | None, least: float, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text identify() gives a language with a score of at least `least`.

    Rows without text or without a letter in it go, and all rows if net is None; rows that repeat go or stay
    together; an empty table gives no rows. Texts go to Python once and only decisions come back.
    """
    if net is None:
        return docs.limit(0)

    def make():
        tables = net.tables()

        def apply(column: pa.Array) -> pa.Array:
            p, _ = predict(net, tables, *text_bytes(column))
            return pa.array(p.max(axis=1) >= least)

        return apply

    return text_filter(docs.where(F.col(f"`{text}`").rlike(r"\p{L}")), text, make)
