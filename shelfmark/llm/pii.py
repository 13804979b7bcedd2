"""Personal data: fixed patterns, and a semi-Markov conditional random field over the places that hold digits or '@'."""

from __future__ import annotations

import random
import re
import zlib
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.batches import map_texts

#: Kinds in order. The patterns below are those of the contract, written so that no text takes quadratic time.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national_id", "bank_account")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Bounds of an entity: tokens and digits.
MOST_TOKENS, MOST_DIGITS = 16, 32
#: Tokens whose segments are held at once.
PART = 2048
SCHEMA = "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>"

_SEED = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\W_]+|[^\s]")
_SPACE = re.compile(r"\s")
_HASHED = 96


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), in order."""
    found, last, p = [], 0, text.find("@")
    while p >= 0:
        a = p
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, p + 1) if a < p else None
        if m:
            found.append((a, 0, m.end()))
            last = m.end()
        p = text.find("@", max(p + 1, last))
    # After an address that failed on its domain, an earlier start is no other match: each '@' has one local part.
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(found)


def islands(text: str) -> list[tuple[int, int]]:
    """Ranges in which an entity can lie: runs of words with a digit or '@', one blank apart at most."""
    out: list[list[int]] = []
    at = 0
    while m := _SEED.search(text, at):
        a = p = m.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        e = _SPACE.search(text, p)
        b = e.start() if e else len(text)
        if out and a - out[-1][1] <= 1:
            out[-1][1] = b
        else:
            out.append([a, b])
        at = b
    return [(a, b) for a, b in out]


def _groups(s: str) -> bool:
    """Eight groups of up to four hex digits between colons; fewer if one run of them is left out."""
    parts = s.lower().split(":")
    whole = all(len(x) <= 4 and all(c in "0123456789abcdef" for c in x) for x in parts)
    return whole and (len(parts) == 8 and all(parts) or 3 <= len(parts) <= 8 and s.count("::") == 1)


def _mod97(s: str) -> bool:
    """Two letters, two digits and 11 to 30 letters and digits whose check digits are right."""
    t = s.replace(" ", "").upper()
    if not (15 <= len(t) <= 34 and t.isascii() and t.isalnum() and t[:2].isalpha() and t[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


_CUES = {"phone": "phone tel call fax mobile cell telephone contact sms whatsapp", "email": "email mail contact write", "ip": "ip host address server addr from", "card": "card visa mastercard credit debit pay", "national_id": "ssn social security sin id passport", "bank_account": "iban account konto bank transfer", "number": "order invoice item version page no ref sku code price date year"}
_CUE = {w: i for i, words in enumerate(_CUES.values()) for w in words.split()}
_NAMES = ["bias", "at", "plus", "paren", "quad", "luhn", "domain", "letters", "only_digits", "glued_left", "glued_right", "odd_start", "odd_end", "dots", "dashes", "blanks", "slash", "colon", "zero_first", "groups", "mod97", "more_left", "more_right"] + [f"cue{i}" for i in range(len(_CUES))] + [f"digits{i}" for i in range(21)] + [f"tokens{i}" for i in range(MOST_TOKENS + 1)]
_AT = {n: i for i, n in enumerate(_NAMES)}
N_FEATURES = len(_NAMES) + _HASHED


_SHAPE = re.compile(r"([0-9]+)|[^\W\d_]+")
_CUE_WORD = re.compile(r"([A-Za-z]+)\W{0,3}$")
_DOMAIN_END = re.compile(r"@[\w-]+(\.[\w-]+)+$")


def _shape(s: str) -> str:
    return _SHAPE.sub(lambda m: f"{min(9, len(m[1]))}d" if m[1] else "w", s)


def _quad(s: str) -> bool:
    parts = s.split(".")
    return len(parts) == 4 and all(x.isdigit() and x.isascii() and len(x) <= 3 and int(x) <= 255 for x in parts)


def _before(text: str, a: int) -> list[int]:
    """Places of the features that what stands before and at a span's start has."""
    on, left, first = [], text[a - 1] if a else "", text[a]
    if first == "+":
        on.append(_AT["plus"])
    if left and (left.isalnum() or left in ".-_/@$#"):
        on.append(_AT["glued_left"])
    if not (first.isalnum() or first in "+("):
        on.append(_AT["odd_start"])
    if a > 1 and left in " ," and text[a - 2].isdigit():
        on.append(_AT["more_left"])
    word = _CUE_WORD.search(text[max(0, a - 20) : a])
    if word and word[1].lower() in _CUE:
        on.append(_AT[f"cue{_CUE[word[1].lower()]}"])
    return on


def _after(text: str, b: int) -> list[int]:
    """Places of the features that what stands at and after a span's end has."""
    on, right, more = [], text[b : b + 1], text[b + 1 : b + 2]
    if right and (right.isalnum() or right in "-_/@%" or right == "." and more.isalnum()):
        on.append(_AT["glued_right"])
    if not text[b - 1].isalnum():
        on.append(_AT["odd_end"])
    if right == " " and more.isdigit():
        on.append(_AT["more_right"])
    return on


def _inside(s: str, digits: int) -> list[int]:
    """Places of the features that the span itself has."""
    on = []
    if s.isdigit():
        on.append(_AT["only_digits"])
        number = s
    else:
        for name, mark in (("dots", "."), ("dashes", "-"), ("blanks", " "), ("slash", "/")):
            if mark in s:
                on.append(_AT[name])
        if "@" in s:
            on.append(_AT["at"])
            if _DOMAIN_END.search(s):
                on.append(_AT["domain"])
        if ":" in s:
            on.append(_AT["colon"])
            if _groups(s):
                on.append(_AT["groups"])
        if "(" in s and ")" in s:
            on.append(_AT["paren"])
        if s.count(".") == 3 and _quad(s):
            on.append(_AT["quad"])
        if s[0].isalpha() and _mod97(s):
            on.append(_AT["mod97"])
        if any(c.isalpha() for c in s):
            on.append(_AT["letters"])
        number = "".join(c for c in s if "0" <= c <= "9")
    if 12 <= digits <= 19 and luhn(number):
        on.append(_AT["luhn"])
    if s[0] in "0(+" and number[:1] == "0":
        on.append(_AT["zero_first"])
    return on


def _parts(text: str, a: int, b: int):
    """Yields, PART tokens of an island at a time, (number of the first, tokens, segments that begin among the PART).

    tokens has some more than PART, which segments may reach into. A candidate segment is (first token, past the
    last, places of features), with '@', or seven digits at least and MOST_DIGITS at most, or two colons and a
    digit; and MOST_TOKENS tokens at most. Its tokens are numbered within the part.
    """
    every = ((m.start(), m.end()) for m in _TOKEN.finditer(text, a, b))
    tokens, first = list(islice(every, PART + MOST_TOKENS)), 0
    while tokens:
        count = np.concatenate([[0], np.cumsum([sum("0" <= c <= "9" for c in text[s:e]) for s, e in tokens])]).tolist()
        marks, colons = (np.concatenate([[0], np.cumsum([text[s] == c for s, e in tokens])]).tolist() for c in "@:")
        shapes = [_shape(text[s:e]) for s, e in tokens]
        # With what stands before a token, so that those of a segment joined are its shape.
        spaced = [text[tokens[i - 1][1] : s] + shapes[i] if i else shapes[i] for i, (s, _) in enumerate(tokens)]
        ends: dict[int, list[int]] = {}
        found = []
        for i in range(min(PART, len(tokens))):
            start = None
            for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
                digits = count[j] - count[i]
                if marks[j] - marks[i] == 1 or 7 <= digits <= MOST_DIGITS or digits and colons[j] - colons[i] >= 2:
                    if start is None:
                        start = [_AT["bias"], *_before(text, tokens[i][0])]
                    if j not in ends:
                        ends[j] = _after(text, tokens[j - 1][1])
                    shape = (shapes[i] + "".join(spaced[i + 1 : j]))[:40]
                    found.append((i, j, [*start, *ends[j], *_inside(text[tokens[i][0] : tokens[j - 1][1]], digits), _AT[f"digits{min(20, digits)}"], _AT[f"tokens{j - i}"], len(_NAMES) + zlib.crc32(shape.encode()) % _HASHED]))
        yield first, tokens, found
        first += PART
        tokens = tokens[PART:]
        tokens += islice(every, PART + MOST_TOKENS - len(tokens))


def _segments(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[int]]]]:
    """Tokens of a (short) island, and the candidate segments among them."""
    tokens, found = [], []
    for first, own, segments in _parts(text, a, b):
        tokens += own[len(tokens) - first :]
        found += [(first + i, first + j, on) for i, j, on in segments]
    return tokens, found


def training_lines(n: int = 700, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled lines made by rule: entities of each kind in their usual spellings, and numbers that are none."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8)))
    x = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + d(14)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        return r.choice([number, " ".join(number[i : i + 4] for i in (0, 4, 8, 12)), "-".join(number[i : i + 4] for i in (0, 4, 8, 12))])

    def account() -> str:
        land, rest = r.choice([("DE", d(18)), ("GB", "NWBK" + d(14)), ("FR", d(23)), ("ES", d(20)), ("NL", "ABNA" + d(10))])
        number = next(t for c in range(2, 99) if _mod97(t := f"{land}{c:02d}{rest}"))
        return r.choice([number, " ".join(number[i : i + 4] for i in range(0, len(number), 4))])

    def address() -> str:
        return r.choice([":".join(x(r.randint(1, 4)) for _ in range(8)), f"{x(4)}:{x(r.randint(2, 4))}::{x(r.randint(1, 4))}", f"fe80::{x(4)}:{x(4)}:{x(4)}:{x(4)}"])

    four = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    made = {
        "email": [lambda: f"{w()}.{d(2)}@{w()}.com", lambda: f"{w()}@mail{d(1)}.{w()}.org", lambda: f"{w()}_{w()}@{w()}.de"],
        "ip": [four, four, address],
        "card": [card],
        "phone": [
            lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(2)} {d(4)} {d(4)}",
            lambda: f"0{d(4)} {d(6)}", lambda: f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{r.randint(1, 9)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", lambda: f"0{d(2)} {d(7)}", lambda: f"0{d(3)}/{d(7)}",
        ],
        "national_id": [lambda: f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"],
        "bank_account": [account],
    }
    none = [
        lambda: f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", lambda: f"{d(2)}/{d(2)}/20{d(2)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: f"{d(8)}", lambda: f"{d(10)}", lambda: f"{d(13)}", lambda: f"{w()}{d(4)}{w()}{d(5)}", lambda: f"{d(2)}:{d(2)}:{d(2)} {d(4)}",
        lambda: f"{d(4)} {d(4)}", lambda: f"{d(2)},{d(3)},{d(3)}.{d(2)}", lambda: f"#{d(7)}", lambda: f"{d(5)}-{d(5)}-{d(6)}", lambda: f"@{w()}", lambda: f"{d(3)} {d(3)} {d(3)}", lambda: f"1999-20{d(2)}, 20{d(2)}-20{d(2)}", lambda: f"0x{d(9)}", lambda: f"{d(6)}-{d(3)}", lambda: f"{d(4)}-{d(4)}",
        lambda: f"{d(2)}-{d(7)}", lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}", lambda: f"{d(3)}-{d(7)}-{d(7)}", lambda: f"{d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{d(3)} {d(4)} {d(2)} {d(5)}", lambda: f"{d(2)}.{d(6)}, -{d(2)}.{d(6)}",
        lambda: f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}T{d(2)}:{d(2)}:{d(2)}.{d(3)}Z", lambda: f"20{d(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)} {d(2)}:{d(2)}:{d(2)}", lambda: ":".join(x(2) for _ in range(6)), lambda: f"{x(8)}-{x(4)}-{x(4)}-{x(4)}-{x(12)}", lambda: x(40), lambda: f"{d(1)}:{d(2)}:{d(2)}:{d(2)}", lambda: f"{w()}::{w()}{d(1)}", lambda: f"{d(3)}-{d(3)}, {d(4)}-{d(4)}",
        lambda: d(r.randint(20, 40)), lambda: " ".join(d(r.randint(1, 5)) for _ in range(r.randint(3, 9))), lambda: f"1{d(9)}", lambda: f"{w().upper()}{d(2)} {d(4)} {d(4)}", lambda: f"{w()}:{d(2)}:{d(3)}", lambda: f"{d(2)}% {d(4)}.{d(2)} {d(3)}", lambda: " ".join(d(2) for _ in range(r.randint(4, 12))), lambda: " ".join(d(2) for _ in range(r.randint(4, 12))), lambda: " ".join(d(3) for _ in range(r.randint(3, 12))), lambda: ", ".join(d(r.randint(2, 4)) for _ in range(r.randint(3, 8))),
    ]
    lines = []
    for i in range(n):
        text, gold = w() + " ", []
        for _ in range(r.randint(1, 3)):
            if r.random() < 0.5:
                kind = KINDS[i % len(KINDS)] if r.random() < 0.6 else "phone"
                if r.random() < 0.4:
                    text += r.choice(_CUES[kind].split()) + r.choice([" ", ": "])
                s = r.choice(made[kind])()
                gold.append((len(text), len(text) + len(s), kind))
            else:
                s = r.choice(none)()
                if r.random() < 0.3:
                    text += r.choice(_CUES["number"].split()) + " "
            text += s + r.choice([" ", ", ", ". ", f" {w()} ", f". {w()} "])
        lines.append((text, gold))
    return lines


def _totals(n: int, segments: list, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward and backward log sums over segmentations; a token outside entities scores 0."""
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for k, (i, j, _) in enumerate(segments):
        by_end.setdefault(j, []).append(k)
        by_start.setdefault(i, []).append(k)
    f, b = np.zeros(n + 1), np.zeros(n + 1)
    for j in range(1, n + 1):
        f[j] = np.logaddexp.reduce([f[j - 1], *(f[segments[k][0]] + scores[k] for k in by_end.get(j, []))])
    for i in range(n - 1, -1, -1):
        b[i] = np.logaddexp.reduce([b[i + 1], *(b[segments[k][1]] + scores[k] for k in by_start.get(i, []))])
    return f, b, f[n]


def fit(lines: list, epochs: int = 40, rate: float = 0.15, decay: float = 2e-3) -> np.ndarray:
    """Weights (kind, feature) by maximum conditional likelihood, with exact expectations."""
    cases = []
    for text, gold in lines:
        for a, b in islands(text):
            tokens, segments = _segments(text, a, b)
            if not segments:
                continue
            x = np.zeros((len(segments), N_FEATURES))
            truth = np.zeros((len(segments), len(KINDS)))
            for k, (i, j, on) in enumerate(segments):
                x[k, on] = 1
                for s, e, kind in gold:
                    if (s, e) == (tokens[i][0], tokens[j - 1][1]):
                        truth[k, KINDS.index(kind)] = 1
            cases.append((len(tokens), segments, x, truth))
    w = np.zeros((len(KINDS), N_FEATURES))
    m, v = np.zeros_like(w), np.zeros_like(w)
    w[:, 0] = -2
    for t in range(1, epochs + 1):
        g = decay * len(cases) * w
        for n, segments, x, truth in cases:
            each = x @ w.T
            whole = np.logaddexp.reduce(each, axis=1)
            f, b, z = _totals(n, segments, whole)
            p = np.exp(np.array([f[i] for i, _, _ in segments]) + np.array([b[j] for _, j, _ in segments]) + whole - z)
            g += (p[:, None] * np.exp(each - whole[:, None]) - truth).T @ x
        g /= len(cases)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


@lru_cache(maxsize=1)
def standard_model() -> np.ndarray:
    return fit(training_lines())


def decode(text: str, a: int, b: int, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Best segmentation of an island: (start, place of the kind, end, score). Memory is some 50 bytes a token."""
    starts, ends, best, back, kind, value = array("q"), array("q"), array("d", [0.0]), array("q", [-1]), array("b", [0]), array("d", [0.0])
    settled = 0  # best[: settled + 1] is final

    def settle(upto: int) -> None:
        nonlocal settled
        while settled < upto:
            settled += 1
            if not best[settled] > best[settled - 1]:
                best[settled], back[settled] = best[settled - 1], -1

    for first, tokens, segments in _parts(text, a, b):
        for s, e in tokens[len(starts) - first :]:
            starts.append(s)
            ends.append(e)
            best.append(float("-inf"))
            back.append(-1)
            kind.append(0)
            value.append(0.0)
        if not segments:
            continue
        sizes = [len(on) for _, _, on in segments]
        scores = np.add.reduceat(weights.T[[place for _, _, on in segments for place in on]], np.cumsum([0, *sizes[:-1]]), axis=0)
        for (i, j, _), top, k in zip(segments, scores.max(axis=1).tolist(), scores.argmax(axis=1).tolist(), strict=True):
            settle(first + i)
            if best[first + i] + top > best[first + j]:
                best[first + j], back[first + j], kind[first + j], value[first + j] = best[first + i] + top, first + i, k, top
    settle(len(starts))
    out, j = [], len(starts)
    while j:
        i = back[j]
        if i < 0:
            j -= 1
        else:
            out.append((starts[i], kind[j], ends[j - 1], value[j]))
            j = i
    return out[::-1]


def find(text: str, weights: np.ndarray) -> list[dict]:
    """Spans of one text in order of start, then kind: all base ones, and the model's that overlap none of them."""
    if not _SEED.search(text):
        return []
    base = base_spans(text)
    spans = [(s, k, e, True, None) for s, k, e in base]
    at = 0
    for a, b in islands(text):
        for s, k, e, score in decode(text, a, b, weights):
            while at < len(base) and base[at][2] <= s and base[at][0] < s:
                at += 1
            if not any(x < e and y > s for x, _, y in base[max(0, at - 4) : at + 8]):
                spans.append((s, k, e, False, score))
    spans.sort(key=lambda x: x[:3])
    return [{"kind": KINDS[k], "start": s, "end": e, "base": own, "score": v} for s, k, e, own, v in spans]


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """(key, spans) for each row: all spans of its whole text.

    spans: kind, start and end (code points, end exclusive), base (a fixed pattern found it) and score (nats over
    being outside, for spans that the model found: all of the best segmentation that overlap no base one). Base spans always stay. A null or empty text has no spans; rows that
    repeat are treated alike; a null key stays null; an empty table gives no rows. weights: of fit(), else
    those learned from training_lines() (700 made lines).
    """
    weights = standard_model() if weights is None else weights

    def make():
        def apply(column: pa.Array) -> list[pa.Array]:
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
            return [pa.array([find(t or "", weights) for t in column.to_pylist()], kind)]

        return apply

    return map_texts(docs, key, text, make, SCHEMA)
