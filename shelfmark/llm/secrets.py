"""Secret scans: fixed patterns, and automata inferred from labelled credentials that score every other candidate."""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from functools import lru_cache
from itertools import islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame

from shelfmark.llm.automata import infer, log_likelihood
from shelfmark.llm.batches import map_texts

#: Kinds in order, and their patterns.
BASE = ("assign", "access", "hex")
ASSIGN = r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=.-]{16,}"
PIECE = r"[^=/.]{16,}"
LEAST_VALUE = 6
#: Least length of a candidate and of its parts.
LEAST = 16

#: A candidate counts if its best format is likelier than ordinary text by so many nats, and so many a character.
NATS, NATS_EACH = 10.0, 0.15
SCHEMA = "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean,score:double>>, scored bigint"
_SIZES = {"U": 20, "H": 6, "h": 6, "l": 20, "d": 10}


def _class(c: str) -> str:
    if c.isdigit():
        return "d"
    if "a" <= c <= "f":
        return "h"
    if "g" <= c <= "z":
        return "l"
    if "A" <= c <= "F":
        return "H"
    return "U" if "G" <= c <= "Z" else c


_CLASS = {c: _class(c) for c in string.ascii_letters + string.digits + "+/_=.-"}


def labelled_credentials(each: int = 150, seed: int = 11) -> list[tuple[str, str]]:
    """(format, credential) pairs made by rule from publicly documented formats; `each` of a format."""
    r = random.Random(seed)
    alnum, hexa, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    rules = {
        "version-control token": lambda: f"gh{r.choice('pousr')}_{some(alnum, 36)}",
        "fine-grained token": lambda: f"github_pat_{some(alnum, 22)}_{some(alnum, 59)}",
        "group token": lambda: f"glpat-{some(alnum + '_-', 20)}",
        "chat token": lambda: f"xox{r.choice('bpars')}-{some(string.digits, r.randint(10, 13))}-{some(string.digits, r.randint(10, 13))}-{some(alnum, 24)}",
        "map key": lambda: f"AIza{some(alnum + '_-', 35)}",
        "payment key": lambda: f"{r.choice(['sk', 'pk', 'rk'])}_{r.choice(['live', 'test'])}_{some(alnum, r.choice([24, 24, 32, r.randint(64, 110)]))}",
        "web token": lambda: f"eyJ{some(alnum + '_-', r.randint(16, 120))}.eyJ{some(alnum + '_-', r.choice([r.randint(20, 90), r.randint(90, 1200)]))}.{some(alnum + '_-', r.choice([43, 43, 86, 342, 683]))}",
        "secret key": lambda: some(b64, 40),
        "package token": lambda: f"npm_{some(alnum, 36)}",
        "upper hex": lambda: some(hexa.upper(), r.choice([32, 40, 64])),
        "random word": lambda: some(alnum, r.choice([24, 32, 40])),
    }
    return [(name, make()) for name, make in rules.items() for _ in range(each)]


def ordinary_tokens(each: int = 300, seed: int = 12) -> list[str]:
    """Tokens of ordinary text, made by rule, for the automaton that candidates are held against."""
    r = random.Random(seed)
    parts = "an be con de en er fe ge ha in ion ka lo ment no or pa qu re si tion un ver wo ya zu".split()
    word = lambda n=None: "".join(r.choice(parts) for _ in range(n or r.randint(5, 9)))
    digits = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    rules = [
        word, lambda: word().capitalize(), lambda: word().upper(), lambda: f"{word()}.{word().capitalize()}", lambda: f"{word(4)}-{word(4)}", lambda: f"{word(3)}_{word(3)}_{word(3)}",
        lambda: f"mail{digits(1)}.{word(3)}.com", lambda: f"www.{word(4)}.org/{word(3)}/{word(4)}", lambda: f"/{word(3)}/{word(3)}/{word(3)}.{r.choice(['html', 'py', 'txt'])}",
        lambda: digits(r.randint(16, 22)), lambda: f"{digits(4)}-{digits(2)}-{digits(2)}-{digits(4)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(3)}.{digits(3)}", lambda: "=-_./+"[r.randrange(6)] * r.randint(16, 60), lambda: f"{word(3)}{digits(r.randint(1, 4))}.{word(3)}{digits(2)}", lambda: "".join(word(2).capitalize() for _ in range(4)), lambda: word(2) * r.randint(3, 9),
        lambda: "_".join(word(3) for _ in range(r.randint(2, 9))).upper(), lambda: "-".join(word(3) for _ in range(r.randint(2, 9))).upper(), lambda: "".join(word(2).capitalize() for _ in range(r.randint(4, 12))),
    ]
    return [t for make in rules for t in (make() for _ in range(each // 4)) if len(t) >= 8]


def ordinary_identifiers(each: int = 300, seed: int = 13) -> list[str]:
    """Identifiers that are no secrets though their characters are random, for an automaton of their own."""
    r = random.Random(seed)
    uuid = lambda: "-".join("".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12))
    return [t for _ in range(each) for t in (uuid(), uuid().upper())]


def fit(labelled: list[tuple[str, str]], ordinary: list[list[str]], alpha: float = 0.05) -> dict:
    """Automata by format, and one for each kind of ordinary token. Places where nearly all samples of a format agree keep their character; others become classes."""
    groups: dict[str, list[str]] = {}
    for name, sample in labelled:
        groups.setdefault(name, []).append(sample)
    model = {"formats": {}}
    for name, samples in sorted(groups.items()):
        fixed: dict[int, str] = {}
        for i in range(min(map(len, samples))):
            seen = [s[i] for s in samples]
            top = max(set(seen), key=lambda c: (seen.count(c), c))
            if seen.count(top) >= 0.95 * len(seen):
                fixed[i] = top
        words = [_symbols(s, fixed) for s in samples]
        lengths = {len(s) for s in samples}
        begins = re.compile("(?=" + "".join(re.escape(fixed[i]) if i in fixed else "." for i in range(max(fixed) + 1)) + ")") if fixed else None
        symbols = {_CLASS.get(c, c) for s in samples for c in s}
        model["formats"][name] = {"fixed": fixed, "begins": begins, "symbols": symbols, "least": min(lengths), "length": lengths.pop() if len(lengths) == 1 else None, "automaton": infer(words, alpha).freeze(_SIZES)}
    model["ordinary"] = [infer([_symbols(s, {}) for s in kind], alpha).freeze(_SIZES) for kind in ordinary]
    return model


def _symbols(sample: str, fixed: dict[int, str]) -> list[str]:
    return ["=" + c if fixed.get(i) == c else _CLASS.get(c, c) for i, c in enumerate(sample)]


@lru_cache(maxsize=1)
def standard_model() -> dict:
    return fit(labelled_credentials(), [ordinary_tokens(), ordinary_identifiers()])


def score(model: dict, candidate: str) -> float:
    """Nats by which the likeliest format beats the likeliest kind of ordinary token; minus infinity if no format takes the length.

    A format whose samples are all of one length asks for it. Others take any, but one below that of their
    samples only with their fixed characters.
    """
    best = float("-inf")
    for form in model["formats"].values():
        if form["length"] in (None, len(candidate)) and (len(candidate) >= form["least"] or form["begins"] and form["begins"].match(candidate)):
            best = max(best, log_likelihood(form["automaton"], _symbols(candidate, form["fixed"])))
    if best == float("-inf"):
        return best
    return best - max(log_likelihood(o, _symbols(candidate, {})) for o in model["ordinary"])


_ASSIGN, _ACCESS, _HEX, _CANDIDATE, _PIECE = map(re.compile, (ASSIGN, ACCESS, HEX, CANDIDATE, PIECE))
_EDGE = re.compile(r"(?<![A-Za-z0-9])(?=.)")


def _fires(value: float, length: int) -> bool:
    return value >= NATS and value >= NATS_EACH * length


def _walk(model: dict, form: dict, run: str, start: int):
    """(end, nats beyond ordinary text) at each end that a credential of the format from start on may have.

    It takes only characters that the format's samples have, and no letter or digit follows it.
    """
    states, miss = form["automaton"]["states"], form["automaton"]["miss"]
    fixed, symbols = form["fixed"], form["symbols"]
    at, value = 0, 0.0
    others = [[o["states"], o["miss"], 0, 0.0] for o in model["ordinary"]]  # .., state, nats so far
    for i in range(start, min(len(run), start + (form["length"] or len(run)))):
        c = run[i]
        kind = _CLASS.get(c, c)
        if kind not in symbols:
            return
        step = states[at][0].get("=" + c if fixed.get(i - start) == c else kind)
        at, gain = step or (0, miss)
        value += gain
        for o in others:
            step = o[0][o[2]][0].get(kind)
            o[2], loss = step or (0, o[1])
            o[3] += loss
        n = i + 1 - start
        if n >= (LEAST if form["begins"] else form["least"]) and form["length"] in (None, n) and (i + 1 == len(run) or not run[i + 1].isalnum()):
            yield i + 1, value + states[at][1] - max(o[3] + o[0][o[2]][1] for o in others)


def parts(model: dict, run: str) -> list[tuple[float, int, int]]:
    """(score, start, end) of the run and of its parts that count as credentials, in order of preference.

    The run and its pieces between '=', '/' and '.' are held against every format, as they are and without what
    ends a sentence. A format's credentials are also looked for from each place where its fixed characters
    occur or, if it has none, from each place that no letter or digit precedes. Those that begin with their
    format's fixed characters, no letter or digit before them, come first, and then the likeliest.
    """
    found: dict[tuple[int, int], float] = {}
    sure: set[tuple[int, int]] = set()
    for a, b in {(0, len(run)), *(m.span() for m in _PIECE.finditer(run))}:
        for e in {b, a + len(run[a:b].rstrip(".-="))}:
            if e - a >= LEAST and _fires(value := score(model, run[a:e]), e - a):
                found[a, e] = value
    for form in model["formats"].values():
        done = 0
        for m in (form["begins"] or _EDGE).finditer(run):
            if m.start() < done:
                continue
            for e, value in _walk(model, form, run, m.start()):
                if _fires(value, e - m.start()):
                    found[m.start(), e] = max(value, found.get((m.start(), e), value))
                    if form["begins"]:
                        done = e
                        if not run[m.start() - 1 : m.start()].isalnum():
                            sure.add((m.start(), e))
    return sorted(((v, a, e) for (a, e), v in found.items()), key=lambda x: (x[1:] not in sure, -x[0], x[1], -x[2]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, place of the kind, kind ...) of the fixed patterns, in order.

    [0-9a-f]+ and AKIA[A-Z0-9]+ take whole runs, so asking for the least length within the pattern drops
    the same matches as dropping them later.
    """
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def find(text: str, model: dict, memo: dict | None = None) -> tuple[list[dict], int]:
    """Spans of one text in order of start, then kind; and the number of candidates scored."""
    base = base_spans(text)
    spans = [(s, k, e, True, None) for s, k, e in base]
    memo = {} if memo is None else memo
    covered = sorted((s, e) for s, _, e in base)
    scored, at = 0, 0
    for m in _CANDIDATE.finditer(text):
        a, b, run = m.start(), m.end(), m.group()
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        found = memo.get(run)
        if found is None:
            found = parts(model, run)
            if len(memo) < 200_000 and len(run) < 200:
                memo[run] = found
        scored += 1
        if not found:
            continue
        taken: list[tuple[int, int]] = []  # disjoint, in order
        for s, e in takewhile(lambda x: x[0] < b, islice(covered, at, None)):
            if taken and s < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
            else:
                taken.append((s, e))
        for value, s, e in found:
            i = bisect_left(taken, (a + s,))
            if (i == len(taken) or taken[i][0] >= a + e) and (i == 0 or taken[i - 1][1] <= a + s):
                taken.insert(i, (a + s, a + e))
                spans.append((a + s, len(BASE), a + e, False, value))
    spans.sort(key=lambda s: s[:3])
    return [{"kind": (*BASE, "format")[k], "start": s, "end": e, "base": own, "score": v} for s, k, e, own, v in spans], scored


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", model: dict | None = None) -> DataFrame:
    """(key, spans, scored) for each row: all spans of its whole text, and how many candidates were scored.

    spans: kind, start and end (code points, end exclusive), base (a fixed pattern found it) and score (nats,
    for spans that an automaton found). Base spans always stay; a candidate, which is a run of characters or a part
    of one (see parts()), adds nothing where it overlaps one or a likelier candidate; scored counts the runs. A
    null or empty text has no spans; rows that repeat are treated alike; a null key stays null; an empty table
    gives no rows. model: of fit(), else one inferred from labelled_credentials() (150 a format).
    """
    model = model or standard_model()

    def make():
        memo: dict = {}

        def apply(column: pa.Array) -> list[pa.Array]:
            found = [find(t or "", model, memo) for t in column.to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
            return [pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], pa.int64())]

        return apply

    return map_texts(docs, key, text, make, SCHEMA)
