"""Probabilistic automata inferred from samples by state merging (red-blue order, Hoeffding tests)."""

from __future__ import annotations

import math


class Automaton:
    """A deterministic automaton with counts: state -> symbol -> (next state, count), and endings."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        self.total: list[int] = [0]

    def _new(self) -> int:
        for part, value in ((self.next, {}), (self.count, {}), (self.ends, 0), (self.total, 0)):
            part.append(value)
        return len(self.next) - 1

    def add(self, word: list[str]) -> None:
        at = 0
        for s in word:
            self.total[at] += 1
            self.count[at][s] = self.count[at].get(s, 0) + 1
            if s not in self.next[at]:
                self.next[at][s] = self._new()
            at = self.next[at][s]
        self.total[at] += 1
        self.ends[at] += 1

    def freeze(self, sizes: dict[str, int], floor: float = 1e-4) -> dict:
        """Log-probabilities by state. A symbol for a class of n characters gives each 1/n of its share."""
        states = []
        for at in range(len(self.next)):
            n = self.total[at] + 1.0
            states.append(({s: (self.next[at][s], math.log(c / n * (1 - floor)) - math.log(sizes.get(s, 1))) for s, c in self.count[at].items()}, math.log(max(self.ends[at] / n, floor))))
        return {"states": states, "miss": math.log(floor)}


def _differ(a: int, n: int, b: int, m: int, alpha: float) -> bool:
    return bool(n and m) and abs(a / n - b / m) > (math.sqrt(1 / n) + math.sqrt(1 / m)) * math.sqrt(0.5 * math.log(2 / alpha))


def _compatible(t: Automaton, a: int, b: int, alpha: float) -> bool:
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        n, m = t.total[a], t.total[b]
        if _differ(t.ends[a], n, t.ends[b], m, alpha):
            return False
        for s in t.count[a].keys() | t.count[b].keys():
            if _differ(t.count[a].get(s, 0), n, t.count[b].get(s, 0), m, alpha):
                return False
            if s in t.next[a] and s in t.next[b]:
                todo.append((t.next[a][s], t.next[b][s]))
    return True


def _fold(t: Automaton, a: int, b: int) -> None:
    """Add what tree state b has to state a."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        t.total[a] += t.total[b]
        t.ends[a] += t.ends[b]
        for s, c in t.count[b].items():
            t.count[a][s] = t.count[a].get(s, 0) + c
            if s in t.next[a]:
                todo.append((t.next[a][s], t.next[b][s]))
            else:
                t.next[a][s] = t.next[b][s]


def infer(words: list[list[str]], alpha: float = 0.05) -> Automaton:
    """Merge the states of the words' prefix tree that no test tells apart; the rest become states of their own."""
    t = Automaton()
    for w in words:
        t.add(w)
    red, blue = [0], [(0, s) for s in sorted(t.next[0])]
    while blue:
        blue.sort(key=lambda x: (-t.total[t.next[x[0]][x[1]]], x))
        source, s = blue.pop(0)
        state = t.next[source][s]
        if state in red:
            continue
        into = next((r for r in red if _compatible(t, r, state, alpha)), None)
        if into is None:
            red.append(state)
        else:
            t.next[source][s] = into
            _fold(t, into, state)
        known = set(red)
        blue = [(r, x) for r in red for x in t.next[r] if t.next[r][x] not in known]
    place = {r: i for i, r in enumerate(red)}
    out = Automaton()
    out.next = [{s: place[x] for s, x in t.next[r].items()} for r in red]
    out.count, out.ends, out.total = [t.count[r] for r in red], [t.ends[r] for r in red], [t.total[r] for r in red]
    return out


def log_likelihood(frozen: dict, word: list[str]) -> float:
    """Of a word; a symbol that a state has never seen costs a fixed sum and leads back to the start."""
    states, miss = frozen["states"], frozen["miss"]
    at, score = 0, 0.0
    for s in word:
        step = states[at][0].get(s)
        if step is None:
            at, score = 0, score + miss
        else:
            at, score = step[0], score + step[1]
    return score + states[at][1]
