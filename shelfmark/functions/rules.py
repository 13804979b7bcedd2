"""The lexical rule bank: patterns as data, and the flags, features and quotes that follow from them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories, patterns over normalised text, and their labels.
SUPPLEMENT, FLAMMABLE = "БАД", "Легковоспламеняющиеся"

RUSSIAN = {
    "bad_marker": r"(?:\bбад\b|биологическ\w*\s+активн\w*\s+добавк\w*|dietary\s+supplement|food\s+supplement)",
    "not_bad": r"(?:не\s+явля\w*\s+(?:биологическ\w*\s+активн\w*\s+добавк\w*|бад)|не\s+(?:является\s+)?бад\b|not\s+(?:a\s+)?dietary\s+supplement)",
    "strict_bad_marker": r"биологическ\w*\s+активн\w*\s+добавк\w*\s+к\s+пище",
    "bach_flower": r"(?:цвет\w*\s+баха|bach\s+flower)",
    "empty_supplement_container": r"(?:таблетниц\w*|органайзер\w*\s+для\s+лекарств\w*|пуст\w*\s+капсул\w*)",
    "sports": r"(?:спортивн\w*\s+питан\w*|\bпротеин\w*|\bгейнер\w*|\bbcaa\b|аминокислот\w*|л[ -]?карнитин\w*|\bcarnitine\b|\bcreatine\b|\bкреатин\w*|предтрен\w*|изотоник\w*|сывороточн\w*\s+белок)",
    "standalone": r"(?:\bспичк\w*|\bзажигалк\w*|\bхлопушк\w*|\bсалют\w*|\bфейерверк\w*|бенгальск\w*\s+(?:огн\w*|свеч\w*)|дым\w*\s+шашк\w*|цветн\w*\s+дым\w*|свеч\w*[- ]?фонтан\w*|пиротехн\w*)",
    "fuel": r"(?:\bбутан\w*|\bпропан\w*|\bгаз\w*\s+баллон\w*|баллон\w*\s+с\s+газ\w*|газ\w*\s+для\s+(?:зажигал\w*|плит\w*)|топлив\w*\s+для\s+зажигал\w*|сух\w*\s+горюч\w*|\bрастопк\w*|ролл\w*\s+для\s+розжиг\w*|угол\w*\s+(?:древесн\w*|каменн\w*)|брикет\w*\s+для\s+(?:грил\w*|розжиг\w*))",
    "device": r"(?:\bмангал\w*|\bгрил\w*|\bпеч\w*|\bкамин\w*|\bплит\w*|\bгорелк\w*|\bтаган\w*|\bразогревател\w*|\bрозжиг\w*)",
    "included": r"(?:в\s+комплект\w*|комплект\w*\s+с|в\s+набор\w*|набор\w*\s+с|вход\w*\s+в\s+комплект|поставля\w*\s+с|вместе\s+с|укомплектован\w*)",
    "absent": r"(?:без\s+(?:газ\w*|баллон\w*|топлив\w*|угл\w*|спич\w*|брик\w*|растопк\w*)|не\s+(?:вход\w*|включен\w*|постав\w*)|приобрета\w*\s+отдельно|баллон\w*\s+отдельно|(?:газ\w*|баллон\w*|топлив\w*|угол\w*|растопк\w*)\s+(?:не\s+вход\w*|не\s+прилага\w*|приобрета\w*\s+отдельно)|не\s+комплекту\w*\s+(?:газ\w*|баллон\w*|топлив\w*))",
    "refillable": r"(?:перезаправ\w*|заправляем\w*|газ\s+заправляется|резервуар\w*)",
    "absence_veto": r"(?:без\s+(?:газ|баллон|топлив|угл|спич)|не\s+(?:входит|включен|постав)|приобрет\w*\s+отдельно|баллон\w*\s+отдельно)",
    "designed_for": r"(?:(?:насадк\w*|переходник\w*)\s+(?:на|для)\s+баллон\w*|для\s+(?:газ\w*\s+)?баллон\w*|совместим\w*\s+с\s+баллон\w*)",
    "built_in": r"(?:пьезо(?:электрическ\w*)?(?:поджиг\w*)?|встроенн\w*\s+(?:поджиг\w*|зажиг\w*))",
    "component": r"(?:огнеупорн\w*|огнестойк\w*|термостойк\w*|негорюч\w*|чехол\w*|сумк\w*|опахал\w*|аксессуар\w*|запчаст\w*)",
    "strict_flame": r"(?:гост\s+1820\s+2001|дымова\w*\s+шашк\w*|шашк\w*\s+дымов\w*|pyrofx|a2tech|бдш\s+тип|joker\s+fireworks|maxsem\s+smoking|газ\s+для\s+заправк\w*\s+зажигал\w*|газ\s+для\s+портативн\w*\s+плит\w*|свеч\w*\s+фонтан\w*|фонтан\w*\s+(?:в|для)\s+торт\w*|фонтаны\s+в\s+торт\w*)",
    "family_clapper": r"хлопушк\w*.*артикул\s+тр",
    "family_grill": r"мангал одноразов",
    "family_coal": r"(?:комплект\w*\s+с|с)\s+угл",
    "family_card": r"интерактивн\w*\s+открытк",
    "family_candle": r"свеч",
    "family_match": r"спич",
}

QUOTE_SOURCES = {
    SUPPLEMENT: [("маркировка БАД", "bad_marker"), ("отрицание БАД", "not_bad"), ("спортивное питание", "sports"), ("пустая тара", "empty_supplement_container")],
    FLAMMABLE: [("горючее или пиротехника", "standalone"), ("топливо не входит", "absent"), ("топливо", "fuel"), ("входит в комплект", "included"), ("устройство", "device")],
}
QUOTE_CONFLICTS = {"топливо не входит": ["входит в комплект", "топливо"]}
QUOTE_WORDS = 3


WORD = "0-9a-zа-яıᲀ-ᲆ"


@lru_cache(maxsize=1024)
def plain_pattern(pattern: str, whole: bool = True) -> str:
    """The pattern for normalised texts (characters of WORD and single blanks), without Unicode classes, which are slow.

    \\w and \\s become classes, \\b a look to the side where no character of a word may be. Without `whole` only
    finding counts, not what is found, and \\w* that ends the pattern or one of its last alternatives goes.
    """
    out, stack = [], []
    opened = {}
    for i, c in enumerate(pattern):
        if c == "(" and pattern[i - 1 : i] != "\\":
            stack.append(i)
        elif c == ")" and pattern[i - 1 : i] != "\\":
            opened[i] = stack.pop()
    inner = sorted((a, b) for b, a in opened.items())

    def last(at: int) -> bool:
        """Whether nothing that must match follows: the end, or the end of an alternative of a group that is last itself."""
        if at == len(pattern):
            return True
        if pattern[at] not in "|)":
            return False
        around = [b for a, b in inner if a < at <= b]
        return last(min(around) + 1) if around else True

    i = 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\w" and not whole and pattern[i + 2 : i + 3] == "*" and last(i + 3):
            i += 3
            continue
        if two == r"\w":
            out.append(f"[{WORD}]")
        elif two == r"\s":
            out.append(" ")
        elif two == r"\b":
            before = pattern[i - 1 : i]
            ends = bool(before) and (before.isalnum() or before in "*)]}") and pattern[i - 2 : i] not in (r"\s", r"\b")
            out.append(f"(?![{WORD}])" if ends else f"(?<![{WORD}])")
        else:
            out.append(pattern[i])
            i += 1
            continue
        i += 2
    return "".join(out)


def _alternatives(pattern: str) -> list[str]:
    """What stands between the outermost bars, a group around the whole pattern taken off first."""
    depth, cuts, closed = 0, [], False
    for i, c in enumerate(pattern):
        escaped = pattern[i - 1 : i] == "\\"
        if c == "(" and not escaped:
            depth += 1
        elif c == ")" and not escaped:
            depth -= 1
            closed = closed or depth == 0 and i < len(pattern) - 1
        elif c == "|" and depth == 0:
            cuts.append(i)
    if not cuts and not closed and pattern.startswith("(") and pattern.endswith(")"):
        return _alternatives(pattern[3:-1] if pattern.startswith("(?:") else pattern[1:-1])
    return [pattern[a:b] for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(pattern)], strict=True)]


@lru_cache(maxsize=1024)
def needed_literals(pattern: str) -> tuple[str, ...]:
    """Strings of which every text that the pattern is found in holds one; empty if there are none to name."""
    out = []
    for part in _alternatives(pattern):
        bare = re.sub(r"\\b", "", part)
        while re.search(r"\([^()]*\)[?*+]?", bare):  # groups may hold anything
            bare = re.sub(r"\([^()]*\)[?*+]?", "\0", bare)
        bare = re.sub(r"\[[^\]]*\][?*+]?|\\.[?*+]?|.[?*]|\.", "\0", bare)
        longest = max(re.findall(r"[^\W_]+", bare), key=len, default="")
        if len(longest) < 2:
            return ()
        out.append(longest)
    return tuple(dict.fromkeys(out))


@dataclass
class Bank:
    """Patterns by rule name, and what quotes are taken from by category."""

    patterns: dict[str, str] = field(default_factory=lambda: dict(RUSSIAN))
    quotes: dict[str, list[tuple[str, str]]] = field(default_factory=lambda: dict(QUOTE_SOURCES))
    conflicts: dict[str, list[str]] = field(default_factory=lambda: dict(QUOTE_CONFLICTS))
    supplement: str = SUPPLEMENT
    flammable: str = FLAMMABLE

    def hit(self, rule: str, text: Column) -> Column:
        """Whether the rule's pattern is in a normalised text; \\w and \\b know all its letters."""
        found = text.rlike(plain_pattern(self.patterns[rule], whole=False))
        needed = needed_literals(self.patterns[rule])
        # Looking for a literal is many times faster than the pattern, which most texts don't hold.
        return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in needed]) & found if needed else found


def joined(name_n: Column, description_n: Column) -> Column:
    return F.trim(F.concat(name_n, F.lit(" "), description_n))


def strict_family(bank: Bank, name_n: Column, text: Column) -> Column:
    """The strict pattern, or one of three families told by several marks together."""
    return bank.hit("strict_flame", text) | bank.hit("family_clapper", name_n) | (bank.hit("family_grill", name_n) & bank.hit("family_coal", name_n)) | (bank.hit("family_card", name_n) & bank.hit("family_candle", text) & bank.hit("family_match", text))


def evidence_flags(bank: Bank, name_n: Column, description_n: Column) -> dict[str, Column]:
    """Eighteen booleans by name."""
    text = joined(name_n, description_n)
    hit = {r: bank.hit(r, text) for r in ("bad_marker", "not_bad", "sports", "strict_bad_marker", "bach_flower", "empty_supplement_container", "standalone", "fuel", "device", "included", "absent", "refillable", "designed_for", "built_in")}
    dry = ~hit["refillable"]
    return hit | {
        "strict_bad_marker_no_sports": hit["strict_bad_marker"] & ~hit["sports"],
        "absence_non_refill": hit["absent"] & dry,
        "empirical_absence_veto": bank.hit("absence_veto", text) & dry,
        "strict_positive_family": strict_family(bank, name_n, text),
    }


def rule_features(bank: Bank, name_n: Column, description_n: Column) -> dict[str, Column]:
    """Thirty-eight doubles by name: hits, their products, and two log lengths."""
    text = joined(name_n, description_n)
    number = lambda c: c.cast("double")
    at = {r: number(bank.hit(r, text)) for r in bank.patterns if not r.startswith(("family", "strict_flame"))}
    dry = F.lit(1.0) - at["refillable"]
    out = {
        "marker_any": at["bad_marker"], "marker_name": number(bank.hit("bad_marker", name_n)), "marker_description": number(bank.hit("bad_marker", description_n)), "explicit_not_bad": at["not_bad"],
        "sports_any": at["sports"], "sports_name": number(bank.hit("sports", name_n)), "marker_x_not_bad": at["bad_marker"] * at["not_bad"], "marker_x_sports": at["bad_marker"] * at["sports"],
        "strict_bad_marker": at["strict_bad_marker"], "strict_bad_marker_no_sports": at["strict_bad_marker"] * (F.lit(1.0) - at["sports"]), "bach_flower": at["bach_flower"], "empty_supplement_container": at["empty_supplement_container"],
        "standalone_ignition": at["standalone"], "fuel_or_material": at["fuel"], "device": at["device"], "included": at["included"], "content_absent": at["absent"], "refillable": at["refillable"],
        "absence_non_refill": at["absent"] * dry, "empirical_absence_veto": at["absence_veto"] * dry, "designed_for": at["designed_for"], "built_in_ignition": at["built_in"], "component_or_accessory": at["component"],
        "fuel_x_included": at["fuel"] * at["included"], "device_x_included": at["device"] * at["included"], "device_x_absent": at["device"] * at["absent"], "device_x_designed_for": at["device"] * at["designed_for"], "standalone_x_absent": at["standalone"] * at["absent"],
    }
    for rule, column in (("standalone", "name_standalone"), ("fuel", "name_fuel"), ("device", "name_device"), ("included", "name_included"), ("absent", "name_absent")):
        out[column] = number(bank.hit(rule, name_n))
    for rule in ("included", "absent"):
        out[f"description_{rule}"] = number(bank.hit(rule, description_n))
    out["strict_positive_family"] = number(strict_family(bank, name_n, text))
    out["log_name_length"] = F.log1p(F.length(name_n).cast("double"))
    out["log_description_length"] = F.log1p(F.length(description_n).cast("double"))
    return out


def absence_veto(bank: Bank, category: Column, name_n: Column, description_n: Column) -> Column:
    text = F.concat(name_n, F.lit(" "), description_n)
    return (category == bank.flammable) & bank.hit("absence_veto", text) & ~bank.hit("refillable", text)


def strict_positive(bank: Bank, category: Column, name_n: Column, description_n: Column) -> Column:
    """The strict pattern alone, not the wider family."""
    return (category == bank.flammable) & bank.hit("strict_flame", F.concat(name_n, F.lit(" "), description_n))


def evidence_quotes(bank: Bank, category: Column, text: Column, limit: int = 2) -> Column:
    """array<struct<label,quote>>: the first matches of a category's patterns in a normalised text, with QUOTE_WORDS
    words around each, in the order of the patterns. A quote that overlaps one taken before is left out, as is
    a label that one taken before rules out.
    """
    words = F.split(text, " ")
    taken_type = "array<struct<label:string,lo:int,hi:int>>"
    blank = F.array().cast(taken_type)
    count = lambda t: F.when(F.trim(t) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(t), " ")))

    def of(sources: list[tuple[str, str]]) -> Column:
        found = []
        for label, rule in sources:
            pattern = F.lit(plain_pattern(bank.patterns[rule]))
            start, hit = F.regexp_instr(text, pattern), F.regexp_substr(text, pattern)
            lo = F.greatest(F.lit(0), count(F.substring(text, F.lit(1), start - 1)) - QUOTE_WORDS)
            hi = F.least(F.size(words), count(F.substring(text, F.lit(1), start - 1 + F.length(hit))) + QUOTE_WORDS)
            found.append(F.when(hit.isNotNull() & (text != ""), F.struct(F.lit(label).alias("label"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))))
        rules_out = lambda x, y: F.lit(False)
        for first, others in bank.conflicts.items():
            rules_out = (lambda f, o, before: lambda x, y: before(x, y) | ((x["label"] == f) & y["label"].isin(*o)))(first, others, rules_out)

        def step(taken: Column, x: Column) -> Column:
            clash = F.exists(taken, lambda t: rules_out(t, x) | ((x["lo"] < t["hi"]) & (x["hi"] > t["lo"])))
            return F.when(x.isNull() | (F.size(taken) >= limit) | clash, taken).otherwise(F.concat(taken, F.array(x)).cast(taken_type))

        return F.aggregate(F.array(*found), blank, step)

    taken = F.lit(None).cast(taken_type)
    for name, sources in bank.quotes.items():
        taken = F.when(category == name, of(sources)).otherwise(taken)
    return F.transform(F.coalesce(taken, blank), lambda t: F.struct(t["label"].alias("label"), F.array_join(F.slice(words, t["lo"] + 1, t["hi"] - t["lo"]), " ").alias("quote")))

