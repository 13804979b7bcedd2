"""Text cleaning and keys, as Columns. Only entity unescaping and NFKC need Python, for the rows that need them."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns, lengths and wordings that results depend on.
TAG = r"</?[a-zA-Z][a-zA-Z0-9]{0,19}(?:\s[^>]{0,300})?/?>"
INVISIBLE = "[­​-‏ -‮⁠-⁯﻿]"
ANY_TAG = r"<[^>]*>"
NOT_WORD = "[^0-9a-zа-яıᲀ-ᲆ]+"
NOT_KEY = "[^0-9a-zа-яё]+"
TEMPLATE_CHARS, TEMPLATE_LEAST = 220, 40
NAME_CHARS, NAME_LEAST = 60, 15
BRAND_LEAST = 3
PASSAGE_CHARS = 1500
OCR_CHARS = 1200
TAGS_COUNTED = r"<[^>]*>"
DOSAGE = r"(?iU)[0-9]+\s*(?:мг|мкг|мл|ме|iu)\b"
SECTION = r"(?U)(состав|противопоказани\w*|способ\s+применени\w*|особые\s+указани\w*|условия\s+хранени\w*|показания\s+к\s+применению)"

#: Code points outside this set, or '&', call for Python: all others are their own NFKC form.
_PLAIN = r"&|[^\x00-\x7FÀ-ÿЀ-ӿ]"


_ENTITY = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def unescaped_closed(text: str) -> str:
    """html.unescape() of entities that end with a semicolon; what a cut has left of one, and names that only begin with one's, stay."""
    return _ENTITY.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" or m[1] + ";" in html.entities.html5 else m[0], text)


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series, unescapes: pd.Series, closed: pd.Series) -> pd.Series:
    def one(t: str | None, n: int, c: bool) -> str | None:
        if t is None:
            return None
        for _ in range(n):
            t = unescaped_closed(t) if c else html.unescape(t)
        return unicodedata.normalize("NFKC", t)

    return pd.Series([one(t, n, c) for t, n, c in zip(text, unescapes, closed, strict=True)], dtype=object)


def let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_of(value: Column) -> Column:
    """A value as text; null is empty."""
    return F.coalesce(value.cast("string"), F.lit(""))


def unescaped_nfkc(text: Column, unescapes: int, closed: bool = False) -> Column:
    """HTML entities (closed: only with their semicolon) unescaped so many times, then NFKC. Rows that need neither send no text to Python."""
    text = text_of(text)
    return F.coalesce(_folded(F.when(text.rlike(_PLAIN), text), F.lit(unescapes), F.lit(closed)), text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean(text: Column, closed: bool = False) -> Column:
    """Display cleaning: unescape twice (closed: only entities with their semicolon), NFKC, drop invisible characters, tags to blanks, one blank at most."""
    return collapse(F.regexp_replace(F.regexp_replace(unescaped_nfkc(text, 2, closed), INVISIBLE, ""), TAG, " "))


def normalize(text: Column) -> Column:
    """Matching form: unescape once, NFKC, lower case, ё as е, tags and all but letters and digits to blanks."""
    return normalize_plain(unescaped_nfkc(text, 1))


def normalize_plain(text: Column) -> Column:
    """normalize() of a text without entities that is its own NFKC form."""
    lower = F.replace(F.lower(text_of(text)), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(F.regexp_replace(lower, ANY_TAG, " "), NOT_WORD, " "))


def labelled_text(name: Column, category: Column, description: Column) -> Column:
    return F.concat(F.lit("Название: "), name, F.lit("\nКатегория: "), category, F.lit("\nОписание: "), description)


def full_key_text(name_n: Column, description_n: Column) -> Column:
    return F.concat_ws("\x1f", name_n, description_n)


def model_text(name_n: Column, description_n: Column, ocr_n: Column | None = None) -> Column:
    """Field-marked text of normalised fields; a non-empty reading of the images is added."""
    out = F.concat(F.lit("название "), name_n, F.lit(" название "), name_n, F.lit(" описание "), description_n)
    return out if ocr_n is None else F.when(F.coalesce(ocr_n, F.lit("")) != "", F.concat(out, F.lit(" изображение "), ocr_n)).otherwise(out)


def basic_model_text(name: Column, description: Column, times: int = 3) -> Column:
    return F.concat(F.repeat(F.concat(name, F.lit(" ")), times), description)


def dedup_key(name: Column, description: Column) -> Column:
    """Letters and digits of both fields run together."""
    return F.regexp_replace(F.lower(F.concat(text_of(name), text_of(description))), NOT_KEY, "")


def unicode_key(name: Column, description: Column) -> Column:
    """As dedup_key(), with the letters and digits of every script."""
    return F.regexp_replace(F.lower(F.concat(text_of(name), text_of(description))), r"[^\p{L}\p{N}]+", "")


def digest(text: Column) -> Column:
    """An equality key; null for an empty text."""
    return F.when(text != "", F.sha2(text, 256))


def template_key(description_n: Column) -> Column:
    prefix = F.substring(description_n, 1, TEMPLATE_CHARS)
    return F.when(F.length(prefix) >= TEMPLATE_LEAST, F.sha2(prefix, 256))


def name_key(name_n: Column) -> Column:
    prefix = F.substring(name_n, 1, NAME_CHARS)
    return F.when(F.length(prefix) >= NAME_LEAST, F.sha2(F.concat(F.lit("n:"), prefix), 256))


def brand_key(name_n: Column) -> Column:
    first = F.substring_index(name_n, " ", 1)
    return F.when(F.length(first) >= BRAND_LEAST, first)


def category_key(category: Column) -> Column:
    """Configuration key: lower case, ё as е, one blank at most."""
    return collapse(F.replace(F.lower(text_of(category)), F.lit("ё"), F.lit("е")))


def passage_text(name: Column, description: Column) -> Column:
    return F.substring(F.concat(F.lit("passage: "), text_of(name), F.lit(". "), text_of(description)), 1, PASSAGE_CHARS)


def strip_reasoning(text: Column) -> Column:
    return F.regexp_replace(text_of(text), r"(?s)<think>.*?</think>", "")


def clean_output(text: Column) -> Column:
    """Model output without its reasoning; the content of a rationale tag if there is one."""
    bare = F.regexp_replace(strip_reasoning(text), r"\A\s+|\s+\z", "")
    inner = F.regexp_extract(bare, r"(?s)<rationale>(.*?)</rationale>", 1)
    return F.when(bare.rlike(r"(?s)<rationale>.*?</rationale>"), F.regexp_replace(inner, r"\A\s+|\s+\z", "")).otherwise(bare)


def clean_ocr(text: Column) -> Column:
    return F.substring(collapse(strip_reasoning(text)), 1, OCR_CHARS)


def structural_features(name: Column, description: Column) -> dict[str, Column]:
    """Seven measures of a raw card."""
    name, description = text_of(name), text_of(description)
    doses = F.regexp_count(description, F.lit(DOSAGE))
    sections = F.size(F.array_distinct(F.regexp_extract_all(F.lower(description), F.lit(SECTION), F.lit(1))))
    return {
        "log_tags": F.log1p(F.regexp_count(description, F.lit(TAGS_COUNTED)).cast("double")),
        "has_sections": (sections >= 3).cast("double"),
        "has_dosage": (doses > 0).cast("double"),
        "dosages": F.least(doses, F.lit(10)).cast("double"),
        "log_description": F.log1p(F.length(description).cast("double")),
        "log_name": F.log1p(F.length(name).cast("double")),
        "nonempty": (F.trim(F.regexp_replace(description, r"\s", " ")) != "").cast("double"),
    }
