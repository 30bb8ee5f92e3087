"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dashes that become a space, and the articles of two languages.
DASHES = "‐‑‒–—―−﹘－"
ARTICLES = {"en": ["a", "an", "the"], "es": ["el", "la", "los", "las", "un", "una", "unos", "unas"]}
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def safe_str(x: Column, default: str = "") -> Column:
    """Text of a value; null, NaN and their spelled forms give the default."""
    s = x.cast("string")
    return F.when(s.isNull() | s.isin("None", "nan", "NaN"), F.lit(default)).otherwise(s)


def coerce_int(x: Column) -> Column:
    """Whole number of a value, cut towards zero; null where it is none."""
    d = x.cast("string").try_cast("double")
    return F.when(~F.isnan(d), d).try_cast("int")


def full_text(title: Column, content: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit("\n\n"), F.coalesce(content, F.lit("")))).otherwise(F.coalesce(content, F.lit("")))


def _bases() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base character and marks, and those bases."""
    pairs = []
    for code in range(0xC0, 0x3100):
        c = chr(code)
        rest = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if rest != c and len(rest) == 1:
            pairs.append((c, rest))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


_FROM, _TO = _bases()


def strip_accents(x: Column) -> Column:
    return F.regexp_replace(F.translate(x, _FROM, _TO), r"\p{Mn}", "")


def normalize_text(x: Column, lowercase: bool = True, accents: bool = True, punctuation: bool = True, articles: bool = False, language: str = "en") -> Column:
    """Lower case, no accents, dashes to spaces, no punctuation, single spaces, no articles: in this order."""
    s = F.coalesce(x, F.lit(""))
    if lowercase:
        s = F.lower(s)
    if accents:
        s = strip_accents(s)
    if punctuation:
        s = F.translate(s, DASHES, " " * len(DASHES))
        s = F.translate(s, ASCII_PUNCTUATION, "")
    s = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    if articles:
        words = F.filter(F.split(s, " "), lambda w: ~w.isin(ARTICLES.get(language, [])) & (w != ""))
        s = F.array_join(words, " ")
    return s


def tokens(x: Column) -> Column:
    return F.filter(F.split(normalize_text(x), " "), lambda w: w != "")


def entity_name(x: Column) -> Column:
    """Lower case, trimmed, one leading article dropped, signs dropped, single spaces."""
    s = F.trim(F.lower(F.coalesce(x, F.lit(""))))
    s = F.regexp_replace(s, r"^(?:the|an|a) ", "")
    s = F.regexp_replace(s, r"(?U)[^\w\s\-']", "")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def strip_think(x: Column) -> Column:
    """Without closed thinking blocks, then without an open one at the end."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*$", ""))


def prefix(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)
