"""Parsers of model output as column expressions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITY_TYPES = ["PERSON", "ORG", "PLACE", "CONCEPT", "EVENT", "OTHER"]
EXTRACTION = "entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,relation:string,description:string>>, high_level_keywords array<string>"
BATCH = f"documents array<struct<doc_id:string,{EXTRACTION.replace(' array', ':array').replace(', ', ',')}>>"


def unfenced(x: Column) -> Column:
    """Without the lines that open and close a code fence."""
    return F.trim(F.regexp_replace(F.trim(x), r"(?m)^```.*$", ""))


def whole_json(s: Column) -> Column:
    """Whether a text is one JSON value and nothing else; the parsers of single values stop at the first one's end."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), s, F.lit("]"))) == 1, F.lit(False))


def _first_object(x: Column) -> Column:
    """The first JSON object that starts at some brace and is whole; null without any."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(s: str | None) -> str | None:
            at = -1 if s is None else s.find("{")
            while at >= 0:
                try:
                    return s[at : decoder.raw_decode(s, at)[1]]
                except (ValueError, RecursionError):
                    at = s.find("{", at + 1)
            return None

        return texts.astype(object).where(texts.notna(), None).map(one).astype(object)

    return run.asNondeterministic()(x)  # no rule may then inline it into an expression over arrays


def embedded_json(x: Column) -> Column:
    """The text of the JSON object in a model's answer: the whole text, else the first whole object in it.

    The search for a brace from which an object can be read runs in Arrow batches and sees only answers that are not JSON as they stand.
    This, and what calls it, must be a column of its own before expressions over arrays use it.
    """
    s = unfenced(x)
    whole = s.startswith("{") & whole_json(s)
    return F.coalesce(F.when(whole, s), _first_object(F.when(~whole & s.contains("{"), s)))


def recovered(x: Column) -> Column:
    """Whether the JSON had to be searched for in an answer that is none as it stands; null without any."""
    s = unfenced(x)
    return F.when(embedded_json(x).isNotNull(), ~(s.startswith("{") & whole_json(s)))


def extraction(x: Column) -> Column:
    return F.from_json(embedded_json(x), EXTRACTION)


def batch_extraction(x: Column) -> Column:
    return F.from_json(embedded_json(x), BATCH)


def valid_entities(found: Column, cut: int = 200) -> Column:
    """Named entities with a known type and a short description."""
    named = F.filter(found, lambda e: F.length(F.trim(F.coalesce(e["name"], F.lit("")))) >= 1)

    def one(e: Column) -> Column:
        kind = F.upper(F.coalesce(e["type"], F.lit("OTHER")))
        return F.struct(F.trim(e["name"]).alias("name"), F.when(kind.isin(ENTITY_TYPES), kind).otherwise("OTHER").alias("type"), F.substring(F.coalesce(e["description"], F.lit("")), 1, cut).alias("description"))

    return F.transform(F.coalesce(named, F.array()), one)


def valid_relations(found: Column, cut: int = 200) -> Column:
    """Relations with both ends; a missing label reads ``related to``."""
    text = lambda r, c: F.trim(F.coalesce(r[c], F.lit("")))
    whole = F.filter(found, lambda r: (text(r, "source") != "") & (text(r, "target") != ""))

    def one(r: Column) -> Column:
        label = F.when(text(r, "relation") == "", "related to").otherwise(text(r, "relation"))
        return F.struct(text(r, "source").alias("source"), text(r, "target").alias("target"), label.alias("relation"), F.substring(F.coalesce(r["description"], F.lit("")), 1, cut).alias("description"))

    return F.transform(F.coalesce(whole, F.array()), one)


def valid_keywords(found: Column, least: int = 2, most: int = 80, limit: int = 10) -> Column:
    """Trimmed, of 2 to 80 characters, first of those equal but for case, 10 at most (the feature's own limit)."""
    fits = F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: F.length(k).between(least, most))
    new = lambda held, k: (F.size(held) < limit) & ~F.exists(held, lambda x: F.lower(x) == F.lower(k))
    return F.aggregate(fits, F.array().cast("array<string>"), lambda held, k: F.when(new(held, k), F.array_append(held, k)).otherwise(held))


def keyword_losses(found: Column, least: int = 2, most: int = 80, limit: int = 10) -> Column:
    """How many keywords ``valid_keywords`` rejects for their length, and how many different ones its limit drops."""
    some = F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda k: F.trim(k)), lambda k: k.isNotNull())
    fits = F.filter(some, lambda k: F.length(k).between(least, most))
    distinct = F.size(F.array_distinct(F.transform(fits, lambda k: F.lower(k))))
    return F.struct((F.size(some) - F.size(fits)).alias("rejected_len"), F.greatest(F.lit(0), distinct - limit).alias("dropped_by_cap"))


def query_levels(x: Column) -> Column:
    return F.from_json(embedded_json(x), "low_level array<string>, high_level array<string>")


def query_keywords(j: Column, limit: int = 20) -> Column:
    """low and high level keywords of a query (a column of ``query_levels``), falsy ones dropped, 20 of each at most."""
    some = lambda a: F.slice(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda k: F.coalesce(k, F.lit("")) != ""), 1, limit)
    return F.struct(some(j["low_level"]).alias("low"), some(j["high_level"]).alias("high"))


def judge_json(x: Column) -> Column:
    """The JSON text in a judge's answer: all of it, else the first flat object that names a score; null if neither is JSON."""
    s = F.trim(x)
    inner = F.regexp_extract(s, r'(?s)\{[^{}]*"score"[^{}]*\}', 0)
    return F.when(whole_json(s), s).when(whole_json(inner), inner)


def judge_score_text(x: Column) -> Column:
    """Score in prose: a fraction, else a number from 0 to 1, else the first one or two digits after ``score``, if from 1 to 10, of ten; null if there is none."""
    s = F.lower(x)
    number = lambda pattern, group: F.nullif(F.regexp_extract(s, pattern, group), F.lit("")).cast("double")
    above, below = number(r"(\d+)\s*/\s*(\d+)", 1), number(r"(\d+)\s*/\s*(\d+)", 2)
    fraction = F.when(below > 0, F.least(F.lit(1.0), above / F.nullif(below, F.lit(0.0))))
    decimal = number(r"\b(0(?:\.\d+)?|1(?:\.0+)?)\b", 1)
    spelled = number(r"score[:\s]*\b(\d{1,2})\b", 1)
    return F.coalesce(fraction, decimal, F.when(spelled.between(1, 10), spelled / 10))


def judge_result(x: Column) -> Column:
    """score in [0, 1], confidence, was_default (no score anywhere), parse_failure (no JSON with anything in it), error.

    A JSON object without a score counts 0. JSON that is no object, or whose score is no number, is an error of value 0; an empty
    object, list or text, 0, false and null count as no JSON.
    """
    raw = F.coalesce(x, F.lit(""))
    j, s = judge_json(raw), judge_score_text(raw)
    nothing = j.isNull() | j.rlike(r'^(\{\s*\}|\[\s*\]|""|null|false|-?0+(\.0*)?([eE][+-]?\d+)?)$')
    keys = F.coalesce(F.json_object_keys(F.when(j.startswith("{"), j)), F.array().cast("array<string>"))
    stated = F.get_json_object(j, "$.score").try_cast("double")
    scored = F.when(~F.array_contains(keys, "score"), 0.0).otherwise(stated)
    wrong = ~nothing & (~j.startswith("{") | scored.isNull())
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    both = F.array_contains(keys, "score") & F.array_contains(keys, "justification")
    return F.struct(
        F.when(wrong, 0.0).when(nothing, F.coalesce(s, F.lit(0.5))).otherwise(clamp(scored)).alias("score"),
        F.when(wrong, 0.0).when(nothing & s.isNull(), 0.2).when(nothing, 0.4).when(both, 0.9).otherwise(0.6).alias("confidence"),
        (nothing & s.isNull()).alias("was_default"),
        nothing.alias("parse_failure"),
        F.when(wrong, F.lit("the answer of the judge has no score")).alias("error"),
    )


def citations(x: Column, n: Column) -> Column:
    """Counts of [ref:k] marks in a text with n citable chunks."""
    s = F.coalesce(x, F.lit(""))
    strict = F.transform(F.regexp_extract_all(s, F.lit(r"\[ref:(\d+)\]"), F.lit(1)), lambda v: v.cast("int"))
    loose = F.regexp_count(s, F.lit(r"(?i)\[\s*ref[^\]]*\]"))
    inside = F.filter(strict, lambda v: (v >= 1) & (v <= n))
    distinct = F.size(F.array_distinct(inside))
    return F.struct(
        loose.cast("long").alias("total"),
        F.size(strict).cast("long").alias("valid"),
        (loose - F.size(strict)).cast("long").alias("malformed"),
        F.size(inside).cast("long").alias("in_range"),
        (F.size(strict) - F.size(inside)).cast("long").alias("out_of_range"),
        distinct.cast("long").alias("distinct_refs"),
        F.when(F.size(inside) > 0, F.bround(distinct / F.size(inside), 3)).otherwise(0.0).alias("coverage_ratio"),
    )
