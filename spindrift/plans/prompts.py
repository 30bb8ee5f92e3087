"""Prompts as column expressions, in our own words; the JSON shapes they ask for are those that ``functions.parse`` reads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.parse import ENTITY_TYPES

#: Characters of an answer, or of a context, that a judge sees.
JUDGED_CHARS = 2000
PREVIOUS_NAMES = 20

_ENTITY = '{"name": "...", "type": "' + "|".join(ENTITY_TYPES) + '", "description": "..."}'
_RELATION = '{"source": "...", "target": "...", "relation": "...", "description": "..."}'
_FOUND = f'"entities": [{_ENTITY}], "relations": [{_RELATION}]'
_TASK = "List up to ten entities, up to ten stated relations between them (labels of two to four words) and up to ten keywords for the themes"
_PLAIN = "Answer with one JSON object and nothing around it."


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n\n", *(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))


def extraction(text: Column) -> Column:
    return _lines(f"{_TASK} of this text.", f'{_PLAIN} Its form: {{{_FOUND}, "high_level_keywords": ["..."]}}', text)


def batch_extraction(blocks: Column) -> Column:
    form = f'{{"documents": [{{"doc_id": "...", {_FOUND}, "high_level_keywords": ["..."]}}]}}'
    return _lines(f"{_TASK} of each of these documents, each on its own.", f"{_PLAIN} Its form, with an entry and the doc_id of every document: {form}", blocks)


def document_block(number: Column, doc_id: Column, text: Column) -> Column:
    return F.concat(F.lit("[DOC "), number, F.lit(' id="'), doc_id, F.lit('"]\n'), text, F.lit("\n[/DOC "), number, F.lit("]"))


def gleaning(text: Column, names: Column) -> Column:
    """Asks again, naming the first entities found before."""
    held = F.array_join(F.slice(names, 1, PREVIOUS_NAMES), ", ")
    return _lines("A first reading of this text missed entities and relations. List only those that it did not find.", F.concat(F.lit("Found before: "), held), f"{_PLAIN} Its form: {{{_FOUND}}}", text)


def query_keywords(query: Column) -> Column:
    return _lines("Name what this query is about: low_level lists the specific names in it, high_level its themes.", f'{_PLAIN} Its form: {{"low_level": ["..."], "high_level": ["..."]}}', query)


def description(name: Column, descriptions: Column) -> Column:
    """Asks for one description in place of the first ten."""
    listed = F.array_join(F.transform(F.slice(descriptions, 1, 10), lambda d, i: F.concat((i + 1).cast("string"), F.lit(". "), d)), "\n")
    return _lines(F.concat(F.lit("Merge these descriptions of "), name, F.lit(" into one that keeps every fact. Answer with the description alone.")), listed)


def synthesis(query: Column, context: Column, max_chars: int) -> Column:
    rules = f"Retell what in the following bears on the question, in prose of at most {max_chars} characters. Use nothing else, do not answer the question, and cite a chunk as [ref:N] by its reference_id. Where the graph and a chunk differ, follow the chunk."
    return _lines(rules, F.concat(F.lit("QUESTION: "), query), context)


def generation(query: Column, context: Column, short: bool = False) -> Column:
    """``short`` asks for a name, a number, yes or no."""
    rules = "Answer the question from the context" + (", in as few words as possible; keep [ref:N] marks." if short else ".")
    return _lines(rules, F.concat(F.lit("CONTEXT:\n"), F.coalesce(context, F.lit(""))), F.concat(F.lit("QUESTION: "), query), "ANSWER:")


_SCORE = f'{_PLAIN} Its form: {{"score": 0.0 to 1.0, "justification": "..."}}'


def faithfulness(answer: Column, context: Column) -> Column:
    """Null without an answer or a context: there is nothing to judge."""
    whole = (F.coalesce(answer, F.lit("")) != "") & (F.coalesce(context, F.lit("")) != "")
    return F.when(whole, _lines("Score how far the context supports the answer.", _SCORE, context, F.substring(answer, 1, JUDGED_CHARS)))


def answer_relevance(answer: Column, query: Column) -> Column:
    whole = (F.coalesce(answer, F.lit("")) != "") & (F.coalesce(query, F.lit("")) != "")
    return F.when(whole, _lines("Score how far the answer addresses the question.", _SCORE, query, F.substring(answer, 1, JUDGED_CHARS)))
