"""Entities, relations and keywords that a model finds in documents and queries.

Answers of the model are stored, so that a lost executor or a second action does not ask the model again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..operators.ranking import call_groups
from . import prompts
from .providers import Model, complete_column
from .storage import stored

#: Documents of one bucket are numbered together; a call holds documents of one bucket only.
BUCKETS = 1024


#: Counters of the keywords that a document's answer loses.
LOST = ["rejected_len", "dropped_by_cap"]


def _valid(j: Column) -> list[Column]:
    lost = parse.keyword_losses(j["high_level_keywords"])
    return [parse.valid_entities(j["entities"]).alias("entities"), parse.valid_relations(j["relations"]).alias("relations"), parse.valid_keywords(j["high_level_keywords"]).alias("keywords"), *(lost[c].alias(c) for c in LOST)]


def _single(docs: DataFrame, model: Model) -> DataFrame:
    asked = complete_column(docs.withColumn("_p", prompts.extraction(F.col("text"))), "_p", model, "extraction")
    j = F.col("_j")
    told = asked.withColumn("_j", parse.extraction(F.col("answer"))).withColumn("_r", parse.recovered(F.col("answer")))
    return told.select("doc_id", *_valid(j), j.isNotNull().alias("parsed"), F.lit(False).alias("missing"), F.coalesce("_r", F.lit(False)).alias("recovered"), "error")


def batch_entries(asked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, doc_id, d: the entries of answers (keys, answer) over several documents; those without a doc_id are skipped, of equal ids the last counts."""
    found = asked.select(*keys, parse.batch_extraction(F.col("answer")).alias("_j")).select(*keys, F.posexplode("_j.documents").alias("_at", "d")).where("coalesce(d.doc_id, '') <> ''")
    return found.groupBy(*keys, F.col("d.doc_id").alias("doc_id")).agg(F.max_by("d", "_at").alias("d"))


def _batched(docs: DataFrame, model: Model, per_call: int) -> DataFrame:
    """Answers keyed back to the documents by doc_id; ``answered`` says whether the call's answer could be read at all."""
    placed = stored(call_groups(docs, per_call, BUCKETS), "call-groups")
    keys = ["_bucket", "_call"]
    block = F.struct("_place", prompts.document_block(F.col("_place").cast("string"), F.col("doc_id"), F.col("text")).alias("t"))
    calls = placed.groupBy(*keys).agg(F.sort_array(F.collect_list(block)).alias("_blocks"), F.count(F.lit(1)).cast("int").alias("_n")).where("_n > 1")  # per_call at most
    asked = calls.select(*keys, "_n", prompts.batch_extraction(F.array_join(F.transform("_blocks", lambda b: b["t"]), "\n\n")).alias("_p"))
    told = stored(complete_column(asked, "_p", model, "extraction", scale="_n").select(*keys, "answer"), "batch-answers")
    read = told.withColumn("_j", parse.batch_extraction(F.col("answer"))).select(*keys, F.col("_j.documents").isNotNull().alias("answered"), F.coalesce(parse.recovered(F.col("answer")), F.lit(False)).alias("_r"))
    joined = placed.join(read, keys, "left").join(batch_entries(told, keys), [*keys, "doc_id"], "left")
    has, answered = F.col("d").isNotNull(), F.coalesce("answered", F.lit(False))
    return joined.select("doc_id", "text", *_valid(F.col("d")), has.alias("parsed"), (answered & ~has).alias("missing"), (answered & F.col("_r") & (F.col("_place") == 1)).alias("recovered"), F.lit(None).cast("string").alias("error"), answered.alias("answered"))


def extract(corpus: DataFrame, model: Model, per_call: int = 5, max_chars: int = 3000, gleaning: int = 0) -> DataFrame:
    """doc_id, round, entities, relations, keywords, parsed, missing, recovered, error, empty_input and what keywords were lost: a row per document, and one more per round of gleaning.

    ``corpus`` has (doc_id, content), ids distinct. A document without text is not sent. If the answer of a call over several
    documents cannot be read, they are sent alone; one that an answer leaves out has nothing. Gleaning names the entities of the first reading, in every round, and brings no keywords.
    """
    docs = corpus.select(F.col("doc_id").cast("string").alias("doc_id"), F.substring(F.coalesce("content", F.lit("")), 1, max_chars).alias("text"))
    blank = F.trim("text") == ""
    if per_call > 1:
        first = stored(_batched(docs.where(~blank), model, per_call), "extracted")
        alone = _single(first.where("not answered").select("doc_id", "text"), model)
        found = first.where("answered").drop("text", "answered").unionByName(alone)
    else:
        found = _single(docs.where(~blank), model)
    nothing = F.from_json(F.lit(None).cast("string"), parse.EXTRACTION)
    no = F.lit(False)
    empty = docs.where(blank).select("doc_id", *_valid(nothing), no.alias("parsed"), no.alias("missing"), no.alias("recovered"), F.lit(None).cast("string").alias("error"))
    out = stored(found.withColumn("empty_input", no).unionByName(empty.withColumn("empty_input", F.lit(True))).withColumn("round", F.lit(0)), "extraction")
    rounds = [out]
    for r in range(1, gleaning + 1):
        named = out.where(F.size("entities") > 0).select("doc_id", F.transform("entities", lambda e: e["name"]).alias("names")).join(docs, "doc_id")
        asked = complete_column(named.withColumn("_p", prompts.gleaning(F.col("text"), F.col("names"))), "_p", model, "gleaning")
        j = F.col("_j")
        more = asked.withColumn("_j", parse.extraction(F.col("answer"))).select("doc_id", *_valid(j)[:2], F.array().cast("array<string>").alias("keywords"), *(F.lit(0).alias(c) for c in LOST), j.isNotNull().alias("parsed"), no.alias("missing"), no.alias("recovered"), "error", no.alias("empty_input"), F.lit(r).alias("round"))
        rounds.append(stored(more, "gleaning"))
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out


def extraction_stats(extracted: DataFrame) -> DataFrame:
    """One row of the thirteen counts over the first reading; all 0 for an empty table."""
    ok = F.col("parsed")
    some = (F.size("entities") > 0) | (F.size("relations") > 0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return extracted.where("round = 0").agg(
        F.count(F.lit(1)).alias("docs_processed"),
        F.count_if(ok).alias("docs_success"),
        F.count_if(~ok & ~F.col("empty_input") & ~F.col("missing")).alias("docs_failed"),
        F.count_if("empty_input").alias("docs_empty_input"),
        F.count_if((ok & ~some) | F.col("missing")).alias("docs_empty_result"),
        F.count_if("recovered").alias("docs_json_recovered"),
        total(F.size("entities")).alias("total_entities"),
        total(F.size("relations")).alias("total_relations"),
        F.count_if(F.size("keywords") > 0).alias("docs_with_keywords"),
        total(F.size("keywords")).alias("total_chunk_keywords"),
        total("rejected_len").alias("chunk_keywords_rejected_len"),
        total("dropped_by_cap").alias("chunk_keywords_dropped_by_cap"),
        F.count_if(F.col("dropped_by_cap") > 0).alias("docs_chunk_keywords_capped"),
    )


def triplets(extracted: DataFrame) -> DataFrame:
    """doc_id, seq, source, target, relation, description; later rounds come after earlier ones."""
    rows = extracted.select("doc_id", "round", F.posexplode("relations").alias("at", "r"))
    return rows.select("doc_id", (F.col("round") * 1_000_000 + F.col("at")).cast("long").alias("seq"), "r.source", "r.target", "r.relation", "r.description")


def mentions(extracted: DataFrame) -> DataFrame:
    """doc_id, seq, name, type, description."""
    rows = extracted.select("doc_id", "round", F.posexplode("entities").alias("at", "e"))
    return rows.select("doc_id", (F.col("round") * 1_000_000 + F.col("at")).cast("long").alias("seq"), "e.name", "e.type", "e.description")


def query_keywords(queries: DataFrame, model: Model, text: str = "query_text") -> DataFrame:
    """query_id, low, high, error, parsed. Equal texts are sent once; a failed call or an answer without keywords gives empty lists."""
    texts = queries.select(F.coalesce(F.col(text), F.lit("")).alias("_t")).distinct()
    asked = stored(complete_column(texts.withColumn("_p", prompts.query_keywords(F.col("_t"))), "_p", model, "query_keywords"), "query-keywords")
    k = parse.query_keywords(F.col("_j"))
    found = asked.withColumn("_j", parse.query_levels(F.col("answer"))).select("_t", k["low"].alias("low"), k["high"].alias("high"), "error", F.col("_j").isNotNull().alias("parsed"))
    return queries.select("query_id", F.coalesce(F.col(text), F.lit("")).alias("_t")).join(found, "_t").drop("_t")


def synthesized_descriptions(nodes: DataFrame, mentions_: DataFrame, model: Model, longer_than: int) -> DataFrame:
    """``nodes`` (name, description, ...) with the model's description where several were merged to more than ``longer_than``
    characters; kept as they were where the call fails or answers with five characters or fewer."""
    from ..functions.text import entity_name

    some = mentions_.withColumn("name", entity_name(F.col("name"))).where("coalesce(description, '') <> ''")
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("doc_id", "seq"))).where("_r <= 10")  # the prompt shows ten
    listed = ranked.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("_r", "description"))).alias("_d")).where("size(_d) > 1")
    long = nodes.where(F.length("description") > longer_than).select("name").join(listed, "name")
    asked = complete_column(long.select("name", prompts.description(F.col("name"), F.transform("_d", lambda d: d["description"])).alias("_p")), "_p", model, "description_synthesis")
    new = stored(asked.select("name", F.trim("answer").alias("_new")).where(F.length("_new") > 5), "descriptions")
    return nodes.join(new, "name", "left").withColumn("description", F.coalesce("_new", "description")).drop("_new")
