"""Queries over datasets, retrievers, models and whole runs, made of the driver's tables, with equivalent SQL.

Files that a query needs (datasets, collections, graphs, reports) are written to the shared folder first, then read back by the library.
Models and embedders are those that need no network and that SQL can follow.
"""

from __future__ import annotations

import io
import json
import os
import tempfile
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, metrics, ranking
from ..sources import datasets
from . import evaluation, extraction, logs, prompts, providers, retrieval, run
from .queries import _MENTIONS, _NORM, _TRIPLETS, mentions, triplets
from .registry import query
from .registry import table as t
from .storage import forget, scratch, stored

# --- datasets ------------------------------------------------------------------------------------------------------


def dataset(spark: SparkSession, d: str) -> str:
    """A dataset in the layout that ``load_dataset`` reads: the items as queries, the documents as corpus, who holds an item as judgements."""
    root = scratch(spark, "datasets")
    items = t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text", F.substring("text", 1, 20).alias("answer"), F.lit("bridge").alias("type"))
    items.write.parquet(f"{root}/hotpotqa/queries.parquet")
    t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("title"), "text").write.parquet(f"{root}/hotpotqa/corpus.parquet")
    held = ranking.containing(t(spark, d, "documents").withColumn("doc_id", F.col("doc_id").cast("string")), items.select("query_id", "text"))
    held.write.parquet(f"{root}/hotpotqa/qrels.parquet")
    datasets.write_text(spark, f"{root}/hotpotqa/metadata.json", json.dumps({"name": "hotpotqa"}))
    return root


@query("SELECT item_id::VARCHAR AS query_id, text AS query_text, nullif(substr(text, 1, 20), '') AS expected_answer, CASE WHEN substr(text, 1, 20) <> '' THEN 'text' END AS answer_type, 'bridge' AS question_type, '' AS level FROM benchmark")
def loaded_queries(spark, d):
    return datasets.load_dataset(spark, dataset(spark, d), "hotpotqa").queries


@query("SELECT doc_id::VARCHAR AS doc_id, '' AS title, coalesce(text, '') AS content FROM documents")
def loaded_corpus(spark, d):
    return datasets.load_dataset(spark, dataset(spark, d), "hotpotqa").corpus


@query("SELECT item_id::VARCHAR AS query_id, d.doc_id::VARCHAR AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def cached_judgements(spark, d):
    """Loaded, saved as cache, and loaded from there: the dataset itself is not looked for again."""
    cache = scratch(spark, "cache")
    datasets.save_cache(datasets.load_dataset(spark, dataset(spark, d), "hotpotqa"), cache, "hotpotqa")
    return datasets.load_dataset(spark, "file:///nowhere", "hotpotqa", cache).qrels


@query("SELECT * FROM (VALUES ('hotpotqa', 'loaded', false), ('none', 'error', true)) v(name, status, told)")
def dataset_statuses(spark, d):
    root = dataset(spark, d)
    found = [(n, datasets.load_dataset(spark, root, n)) for n in ("hotpotqa", "none")]
    return spark.createDataFrame([(n, x.status, x.error is not None) for n, x in found], "name string, status string, told boolean")


@query("SELECT * FROM (VALUES ('object', true, 2), ('list', false, 0), ('broken', false, 0), ('missing', false, 0)) v(name, found, n_keys)")
def json_objects(spark, d):
    root = scratch(spark, "json")
    for name, text in (("object", '{"a": 1,\n "b": [2]}'), ("list", "[1]"), ("broken", '{"a"')):
        datasets.write_text(spark, f"{root}/{name}.json", text)
    read = [(n, datasets.read_json(spark, f"{root}/{n}.json")) for n in ("object", "list", "broken", "missing")]
    return spark.createDataFrame([(n, x is not None, len(x or {})) for n, x in read], "name string, found boolean, n_keys int")


@query("SELECT * FROM (VALUES ('written', true), ('missing', false)) v(name, found)")
def storage_probe(spark, d):
    root = scratch(spark, "probe")
    t(spark, d, "region").write.parquet(f"{root}/written")
    return spark.createDataFrame([(n, datasets.exists(spark, f"{root}/{n}")) for n in ("written", "missing")], "name string, found boolean")


def _chunks(spark, d) -> DataFrame:
    docs = t(spark, d, "documents").where("coalesce(text, '') <> ''")
    return docs.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.lit("col").alias("collection_id"), "text", F.col("source").alias("source_file"), F.col("n_chars").cast("double").alias("token_count"))


@query("SELECT 'c' || doc_id AS chunk_id, 'col' AS collection_id, text, '' AS document_id, coalesce(source, '') AS source_file, NULL::INT AS chunk_index, NULL::INT AS page_start, NULL::INT AS page_end, n_chars::INT AS token_count FROM documents WHERE coalesce(text, '') <> ''")
def collection_rows(spark, d):
    root = scratch(spark, "collections")
    datasets.write_collection(_chunks(spark, d), root, "col", 1_000_000)
    return datasets.load_collection(spark, root, "col")


@query("SELECT 'c' || doc_id AS chunk_id, text FROM documents WHERE coalesce(text, '') <> ''")
def archived_collection(spark, d):
    """Exported to an archive, imported elsewhere, and read there."""
    root = scratch(spark, "archived")
    datasets.write_collection(_chunks(spark, d), f"{root}/a", "col", 1_000_000)
    with tempfile.TemporaryDirectory() as held:  # an archive is one file of the driver's
        datasets.export_collection(spark, f"{root}/a", "col", f"{held}/col.tgz")
        datasets.import_collection(spark, f"{held}/col.tgz", f"{root}/b", "col")
    return datasets.load_collection(spark, f"{root}/b", "col").select("chunk_id", "text")


_BREAKS = {
    "none": {}, "rows": {"num_chunks": 6}, "other": {"collection_id": "x"}, "no parts": {"parts": []}, "no cap": {"max_chunk_chars": 0}, "too long": {"max_chunk_chars": 3},
    "lost part": {"parts": [{"path": "parts/none", "num_rows": 1}]}, "bare part": {"parts": [{"path": "x"}]}, "no version": {"schema_version": None}, "short": {"max_chunk_chars": 10},
}


@query(f"SELECT name, name NOT IN ('none', 'short') AS refused FROM (SELECT unnest({list(_BREAKS)}) AS name)")
def collection_refusals(spark, d):
    root = scratch(spark, "refused")
    rows = t(spark, d, "region").select(F.concat(F.lit("c"), "r_regionkey").alias("chunk_id"), F.lit("col").alias("collection_id"), F.lit("a text").alias("text"))
    good, out = datasets.write_collection(rows, root, "col", 100), []
    for name, change in _BREAKS.items():
        datasets.write_text(spark, f"{root}/col/collection.json", json.dumps({k: v for k, v in (good | change).items() if v is not None}))
        try:
            datasets.load_collection(spark, root, "col")
            out.append((name, False))
        except datasets.ContractError:
            out.append((name, True))
    return spark.createDataFrame(out, "name string, refused boolean")


@query("SELECT cap, cap > 3000 AS refused FROM (SELECT unnest([1, 2999, 3000, 3001, 5000]) AS cap)")
def index_readiness(spark, d):
    def refused(cap: int) -> bool:
        try:
            datasets.index_ready({"max_chunk_chars": cap}, 3000)
        except datasets.ContractError:
            return True
        return False

    return spark.createDataFrame([(c, refused(c)) for c in (1, 2999, 3000, 3001, 5000)], "cap int, refused boolean")


@query("""
WITH r AS (SELECT sha256(doc_id::VARCHAR) AS k, sha256(concat_ws('‖', doc_id::VARCHAR, text)) AS h FROM documents),
p AS (SELECT substr(k, 1, 3) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM r GROUP BY 1)
SELECT substr(sha256(string_agg(h, '' ORDER BY p, h) || 'n=' || sum(n) || 'mtc=3000me=100000'), 1, 16) AS fingerprint FROM p
""")
def corpus_fingerprint(spark, d):
    corpus = t(spark, d, "documents").select("doc_id", F.col("text").alias("content"))
    return spark.createDataFrame([(datasets.fingerprint(corpus, 3000, 100_000),)], "fingerprint string")


@query(f"WITH {_TRIPLETS} SELECT lo, hi, relation, doc_id, seq FROM rel")
def stored_graph(spark, d):
    path = scratch(spark, "graph")
    datasets.save_graph({"relations": graph.edge_relations(triplets(spark, d))}, path, "print")
    return datasets.load_graph(spark, path)["relations"].select("lo", "hi", "relation", "doc_id", "seq")


@query("SELECT * FROM (VALUES (2, false), (3, true), (4, true)) v(version, loaded)")
def graph_versions(spark, d):
    path = scratch(spark, "graph")
    datasets.save_graph({"nodes": t(spark, d, "region")}, path)
    header, out = datasets.read_json(spark, f"{path}/kg.json"), []
    for v in (2, 3, 4):
        datasets.write_text(spark, f"{path}/kg.json", json.dumps(header | {"version": v}))
        out.append((v, datasets.load_graph(spark, path) is not None))
    return spark.createDataFrame(out, "version int, loaded boolean")


@query(f"WITH {_TRIPLETS} SELECT source, target, r.relation, description, r.doc_id, weight FROM (SELECT lo AS source, hi AS target, relation, doc_id, min(seq) AS seq, arg_min(description, seq) AS description FROM (SELECT source AS lo, target AS hi, relation, doc_id, seq, description FROM tr) GROUP BY ALL) r JOIN edge e ON e.lo = r.source AND e.hi = r.target")
def exported_graph(spark, d):
    path = scratch(spark, "export")
    relations = graph.weighted_relations(graph.edge_relations(triplets(spark, d)))
    nodes = t(spark, d, "part").select(F.concat(F.lit("part-"), "p_partkey").alias("name"), F.lit("CONCEPT").alias("type"), F.lit("").alias("description"))
    datasets.export_graph({"nodes": nodes, "relations": relations}, path)
    return spark.read.parquet(f"{path}/kg_edges")


@query("SELECT * FROM (VALUES ('dataset', '\"hotpotqa\"'), ('avg_mrr', '0.5'), ('config', '{\"api_key\": \"***\", \"retrieval_k\": 20}')) v(key, value)")
def report_file(spark, d):
    path = f"{scratch(spark, 'report')}/report.json"
    datasets.write_report(spark, path, {"dataset": "hotpotqa", "avg_mrr": 0.5, "config": {"api_key": "abc", "retrieval_k": 20}})
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in datasets.read_json(spark, path).items()], "key string, value string")


@query("SELECT 'region_read' AS event, r_name AS name, r_regionkey::BIGINT AS n FROM region")
def structured_log(spark, d):
    """Events as JSON lines: written by the logger, read as rows. The rows are the five regions."""
    held = io.StringIO()
    with logs.configured("jsonl", stream=held):
        for r in t(spark, d, "region").collect():
            logs.event("region_read", name=r["r_name"], n=r["r_regionkey"])
    lines = spark.createDataFrame([(x,) for x in held.getvalue().splitlines()], "line string")
    return lines.select(F.from_json("line", "event string, ts string, name string, n long").alias("e")).where("e.ts IS NOT NULL").select("e.event", "e.name", "e.n")


@query("SELECT r_name AS line FROM region")
def console_copy(spark, d):
    """What goes to the console while it is copied."""
    with tempfile.TemporaryDirectory() as folder:
        names = [r["r_name"] for r in t(spark, d, "region").collect()]  # five rows
        with open(os.devnull, "w") as quiet, logs.console_copied(f"{folder}/console.txt", quiet, quiet):
            for n in names:
                print(n)
        with open(f"{folder}/console.txt", encoding="utf-8") as f:
            return spark.createDataFrame([(x,) for x in f.read().splitlines()], "line string")


# --- settings, names, prompts --------------------------------------------------------------------------------------

_SPELT = ["hotpotqa", "HotpotQA", "hotpot-qa", "HOT_POT_QA", "fever", ""]


@query(f"SELECT name, CASE WHEN k THEN 'HYBRID' ELSE 'RETRIEVAL_ONLY' END AS kind, CASE WHEN k THEN 'f1_score' ELSE 'faithfulness' END AS metric, CASE WHEN k THEN 'exact_match,faithfulness' ELSE 'answer_relevance' END AS secondary FROM (SELECT name, replace(replace(lower(name), '-', ''), '_', '') = 'hotpotqa' AS k FROM (SELECT unnest({_SPELT}) AS name))")
def dataset_kinds(spark, d):
    found = [(n, datasets.dataset_config(n)) for n in _SPELT]
    return spark.createDataFrame([(n, c["type"], c["primary"], ",".join(c["secondary"])) for n, c in found], "name string, kind string, metric string, secondary string")


_WINDOWS = [(0, None), (0, 100), (0, 1024), (0, 1025), (0, 8192), (9, 8192), (70_000, None)]


@query(f"SELECT override, tokens, CASE WHEN override > 0 THEN override WHEN coalesce(tokens, 0) > 1024 THEN (tokens - 1024) * 4 ELSE 4000 END AS chars FROM (VALUES {', '.join(f'({a}, {b or "NULL::INT"})' for a, b in _WINDOWS)}) v(override, tokens)")
def context_limits(spark, d):
    return spark.createDataFrame([(a, b, evaluation.context_chars(a, b)) for a, b in _WINDOWS], "override int, tokens int, chars int")


@query("SELECT * FROM (VALUES ('strategy', 'LIGHT_RAG'), ('retrieval_k', '7'), ('max_queries', '50'), ('dev_mode', 'True'), ('mode', 'hybrid'), ('max_context_chars', '4000'), ('judge_threshold', '0.02'), ('rerank_top_n', '0'), ('dataset_type', 'HYBRID'), ('faults', 'retrieval_k must be positive;LLM_BASE_URL is not set')) v(name, value)")
def settings(spark, d):
    env = {"RETRIEVAL_STRATEGY": "LIGHT_RAG", "RETRIEVAL_K": "7", "EVAL_MAX_QUERIES": "many", "DEV_MODE": "true", "LIGHTRAG_MODE": "odd", "RERANKER_TOP_N": "5"}
    c = run.config_from(env)
    held = asdict(c) | {"mode": c.graph.mode}
    wrong = [x for x in run.faults({}, run.config_from(env | {"RETRIEVAL_K": "0"})) if x.startswith(("retrieval_k", "LLM_BASE"))]
    names = ("strategy", "retrieval_k", "max_queries", "dev_mode", "mode", "max_context_chars", "judge_threshold", "rerank_top_n", "dataset_type")
    return spark.createDataFrame([*((n, str(held[n])) for n in names), ("faults", ";".join(sorted(wrong, reverse=True)))], "name string, value string")


_LINE = "' || chr(10) || chr(10) || '"


@query(f"""
SELECT doc_id, md5('Answer the question from the context, in as few words as possible; keep [ref:N] marks.{_LINE}CONTEXT:' || chr(10) || coalesce(text, '') || chr(10) || chr(10) || 'QUESTION: ' || source || chr(10) || chr(10) || 'ANSWER:') AS generation,
  md5('[DOC 1 id="' || doc_id || '"]' || chr(10) || text || chr(10) || '[/DOC 1]') AS block,
  md5('A first reading of this text missed entities and relations. List only those that it did not find.{_LINE}Found before: ' || lang || ', ' || source) AS gleaning_head
FROM documents
""")
def prompt_texts(spark, d):
    docs = t(spark, d, "documents")
    head = F.concat_ws("\n\n", F.slice(F.split(prompts.gleaning(F.lit(""), F.array("lang", "source")), "\n\n"), 1, 2))
    return docs.select("doc_id", F.md5(prompts.generation(F.col("source"), F.col("text"), True)).alias("generation"), F.md5(prompts.document_block(F.lit("1"), F.col("doc_id").cast("string"), F.col("text"))).alias("block"), F.md5(head).alias("gleaning_head"))


_FAITH, _RELEVANT = (len(f"{x}\n\n{prompts._SCORE}\n\n\n\n") for x in ("Score how far the context supports the answer.", "Score how far the answer addresses the question."))


@query(f"SELECT doc_id, CASE WHEN text <> '' AND lang <> 'de' THEN {_FAITH} + length(source) + least(2000, length(text)) END::INT AS faithfulness, CASE WHEN text <> '' AND source <> '' THEN {_RELEVANT} + length(source) + least(2000, length(text)) END::INT AS relevance FROM documents")
def judged_prompts(spark, d):
    """Lengths of what a judge is asked: answers are cut, contexts are not; without an answer or a context nothing is asked."""
    docs = t(spark, d, "documents")
    context = F.when(F.col("lang") != "de", F.col("source"))
    return docs.select("doc_id", F.length(prompts.faithfulness(F.col("text"), context)).alias("faithfulness"), F.length(prompts.answer_relevance(F.col("text"), F.col("source"))).alias("relevance"))


# --- metrics -------------------------------------------------------------------------------------------------------

_BARE = f"array_to_string(list_filter(string_split({_NORM}, ' '), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"


@query(f"SELECT doc_id, (coalesce(text, '') <> '' AND {_BARE.format('text')} = {_BARE.format('x')})::INT::DOUBLE AS exact FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'The ' || text || '!' ELSE text || ' more' END AS x FROM documents WHERE lang = 'en')")
def exact_matches(spark, d):
    docs = t(spark, d, "documents").where("lang = 'en'")
    other = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("The "), "text", F.lit("!"))).otherwise(F.concat("text", F.lit(" more")))
    return docs.select("doc_id", metrics.exact_match(F.col("text"), other).alias("exact"))


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 0.0 ELSE 1.0 END::DOUBLE AS accuracy, lang IN ('en', 'fr') AS valid FROM documents")
def accuracy_labels(spark, d):
    """Labels equal but for case and signs; which labels are known changes nothing about it."""
    said = F.concat(F.upper("lang"), F.when(F.col("lang") == "de", "x").otherwise("!"))
    return t(spark, d, "documents").select("doc_id", metrics.accuracy(said, F.col("lang")).alias("accuracy"), metrics.valid_label(F.col("lang"), ["En.", "FR"]).alias("valid"))


@query("""
WITH r AS (SELECT l_orderkey AS query_id, l_partkey AS id, l_linenumber AS rank FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) = 1),
e AS (SELECT DISTINCT l_orderkey AS query_id, l_partkey AS id FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT query_id, count(*) AS n FROM e GROUP BY 1),
h AS (SELECT query_id, count(*) AS h FROM (SELECT DISTINCT query_id, id FROM r WHERE rank <= 3) JOIN e USING (query_id, id) GROUP BY 1)
SELECT n.query_id, (coalesce(h, 0) > 0)::INT::DOUBLE AS generation_hit, coalesce(h, 0) / n::DOUBLE AS generation_recall FROM n LEFT JOIN h USING (query_id)
""")
def generation_scores(spark, d):
    line = t(spark, d, "lineitem")
    rows = ranking.keep_first(line.select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("rank")), ["query_id", "id"], ["rank"])
    relevant = line.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("id"))
    return metrics.generation_metrics(rows.where("rank <= 3"), relevant)


@query("SELECT * FROM (VALUES (false, false, 'exact_match,f1_score,accuracy'), (false, true, 'exact_match,f1_score,accuracy,semantic_similarity'), (true, false, 'exact_match,f1_score,accuracy,faithfulness,answer_relevance'), (true, true, 'exact_match,f1_score,accuracy,semantic_similarity,faithfulness,answer_relevance')) v(model, embedder, metrics)")
def available_metrics(spark, d):
    rows = [(m, e, ",".join(k for k, v in metrics.available_metrics(m, e).items() if v)) for m in (False, True) for e in (False, True)]
    return spark.createDataFrame(rows, "model boolean, embedder boolean, metrics string")


@query("""
SELECT doc_id, m AS metric, CASE WHEN m IN ('faithfulness', 'unknown') OR m = 'f1_score' AND lang = 'de' THEN 0.0 ELSE 0.5 END::DOUBLE AS value,
  CASE WHEN m = 'faithfulness' THEN 'faithfulness needs a model' WHEN m = 'unknown' THEN 'unknown needs a known name' WHEN m = 'f1_score' AND lang = 'de' THEN 'f1_score needs an expected answer' END AS error
FROM documents, (SELECT unnest(['f1_score', 'semantic_similarity', 'faithfulness', 'unknown']) AS m) WHERE m <> 'semantic_similarity' OR lang <> 'de'
""")
def calculated_metrics(spark, d):
    """What a metric lacks is an error of value 0."""
    expected = F.when(F.col("lang") != "de", F.col("text"))
    scores = dict.fromkeys(["f1_score", "semantic_similarity", "faithfulness"], F.lit(0.5))
    names = ["f1_score", "semantic_similarity", "faithfulness", "unknown"]
    each = F.array(*(F.struct(F.lit(n).alias("metric"), metrics.calculated(n, False, True, scores, expected, F.col("text"), F.col("text")).alias("r")) for n in names))
    rows = t(spark, d, "documents").where("text <> ''").select("doc_id", "lang", F.explode(each).alias("m")).select("doc_id", "lang", "m.metric", "m.r.value", "m.r.error")
    return rows.where("metric <> 'semantic_similarity' OR lang <> 'de'").drop("lang")


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'faithfulness' WHEN length(text) > 1000 THEN 'exact_match,faithfulness' ELSE 'f1_score,exact_match,faithfulness' END AS secondary FROM documents WHERE text <> ''")
def secondary_metrics(spark, d):
    """Beside F1 or accuracy: F1 and exact match where there is an answer, then what the dataset configures; none twice."""
    expected = F.when(F.col("lang") != "de", F.col("text"))
    primary = F.when(F.length("text") > 1000, "f1_score").otherwise("accuracy")
    named = [F.when(on, F.lit(n)) for n, on in metrics.secondary_metrics("HYBRID", primary, expected, ["faithfulness"])]
    return t(spark, d, "documents").where("text <> ''").select("doc_id", F.concat_ws(",", *named).alias("secondary"))


_GUARDS = [("faithfulness", 0.03, 0.02), ("faithfulness", 0.02, 0.02), ("faithfulness", 0.9, 0.0), (None, 0.0, 0.02), ("answer_relevance", 0.5, 0.4)]


@query(f"SELECT metric, rate, threshold, metric IS NOT NULL AND threshold > 0 AND rate > threshold AS failed FROM (VALUES {', '.join(f'({repr(m) if m else "NULL"}, {r}::DOUBLE, {x}::DOUBLE)' for m, r, x in _GUARDS)}) v(metric, rate, threshold)")
def judge_guard(spark, d):
    def failed(metric, rate, threshold) -> bool:
        try:
            evaluation.guard({"worst_judge_metric": metric, "worst_judge_rate": rate}, threshold)
        except evaluation.JudgeGuard:
            return True
        return False

    return spark.createDataFrame([(*g, failed(*g)) for g in _GUARDS], "metric string, rate double, threshold double, failed boolean")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN event_type = 'error' THEN CASE WHEN (props->>'k')::INT > 50 THEN 'ValueError: no such thing' ELSE 'TimeoutError: TimeoutError()' END END AS error_message FROM events")
def run_statuses(spark, d):
    far = F.get_json_object("props", "$.k").cast("int") > 50
    said = evaluation.failure_text(F.when(far, "ValueError").otherwise("TimeoutError"), F.when(far, "no such thing").otherwise(""))
    rows = t(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", said).alias("failure"))
    return evaluation.assembled(rows)


# --- reports of queries --------------------------------------------------------------------------------------------


@query("""
SELECT event_id, CASE WHEN event_type = 'view' THEN '{' ELSE '{"kg_fallback":"' || event_type || '",' END || '"lightrag_mode":"hybrid","graph_active":' || (event_type <> 'error') || ',"kg_entities_count":' || CASE WHEN event_type = 'click' THEN 0 ELSE 2 END || '}' AS told FROM events
""")
def retrieval_metadata(spark, d):
    """What may be told of a retrieval: known columns only, lists by their sizes, nulls left out."""
    kind = F.col("event_type")
    rows = t(spark, d, "events").select("event_id", F.when(kind != "view", kind).alias("kg_fallback"), F.lit("hybrid").alias("lightrag_mode"), (kind != "error").alias("graph_active"), F.when(kind != "click", F.array(kind, F.lit("x"))).alias("kg_entities"), F.lit("s3cret").alias("api_key"))
    return rows.select("event_id", F.to_json(datasets.retrieval_metadata(rows.columns)).alias("told"))


@query("""
SELECT event_id::VARCHAR AS query_id, event_type = 'click' AS has_generation, event_type = 'view' AS has_metadata, event_type = 'error' AS has_retrieval_metadata, round_even(value / 7, 4) AS mrr, round_even(value / 3, 4) AS f1, CASE WHEN event_type = 'click' THEN round_even(value / 9, 4) END AS generation_recall FROM events
""")
def query_reports(spark, d):
    kind, v = F.col("event_type"), F.col("value")
    rows = t(spark, d, "events").select(
        F.col("event_id").cast("string").alias("query_id"), (v / 7).alias("mrr"), F.create_map(F.lit("f1_score"), v / 3).alias("secondary_metrics"), F.when(kind == "click", F.array(F.lit("a"))).alias("generation_doc_ids"), (v / 9).alias("generation_recall"),
        F.when(kind == "view", F.lit(True)).alias("reranked"), F.when(kind == "error", F.lit("no_keywords")).alias("kg_fallback"), F.lit("completed").alias("status"),
    )
    told = datasets.query_reports(rows)
    at = lambda path: F.get_json_object("report", path)
    return told.select("query_id", at("$.generation_doc_ids").isNotNull().alias("has_generation"), at("$.metadata").isNotNull().alias("has_metadata"), at("$.retrieval_metadata").isNotNull().alias("has_retrieval_metadata"), at("$.mrr").cast("double").alias("mrr"), at("$.secondary_metrics.f1_score").cast("double").alias("f1"), at("$.generation_recall").cast("double").alias("generation_recall"))


# --- models --------------------------------------------------------------------------------------------------------


@query("""
WITH n AS (SELECT p_partkey, p_size % 3 = 0 AS twice, p_name, p_brand, p_type FROM part)
SELECT p_partkey, 'doc-' || p_partkey AS doc_id, CASE WHEN twice THEN p_type ELSE p_name END AS entity FROM n UNION ALL SELECT p_partkey, 'x' AS doc_id, p_brand FROM n
""")
def batch_answers(spark, d):
    """Entries of answers over several documents: one without an id is skipped, of equal ids the last counts."""
    entry = lambda i, name: F.concat(F.lit('{"doc_id": "'), i, F.lit('", "entities": [{"name": "'), name, F.lit('"}]}'))
    own = F.concat(F.lit("doc-"), "p_partkey")
    parts = [entry(own, F.col("p_name")), entry(F.lit(""), F.lit("nobody")), entry(F.lit("x"), F.col("p_brand")), F.when(F.col("p_size") % 3 == 0, entry(own, F.col("p_type")))]
    said = F.concat(F.lit('Sure:\n{"documents": ['), F.concat_ws(", ", *parts), F.lit("]}"))
    found = extraction.batch_entries(t(spark, d, "part").select("p_partkey", said.alias("answer")), ["p_partkey"])
    return found.select("p_partkey", "doc_id", F.col("d.entities")[0]["name"].alias("entity"))


#: Customers as documents: two names and three themes each; one in eleven is empty.
_PEOPLE = "p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'Person' || c_custkey || ' likes some Segment' || c_nationkey || ' goods' END AS content FROM customer)"


def _people(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    said = F.concat(F.lit("Person"), k, F.lit(" likes some Segment"), "c_nationkey", F.lit(" goods"))
    return t(spark, d, "customer").select(k.cast("string").alias("doc_id"), F.when(k % 11 == 0, "").otherwise(said).alias("content"))


_COUNTS = "SELECT count(*) AS docs_processed, count(*) FILTER (content <> '') AS docs_success, 0::BIGINT AS docs_failed, count(*) FILTER (content = '') AS docs_empty_input, 0::BIGINT AS docs_empty_result, 0::BIGINT AS docs_json_recovered, 2 * count(*) FILTER (content <> '') AS total_entities, count(*) FILTER (content <> '') AS total_relations, count(*) FILTER (content <> '') AS docs_with_keywords, 3 * count(*) FILTER (content <> '') AS total_chunk_keywords, 0::BIGINT AS chunk_keywords_rejected_len, 0::BIGINT AS chunk_keywords_dropped_by_cap, 0::BIGINT AS docs_chunk_keywords_capped FROM p"


@query(f"WITH {_PEOPLE} {_COUNTS}")
def extraction_counters(spark, d):
    return extraction.extraction_stats(extraction.extract(_people(spark, d), providers.WordModel(), 5))


@query(f"""WITH {_PEOPLE} SELECT k::VARCHAR AS doc_id, r AS round, CASE WHEN content <> '' AND r = 0 THEN split_part(content, ' ', 1) || ',' || split_part(content, ' ', 4) ELSE '' END AS entities, CASE WHEN content <> '' AND r = 0 THEN 'likes,some,goods' ELSE '' END AS keywords, content <> '' AND r = 0 AS parsed
FROM p, (SELECT unnest([0, 1]) AS r) WHERE r = 0 OR content <> ''""")
def extracted_documents(spark, d):
    """One document a call, and one round of gleaning, which finds nothing more."""
    found = extraction.extract(_people(spark, d), providers.WordModel(), 1, gleaning=1)
    return found.select("doc_id", "round", F.array_join(F.transform("entities", lambda e: e["name"]), ",").alias("entities"), F.array_join("keywords", ",").alias("keywords"), "parsed")


@query("SELECT count(*) FILTER (m <> 1) AS docs_success, count(*) FILTER (m = 1) AS docs_failed, 0::BIGINT AS docs_empty_result, count(*) FILTER (m = 2) AS docs_json_recovered, count(*) FILTER (m <> 1) AS total_entities, 2 * count(*) FILTER (m <> 1) AS chunk_keywords_rejected_len, 3 * count(*) FILTER (m <> 1) AS chunk_keywords_dropped_by_cap, count(*) FILTER (m <> 1) AS docs_chunk_keywords_capped FROM (SELECT CASE WHEN s_suppkey % 5 = 1 THEN 1 WHEN s_suppkey % 5 = 2 THEN 2 ELSE 0 END AS m FROM supplier)")
def extraction_losses(spark, d):
    """Answers that cannot be read, that hide their JSON, and whose keywords are too short, too long or too many."""
    docs = t(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), F.concat(F.lit("case "), F.col("s_suppkey") % 5).alias("content"))
    stats = extraction.extraction_stats(extraction.extract(docs, providers.CaseModel(), 1))
    return stats.select("docs_success", "docs_failed", "docs_empty_result", "docs_json_recovered", "total_entities", "chunk_keywords_rejected_len", "chunk_keywords_dropped_by_cap", "docs_chunk_keywords_capped")


@query("WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM benchmark) SELECT item_id AS query_id, array_to_string(list_filter(w, lambda x: regexp_matches(x, '^\\p{Lu}'))[1:20], ' ') AS low, array_to_string(list_filter(w, lambda x: NOT regexp_matches(x, '^\\p{Lu}'))[1:20], ' ') AS high FROM w")
def keyword_extraction(spark, d):
    """Keywords of queries as a model names them: equal texts are asked once, twenty of each kind count."""
    items = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    found = extraction.query_keywords(items.unionAll(items), providers.WordModel())
    return found.distinct().select("query_id", F.array_join("low", " ").alias("low"), F.array_join("high", " ").alias("high"))


@query("SELECT item_id AS query_id, CASE WHEN item_id % 4 <= 1 THEN 'the context' ELSE substr(trim(split_part(text, chr(10), 1)), 1, 40) END AS narrative, CASE WHEN item_id % 4 = 0 THEN 'empty' END AS synthesis_error, item_id % 4 > 1 AND length(trim(split_part(text, chr(10), 1))) > 40 AS truncated FROM benchmark")
def synthesized_contexts(spark, d):
    """Narratives in place of contexts: cut where too long, left as they were where the model says nothing or is not asked."""
    k = F.col("item_id") % 4
    rows = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(k == 0, "").otherwise(F.col("text")).alias("query_text"), F.lit("the context").alias("context"), (k != 1).alias("wanted"))
    told = evaluation.synthesized(rows, providers.LengthModel(), 40, 60.0, "wanted")
    return told.select("query_id", "narrative", "synthesis_error", "truncated")


@query(f"""
WITH {_TRIPLETS}, {_MENTIONS}, once AS (SELECT DISTINCT name, lower(description) AS k FROM men), n AS (SELECT name, count(*) AS told FROM men GROUP BY 1),
d AS (SELECT name, max(length(k)) AS longest, sum(length(k)) + 3 * (count(*) - 1) AS chars, count(*) AS n FROM (SELECT name, k FROM once QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(k) DESC, k) <= 5) GROUP BY 1)
SELECT name, told > 1 AND chars > 40 AS merged FROM d JOIN n USING (name)
""")
def kg_model_descriptions(spark, d):
    """Which entities get one description of the model's for several long ones."""
    told = mentions(spark, d)
    nodes = graph.entities(told)
    merged = extraction.synthesized_descriptions(nodes, told, providers.LengthModel(), 40)
    return merged.select("name", F.col("description").startswith("Merge these descriptions of ").alias("merged"))


@query("""
WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS rank, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, length('x' || l_partkey) AS s, l_orderkey % 3 = 0 AS bad FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey ORDER BY l_quantity) = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN bad THEN 0 ELSE -s END, rank, id) AS new_rank FROM r)
SELECT query_id, id, CAST(new_rank AS INTEGER) AS new_rank, NOT bad AS reranked, CASE WHEN bad THEN 'ValueError: no question' END AS rerank_error FROM n WHERE new_rank <= 2
""")
def rerank_fallbacks(spark, d):
    """One request a query; where it fails, the list stays in its order, cut, and says so."""
    line = ranking.keep_first(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity"])
    rows = line.select(F.col("l_orderkey").alias("query_id"), "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.concat(F.lit("x"), "l_partkey").alias("content"), F.when(F.col("l_orderkey") % 3 == 0, "").otherwise("asked").alias("query_text"))
    rows = stored(rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("l_linenumber", "id"))), "rerank-rows")
    out = ranking.rerank(rows, providers.rerank_scores(rows, providers.LengthReranker()), 2)
    return out.select("query_id", "id", "new_rank", "reranked", "rerank_error")


# --- the graph -----------------------------------------------------------------------------------------------------


@query(f"WITH {_TRIPLETS} SELECT rel.lo, rel.hi, relation, doc_id, weight FROM rel JOIN edge USING (lo, hi)")
def kg_weighted_relations(spark, d):
    return graph.weighted_relations(graph.edge_relations(triplets(spark, d))).select("lo", "hi", "relation", "doc_id", "weight")


@query("WITH e AS (SELECT DISTINCT least(lower(c_mktsegment), x) AS lo, greatest(lower(c_mktsegment), x) AS hi FROM (SELECT c_mktsegment, CASE WHEN c_nationkey % 5 = 0 THEN lower(c_mktsegment) ELSE 'nation-' || c_nationkey END AS x FROM customer)) SELECT node, count(*) AS degree FROM (SELECT lo AS node FROM e UNION ALL SELECT hi FROM e) GROUP BY 1")
def kg_loops(spark, d):
    """Relations of an entity with itself are edges, and count twice in its degree."""
    own = F.col("c_nationkey") % 5 == 0
    rows = t(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("seq"), F.col("c_mktsegment").alias("source"), F.when(own, F.upper("c_mktsegment")).otherwise(F.concat(F.lit("Nation-"), "c_nationkey")).alias("target"), F.lit("in").alias("relation"), F.lit("").alias("description"))
    return graph.degrees(graph.edges(graph.edge_relations(rows)))


@query("SELECT p_partkey, p_partkey % 2 = 0 AS known, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS type FROM part")
def kg_lookup(spark, d):
    """Entities by their names as spelt anywhere."""
    part = t(spark, d, "part")
    nodes = part.where("p_partkey % 2 = 0").select(F.concat(F.lit("part-"), "p_partkey").alias("name"), F.col("p_type").alias("type"))
    found = graph.lookup(nodes, part.select("p_partkey", F.concat(F.lit("  The PART-"), "p_partkey", F.lit("!")).alias("asked")), "asked")
    return found.select("p_partkey", F.col("node").isNotNull().alias("known"), "type")


@query(f"WITH {_TRIPLETS} SELECT doc_id, seq, source AS name FROM tr WHERE regexp_extract(source, '[0-9]+')::INT <= 500")
def kg_known_mentions(spark, d):
    """What is told of names that the graph does not hold is ignored."""
    tr = triplets(spark, d)
    held = t(spark, d, "part").where("p_partkey <= 500").select(F.concat(F.lit("part-"), "p_partkey").alias("name"))
    told = graph.known_mentions(tr.select("doc_id", "seq", F.col("source").alias("name")), held)
    return told.select("doc_id", "seq", F.regexp_replace(F.lower("name"), "^the ", "").alias("name"))


@query("SELECT p_name || '/' || p_partkey AS name, CASE WHEN p_size > 25 THEN p_name || '/' || p_partkey || ': ' || p_type ELSE p_name || '/' || p_partkey END AS t FROM part")
def kg_entity_texts(spark, d):
    name = F.concat_ws("/", "p_name", "p_partkey")
    return retrieval.entity_texts(t(spark, d, "part").select(name.alias("name"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise("").alias("description")))


@query(f"WITH {_TRIPLETS} SELECT lo || ' -> ' || r.relation || ' -> ' || hi AS key, lo || ' -> ' || r.relation || ' -> ' || hi || ': ' || arg_min(description, (doc_id, seq)) AS description, weight FROM (SELECT source AS lo, target AS hi, relation, doc_id, seq, description FROM tr) r JOIN edge USING (lo, hi) GROUP BY lo, hi, r.relation, weight")
def kg_relation_texts(spark, d):
    return retrieval.relation_texts(graph.weighted_relations(graph.edge_relations(triplets(spark, d)))).select("key", "description", "weight")


@query("SELECT p_partkey AS doc_id, p_brand || ', ' || p_type AS t FROM part")
def kg_keyword_texts(spark, d):
    return retrieval.keyword_texts(t(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.array("p_brand", "p_type").alias("keywords")))


_ENTITY_HITS = "h AS (SELECT DISTINCT o_custkey AS query_id, 'part-' || l_partkey AS key, (l_partkey % 10)::INT AS rank, (l_suppkey % 9) / 10.0::DOUBLE AS distance FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1), docs AS (SELECT DISTINCT lo AS key, doc_id FROM rel UNION SELECT DISTINCT hi, doc_id FROM rel)"


def _line_hits(spark, d) -> DataFrame:
    lines = t(spark, d, "orders").join(t(spark, d, "lineitem").where("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("part-"), "l_partkey").alias("key"), F.concat(F.lit("supplier-"), "l_suppkey").alias("other"), (F.col("l_partkey") % 10).cast("int").alias("rank"), ((F.col("l_suppkey") % 9) / 10).alias("distance"))


def _node_docs(relations: DataFrame) -> DataFrame:
    return relations.select(F.explode(F.array("lo", "hi")).alias("key"), "doc_id").distinct()


@query(f"WITH {_TRIPLETS}, {_ENTITY_HITS} SELECT query_id, doc_id, round(sum((1 - distance / 2) / (1 + rank)), 6) AS score FROM h JOIN docs USING (key) GROUP BY 1, 2")
def entity_documents(spark, d):
    """Each entity that a query meets gives to all its documents."""
    hits = _line_hits(spark, d).drop("other").distinct()
    found = ranking.entity_scores(hits, _node_docs(graph.edge_relations(triplets(spark, d))))
    return found.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))


@query(f"""
WITH {_TRIPLETS}, h AS (SELECT DISTINCT c_custkey AS query_id, l_linenumber AS rank, 0.4::DOUBLE AS distance, 'part-' || l_partkey AS lo, 'supplier-' || l_suppkey AS hi FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_totalprice > 450000 AND l_returnflag = 'A'),
docs AS (SELECT DISTINCT lo AS key, doc_id FROM rel UNION SELECT DISTINCT hi, doc_id FROM rel)
SELECT query_id, doc_id, round(sum(0.8 / (1 + rank) * weight), 6) AS score FROM (SELECT DISTINCT h.query_id, rank, weight, doc_id FROM h JOIN edge USING (lo, hi) JOIN docs ON key = lo OR key = hi) GROUP BY 1, 2
""")
def relation_documents(spark, d):
    """Each relation gives once to every document of either end."""
    relations = stored(graph.statements(triplets(spark, d)), "relations")
    lines = t(spark, d, "orders").where("o_totalprice > 450000").join(t(spark, d, "lineitem").where("l_returnflag = 'A'"), F.col("o_orderkey") == F.col("l_orderkey"))
    hits = stored(lines.select(F.col("o_custkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.lit(0.4).alias("distance"), F.concat(F.lit("part-"), "l_partkey").alias("lo"), F.concat(F.lit("supplier-"), "l_suppkey").alias("hi")).distinct(), "hits")
    weighted = stored(hits.join(graph.edges(relations.join(hits, ["lo", "hi"], "left_semi")), ["lo", "hi"]), "weighted-hits")
    lists = ranking.doc_lists(relations.select(F.explode(F.array("lo", "hi")).alias("key"), "doc_id"))
    forget(relations)
    forget(hits)
    found = ranking.relation_scores(weighted, lists, ranking.summing_tasks(ranking.summed_rows([ranking.relation_ends(weighted)], lists), lists))
    return found.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))


@query("""
SELECT p_partkey AS query_id, 0 AS rank, '{"source": "part-' || p_partkey || '", "target": "' || p_brand || '", "relation": "of", "description": "", "vdb_distance": 0.5, "weight": 1' || CASE WHEN p_size > 25 THEN ', "source_description": "' || p_name || '", "source_type": "' || p_type || '"' ELSE '' END || '}' AS line FROM part
""")
def relation_lines(spark, d):
    """Relations as a model is shown them, with what is known of their ends."""
    part = t(spark, d, "part")
    name = F.concat(F.lit("part-"), "p_partkey")
    nodes = part.where("p_size > 25").select(name.alias("name"), F.col("p_type").alias("type"), F.col("p_name").alias("description"))
    hits = part.select(F.col("p_partkey").alias("query_id"), F.lit(0).alias("rank"), F.lit(0.5).alias("distance"), name.alias("source"), F.col("p_brand").alias("target"), F.lit("of").alias("relation"), F.lit("").alias("description"), F.lit(1).alias("weight"))
    return retrieval.relation_lines(hits, nodes)


# --- retrievers and runs -------------------------------------------------------------------------------------------

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_COUNTED = f"[(length(x) - length(replace(x, l, '')))::DOUBLE FOR l IN {list(_LETTERS)}]"
_VECTORS = f"""
v AS (SELECT id, text, [c / n FOR c IN c] AS v FROM (SELECT *, sqrt(list_sum([c * c FOR c IN c])) AS n FROM (SELECT id, text, {_COUNTED} AS c FROM (SELECT doc_id::VARCHAR AS id, text, lower(text) AS x FROM documents WHERE text <> ''))) WHERE n > 0),
q AS (SELECT id, text, [c / n FOR c IN c] AS v FROM (SELECT *, sqrt(list_sum([c * c FOR c IN c])) AS n FROM (SELECT id, text, {_COUNTED} AS c FROM (SELECT item_id::VARCHAR AS id, text, lower(text) AS x FROM benchmark)))),
top AS (SELECT q.id AS query_id, v.id AS doc_id, v.text, round(greatest(0, list_sum([a * a FOR a IN q.v]) + list_sum([b * b FOR b IN v.v]) - 2 * list_dot_product(q.v, v.v)) * 1000000)::BIGINT AS micros FROM q, v),
found AS (SELECT query_id, doc_id, text, micros, CAST(row_number() OVER (PARTITION BY query_id ORDER BY micros, doc_id) AS INTEGER) AS rank FROM top QUALIFY rank <= 20)
"""


def _items(spark, d) -> DataFrame:
    return t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query_text"))


def _corpus(spark, d) -> DataFrame:
    """Documents with a letter: those without have no direction."""
    letters = t(spark, d, "documents").where(F.lower("text").rlike("[a-z]"))
    return letters.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("title"), F.col("text").alias("content"))


@query(f"WITH {_VECTORS} SELECT query_id, rank, doc_id, round(1 - micros / 2000000.0::DOUBLE, 9) AS score, md5(text) AS content, NULL::VARCHAR AS fallback FROM found")
def vector_retrieval(spark, d):
    engine = retrieval.retriever("SIMPLE_VECTOR", providers.LetterEmbedder())
    engine.index_documents(_corpus(spark, d))
    return engine.retrieve(_items(spark, d)).withColumn("score", F.round("score", 9)).withColumn("content", F.md5("content"))


@query(f"WITH {_VECTORS} SELECT query_id, doc_id FROM found WHERE rank = 1")
def retrieval_by_vector(spark, d):
    """Queries that bring their vectors are not embedded again."""
    engine = retrieval.VectorRetriever(providers.LetterEmbedder(), 1)
    engine.index_documents(_corpus(spark, d))
    asked = providers.embed_column(_items(spark, d), "query_text", providers.LetterEmbedder())
    engine.embedder = None
    return engine.retrieve_by_vector(asked).select("query_id", "doc_id")


@query("SELECT item_id::VARCHAR AS query_id, state, CASE state WHEN 'cleared' THEN 'nothing is indexed' ELSE 'ValueError: out of order' END AS error FROM benchmark, (SELECT unnest(['broken', 'cleared']) AS state)")
def retrieval_errors(spark, d):
    """A failing embedder, and an index that is cleared, leave queries without rows and say why."""
    engine, out = retrieval.VectorRetriever(providers.LetterEmbedder()), []
    engine.index_documents(_corpus(spark, d))
    for state in ("broken", "cleared"):
        if state == "broken":
            engine.embedder = providers.BrokenEmbedder()
        else:
            engine.clear_index()
        rows = engine.retrieve(_items(spark, d)).select("query_id").distinct()
        out.append(engine.errors.join(rows, "query_id", "left_anti").select("query_id", F.lit(state).alias("state"), "error"))
    return out[0].unionAll(out[1])


@query("SELECT * FROM (VALUES ('hybrid', true, true, 'GraphRetriever'), ('local', true, false, 'GraphRetriever'), ('global', false, true, 'GraphRetriever'), ('naive', false, false, 'GraphRetriever'), ('without a model', false, false, 'VectorRetriever'), ('SIMPLE_VECTOR', false, false, 'VectorRetriever')) v(name, names, themes, engine)")
def retrieval_modes(spark, d):
    made = {m: retrieval.retriever("LIGHT_RAG", None, providers.WordModel(), retrieval.GraphSettings(mode=m)) for m in retrieval.MODES}
    made |= {"without a model": retrieval.retriever("LIGHT_RAG", None), "SIMPLE_VECTOR": retrieval.retriever("SIMPLE_VECTOR", None, providers.WordModel())}
    return spark.createDataFrame([(n, *retrieval.mode_levels(n), type(e).__name__) for n, e in made.items()], "name string, names boolean, themes boolean, engine string")


@query("SELECT dropped, kept, CASE WHEN dropped = 0 THEN NULL WHEN dropped / (dropped + kept)::DOUBLE > 0.1 THEN 'error' ELSE 'warning' END AS alert FROM (VALUES (0, 0), (0, 5), (1, 9), (1, 8), (5, 100)) v(dropped, kept)")
def cap_alerts(spark, d):
    return spark.createDataFrame([(a, b, retrieval.cap_alert(a, b)) for a, b in ((0, 0), (0, 5), (1, 9), (1, 8), (5, 100))], "dropped int, kept int, alert string")


@query("SELECT true AS degraded, 'SIMPLE_VECTOR' AS strategy_used, count(*) * 3 AS n_rows FROM benchmark")
def degraded_graph(spark, d):
    """An index of the graph that cannot be made leaves vectors to serve every query."""
    engine = retrieval.GraphRetriever(providers.LetterEmbedder(), providers.WordModel(), retrieval.GraphSettings(), 3)
    engine._graph = lambda corpus: {"nodes": corpus.select(F.col("doc_id").alias("name"))}  # lacks what the indexes need
    engine.index_documents(_corpus(spark, d))
    found = engine.retrieve(_items(spark, d)).agg(F.count(F.lit(1)).alias("n_rows"))
    return found.select(F.lit(engine.degraded is not None).alias("degraded"), F.lit(engine.strategy_used).alias("strategy_used"), "n_rows")


@query("SELECT 'query' AS kind, item_id::VARCHAR AS id FROM (FROM benchmark ORDER BY item_id::VARCHAR LIMIT 10) UNION ALL SELECT 'document', doc_id::VARCHAR FROM (FROM documents ORDER BY md5('42:' || doc_id) LIMIT 100)")
def standard_subset(spark, d):
    config = evaluation.RunConfig(max_queries=10, max_corpus=100)
    corpus = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    queries, docs = evaluation.selected(datasets.Dataset(_items(spark, d), corpus), config)
    return queries.select(F.lit("query").alias("kind"), F.col("query_id").alias("id")).unionAll(docs.select(F.lit("document"), "doc_id"))


@query("SELECT * FROM (VALUES ('vectors', 20, 60, 20, 5), ('vectors', 100, 100, 100, 5), ('configured', 20, 70, 20, 5), ('graph', 20, 20, 20, 3), ('graph, all', 20, 20, 20, 20)) v(name, retrieval_k, fetched, measured, shown)")
def retrieval_depths(spark, d):
    """How many rows are fetched, measured and shown, with a reranker and without."""
    out = []
    for name, k, config in (("vectors", 20, {"rerank_top_n": 20}), ("vectors", 100, {"rerank_top_n": 20}), ("configured", 20, {"rerank_top_n": 20, "rerank_fetch_k": 70}), ("graph", 20, {"strategy": "LIGHT_RAG", "generation_top_n": 3}), ("graph, all", 20, {"strategy": "LIGHT_RAG"})):
        c = evaluation.RunConfig(retrieval_k=k, **config)
        fetched, measured, shown = evaluation.depths(c, True)
        out.append((name, k, fetched, measured, min(shown, 5) if "rerank_top_n" in config else shown))
    return spark.createDataFrame(out, "name string, retrieval_k int, fetched int, measured int, shown int")


_FIRST = "trim(split_part(text, chr(10), 1))"
_EVALUATION = f"""
WITH {_VECTORS},
items AS (SELECT item_id::VARCHAR AS query_id, text, {_FIRST} AS answer, nullif(substr(text, 1, 20), '') AS expected FROM benchmark),
rels AS (SELECT item_id::VARCHAR AS query_id, d.doc_id::VARCHAR AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
n AS (SELECT query_id, count(*) AS n FROM rels GROUP BY 1),
m AS (SELECT query_id, coalesce(1.0 / min(rank) FILTER (hit), 0)::DOUBLE AS mrr, count(*) FILTER (hit) / any_value(n)::DOUBLE AS recall_at_20 FROM (SELECT f.query_id, f.rank, r.doc_id IS NOT NULL AS hit FROM found f LEFT JOIN rels r USING (query_id, doc_id)) LEFT JOIN n USING (query_id) GROUP BY 1),
w AS (SELECT query_id, 1 AS p, 0 AS q, unnest(string_split({_NORM.format("answer")}, ' ')) AS w FROM items UNION ALL SELECT query_id, 0, 1, unnest(string_split({_NORM.format("expected")}, ' ')) FROM items),
c AS (SELECT query_id, w, sum(p) AS p, sum(q) AS q FROM w WHERE w <> '' GROUP BY ALL),
f AS (SELECT query_id, coalesce(2 * sum(least(p, q)) / sum(p + q), 0)::DOUBLE AS f1 FROM c GROUP BY 1),
b AS (SELECT query_id, rank, '[Doc ' || rank || ']' || chr(10) || text AS b, sum(length('[Doc ' || rank || ']' || chr(10) || text) + CASE WHEN rank > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM found),
x AS (SELECT query_id, max(used) FILTER (used <= 4000) AS chars FROM b GROUP BY 1),
j AS (SELECT query_id, CASE WHEN coalesce(chars, 0) = 0 OR answer = '' THEN NULL ELSE ({_FAITH} + chars + least(2000, length(answer))) % 11 END AS k FROM items JOIN x USING (query_id))
SELECT query_id, 'completed' AS status, mrr, recall_at_20, answer AS generated_response, 'f1_score' AS primary_metric_type, CASE WHEN expected IS NULL THEN 0.0 ELSE f1 END AS generation_score,
  (CASE WHEN k IS NULL THEN 0.0 WHEN k = 0 THEN 0.5 ELSE k / 10 END)::DOUBLE AS faithfulness FROM items JOIN m USING (query_id) JOIN f USING (query_id) JOIN j USING (query_id)
"""


def _run(spark, d) -> tuple[DataFrame, dict]:
    data = datasets.load_dataset(spark, dataset(spark, d), "hotpotqa")
    data.corpus = data.corpus.where(F.lower("content").rlike("[a-z]"))
    config = evaluation.RunConfig(dataset="hotpotqa", max_queries=0, max_corpus=0, judge_threshold=0.0)
    return evaluation.evaluate(data, config, providers.LetterEmbedder(), providers.LengthModel())


@query(_EVALUATION)
def evaluation_results(spark, d):
    """A whole run over all items and documents: vectors, plain contexts, answers, F1 and a judge."""
    result, _ = _run(spark, d)
    return result.select("query_id", "status", "mrr", "recall_at_20", "generated_response", "primary_metric_type", "generation_score", F.element_at("secondary_metrics", "faithfulness").alias("faithfulness"))


@query(f"""
WITH e AS ({_EVALUATION}), j AS ({_EVALUATION.replace("SELECT query_id, 'completed' AS status", "SELECT k, 'completed' AS status")})
SELECT count(*) AS n_completed, 0 AS n_failed, round_even(avg(mrr), 4) AS avg_mrr, round_even(avg(generation_score), 4) AS avg_generation_score, (SELECT count(k) FROM j) AS judged, 'SIMPLE_VECTOR' AS retrieval_strategy, 7 AS events, (SELECT count(*) FROM documents WHERE regexp_matches(lower(text), '[a-z]')) AS total_documents FROM e
""")
def evaluation_report(spark, d):
    _, r = _run(spark, d)
    row = (r["n_completed"], r["n_failed"], r["avg_mrr"], r["avg_generation_score"], r["judge_fallback_stats"]["faithfulness"]["invocations"], r["retrieval_strategy"], len(r["operational_stats"]), r["total_documents"])
    return spark.createDataFrame([row], "n_completed long, n_failed int, avg_mrr double, avg_generation_score double, judged long, retrieval_strategy string, events int, total_documents long")
