"""Queries over the driver's tables, one or more for each operator, with equivalent SQL.

Roles of the tables: documents are the corpus, benchmark the queries (relevant: documents that hold the item's
text), embeddings the vector index (relevant: same label), conversations pairs of expected and generated answers, events
the log of calls, orders and their lines the documents and relations of a knowledge graph whose entities are parts and suppliers.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parse, text
from ..operators import graph, metrics, ranking, statistics
from ..operators.vectors import SCALE, nearest, semantic_similarity
from ..sources import datasets
from . import retrieval
from .evaluation import generation_totals, run_totals
from .providers import HashEmbedder, WordModel
from .registry import ORACLE_SQL, query
from .registry import table as t
from .retrieval import WHOLE_TEXTS, GraphRetriever, GraphSettings, structured_context
from .storage import forget, stored


# --- scalars -------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN lang IS NULL OR lang IN ('None', 'nan', 'NaN') THEN '' ELSE lang END AS lang, CASE WHEN coalesce(source, '') <> '' THEN source || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS full_text FROM documents")
def full_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", text.safe_str(F.col("lang")).alias("lang"), text.full_text(F.col("source"), F.col("text")).alias("full_text"))


@query("SELECT event_id, CAST(trunc(value) AS INTEGER) AS whole, TRY_CAST(event_type AS INTEGER) AS none FROM events")
def coerced_integers(spark, d):
    return t(spark, d, "events").select("event_id", text.coerce_int(F.col("value")).alias("whole"), text.coerce_int(F.col("event_type")).alias("none"))


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[‐‑‒–—―−﹘－]', ' ', 'g'), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, {_NORM.format('text')} AS normal FROM documents")
def normalized_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@query(r"SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(trim(lower('The ' || p_name || ' (' || p_brand || ')')), '^(the|an|a) ', ''), '[^\w\s''-]', '', 'g'), '\s+', ' ', 'g')) AS name FROM part")
def entity_names(spark, d):
    return t(spark, d, "part").select("p_partkey", text.entity_name(F.concat(F.lit("The "), "p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"))


@query("SELECT conv_id, turn, trim(text) AS answer FROM conversations")
def think_stripped(spark, d):
    raw = F.concat(F.lit("<think>plan "), "role", F.lit("</think>"), "text", F.lit("<think>open end"))
    return t(spark, d, "conversations").select("conv_id", "turn", text.strip_think(raw).alias("answer"))


_QUERIES_SQL = """
SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query_text, nullif(substr(text, 1, 20), '') AS expected_answer,
  CASE WHEN length(text) > 250 THEN 'label' ELSE 'text' END AS answer_type, CASE WHEN length(text) > 250 THEN 'comparison' ELSE 'bridge' END AS question_type, '' AS level FROM benchmark
"""


@query(_QUERIES_SQL)
def normalized_query_rows(spark, d):
    from ..sources.datasets import normalized_queries

    raw = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.substring("text", 1, 20).alias("answer"), F.when(F.length("text") > 250, "comparison").otherwise("bridge").alias("type"))
    return normalized_queries(raw)


# --- parsers -------------------------------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT event_id, event_type, trunc(value) AS w, (props->>'k')::DOUBLE AS k FROM events)
SELECT event_id,
  CASE event_type WHEN 'view' THEN least(1.0, w / 500) WHEN 'click' THEN CASE WHEN w <= 1 THEN w WHEN w <= 10 THEN w / 10 ELSE 0.5 END WHEN 'error' THEN 0.5 WHEN 'signup' THEN least(1.0, k / 100) ELSE 0.25 END AS score,
  CASE WHEN event_type = 'signup' THEN 0.9 WHEN event_type = 'error' OR event_type = 'click' AND w > 10 THEN 0.2 ELSE 0.4 END::DOUBLE AS confidence,
  event_type = 'error' OR event_type = 'click' AND w > 10 AS was_default, event_type <> 'signup' AS parse_failure
FROM e
""")
def judge_scores(spark, d):
    whole = F.col("value").cast("int").cast("string")
    share = F.get_json_object("props", "$.k").cast("double") / 100
    said = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("I give it "), whole, F.lit("/500 overall")))
        .when(F.col("event_type") == "click", F.concat(F.lit("Score: "), whole))
        .when(F.col("event_type") == "error", F.lit("I cannot tell"))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"score": '), share.cast("string"), F.lit(', "justification": "ok"}')))
        .otherwise(F.lit("about 0.25, all in all"))
    )
    one = t(spark, d, "events").withColumn("said", said).withColumn("r", parse.judge_result(F.col("said")))
    return one.select("event_id", "r.score", "r.confidence", "r.was_default", "r.parse_failure")


@query("""
WITH e AS (SELECT event_id, (props->>'k')::INT AS k, trunc(value)::INT AS v FROM events)
SELECT event_id, 4::BIGINT AS total, 3::BIGINT AS valid, 1::BIGINT AS malformed, (CASE WHEN k BETWEEN 1 AND 50 THEN 2 ELSE 0 END + CASE WHEN v BETWEEN 1 AND 50 THEN 1 ELSE 0 END)::BIGINT AS in_range,
  (3 - CASE WHEN k BETWEEN 1 AND 50 THEN 2 ELSE 0 END - CASE WHEN v BETWEEN 1 AND 50 THEN 1 ELSE 0 END)::BIGINT AS out_of_range,
  (CASE WHEN k BETWEEN 1 AND 50 THEN 1 ELSE 0 END + CASE WHEN v BETWEEN 1 AND 50 AND v <> k THEN 1 ELSE 0 END)::BIGINT AS distinct_refs FROM e
""")
def citation_counts(spark, d):
    k, v = F.get_json_object("props", "$.k"), F.col("value").cast("int").cast("string")
    said = F.concat(F.lit("As in [ref:"), k, F.lit("] and [ref:"), v, F.lit("], again [ref:"), k, F.lit("], not [Ref 3]."))
    return t(spark, d, "events").select("event_id", parse.citations(said, F.lit(50)).alias("c")).select("event_id", "c.total", "c.valid", "c.malformed", "c.in_range", "c.out_of_range", "c.distinct_refs")


@query("""
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'PLACE' ELSE 'OTHER' END AS type, p_name AS name, substr(p_brand || ' ' || p_type, 1, 200) AS description, 'related to' AS relation, list_distinct([p_brand])[1] AS keyword, 1 AS n_keywords FROM part
""")
def parsed_extractions(spark, d):
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    said = F.concat(
        F.lit('```json\n{"entities": [{"name": " '), "p_name", F.lit(' ", "type": "'), F.when(F.col("p_size") > 25, "place").otherwise("thing"), F.lit('", "description": "'), "p_brand", F.lit(" "), "p_type", F.lit('"}, {"name": ""}], "relations": [{"source": '),
        q(F.col("p_name")), F.lit(', "target": '), q(F.col("p_brand")), F.lit('}, {"source": "x"}], "high_level_keywords": ['), q(F.col("p_brand")), F.lit(", "), q(F.upper("p_brand")), F.lit(', "k"]}\n```'),
    )
    one = t(spark, d, "part").select("p_partkey", parse.extraction(said).alias("x"))
    e, r, k = parse.valid_entities(F.col("x.entities")), parse.valid_relations(F.col("x.relations")), parse.valid_keywords(F.col("x.high_level_keywords"))
    found = one.select("p_partkey", e.alias("e"), r.alias("r"), k.alias("k")).where((F.size("e") == 1) & (F.size("r") == 1))
    return found.select("p_partkey", F.col("e")[0]["type"].alias("type"), F.col("e")[0]["name"].alias("name"), F.col("e")[0]["description"].alias("description"), F.col("r")[0]["relation"].alias("relation"), F.col("k")[0].alias("keyword"), F.size("k").alias("n_keywords"))


@query("SELECT item_id, len(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '')[1:20]) AS n_low, 1 AS n_high FROM benchmark")
def parsed_query_keywords(spark, d):
    words = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    said = F.to_json(F.struct(words.alias("low_level"), F.array(F.lit(""), F.element_at(words, 1)).alias("high_level")))
    levels = t(spark, d, "benchmark").select("item_id", parse.query_levels(F.concat(F.lit("Here:\n"), said)).alias("j"))
    return levels.select("item_id", parse.query_keywords(F.col("j")).alias("k")).select("item_id", F.size("k.low").cast("long").alias("n_low"), F.size("k.high").alias("n_high"))


# --- vectors, retrieval metrics ------------------------------------------------------------------------------------

_TOP = f"""
q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT query_id, vec_id AS id, q.label = e.label AS hit, round((1 - list_cosine_similarity(q.v, e.embedding::DOUBLE[])) * {SCALE})::BIGINT AS micros FROM q, embeddings e),
top AS (SELECT query_id, id, hit, micros / {float(SCALE)} AS distance, row_number() OVER (PARTITION BY query_id ORDER BY micros, id) AS rank FROM d QUALIFY rank <= 20)
"""


def _vectors(spark, d):
    v = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return v, v.where(F.col("id") % 20 == 0)


@query(f"WITH {_TOP} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, distance FROM top")
def vector_top_k(spark, d):
    v, q = _vectors(spark, d)
    return nearest(q, v, 20)


_AT = lambda k: f"(CASE WHEN count(*) FILTER (hit AND rank <= {k}) > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_at_{k}, count(*) FILTER (hit AND rank <= {k}) / any_value(n)::DOUBLE AS recall_at_{k}, round(coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= {k}), 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least({k}, any_value(n)) + 1)]), 9) AS ndcg_at_{k}"
_METRICS = f"WITH {_TOP}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), m AS (SELECT query_id, coalesce(1.0 / min(rank) FILTER (hit), 0)::DOUBLE AS mrr, {', '.join(map(_AT, metrics.KS))} FROM top JOIN q USING (query_id) JOIN n USING (label) GROUP BY query_id)"


def _metrics(spark, d):
    v, q = _vectors(spark, d)
    near = stored(nearest(q, v, 20), "nearest")
    hits, sizes = metrics.labelled_hits(near, q.withColumnRenamed("id", "query_id"), v)
    return metrics.retrieval_metrics(near, hits, sizes=sizes)


@query(f"{_METRICS} SELECT * FROM m")
def retrieval_scores(spark, d):
    return _metrics(spark, d)


@query(f"""{_METRICS}, g AS (SELECT *, CASE WHEN query_id % 3 = 0 THEN 0 ELSE mrr END AS gs FROM m WHERE query_id % 7 <> 0)
SELECT count(*) AS n_completed, round(avg(hit_at_5), 9) AS hit, round(avg(mrr), 9) AS mrr, round(avg(recall_at_5), 9) AS recall, round(avg(ndcg_at_5), 9) AS ndcg, round(1 - avg(recall_at_5), 9) AS missed,
  round(avg(gs), 9) AS generation, count(*) FILTER (gs = 0) AS n_zero, count(*) FILTER (gs > 0) AS n_scored FROM g""")
def run_summary(spark, d):
    score = F.when(F.col("query_id") % 3 == 0, 0.0).otherwise(F.col("mrr"))
    done = _metrics(spark, d).withColumn("status", F.when(F.col("query_id") % 7 == 0, "failed").otherwise("completed")).withColumn("generation_score", score)
    r = lambda c: F.round(c, 9)
    return run_totals(done).select("n_completed", r("avg_hit_at_5").alias("hit"), r("avg_mrr").alias("mrr"), r("avg_recall_at_5").alias("recall"), r("avg_ndcg_at_5").alias("ndcg"), r("avg_missed_at_5").alias("missed"), r("avg_generation_score").alias("generation"), "n_zero", "n_scored")


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round((list_cosine_similarity(a, b) + 1) / 2, 6) AS similarity FROM v WHERE b IS NOT NULL
""")
def semantic_similarities(spark, d):
    v = t(spark, d, "embeddings").withColumn("next", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("next is not null")
    return v.select("vec_id", F.round(semantic_similarity(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@query(f"WITH {_TOP}, s AS (SELECT *, 1.0 / (1 + id % 7) AS s FROM top), r AS (SELECT query_id, id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN id % 3 = 0 THEN 0 ELSE s END DESC, rank) AS new_rank FROM s) SELECT query_id, id, CAST(rank AS INTEGER) AS rank, CAST(new_rank AS INTEGER) AS new_rank FROM r WHERE new_rank <= 5")
def reranked(spark, d):
    v, q = _vectors(spark, d)
    rows = nearest(q, v, 20)
    scores = rows.where(F.col("id") % 3 != 0).select("query_id", "id", (1 / (1 + F.col("id") % 7)).alias("rerank_score"))
    return ranking.rerank(rows, scores, 5).select("query_id", "id", "rank", "new_rank")


# --- answers -------------------------------------------------------------------------------------------------------


def _pairs(spark, d):
    c = t(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    u = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("expected"))
    return a.join(u, ["conv_id", "turn"]).withColumn("pair", F.concat_ws("-", "conv_id", "turn", F.substring(F.sha2(F.concat("answer", F.lit("\x00"), "expected"), 256), 1, 12)))


_PAIRS = "p AS (SELECT a.conv_id, a.turn, a.text AS answer, u.text AS expected, a.conv_id || '-' || a.turn || '-' || substr(sha256(a.text || chr(0) || u.text), 1, 12) AS pair FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user')"


@query(rf"""
WITH {_PAIRS}, d AS (SELECT DISTINCT pair, answer, expected FROM p),
w AS (SELECT pair, 1 AS p, 0 AS q, unnest(string_split({_NORM.format("answer")}, ' ')) AS w FROM d UNION ALL SELECT pair, 0, 1, unnest(string_split({_NORM.format("expected")}, ' ')) FROM d),
c AS (SELECT pair, w, sum(p) AS p, sum(q) AS q FROM w WHERE w <> '' GROUP BY ALL)
SELECT d.pair, coalesce(2 * sum(least(p, q)) / sum(p + q), 0)::DOUBLE AS f1 FROM d LEFT JOIN c USING (pair) GROUP BY d.pair
""")
def answer_f1(spark, d):
    return metrics.token_f1_rows(_pairs(spark, d).select("pair", "answer", "expected").distinct(), "pair", "answer", "expected")


@query(f"WITH {_PAIRS} SELECT pair, ({_NORM.format('answer')} = {_NORM.format('expected')} AND answer <> '' AND expected <> '')::INT::DOUBLE AS accuracy FROM p")
def answer_accuracy(spark, d):
    return _pairs(spark, d).select("pair", metrics.accuracy(F.col("answer"), F.col("expected")).alias("accuracy"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN CASE WHEN length(text) > 1000 THEN 'f1_score' WHEN length(text) > 100 THEN 'accuracy' ELSE 'f1_score' END WHEN lang = 'fr' THEN CASE WHEN length(text) > 100 THEN 'semantic_similarity' ELSE 'answer_relevance' END ELSE 'faithfulness' END AS metric FROM documents")
def primary_metrics(spark, d):
    kind = F.when(F.col("lang") == "en", "HYBRID").when(F.col("lang") == "fr", "ADAPTED").otherwise("RETRIEVAL_ONLY")
    return t(spark, d, "documents").select("doc_id", metrics.primary_metric(kind, F.when(F.length("text") <= 1000, "label").otherwise("text"), F.when(F.length("text") > 100, F.col("text")), F.lit(True), F.lit(datasets.dataset_config("hotpot-qa")["primary"])).alias("metric"))


# --- logs ----------------------------------------------------------------------------------------------------------


@query("SELECT event_type AS phase, count(*) AS n, round(list_sort(list(value))[least(count(*) - 1, floor(0.5 * count(*))::BIGINT) + 1], 1) AS p50, round(list_sort(list(value))[least(count(*) - 1, floor(0.95 * count(*))::BIGINT) + 1], 1) AS p95, round(max(value), 1) AS longest FROM events GROUP BY 1")
def call_times(spark, d):
    one = statistics.percentiles(t(spark, d, "events").withColumnRenamed("event_type", "phase"), ["phase"], "value")
    return one.select("phase", "n", *(F.round(c, 1).alias(a) for c, a in (("p50", "p50"), ("p95", "p95"), ("max", "longest"))))


_EVENT_OF = {"view": statistics.EVENTS[0], "click": statistics.EVENTS[1], "error": statistics.EVENTS[5], "signup": statistics.EVENTS[6], "purchase": "of no known name"}


@query(f"WITH e AS (SELECT CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _EVENT_OF.items())} END AS event FROM events) SELECT name AS event, count(event) AS n FROM (SELECT unnest({statistics.EVENTS}) AS name) LEFT JOIN e ON event = name GROUP BY 1")
def operational_counters(spark, d):
    named = F.create_map(*(F.lit(x) for kv in _EVENT_OF.items() for x in kv))
    return statistics.operational_counters(t(spark, d, "events").select(named[F.col("event_type")].alias("event")))


@query("SELECT user_id, count(*) AS total_requests, count(*) FILTER (event_type <> 'error') AS successful_requests, count(*) FILTER (event_type = 'error') AS failed_requests, count(*) FILTER (event_type <> 'error') / count(*)::DOUBLE AS success_rate, round(sum(value) / count(*), 6) AS avg_latency_ms, sum((props->>'k')::INT % 4)::BIGINT AS retries_total FROM events GROUP BY 1")
def service_counters(spark, d):
    calls = t(spark, d, "events").select("user_id", F.when(F.col("event_type") == "error", "failed").alias("error"), F.col("value").alias("latency_ms"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("retries"))
    return statistics.service_totals(calls, ["user_id"]).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


def _judged(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return statistics.judge_stats(t(spark, d, "events").select(F.col("event_type").alias("metric"), (k > 50).alias("parse_failure"), (k > 90).alias("was_default")))


_JUDGED = "r AS (SELECT event_type AS metric, count(*) AS invocations, count(*) FILTER ((props->>'k')::INT > 50) AS parse_failures, count(*) FILTER ((props->>'k')::INT > 90) AS default_returns FROM events GROUP BY 1)"


@query(f"WITH {_JUDGED} SELECT *, parse_failures / invocations::DOUBLE AS parse_failure_rate, default_returns / invocations::DOUBLE AS default_return_rate FROM r")
def judge_fallbacks(spark, d):
    return _judged(spark, d)


@query(f"WITH {_JUDGED} SELECT metric, default_returns / invocations::DOUBLE AS rate FROM r ORDER BY 2 DESC, 1 LIMIT 1")
def judge_worst_metric(spark, d):
    return statistics.worst_judge(_judged(spark, d))


@query("SELECT (SELECT count(*) FROM benchmark) AS queries_loaded, (SELECT count(*) FROM benchmark WHERE substr(text, 1, 20) <> '') AS queries_with_text_answer, (SELECT count(DISTINCT item_id) FROM benchmark b JOIN documents d ON contains(d.text, b.text)) AS queries_with_relevant_docs, (SELECT count(*) FROM documents) AS corpus_loaded")
def corpus_statistics(spark, d):
    items = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.substring("text", 1, 20).alias("expected_answer"))
    return statistics.dataset_statistics(items, ranking.containing(t(spark, d, "documents"), items), t(spark, d, "documents"))


# --- packing, subsets ----------------------------------------------------------------------------------------------


@query("""
WITH b AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, '[Doc ' || row_number() OVER (PARTITION BY source ORDER BY doc_id) || ']' || chr(10) || text AS b FROM documents),
u AS (SELECT *, sum(length(b) + CASE WHEN i > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY source ORDER BY i) AS used FROM b)
SELECT source, count(*) FILTER (used <= 4000) AS n_docs, coalesce(string_agg(b, chr(10) || chr(10) ORDER BY i) FILTER (used <= 4000), '') AS context FROM u GROUP BY source
""")
def packed_contexts(spark, d):
    return ranking.pack_context(t(spark, d, "documents"), "source", ["doc_id"], "text", 4000)


@query("""
WITH l AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, '{"id": ' || doc_id || ', "lang": "' || lang || '"}' AS l FROM documents),
u AS (SELECT *, sum(length(l) + 1) OVER (PARTITION BY source ORDER BY i) AS used FROM l)
SELECT source, count(*) AS n_lines, string_agg(l, chr(10) ORDER BY i) AS body FROM u WHERE used <= 857 - 60 GROUP BY source
""")
def structured_sections(spark, d):
    line = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit(', "lang": "'), "lang", F.lit('"}'))
    return ranking.section(t(spark, d, "documents").withColumn("line", line), "source", ["doc_id"], "line", ranking.section_budgets(4000, "hybrid")[0])


@query("""
WITH q AS (SELECT * FROM benchmark ORDER BY md5('42:' || item_id) LIMIT 20),
gold AS (SELECT DISTINCT doc_id FROM documents d JOIN q ON contains(d.text, q.text)),
fill AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (FROM gold) ORDER BY md5('42:' || doc_id) LIMIT (150 - (SELECT count(*) FROM gold)))
SELECT doc_id, true AS gold FROM gold UNION ALL SELECT doc_id, false FROM fill
""")
def development_subset(spark, d):
    q = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = t(spark, d, "documents").select("doc_id", "text")
    chosen = q.withColumn("_o", ranking.seeded_order(42, "query_id")).orderBy("_o").limit(20)  # the feature's number of queries
    rels = ranking.containing(docs, chosen)
    kept = ranking.subset(q, rels, docs.select("doc_id"), 20, 150, 42)[1]
    return kept.join(rels.select("doc_id").distinct().withColumn("gold", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("gold", F.lit(False)).alias("gold"))


@query("SELECT item_id AS query_id, coalesce(string_agg(d.doc_id, ',' ORDER BY d.doc_id::VARCHAR), '') AS docs FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def relevant_documents(spark, d):
    b = t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    held = ranking.containing(t(spark, d, "documents"), b).withColumn("doc_id", F.col("doc_id").cast("string"))
    return datasets.relevant_lists(b, held).select("query_id", F.array_join("relevant_doc_ids", ",").alias("docs"))


@query("WITH b AS (SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 64)::INT AS bucket FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS n FROM b) SELECT doc_id, bucket, (n // 5)::INT AS call, (n % 5 + 1)::INT AS place FROM n")
def model_batches(spark, d):
    return ranking.call_groups(t(spark, d, "documents").select("doc_id"), 5, 64).select("doc_id", F.col("_bucket").alias("bucket"), F.col("_call").alias("call"), F.col("_place").alias("place"))


@query("SELECT count(*) FILTER (coalesce(lang, '') = '') AS empty_id, count(*) FILTER (source IS DISTINCT FROM 'src0') AS foreign, count(*) FILTER (coalesce(text, '') = '') AS empty_text, count(*) FILTER (length(text) > 5000) AS too_long, (SELECT count(*) FROM (SELECT lang FROM documents GROUP BY 1 HAVING count(*) > 1)) AS repeated_id FROM documents")
def contract_faults(spark, d):
    chunks = t(spark, d, "documents").select(F.col("lang").alias("chunk_id"), F.col("source").alias("collection_id"), "text")
    return datasets.fault_counts(chunks, "src0", 5000)


# --- knowledge graph -----------------------------------------------------------------------------------------------


def triplets(spark, d, monthly: bool = False):
    """Lines as relations; ``monthly`` splits suppliers by month of shipping, so that no entity is in most documents."""
    line = t(spark, d, "lineitem").select(F.date_format("l_shipdate", "-yyyyMM").alias("month"), F.col("l_orderkey").alias("doc_id"), F.concat_ws("/", F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lpad("l_partkey", 9, "0"), F.lpad("l_suppkey", 9, "0")).alias("seq"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    return line.select("doc_id", "seq", F.concat(F.lit("The Part-"), "l_partkey").alias("source"), F.concat(F.lit("Supplier-"), "l_suppkey", "month" if monthly else F.lit("")).alias("target"), F.concat(F.lit("shipped "), "l_returnflag").alias("relation"), F.concat(F.lit("status "), "l_linestatus").alias("description"))


def mentions(spark, d):
    p = triplets(spark, d)
    part = t(spark, d, "part").select(F.concat(F.lit("The Part-"), "p_partkey").alias("source"), "p_name", "p_type")
    one = p.join(part, "source").select("doc_id", "seq", F.col("source").alias("name"), F.when(F.col("p_type") == "SMALL", "UNKNOWN").otherwise("CONCEPT").alias("type"), F.concat("p_name", F.lit(" "), "description").alias("description"))
    return one.unionByName(p.select("doc_id", "seq", F.col("target").alias("name"), F.lit("ORG").alias("type"), F.concat(F.lit("of "), F.col("relation"), F.lit(", "), "description").alias("description")))


_TRIPLETS = """
tr AS (SELECT l_orderkey AS doc_id, lpad(l_linenumber::VARCHAR, 2, '0') || '/' || lpad(l_partkey::VARCHAR, 9, '0') || '/' || lpad(l_suppkey::VARCHAR, 9, '0') AS seq, 'part-' || l_partkey AS source, 'supplier-' || l_suppkey AS target, 'shipped ' || l_returnflag AS relation, 'status ' || l_linestatus AS description FROM lineitem),
rel AS (SELECT source AS lo, target AS hi, relation, doc_id, min(seq) AS seq FROM tr GROUP BY ALL),
edge AS (SELECT lo, hi, greatest(1, count(DISTINCT doc_id)) AS weight FROM rel GROUP BY ALL),
deg AS (SELECT node, count(*) AS degree FROM (SELECT lo AS node FROM edge UNION ALL SELECT hi FROM edge) GROUP BY 1)
"""


@query(f"WITH {_TRIPLETS} SELECT lo, hi, relation, doc_id, seq FROM rel")
def kg_relations(spark, d):
    return graph.edge_relations(triplets(spark, d)).select("lo", "hi", "relation", "doc_id", "seq")


@query(f"WITH {_TRIPLETS} SELECT lo, hi, weight FROM edge")
def kg_edges(spark, d):
    return graph.edges(graph.edge_relations(triplets(spark, d)))


@query(f"WITH {_TRIPLETS} SELECT node, degree FROM deg")
def kg_degrees(spark, d):
    return graph.degrees(graph.edges(graph.edge_relations(triplets(spark, d))))


_NEAR = """
near AS (SELECT e.node, e.other AS neighbour, round_even(ln(1 + weight) + degree, 3) AS score, label FROM (
  SELECT lo AS node, hi AS other, weight FROM edge UNION ALL SELECT hi, lo, weight FROM edge) e JOIN deg ON deg.node = e.other
  JOIN (SELECT lo, hi, arg_min(relation, (doc_id, seq, relation)) AS label FROM rel GROUP BY ALL) f ON f.lo = least(e.node, e.other) AND f.hi = greatest(e.node, e.other))
"""


@query(f"WITH {_TRIPLETS}, {_NEAR} SELECT node, CAST(row_number() OVER (PARTITION BY node ORDER BY score DESC, neighbour) AS INTEGER) AS rank, neighbour, score, label FROM near QUALIFY rank <= 5")
def kg_neighbours(spark, d):
    return graph.neighbours(graph.edge_relations(triplets(spark, d)), 5)


@query(f"""
WITH {_TRIPLETS}, n AS (SELECT node, least(5, count(*)) AS k FROM (SELECT lo AS node FROM edge UNION ALL SELECT hi FROM edge) GROUP BY 1),
h AS (SELECT DISTINCT o_custkey AS query_id, CASE WHEN l_linenumber = 1 THEN 'nobody' ELSE 'part-' || l_partkey END AS name FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT query_id, count(*) FILTER (k > 0) AS with_neighbours, round_even(avg(coalesce(k, 0)), 3) AS mean_neighbours FROM h LEFT JOIN n ON node = name GROUP BY 1
""")
def kg_neighbour_coverage(spark, d):
    near = graph.neighbours(graph.edge_relations(triplets(spark, d)), 5)
    hits = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("query_id"), F.when(F.col("l_linenumber") == 1, "nobody").otherwise(F.concat(F.lit("part-"), "l_partkey")).alias("name")).distinct()
    return retrieval.neighbour_coverage(near, hits)


_MENTIONS = """
men AS (SELECT doc_id, seq, source AS name, CASE WHEN p_type = 'SMALL' THEN 'UNKNOWN' ELSE 'CONCEPT' END AS type, p_name || ' ' || description AS description FROM tr JOIN part ON source = 'part-' || p_partkey
  UNION ALL SELECT doc_id, seq, target, 'ORG', 'of ' || relation || ', ' || description FROM tr)
"""


@query(f"""
WITH {_TRIPLETS}, {_MENTIONS}, base AS (SELECT name, count(DISTINCT doc_id) AS n_docs, coalesce(max(type) FILTER (type <> 'UNKNOWN'), 'UNKNOWN') AS type FROM men GROUP BY 1),
once AS (SELECT name, lower(description) AS k, arg_min(description, (doc_id, seq, description)) AS description, min((doc_id, seq)) AS f FROM men GROUP BY ALL),
top AS (SELECT name, description, row_number() OVER (PARTITION BY name ORDER BY length(description) DESC, f, k) AS r FROM once QUALIFY r <= 5),
j AS (SELECT name, string_agg(description, ' | ' ORDER BY r) AS d FROM top GROUP BY 1)
SELECT name, n_docs, type, CASE WHEN length(d) > 500 THEN regexp_extract(substr(d, 1, 500), '(?s)^(.*) \\| ', 1) ELSE d END AS description FROM base JOIN j USING (name)
""")
def kg_entities(spark, d):
    return graph.entities(mentions(spark, d))


@query(f"""
WITH {_TRIPLETS}, nm AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, source AS name FROM tr UNION ALL SELECT doc_id, target FROM tr)),
new AS (SELECT a.doc_id, a.name AS lo, b.name AS hi, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.name, b.name) AS r FROM nm a JOIN nm b ON a.doc_id = b.doc_id AND a.name < b.name ANTI JOIN edge e ON e.lo = a.name AND e.hi = b.name)
SELECT min(doc_id) AS doc_id, lo, hi FROM new WHERE r <= 10 GROUP BY lo, hi
""")
def kg_cooccurrence(spark, d):
    tr = triplets(spark, d)
    names = tr.select("doc_id", F.explode(F.array("source", "target")).alias("name"))
    return graph.cooccurrence(graph.statements(tr), names)


_PLACES = "pl AS (SELECT 'customer-' || c_custkey AS node, c_nationkey AS g FROM customer UNION ALL SELECT 'nation-' || n_nationkey, n_nationkey FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'order-' || o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)"


def _places(spark, d):
    """Orders hang on their customers, customers on their nations: a component for each nation."""
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    customer = F.concat(F.lit("customer-"), "c_custkey")
    first = c.select(customer.alias("lo"), F.concat(F.lit("nation-"), "c_nationkey").alias("hi"))
    return first.unionAll(o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(customer, F.concat(F.lit("order-"), "o_orderkey")))


@query(f"WITH {_PLACES} SELECT node, min(node) OVER (PARTITION BY g) AS root FROM pl")
def kg_components(spark, d):
    return graph.components(_places(spark, d))


@query(f"""
WITH {_TRIPLETS}, nm AS (SELECT DISTINCT doc_id, name FROM (SELECT doc_id, source AS name FROM tr UNION ALL SELECT doc_id, target FROM tr)), kw AS (SELECT doc_id, arg_max(relation, seq) AS k FROM tr GROUP BY 1)
SELECT count(DISTINCT name) AS n_entities, count(DISTINCT doc_id) AS n_docs, count(*) / count(DISTINCT doc_id)::DOUBLE AS entities_per_doc, (SELECT count(*) FROM edge) AS n_edges, 1::BIGINT AS n_components, (SELECT round(sum(strlen(lo) + strlen(hi) + strlen(relation)) / 1048576, 2) FROM rel) AS memory_mb,
  (SELECT count(*) FROM kw) AS docs_with_keywords, (SELECT count(*) FROM kw) AS n_keywords, 0::BIGINT AS entities_dropped, 0::BIGINT AS entities_evicted, 0::BIGINT AS triplets_dropped_by_cap FROM nm
""")
def kg_statistics(spark, d):
    tr = triplets(spark, d)
    names = tr.select("doc_id", F.explode(F.array("source", "target")).alias("name")).select("doc_id", text.entity_name(F.col("name")).alias("name"))
    keywords = graph.chunk_keywords(tr.select("doc_id", "seq", F.array("relation").alias("keywords")))
    return graph.stats(graph.edge_relations(tr), names, keywords, graph.admitted(tr, 10_000_000))


@query(f"WITH {_TRIPLETS} SELECT name FROM (SELECT source AS name FROM tr UNION SELECT target FROM tr)")
def kg_names_below_cap(spark, d):
    return graph.capped(triplets(spark, d), 10_000_000)


def _pairs_of_orders(spark, d):
    """Two new names an order: beyond the cap the oldest pair makes room for the newest."""
    o = t(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("Order-"), "o_orderkey").alias("source"), F.concat(F.lit("Payer-"), "o_orderkey").alias("target"), F.lit("paid by").alias("relation"), F.lit("").alias("description"))


@query("WITH o AS (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 500) SELECT 'order-' || o_orderkey AS name FROM o UNION ALL SELECT 'payer-' || o_orderkey FROM o")
def kg_capped_names(spark, d):
    return graph.capped(_pairs_of_orders(spark, d), 1000)


@query("SELECT 0::BIGINT AS entities_dropped, (2 * count(*) - 1000)::BIGINT AS entities_evicted, 0::BIGINT AS triplets_dropped_by_cap FROM orders")
def kg_cap_counts(spark, d):
    return graph.cap_counts(graph.admitted(_pairs_of_orders(spark, d), 1000))


@query("SELECT 0::BIGINT AS entities_evicted, (SELECT count(*) FROM orders WHERE o_orderkey >= 2) AS entities_dropped, (SELECT count(*) FROM orders WHERE o_orderkey >= 2) AS triplets_dropped_by_cap")
def kg_cap_drops(spark, d):
    """The two names that every other order's pair comes after are each in two documents, so nothing can make room."""
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).cast("long").alias("seq"))
    early = F.col("doc_id") < 2
    rows = o.select("doc_id", "seq", F.when(early, "first").otherwise(F.concat(F.lit("order-"), "doc_id")).alias("source"), F.when(early, "second").otherwise(F.concat(F.lit("payer-"), "doc_id")).alias("target"), F.lit("with").alias("relation"), F.lit("").alias("description"))
    return graph.cap_counts(graph.admitted(rows, 2))


@query(f"WITH {_TRIPLETS} SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM tr)")
def kg_documents_without_relations(spark, d):
    return t(spark, d, "orders").select("o_orderkey").join(triplets(spark, d), F.col("o_orderkey") == F.col("doc_id"), "left_anti")


@query("SELECT c_mktsegment AS doc_id, arg_max(o_orderpriority, o_orderkey) AS keyword FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' GROUP BY 1")
def chunk_keywords_last_write(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    said = F.when(F.col("o_orderstatus") == "F", F.array().cast("array<string>")).otherwise(F.array("o_orderpriority"))  # empty lists never overwrite
    held = graph.chunk_keywords(rows.select(F.col("c_mktsegment").alias("doc_id"), F.col("o_orderkey").alias("seq"), said.alias("keywords")))
    return held.select("doc_id", F.col("keywords")[0].alias("keyword"))


# Hybrid retrieval: customers ask; the parts and suppliers of their orders are the hits of the entity channel, their
# pairs those of the relation channel, orders by total price those of the keyword channel.

_MONTHLY = _TRIPLETS.replace("'supplier-' || l_suppkey", "'supplier-' || l_suppkey || strftime(l_shipdate, '-%Y%m')")
_HYBRID = f"""
WITH {_MONTHLY},
base AS (SELECT o_custkey AS query_id, l_linenumber AS kw_idx, 'part-' || l_partkey AS part, 'supplier-' || l_suppkey || strftime(l_shipdate, '-%Y%m') AS supp, l_orderkey AS doc, l_discount * 10 AS distance, l_extendedprice AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
eh AS (SELECT query_id, kw_idx, part AS key, distance, row_number() OVER (PARTITION BY query_id, kw_idx ORDER BY distance, part, price) - 1 AS pos FROM base),
e1 AS (SELECT query_id, key, distance, kw_idx, pos FROM eh WHERE pos < 10 AND distance <= 0.8 QUALIFY row_number() OVER (PARTITION BY query_id, key ORDER BY kw_idx, pos) = 1),
e2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw_idx, pos, key) - 1 AS rank FROM e1),
docs AS (SELECT DISTINCT lo AS key, doc_id FROM rel UNION SELECT DISTINCT hi, doc_id FROM rel),
ec AS (SELECT query_id, doc_id, greatest(0, 1 - distance / 2) / (1 + rank) AS score FROM e2 JOIN docs USING (key)),
rh AS (SELECT query_id, kw_idx, part, supp, distance, row_number() OVER (PARTITION BY query_id, kw_idx ORDER BY distance, part, supp, price) - 1 AS pos FROM base),
r1 AS (SELECT *, part || ' > ' || supp AS key FROM rh WHERE pos < 20 AND distance <= 0.8 QUALIFY row_number() OVER (PARTITION BY query_id, part, supp ORDER BY kw_idx, pos) = 1),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw_idx, pos, key) - 1 AS rank FROM r1 QUALIFY rank < 30),
rc AS (SELECT query_id, doc_id, greatest(0, 1 - distance / 2) / (1 + rank) * weight AS score FROM (SELECT DISTINCT r2.query_id, rank, distance, weight, doc_id FROM r2 JOIN edge ON lo = part AND hi = supp JOIN docs ON docs.key = part OR docs.key = supp)),
kh AS (SELECT query_id, kw_idx, doc AS key, distance, row_number() OVER (PARTITION BY query_id, kw_idx ORDER BY distance, doc, price) - 1 AS pos FROM base),
k1 AS (SELECT query_id, key, min(distance) AS distance, min((kw_idx, pos)) AS place FROM kh WHERE pos < 20 AND distance <= 0.8 GROUP BY ALL),
k2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, key) - 1 AS rank FROM k1),
kc AS (SELECT query_id, key AS doc_id, greatest(0, 1 - distance / 2) / (1 + rank) AS score FROM k2),
s AS (SELECT query_id, doc_id, round(sum(score), 9) AS score FROM (SELECT * FROM ec UNION ALL SELECT * FROM rc UNION ALL SELECT * FROM kc) GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s QUALIFY rank <= 20
"""


@query()
def kg_hybrid_retrieval(spark, d):
    base = t(spark, d, "orders").join(t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("query_id"), F.col("l_linenumber").alias("kw_idx"), "l_partkey", "l_suppkey", F.date_format("l_shipdate", "-yyyyMM").alias("month"), F.col("l_orderkey").alias("doc"), (F.col("l_discount") * 10).alias("distance"), F.col("l_extendedprice").alias("price")
    )
    base = stored(base, "lines")
    dealt = base.repartition("query_id").select("*", F.concat(F.lit("part-"), "l_partkey").alias("part"), F.concat(F.lit("supplier-"), "l_suppkey", "month").alias("supp"))  # once a channel: no window moves a row
    by = lambda *c: F.row_number().over(Window.partitionBy("query_id", "kw_idx").orderBy("distance", *c, "price")) - 1

    entity = stored(ranking.channel_hits(dealt.select("query_id", "kw_idx", F.col("part").alias("key"), "distance", by("part").alias("pos")), "entity"), "entity-hits")
    relation = ranking.channel_hits(dealt.select("query_id", "kw_idx", F.concat_ws(" > ", "part", "supp").alias("key"), "distance", by("part", "supp").alias("pos")), "relation")
    ends = stored(relation.withColumn("p", F.split("key", " > ")).select("query_id", "rank", "distance", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi")), "relation-hits")
    keyword = stored(ranking.channel_hits(dealt.select("query_id", "kw_idx", F.col("doc").alias("key"), "distance", by("doc").alias("pos")), "keyword"), "keyword-hits")
    forget(base)

    relations = stored(graph.statements(triplets(spark, d, monthly=True)), "relations")
    weighted = stored(ends.join(graph.edges(relations), ["lo", "hi"]), "weighted-hits")
    forget(ends)
    lists = ranking.doc_lists(relations.select(F.explode(F.array("lo", "hi")).alias("key"), "doc_id"), 32)
    forget(relations)
    return ranking.fuse_hits(entity, weighted, keyword, lists, 20)


ORACLE_SQL["kg_hybrid_retrieval"] = _HYBRID


@query("""
WITH w AS (SELECT c_custkey AS query_id, c_custkey % 5 > 0 AS words, count(o_orderkey) > 0 AS hits, count(o_orderkey) FILTER (o_orderstatus <> 'F') > 0 AS held FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 200000 GROUP BY 1, 2)
SELECT query_id, CASE WHEN NOT words THEN 'no_keywords' WHEN NOT hits THEN 'no_doc_ids' ELSE 'docs_not_in_store' END AS fallback FROM w WHERE NOT held
""")
def retrieval_fallbacks(spark, d):
    none, some = F.array().cast("array<string>"), F.array(F.lit("word"))
    words = t(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.when(F.col("c_custkey") % 5 > 0, some).otherwise(none).alias("low"), none.alias("high"))
    urgent = t(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 200000")
    fused = urgent.select(F.col("o_custkey").alias("query_id"), "o_orderstatus")
    return retrieval.fallback_reasons(words, fused, fused.where("o_orderstatus <> 'F'"), "local")


@query("SELECT event_type AS phase, date_trunc('hour', ts) AS start, count(*) AS n_calls, round(avg(value), 6) AS mean_ms, max(value) AS max_ms FROM events GROUP BY ALL")
def windowed_call_times(spark, d):
    from ..streaming.calls import windowed_calls

    return windowed_calls(t(spark, d, "events").select("ts", F.col("event_type").alias("phase"), F.col("value").alias("llm_ms"))).withColumn("mean_ms", F.round("mean_ms", 6))


# --- runs ----------------------------------------------------------------------------------------------------------


def _times_sql(name: str, value: str) -> str:
    of = f"list_sort(list({value}) FILTER ({value} IS NOT NULL))"
    at = lambda p: f"round(coalesce({of}[least(count({value}) - 1, floor({p} * count({value}))::BIGINT) + 1], 0), 1)"
    return f"count({value}) AS n_{name}_samples, {at(0.5)} AS p50_{name}_ms, {at(0.95)} AS p95_{name}_ms, round(coalesce(max({value}), 0), 1) AS max_{name}_ms"


@query(f"""
SELECT count(*) AS invocations, count(*) FILTER (e IS NULL) AS successes, count(*) FILTER (e = 'error') AS errors, count(*) FILTER (e = 'empty') AS empty_returns, count(*) FILTER (cut) AS truncations,
  count(*) FILTER (e = 'timeout') AS timeouts, count(*) FILTER (e IS NOT NULL) / count(*)::DOUBLE AS fallback_rate, {_times_sql("total", "value")}, {_times_sql("queue", "q")}, {_times_sql("llm", "l")}
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'error' WHEN 'view' THEN 'timeout' WHEN 'purchase' THEN 'empty' END AS e, event_type = 'signup' AS cut, CASE WHEN (props->>'k')::INT > 20 THEN (props->>'k')::DOUBLE END AS q, CASE WHEN event_type <> 'view' THEN value / 2 END AS l FROM events) WHERE value IS NOT NULL
""")
def synthesis_counters(spark, d):
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("double")
    reason = F.when(kind == "click", "error").when(kind == "view", "timeout").when(kind == "purchase", "empty")
    return statistics.synthesis_stats(t(spark, d, "events").select(reason.alias("synthesis_error"), (kind == "signup").alias("truncated"), F.col("value").alias("total_ms"), F.when(k > 20, k).alias("queue_ms"), F.when(kind != "view", F.col("value") / 2).alias("llm_ms")))


@query(f"SELECT event_type AS phase, count(*) AS invocations, {_times_sql('queue', 'q')}, {_times_sql('llm', 'l')} FROM (SELECT *, CASE WHEN event_type <> 'error' THEN (props->>'k')::DOUBLE END AS q, CASE WHEN (props->>'k')::INT % 2 = 0 THEN value END AS l FROM events) GROUP BY 1")
def phase_times(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return statistics.phase_times(t(spark, d, "events").select(F.col("event_type").alias("phase"), F.when(F.col("event_type") != "error", k).alias("queue_ms"), F.when(k % 2 == 0, F.col("value")).alias("llm_ms")))


@query("""
WITH l AS (SELECT conv_id, i, '{"reference_id": ' || i || ', "content": ' || to_json(text)::VARCHAR || '}' AS line FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text IS NOT NULL)),
u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY i) AS used FROM l),
p AS (SELECT conv_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM u WHERE used <= 500 GROUP BY 1)
SELECT conv_id AS query_id, CASE WHEN body IS NULL THEN '[No se encontraron documentos]' ELSE 'Document Chunks:' || chr(10) || chr(10) || '```json' || chr(10) || body || chr(10) || '```' END AS context, CAST(coalesce(n, 0) AS INTEGER) AS n_chunks
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN p USING (conv_id)
""")
def chunk_contexts(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("text").alias("content"))
    return structured_context(rows, rows.where("content IS NOT NULL"), None, None, 600, "naive")


@query("""
WITH r AS (SELECT l_orderkey AS q, bool_or(l_returnflag = 'R') AS own, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS recall, avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0 END) AS at5 FROM lineitem GROUP BY 1)
SELECT round(avg(recall), 6) AS avg_generation_recall, round(avg(CASE WHEN recall > 0 THEN 1.0 ELSE 0 END), 6) AS avg_generation_hit, count(*) FILTER (recall > at5) AS reranker_rescue_count FROM r WHERE own
""")
def reranker_rescues(spark, d):
    share = lambda c, v: F.avg(F.when(F.col(c) == v, 1.0).otherwise(0.0))
    per = t(spark, d, "lineitem").groupBy("l_orderkey").agg(share("l_returnflag", "R").alias("recall"), share("l_linestatus", "F").alias("recall_at_5"))
    own = F.col("recall") > 0
    results = per.select("recall_at_5", F.when(own, F.col("recall")).alias("generation_recall"), F.when(own, 1.0).alias("generation_hit"), F.lit("completed").alias("status"))
    return generation_totals(results, 5).select(F.round("avg_generation_recall", 6).alias("avg_generation_recall"), F.round("avg_generation_hit", 6).alias("avg_generation_hit"), "reranker_rescue_count")


@query()
def graph_retrieval(spark, d):
    """All benchmark items asked of a graph over all documents, read whole, with the models that need no network."""
    engine = GraphRetriever(HashEmbedder(), WordModel(), GraphSettings(max_text_chars=WHOLE_TEXTS))
    engine.index_documents(t(spark, d, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("content")))
    if engine.degraded:
        raise RuntimeError(engine.degraded)
    asked = t(spark, d, "benchmark").select("item_id", F.col("text").alias("query_text")).withColumnRenamed("item_id", "query_id")
    return engine.retrieve(asked).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), "fallback")
