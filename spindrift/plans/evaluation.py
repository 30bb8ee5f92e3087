"""An evaluation run: retrieve, answer, score, aggregate, as one chain of DataFrame plans.

Answers of models are stored, so that no action and no lost executor asks a model twice.
"""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import citations, judge_result
from ..functions.text import strip_think
from ..operators import metrics, ranking, statistics
from ..operators.vectors import semantic_similarity
from ..sources.datasets import Dataset, dataset_config, redacted
from . import logs, prompts, providers
from .retrieval import STRATEGIES, GraphSettings, retriever, structured_context
from .storage import stored

#: Characters per token, and tokens kept for the rest of a prompt, when the context is sized by the model's window.
CHARS_PER_TOKEN, OVERHEAD_TOKENS, FALLBACK_CHARS = 4, 1024, 4000


@dataclass
class RunConfig:
    dataset: str = "dataset"
    dataset_type: str = "HYBRID"
    strategy: str = "SIMPLE_VECTOR"
    graph: GraphSettings = field(default_factory=GraphSettings)
    retrieval_k: int = 20
    generation: bool = True
    generation_top_n: int = 0
    rerank_top_n: int = 0
    rerank_fetch_k: int = 0
    max_context_chars: int = FALLBACK_CHARS
    synthesis: bool = True
    synthesis_max_chars: int = 0
    synthesis_timeout: float = 30.0
    query_timeout: float = 300.0
    judge_threshold: float = 0.02
    max_queries: int = 50
    max_corpus: int = 1000
    seed: int = 42
    dev_mode: bool = False
    dev_queries: int = 200
    dev_corpus_size: int = 4000
    extra: dict = field(default_factory=dict)

    def faults(self) -> list[str]:
        """What is wrong with the settings, all of it."""
        out = [f"{k} must be positive" for k in ("retrieval_k", "max_context_chars", "synthesis_timeout", "query_timeout") if getattr(self, k) <= 0]
        out += [f"{k} must not be negative" for k in ("generation_top_n", "rerank_top_n", "rerank_fetch_k", "max_queries", "max_corpus", "synthesis_max_chars") if getattr(self, k) < 0]
        out += [f"{k} must be positive in dev mode" for k in ("dev_queries", "dev_corpus_size") if self.dev_mode and getattr(self, k) <= 0]
        if not 0 <= self.judge_threshold <= 1:
            out.append("judge_threshold must be from 0 to 1")
        if self.dataset_type not in ("HYBRID", "RETRIEVAL_ONLY", "ADAPTED"):
            out.append(f"unknown dataset type {self.dataset_type}")
        if self.strategy not in STRATEGIES:
            out.append(f"unknown strategy {self.strategy}")
        return out + self.graph.faults()


class JudgeGuard(RuntimeError):
    """Too many judge answers had no score. ``report`` is the report of the run."""

    def __init__(self, message: str, report: dict | None = None):
        super().__init__(message)
        self.report = report


def context_chars(override: int, window_tokens: int | None) -> int:
    """Characters of context: the override, else what the model's window leaves, else the fallback."""
    if override > 0:
        return override
    left = (window_tokens or 0) - OVERHEAD_TOKENS
    return left * CHARS_PER_TOKEN if left > 0 else FALLBACK_CHARS


def depths(config: RunConfig, has_reranker: bool) -> tuple[int, int, int]:
    """Rows of a query that are fetched, that are measured, and that an answer sees."""
    k, graphed = config.retrieval_k, config.strategy == "LIGHT_RAG"
    if has_reranker and config.rerank_top_n and not graphed:
        return max(config.rerank_fetch_k or 3 * config.rerank_top_n, k), k, config.rerank_top_n
    return k, k, min(config.generation_top_n or k, k) if graphed else k


def selected(data: Dataset, config: RunConfig) -> tuple[DataFrame, DataFrame]:
    """The queries and documents of a run: the development subset, or the first queries and documents in seeded order (0: all)."""
    queries, corpus = data.queries, data.corpus
    if config.dev_mode:
        return ranking.subset(queries, data.qrels, corpus, config.dev_queries, config.dev_corpus_size, config.seed)
    if config.max_queries:
        queries = queries.orderBy("query_id").limit(config.max_queries)
    if config.max_corpus:
        corpus = corpus.withColumn("_o", ranking.seeded_order(config.seed, "doc_id")).orderBy("_o").limit(config.max_corpus).drop("_o")
    return queries, corpus


def synthesized(contexts: DataFrame, model: providers.Model, max_chars: int, timeout: float, where: str = "true") -> DataFrame:
    """``contexts`` (query_id, query_text, context, ...) with narrative, synthesis_error, truncated and the times of the call.

    A call that fails, is late or answers nothing leaves the context as it is and names the reason: error, timeout or empty.
    """
    asked = contexts.withColumn("_p", F.when(F.expr(where), prompts.synthesis(F.col("query_text"), F.col("context"), max_chars)))
    told = stored(providers.complete_column(asked, "_p", model, "kg_synthesis", attempts=1, timeout=timeout), "synthesis")
    text = F.trim(F.coalesce("answer", F.lit("")))
    failed = F.when(F.col("error") == "timeout", "timeout").when(F.col("error").isNotNull(), "error").when(text == "", "empty")
    sent = F.col("_p").isNotNull()
    return told.select(
        *contexts.columns,
        F.when(sent & failed.isNull(), F.substring(text, 1, max_chars)).otherwise(F.col("context")).alias("narrative"),
        F.when(sent, failed).alias("synthesis_error"),
        (sent & failed.isNull() & (F.length(text) > max_chars)).alias("truncated"),
        *(F.when(sent, F.col(c)).alias(c) for c in ("total_ms", "queue_ms", "llm_ms")),
    )


def _contexts(queries, found, shown, entities, relations, config: RunConfig) -> DataFrame:
    """query_id, query_text, context, n_chunks, has_graph: structured where the graph has something to show, else plain."""
    asked = queries.select("query_id", "query_text")
    plain = ranking.pack_context(shown, "query_id", ["rank"], "content", config.max_context_chars)
    plain = asked.join(plain, "query_id", "left").select("query_id", "query_text", F.coalesce("context", F.lit(ranking.NOTHING)).alias("context"), F.coalesce("n_docs", F.lit(0)).alias("n_chunks"))
    lines = [x.select("query_id") for x in (entities, relations) if x is not None]
    if not lines:
        return plain.withColumn("has_graph", F.lit(False))
    served = found.where("fallback IS NULL").select("query_id").distinct()  # a query that fell back shows no graph
    graphs = reduce(DataFrame.unionAll, lines).distinct().join(served, "query_id", "left_semi")
    rich = structured_context(graphs, shown, entities, relations, config.max_context_chars, config.graph.mode).withColumnRenamed("context", "_c").withColumnRenamed("n_chunks", "_n")
    both = plain.join(rich, "query_id", "left")
    return both.select("query_id", "query_text", F.coalesce("_c", "context").alias("context"), F.coalesce("_n", "n_chunks").alias("n_chunks"), F.col("_c").isNotNull().alias("has_graph"))


def evaluate(data: Dataset, config: RunConfig, embedder: providers.Embedder, model: providers.Model | None, reranker: providers.Reranker | None = None) -> tuple[DataFrame, dict]:
    """Per-query results and the report of the run."""
    began = time.monotonic()
    logs.event("run_start", dataset=config.dataset, strategy=config.strategy, dev_mode=config.dev_mode)
    if config.faults():
        raise ValueError("; ".join(config.faults()))
    if data.status == "error":
        raise ValueError(f"the dataset is not loaded: {data.error}")
    if model is None and (config.generation or config.strategy == "LIGHT_RAG"):
        raise ValueError("answers and the graph need a model")
    queries, corpus = (stored(x, "selected") for x in selected(data, config))
    spark, graphed = queries.sparkSession, config.strategy == "LIGHT_RAG"
    reranks = bool(reranker and config.rerank_top_n and not graphed)

    engine = retriever(config.strategy, embedder, model, config.graph, config.retrieval_k)
    engine.index_documents(corpus)
    fetch, measured, seen = depths(config, reranker is not None)
    found, entities, relations = engine.search(queries, fetch) if graphed else (engine.retrieve(queries, fetch), None, None)
    found = stored(found.withColumnRenamed("doc_id", "id"), "retrieved")
    events = [x for x in (getattr(engine, "events", None), (getattr(engine, "graph", None) or {}).get("events")) if x is not None]
    if graphed and engine.degraded:
        events.append(spark.createDataFrame([("retrieval_error",)], "event string"))

    listed = found.where(F.col("rank") <= measured).select("query_id", "rank", "id", F.lit(0.0).alias("distance"))
    relevant = (data.qrels if data.qrels is not None else spark.createDataFrame([], "query_id string, doc_id string")).withColumnRenamed("doc_id", "id")
    relevant = relevant.join(queries.select("query_id"), "query_id", "left_semi")
    scores = metrics.retrieval_metrics(listed, relevant)

    shown, other, reranked = found, False, queries.select("query_id", F.lit(None).cast("boolean").alias("reranked"))
    if reranks:
        texts = found.join(queries.select("query_id", "query_text"), "query_id")
        told = stored(providers.rerank_scores(texts, reranker), "rerank-scores")
        shown = stored(ranking.rerank(texts, told, seen).drop("rank").withColumnRenamed("new_rank", "rank"), "reranked")
        reranked, other = told.groupBy("query_id").agg((F.count("rerank_error") == 0).alias("reranked")), True
    elif seen < measured:
        shown, other = found.where(F.col("rank") <= seen), True
    sizes = listed.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_retrieved"))
    wanted = relevant.groupBy("query_id").agg(F.count_distinct("id").alias("n_expected"))
    hits = metrics.generation_metrics(shown, relevant) if other else queries.select("query_id", *(F.lit(None).cast("double").alias(c) for c in ("generation_hit", "generation_recall")))
    fell = found.where("fallback IS NOT NULL").groupBy("query_id").agg(F.first("fallback").alias("fallback"))
    ids = lambda rows, name: rows.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias(name))  # noqa: E731  (so many as were asked for)
    lists = [ids(listed, "retrieved_doc_ids")] + ([ids(shown, "generation_doc_ids")] if other else []) + ([ids(found, "pre_rerank_candidate_ids")] if reranks else [])
    missed = engine.errors.groupBy("query_id").agg(F.first("error").alias("retrieval_error"))
    per = queries.select("query_id", "query_text", F.col("expected_answer").alias("expected_response"))
    for part in (sizes, wanted, hits, fell, scores, reranked, missed, *lists):
        per = per.join(part, "query_id", "left")
    per = per.fillna(0, ["n_retrieved", "n_expected"])
    per = per.withColumn("strategy_used", F.lit(engine.strategy_used))
    if config.generation:
        answers, extra, more = _answers(queries, _contexts(queries, found, shown, entities, relations, config), config, embedder, model)
        per = per.join(answers, "query_id", "left").withColumn("primary_metric_value", F.col("generation_score"))
        events += more
    else:
        per = per.withColumn("generation_score", F.lit(None).cast("double")).withColumn("failure", F.lit(None).cast("string"))
    result = stored(assembled(per), "results")
    counted = statistics.operational_counters(reduce(DataFrame.unionAll, events) if events else spark.createDataFrame([], "event string"))
    strayed = result.where(F.col("strategy_used") != config.strategy).count()
    report = summary(result, config.retrieval_k) | extra | {
        "dataset": config.dataset,
        "retrieval_strategy": "FALLBACK_SIMPLE_VECTOR" if strayed else config.strategy,
        "strategy_mismatches": strayed,
        "rerank_failures": result.where("NOT reranked").count(),
        "operational_stats": {r["event"]: r["n"] for r in counted.collect()},  # seven rows
        "total_documents": corpus.count(),
        "config": redacted(asdict(config)),
        "execution_time_seconds": round(time.monotonic() - began, 2),
    }
    if graphed and engine.degraded:
        report["degraded"] = engine.degraded
    logs.event("run_complete", elapsed_s=report["execution_time_seconds"], queries_evaluated=report["n_completed"], queries_failed=report["n_failed"], hit_at_5=report["avg_hit_at_5"], mrr=report["avg_mrr"], judge_fallback_stats=report.get("judge_fallback_stats"))
    guard(report, config.judge_threshold)
    return result, report


def assembled(rows: DataFrame) -> DataFrame:
    """``rows`` with status and error_message: a query whose ``failure`` is told has failed, all others are completed."""
    failed = F.col("failure").isNotNull()
    return rows.withColumn("status", F.when(failed, "failed").otherwise("completed")).withColumn("error_message", F.col("failure")).drop("failure")


def failure_text(kind: Column, message: Column) -> Column:
    """``Type: message`` of an exception; one without a message shows itself."""
    return F.concat(kind, F.lit(": "), F.coalesce(F.nullif(message, F.lit("")), F.concat(kind, F.lit("()"))))


def guard(report: dict, threshold: float) -> None:
    """Fail the run if the metric that was guessed most often was so too often; a threshold of 0 or less switches this off."""
    metric, rate = report.get("worst_judge_metric"), report.get("worst_judge_rate", 0.0)
    if threshold > 0 and metric is not None and rate > threshold:
        logs.event("run_judge_threshold_exceeded", metric=metric, default_return_rate=round(rate, 4), threshold=threshold)
        raise JudgeGuard(f"{rate:.2%} of the answers for {metric} had no score (at most {threshold:.2%} may)", report)


def _answers(queries: DataFrame, contexts: DataFrame, config: RunConfig, embedder, model) -> tuple[DataFrame, dict, list[DataFrame]]:
    """The answer of each query with its scores, what the report says of the model's calls, and the events."""
    told = contexts.withColumn("narrative", F.col("context"))
    extra: dict = {}
    spec = dataset_config(config.dataset)
    narrated = config.strategy == "LIGHT_RAG" and config.synthesis
    if narrated:
        told = synthesized(contexts, model, config.synthesis_max_chars or config.max_context_chars, config.synthesis_timeout, "has_graph")
        extra["kg_synthesis"] = {k: round(v, 4) if isinstance(v, float) else v for k, v in statistics.synthesis_stats(told).first().asDict().items()}
        told = told.drop("total_ms", "queue_ms", "llm_ms")
    known = told.join(queries.select("query_id", "expected_answer", "answer_type"), "query_id")
    asked = known.withColumn("prompt", prompts.generation(F.col("query_text"), F.col("narrative"), config.dataset_type == "HYBRID"))
    said = stored(providers.complete_column(asked, "prompt", model, "generation", timeout=config.query_timeout), "answers")
    call = lambda phase: [F.lit(phase).alias("phase"), "error", "queue_ms", "llm_ms", "total_ms", "retries"]
    calls = [said.select(*call("generation"))]
    late = F.col("error") == "timeout"
    events = [said.where("error IS NOT NULL").select(F.lit("generation_error").alias("event"))]
    said = said.withColumn("late", F.coalesce(late, F.lit(False))).withColumn("response", F.when(F.col("error").isNotNull(), F.concat(F.lit("[ERROR: "), "error", F.lit("]"))).otherwise(strip_think(F.col("answer"))))
    said = said.select(*known.columns, "late", "response", metrics.primary_metric(F.lit(config.dataset_type), F.col("answer_type"), F.col("expected_answer"), F.lit(embedder is not None), F.lit(spec["primary"])).alias("metric"))
    said = stored(said, "responses")

    answer, expected, context, query = (F.col(c) for c in ("response", "expected_answer", "context", "query_text"))
    second = metrics.secondary_metrics(config.dataset_type, F.col("metric"), expected, spec["secondary"])
    judging = {"faithfulness": prompts.faithfulness(answer, context), "answer_relevance": prompts.answer_relevance(answer, query)}
    scored = said.join(metrics.token_f1_rows(said, "query_id", "response", "expected_answer").withColumnRenamed("f1", "_f1"), "query_id", "left")
    verdicts, opinions = [], {}
    for name, prompt in judging.items():
        on = F.col("metric") == name
        for n, also in second:
            on = (on | also) if n == name else on
        judged = stored(providers.complete_column(said.select("query_id", F.when(on, prompt).alias("prompt")).where("prompt IS NOT NULL"), "prompt", model, "judge", timeout=config.query_timeout), "judged")
        calls.append(judged.select(*call("judge")))
        read = stored(judged.withColumn("j", judge_result(F.col("answer"))), "verdicts")
        ok = F.col("error").isNull()
        verdicts.append(read.select(F.lit(name).alias("metric"), (ok & F.col("j.parse_failure")).alias("parse_failure"), (ok & F.col("j.was_default")).alias("was_default")))
        opinions[name] = F.coalesce(f"_{name}", F.lit(0.0))
        scored = scored.join(read.select("query_id", F.when(ok, F.col("j.score")).otherwise(0.0).alias(f"_{name}"), F.coalesce("error", "j.error").alias(f"_{name}_error"), F.coalesce(F.col("error") == "timeout", F.lit(False)).alias(f"_{name}_late"), F.when(ok, F.col("j.was_default")).alias(f"_{name}_default")), "query_id", "left")
    if config.dataset_type == "ADAPTED" and embedder is not None:
        scored = providers.embed_column(providers.embed_column(scored, "response", embedder, "_a", "_a_error"), "expected_answer", embedder, "_b", "_b_error")
        scored = scored.withColumn("_near", semantic_similarity(F.col("_a"), F.col("_b")))
    else:
        scored = scored.withColumn("_near", F.lit(None).cast("double"))
    values = {"f1_score": F.col("_f1"), "accuracy": metrics.accuracy(answer, expected), "exact_match": metrics.exact_match(answer, expected), "semantic_similarity": F.col("_near"), **opinions}
    of = {name: metrics.calculated(name, True, embedder is not None, values, expected, context, query) for name in metrics.METRICS}
    value, wrong = F.lit(0.0), F.lit(None).cast("string")
    for name, m in of.items():
        mine = F.col("metric") == name
        value = F.when(mine, m["value"]).otherwise(value)
        wrong = F.when(mine, F.coalesce(m["error"], F.col(f"_{name}_error")) if name in judging else m["error"]).otherwise(wrong)
    late = F.col("late") | F.coalesce("_faithfulness_late", F.lit(False)) | F.coalesce("_answer_relevance_late", F.lit(False))
    entries = [F.when(on, F.struct(F.lit(name).alias("key"), of[name]["value"].alias("value"))) for name, on in second]
    default = F.when(F.col("metric") == "faithfulness", F.col("_faithfulness_default")).when(F.col("metric") == "answer_relevance", F.col("_answer_relevance_default"))
    columns = [
        "query_id", F.col("response").alias("generated_response"), F.col("metric").alias("primary_metric_type"), F.when(~late, value).alias("generation_score"), wrong.alias("metric_error"), default.alias("judge_default"),
        F.map_from_entries(F.array_compact(F.array(*entries))).alias("secondary_metrics"), "n_chunks", "has_graph",
        F.when(late, failure_text(F.lit("TimeoutError"), F.lit(""))).alias("failure"),
    ]
    if narrated:
        columns += [F.col("synthesis_error").alias("kg_synthesis_error"), (F.col("has_graph") & F.col("synthesis_error").isNull()).alias("kg_synthesis_used")]
        for at, c in (("synth", "narrative"), ("gen", "response")):
            cited = citations(F.col(c), F.col("n_chunks"))
            columns += [F.when(F.col("has_graph"), cited[k]).alias(f"citation_refs_{at}_{k.removesuffix('_refs')}") for k in ("total", "valid", "malformed", "in_range", "out_of_range", "distinct_refs", "coverage_ratio")]
    all_calls = stored(reduce(DataFrame.unionAll, calls), "calls")
    extra["calls"] = {r["phase"]: {k: v for k, v in r.asDict().items() if k != "phase"} for r in statistics.phase_times(all_calls).orderBy("phase").collect()}  # one row a phase
    extra["service"] = statistics.service_totals(all_calls.withColumnRenamed("total_ms", "latency_ms")).first().asDict()
    fallbacks = stored(statistics.judge_stats(reduce(DataFrame.unionAll, verdicts)), "judge-stats")
    worst = statistics.worst_judge(fallbacks).first()
    extra |= {"judge_fallback_stats": {r["metric"]: {k: v for k, v in r.asDict().items() if k != "metric"} for r in fallbacks.collect()}, "worst_judge_metric": worst["metric"], "worst_judge_rate": worst["rate"]}  # one row a metric
    return scored.select(*columns), extra, events


def run_totals(results: DataFrame) -> DataFrame:
    """One row: averages over the completed queries; what is missing counts 0."""
    done = results.where("status = 'completed'")
    mean = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0.0))) / F.count(F.lit(1)), F.lit(0.0))
    return done.agg(
        F.count(F.lit(1)).alias("n_completed"),
        *(mean(c).alias(f"avg_{c}") for c in ("hit_at_5", "mrr", "recall_at_5", "ndcg_at_5", "generation_score")),
        (1 - mean("recall_at_5")).alias("avg_missed_at_5"),
        F.count_if(F.col("generation_score") == 0).alias("n_zero"),
        F.count_if(F.col("generation_score") > 0).alias("n_scored"),
    )


def generation_totals(results: DataFrame, retrieval_k: int) -> DataFrame:
    """One row: averages over the completed queries whose answer saw a list of its own (null without any), and how many that
    list rescued: its recall is above that at ``retrieval_k``, which counts 0 where it is not among the measured depths."""
    own = results.where("status = 'completed' AND generation_recall IS NOT NULL")
    at = f"recall_at_{retrieval_k}"
    recall = F.coalesce(F.col(at), F.lit(0.0)) if at in results.columns else F.lit(0.0)
    return own.agg(F.avg("generation_recall").alias("avg_generation_recall"), F.avg("generation_hit").alias("avg_generation_hit"), F.count_if(F.col("generation_recall") > recall).alias("reranker_rescue_count"))


def summary(results: DataFrame, retrieval_k: int = 20) -> dict:
    """The figures of a report: averages to 4 places, sizes of lists to 1."""
    row = run_totals(results).first().asDict() | generation_totals(results, retrieval_k).first().asDict()
    mean = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0.0))) / F.count(F.lit(1)), F.lit(0.0))
    curves = [f"{m}_at_{k}" for m in ("recall", "ndcg") for k in metrics.KS]
    more = results.where("status = 'completed'").agg(*(mean(c).alias(c) for c in curves), mean("n_retrieved").alias("retrieved"), mean("n_expected").alias("expected"), F.count_if(F.col("fallback").isNotNull()).alias("fallbacks")).first()
    out = {k: round(v, 4) if isinstance(v, float) else v for k, v in row.items()} | {"n_failed": results.where("status = 'failed'").count()}
    out |= {f"avg_{m}_at_k": {k: round(more[f"{m}_at_{k}"], 4) for k in metrics.KS} for m in ("recall", "ndcg")}
    out["complement_recall_at_k"] = {k: round(1 - more[f"recall_at_{k}"], 4) for k in metrics.KS}
    return out | {"avg_retrieved_count": round(more["retrieved"], 1), "avg_expected_count": round(more["expected"], 1), "n_fallbacks": more["fallbacks"]}
