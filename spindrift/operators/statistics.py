"""Counts and times of datasets, calls and judges, each as one plan of aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The events that a run counts.
EVENTS = ["neighbor_lookup_failure", "chunk_keywords_vdb_error", "description_synthesis_error", "gleaning_error", "keywords_parse_failure", "retrieval_error", "generation_error"]
PERCENTILES = (0.5, 0.95)


def percentiles(rows: DataFrame, group: list[str], value: str, ps: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """group, n, p50, p95, ..., max: the value at place min(n - 1, floor(p n)) of the sorted ones, nulls aside.

    Equal values are counted before they are sorted, and only running sums of the counts meet in a group's task, so no group is ever one row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    by = Window.partitionBy(*(group or [F.lit(0)]))
    placed = counted.withColumn("_to", F.sum("_n").over(by.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_all", F.sum("_n").over(by))

    def at(p: float):
        place = F.least(F.col("_all") - 1, F.floor(F.lit(p) * F.col("_all")))
        return F.max(F.when((F.col("_to") > place) & (F.col("_to") - F.col("_n") <= place), F.col("_v")))

    return placed.groupBy(*group).agg(F.max("_all").alias("n"), *(at(p).alias(f"p{round(100 * p)}") for p in ps), F.max("_v").alias("max"))


def timings(rows: DataFrame, group: list[str], families: list[str]) -> DataFrame:
    """group and, for each family ``x`` (a column ``x_ms``): n_x_samples, p50_x_ms, p95_x_ms, max_x_ms, rounded to 1 place, 0 without samples."""
    if not group:
        return timings(rows.withColumn("_g", F.lit(0)), ["_g"], families).drop("_g")
    keys = rows.select(*group).distinct()
    parts = []
    for x in families:
        t = percentiles(rows, group, f"{x}_ms")
        parts.append(t.select(*group, F.col("n").alias(f"n_{x}_samples"), *(F.col(c).alias(f"{c}_{x}_ms") for c in ("p50", "p95", "max"))))
    joined = reduce(lambda a, b: a.join(b, group, "left"), parts, keys)
    figures = [c for c in joined.columns if c not in group]
    return joined.select(*group, *((F.coalesce(c, F.lit(0)) if c.startswith("n_") else F.round(F.coalesce(c, F.lit(0.0)), 1)).alias(c) for c in figures))


def phase_times(calls: DataFrame) -> DataFrame:
    """phase, invocations, and the times in queue and at the model, of (phase, queue_ms, llm_ms); a null time is no sample."""
    named = calls.withColumn("phase", F.coalesce("phase", F.lit("unknown")))
    return named.groupBy("phase").agg(F.count(F.lit(1)).alias("invocations")).join(timings(named, ["phase"], ["queue", "llm"]), "phase")


def synthesis_stats(told: DataFrame) -> DataFrame:
    """One row: how often a narrative was asked for, how that ended, and three families of times.

    Takes synthesis_error (null, error, empty or timeout), truncated, total_ms (null: not asked for), queue_ms, llm_ms.
    """
    sent = told.where("total_ms IS NOT NULL").withColumn("_g", F.lit(0))
    n = F.count(F.lit(1))
    one = lambda reason: F.count_if(F.col("synthesis_error") == reason)
    counts = sent.agg(
        n.alias("invocations"),
        F.count_if(F.col("synthesis_error").isNull()).alias("successes"),
        one("error").alias("errors"),
        one("empty").alias("empty_returns"),
        F.count_if("truncated").alias("truncations"),
        one("timeout").alias("timeouts"),
        F.coalesce(F.count_if(F.col("synthesis_error").isNotNull()) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("fallback_rate"),
    )
    times = timings(sent, ["_g"], ["total", "queue", "llm"])
    joined = counts.withColumn("_g", F.lit(0)).join(times, "_g", "left").drop("_g")
    return joined.select(*counts.columns, *(F.coalesce(c, F.lit(0) if c.startswith("n_") else F.lit(0.0)).alias(c) for c in times.columns if c != "_g"))


def operational_counters(events: DataFrame) -> DataFrame:
    """event, n: a row for each of ``EVENTS``, 0 where none of (event) is; other events are not counted."""
    names = events.sparkSession.createDataFrame([(e,) for e in EVENTS], "event string")
    return names.join(events.groupBy("event").agg(F.count(F.lit(1)).alias("n")), "event", "left").select("event", F.coalesce("n", F.lit(0)).alias("n"))


def service_totals(calls: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Requests, how many succeeded, their share, mean latency and retries of (error, latency_ms, retries); zeros without calls."""
    n, good = F.count(F.lit(1)), F.count_if(F.col("error").isNull())
    return calls.groupBy(*(by or [])).agg(
        n.alias("total_requests"),
        good.alias("successful_requests"),
        (n - good).alias("failed_requests"),
        F.coalesce(good / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.sum("latency_ms") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.sum("retries"), F.lit(0)).cast("long").alias("retries_total"),
    )


def dataset_statistics(queries: DataFrame, qrels: DataFrame | None, corpus: DataFrame) -> DataFrame:
    """One row: queries, those with an answer, those with a relevant document, documents."""
    asked = queries.agg(F.count(F.lit(1)).alias("queries_loaded"), F.count_if(F.coalesce("expected_answer", F.lit("")) != "").alias("queries_with_text_answer"))
    relevant = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi") if qrels is not None else queries.limit(0)
    held = relevant.agg(F.count(F.lit(1)).alias("queries_with_relevant_docs"))
    stored = corpus.agg(F.count(F.lit(1)).alias("corpus_loaded"))
    parts = [x.withColumn("_g", F.lit(0)) for x in (asked, held, stored)]  # one row each
    return reduce(lambda a, b: a.join(b, "_g"), parts).drop("_g")


def judge_stats(judged: DataFrame) -> DataFrame:
    """metric, invocations, parse_failures, default_returns and their rates, of (metric, parse_failure, was_default)."""
    n, bad, guessed = F.count(F.lit(1)), F.count_if("parse_failure"), F.count_if("was_default")
    return judged.groupBy("metric").agg(n.alias("invocations"), bad.alias("parse_failures"), guessed.alias("default_returns"), (bad / n).alias("parse_failure_rate"), (guessed / n).alias("default_return_rate"))


def worst_judge(stats: DataFrame) -> DataFrame:
    """One row: the metric of the highest rate of defaults (the first by name of equal ones; null if no rate is above 0), and the rate."""
    rate = F.col("default_return_rate")
    return stats.where(rate > 0).agg(F.min_by("metric", F.struct(-rate, "metric")).alias("metric"), F.coalesce(F.max(rate), F.lit(0.0)).alias("rate"))
