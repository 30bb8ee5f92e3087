"""Counts and times of calls over event-time windows (an extension: the batch form is ``call_times``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_calls(calls: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """phase, start, n_calls, mean_ms, max_ms of (ts, phase, llm_ms) rows, for a stream or a table."""
    marked = calls.withWatermark("ts", late) if calls.isStreaming else calls
    return marked.groupBy(F.window("ts", window).alias("w"), "phase").agg(F.count(F.lit(1)).alias("n_calls"), F.avg("llm_ms").alias("mean_ms"), F.max("llm_ms").alias("max_ms")).select("phase", F.col("w.start").alias("start"), "n_calls", "mean_ms", "max_ms")
