"""What the training-data operators share: tables, null handling, names."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import partitions, scratch, shared_dir, stored

__all__ = ["free_name", "partitions", "scratch", "sent", "shared_dir", "stored", "table", "text_or_empty", "without"]

#: Narrow rows that are broadcast at most; more are joined by a shuffle.
SENT_ROWS = 250_000

# Functions of this package travel to the workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules["spindrift"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so (letter case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sent(narrow: DataFrame) -> DataFrame:
    """A stored table of narrow rows for a join with texts: broadcast if it has ``SENT_ROWS`` rows or fewer, by a count of it."""
    return F.broadcast(narrow) if narrow.count() <= SENT_ROWS else narrow


def without(docs: DataFrame, members: DataFrame, key: Column, id_col: str) -> DataFrame:
    """``docs`` less the rows whose (id, key) does not stay, and with one of those that repeat one that does.

    ``members``: a stored table (id, key, stays) of the groups of several rows only. The texts of all other rows are read once and never shuffled
    while ``members`` can be broadcast.
    """
    row_id, row_key, hit_id, hit_key = (free_name(docs, n) for n in ("_row_id", "_row_key", "_hit_id", "_hit_key"))
    keyed = docs.withColumn(row_id, F.col(id_col).cast(members.schema["id"].dataType)).withColumn(row_key, key)
    named = members.select(F.col("id").alias(hit_id), F.col("key").alias(hit_key), "stays")
    same = F.col(row_id).eqNullSafe(F.col(hit_id)) & (F.col(row_key) == F.col(hit_key))
    out = keyed.join(sent(named.where("not stays").drop("stays")), same, "left_anti")
    again = named.where("stays").groupBy(hit_id, hit_key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if again.limit(1).count():  # some row repeats id and text
        out = out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([row_id, row_key]))
    return out.drop(row_id, row_key)
