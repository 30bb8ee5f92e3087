"""Exact deduplication by a heavy-hitter split, in DataFrame functions only.

Digests go through a frequent-items sketch of the Misra-Gries family (``approx_top_k``). The
digests it names are counted exactly, which gives each its verified winner; that table has
``heavy_k`` rows at most, whatever the input, and is broadcast, so rows of very large groups are
settled where they are read. All other digests take an ordinary shuffle, in which no group is large.

Cases: a null text counts as empty; equal texts are those identical after lower-casing A-Z. Of equal
texts the row with the largest id stays; a null id never wins against another and forms a keep_id of
null when the whole group has none. Rows that repeat an id count towards ``group_size``; in
``exact_duplicates`` all rows with the winning id are ``kept``, in ``drop_exact_duplicates`` one of
them stays. An empty table gives an empty result. Extra columns are ignored by the former and
returned by the latter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table, text_or_empty, without

#: Digests that are broadcast at most, and counters of the sketch.
HEAVY_K = 1_000
COUNTERS = 10_000


def normalised(column: str) -> Column:
    return F.translate(text_or_empty(column), string.ascii_uppercase, string.ascii_lowercase)


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, digest) of every row, stored: all later passes read this narrow table, not the texts."""
    return stored(docs.select(F.col(id_col).alias("id"), F.sha2(normalised(text_col), 256).alias("digest")), "digests")


def heavy_winners(rows: DataFrame, heavy_k: int = HEAVY_K, counters: int = COUNTERS) -> DataFrame:
    """(digest, keep_id, group_size), exact, of the digests that the sketch names: ``heavy_k`` rows at most."""
    named = rows.agg(F.expr(f"approx_top_k(digest, {heavy_k}, {counters})").alias("top")).select(F.explode("top").alias("t")).select(F.col("t.item").alias("digest"))
    return (
        rows.join(F.broadcast(named), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )


def exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", heavy_k: int = HEAVY_K, counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, text_col, id_col)
    winners = stored(heavy_winners(rows, heavy_k, counters), "winners")
    marked = rows.join(F.broadcast(winners), "digest", "left")
    settled = marked.where("group_size is not null")
    rest = marked.where("group_size is null").select("digest", "id")
    groups = rest.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    both = settled.select("digest", "id", "keep_id", "group_size").unionByName(rest.join(groups, "digest").select("digest", "id", "keep_id", "group_size"))
    return both.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Only the narrow rows of groups of several are joined to the texts, so the texts of the others are read once more and stay where they are.
    """
    found = exact_duplicates(docs, text_col, id_col).where("group_size > 1")
    members = stored(found.select(F.col(id_col).alias("id"), F.col("text_sha256").alias("key"), F.col("kept").alias("stays")), "members")
    return without(docs, members, F.sha2(normalised(text_col), 256), id_col)


def op9(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
