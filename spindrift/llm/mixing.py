"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate: its share of the wanted total over its number of documents.
Each document inverts the Poisson distribution with that mean at a uniform number hashed from its id
and a seed, is exploded by the resulting count, and all copies are shuffled into one global order
by a second hash. A rate above ``PART`` is the sum of as many equal rates of ``PART`` at most, each inverted at a hash of its own
(sums of independent Poisson numbers are one), so plans hold one table of at most some hundred numbers for a source, and a document
costs time in proportion to its copies. The table of sources comes from the weights, a parameter, so nothing that grows
with the data is collected or broadcast, and no join on the (skewed) source happens.

Cases: a source that the weights do not name, and a null source, belong to the remainder, which has the
weight ``other``. A weight of 0 drops the source. Null ids hash as the text ``null``; rows that
repeat an id are drawn alike. Null, empty and very long texts travel as they are. The counts of a part stop at the first n whose tail is below 2**-60. An empty
table gives an empty result. Columns already called ``copy``, ``mix_rate`` or ``shuffle_key`` keep
their name; the new ones then get an underscore in front.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, table

#: Wanted shares of the mixture by source; the rest of the sources share ``OTHER``.
WEIGHTS = {"src0": 0.15, "src1": 0.10, "src2": 0.10, "src3": 0.08, "src4": 0.07, "src5": 0.05}
OTHER = 0.45
#: Copies in the mixture for each document of the input, on average.
EPOCHS = 1.0
SEED = 17


#: Largest mean that is inverted at once.
PART = 32.0


def uniform(id_col: str, seed: int, part: Column) -> Column:
    """Hash-seeded number in [0, 1): the first 52 bits of a digest of seed, part and id."""
    key = F.concat(F.lit(f"{seed}:"), part.cast("string"), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def parts_of(rate: float) -> int:
    return max(1, math.ceil(rate / PART))


def poisson_cdf(rate: float) -> list[float]:
    """P(N <= n) for n = 0, 1, ... until the rest is below 2**-60; for rates up to ``PART``."""
    n, p = 0, math.exp(-rate)
    total, out = p, [p]
    while n < rate or p > 2.0**-60:
        n += 1
        p *= rate / n
        total += p
        out.append(min(total, 1.0))
    return out


def drawn_count(rate: float, id_col: str, seed: int) -> Column:
    """The Poisson number of a row."""
    parts = parts_of(rate)
    cdf = F.array(*map(F.lit, poisson_cdf(rate / parts)))
    of = lambda part: F.size(F.filter(cdf, lambda c: c <= uniform(id_col, seed, part)))
    if parts == 1:
        return of(F.lit(0))
    return F.aggregate(F.sequence(F.lit(0), F.lit(parts - 1)), F.lit(0), lambda total, part: total + of(part))


def rates(docs: DataFrame, weights: dict[str, float], other: float, epochs: float, source_col: str = "source") -> dict[str | None, float]:
    """Mean repetition rate by source named in ``weights``; at None that of the remainder."""
    named = F.when(F.col(source_col).isin(list(weights)), F.col(source_col))
    sizes = {r["s"]: r["n"] for r in docs.groupBy(named.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}  # len(weights) + 1 rows at most
    total, all_weights = sum(sizes.values()) * epochs, sum(weights.values()) + other
    return {s: (weights.get(s, other) if s is not None else other) / all_weights * total / n for s, n in sizes.items()}


def mix(docs: DataFrame, weights: dict[str, float] = WEIGHTS, other: float = OTHER, epochs: float = EPOCHS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Every copy of every document, in a global random order; adds copy, mix_rate and shuffle_key."""
    copy, rate_name, key = (free_name(docs, n) for n in ("copy", "mix_rate", "shuffle_key"))
    by_source = rates(docs, weights, other, epochs, source_col)
    named = F.when(F.col(source_col).isin(list(weights)), F.col(source_col))
    rate, count = F.lit(None).cast("double"), F.lit(0)
    n_name = free_name(docs, "_n")
    for s, r in by_source.items():
        here = named.isNull() if s is None else F.coalesce(named == s, F.lit(False))
        rate, count = F.when(here, F.lit(r)).otherwise(rate), F.when(here, drawn_count(r, id_col, seed)).otherwise(count)
    drawn = docs.withColumn(rate_name, rate).withColumn(n_name, count).where(F.col(n_name) > 0)
    copies = drawn.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n_name))))
    order = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit("/"), F.col(copy).cast("string")))
    return copies.withColumn(key, order).drop(n_name).orderBy(key)


def op2(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mix_sql(docs: str, weights: dict[str, float] = WEIGHTS, other: float = OTHER, epochs: float = EPOCHS, seed: int = SEED) -> str:
    """The same mixture of the relation ``docs`` in DuckDB SQL; the recursion sums the same terms in the same order."""
    listed = ", ".join(f"('{s}', {w!r}::DOUBLE)" for s, w in weights.items())
    share = f"CASE WHEN s IS NULL THEN {other!r}::DOUBLE ELSE w END / {sum(weights.values()) + other!r}::DOUBLE * ((SELECT count(*) FROM {docs}) * {epochs!r}::DOUBLE)"
    return f"""
weights AS (SELECT * FROM (VALUES {listed}) AS v(s, w)),
sizes AS (SELECT w.s, any_value(w.w) AS w, count(*) AS n FROM {docs} d LEFT JOIN weights w ON d.source = w.s GROUP BY w.s),
rates AS (SELECT s, rate, greatest(1, ceil(rate / {PART!r}::DOUBLE))::BIGINT AS parts FROM (SELECT s, {share} / n AS rate FROM sizes)),
terms AS (
  SELECT s, rate / parts AS r, 0 AS k, exp(-(rate / parts)) AS p, exp(-(rate / parts)) AS cdf FROM rates
  UNION ALL
  SELECT s, r, k + 1, p * (r / (k + 1)), least(cdf + p * (r / (k + 1)), 1.0) FROM terms WHERE k < r OR p > pow(2.0, -60)
),
tables AS (SELECT s, list(cdf ORDER BY k) AS cdfs FROM terms GROUP BY s),
counted AS (
  SELECT d.*, r.rate AS mix_rate, list_sum([len(list_filter(t.cdfs, lambda c: c <= ('0x' || substr(md5('{seed}:' || part || ':' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / pow(2.0, 52))) FOR part IN range(0, r.parts)]) AS reps
  FROM {docs} d LEFT JOIN weights w ON d.source = w.s JOIN rates r ON r.s IS NOT DISTINCT FROM w.s JOIN tables t ON t.s IS NOT DISTINCT FROM w.s
)
SELECT * EXCLUDE (reps), CAST(copy AS INTEGER) AS copy, md5('{seed}/' || coalesce(doc_id::VARCHAR, 'null') || '/' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, reps::BIGINT + 1)) AS copy FROM counted WHERE reps > 0)
"""


ORACLE_SQL = "WITH RECURSIVE " + mix_sql("documents").strip().replace("SELECT * EXCLUDE (reps), CAST", "SELECT * EXCLUDE (reps, copy), CAST")
