"""From raw documents to a training mixture: five of the training-data operators, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next one; all but the last return the columns of ``documents``.

1. quality: documents that the classifier predicts to be of low quality go
2. exact_dedup: of equal texts the document with the largest id stays
3. near_dedup: of each class of similar texts the document with the smallest id stays
4. decontaminate: documents that contain a benchmark item go
5. mix: documents are replicated to the target weights of their sources, in a global random order

Nulls, empty texts, ties, repeated rows, empty tables and columns with clashing names: as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import stored, table
from spindrift.llm.decontaminate import drop_contaminated
from spindrift.llm.exact_dedup import drop_exact_duplicates
from spindrift.llm.jaccard import drop_similar
from spindrift.llm.mixing import mix
from spindrift.llm.quality import THRESHOLD, score_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = score_quality(docs, table(spark, sf_dir, "labels"))
    return scored.where(F.col(scored.columns[len(docs.columns)]) >= THRESHOLD).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mixture)]

#: The classifier and the classes of similar texts are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
