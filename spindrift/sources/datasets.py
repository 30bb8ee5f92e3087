"""Datasets, chunk collections, graph exports and run reports on any file system that Spark reads."""

from __future__ import annotations

import json
import os
import shutil
import tarfile
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, coerce_int, safe_str

#: What a collection's manifest must have, and the version of a stored graph.
MANIFEST_KEYS = ("contract_version", "schema_version", "collection_id", "generation", "num_chunks", "max_chunk_chars", "parts")
GRAPH_VERSION = 3
SECRET_WORDS = ("key", "secret", "token", "password", "credential")


#: What is known of the datasets, by name; of any other, relevance alone is measured.
DATASETS = {"hotpotqa": {"type": "HYBRID", "primary": "f1_score", "secondary": ["exact_match", "faithfulness"]}}
OTHER_DATASET = {"type": "RETRIEVAL_ONLY", "primary": "faithfulness", "secondary": ["answer_relevance"]}


def dataset_name(name: str) -> str:
    return name.lower().replace("-", "").replace("_", "")


def dataset_config(name: str) -> dict:
    """Kind, primary metric and secondary metrics of a dataset, whatever the spelling of its name."""
    return DATASETS.get(dataset_name(name), OTHER_DATASET)


@dataclass
class Dataset:
    queries: DataFrame | None = None
    corpus: DataFrame | None = None
    qrels: DataFrame | None = None
    status: str = "loaded"
    error: str | None = None
    header: dict = field(default_factory=dict)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_json(spark: SparkSession, path: str) -> dict | None:
    """A JSON object; None if the file is missing or holds something else."""
    if not exists(spark, path):
        return None
    try:
        value = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def normalized_queries(raw: DataFrame) -> DataFrame:
    """query_id, query_text, expected_answer, answer_type, question_type, level."""
    col = lambda c: safe_str(F.col(c)) if c in raw.columns else F.lit("")
    answer = blank_to_null(col("answer"))
    question = F.coalesce(blank_to_null(col("question_type")), blank_to_null(col("type")), F.lit(""))
    stated = F.when(col("answer_type").isin("text", "label", "counter_argument"), col("answer_type"))
    kind = F.when(question == "comparison", "label").when(col("answer_type") != "", stated).when(answer.isNotNull(), "text")
    return raw.select(col("query_id").alias("query_id"), col("text").alias("query_text"), answer.alias("expected_answer"), kind.alias("answer_type"), question.alias("question_type"), col("level").alias("level"))


def relevant_lists(queries: DataFrame, qrels: DataFrame | None) -> DataFrame:
    """``queries`` with relevant_doc_ids: the distinct documents that the judgements (query_id, doc_id) name, in order; empty where none does."""
    none = F.array().cast("array<string>")
    if qrels is None:
        return queries.withColumn("relevant_doc_ids", none)
    listed = qrels.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("_r"))
    return queries.join(listed, "query_id", "left").withColumn("relevant_doc_ids", F.coalesce("_r", none)).drop("_r")


def load_dataset(spark: SparkSession, root: str, name: str, cache: str | None = None) -> Dataset:
    """queries, corpus and (optional) qrels below root/name; any error becomes a status and never raises."""
    base = f"{cache}/{name}" if cache and exists(spark, f"{cache}/{name}/queries.parquet") else f"{root}/{name}"
    try:
        queries = normalized_queries(spark.read.parquet(f"{base}/queries.parquet"))
        docs = spark.read.parquet(f"{base}/corpus.parquet")
        col = lambda c: safe_str(F.col(c)) if c in docs.columns else F.lit("")
        corpus = docs.select(col("doc_id").alias("doc_id"), col("title").alias("title"), col("text").alias("content"))
        qrels = None
        if exists(spark, f"{base}/qrels.parquet"):
            qrels = spark.read.parquet(f"{base}/qrels.parquet").select(safe_str(F.col("query_id")).alias("query_id"), safe_str(F.col("doc_id")).alias("doc_id"))
    except Exception as e:  # the contract: a status instead of an error
        return Dataset(status="error", error=f"{type(e).__name__}: {str(e)[:300]}")
    return Dataset(queries, corpus, qrels, header=read_json(spark, f"{base}/metadata.json") or {})


def save_cache(data: Dataset, cache: str, name: str) -> None:
    data.queries.select("query_id", F.col("query_text").alias("text"), F.col("expected_answer").alias("answer"), "answer_type", "question_type", "level").write.mode("overwrite").parquet(f"{cache}/{name}/queries.parquet")
    data.corpus.select("doc_id", "title", F.col("content").alias("text")).write.mode("overwrite").parquet(f"{cache}/{name}/corpus.parquet")
    if data.qrels is not None:
        data.qrels.withColumn("relevance", F.lit(1)).write.mode("overwrite").parquet(f"{cache}/{name}/qrels.parquet")


class ContractError(ValueError):
    """A chunk collection breaks its contract."""


def check_manifest(manifest: dict | None, collection_id: str) -> dict:
    if manifest is None:
        raise ContractError("the manifest is missing")
    lacking = [k for k in MANIFEST_KEYS if k not in manifest]
    if lacking:
        raise ContractError(f"the manifest lacks {', '.join(lacking)}")
    if manifest["collection_id"] != collection_id:
        raise ContractError("the manifest is of another collection")
    if not manifest["parts"] or any("path" not in p or "num_rows" not in p for p in manifest["parts"]):
        raise ContractError("the manifest needs parts, each with path and num_rows")
    if not manifest["max_chunk_chars"] > 0:
        raise ContractError("max_chunk_chars must be positive")
    return manifest


def chunk_faults(chunks: DataFrame, collection_id: str, cap: int) -> dict[str, int]:
    """How many rows break each rule, where any does."""
    return {k: v for k, v in fault_counts(chunks, collection_id, cap).first().asDict().items() if v}


def fault_counts(chunks: DataFrame, collection_id: str, cap: int) -> DataFrame:
    """One row: how many rows break each rule, in one aggregation; repeated ids by another."""
    text = F.coalesce("text", F.lit(""))
    bad = chunks.agg(
        F.count_if(F.coalesce("chunk_id", F.lit("")) == "").alias("empty_id"),
        F.count_if(~F.col("collection_id").eqNullSafe(F.lit(collection_id))).alias("foreign"),
        F.count_if(text == "").alias("empty_text"),
        F.count_if(F.length(text) > cap).alias("too_long"),
    )
    repeated = chunks.groupBy("chunk_id").count().where("count > 1").agg(F.count(F.lit(1)).alias("repeated_id"))
    return bad.withColumn("_g", F.lit(0)).join(repeated.withColumn("_g", F.lit(0)), "_g").drop("_g")  # one row each


def load_collection(spark: SparkSession, root: str, collection_id: str) -> DataFrame:
    """The checked rows of a collection; only the files that its manifest lists are read."""
    manifest = check_manifest(read_json(spark, f"{root}/{collection_id}/collection.json"), collection_id)
    parts = {f"{root}/{collection_id}/{p['path']}": p["num_rows"] for p in manifest["parts"]}
    lacking = [p for p in parts if not exists(spark, p)]
    if lacking:
        raise ContractError(f"parts are missing: {lacking[:3]}")
    raw = spark.read.parquet(*parts)
    sizes = {r[0].rsplit("/", 1)[-1]: r[1] for r in raw.groupBy("_metadata.file_path").count().collect()}  # a row per listed part
    wrong = [p for p, n in parts.items() if sizes.get(p.rsplit("/", 1)[-1], 0) != n]
    if wrong or sum(parts.values()) != manifest["num_chunks"]:
        raise ContractError(f"rows differ from the manifest: {wrong[:3]}")
    faults = chunk_faults(raw, collection_id, manifest["max_chunk_chars"])
    if faults:
        raise ContractError(f"rows break the contract: {faults}")
    text = lambda c: safe_str(F.col(c)).alias(c) if c in raw.columns else F.lit("").alias(c)
    number = lambda c: (coerce_int(F.col(c)) if c in raw.columns else F.lit(None).cast("int")).alias(c)
    return raw.select("chunk_id", "collection_id", "text", *map(text, ("document_id", "source_file")), *map(number, ("chunk_index", "page_start", "page_end", "token_count")))


def write_collection(chunks: DataFrame, root: str, collection_id: str, max_chunk_chars: int, generation: int = 1) -> dict:
    """Parts first, the manifest last: a reader sees a whole collection or none."""
    spark, base = chunks.sparkSession, f"{root}/{collection_id}"
    chunks.write.mode("overwrite").parquet(f"{base}/parts")
    sizes = spark.read.parquet(f"{base}/parts").groupBy("_metadata.file_path").count().collect()
    parts = [{"path": f"parts/{r[0].rsplit('/', 1)[-1]}", "num_rows": r[1]} for r in sizes]
    manifest = dict(zip(MANIFEST_KEYS, ("1", 1, collection_id, generation, sum(p["num_rows"] for p in parts), max_chunk_chars, parts), strict=True))
    write_text(spark, f"{base}/collection.json", json.dumps(manifest))
    return manifest


def fingerprint(corpus: DataFrame, max_text_chars: int, max_entities: int) -> str:
    """16 digits that name a corpus and the settings of its graph: digests of rows, folded in order of id by prefix of the id's digest."""
    rows = corpus.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("k"), F.sha2(F.concat_ws("‖", F.col("doc_id").cast("string"), "content"), 256).alias("h"))
    parts = rows.groupBy(F.substring("k", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    one = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "").alias("h"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))  # 4096 parts at most
    return one.select(F.substring(F.sha2(F.concat("h", F.lit("n="), "n", F.lit(f"mtc={max_text_chars}me={max_entities}")), 256), 1, 16)).first()[0]


def save_graph(tables: dict[str, DataFrame], path: str, print_: str = "") -> None:
    spark = next(iter(tables.values())).sparkSession
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    write_text(spark, f"{path}/kg.json", json.dumps({"version": GRAPH_VERSION, "fingerprint": print_, "tables": sorted(tables)}))


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables of a stored graph; None if there is none or its version is older."""
    header = read_json(spark, f"{path}/kg.json")
    if header is None or header.get("version", 0) < GRAPH_VERSION:
        return None
    return {name: spark.read.parquet(f"{path}/{name}.parquet") for name in header["tables"]}


def redacted(config: dict) -> dict:
    """A copy of the settings without anything that may be secret."""
    return {k: redacted(v) if isinstance(v, dict) else "***" if any(w in k.lower() for w in SECRET_WORDS) and isinstance(v, str) else v for k, v in config.items()}


#: What of a query's retrieval is told in a report, and the lists that are told by their sizes.
TOLD = (
    "kg_fallback kg_chunk_keyword_matches kg_synthesis_used kg_synthesis_error lightrag_mode graph_active kg_entities_with_neighbors kg_mean_neighbors_per_entity kg_budget_cap_triggered".split()
    + [f"citation_refs_{at}_{what}" for at in ("synth", "gen") for what in "total valid malformed in_range out_of_range distinct coverage_ratio".split()]
)
COUNTED = ["kg_entities", "kg_relations"]


def retrieval_metadata(columns: list[str]) -> Column:
    """A struct of what may be told, of the columns that there are; null if there are none of them. A null stays out of the JSON."""
    parts = [F.col(c) for c in TOLD if c in columns] + [F.coalesce(F.size(c), F.lit(0)).alias(f"{c}_count") for c in COUNTED if c in columns]
    return F.struct(*parts) if parts else F.lit(None).cast("struct<none:int>")


def query_reports(results: DataFrame) -> DataFrame:
    """query_id, report: one JSON object a query, its figures to 4 places; blocks that do not apply are left out."""
    have = results.columns
    r4 = lambda c: F.bround(F.col(c).cast("double"), 4).alias(c)
    plain = [F.col(c) for c in ("query_id", "query_text", "retrieved_doc_ids", "generated_response", "expected_response", "primary_metric_type", "status") if c in have]
    curves = [F.struct(*(F.col(f"{m}_at_{k}").alias(str(k)) for k in (1, 3, 5, 10, 20) if f"{m}_at_{k}" in have)).alias(f"{m}_at_k") for m in ("hit", "recall", "ndcg") if f"{m}_at_1" in have]
    own = F.size("generation_doc_ids") > 0 if "generation_doc_ids" in have else F.lit(False)
    listed = [F.when(own, F.col(c) if c.endswith("ids") else F.bround(c, 4)).alias(c) for c in ("generation_doc_ids", "generation_recall", "generation_hit") if c in have]
    before = [F.when(F.size("pre_rerank_candidate_ids") > 0, F.col("pre_rerank_candidate_ids")).alias("pre_rerank_candidate_ids")] if "pre_rerank_candidate_ids" in have else []
    extra = [F.when(F.col("reranked").isNotNull(), F.struct("reranked")).alias("metadata")] if "reranked" in have else []
    second = [F.transform_values("secondary_metrics", lambda k, v: F.bround(v, 4)).alias("secondary_metrics")] if "secondary_metrics" in have else []
    told = retrieval_metadata(have)
    some = F.to_json(told) != "{}"
    figures = [r4(c) for c in ("mrr", "primary_metric_value") if c in have]
    whole = F.struct(*plain, *figures, *curves, *second, *listed, *before, *extra, F.when(some, told).alias("retrieval_metadata"))
    return results.select("query_id", F.to_json(whole).alias("report"))


def write_report(spark: SparkSession, path: str, report: dict) -> None:
    write_text(spark, path, json.dumps(report | {"config": redacted(report.get("config", {}))}, default=str))


def export_collection(spark: SparkSession, root: str, collection_id: str, archive: str) -> int:
    """A collection as a gzip tar at the local path ``archive``: the manifest and the parts that it lists. Returns the parts.

    Files pass the driver one at a time, in slices; the archive itself is the one local file.
    """
    manifest = check_manifest(read_json(spark, f"{root}/{collection_id}/collection.json"), collection_id)
    names = ["collection.json", *(p["path"] for p in manifest["parts"])]
    with tarfile.open(archive, "w:gz") as tar, tempfile.TemporaryDirectory() as held:
        for n in names:
            fs, p = _fs(spark, f"{root}/{collection_id}/{n}")
            local = f"{held}/part"
            fs.copyToLocalFile(False, p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local}"), True)
            tar.add(local, f"{collection_id}/{n}")
            os.remove(local)
    return len(names) - 1


def import_collection(spark: SparkSession, archive: str, root: str, collection_id: str) -> dict:
    """The collection of an archive below ``root``, its manifest last; names that leave the collection's folder are an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    with tarfile.open(archive, "r:gz") as tar, tempfile.TemporaryDirectory() as held:
        members = {m.name.removeprefix(f"{collection_id}/"): m for m in tar.getmembers() if m.isfile() and m.name.startswith(f"{collection_id}/")}
        if any(n.startswith("/") or ".." in n.split("/") for n in members) or "collection.json" not in members:
            raise ContractError("the archive does not hold this collection")
        manifest = check_manifest(json.load(tar.extractfile(members["collection.json"])), collection_id)
        lacking = [p["path"] for p in manifest["parts"] if p["path"] not in members]
        if lacking:
            raise ContractError(f"parts are missing: {lacking[:3]}")
        for n in [*(p["path"] for p in manifest["parts"]), "collection.json"]:
            local = f"{held}/part"
            with open(local, "wb") as f:
                shutil.copyfileobj(tar.extractfile(members[n]), f)
            fs, p = _fs(spark, f"{root}/{collection_id}/{n}")
            fs.copyFromLocalFile(True, True, path(f"file://{local}"), p)
    return manifest


def index_ready(manifest: dict, max_text_chars: int) -> None:
    """Chunks longer than what the graph reads of a text would be cut without notice."""
    if manifest["max_chunk_chars"] > max_text_chars:
        raise ContractError(f"chunks of up to {manifest['max_chunk_chars']} characters exceed the {max_text_chars} that the graph reads")


def export_graph(tables: dict[str, DataFrame], path: str) -> None:
    """kg_nodes and kg_edges, an edge per relation and document, for other programs."""
    tables["nodes"].select("name", "type", "description").write.mode("overwrite").parquet(f"{path}/kg_nodes")
    tables["relations"].select("source", "target", "relation", "description", "doc_id", "weight").write.mode("overwrite").parquet(f"{path}/kg_edges")
