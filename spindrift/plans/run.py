"""``python -m spindrift.plans.run [--env FILE] [--dry-run] [-v]``: one evaluation run with settings from the environment."""

from __future__ import annotations

import argparse
import logging
import os
import sys
from datetime import datetime

from ..sources.datasets import dataset_config, load_dataset, query_reports, write_report
from . import logs
from .evaluation import JudgeGuard, RunConfig, context_chars, evaluate
from .providers import HttpEmbedder, HttpModel, HttpReranker
from .retrieval import MODES, GraphSettings

log = logging.getLogger("spindrift")


def read_env(path: str) -> dict[str, str]:
    """The process environment, overridden by the NAME=value lines of a file; comments and quotes are taken off."""
    out = dict(os.environ)
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                name, sign, value = line.strip().partition("=")
                if sign and not name.startswith("#"):
                    out[name.removeprefix("export ").strip()] = value.strip().strip("'\"")
    return out


def number(env: dict, name: str, default, kind=int):
    """A number; what is missing or is none reads as the default."""
    try:
        return kind(env.get(name, "").strip() or default)
    except ValueError:
        log.warning("%s is no number, %s is used", name, default)
        return default


def flag(env: dict, name: str, default: bool) -> bool:
    return env.get(name, "").strip().lower() in ("true", "1", "yes") if env.get(name, "").strip() else default


# The names of the settings in the environment, and what they are where they are not set.


def config_from(env: dict[str, str]) -> RunConfig:
    mode = env.get("LIGHTRAG_MODE", "hybrid").strip().lower()
    name = env.get("MTEB_DATASET_NAME", "hotpotqa").strip()
    kg = GraphSettings(
        mode=mode if mode in MODES else "hybrid",
        max_text_chars=number(env, "KG_MAX_TEXT_CHARS", 3000),
        docs_per_call=number(env, "KG_BATCH_DOCS_PER_CALL", 5),
        gleaning_rounds=number(env, "KG_GLEANING_ROUNDS", 0),
        max_entities=number(env, "KG_MAX_ENTITIES", 0) or 100_000,
        neighbours=number(env, "KG_MAX_NEIGHBORS_PER_ENTITY", 5),
        keyword_index=flag(env, "KG_CHUNK_KEYWORDS_ENABLED", True),
        description_synthesis=flag(env, "KG_DESCRIPTION_SYNTHESIS", False),
        description_chars=number(env, "KG_SYNTHESIS_CHAR_THRESHOLD", 200),
        cache=env.get("KG_CACHE_DIR", "").strip() or None,
    )
    reranks = flag(env, "RERANKER_ENABLED", False)
    return RunConfig(
        dataset=name,
        dataset_type=dataset_config(name)["type"],
        strategy=env.get("RETRIEVAL_STRATEGY", "SIMPLE_VECTOR").strip(),
        graph=kg,
        retrieval_k=number(env, "RETRIEVAL_K", 20),
        generation=flag(env, "GENERATION_ENABLED", True),
        generation_top_n=number(env, "LIGHTRAG_GENERATION_TOP_N", 0),
        rerank_top_n=number(env, "RERANKER_TOP_N", 20) if reranks else 0,
        rerank_fetch_k=number(env, "RERANKER_FETCH_K", 0) if reranks else 0,
        max_context_chars=context_chars(number(env, "GENERATION_MAX_CONTEXT_CHARS", 0), number(env, "LLM_CONTEXT_TOKENS", 0)),
        synthesis=flag(env, "KG_SYNTHESIS_ENABLED", True),
        synthesis_max_chars=number(env, "KG_SYNTHESIS_MAX_CHARS", 0),
        synthesis_timeout=number(env, "KG_SYNTHESIS_TIMEOUT_S", 30.0, float),
        judge_threshold=number(env, "JUDGE_FALLBACK_THRESHOLD", 0.02, float),
        max_queries=number(env, "EVAL_MAX_QUERIES", 50),
        max_corpus=number(env, "EVAL_MAX_CORPUS", 1000),
        seed=number(env, "CORPUS_SHUFFLE_SEED", 42),
        dev_mode=flag(env, "DEV_MODE", False),
        dev_queries=number(env, "DEV_QUERIES", 200),
        dev_corpus_size=number(env, "DEV_CORPUS_SIZE", 4000),
    )


def faults(env: dict[str, str], config: RunConfig) -> list[str]:
    """All that keeps a run from starting."""
    need = ["EMBEDDING_BASE_URL", "EMBEDDING_MODEL_NAME", "DATASETS_ROOT"]
    if config.generation or config.strategy == "LIGHT_RAG":
        need += ["LLM_BASE_URL", "LLM_MODEL_NAME"]
    if config.rerank_top_n:
        need += ["RERANKER_BASE_URL", "RERANKER_MODEL_NAME"]
    return [f"{n} is not set" for n in need if not env.get(n, "").strip()] + config.faults()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--env", default=".env", help="file of settings")
    parser.add_argument("--dry-run", action="store_true", help="check the settings and show them")
    parser.add_argument("--verbose", "-v", action="store_true")
    args = parser.parse_args(argv)
    env = read_env(args.env)
    logs.configure(env.get("LOG_FORMAT"), logging.DEBUG if args.verbose else logging.INFO)
    config = config_from(env)
    wrong = faults(env, config)
    for w in wrong:
        log.error("%s", w)
    if wrong:
        return 1
    if args.dry_run:
        log.info("%s", config)
        return 0

    run = f"run_{datetime.now():%Y%m%d_%H%M%S}"
    results = env.get("EVALUATION_RESULTS_DIR", "results")
    if "://" in results:  # only the driver's own folders can hold what its console shows
        return _run(env, config, run, results)
    with logs.console_copied(f"{results}/console_log_{config.strategy.lower()}_{run.removeprefix('run_')}.txt"):
        logs.configure(env.get("LOG_FORMAT"), logging.DEBUG if args.verbose else logging.INFO)
        return _run(env, config, run, results)


def _run(env: dict[str, str], config: RunConfig, run: str, results: str) -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.getOrCreate()
    model = HttpModel(env["LLM_BASE_URL"], env["LLM_MODEL_NAME"]) if env.get("LLM_BASE_URL") else None
    reranker = HttpReranker(env["RERANKER_BASE_URL"], env["RERANKER_MODEL_NAME"]) if config.rerank_top_n else None
    embedder = HttpEmbedder(env["EMBEDDING_BASE_URL"], env["EMBEDDING_MODEL_NAME"], number(env, "EMBEDDING_BATCH_SIZE", 50))
    out = f"{results}/{run}"
    data = load_dataset(spark, env["DATASETS_ROOT"], config.dataset, env.get("DATASETS_CACHE") or None)
    try:
        result, report = evaluate(data, config, embedder, model, reranker)
    except JudgeGuard as e:
        log.error("%s", e)
        write_report(spark, f"{out}/report.json", (e.report or {}) | {"run_id": run, "status": "failed"})
        return 2
    result.write.parquet(f"{out}/queries.parquet")
    query_reports(result).select("report").write.text(f"{out}/queries.jsonl")
    write_report(spark, f"{out}/report.json", report | {"run_id": run, "timestamp": datetime.now().isoformat(), "status": "completed"})
    log.info("%s: hit@5 %s, mrr %s", run, report["avg_hit_at_5"], report["avg_mrr"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
