import json

import pytest

from spindrift.plans.evaluation import JudgeGuard, RunConfig, evaluate
from spindrift.plans.providers import EchoModel, HashEmbedder, OverlapReranker
from spindrift.sources import datasets as ds


@pytest.fixture
def dataset(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([(f"q{i}", f"alpha{i} beta{i}", f"alpha{i}", None, "bridge", "easy") for i in range(3)], "query_id string, text string, answer string, answer_type string, type string, level string").write.parquet(f"{root}/set/queries.parquet")
    spark.createDataFrame([(f"d{i}", "", f"alpha{i % 3} beta{i % 3} more{i}") for i in range(6)], "doc_id string, title string, text string").write.parquet(f"{root}/set/corpus.parquet")
    spark.createDataFrame([(f"q{i % 3}", f"d{i}") for i in range(6)], "query_id string, doc_id string").write.parquet(f"{root}/set/qrels.parquet")
    return root


def test_load_cache_and_errors(spark, dataset, tmp_path):
    d = ds.load_dataset(spark, dataset, "set")
    assert (d.status, d.queries.count(), d.corpus.count(), d.qrels.count()) == ("loaded", 3, 6, 6)
    assert {r["answer_type"] for r in d.queries.collect()} == {"text"}
    ds.save_cache(d, f"file://{tmp_path}/cache", "set")
    assert ds.load_dataset(spark, "file:///nowhere", "set", f"file://{tmp_path}/cache").qrels.count() == 6
    assert ds.load_dataset(spark, dataset, "none").status == "error"


def test_collection_contract(spark, tmp_path):
    root = f"file://{tmp_path}"
    chunks = spark.createDataFrame([(f"c{i}", "col", "text") for i in range(4)], "chunk_id string, collection_id string, text string")
    ds.write_collection(chunks, root, "col", 10)
    assert ds.load_collection(spark, root, "col").count() == 4
    good = json.loads((tmp_path / "col/collection.json").read_text())
    for change in ({"num_chunks": 5}, {"collection_id": "x"}, {"parts": []}, {"max_chunk_chars": 0}, {"max_chunk_chars": 3}, {"parts": [{"path": "parts/none", "num_rows": 1}]}):
        ds.write_text(spark, f"{root}/col/collection.json", json.dumps(good | change))
        with pytest.raises(ds.ContractError):
            ds.load_collection(spark, root, "col")
    for k in ds.MANIFEST_KEYS:
        with pytest.raises(ds.ContractError):
            ds.check_manifest({a: b for a, b in good.items() if a != k}, "col")
    with pytest.raises(ds.ContractError):
        ds.load_collection(spark, root, "missing")


def test_graph_store_and_fingerprint(spark, tmp_path):
    t = spark.range(3).selectExpr("cast(id as string) doc_id", "'x' content")
    ds.save_graph({"nodes": t}, f"file://{tmp_path}/kg")
    assert ds.load_graph(spark, f"file://{tmp_path}/kg")["nodes"].count() == 3
    ds.write_text(spark, f"file://{tmp_path}/kg/kg.json", '{"version": 2, "tables": []}')
    assert ds.load_graph(spark, f"file://{tmp_path}/kg") is None
    a = ds.fingerprint(t, 5, 6)
    assert len(a) == 16 and a == ds.fingerprint(t.orderBy("doc_id", ascending=False).repartition(3), 5, 6) and a != ds.fingerprint(t, 5, 7)


def test_report_has_no_secrets(spark, tmp_path):
    ds.write_report(spark, f"file://{tmp_path}/r.json", {"config": {"api_key": "abc", "store": {"secret": "x", "url": "u"}}})
    assert json.loads((tmp_path / "r.json").read_text())["config"] == {"api_key": "***", "store": {"secret": "***", "url": "u"}}


def test_evaluation_run(spark, dataset):
    d = ds.load_dataset(spark, dataset, "set")
    result, report = evaluate(d, RunConfig(retrieval_k=5, rerank_top_n=2), HashEmbedder(), EchoModel(), OverlapReranker())
    rows = {r["query_id"]: r for r in result.collect()}
    assert len(rows) == 3 and all(r["mrr"] == 1.0 and r["recall_at_5"] == 1.0 for r in rows.values())
    assert report["avg_mrr"] == 1.0 and report["n_completed"] == 3

    class Mute:
        def complete(self, prompt, phase):
            return "no idea"

    with pytest.raises(JudgeGuard):
        evaluate(d, RunConfig(retrieval_k=5), HashEmbedder(), Mute())
    with pytest.raises(ValueError):
        evaluate(d, RunConfig(retrieval_k=0), HashEmbedder(), EchoModel())


def test_stream_equals_batch(spark, tmp_path):
    from spindrift.streaming.calls import windowed_calls

    calls = spark.sql("select timestamp'2024-01-01' + make_interval(0,0,0,0,0,id*7,0) ts, cast(id % 3 as string) phase, cast(id as double) llm_ms from range(100)")
    calls.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(calls.schema).parquet(f"file://{tmp_path}/in")
    q = windowed_calls(stream).writeStream.outputMode("complete").format("memory").queryName("calls").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("calls").collect())) == sorted(map(tuple, windowed_calls(calls).collect()))


def test_graph_run(spark, tmp_path):
    from spindrift.plans.providers import WordModel
    from spindrift.plans.retrieval import GraphSettings

    queries = spark.createDataFrame([("q1", "Byron poetry", "Shelley", "text", "", ""), ("q2", "Turing machines", "Turing", "text", "", "")], "query_id string, query_text string, expected_answer string, answer_type string, question_type string, level string")
    corpus = spark.createDataFrame([("d1", "", "Ada Byron wrote engines"), ("d2", "", "Byron met Shelley poetry"), ("d3", "", "Turing Church machines")], "doc_id string, title string, content string")
    qrels = spark.createDataFrame([("q1", "d2"), ("q2", "d3")], "query_id string, doc_id string")

    class Teller(WordModel):
        def complete(self, prompt, phase):
            if phase == "kg_synthesis":
                return "" if "machines" in prompt.split("QUESTION: ")[1].split("\n")[0] else "Byron met Shelley [ref:1] [ref:9]"
            return "Shelley [ref:1]" if phase == "generation" else super().complete(prompt, phase)

    config = RunConfig(strategy="LIGHT_RAG", graph=GraphSettings(mode="hybrid"), retrieval_k=3, generation_top_n=1, max_context_chars=120_000)
    result, report = evaluate(ds.Dataset(queries, corpus, qrels), config, HashEmbedder(512), Teller())
    rows = {r["query_id"]: r for r in result.collect()}
    assert rows["q1"]["mrr"] == 1.0 and rows["q1"]["kg_synthesis_used"] and rows["q1"]["kg_synthesis_error"] is None
    assert (rows["q1"]["citation_refs_synth_in_range"], rows["q1"]["citation_refs_synth_out_of_range"]) == (1, 1)
    assert rows["q2"]["kg_synthesis_error"] == "empty" and rows["q2"]["generation_hit"] == 1.0
    assert report["retrieval_strategy"] == "LIGHT_RAG" and report["kg_synthesis"]["invocations"] == 2 and report["kg_synthesis"]["fallback_rate"] == 0.5
    assert report["avg_generation_recall"] == 1.0 and report["calls"]["generation"]["invocations"] == 2


def test_archive_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}"
    rows = spark.createDataFrame([(f"c{i}", "col", f"text {i}") for i in range(5)], "chunk_id string, collection_id string, text string")
    manifest = ds.write_collection(rows, f"{root}/a", "col", 10)
    assert ds.export_collection(spark, f"{root}/a", "col", str(tmp_path / "col.tgz")) == len(manifest["parts"])
    assert ds.import_collection(spark, str(tmp_path / "col.tgz"), f"{root}/b", "col") == manifest
    assert sorted(r["text"] for r in ds.load_collection(spark, f"{root}/b", "col").collect()) == [f"text {i}" for i in range(5)]
    with pytest.raises(ds.ContractError):
        ds.import_collection(spark, str(tmp_path / "col.tgz"), f"{root}/b", "other")
    with pytest.raises(ds.ContractError):
        ds.index_ready(manifest, 5)
    ds.index_ready(manifest, 10)


def test_settings(tmp_path, monkeypatch):
    from spindrift.plans import run

    file = tmp_path / "env"
    file.write_text("# comment\nRETRIEVAL_STRATEGY=LIGHT_RAG\nRETRIEVAL_K='7'\nEVAL_MAX_QUERIES=many\nDEV_MODE=true\nLIGHTRAG_MODE=odd\n")
    env = {k: v for k, v in run.read_env(str(file)).items()}
    c = run.config_from(env)
    assert (c.strategy, c.retrieval_k, c.max_queries, c.dev_mode, c.graph.mode, c.max_context_chars) == ("LIGHT_RAG", 7, 50, True, "hybrid", 4000)
    assert "LLM_BASE_URL is not set" in run.faults(env, c) and run.main(["--env", str(file), "--dry-run"]) == 1
    file.write_text(file.read_text() + "".join(f"{n}=x\n" for n in ("LLM_BASE_URL", "LLM_MODEL_NAME", "EMBEDDING_BASE_URL", "EMBEDDING_MODEL_NAME", "DATASETS_ROOT")))
    assert run.main(["--env", str(file), "--dry-run"]) == 0
    from spindrift.plans.evaluation import context_chars

    assert (context_chars(9, 5000), context_chars(0, 5000), context_chars(0, 100), context_chars(0, None)) == (9, 15904, 4000, 4000)


def test_calls_time_out_and_nulls_are_not_sent(spark):
    import time

    from spindrift.plans.providers import complete_column

    class Slow:
        def complete(self, prompt, phase):
            time.sleep(3 if prompt == "slow" else 0)
            return prompt

    rows = spark.createDataFrame([(1, "slow"), (2, "fast"), (3, None)], "i int, p string").coalesce(1)
    got = {r["i"]: (r["answer"], r["error"]) for r in complete_column(rows, "p", Slow(), "x", timeout=1.0).collect()}
    assert got == {1: (None, "timeout"), 2: ("fast", None), 3: (None, None)}


def test_late_queries_fail_and_failing_rerankers_keep_the_order(spark, dataset):
    import time

    class Slow(EchoModel):
        def complete(self, prompt, phase):
            if phase == "generation" and "alpha1 beta1" in prompt.split("QUESTION: ")[1]:
                time.sleep(9)
            return '{"score": 0.5, "justification": "x"}'

    class Broken:
        def scores(self, query, texts):
            if "alpha2" in query:
                raise RuntimeError("no places")
            return [float(i) for i in range(len(texts))]

    d = ds.load_dataset(spark, dataset, "set")
    result, report = evaluate(d, RunConfig(dataset="hotpotqa", retrieval_k=5, rerank_top_n=2, query_timeout=4.0), HashEmbedder(), Slow(), Broken())
    rows = {r["query_id"]: r for r in result.collect()}
    assert (rows["q1"]["status"], rows["q1"]["error_message"], rows["q1"]["generation_score"]) == ("failed", "TimeoutError: TimeoutError()", None)
    assert {rows[q]["status"] for q in ("q0", "q2")} == {"completed"} and (report["n_completed"], report["n_failed"], report["rerank_failures"]) == (2, 1, 1)
    assert rows["q2"]["reranked"] is False and rows["q2"]["generation_doc_ids"] == rows["q2"]["retrieved_doc_ids"][:2]
    assert rows["q0"]["reranked"] and rows["q0"]["generation_doc_ids"] == rows["q0"]["pre_rerank_candidate_ids"][::-1][:2]
    assert report["operational_stats"]["generation_error"] == 1 and report["judge_fallback_stats"]["faithfulness"]["invocations"] == 3
    told = {r["query_id"]: json.loads(r["report"]) for r in ds.query_reports(result).collect()}
    assert told["q2"]["metadata"] == {"reranked": False} and "retrieval_metadata" not in told["q2"] and told["q0"]["secondary_metrics"]["faithfulness"] == 0.5
    assert "generation_doc_ids" in told["q0"] and told["q1"]["status"] == "failed" and "primary_metric_value" not in told["q1"]


def test_http_providers():
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from spindrift.plans.providers import HttpEmbedder, HttpModel, HttpReranker

    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append((self.path, body))
            answer = {}
            if self.path == "/embeddings":
                if len(calls) == 1:
                    self.send_error(500)
                    return
                answer = {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}
            elif self.path == "/chat/completions":
                text = "<think>so</think> fine" if body["max_tokens"] >= 400 else "<think>not done"
                answer = {"choices": [{"message": {"content": text}}]}
            elif self.path == "/ranking":
                answer = {"rankings": [{"index": 1, "logit": 2.5}]}
            data = json.dumps(answer).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        assert HttpEmbedder(url, "m", batch=2).embed(["a", "bb", "ccc"]) == [[1.0], [2.0], [3.0]]
        assert HttpModel(url, "m", tokens=100).complete("p", "generation") == "fine"
        assert [b["max_tokens"] for p, b in calls if p == "/chat/completions"] == [100, 200, 400]
        assert HttpModel(url, "m", tokens=100).scaled(7).tokens == 300
        assert HttpReranker(url, "m").scores("q", ["a", "b"]) == [0.0, 2.5]
        with pytest.raises(ValueError):
            HttpModel(url, "m", tokens=100, most_tokens=200).complete("p", "generation")
    finally:
        server.shutdown()
