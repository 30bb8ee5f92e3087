import pytest
from pyspark.sql import functions as F

from spindrift.functions import parse, text
from spindrift.operators import graph, metrics, ranking
from spindrift.operators.components import connected_components
from spindrift.operators.vectors import nearest, semantic_similarity


def values(df):
    return [tuple(r) for r in df.collect()]


def test_judge_quirks(spark):
    cases = {"score: 8": 0.8, "1/2": 0.5, "0/0": 0.0, "I give it 8": 0.5, "": 0.5, "0.8/1.0": 1.0, "0.75 / 1": 1.0, "score=7": 0.5, "score: 50": 0.5, "Score 8": 0.8, "score: 100 of 7": 0.5, "1/0": 1.0, '{"score": null}': 0.0, "[1]": 0.0, "{}": 0.5, '{"justification": "x"}': 0.0, "about 0.25 I think": 0.25, "0.8 because of this": 0.8, '{"a": 1} and {"score": 0.3}': 0.3, "0": 0.0, "true": 0.0, '{"score": 0.7} so': 0.7, '{"score": 8}': 1.0, None: 0.5}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", parse.judge_result(F.col("s")).alias("r")).select("s", "r.score")
    assert dict(values(df)) == cases


def test_citations(spark):
    rows = [("a [ref:1][ref:1] [ref:9] [Ref 2] (ref:3)", 5), (None, 3), ("[ref:0]", 2), ("x", 0)]
    df = spark.createDataFrame(rows, "s string, n int").select(parse.citations(F.col("s"), F.col("n")).alias("c")).select("c.*")
    assert values(df) == [(4, 3, 1, 2, 1, 1, 0.5), (0, 0, 0, 0, 0, 0, 0.0), (1, 1, 0, 0, 1, 0, 0.0), (0, 0, 0, 0, 0, 0, 0.0)]


def test_normalization(spark):
    cases = {"  The Café—déjà, VU! ": "cafe deja vu", "a  b": "b", "": "", None: "", "Ünï–cödé": "uni code"}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", text.normalize_text(F.col("s"), articles=True))
    assert dict(values(df)) == cases


def test_keywords(spark):
    df = spark.createDataFrame([([" Ab", "aB", "x", "y" * 81, *(f"k{i}" for i in range(12))],), (None,)], "a array<string>").select(parse.valid_keywords(F.col("a")))
    assert [len(r[0]) for r in df.collect()] == [10, 0]
    assert df.first()[0][:2] == ["Ab", "k0"]


def test_metric_cases(spark):
    cases = [("a", ["d1", "d2", "d3"], ["d1"]), ("b", ["d1", "d2", "d3", "d4", "d5"], ["d3"]), ("c", ["r1", "x1", "x2", "x3", "r2", "x4"], ["r1", "r2"]), ("d", ["x"], [])]
    got = spark.createDataFrame([(q, i + 1, d) for q, r, _ in cases for i, d in enumerate(r)], "query_id string, rank int, id string")
    rel = spark.createDataFrame([(q, d) for q, _, e in cases for d in e], "query_id string, id string")
    m = {r["query_id"]: r for r in metrics.retrieval_metrics(got, rel).collect()}
    assert (m["a"]["mrr"], m["a"]["hit_at_1"], m["a"]["ndcg_at_1"]) == (1, 1, 1)
    assert (m["b"]["mrr"], m["b"]["hit_at_1"], m["b"]["hit_at_3"]) == (1 / 3, 0, 1)
    assert (m["c"]["recall_at_1"], m["c"]["recall_at_3"], m["c"]["recall_at_5"]) == (0.5, 0.5, 1)
    assert m["d"]["mrr"] == 0 and m["d"]["hit_at_1"] is None


def test_answer_metrics(spark):
    df = spark.createDataFrame([("The cat sat", "a cat sat", 1), ("x x y", "x y y", 1), ("", "x", 1)], "a string, b string, k int")
    assert [r[0] for r in df.select(metrics.exact_match(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    assert {r["a"]: round(r["f1"], 4) for r in metrics.token_f1_rows(df, "a", "a", "b").collect()} == {"The cat sat": 0.6667, "x x y": 0.6667, "": 0.0}
    labels = spark.createDataFrame([("Yes", "yes!"), ("no", "yes"), ("", "")], "a string, b string")
    assert [tuple(r) for r in labels.select(metrics.accuracy(F.col("a"), F.col("b")), metrics.valid_label(F.col("a"), ["YES"])).collect()] == [(1.0, True), (0.0, False), (0.0, False)]


def test_similarity(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(semantic_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5, 0.5]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_nearest_ties_and_empty(spark, metric):
    v = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(6)], "id long, vector array<double>")
    got = values(nearest(v.where("id = 0"), v, 3, metric).orderBy("rank"))
    assert [r[2] for r in got] == [0, 2, 4]
    assert values(nearest(v.where("id < 0"), v, 3, metric)) == []


def test_neighbours_and_weights(spark):
    tr = spark.createDataFrame([(1, "1", "A", "B", "r", "d"), (1, "2", "A", "C", "r", "d"), (1, "3", "C", "D", "r", "d"), (1, "4", "A", "B", "r", "again"), (2, "1", "b", "a", "r", "d"), (3, "1", "", "x", "r", "d")], "doc_id int, seq string, source string, target string, relation string, description string")
    rel = graph.edge_relations(tr)
    # a lone letter is no article, so A stays
    assert sorted(values(graph.edges(rel))) == [("a", "b", 2), ("a", "c", 1), ("c", "d", 1)]
    near = [r for r in values(graph.neighbours(rel, 5).orderBy("node", "rank")) if r[0] == "a"]
    assert [r[2] for r in near] == ["c", "b"]


def test_capped(spark):
    tr = spark.createDataFrame([(1, "1", "A1", "B1", "r", ""), (2, "1", "C1", "D1", "r", "")], "doc_id int, seq string, source string, target string, relation string, description string")
    assert {r[0] for r in graph.capped(tr, 3).collect()} >= {"c1", "d1"} and graph.capped(tr, 3).count() == 3
    assert graph.capped(tr, 4).count() == 4


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (200, 200), (None, 3)], "src long, dst long")
    got = dict(values(connected_components(e)))
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and got[200] == 200 and len(got) == 44
    assert connected_components(e.limit(0)).count() == 0


def test_context_cases(spark):
    df = spark.createDataFrame([("a", 1, "x" * 50), ("b", 1, "y" * 5), ("b", 2, "z" * 5)], "g string, r int, c string")
    exact = len("[Doc 1]\n" + "y" * 5)
    got = {r["g"]: (r["n_docs"], r["context"]) for r in ranking.pack_context(df, "g", ["r"], "c", exact).collect()}
    assert got == {"a": (0, ""), "b": (1, "[Doc 1]\nyyyyy")}
    assert sum(ranking.section_budgets(4000, "hybrid")) == 3900


def test_subset_error(spark):
    q = spark.createDataFrame([(1,)], "query_id long")
    docs = spark.range(5).select(F.col("id").alias("doc_id"))
    rel = docs.select(F.lit(1).cast("long").alias("query_id"), "doc_id")
    with pytest.raises(ValueError):
        ranking.subset(q, rel, docs, 1, 3, 0)
    assert ranking.subset(q, rel.limit(2), docs, 1, 3, 0)[1].count() == 3


@pytest.mark.parametrize("window", [1, 3, 40])
def test_cooccurrence_equals_brute_force(spark, window):
    import itertools
    import random

    rng = random.Random(5)
    docs = {0: [f"n{i}" for i in range(60)], 1: ["only"], 2: ["n1", "n2"], 3: [f"n{i}" for i in range(0, 60, 2)], 4: [f"m{i}" for i in range(5)]}
    pairs = [p for ns in docs.values() for p in itertools.combinations(sorted(set(ns)), 2)]
    early = set(itertools.islice(itertools.combinations(sorted(docs[0]), 2), 300))  # edges before the first new pair
    linked = early | set(rng.sample(pairs, 200)) | set(itertools.combinations(sorted(docs[4]), 2))
    want = {}
    for d, ns in sorted(docs.items()):
        for p in [p for p in itertools.combinations(sorted(set(ns)), 2) if p not in linked][:10]:
            want.setdefault(p, d)
    rows = [(d, n) for d, ns in docs.items() for n in ns] + [(0, "n3"), (2, ""), (2, None), (None, "n9"), (None, "n8")]
    names = spark.createDataFrame(rows, "doc_id long, name string")
    edges = spark.createDataFrame(sorted(linked), "lo string, hi string")
    got = graph.cooccurrence(edges, names, window=window)
    assert sorted(values(got)) == sorted((d, *p) for p, d in want.items())
    assert values(graph.cooccurrence(edges, names.limit(0), window=window)) == []


def test_cooccurrence_in_blocks(spark, monkeypatch):
    labels = []
    real = graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, label: labels.append((label, df.columns)) or real(df, label))
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 50)
    names = spark.createDataFrame([(d, f"n{i}") for d in range(20) for i in range(d, d + 6)], "doc_id int, name string")
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "lo string, hi string")
    got = sorted(values(graph.cooccurrence(edges, names, 4)))
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 1 << 26)
    assert got == sorted(values(graph.cooccurrence(edges, names, 4))) and len(got) > 40
    parts = [c for label, c in labels if label == "cooccurring"]
    assert len(parts) == 4 and all(c == ["doc_id", "names", "found"] for c in parts)  # three blocks and one; pairs as numbers


def test_stats_of_empty_tables(spark):
    none = spark.createDataFrame([], "lo string, hi string, relation string, doc_id long")
    assert values(graph.stats(none, spark.createDataFrame([], "doc_id long, name string")).select("n_entities", "n_docs", "n_edges")) == [(0, 0, 0)]


def test_embedded_json(spark):
    cases = {
        '{"a": 1}': '{"a": 1}',
        '```json\n{"a": 1}\n```': '{"a": 1}',
        'so {"a": {"b": "}"}} and {more}': '{"a": {"b": "}"}}',
        "a {set} of {\"x\": [1]} it": '{"x": [1]}',
        '{"cut": [1, 2': None,
        '{"outer": {"inner": 2} cut': '{"inner": 2}',
        "none": None,
        "": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "x string")
    got = {r[0]: r[1] for r in rows.select("x", parse.embedded_json(F.col("x"))).collect()}
    assert got == cases | {None: None}


def test_statistics_of_empty_tables(spark):
    from spindrift.operators import statistics as st

    none = lambda schema: spark.createDataFrame([], schema)
    assert values(st.service_totals(none("error string, latency_ms double, retries int"))) == [(0, 0, 0, 0.0, 0.0, 0)]
    assert st.synthesis_stats(none("synthesis_error string, truncated boolean, total_ms double, queue_ms double, llm_ms double")).first().asDict() | {"invocations": 0, "fallback_rate": 0.0, "p95_llm_ms": 0.0} == st.synthesis_stats(none("synthesis_error string, truncated boolean, total_ms double, queue_ms double, llm_ms double")).first().asDict()
    assert values(st.worst_judge(none("metric string, default_return_rate double"))) == [(None, 0.0)] and st.phase_times(none("phase string, queue_ms double, llm_ms double")).count() == 0
    assert {r["n"] for r in st.operational_counters(none("event string")).collect()} == {0}


def test_containing_equals_search(spark):
    import random

    r = random.Random(4)
    docs = [(i, " ".join(r.choice("ab cd ef gh\nij kl".split(" ")) for _ in range(60))) for i in range(60)] + [(99, None), (98, "")]
    items = [(j, docs[r.randrange(60)][1][a : a + n]) for j, (a, n) in enumerate((r.randrange(100), r.randrange(1, 60)) for _ in range(80))] + [(500, None), (501, "absent words of an item that nobody has")]
    got = {tuple(x) for x in ranking.containing(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "query_id int, text string")).collect()}
    assert got == {(j, i) for j, q in items for i, t in docs if q is not None and t is not None and q in t}


def test_nearest_of_names_in_tiles(spark, monkeypatch):
    import numpy as np

    from spindrift.operators import vectors

    monkeypatch.setattr(vectors, "CELLS", 7)
    monkeypatch.setattr(vectors, "BLOCK", 3)
    rng = np.random.default_rng(0)
    v = [(f"n{i}", [float(x) for x in rng.integers(0, 3, 4)]) for i in range(30)]
    df = spark.createDataFrame([*v, ("none", None), (None, [1.0, 0.0, 0.0, 0.0])], "id string, vector array<double>")
    got = {(r[0], r[1]): r[2] for r in vectors.nearest(df, df, 4, "l2").collect()}
    for name, q in v:
        want = sorted((round(sum((a - b) ** 2 for a, b in zip(q, x, strict=True)), 6), n) for n, x in v)[:4]
        assert [got[name, k + 1] for k in range(4)] == [n for _, n in want]


@pytest.mark.parametrize("metric", ["cosine", "l2"])
@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e20])
def test_nearest_leaves_far_vectors_in_their_task(monkeypatch, metric, scale):
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from spindrift.operators import vectors

    monkeypatch.setattr(vectors, "CELLS", 400)
    monkeypatch.setattr(vectors, "COLUMNS", 16)
    rng = np.random.default_rng(1)
    q = rng.integers(-3, 4, (30, 5)).astype(float) * scale
    near, far = np.concatenate([q, q, rng.integers(-3, 4, (60, 5)) * scale]), np.concatenate([-q[:7], np.zeros((1, 5))])
    q[3] = 0
    batches = [pa.RecordBatch.from_pydict({"id": pa.array([f"{t}{i}" for i in range(len(v))]), "vector": pa.array(list(v))}) for t, v in (("a", near), ("b", near[::-1]), ("c", far))]
    held = SimpleNamespace(value=([*range(30)], q))
    out = [b.to_pylist() for b in vectors._nearest(held, 4, metric, pa.int64())(iter(batches))]
    rows = sorted((r["query_id"], r["micros"], r["id"]) for b in out for r in b)
    whole = np.concatenate([near, near[::-1], far])
    if scale == 1e20:  # too long for whole numbers of millionths
        rows = [r for r in rows if metric == "cosine"]
    names = [f"{t}{i}" for t, v in (("a", near), ("b", near), ("c", far)) for i in range(len(v))]
    for a in range(30 if rows else 0):
        d = np.round(vectors._distances(q[a : a + 1], whole, metric)[0] * vectors.SCALE).astype(int)
        assert [r[1:] for r in rows if r[0] == a][:4] == sorted(zip(d, names, strict=True))[:4]
    if scale == 1.0:
        assert sum(r[2][0] == "c" for r in rows) < 30  # four of them a query before
        assert sum(r[2][0] == "b" for r in rows) <= 120


def test_labels_make_no_pairs(spark):
    items = spark.createDataFrame([(i, ["x", "y", None][i % 3]) for i in range(12)], "id int, label string")
    asked = items.where("id < 4").withColumnRenamed("id", "query_id")
    got = spark.createDataFrame([(q, r + 1, (q * 5 + r * 2) % 12) for q in range(4) for r in range(5)], "query_id int, rank int, id int")
    pairs = asked.join(items, "label").select("query_id", "id")
    hits, sizes = metrics.labelled_hits(got, asked, items)
    assert sorted(values(metrics.retrieval_metrics(got, hits, sizes=sizes))) == sorted(values(metrics.retrieval_metrics(got, pairs)))
    assert hits.count() <= got.count() and dict(values(sizes)) == {0: 4, 1: 4, 3: 4}


@pytest.mark.parametrize(("kind", "bits"), [("long", 16), ("long", 32), ("int", 16), ("string", 16)])
def test_lists_of_documents_score_as_rows(spark, kind, bits):
    ids = ["a", "b", "c", "", None, "d"] if kind == "string" else [1, 65_535, 65_536, -1, None, -(2**31)]
    docs = spark.createDataFrame([(k, x) for i, x in enumerate(ids) for k in ("p", "s", "u")[: 1 + i % 3]] + [("p", ids[0])], f"key string, doc_id {kind}").distinct()
    hits = spark.createDataFrame([(1, "p", "s", 0, 0.4, 2), (1, "u", "s", 0, 0.4, 2), (1, "p", "p", 1, 0.0, 1), (2, "s", "u", 3, 0.2, 1), (3, "x", "y", 0, 0.1, 1)], "query_id int, lo string, hi string, rank int, distance double, weight int")
    lists = ranking.doc_lists(docs.unionAll(docs), bits)
    sums = lambda found: sorted(map(repr, values(found.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 9)))))
    got = ranking.relation_scores(hits, lists, ranking.summing_tasks(ranking.summed_rows([ranking.relation_ends(hits)], lists), lists))
    assert got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sums(got) == sums(ranking.relation_scores(hits, docs))
    keyed = hits.withColumnRenamed("lo", "key")
    assert sums(ranking.entity_scores(keyed, lists, 3)) == sums(ranking.entity_scores(keyed, docs))


def test_rows_of_relations_and_documents_are_not_shuffled(spark):
    from conftest import DATA

    from spindrift.plans import run_queries

    plan = run_queries.relation_documents(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "hashpartitioning(query_id" in plan
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning" in x and "doc_id" in x]


def test_hits_fused_in_blocks_equal_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(f"k{i % 7}", i * 3) for i in range(60)], "key string, doc_id long")
    entity = spark.createDataFrame([(q, f"k{q % 7}", 0, 0.4) for q in range(9)], "query_id long, key string, rank int, distance double")
    relation = spark.createDataFrame([(q, f"k{q % 5}", f"k{q % 3}", r, 0.2, 2) for q in range(9) for r in range(2)], "query_id long, lo string, hi string, rank int, distance double, weight int")
    keyword = spark.createDataFrame([(q, 1000 + q, 0, 0.1) for q in range(9)], "query_id long, key long, rank int, distance double")
    monkeypatch.setattr(ranking, "BLOCK_ROWS", 50)
    monkeypatch.setattr(ranking, "SUMMED", 10)
    got = ranking.fuse_hits(entity, relation, keyword, ranking.doc_lists(docs, 32), 4)
    want = ranking.fuse([ranking.entity_scores(entity, docs), ranking.relation_scores(relation, docs), ranking.keyword_scores(keyword)], 4)
    assert sorted(values(got)) == sorted(values(want))


def test_shuffles_of_stored_tables_go_with_their_end(spark):
    import time
    from pathlib import Path

    from spindrift.plans.storage import CLEANUP, stored

    tops = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {p for top in tops for p in Path(top).glob("*/shuffle_*.data")}
    before, conf = held(), spark.conf.get(CLEANUP, None)
    df = spark.range(5000).groupBy((F.col("id") % 700).alias("g")).count()
    assert stored(df, "groups").count() == 700 and spark.conf.get(CLEANUP, None) == conf
    shuffled = {p for p in held() - before if p.stat().st_size > 4000}  # the count's own files are small
    for _ in range(20):
        if not any(p.exists() for p in shuffled):
            break
        time.sleep(0.2)
    assert not any(p.exists() for p in shuffled)


def test_names_are_made_once(spark):
    rows = spark.createDataFrame([(1, 0, "The Ada", "Byron", "r", "")], "doc_id long, seq long, source string, target string, relation string, description string")
    plan = graph.edge_relations(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 6  # three for each name
