import pytest

from spindrift.operators import graph, ranking
from spindrift.plans import extraction, retrieval
from spindrift.plans.providers import HashEmbedder, WordModel

DOCS = [("d1", "", "Ada Byron wrote engines"), ("d2", "", "Byron met Shelley poetry"), ("d3", "", "Turing Church machines"), ("d4", "", "plain words only"), ("d5", "", "")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id string, title string, content string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("q1", "Byron poetry"), ("q2", "machines"), ("q3", ""), ("q4", "Byron poetry")], "query_id string, query_text string")


@pytest.fixture(scope="module")
def hybrid(corpus):
    r = retrieval.GraphRetriever(HashEmbedder(512), WordModel(), retrieval_k=3)
    r.index_documents(corpus)
    assert r.degraded is None
    return r


@pytest.mark.parametrize("per_call", [1, 3])
def test_extraction(corpus, per_call):
    found = extraction.extract(corpus, WordModel(), per_call, gleaning=1)
    got = {r["doc_id"]: r for r in found.where("round = 0").collect()}
    assert set(got) == {d[0] for d in DOCS}
    assert [e["name"] for e in got["d1"]["entities"]] == ["Ada", "Byron"] and got["d1"]["keywords"] == ["wrote", "engines"]
    assert [(r["source"], r["target"]) for r in got["d2"]["relations"]] == [("Byron", "Shelley")]
    stats = extraction.extraction_stats(found).first().asDict()
    assert (stats["docs_processed"], stats["docs_success"], stats["docs_empty_input"], stats["docs_empty_result"], stats["docs_failed"]) == (5, 4, 1, 1, 0)
    assert (stats["total_entities"], stats["total_relations"], stats["docs_with_keywords"]) == (6, 3, 4)


def test_unanswered_documents_are_sent_alone(corpus):
    class Half(WordModel):
        def complete(self, prompt, phase):
            return "no" if "[DOC" in prompt else super().complete(prompt, phase)

    assert extraction.extract(corpus, Half(), 5).where("parsed").count() == 4


def test_graph_tables(hybrid):
    g = hybrid.graph
    assert {r["name"] for r in g["nodes"].collect()} == {"ada", "byron", "shelley", "turing", "church"}
    assert {(r["name"], r["doc_id"]) for r in g["node_docs"].where("name = 'byron'").collect()} == {("byron", "d1"), ("byron", "d2")}
    assert {(r["lo"], r["hi"]) for r in g["relations"].collect()} == {("ada", "byron"), ("byron", "shelley"), ("church", "turing")}


def test_hybrid(hybrid, queries):
    rows = {}
    for r in hybrid.retrieve(queries).orderBy("query_id", "rank").collect():
        rows.setdefault(r["query_id"], []).append(r)
    assert rows["q1"][0]["doc_id"] == "d2" and {r["doc_id"] for r in rows["q1"]} == {"d1", "d2"} and rows["q1"][0]["fallback"] is None
    assert [r["doc_id"] for r in rows["q1"]] == [r["doc_id"] for r in rows["q4"]]
    assert rows["q2"][0]["doc_id"] == "d3" and {r["fallback"] for r in rows["q3"]} == {"no_keywords"}
    one = [r for r in rows["q1"] if r["doc_id"] == "d1"][0]
    byron = dict((r["key"], r["distance"]) for r in hybrid._hits(extraction.query_keywords(queries.where("query_id = 'q1'"), WordModel()), "low", hybrid.entities, "name", "entity").collect())
    assert one["score"] >= max(0, 1 - byron["byron"] / 2) - 1e-6


@pytest.mark.parametrize(("mode", "reason"), [("local", "no_keywords"), ("global", None), ("naive", None)])
def test_modes(corpus, queries, mode, reason):
    r = retrieval.retriever("LIGHT_RAG", HashEmbedder(512), WordModel(), retrieval.GraphSettings(mode=mode), 2)
    r.index_documents(corpus)
    got = r.retrieve(queries.where("query_id = 'q2'")).orderBy("rank").collect()
    assert got[0]["doc_id"] == "d3" and got[0]["fallback"] == reason


def test_graph_query_reads_whole_texts(spark, tmp_path):
    from spindrift.plans import queries as registered

    filler = " ".join(f"filler{i % 5}" for i in range(20_000))
    rows = [(1, f"Ada {filler} Zebra stripes"), (2, "Ada Byron"), (3, "plain words")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Zebra"), (8, "stripes")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r["query_id"], r["doc_id"]): r for r in registered.graph_retrieval(spark, str(tmp_path)).collect()}
    assert got[7, "1"]["rank"] == got[8, "1"]["rank"] == 1 and {r["fallback"] for r in got.values()} == {None}


def test_failing_model_degrades_to_vectors(corpus, queries):
    class Broken:
        def complete(self, prompt, phase):
            return "[]"

    r = retrieval.GraphRetriever(HashEmbedder(512), Broken(), retrieval_k=2)
    r.index_documents(corpus)
    assert {x["fallback"] for x in r.retrieve(queries).collect()} == {"no_keywords"}
    r.clear_index()
    assert not r.is_indexed
    assert r.retrieve(queries).count() == 0 and {x["error"] for x in r.errors.collect()} == {"nothing is indexed"}


def test_cached_graph(corpus, tmp_path):
    for model in (WordModel(), None):  # the second run must not need a model for the graph
        r = retrieval.GraphRetriever(HashEmbedder(64), model, retrieval.GraphSettings(cache=f"file://{tmp_path}"))
        r.index_documents(corpus)
        assert r.degraded is None and r.graph["nodes"].count() == 5


def test_structured_context(hybrid, queries, spark):
    ranked, entities, relations = hybrid.search(queries)
    got = {r["query_id"]: r for r in retrieval.structured_context(queries, ranked, entities, relations, 120_000, "hybrid").collect()}
    text = got["q1"]["context"]
    assert '{"entity": "byron", "type": "CONCEPT", "description": "about Byron", "neighbors": [' in text
    assert text.index("(Entity)") < text.index("Document Chunks") and '{"reference_id": 1, "content": "Byron met Shelley poetry"}' in text and got["q1"]["n_chunks"] == 2
    none = retrieval.structured_context(queries, ranked.where("false"), None, None, 1000, "naive").first()
    assert none["context"] == ranking.NOTHING and none["n_chunks"] == 0
    tight = {r["query_id"]: r["n_chunks"] for r in retrieval.structured_context(queries, ranked, None, None, 165, "naive").collect()}
    assert tight["q1"] == 1


def brute_cap(triplets, told, most):
    names, links, text, docs = {}, set(), {}, {}
    for d in sorted({t[0] for t in triplets}):
        for _, s, t in [x for x in triplets if x[0] == d]:
            ok = True
            for x in (s, t):
                if x in names:
                    docs[x].add(d)
                    continue
                if len(names) >= most:
                    degree = lambda y: sum((a == y) + (b == y) for a, b in links)
                    can = [y for y in names if len(docs[y]) == 1 and y not in (s, t)]
                    if not can:
                        ok = False
                        break
                    out = min(can, key=lambda y: (degree(y) + 1) * (1 + text[y] / 100))
                    del names[out]
                    links = {e for e in links if out not in e}
                names[x], docs[x], text[x] = 1, {d}, 0
            if ok:
                links.add(tuple(sorted((s, t))))
        for _, n, c in [x for x in told if x[0] == d and x[1] in names]:
            text[n] += c + (3 if text[n] else 0)
    return set(names)


@pytest.mark.parametrize("seed", range(2))
def test_cap_equals_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    triplets = [(d, f"n{r.randrange(25)}", f"n{r.randrange(25)}") for d in range(12) for _ in range(4)]
    told = [(d, f"n{r.randrange(25)}", r.randrange(1, 40)) for d in range(12) for _ in range(2)]
    rows = spark.createDataFrame([(*t[:1], i, *t[1:], "r", "") for i, t in enumerate(triplets)], "doc_id int, seq long, source string, target string, relation string, description string")
    said = spark.createDataFrame([(d, i, n, "X", "x" * c) for i, (d, n, c) in enumerate(told)], "doc_id int, seq long, name string, type string, description string")
    assert {x["name"] for x in graph.capped(rows, 9, said).collect()} == brute_cap(triplets, told, 9)


def test_hybrid_scores_equal_brute_force(hybrid, queries):
    import numpy as np

    embed = lambda x: np.array(HashEmbedder(512).embed([x])[0])
    docs = {}
    for r in hybrid.graph["node_docs"].collect():
        docs.setdefault(r["name"], set()).add(r["doc_id"])
    ends = {r["key"]: ({r["lo"], r["hi"]}, r["weight"]) for r in hybrid.first.collect()}

    def near(index, key, word, k):
        q = embed(word)
        return sorted((round(1 - float(q @ np.array(r["vector"])), 6), r[key]) for r in index)[:k]

    indexes = [(x.collect(), key, k) for x, key, k in ((hybrid.entities, "name", 10), (hybrid.relations, "key", 20), (hybrid.keywords, "doc_id", 20))]
    want = {}
    for q in queries.collect():
        words = q["query_text"].split()
        low, high = [w for w in words if w[0].isupper()], [w for w in words if not w[0].isupper()]
        sums = {}
        for channel, ((index, key, k), level) in enumerate(zip(indexes, (low, high, high), strict=True)):
            first = {}
            for word in level:
                for d, name in near(index, key, word, k):
                    if d <= 0.8:
                        first[name] = min(first[name], d) if channel == 2 and name in first else first.get(name, d)
            for rank, (name, d) in enumerate(first.items()):
                if channel == 1 and rank == 30:
                    break
                reached, weight = (docs[name], 1) if channel == 0 else (set().union(*(docs[e] for e in ends[name][0])), ends[name][1]) if channel == 1 else ({name}, 1)
                for doc in reached:
                    sums[doc] = sums.get(doc, 0) + max(0, 1 - d / 2) / (1 + rank) * weight
        want[q["query_id"]] = {x: round(s, 6) for x, s in sorted(sums.items(), key=lambda x: (-round(x[1], 9), x[0]))[:3]}
    got = {}
    for r in hybrid.retrieve(queries).where("fallback IS NULL").collect():
        got.setdefault(r["query_id"], {})[r["doc_id"]] = round(r["score"], 6)
    want = {q: pytest.approx(s, abs=2e-6) for q, s in want.items() if s}  # distances are rounded to 6 places on both sides
    assert got == want and "q1" in got


def test_cap_takes_orders_of_any_type(spark):
    rows = spark.createDataFrame([(d, f"{i:03}", f"a{d}{i}", f"b{d}{i}", "r", "") for d in range(4) for i in range(3)], "doc_id int, seq string, source string, target string, relation string, description string")
    told = spark.createDataFrame([(0, "zzz", "a00", "X", "y" * 900), (0, "yyy", "b00", "X", "y" * 900)], "doc_id int, seq string, name string, type string, description string")
    held = graph.admitted(rows, 6, told)
    assert {r["name"] for r in held.collect() if r["name"]} == {"a00", "b00", "a31", "b31", "a32", "b32"}  # long descriptions keep their names
    assert graph.cap_counts(held).first().asDict() == {"entities_dropped": 0, "entities_evicted": 18, "triplets_dropped_by_cap": 0}


def test_failing_embedder_is_told(hybrid, queries):
    from spindrift.plans.providers import BrokenEmbedder

    held, hybrid.embedder = hybrid.embedder, BrokenEmbedder()
    try:
        assert hybrid.retrieve(queries).count() == 0
        assert {r["query_id"]: r["error"] for r in hybrid.errors.collect()} == {f"q{i}": "ValueError: out of order" for i in range(1, 5)}
        assert {r["event"] for r in hybrid.events.distinct().collect()} == {"retrieval_error", "chunk_keywords_vdb_error"}
    finally:
        hybrid.embedder = held


def test_words_are_hashed_once(monkeypatch):
    from spindrift.plans import providers

    asked = []
    real = providers.hashlib.blake2b
    monkeypatch.setattr(providers.hashlib, "blake2b", lambda w, **k: asked.append(w) or real(w, **k))
    one = HashEmbedder(8).embed(["a B a", "b c", ""])
    assert sorted(asked) == [b"a", b"b", b"c"]
    monkeypatch.setattr(providers, "WORDS_HELD", 1)
    assert HashEmbedder(8).embed(["a B a", "b c", ""]) == one and one[2] == [0.0] * 8
