"""The training-data operators against SQL, brute force, round trips and held-out labels, and on awkward rows."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from spindrift.llm import chat, decontaminate, exact_dedup, html, jaccard, mixing, quality, queries, substrings, tokens, warc, words

LONG = "word " * 30_000
ROWS = [(1, "Some Text here that is long enough to have shingles in it", "src0"), (2, "some text HERE that is long enough to have shingles in it", None), (2, "some text HERE that is long enough to have shingles in it", "src1"), (3, None, "x"), (4, "", "src1"), (None, "lonely", "src0"), (5, LONG, "src2"), (6, "héllo wörld ünd mehr davon ja", "src3")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "mine", 7) for r in ROWS], "doc_id long, text string, source string, keep_id string, score int")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def corpus(spark):
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(name, spark, same):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name])


# 9


def test_exact_dedup_odd(odd, none):
    got = {(r[0], r[4][:6]): r for r in exact_dedup.exact_duplicates(odd).collect()}
    assert len(exact_dedup.exact_duplicates(odd).collect()) == 8
    one = [r for r in got.values() if r["group_size"] == 3]
    assert {r["keep_id"] for r in one} == {2} and {(r["doc_id"], r["kept"]) for r in one} == {(1, False), (2, True)}
    assert [r["group_size"] for r in got.values() if r["doc_id"] in (3, 4)] == [2, 2]
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and sorted(r[0] or 0 for r in kept.collect()) == [0, 2, 4, 5, 6]
    assert exact_dedup.exact_duplicates(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0


# 2


def test_mixing(spark, odd, none):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit(1).alias("copy"))
    out = mixing.mix(docs, {"a": 0.75}, 0.25, 2.0)
    assert out.columns == ["doc_id", "source", "copy", "mix_rate", "_copy", "shuffle_key"]
    n = dict(out.groupBy("source").count().collect())
    assert abs(n["a"] / (n["a"] + n["b"]) - 0.75) < 0.01 and abs(n["a"] + n["b"] - 40_000) < 1000
    assert mixing.mix(none).count() == 0 and mixing.mix(odd, {"src0": 1.0}, 0.0).where("source <> 'src0' or source is null").count() == 0
    repeated = spark.createDataFrame([(1, "a", None), (1, "a", ""), (None, "a", "x" * 100_000), (None, None, "t")], "doc_id long, source string, text string")
    drawn = collections.Counter((r["doc_id"], r["source"], r["text"]) for r in mixing.mix(repeated, {"a": 1.0}, 1.0, 6.0).collect())
    assert drawn[1, "a", None] == drawn[1, "a", ""]
    few = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("rare").alias("source"))  # a rate far above what is inverted at once
    counts = [r["n"] for r in mixing.mix(few, {"rare": 1.0}, 0.0, 1000.0).groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert abs(np.mean(counts) - 1000) < 10 and 800 < np.var(counts) < 1250
    plan = mixing.mix(few, {"rare": 1.0}, 0.0, 1e6)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 50_000


@pytest.mark.parametrize("epochs", [1.0, 200.0])
def test_mixing_sql(spark, duck, epochs):
    sql = "WITH RECURSIVE " + mixing.mix_sql("few", epochs=epochs).strip().replace("SELECT * EXCLUDE (reps), CAST", "SELECT * EXCLUDE (reps, copy), CAST")
    duck.execute("create or replace temp view few as select doc_id, source from documents where doc_id < 60")
    want = collections.Counter(duck.execute(f"select doc_id, copy, shuffle_key from ({sql})").fetchall())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source").where("doc_id < 60")
    assert collections.Counter(map(tuple, mixing.mix(docs, epochs=epochs).select("doc_id", "copy", "shuffle_key").collect())) == want


# 6


def test_chat_round_trip_and_folding(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<\\|x", "<\\\\|", "<<SYS>> a <</SYS>>", "", "\n", "[\\INST]", "日本 <s>"]
    for t in nasty:
        assert chat.unescape(chat.escape(t)) == t and chat.parse(chat.render([(t, t), ("assistant", t)])[0]) == [(t, t), ("assistant", t)]
    rows = [(1, 0, "a", 0, "start", "user", "he"), (1, 0, "a", 1, "delta", None, "llo"), (1, 1, "b", 0, "start", "assistant", "bad"), (1, 1, "b", 1, "regenerate", None, None), (1, 1, "b", 2, None, None, "good"), (1, 2, "c", 0, "start", "user", "x"), (1, 2, "c", 1, "edit", None, "y"), (1, 3, "d", 0, "start", "user", "z"), (1, 3, "d", 1, "delete", None, None), (None, None, None, 0, "start", None, None)]
    log = spark.createDataFrame(rows, "conv_id long, turn long, msg string, seq long, kind string, role string, text string")
    got = {r[0]: chat.parse(r[1]) for r in chat.format_conversations(log).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "good"), ("user", "y")], None: [("", "")]}
    assert chat.format_conversations(log.limit(0)).count() == 0
    turns = spark.createDataFrame([(5, 0, None, None, 1), (5, 0, "user", "a" * 1500, 1), (5, 0, "user", "a" * 1500, 1)], "conv_id long, turn long, role string, text string, seq int")
    r = chat.read_back(chat.format_conversations(chat.event_log(turns))).first()
    assert r["n_turns"] == 3 and r["turns_sha256"] == hashlib.sha256(("\n\n" + ("user\n" + "a" * 1500 + "\n") * 2).encode()).hexdigest()


# 7


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/x", "<p>é"), (1, "http://a/y\n", "<p>é"), (1, "http://a/y\n", "<p>é"), (2, None, None), (9, "u", ""), (None, "v", "zz"), (8, "w", "a\r\n\r\nb" * 50_000)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=2000)
    got = sorted(map(tuple, warc.captures_of(warc.read_records(manifest)).drop("uri", "request").collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(3, 3, sha("<p>é") , "revisit", 1), (1, 5, "", "", None)]
    by = collections.Counter((r[0], r[3], r[4]) for r in got)
    assert by == {(3, "revisit", 1): 1, (1, "response", None): 1, (1, "revisit", 1): 1, (2, "response", None): 1, (9, "revisit", 2): 1, (None, "response", None): 1, (8, "response", None): 1}
    assert {(r[1], r[2]) for r in got if r[0] in (1, 3)} == {(5, want[0][2])} and [r[1] for r in got if r[0] == 8] == [300_000]
    assert warc.captures_of(warc.read_records(warc.write_archives(pages.limit(0), f"file://{tmp_path}/e"))).count() == 0
    short = warc.captures_of(warc.read_records(warc.write_archives(pages, f"file://{tmp_path}/m", min_bytes=6)))
    assert short.where("record_type = 'revisit'").count() == 0


def test_warc_pages_without_ids(spark, tmp_path):
    rows = [(None, "u", f"text {i % 40}") for i in range(200)] + [(1, "v", "text 3")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    out = warc.captures_of(warc.read_records(warc.write_archives(pages, f"file://{tmp_path}/n"))).collect()
    assert len(out) == 201 and all(r["payload_bytes"] in (6, 7) for r in out)
    assert collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in out) == {(None, "response", None): 39, (None, "revisit", None): 156, (None, "revisit", 1): 5, (1, "response", None): 1}


def test_warc_query(spark):
    got = {r["page_id"]: r for r in warc.op7(spark, DATA).collect()}
    seen = {}
    for p, h in sorted((r[0], r[1]) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html").collect()):
        data = (h or "").encode()
        first = seen.setdefault(data, p)
        assert tuple(got[p]) == (p, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first == p else "revisit", None if first == p else first)


# 3


def test_html(spark):
    page = "<body><header><h1>Site</h1></header><nav>m</nav><main><article><header><h1>T</h1></header><p>a &lt;b <b>c</b>\n d<p>e<br>f<ul><li>x<li>y</ul><div class='share-box'>no</div><section class=comments><article>zz</article></section></article></main><aside>k</aside><p>out"
    assert html.main_text(page) == "T\n\na <b c d\n\ne f\n\nx\n\ny"
    assert html.main_text(None) == html.main_text("") == "" and html.main_text("1 < 2 <p>x</p><form>f</form>") == "1 < 2\n\nx"
    assert html.main_text("<p>a<script>x</script><style>y</style><!-- z --><div id=cookie-notice>q</div>b") == "a\n\nb"
    site = [(i, f"http://h/{i}", f"<body><div class=top><p>Same words on every page</p></div><div class=text><p>own text {i}</p></div>", "x") for i in range(6)]
    pages = spark.createDataFrame([*site, (7, None, None, "y"), (7, "http://h", "<article>z", "y")], "page_id long, url string, html string, host string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(pages).collect())
    assert got == sorted([(i, f"own text {i}", 10) for i in range(6)] + [(7, "", 0), (7, "z", 1)])
    assert html.extract(pages.limit(0)).count() == 0


def test_html_keeps_unique_text_among_repeated_blocks(spark):
    same = lambda i: f"<div class=block-{chr(97 + i)}><p>Same words {i}</p></div>"
    hosts = {}
    for n in (3, 4, 5, 20):  # repeated blocks around the text of one page, in constant order
        hosts[f"blocks{n}"] = ["<html><body>" + "".join(map(same, range(n // 2))) + f"<div class=text><p>own text {i}</p></div>" + "".join(map(same, range(n // 2, n))) + "</body></html>" for i in range(6)]
    hosts["many"] = ["<body><div class=text>" + "".join(f"<p class={chr(97 + k)}>own {k} {i}</p>" for k in range(18)) + "</div>" + same(0) for i in range(6)]
    hosts["direct"] = [f"<body><div class=text>own text {i}" + "".join(map(same, range(6))) + "</div>" for i in range(6)]
    hosts["links"] = [f"<body><div class=top><a>Home</a> <a>About</a></div><div class=text><p>own text {i}</p></div>" for i in range(6)]
    hosts["copies"] = ["<body><div class=text><p>copied text</p></div>"] * 6
    pages = spark.createDataFrame([(k, f"http://{h}/{k}", x) for h, xs in hosts.items() for k, x in enumerate(xs)], "page_id long, url string, html string")
    got = {(html.host_of(r["url"]), r["page_id"]): r["text"] for r in html.extract(pages).collect()}
    for i in range(6):
        assert {h: got[h, i] for h in hosts} == {**dict.fromkeys(hosts, f"own text {i}"), "many": "\n\n".join(f"own {k} {i}" for k in range(18)), "copies": "copied text"}


def test_html_tree_decides_on_pages_with_article(spark):
    assert html.main_text("<div class=content><p>a long article of its own</div><article class=teaser>short</article>") == "a long article of its own\n\nshort"
    teaser = [f"<body><div class=top><p>Same words</p></div><div class=content><p>own text {i} </div><article><p>short {i}</article>" for i in range(6)]
    inside = [f"<body><article><div class=hint><p>Same words in every article</p></div><p>own article text {i}</p></article><p>Same words</p>" for i in range(6)]
    copies = ["<body><div class=wrap><article><p>copied text</p></article></div><p>out"] * 6
    alone = ["<body><article><p>one text alone</p></article><p>out"] * 3
    hosts = {"teaser": teaser, "inside": inside, "copies": copies, "alone": alone}
    pages = spark.createDataFrame([(k, f"http://{h}/{k}", x) for h, xs in hosts.items() for k, x in enumerate(xs)], "page_id long, url string, html string")
    got = {(html.host_of(r["url"]), r["page_id"]): r["text"] for r in html.extract(pages).collect()}
    for i in range(6):
        assert got["teaser", i] == f"own text {i}\n\nshort {i}" and got["inside", i] == f"own article text {i}" and got["copies", i] == "copied text"
    assert {got["alone", i] for i in range(3)} == {"one text alone"}


def test_html_names_are_whole_tokens_of_containers():
    page = "<body><div class='layout no-sidebar'><article class='post with-sidebar'><h2 id=related-work>Related work</h2><section id=social-life><p class=notice>Own words</p></section><div class='share-box'>no</div><div class='ad slot-3'>no</div></article></div>"
    assert html.main_text(page) == "Related work\n\nOwn words"
    for wrapper in ("sidebar", "alert", "left-sidebar menu", "social"):
        assert html.main_text(f"<div class='{wrapper}'><main><h1>T</h1><p>own</main></div><div class='{wrapper}'>no</div>") == "T\n\nown"
        assert html.main_text(f"<div class='{wrapper}'><p>most of the text</div><div class='{wrapper}'>no</div>") == "most of the text"
    assert html.main_text("<main><p>short</main><div class=comments><article>a long comment of a reader</article></div><div id=advert-box>more text than there is of any other</div>") == "short"
    assert html.main_text("<div class='layout sidebar'><article>own text</article></div><div class=sidebar><article>teaser</article></div>") == "own text"


def test_html_query(spark):
    import html as lib

    got = {r["page_id"]: r["text"] for r in html.op3(spark, DATA).collect()}
    for p, h in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", h)[1].replace("<br>", " ")
        parts = (" ".join(lib.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert got[p] == "\n\n".join(x for x in parts if x)


# 4


def test_quality(spark, odd, none):
    labels = {r[0]: r[1] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality").collect()}
    rows = quality.op4(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    marks = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    scored = quality.score_quality(odd, marks)
    assert scored.count() == 8 and "_score" in scored.columns and scored.where("_score < 0 or _score > 1").count() == 0
    assert quality.score_quality(none, marks).count() == 0 and quality.score_quality(odd, marks.limit(0)).select("_score").distinct().collect()[0][0] == 0.5


# 5


def brute_classes(docs):
    sets = {}
    for i, x in docs.items():
        w = re.findall(r"\w+", x.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links, root = collections.Counter(), {i: i for i in docs}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {i: (top(i), links[i]) for i in docs}


def test_jaccard(spark, corpus, odd, none):
    assert {r[0]: (r[1], r[2]) for r in jaccard.op5(spark, DATA).collect()} == brute_classes(corpus)
    got = collections.Counter((r[0], r[1], r[2]) for r in jaccard.similar_texts(odd).collect())
    assert got[(2, 1, 2)] == 2 and got[(3, 3, 0)] == 1 and got[(None, None, 0)] == 1 and sum(got.values()) == 8
    kept = jaccard.drop_similar(odd)
    assert kept.columns == odd.columns and sorted(r[0] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6]
    assert jaccard.similar_texts(none).count() == 0


def test_jaccard_links_every_text_of_a_repeated_id(spark):
    rng = np.random.default_rng(2)
    one, two = ([f"w{k}" for k in rng.integers(0, 5000, 60)] for _ in range(2))
    other = lambda w: " ".join([*w, "more"])
    rows = [(1, " ".join(one)), (2, " ".join(two)), (2, other(one)), (3, other(two)), (None, other(two) + " still"), (3, other(two))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, class_id string")
    got = collections.Counter((r[0], r[1], r[2]) for r in jaccard.similar_texts(docs).collect())
    assert got == {(1, 1, 1): 1, (2, 2, 3): 1, (2, 1, 1): 1, (3, 2, 3): 2, (None, 2, 3): 1}
    kept = jaccard.drop_similar(docs)
    assert kept.columns == docs.columns and sorted((r[0], r[1]) for r in kept.collect()) == sorted(rows[:2])
    again = spark.createDataFrame([(None, "some text of its own"), (None, "some text of its own"), (7, "x y"), (7, "x y"), (7, "another text")], "doc_id long, text string")
    assert sorted(r[1] for r in jaccard.drop_similar(again).collect()) == ["another text", "some text of its own", "x y"]


@pytest.mark.parametrize("split", [3, 50])
def test_jaccard_deals_large_buckets(spark, split):
    rng = np.random.default_rng(1)
    base = [[f"w{k}" for k in rng.integers(0, 9000, 80)] for _ in range(20)]
    docs = dict(enumerate(" ".join([*b[: 80 - i % 5], *(f"v{k}" for k in rng.integers(0, 9000, i % 3))]) for b in base for i in range(40)))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r[0]: (r[1], r[2]) for r in jaccard.similar_texts(df, split=split).collect()} == brute_classes(docs)


def test_jaccard_recall_is_what_it_says():
    """Pairs at the threshold itself, found by the paths of one run after another and by the sketch."""
    rng = np.random.default_rng(4)
    pairs = 400
    sets = []
    for _ in range(pairs):
        x = rng.integers(0, 2**63, 110).astype(np.uint64)
        sets += [np.unique(x[:99]), np.unique(x[11:])]  # 88 of 110 shared
    minima = jaccard.minhashes(sets)
    rows, leaves = jaccard.paths(minima, 0.8, jaccard.DEPTH, jaccard.repeats_for())
    of = [set(leaves[rows == i].tolist()) for i in range(len(sets))]
    bits = jaccard.sketches(minima)
    met = [bool(of[2 * i] & of[2 * i + 1]) and jaccard.alike(bits[2 * i], bits[2 * i + 1 : 2 * i + 2])[0] >= jaccard.least_alike(0.8) for i in range(pairs)]
    assert np.mean(met) >= 0.99


# 1


def test_decontaminate_odd(spark, odd, none):
    bench = spark.createDataFrame([(1, "text here that is long enough to have shingles"), (2, "wörld ünd"), (3, None), (4, ""), (5, "word word word word word word"), (None, "absent words are never found here at all")], "item_id long, text string")
    hits = sorted((r["doc_id"], r["item_id"], r["shared"]) for r in decontaminate.find_items(odd, bench).collect())
    assert hits == [(1, 1, 5), (2, 1, 5), (2, 1, 5), (5, 5, 1), (6, 2, 1)]
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and sorted(r[0] or 0 for r in kept.collect()) == [0, 3, 4]
    assert decontaminate.find_items(none, bench).count() == 0 and decontaminate.find_items(odd, bench.limit(0)).count() == 0
    assert len(decontaminate.find_items(odd, bench, block=5).collect()) == 5


def test_decontaminate_finds_short_items(spark):
    rng = np.random.default_rng(5)
    docs = [[f"w{k}" for k in rng.integers(0, 20_000, 1000)] for _ in range(200)]
    items = [docs[i][at : at + n] for n in range(1, 17) for i, at in enumerate(rng.integers(0, 900, 200))]
    items[-1] += [f"w{k}" for k in rng.integers(0, 20_000, 2)]  # a part of the shingles is enough
    where = {}
    for i, w in enumerate(docs):
        for n in range(1, 6):
            for k in range(1001 - n):
                where.setdefault(tuple(w[k : k + n]), set()).add(i)
    want = set()
    for j, w in enumerate(items):
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
        shared = collections.Counter(i for g in grams for i in where.get(g, ()))
        want |= {(i, j) for i, n in shared.items() if n >= 0.8 * len(grams) - 1e-9}
    tables = [spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(x)], f"{name} long, text string") for x, name in ((docs, "doc_id"), (items, "item_id"))]
    got = [(r[0], r[1]) for r in decontaminate.find_items(*tables).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 3200
    bins = decontaminate.bins_for(1024, 11, 0.8, 0.999999)
    load = 1035 / bins
    assert (1 - (1 - np.exp(-load)) / load) ** 9 <= 1e-6 * 1.001


# 8


def test_token_counts(spark, odd, none, corpus):
    with open(tokens.VOCABULARY, "rb") as f:
        encode = tokens.tokenizer(f.read())
    got = {r[0]: r[1] for r in tokens.op8(spark, DATA).collect()}
    assert got == {i: len(encode(t)) for i, t in corpus.items()}
    want = sorted((r[0] or 0, len(encode(r[1] or ""))) for r in ROWS)
    for eod in (tokens.EOD, 60_000, 70_000):  # the last one takes 32 bits
        small = tokens.token_counts(odd, eod=eod, block_tokens=64, file_tokens=500)
        assert sorted((r[0] or 0, r[1]) for r in small.collect()) == want
    with pytest.raises(ValueError):
        tokens.token_counts(odd, eod=50_255)
    assert tokens.token_counts(none).count() == 0


def test_token_files_are_flat(spark, odd, tmp_path):
    manifest = tokens.write_token_files(odd.coalesce(1), f"file://{tmp_path}/t").collect()
    with open(tokens.VOCABULARY, "rb") as f:
        encode = tokens.tokenizer(f.read())
    texts = {r[0]: r[1] or "" for r in ROWS}
    for r in manifest:
        flat = np.fromfile(r["path"].removeprefix("file://"), "<u2").tolist()
        assert flat == [t for i in r["ids"] for t in [*encode(texts[i]), tokens.EOD]]


# 10


def brute_repeats(docs):
    seen, out = set(), {}
    for i, t in docs:
        x = t.encode()
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - 99):
            s = x[p : p + 100]
            if s in seen:
                gone[p : p + 100] = True
            seen.add(s)
        out[i] = (len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_substrings(spark, corpus, odd, none):
    assert {r[0]: tuple(r[1:]) for r in substrings.op10(spark, DATA).collect()} == brute_repeats(sorted(corpus.items()))
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abé\x00"), 400)) for _ in range(6)]
    cases = [(9, texts[0] + texts[1]), (1, texts[1][7:350] + texts[2]), (5, "x" * 700), (4, "ab" * 300), (7, texts[2][:99]), (8, texts[2][:100] + "y" * 300), (10, ""), (11, texts[3] + texts[3])]
    df = spark.createDataFrame(cases, "doc_id long, text string").repartition(3)
    for chunk in (300, 4_000_000):
        found = substrings.remove_repeated(df, chunk_bytes=chunk).collect()
        want = brute_repeats(sorted(cases))
        assert {r[0]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in found} == want
        assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in found)
    assert substrings.remove_repeated(none).count() == 0
    # null ids come last, rows that repeat an id in some order; all but one of equal texts lose everything
    text = "".join(rng.choice(list("abcdefgh"), 300))
    rows = [(None, text, "x"), (2, text, "x"), (2, text, "x"), (1, None, "x"), (3, "short", "x")]
    got = substrings.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], bytes(r["kept"]).decode()) for r in got) == {(None, 300, ""): 1, (2, 300, ""): 1, (2, 300, text): 1, (1, 0, ""): 1, (3, 5, "short"): 1}
    assert {r["doc_id"]: (r["n_bytes"], len(r["spans"])) for r in substrings.remove_repeated(odd).collect()}[5] == (150_000, 1)


def test_window_masks_compare_bytes(monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.integers(97, 99, (40, substrings.ROW)).astype(np.uint8)
    rows = np.concatenate([base, base, base])
    rows[40:80, 130:] = 120  # other bytes before the anchor
    rows[80:, 90:100] = 121  # another suffix
    rows = rows[np.lexsort(rows.T[::-1])]
    rank = rng.permutation(len(rows))
    least, most = np.zeros(len(rows), np.int64), np.full(len(rows), substrings.REACH)
    shared = substrings.prefixes(rows)
    got = substrings.window_masks(rows, shared, rank, least, most)
    want = np.zeros(len(rows), np.uint64)
    for o in range(substrings.REACH + 1):
        windows = [(bytes(r[: substrings.LENGTH - o]), bytes(r[substrings.LENGTH : substrings.LENGTH + o])) for r in rows]
        low = {}
        for w, k in zip(windows, rank, strict=True):
            low[w] = min(low.get(w, k), k)
        want |= np.array([int(low[w] != k) << o for w, k in zip(windows, rank, strict=True)], np.uint64)
    assert (got == want).all() and want.any()
    monkeypatch.setattr(substrings, "mixed", lambda h: h & np.uint64(3))  # nearly all hashes collide
    assert (substrings.window_masks(rows, shared, rank, least, most) == want).all()


def test_words():
    sets = words.shingle_sets(["A b C d e f", "a B c D e F", "one two", "", None, "…", "ça va bien là-bas oui"])
    assert (sets[0] == sets[1]).all() and [len(s) for s in sets] == [2, 2, 1, 0, 0, 0, 2]


# pipeline


def test_pipeline(spark, corpus):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stage = dict(p.STAGES)
    kept = stage["quality"](spark, docs, DATA)
    assert kept.columns == docs.columns
    ids = {r[0] for r in kept.collect()}
    folded = collections.defaultdict(list)
    for i in ids:
        folded[corpus[i].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))].append(i)
    ids = {max(g) for g in folded.values()}
    ids = {i for i, (c, _) in brute_classes({i: corpus[i] for i in ids}).items() if c == i}
    grams = lambda t: (lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)})(re.findall(r"\w+", t.lower()))
    items = [grams(r[0]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("text").collect()]
    ids = {i for i in ids if not any(len(g & grams(corpus[i])) >= 0.8 * len(g) for g in items)}
    want = mixing.mix(docs.where(F.col("doc_id").isin(list(ids))))
    assert sorted(map(str, p.run(spark, DATA).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("slice_bytes", [1, 7, 1 << 13])
def test_warc_members_equal_gzip(monkeypatch, slice_bytes):
    import gzip
    import io
    import random

    monkeypatch.setattr(warc, "SLICE", slice_bytes)
    rng = random.Random(3)
    contents = [b"", b"a", rng.randbytes(20_000), b"x" * 300_000, *[rng.randbytes(rng.randrange(50)) for _ in range(40)], rng.randbytes(1 << 20)]
    contents = contents[:-1] if slice_bytes == 1 else contents
    members = [gzip.compress(c) for c in contents]
    offsets = [sum(map(len, members[:i])) for i in range(len(members))]
    data = b"".join(members)
    assert list(warc._members(io.BytesIO(data))) == list(zip(offsets, contents, strict=True))
    assert list(warc._members(io.BytesIO(b""))) == []
    with pytest.raises(ValueError):
        list(warc._members(io.BytesIO(data[:-1])))


def test_quality_equals_scalar_arithmetic():
    """The vectorised features, updates and dot products against plain loops over dictionaries."""
    import math

    rng = np.random.default_rng(3)
    bits, texts = 10, [" ".join(rng.choice(["good", "Text", "BUY", "now!!", "12", "a", "sehr"], rng.integers(1, 30))) for _ in range(60)] + ["", None]
    labels = np.array([float("BUY" not in (t or "")) for t in texts])
    slots, values, offsets = quality.features(texts, bits)
    rows = [dict(zip(slots[a:b].tolist(), values[a:b].tolist(), strict=True)) for a, b in zip(offsets, offsets[1:])]
    for row, text in zip(rows, texts, strict=True):
        one = quality.features([text], bits)
        assert row == pytest.approx(dict(zip(one[0].tolist(), one[1].tolist(), strict=True)))  # whatever stands beside it
        assert not row or abs(sum(v * v for v in row.values()) - 1) < 1e-9
    z, n, bias = {}, {}, 1 << bits

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        return (math.copysign(quality.L1, z[i]) - z[i]) / ((quality.BETA + math.sqrt(n.get(i, 0.0))) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(7)
    for _ in range(quality.EPOCHS):
        for k in order.permutation(len(labels)):
            x = {**rows[k], bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - labels[k]) * v
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    model = quality.ftrl(slots, values, offsets, labels, bits)
    assert model == pytest.approx(np.array([weight(i) for i in range(bias + 1)]), abs=1e-9)
    scores = [1 / (1 + math.exp(-weight(bias) - sum(weight(i) * v for i, v in row.items()))) for row in rows]
    assert quality.score(texts, model) == pytest.approx(scores, abs=1e-9)
    assert np.mean(np.array(scores)[labels == 1]) > np.mean(np.array(scores)[labels == 0])


def test_quality_repeated_rows(spark):
    docs = spark.createDataFrame([(i, "plain good text" if i % 2 else "BUY now!!", "l") for i in range(40)] + [(1, "plain good text", "l"), (1, None, "l"), (None, "BUY now!!", "l"), (41, "x " * 50_000, "l")], "doc_id long, text string, label string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (1, 0), (3, 1), (99, 1)], "doc_id long, quality int")
    rows = quality.score_quality(docs, marks).collect()
    assert len(rows) == 44 and docs.columns == rows[0].__fields__[:3] and all(0 <= r["score"] <= 1 for r in rows)
    by = collections.defaultdict(set)
    for r in rows:
        by[r["text"]].add(round(r["score"], 9))
    assert all(len(x) == 1 for x in by.values()) and min(by["plain good text"]) > max(by["BUY now!!"])


def test_html_tree_changes_the_result(spark):
    site = [(i, f"http://h/{i}", f"<body><div class=top><p>Same words on every page</p></div><div class=text><p>own text {i}</p></div>") for i in range(6)]
    pages = spark.createDataFrame(site, "page_id long, url string, html string")
    off = {r["page_id"]: r["text"] for r in html.extract(pages, least_pages=1 << 60).collect()}
    on = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert off == {i: f"Same words on every page\n\nown text {i}" for i in range(6)} and on == {i: f"own text {i}" for i in range(6)}


def test_html_long_and_deep(spark):
    deep = "<div class=a>" * 3000 + "deep text" + "</div>" * 3000
    long = "<article>" + "<p>some words &amp; more</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([(1, "http://h/1", deep), (2, "http://h/2", long), (2, "http://h/2", long), (3, "http://h/3", "</div></p>" * 1000 + "<p>x" + "<b" * 1000)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.extract(pages).collect()}
    assert got[1]["text"] == "deep text" and got[2]["text"] == "\n\n".join(["some words & more"] * 20_000) and got[2]["n_chars"] == len(got[2]["text"]) and got[3]["text"].startswith("x")


def test_decontaminate_long_documents_and_blocks(spark):
    rng = np.random.default_rng(9)
    long = [f"w{k}" for k in rng.integers(0, 1000, 300_000)]
    docs = [(1, " ".join(long)), (1, " ".join(long[:50])), (None, " ".join(long[10:40])), (2, None), (3, "nothing here")]
    items = [(k, " ".join(long[at : at + n])) for k, (at, n) in enumerate([(5, 1), (10, 5), (20, 12), (250_000, 30), (299_900, 100)])] + [(9, " ".join(f"v{k}" for k in range(20)))]
    tables = [spark.createDataFrame(x, f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id"))]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = collections.Counter()
    for i, t in docs:
        w = (t or "").split()
        for j, x in items:
            g = grams(x.split()) or {(x,)}
            has = grams(w) if len(x.split()) >= 5 else {(y,) for y in w}
            if len(g & has) >= 0.8 * len(g):
                want[i, j] += 1
    for block in (decontaminate.BLOCK_SHINGLES, 25, 1):
        assert collections.Counter((r[0], r[1]) for r in decontaminate.find_items(*tables, block=block).collect()) == want
    kept = decontaminate.drop_contaminated(*tables)
    assert sorted((r[0] or 0, len(r[1] or "")) for r in kept.collect()) == [(2, 0), (3, 12)]


def test_pipeline_stages_on_awkward_rows(spark, none):
    import corpus_pipeline as p

    rows = [(1, "Some Text here that is long enough to have shingles in it", "en", "src0"), (2, "some text HERE that is long enough to have shingles in it", "en", None), (2, "some text HERE that is long enough to have shingles in it", "en", None), (None, None, None, None), (3, None, "en", "x"), (4, "", "en", "src1"), (5, LONG, "en", "src2"), (None, "lonely words of a row without an id here", "de", "src0"), (None, "lonely words of a row without an id here", "de", "src0")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "mine", 1, 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, keep_id string, class_id int, score double")
    before = collections.Counter(map(str, docs.collect()))
    left = {"exact_dedup": [None, 2, 4, 5], "near_dedup": [None, None, 1, 3, 4, 5], "decontaminate": None, "quality": None}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        got = out.collect()
        assert out.columns == docs.columns and not collections.Counter(map(str, got)) - before, name
        if left[name]:
            assert sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i)) == left[name], name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
    mixed = p.STAGES[-1][1](spark, docs, DATA)
    assert mixed.columns[: len(docs.columns)] == docs.columns and p.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0
