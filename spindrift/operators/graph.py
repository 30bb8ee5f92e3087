"""The knowledge graph as tables.

Input: triplets(doc_id, seq, source, target, relation, description) and mentions(doc_id, seq, name, type,
description). An edge is an unordered pair of normalised names (lo <= hi) that carries its relations.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import entity_name
from ..plans.storage import forget, stored
from .components import connected_components

DESCRIPTIONS, DESCRIPTION_CHARS, SEPARATOR = 5, 500, " | "
PAIRS_PER_DOC = 10
#: Pairs of names that travel to the edges at once.
PAIRS_AT_ONCE = 1 << 26


def _named(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with these columns as names of entities. They come from a generator: no filter is pushed below it, so each is made once."""
    made = F.explode(F.array(F.struct(*(entity_name(F.col(n)).alias(n) for n in names)))).alias("_named")
    return rows.select(*(c for c in rows.columns if c not in names), made).select(*(F.col(f"_named.{c}").alias(c) if c in names else F.col(c) for c in rows.columns))


def edge_relations(triplets: DataFrame) -> DataFrame:
    """lo, hi, source, target, relation, description, doc_id, seq: one row per (edge, relation, document), the first stated."""
    named = _named(triplets, "source", "target")
    whole = named.where("source <> '' and target <> ''").withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target"))
    first = F.min(F.struct("seq", "source", "target", "description")).alias("f")
    return whole.groupBy("lo", "hi", "relation", "doc_id").agg(first).select("lo", "hi", "f.source", "f.target", "relation", "f.description", "doc_id", "f.seq")


def statements(triplets: DataFrame) -> DataFrame:
    """lo, hi, doc_id: the ends of the edges as often as they are stated, without a shuffle."""
    ends = _named(triplets.select("doc_id", "source", "target"), "source", "target").where("source <> '' and target <> ''")
    return ends.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"), "doc_id")


def _counted_edges(relations: DataFrame, *first: Column) -> DataFrame:
    by_doc = relations.groupBy("lo", "hi", F.nullif(F.col("doc_id").cast("string"), F.lit("")).alias("_d")).agg(*[F.min(f).alias("_f") for f in first] or [F.count(F.lit(1)).alias("_n")])
    return by_doc.groupBy("lo", "hi").agg(F.greatest(F.lit(1), F.count("_d")).alias("weight"), *(F.min("_f").alias("_f") for _ in first))


def edges(relations: DataFrame) -> DataFrame:
    """lo, hi, weight: the number of distinct documents (1 at least)."""
    return _counted_edges(relations)


def labelled_edges(relations: DataFrame) -> DataFrame:
    """lo, hi, weight, label: the edges with the relation that was stated first."""
    return _counted_edges(relations, F.struct("doc_id", "seq", "relation")).select("lo", "hi", "weight", F.col("_f.relation").alias("label"))


def weighted_relations(relations: DataFrame) -> DataFrame:
    return relations.join(edges(relations), ["lo", "hi"])


def degrees(edge_table: DataFrame) -> DataFrame:
    """node, degree; a loop counts twice."""
    return edge_table.select(F.explode(F.array("lo", "hi")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def neighbours(relations: DataFrame, n: int) -> DataFrame:
    """node, rank, neighbour, score, label: the n neighbours with the highest ln(1 + weight) + degree, rounded to 3.

    Edges are stored once for their degrees and their ends. The rank is limited before rows are shuffled to their nodes, so a hub sends n rows a task.
    """
    table = stored(labelled_edges(relations), "edges")
    both = table.select(F.col("lo").alias("node"), F.col("hi").alias("neighbour"), "weight", "label").unionAll(table.where("lo <> hi").select("hi", "lo", "weight", "label"))
    scored = both.join(degrees(table).withColumnRenamed("node", "neighbour"), "neighbour").withColumn("score", F.bround(F.log1p(F.col("weight").cast("double")) + F.col("degree"), 3))
    w = Window.partitionBy("node").orderBy(F.desc("score"), "neighbour")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("node", "rank", "neighbour", "score", "label")


def chunk_keywords(rows: DataFrame) -> DataFrame:
    """doc_id, keywords of (doc_id, seq, keywords): the last that is not empty."""
    return rows.where("doc_id IS NOT NULL AND size(keywords) > 0").groupBy("doc_id").agg(F.max_by("keywords", "seq").alias("keywords"))


def lookup(nodes: DataFrame, asked: DataFrame, name: str = "name") -> DataFrame:
    """``asked`` with the columns of the node (``nodes`` by name) that its name means once normalised; null where there is none."""
    found = nodes.withColumnRenamed("name", "_node")
    keyed = asked.withColumn("_key", entity_name(F.col(name)))
    return keyed.join(found, keyed["_key"] == found["_node"], "left").drop("_key").withColumnRenamed("_node", "node")


def entities(mentions: DataFrame) -> DataFrame:
    """name, n_docs, type (the last that is not UNKNOWN), description (merged)."""
    m = _named(mentions, "name").where("name <> ''")
    at = F.struct("doc_id", "seq")
    known = F.when(F.col("type") != "UNKNOWN", at)
    base = m.groupBy("name").agg(F.count_distinct("doc_id").alias("n_docs"), F.coalesce(F.max_by("type", known), F.lit("UNKNOWN")).alias("type"))
    return base.join(merged_descriptions(m), "name", "left").withColumn("description", F.coalesce("description", F.lit("")))


def known_mentions(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """The rows of ``mentions`` whose name the graph (name) holds."""
    held = names.select(F.col("name").alias("_n")).distinct()
    return mentions.join(held, entity_name(F.col("name")) == F.col("_n"), "left_semi")


def merged_descriptions(mentions: DataFrame) -> DataFrame:
    """name, description: distinct but for case, the longest five (first stated of equal length), joined, cut at 500 at a separator."""
    some = mentions.where(F.coalesce("description", F.lit("")) != "").withColumn("_k", F.lower("description"))
    once = some.groupBy("name", "_k").agg(F.min(F.struct("doc_id", "seq", "description")).alias("f"))
    w = Window.partitionBy("name").orderBy(F.desc(F.length("f.description")), "f.doc_id", "f.seq", "_k")
    top = once.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= DESCRIPTIONS)
    joined = top.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "f.description"))), lambda x: x["description"]), SEPARATOR).alias("d"))
    head = F.substring("d", 1, DESCRIPTION_CHARS)
    cut = F.when(F.instr(head, SEPARATOR) > 0, F.regexp_extract(head, r"(?s)^(.*) \| ", 1)).otherwise(head)
    return joined.select("name", F.when(F.length("d") > DESCRIPTION_CHARS, cut).otherwise(F.col("d")).alias("description"))


def _key(lo: Column, hi: Column) -> list[Column]:
    """A pair of names in 128 bits, two digests of 64: among 10^9 pairs and as many edges any two meet by chance once in 10^20 runs."""
    return [F.xxhash64(lo, hi).alias("h"), F.xxhash64(F.lit(1), hi, lo).alias("g")]


def cooccurrence(relations: DataFrame, names: DataFrame, limit: int = PAIRS_PER_DOC, window: int = 4 * PAIRS_PER_DOC) -> DataFrame:
    """doc_id, lo, hi: pairs of names (doc_id, name) of one document without an edge yet; ten a document, the lowest document owns a pair.

    The pairs of a document's sorted names are numbered in their order, and half as many again as ``limit`` (``window`` at most) are looked
    at first, then ``window``, then windows twice as large, until ``limit`` new ones are found or none is left. A document with fewer than
    ``limit`` new pairs looks at all its pairs, nearly all of which are edges already. Documents are dealt to blocks of PAIRS_AT_ONCE
    pairs; of a pair only its digests and its number travel to the edges, those that are edges come back, and a document keeps the
    numbers of its new pairs beside its names.
    """
    spark = names.sparkSession
    once = _named(names.select("doc_id", "name").where("doc_id IS NOT NULL"), "name").where("name <> ''")
    todo = stored(once.groupBy("doc_id").agg(F.sort_array(F.collect_set("name")).alias("names")).withColumn("found", F.array().cast("array<long>")), "names")
    linked = stored(relations.select(*_key(F.col("lo"), F.col("hi"))).distinct(), "linked")
    k = F.size("names").cast("long")
    n = (k * (k - 1) / 2).cast("long")
    done, begin, width = [], 0, min(window, limit + limit // 2)
    while True:
        end = begin + width
        some = todo.where(n > begin)
        rows = some.agg(F.sum(F.least(n, F.lit(end)) - begin)).first()[0]
        if not rows:
            break
        blocks = -(-rows // PAIRS_AT_ONCE)
        parts = []
        for block in range(blocks):
            part = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == block)
            at = F.sequence(F.lit(begin).cast("long"), F.least(F.lit(end).cast("long"), n) - 1)
            pairs = part.select("doc_id", "names", F.explode(at).alias("at")).select("doc_id", "at", *_key(*_pair()))
            held = pairs.join(linked, ["h", "g"], "left_semi").groupBy("doc_id").agg(F.collect_set("at").alias("held"))
            new = F.array_except(at, F.coalesce("held", F.array().cast("array<long>")))
            looked = part.join(held, "doc_id", "left").select("doc_id", "names", F.concat("found", F.slice(new, F.lit(1), limit - F.size("found"))).alias("found"))
            parts.append(stored(looked, "cooccurring"))
        if begin == 0:
            forget(todo)
        looked = reduce(DataFrame.unionAll, parts)
        over = (n <= end) | (F.size("found") >= limit)
        done.append(looked.where(over))
        todo = looked.where(~over)
        begin, width = end, window if begin == 0 else 2 * width
    if not done:
        return spark.createDataFrame([], T.StructType([names.schema["doc_id"], T.StructField("lo", T.StringType()), T.StructField("hi", T.StringType())]))
    forget(linked)
    found = reduce(DataFrame.unionAll, done).select("doc_id", "names", F.explode("found").alias("at"))
    lo, hi = _pair()
    return found.select("doc_id", lo.alias("lo"), hi.alias("hi")).groupBy("lo", "hi").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "lo", "hi")


def _pair() -> tuple[Column, Column]:
    """The names of the pair with the number ``at`` among those of sorted ``names``."""
    k, at = F.size("names").cast("long"), F.col("at")
    start = lambda i: (i * (2 * k - i - 1) / 2).cast("long")  # noqa: E731  (number of the first pair of the i-th name)
    guess = F.floor((2 * k - 1 - F.sqrt(F.greatest(F.lit(0.0), (2 * k - 1) * (2 * k - 1) - 8.0 * at))) / 2)
    i = F.when(start(guess) > at, guess - 1).when(start(guess + 1) <= at, guess + 1).otherwise(guess)
    return F.get("names", i.cast("int")), F.get("names", (at - start(i) + i + 1).cast("int"))


def components(edge_table: DataFrame) -> DataFrame:
    """node, root: a component is named by its smallest name."""
    return connected_components(edge_table, "lo", "hi").withColumnRenamed("component", "root")


def capped(triplets: DataFrame, most: int, mentions: DataFrame | None = None) -> DataFrame:
    """The names that stay when the graph may hold ``most``: name. A no-op below the cap."""
    return admitted(triplets, most, mentions).where("name IS NOT NULL").select("name")


def cap_counts(held: DataFrame) -> DataFrame:
    """One row of what the cap cost, of the table that ``admitted`` gives: entities_dropped, entities_evicted, triplets_dropped_by_cap."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return held.agg(total("entities_dropped"), total("entities_evicted"), total("triplets_dropped_by_cap"))


ADMITTED = "name string, entities_dropped long, entities_evicted long, triplets_dropped_by_cap long"


def admitted(triplets: DataFrame, most: int, mentions: DataFrame | None = None) -> DataFrame:
    """name, and a row without a name that counts what the cap cost, if it was reached.

    Beyond the cap names are admitted in order of statement, and for each new one the least of those with one document is evicted:
    n_docs * (degree + 1) * (1 + characters of its description / 100), the first admitted of equal ones. A document's
    descriptions (``mentions``) count once its triplets are in. This rule depends on the order of all triplets, so it is one
    sequential fold; it holds the names and pairs of a graph within the cap, and a heap of the evictable names.
    """
    whole = _named(triplets.select("doc_id", "seq", F.col("source").alias("s"), F.col("target").alias("t")), "s", "t").where("s <> '' and t <> ''")
    ends = whole.select("doc_id", F.lit(0).alias("stage"), "seq", "s", "t", F.lit(0).alias("chars"))
    names = ends.select(F.explode(F.array("s", "t")).alias("name")).distinct()
    if names.limit(most + 1).count() <= most:
        return names.select("name", *(F.lit(None).cast("long").alias(c) for c in ("entities_dropped", "entities_evicted", "triplets_dropped_by_cap")))
    if mentions is not None:
        told = mentions.select("doc_id", F.lit(1), F.col("seq").cast(triplets.schema["seq"].dataType), entity_name(F.col("name")), F.lit(None).cast("string"), F.length("description"))
        ends = ends.unionAll(told.where(F.coalesce(F.length("description"), F.lit(0)) > 0))

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: dict[str, set] = {}
        told: dict[str, int] = {}
        links: dict[str, set] = {}
        since: dict[str, int] = {}
        heap: list = []

        def score(x: str) -> float:
            return (len(links[x]) + (x in links[x]) + 1) * (1 + told[x] / 100)  # a loop counts twice

        def touch(x: str) -> None:
            if x in docs and len(docs[x]) == 1:
                heapq.heappush(heap, (score(x), since[x], x))

        def evictable(pair: set) -> str | None:
            aside, out = [], None
            while heap:
                top = heapq.heappop(heap)
                if top[2] not in docs or len(docs[top[2]]) > 1 or top[:2] != (score(top[2]), since[top[2]]):
                    continue  # an older state of the name
                if top[2] not in pair:
                    out = top[2]
                    break
                aside.append(top)
            for x in aside:
                heapq.heappush(heap, x)
            return out

        n = dropped = evicted = 0
        for p in parts:
            for doc_id, s, t, chars in zip(p["doc_id"], p["s"], p["t"], p["chars"], strict=True):
                if t is None:
                    if s in docs:
                        told[s] = min(DESCRIPTION_CHARS, told[s] + chars + (len(SEPARATOR) if told[s] else 0))
                        touch(s)
                    continue
                ok = True
                for x in (s, t):
                    if x in docs:
                        docs[x].add(doc_id)
                        continue
                    if len(docs) >= most:
                        out = evictable({s, t})
                        if out is None:
                            ok = False
                            dropped += 1
                            break
                        evicted += 1
                        for other in links.pop(out) - {out}:
                            links[other].discard(out)
                            touch(other)
                        del docs[out], told[out], since[out]
                    n += 1
                    docs[x], told[x], links[x], since[x] = {doc_id}, 0, set(), n
                    touch(x)
                if ok and t not in links[s]:
                    links[s].add(t)
                    links[t].add(s)
                    touch(s)
                    touch(t)
        none = [None] * len(docs)
        columns = {"name": [*docs, None]} | {c: pd.Series([*none, k], dtype="Int64") for c, k in (("entities_dropped", dropped), ("entities_evicted", evicted), ("triplets_dropped_by_cap", dropped))}
        yield pd.DataFrame(columns)

    return ends.repartition(1).sortWithinPartitions("doc_id", "stage", "seq").mapInPandas(fold, ADMITTED)


def stats(relations: DataFrame, names: DataFrame, keywords: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """One row: n_entities, n_docs, entities_per_doc, n_edges, n_components, what the cap cost, documents with keywords and keywords, memory_mb.

    ``names``: name, doc_id. ``held``: what ``admitted`` gave. The memory is that of the characters of names and relations.
    """
    linked = stored(edges(relations), "edges")
    sizes = names.agg(F.count_distinct("name").alias("n_entities"), F.count_distinct("doc_id").alias("n_docs"), (F.count_distinct("doc_id", "name") / F.nullif(F.count_distinct("doc_id"), F.lit(0))).alias("entities_per_doc"))
    parts = [
        sizes.withColumn("entities_per_doc", F.coalesce("entities_per_doc", F.lit(0.0))),
        linked.agg(F.count(F.lit(1)).alias("n_edges")),
        components(linked).agg(F.count_distinct("root").alias("n_components")),
        relations.agg(F.round(F.coalesce(F.sum(F.octet_length("lo") + F.octet_length("hi") + F.octet_length("relation")), F.lit(0)) / (1 << 20), 2).alias("memory_mb")),
    ]
    if keywords is not None:
        parts.append(keywords.where("size(keywords) > 0").agg(F.count(F.lit(1)).alias("docs_with_keywords"), F.coalesce(F.sum(F.size("keywords")), F.lit(0)).cast("long").alias("n_keywords")))
    if held is not None:
        parts.append(cap_counts(held))
    rows = [p.withColumn("_g", F.lit(0)) for p in parts]  # one row each
    return reduce(lambda a, b: a.join(b, "_g"), rows).drop("_g")
