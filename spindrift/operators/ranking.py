"""Ranking, deduplication, fusion, packing and subsets as window plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from ..plans.storage import partitions, stored

THRESHOLD = 0.8
TOP = {"entity": 10, "relation": 20, "keyword": 20}
RELATION_CAP = 30
#: Rows that one task sums up, so that its tables stay in memory.
SUMMED = 1 << 20
#: Rows that ``fuse_hits`` sums up at once: their lists and spills are on disk together.
BLOCK_ROWS = 1 << 28
#: Fixed value: what stands for a context without documents.
NOTHING = "[No se encontraron documentos]"


def json_line(**values: Column) -> Column:
    """A JSON object on one line with ``", "`` and ``": "`` between its parts; a null member is left out."""
    bare = lambda v: F.regexp_replace(F.to_json(F.struct(v.alias("x"))), r'(?s)^\{"x":(.*)\}$', "$1")
    members = [F.when(v.isNotNull(), F.concat(F.lit(f'"{k}": '), bare(v))) for k, v in values.items()]
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def keep_first(rows: DataFrame, keys: list[str], order: list, limit: int | None = None, group: list[str] | None = None) -> DataFrame:
    """First row of each key by ``order``; with ``limit`` at most so many of each group (a limit of the feature)."""
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
    if limit is None:
        return first
    return first.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_rn") <= limit).drop("_rn")


def similarity(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / 2)


def channel_hits(hits: DataFrame, channel: str, threshold: float = THRESHOLD) -> DataFrame:
    """Deduplicated hits (query_id, kw_idx, pos, key, distance) of a channel with their 0-based rank.

    Entities keep their first hit, relations too (30 a query), keywords their best distance at their first place.
    """
    top = hits.where((F.col("pos") < TOP[channel]) & (F.col("distance") <= threshold))
    order = ["kw_idx", "pos", "key"]
    if channel == "keyword":
        one = top.groupBy("query_id", "key").agg(F.min("distance").alias("distance"), F.min(F.struct("kw_idx", "pos")).alias("at")).select("query_id", "key", "distance", "at.*")
    else:
        one = keep_first(top, ["query_id", "key"], order, RELATION_CAP if channel == "relation" else None, ["query_id"])
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)


def fuse(contributions: list[DataFrame], k: int) -> DataFrame:
    """query_id, rank, doc_id, score: sums of (query_id, doc_id, score) over channels; ties go to the smaller id."""
    from functools import reduce

    sums = reduce(DataFrame.unionByName, contributions).groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def doc_lists(node_docs: DataFrame, bits: int = 16) -> DataFrame:
    """key, base, docs: the distinct documents of each key (key, doc_id; repeated rows may be among them), stored.

    Whole numbers are held as their last ``bits`` (16, or 32 for short lists of ids far apart), the rest is ``base``. So a list that
    travels to many queries takes two bytes a document, or four, instead of a row. A null id has an empty list of its own without base.
    """
    doc, kind = F.col("doc_id"), node_docs.schema["doc_id"].dataType
    if _whole(kind):
        wide = doc.cast("long")
        base, place = F.shiftright(wide, bits), (wide.bitwiseAND(F.lit((1 << bits) - 1)) - (1 << bits - 1)).cast({16: "short", 32: "int"}[bits])
    else:
        base, place = F.when(doc.isNotNull(), F.lit(0).cast("long")), doc
    lists = stored(node_docs.select("key", base.alias("base"), place.alias("_p")).groupBy("key", "base").agg(F.collect_set("_p").alias("docs")), "doc-lists")
    lists._doc_kind, lists._bits = kind, bits
    return lists


def summed_rows(keys: list[DataFrame], lists: DataFrame) -> int:
    """The rows of documents that hits (key, a row for each) make of their ``doc_lists``."""
    from functools import reduce

    asked = reduce(DataFrame.unionAll, [k.select("key") for k in keys]).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(lists.select("key", F.size("docs").alias("m")), "key").agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0


def summing_tasks(rows: int, lists: DataFrame) -> int:
    """How many tasks to deal queries to, so that so many rows are no more than SUMMED a task."""
    return max(partitions(lists.sparkSession), -(-rows // SUMMED))


def fuse_hits(entity: DataFrame, relation: DataFrame, keyword: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """``fuse`` of the hits of three channels (stored) and ``doc_lists``: queries are dealt to blocks, whose results alone are kept."""
    from functools import reduce

    rows = summed_rows([entity, relation_ends(relation)], lists)
    blocks = max(1, -(-rows // BLOCK_ROWS))
    tasks = summing_tasks(-(-rows // blocks), lists)
    found = []
    for b in range(blocks):
        e, r, w = (x.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for x in (entity, relation, keyword))
        found.append(stored(fuse([entity_scores(e, lists, tasks), relation_scores(r, lists, tasks), keyword_scores(w).repartition(tasks, "query_id")], k), "fused"))
    return reduce(DataFrame.unionAll, found)


def _listed(lists: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, doc_id, score of rows (query_id, score, base, docs)."""
    doc = F.col("_p")
    if _whole(lists._doc_kind):
        doc = (F.shiftleft("base", lists._bits) + (doc.cast("long") + (1 << lists._bits - 1))).cast(lists._doc_kind)
    return rows.select("query_id", "score", "base", F.explode_outer("docs").alias("_p")).select("query_id", doc.alias("doc_id"), "score")


def _whole(kind) -> bool:
    return isinstance(kind, IntegerType | LongType)


def entity_scores(hits: DataFrame, node_docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """query_id, doc_id, score of ranked entity hits (query_id, key, rank, distance): each entity gives to all its documents (key, doc_id).

    With ``doc_lists`` for ``node_docs`` lists travel instead of rows, to as many ``tasks`` by query; sums by query and document then need no shuffle.
    """
    if "docs" not in node_docs.columns:
        return hits.join(node_docs, "key").select("query_id", "doc_id", _gain().alias("score"))
    found = hits.select("query_id", "key", _gain().alias("score")).join(node_docs, "key").select("query_id", "score", "base", "docs")
    return _listed(node_docs, found.repartition(tasks or partitions(hits.sparkSession), "query_id"))


def relation_scores(hits: DataFrame, node_docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """The same of relation hits (query_id, rank, distance, weight, lo, hi): each gives once to every document of either end."""
    ends = relation_ends(hits)
    if "docs" not in node_docs.columns:
        return ends.join(node_docs, "key").select("query_id", "rank", "score", "doc_id").distinct().select("query_id", "doc_id", "score")
    found = ends.join(node_docs, "key").select("query_id", "rank", "score", "base", "docs").repartition(tasks or partitions(hits.sparkSession), "query_id")
    once = found.groupBy("query_id", "rank", "score", "base").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("docs"))
    return _listed(node_docs, once)


def relation_ends(hits: DataFrame) -> DataFrame:
    """query_id, rank, score, key of both ends of relation hits."""
    return hits.select("query_id", "rank", (_gain() * F.col("weight")).alias("score"), F.explode(F.array("lo", "hi")).alias("key"))


def keyword_scores(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("key").alias("doc_id"), _gain().alias("score"))


def _gain() -> Column:
    return similarity(F.col("distance")) / (1 + F.col("rank"))


def rerank(rows: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """``rows`` (query_id, rank, id) by score, best first; a missing score counts 0; all other columns stay.

    Where ``scores`` tells a ``rerank_error``, the query keeps the order it had, ``reranked`` is false and the error is told.
    """
    told = scores if "rerank_error" in scores.columns else scores.withColumn("rerank_error", F.lit(None).cast("string"))
    by = Window.partitionBy("query_id")
    scored = rows.join(told, ["query_id", "id"], "left").withColumn("rerank_error", F.max("rerank_error").over(by))
    scored = scored.withColumn("reranked", F.col("rerank_error").isNull()).withColumn("rerank_score", F.when(F.col("reranked"), F.coalesce("rerank_score", F.lit(0.0))))
    return scored.withColumn("new_rank", F.row_number().over(by.orderBy(F.desc("rerank_score"), "rank"))).where(F.col("new_rank") <= top_n)


def pack_context(rows: DataFrame, group: str, order: list[str], content: str, max_chars: int) -> DataFrame:
    """group, n_docs, context: ``[Doc i]`` blocks in order, up to the first that would overflow.

    A block has 8 characters or more, and one of more than ``max_chars`` never fits, so of each group at most that many rows, and of
    each text at most one character more than fits, travel to where the context is packed.
    """
    w = Window.partitionBy(group).orderBy(*order)
    cut = F.substring(F.coalesce(content, F.lit("")), 1, max_chars + 1)
    first = rows.select(group, *order, cut.alias("_c")).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= max_chars // 8 + 1)
    block = first.withColumn("_b", F.concat(F.lit("[Doc "), F.col("_i"), F.lit("]\n"), F.col("_c")))
    used = F.sum(F.length("_b") + F.when(F.col("_i") > 1, 2).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = block.withColumn("_used", used).where(F.col("_used") <= max_chars)
    texts = kept.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_i", "_b"))).alias("_a"))
    packed = texts.select(group, F.size("_a").cast("long").alias("n_docs"), F.array_join(F.transform("_a", lambda x: x["_b"]), "\n\n").alias("context"))
    return rows.select(group).distinct().join(packed, group, "left").select(group, F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"), F.coalesce("context", F.lit("")).alias("context"))


def section_budgets(max_chars: int, mode: str) -> tuple[int, int, int]:
    """Characters for entities, relations and chunks: the graph takes half at most, scaled alike."""
    e = 24_000 if mode != "global" else 0
    r = 32_000 if mode != "local" else 0
    cap = max_chars // 2
    if e + r > cap:
        e, r = int(e * cap / (e + r)), int(r * cap / (e + r))
    return e, r, max_chars - e - r - 100


def section(rows: DataFrame, group: str, order: list[str], line: str, budget: int) -> DataFrame:
    """Lines of a section per group while they fit in ``budget - 60``: group, n_lines, body. No more of a line travels than can fit."""
    w = Window.partitionBy(group).orderBy(*order)
    cut = F.substring(F.col(line), 1, max(1, budget))
    numbered = rows.select(group, *order, cut.alias("_l")).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= max(1, budget))
    used = F.sum(F.length("_l") + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = numbered.withColumn("_used", used).where(F.col("_used") <= budget - 60)
    one = kept.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_i", "_l"))).alias("_a"))
    return one.select(group, F.size("_a").cast("long").alias("n_lines"), F.array_join(F.transform("_a", lambda x: x["_l"]), "\n").alias("body"))


def containing(docs: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, doc_id of the documents (doc_id, text) that hold an item's text (query_id, text) as it stands.

    White space parts a text into tokens; all but an item's first and last must be tokens of the document, so three of those in a
    row name the candidates, by an equi join with the few rows of the items, and only those are searched for the text. Items of fewer than five
    tokens, and those without text, are compared with every document.
    """
    asked = items.select("query_id", F.col("text").alias("_q")).where("_q IS NOT NULL")
    parts = F.split("_q", r"\s+")
    long = asked.withColumn("_w", parts).where(F.size("_w") >= 5).select("query_id", "_q", F.array_join(F.slice("_w", 2, 3), " ").alias("_k"))
    tokens = docs.select("doc_id", "text", F.split("text", r"\s+").alias("_w"))
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - 2), lambda i: F.array_join(F.slice("_w", i, 3), " "))
    grams = tokens.where(F.size("_w") >= 3).select("doc_id", F.explode(F.array_distinct(runs)).alias("_k"))
    candidates = grams.join(long, "_k").select("doc_id", "query_id", "_q")
    found = docs.select("doc_id", "text").join(candidates, "doc_id").where(F.contains("text", "_q")).select("query_id", "doc_id")
    short = asked.where(F.size(parts) < 5)
    return found.unionAll(docs.select("doc_id", "text").join(short, F.contains("text", "_q")).select("query_id", "doc_id")).distinct()


def call_groups(docs: DataFrame, per_call: int, buckets: int) -> DataFrame:
    """``docs`` with _bucket, _call (from 0) and _place (from 1): calls of ``per_call`` documents in order of id, within buckets of the id's digest."""
    digest = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long")
    w = Window.partitionBy("_bucket").orderBy("doc_id")
    placed = docs.withColumn("_bucket", (digest % buckets).cast("int")).withColumn("_n", F.row_number().over(w) - 1)
    return placed.withColumn("_call", F.floor(F.col("_n") / per_call).cast("int")).withColumn("_place", (F.col("_n") % per_call + 1).cast("int")).drop("_n")


def seeded_order(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def subset(queries: DataFrame, qrels: DataFrame, corpus: DataFrame, n_queries: int, size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Development subset: n queries in seeded order, all of their documents in the corpus, filled up to ``size``."""
    chosen = queries.withColumn("_o", seeded_order(seed, "query_id")).orderBy("_o").limit(n_queries).drop("_o")
    gold = qrels.join(chosen, "query_id", "left_semi").select("doc_id").distinct().join(corpus, "doc_id", "left_semi")
    n_gold = gold.count()
    if n_gold > size:
        raise ValueError(f"{n_gold} relevant documents exceed the subset of {size}")
    fill = corpus.join(gold, "doc_id", "left_anti").withColumn("_o", seeded_order(seed, "doc_id")).orderBy("_o").limit(size - n_gold).drop("_o")
    return chosen, corpus.join(gold, "doc_id", "left_semi").unionByName(fill)
