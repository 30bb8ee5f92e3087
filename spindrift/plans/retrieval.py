"""Two retrievers over a corpus (doc_id, title, content): by vectors alone, and by a knowledge graph with three more indexes.

``index_documents`` makes the tables of a retriever, ``retrieve`` its ranked rows: query_id, rank, doc_id, score, content, fallback.
What fails for some queries leaves them without rows and is told in ``errors``. Tables and answers of models are stored, never kept in executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import full_text
from ..operators import graph, ranking
from ..operators.vectors import nearest
from ..sources.datasets import exists, fingerprint, load_graph, save_graph
from . import extraction, logs
from .providers import Embedder, Model, embed_column
from .storage import stored

MODES = ("hybrid", "local", "global", "naive")
STRATEGIES = ("SIMPLE_VECTOR", "LIGHT_RAG")
CONTEXT_ENTITIES = 30
#: A ``max_text_chars`` that no text exceeds.
WHOLE_TEXTS = 2**31 - 1
RANKED = ["query_id", "rank", "doc_id", "score", "content", "fallback"]


@dataclass
class GraphSettings:
    mode: str = "hybrid"
    max_text_chars: int = 3000
    docs_per_call: int = 5
    gleaning_rounds: int = 0
    max_entities: int = 100_000
    neighbours: int = 5
    keyword_index: bool = True
    description_synthesis: bool = False
    description_chars: int = 500
    cache: str | None = None

    def faults(self) -> list[str]:
        out = [f"{k} must be positive" for k in ("max_text_chars", "docs_per_call", "max_entities", "neighbours") if getattr(self, k) <= 0]
        out += ["gleaning_rounds must not be negative"] * (self.gleaning_rounds < 0)
        return out + [f"unknown mode {self.mode}"] * (self.mode not in MODES)


#: The headings of what a model is shown.
ENTITY_HEAD, RELATION_HEAD, CHUNK_HEAD = "Knowledge Graph Data (Entity)", "Knowledge Graph Data (Relationship)", "Document Chunks"


class Retriever(Protocol):
    def index_documents(self, corpus: DataFrame) -> None: ...
    def retrieve(self, queries: DataFrame, top_k: int | None = None) -> DataFrame: ...
    def clear_index(self) -> None: ...
    @property
    def is_indexed(self) -> bool: ...


def _indexed(rows: DataFrame, key: str, text: str, embedder: Embedder, label: str) -> DataFrame:
    """(key, vector) of a text per key, stored."""
    return stored(embed_column(rows, text, embedder).select(key, "vector"), label)


def _asked(texts: DataFrame, embedder: Embedder, label: str) -> DataFrame:
    """id, text, vector, error of the distinct texts (text, and perhaps vector), stored: numbers last as long as the table."""
    if "vector" in texts.columns:
        told = texts.dropDuplicates(["text"]).withColumn("error", F.lit(None).cast("string"))
    else:
        told = embed_column(texts.distinct(), "text", embedder, error="error")
    return stored(told.withColumn("id", F.monotonically_increasing_id()), label)


def _search(texts: DataFrame, index: DataFrame, key: str, k: int, metric: str) -> DataFrame:
    """text, pos (0-based), key, distance of the k nearest entries of an index (key, vector) for each text of ``_asked``."""
    hits = nearest(texts.select("id", "vector"), index.select(F.col(key).alias("id"), "vector"), k, metric).withColumnRenamed("id", "key")
    return hits.join(texts.select(F.col("id").alias("query_id"), "text"), "query_id").select("text", (F.col("rank") - 1).alias("pos"), "key", "distance")


class VectorRetriever:
    """Nearest documents by squared Euclidean distance of unit vectors (the order of cosine distance)."""

    def __init__(self, embedder: Embedder, retrieval_k: int = 20):
        self.embedder, self.retrieval_k = embedder, retrieval_k
        self.clear_index()

    @property
    def is_indexed(self) -> bool:
        return self.chunks is not None

    @property
    def strategy_used(self) -> str:
        return "SIMPLE_VECTOR"

    def clear_index(self) -> None:
        self.chunks = self.vectors = self.errors = None

    def index_documents(self, corpus: DataFrame) -> None:
        self.chunks = stored(corpus.select(F.col("doc_id").cast("string").alias("doc_id"), full_text(F.col("title"), F.col("content")).alias("content")), "chunks")
        self.vectors = _indexed(self.chunks, "doc_id", "content", self.embedder, "chunk-vectors")

    def retrieve(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """``queries`` has (query_id, query_text); a vector column, where there is one, is used instead of the text.

        Without an index, and where the embedder fails, a query has no rows; ``errors`` (query_id, error) says why.
        """
        if not self.is_indexed:
            self.errors = queries.select("query_id", F.lit("nothing is indexed").alias("error"))
            kind = dict(queries.dtypes)["query_id"]
            return queries.sparkSession.createDataFrame([], f"query_id {kind}, rank int, doc_id string, score double, content string, fallback string")
        k = top_k or self.retrieval_k
        asked = queries.select("query_id", F.coalesce("query_text", F.lit("")).alias("text"), *(["vector"] if "vector" in queries.columns else []))
        texts = _asked(asked.drop("query_id"), self.embedder, "asked")
        self.errors = asked.select("query_id", "text").join(texts.where("error IS NOT NULL").select("text", "error"), "text").select("query_id", "error")
        hits = _search(texts, self.vectors, "doc_id", k, "l2").withColumnRenamed("key", "doc_id")
        found = contents(asked.drop("vector").join(hits, "text"), self.chunks)
        return found.select("query_id", (F.col("pos") + 1).alias("rank"), "doc_id", (1 - F.col("distance") / 2).alias("score"), "content", F.lit(None).cast("string").alias("fallback"))

    def retrieve_by_vector(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """As ``retrieve``, for queries that bring their vectors."""
        if "vector" not in queries.columns:
            raise ValueError("the queries have no vectors")
        return self.retrieve(queries, top_k)


def contents(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``found`` with the content of each doc_id; documents that are not in store, or empty, are left out."""
    return found.join(chunks.select("doc_id", "content"), "doc_id").where("content <> ''")


def build_graph(corpus: DataFrame, model: Model, settings: GraphSettings) -> dict[str, DataFrame]:
    """The graph's tables: nodes (name, type, description), node_docs (name, doc_id), relations (with co-occurrences, weight),
    neighbours, keywords (doc_id, keywords), extraction (the counts of the model's answers), stats (of the graph) and events."""
    found = extraction.extract(corpus, model, settings.docs_per_call, settings.max_text_chars, settings.gleaning_rounds)
    said = extraction.triplets(found)
    told = extraction.mentions(found)
    held = stored(graph.admitted(said, settings.max_entities, told), "graph-names")
    stay = held.where("name IS NOT NULL").select("name")
    stated = stored(graph.edge_relations(said).join(stay.withColumnRenamed("name", "lo"), "lo", "left_semi").join(stay.withColumnRenamed("name", "hi"), "hi", "left_semi"), "graph-relations")
    ends = stated.select(F.explode(F.array("lo", "hi")).alias("name"), "doc_id", "seq").distinct()
    node_docs = stored(ends.select("name", "doc_id").distinct(), "graph-node-docs")
    known = graph.known_mentions(told, node_docs)
    blank = ends.select("doc_id", F.col("seq").cast("long").alias("seq"), "name", F.lit("UNKNOWN").alias("type"), F.lit("").alias("description"))
    nodes = graph.entities(known.unionByName(blank)).drop("n_docs")
    if settings.description_synthesis:
        nodes = extraction.synthesized_descriptions(nodes, known, model, settings.description_chars)
    together = graph.cooccurrence(stated, node_docs).select("lo", "hi", F.col("lo").alias("source"), F.col("hi").alias("target"), F.lit("co-occurs").alias("relation"), F.lit("").alias("description"), "doc_id", F.lit(0).cast("long").alias("seq"))
    relations = stored(stated.unionByName(together), "graph-all-relations")
    keywords = graph.chunk_keywords(found.where("round = 0").select("doc_id", F.lit(0).alias("seq"), "keywords"))
    failed = found.where("round > 0 AND NOT parsed").select(F.lit("gleaning_error").alias("event"))
    return {
        "nodes": stored(nodes, "graph-nodes"),
        "node_docs": node_docs,
        "relations": stored(graph.weighted_relations(relations), "graph-weighted"),
        "neighbours": stored(graph.neighbours(relations, settings.neighbours), "graph-neighbours"),
        "keywords": keywords,
        "extraction": extraction.extraction_stats(found),
        "stats": graph.stats(relations, node_docs, keywords, held),
        "events": failed,
    }


def fallback_reasons(words: DataFrame, fused: DataFrame, ranked: DataFrame, mode: str) -> DataFrame:
    """query_id, fallback of the queries (query_id, low, high) without a row in ``ranked``: why vectors must serve them."""
    names, themes = mode_levels(mode)
    found = (F.size("low") if names else F.lit(0)) + (F.size("high") if themes else F.lit(0))
    lacking = words.select("query_id", (found > 0).alias("_words")).join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    told = lacking.join(fused.select("query_id").distinct().withColumn("_has", F.lit(True)), "query_id", "left")
    return told.select("query_id", F.when(~F.col("_words"), "no_keywords").when(F.col("_has").isNull(), "no_doc_ids").otherwise("docs_not_in_store").alias("fallback"))


def cap_alert(dropped: int, kept: int) -> str | None:
    """``error`` if the cap on entities dropped more than a tenth of those seen, ``warning`` if it dropped any."""
    if dropped <= 0:
        return None
    return "error" if dropped / (dropped + kept) > 0.1 else "warning"


def entity_texts(nodes: DataFrame) -> DataFrame:
    """name, t: what the index of entities embeds."""
    return nodes.select("name", F.when(F.col("description") != "", F.concat_ws(": ", "name", "description")).otherwise(F.col("name")).alias("t"))


def relation_texts(relations: DataFrame) -> DataFrame:
    """key, lo, hi, source, target, relation, description, weight: the first stated row of each relation, its description being what the index embeds."""
    first = F.min(F.struct("doc_id", "seq", "lo", "hi", "source", "target", "relation", "description", "weight")).alias("f")
    one = relations.groupBy(F.concat_ws(" -> ", "source", "relation", "target").alias("key")).agg(first).select("key", "f.*")
    said = F.when(F.col("description") != "", F.concat_ws(": ", "key", "description")).otherwise(F.col("key"))
    return one.select("key", "lo", "hi", "source", "target", "relation", said.alias("description"), "weight")


def keyword_texts(keywords: DataFrame) -> DataFrame:
    return keywords.select("doc_id", F.array_join("keywords", ", ").alias("t"))


def mode_levels(mode: str) -> tuple[bool, bool]:
    """Whether a mode uses the names of a query (entities), and its themes (relations and keywords)."""
    return mode in ("hybrid", "local"), mode in ("hybrid", "global")


class GraphRetriever(VectorRetriever):
    """Entities, relations and themes of a query, each looked up in its own index, then fused to documents.

    A query without a result in the graph falls back to vectors; ``fallback`` says why (no_keywords, no_doc_ids,
    docs_not_in_store). The mode ``local`` uses names and entities, ``global`` themes, relations and keywords, ``hybrid`` both,
    ``naive`` vectors alone. If no graph can be built, ``degraded`` holds the reason and vectors serve every query.
    """

    def __init__(self, embedder: Embedder, model: Model, settings: GraphSettings | None = None, retrieval_k: int = 20):
        self.settings, self.model = settings or GraphSettings(), model
        if self.settings.faults():
            raise ValueError("; ".join(self.settings.faults()))
        super().__init__(embedder, retrieval_k)

    def clear_index(self) -> None:
        super().clear_index()
        self.graph = self.entities = self.relations = self.keywords = self.degraded = self.alert = self.events = None
        self._told = []

    @property
    def strategy_used(self) -> str:
        return "SIMPLE_VECTOR" if self.graph is None else "LIGHT_RAG"

    def index_documents(self, corpus: DataFrame) -> None:
        super().index_documents(corpus)
        if self.settings.mode == "naive":
            return
        try:
            self._index_graph(self._graph(self.chunks))
        except Exception as e:  # the contract: vectors go on serving
            self.graph = self.entities = self.relations = self.keywords = None
            self.degraded = f"{type(e).__name__}: {str(e)[:300]}"
            logs.event("graph_failed", error=self.degraded)

    def _index_graph(self, g: dict[str, DataFrame]) -> None:
        self.entities = _indexed(entity_texts(g["nodes"]), "name", "t", self.embedder, "entity-vectors")
        self.first = stored(relation_texts(g["relations"]), "relation-texts")
        self.relations = _indexed(self.first, "key", "description", self.embedder, "relation-vectors")
        if self.settings.keyword_index:
            self.keywords = _indexed(keyword_texts(g["keywords"]), "doc_id", "t", self.embedder, "keyword-vectors")
        if "stats" in g:
            row = g["stats"].first()
            self.alert = cap_alert(row["entities_dropped"], row["n_entities"])
            if self.alert:
                logs.event("kg_entity_cap", level=self.alert, dropped=row["entities_dropped"], kept=row["n_entities"], cap=self.settings.max_entities)
        self.graph = g

    def _graph(self, corpus: DataFrame) -> dict[str, DataFrame]:
        s = self.settings
        if not s.cache:
            return build_graph(corpus, self.model, s)
        spark = corpus.sparkSession
        print_ = fingerprint(corpus, s.max_text_chars, s.max_entities)
        path = f"{s.cache}/{print_}-{s.docs_per_call}-{s.gleaning_rounds}-{s.neighbours}-{int(s.description_synthesis)}"
        held = load_graph(spark, path) if exists(spark, f"{path}/kg.json") else None
        if held is None:
            save_graph(build_graph(corpus, self.model, s), path, print_)
            held = load_graph(spark, path)
        return held

    def _hits(self, words: DataFrame, level: str, index: DataFrame, key: str, channel: str) -> DataFrame:
        """Deduplicated, ranked hits of one channel."""
        each = words.select("query_id", F.posexplode(level).alias("kw_idx", "text"))
        vectors = _asked(each.select("text"), self.embedder, "keyword-texts")
        event = "chunk_keywords_vdb_error" if channel == "keyword" else "retrieval_error"
        self._told.append(vectors.where("error IS NOT NULL").select(F.lit(event).alias("event")))
        found = each.join(_search(vectors, index, key, ranking.TOP[channel], "cosine"), "text")
        return stored(ranking.channel_hits(found.select("query_id", "kw_idx", "pos", "key", "distance"), channel), f"{channel}-hits")

    def search(self, queries: DataFrame, top_k: int | None = None) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
        """Ranked rows, and the entities and relations to show a model: (query_id, rank, line) each, None where the mode has none."""
        k, s = top_k or self.retrieval_k, self.settings
        if self.graph is None:
            return super().retrieve(queries, k), None, None
        words = stored(extraction.query_keywords(queries, self.model), "words")
        self._told = [words.where("NOT parsed").select(F.lit("keywords_parse_failure").alias("event"))]
        docs = self.graph["node_docs"].select(F.col("name").alias("key"), "doc_id")
        names, themes = mode_levels(s.mode)
        parts, entity_lines, shown_relations = [], None, None
        if names:
            hits = self._hits(words, "low", self.entities, "name", "entity")
            parts.append(ranking.entity_scores(hits, docs))
            entity_lines = self._entity_lines(hits)
        if themes:
            hits = self._hits(words, "high", self.relations, "key", "relation").join(self.first, "key")
            parts.append(ranking.relation_scores(hits, docs))
            shown_relations = relation_lines(hits, self.graph["nodes"])
            if self.keywords is not None:
                parts.append(ranking.keyword_scores(self._hits(words, "high", self.keywords, "doc_id", "keyword")))
        self.events = reduce(DataFrame.unionAll, self._told)  # what went wrong, a row each
        fused = stored(ranking.fuse(parts, k), "fused")
        ranked = contents(fused, self.chunks).select("query_id", "rank", "doc_id", "score", "content")
        why = stored(fallback_reasons(words, fused, ranked, s.mode), "fallbacks")
        vector = super().retrieve(queries.join(why, "query_id", "left_semi"), k).drop("fallback").join(why, "query_id")
        return ranked.withColumn("fallback", F.lit(None).cast("string")).select(*RANKED).unionByName(vector.select(*RANKED)), entity_lines, shown_relations

    def retrieve(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        return self.search(queries, top_k)[0]

    def _entity_lines(self, hits: DataFrame) -> DataFrame:
        near = F.struct("rank", ranking.json_line(entity=F.col("neighbour"), relation=F.col("label"), score=F.col("score")).alias("t"))
        by = self.graph["neighbours"].groupBy(F.col("node").alias("name")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(near)), lambda x: x["t"]), ", ").alias("near"))
        shown = hits.where(F.col("rank") < CONTEXT_ENTITIES).select("query_id", "rank", F.col("key").alias("name")).join(self.graph["nodes"], "name").join(by, "name", "left")
        plain = ranking.json_line(entity=F.col("name"), type=F.col("type"), description=F.col("description"))
        line = F.when(F.col("near").isNull(), plain).otherwise(F.concat(F.substring(plain, F.lit(1), F.length(plain) - 1), F.lit(', "neighbors": ['), "near", F.lit("]}")))
        return shown.select("query_id", "rank", line.alias("line"))


def relation_lines(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, rank, line of relation hits, with what is known of both ends; an end that is no node has none."""
    of = lambda end: nodes.select(F.col("name").alias(end), F.col("description").alias(f"{end}_description"), F.col("type").alias(f"{end}_type"))
    told = hits.join(of("source"), "source", "left").join(of("target"), "target", "left")
    c: dict[str, Column] = {n: F.col(n) for n in ("source", "target", "relation", "description", "vdb_distance", "weight", "source_description", "source_type", "target_description", "target_type")}
    return told.withColumnRenamed("distance", "vdb_distance").select("query_id", "rank", ranking.json_line(**c).alias("line"))


def neighbour_coverage(neighbours: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, with_neighbours, mean_neighbours (over all entities of the query, 3 places) of (query_id, name) rows and a table of neighbours (node)."""
    n = neighbours.groupBy(F.col("node").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    counted = hits.join(n, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return counted.groupBy("query_id").agg(F.count_if(F.col("n") > 0).alias("with_neighbours"), F.bround(F.avg("n"), 3).alias("mean_neighbours"))


def retriever(strategy: str, embedder: Embedder, model: Model | None = None, settings: GraphSettings | None = None, retrieval_k: int = 20) -> VectorRetriever:
    """The retriever of a strategy; without a model, vectors alone."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    if strategy == "LIGHT_RAG" and model is not None:
        return GraphRetriever(embedder, model, settings, retrieval_k)
    return VectorRetriever(embedder, retrieval_k)


def structured_context(queries: DataFrame, ranked: DataFrame, entities: DataFrame | None, relations: DataFrame | None, max_chars: int, mode: str) -> DataFrame:
    """query_id, context, n_chunks: sections of JSON lines in budgets; what the graph leaves goes to the chunks, which are numbered from 1."""
    e, r, base = ranking.section_budgets(max_chars, mode)
    out = queries.select("query_id").distinct()
    heads, spare = [], F.lit(base)
    for name, rows, budget, label in (("e", entities, e, ENTITY_HEAD), ("r", relations, r, RELATION_HEAD)):
        if rows is None or budget <= 0:
            spare = spare + budget
            continue
        body = ranking.section(rows, "query_id", ["rank"], "line", budget + 1)  # the last line ends without a newline
        out = out.join(body.select("query_id", F.concat(F.lit(f"{label}:\n\n```json\n"), "body", F.lit("\n```")).alias(name)), "query_id", "left")
        heads.append(F.col(name))
        spare = spare + F.when(F.col(name).isNull(), budget).otherwise(F.greatest(F.lit(0), budget - F.length(name)))
    sized = out.withColumn("_spare", spare)
    w = Window.partitionBy("query_id").orderBy("rank")
    numbered = ranked.select("query_id", "rank", "content").withColumn("_i", F.row_number().over(w)).join(sized.select("query_id", "_spare"), "query_id")
    lines = numbered.withColumn("_l", ranking.json_line(reference_id=F.col("_i"), content=F.col("content")))
    used = lines.withColumn("_u", F.sum(F.length("_l") + 1).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_u <= _spare")
    packed = used.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_i", "_l"))).alias("_a"))
    chunks = packed.select("query_id", F.size("_a").alias("n_chunks"), F.concat(F.lit(f"{CHUNK_HEAD}:\n\n```json\n"), F.array_join(F.transform("_a", lambda x: x["_l"]), "\n"), F.lit("\n```")).alias("_c"))
    whole = F.concat_ws("\n\n", *heads, F.col("_c"))
    return sized.join(chunks, "query_id", "left").select("query_id", F.when(whole == "", ranking.NOTHING).otherwise(whole).alias("context"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
