"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents long, so their Jaccard similarity says little: what counts is containment, the
share of an item's five-word shingles that a document has. Documents are partitioned by the number of their
shingles, in powers of two. A partition with sizes up to u turns the containment threshold t for the smallest item of q
shingles into t q shared of q + u shingles for the least similar pair it must find, and that into its own
number of minhash coordinates: enough for one agreement in any of them with probability ``RECALL``. Coordinates
are bins of one permutation, so a document costs one hash per shingle, and a bin holds one minimum: a shared shingle
agrees unless a smaller one of either is in its bin, and all shared ones must fail for a miss. Items are
hashed into the same bins; a bin with equal minima makes a candidate (agreement means a shared shingle).
Items of few shingles would need more bins than a document has shingles: of up to ``EXACT`` shingles, each shingle is looked up, and
none is missed.
Every candidate is verified exactly: the distinct shingles of the item found in the whole document over those of the item.

The items of the benchmark are taken in blocks of ``BLOCK_SHINGLES`` shingles, each sent to the tasks by a broadcast of
that bounded size; more items mean more passes, not larger ones: with more than one block, the hits of each are stored and its broadcast is
destroyed before the next one is read, so one block at a time is held by the driver and the executors. No pair of a document and an item is formed before a bin agrees.

Cases: null and empty texts have no shingles, are never hits and never contaminated. An item of 1 to 4 words has one
shingle of all its words: it is searched among the runs of as many words. Items without words are ignored. Repeated items
and documents are hits of their own; null ids of items or documents stay null. A very long text is searched whole, as a block of its own. Empty tables give no hits. Extra columns are ignored, and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, stored, table
from .words import SHINGLE, blocks, ngrams, normalised, trim, word_hashes

THRESHOLD = 0.8
RECALL = 0.999999
#: Items of so many shingles or fewer are looked up shingle by shingle.
EXACT = 10
#: Shingles of items in one broadcast (16 bytes each, and the ids).
BLOCK_SHINGLES = 500_000

HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shared", pa.int64()), ("item_shingles", pa.int64()), ("containment", pa.float64())])


def bins_for(upper: int, q: int, threshold: float, recall: float) -> int:
    """Coordinates of the partition with sizes up to ``upper``, for items of q shingles or more."""
    shared = max(1, math.ceil(threshold * q - 1e-9))
    if upper <= q <= shared:  # only equal sets
        return 1
    missed = (1 - recall) ** (1 / shared)  # of one shared shingle, at most
    low, high = 0.0, 1.0  # shingles of both in a bin
    hidden = lambda x: 1 + math.expm1(-x) / x
    while hidden(high) < missed:
        low, high = high, 2 * high
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if hidden(middle) < missed else (low, middle)
    return math.ceil((q + upper) / max(low, 1e-9))


class Items:
    """A block of items, searchable by the shingles of documents."""

    def __init__(self, ids: list, texts: list, width: int):
        """Items whose shingles have ``width`` words."""
        words, offsets = word_hashes(texts)
        grams, starts = ngrams(words, offsets, width)
        sets = [np.unique(grams[starts[i] : starts[i + 1]]) for i in range(len(texts))]
        self.width, self.ids, self.sizes = width, ids, np.array([len(s) for s in sets], np.int64)
        self.flat, self.owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(self.flat, kind="stable")
        self.flat, self.owner = self.flat[order], self.owner[order]
        few = self.sizes <= EXACT
        self.few, self.many = np.unique(self.flat[few[self.owner]]), ~few[self.owner]
        self.least = int(self.sizes[~few].min(initial=np.iinfo(np.int64).max))

    def minima(self, bins: int) -> np.ndarray:
        """Distinct (bin, minimum) of the items of more than ``EXACT`` shingles; the minimum alone names its bin."""
        flat = self.flat[self.many]
        key = self.owner[self.many] * bins + (flat % np.uint64(bins)).astype(np.int64)
        order = np.lexsort((flat, key))
        first = np.concatenate([[True], np.diff(key[order]) > 0])
        return np.unique(flat[order][first])


def _found(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def candidates(grams: np.ndarray, doc: np.ndarray, counts: np.ndarray, items: Items, threshold: float, recall: float) -> np.ndarray:
    """Documents (numbers) with a shingle of a small item, or a bin minimum that another item has in the same bin.

    Bins are sparse: only those are made in which a document has some item's minimum, so memory follows the shingles, not the bins.
    """
    out = [doc[_found(items.few, grams)]] if len(items.few) else []
    if not items.many.any():
        return np.unique(out[0])
    classes = np.where(counts > 0, np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64), -1)
    of = classes[doc]
    for c in np.unique(classes[classes >= 0]):
        bins = bins_for(1 << int(c), items.least, threshold, recall)
        wanted = items.minima(bins)
        here = of == c
        h, d = grams[here], doc[here]
        bin_ = d * bins + (h % np.uint64(bins)).astype(np.int64)
        told = np.unique(bin_[_found(wanted, h)])  # an item's minimum may be in them
        if not len(told):
            continue
        inside = _found(told, bin_)
        bin_, h = bin_[inside], h[inside]
        order = np.lexsort((h, bin_))
        least = order[np.concatenate([[True], np.diff(bin_[order]) > 0])]
        out.append(np.unique(bin_[least[_found(wanted, h[least])]] // bins))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def contained(shingles: np.ndarray, items: Items, threshold: float) -> list[tuple[int, int]]:
    """(item number, shared shingles) of the items that a document's distinct shingles contain."""
    a, b = np.searchsorted(items.flat, shingles, "left"), np.searchsorted(items.flat, shingles, "right")
    hit = np.flatnonzero(b > a)
    if not len(hit):
        return []
    length = (b - a)[hit]
    at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(a[hit], length)
    shared = np.bincount(items.owner[at], minlength=len(items.sizes))
    return [(int(i), int(shared[i])) for i in np.flatnonzero((shared > 0) & (shared >= threshold * items.sizes - 1e-9))]


def _search(held, threshold: float, recall: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[Items] = held.value
        for b in batches:
            ids, texts, out = b.column("doc_id").to_pylist(), b.column("text").to_pylist(), []
            for x, y in blocks(texts):
                words, offsets = word_hashes(texts[x:y])
                for items in groups:
                    grams, starts = ngrams(words, offsets, items.width)
                    counts = np.diff(starts)
                    doc = np.repeat(np.arange(y - x), counts)
                    for d in candidates(grams, doc, counts, items, threshold, recall):
                        for i, n in contained(np.unique(grams[starts[d] : starts[d + 1]]), items, threshold):
                            out.append((ids[x + d], items.ids[i], n, int(items.sizes[i]), n / int(items.sizes[i])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), HITS.types, strict=True)], schema=HITS)
        b = texts = words = None
        trim()

    return run


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block: int) -> Iterator[list[Items]]:
    """The benchmark in bounded blocks, each grouped by the width of its shingles; read row by row."""
    ids, texts, total = [], [], 0

    def built() -> list[Items]:
        groups: dict[int, list[int]] = {}
        _, offsets = word_hashes(texts)
        for i, n in enumerate(np.diff(offsets)):
            if n:
                groups.setdefault(min(int(n), SHINGLE), []).append(i)
        return [Items([ids[i] for i in at], [texts[i] for i in at], width) for width, at in groups.items()]

    for r in benchmark.select(F.col(item_col).cast("long"), F.col(text_col).cast("string")).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        total += len(normalised(r[1]).split())
        if total >= block:
            yield built()
            ids, texts, total = [], [], 0
    if ids:
        yield built()


def find_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK_SHINGLES, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Hits: doc_id, item_id, shared, item_shingles, containment."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, shared long, item_shingles long, containment double"
    found: list[DataFrame] = []
    waiting = None
    for groups in item_blocks(benchmark, item_col, item_text_col, block):
        if not groups:
            continue
        if waiting is not None:
            found.append(_pass(rows, waiting, threshold, recall, schema))
        waiting = groups
    if waiting is None:
        return spark.createDataFrame([], schema)
    if not found:
        return rows.mapInArrow(_search(spark.sparkContext.broadcast(waiting), threshold, recall), schema)
    return reduce(DataFrame.unionAll, [*found, _pass(rows, waiting, threshold, recall, schema)])


def _pass(rows: DataFrame, groups: list[Items], threshold: float, recall: float, schema: str) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(groups)
    hits = stored(rows.mapInArrow(_search(held, threshold, recall), schema), "hits")
    held.destroy()
    return hits


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that contain an item (of null ids, those whose own text does); all columns as they were."""
    found = stored(find_items(docs.where(F.col(id_col).isNotNull()), benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(id_col)).distinct(), "contaminated")
    alias = free_name(docs, "hit")
    kept = docs.join(found.withColumnRenamed(id_col, alias), F.col(id_col).cast("long") == F.col(alias), "left_anti")
    loose = docs.where(F.col(id_col).isNull())
    if loose.limit(1).count():
        text = options.get("text_col", "text")
        keyed = loose.withColumn(alias, F.xxhash64(text))
        bad = find_items(keyed, benchmark, id_col=alias, **options).select(F.col("doc_id").alias("bad")).distinct()
        kept = kept.where(F.col(id_col).isNotNull()).unionByName(keyed.join(bad, F.col(alias) == F.col("bad"), "left_anti").drop(alias))
    return kept


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def words_sql(column: str) -> str:
    return f"regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{N}}_]+')"


def _runs_sql(words: str, n: str) -> str:
    return f"[array_to_string(list_slice({words}, i, i + {n} - 1), ' ') FOR i IN range(1, len({words}) - {n} + 2)]"


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {words_sql("text")} AS w FROM documents),
b AS (SELECT row_number() OVER () AS item, item_id, w, least(len(w), {SHINGLE}) AS n FROM (SELECT item_id, {words_sql("text")} AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT DISTINCT item, item_id, n, unnest({_runs_sql("w", "n")}) AS s FROM b),
k AS (SELECT DISTINCT n FROM b),
ds AS (SELECT DISTINCT doc_id, n, unnest({_runs_sql("w", "n")}) AS s FROM d, k WHERE len(w) >= n),
c AS (SELECT item, count(*) AS item_shingles FROM bs GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, any_value(item_shingles) AS item_shingles, count(*) / any_value(item_shingles)::DOUBLE AS containment
FROM ds JOIN bs USING (n, s) JOIN c USING (item) GROUP BY doc_id, item, item_id HAVING count(*) >= {THRESHOLD} * any_value(item_shingles) - 1e-9
"""
