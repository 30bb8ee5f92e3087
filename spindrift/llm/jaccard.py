"""N-gram Jaccard join by chosen paths.

Every text becomes the set of its five-word shingles. Equal sets are one class, found by one aggregation
on a digest of the set, whatever their number. The join of different sets follows:

1. Each set is embedded into ``COORDINATES`` minhash tokens (coordinate, value); two sets share a
   token with a probability that is their Jaccard similarity.
2. Chosen paths: in each of ``REPEATS`` runs a set walks a random tree. At each node, one or two coordinates are
   sampled (1 / threshold on average), the same for all sets at that node, and the set goes to the child of its own
   token. Sets that meet at depth ``DEPTH`` shared every token of the path. A pair at the threshold survives a run with
   probability 0.58, so the target recall of 0.9999 takes 12 runs (``repeats_for``); more similar pairs survive oftener.
3. Buckets are compared by brute force on 2-bit minhash sketches, which travel with the rows. A bucket of more than
   ``SPLIT`` sets is dealt into parts, and each pair of parts is a bucket of its own, so a token path that very many sets share
   is spread over the tasks and no pair is left out. Each bucket yields a spanning forest of its similar
   sets (sets not reached yet are compared with those that are), so never all pairs of a group.
4. Candidate forests are joined into components. Within each, all pairs of different sets are compared
   exactly, in blocks of about ``SIDE`` sets or ``SIDE_SHINGLES`` shingles that are dealt over the tasks; blocks return numbers of
   links and a forest, never pairs. The classes are the components of the exact links.

A set is named by a 192-bit digest of its shingles, a row by its id and the SHA-256 of its text, so ids may repeat or be null.

Cases: null and empty texts, and those without a word, have no shingles: each is a class of its own without links. Texts of
1 to 4 words have one shingle of all their words. Rows that repeat an id are rows of their own, each in the class of its own text. Null ids
take part and are larger than any other; a class whose ids are all null has a null class_id. Empty input, empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import partitions, sent, stored, table, without
from .decontaminate import words_sql
from .words import blocks, mixed, shingle_sets, trim

THRESHOLD = 0.8
COORDINATES = 128
DEPTH = 4
RECALL = 0.9999
#: Sets in a bucket; larger ones are dealt into pairs of parts.
SPLIT = 8192
#: Sets, and shingles, on each side of an exact block.
SIDE, SIDE_SHINGLES = 256, 2_000_000


def survival(threshold: float = THRESHOLD, depth: int = DEPTH) -> float:
    """Probability that a pair at the threshold meets in one run."""
    two = 1 / threshold - 1  # probability of a second coordinate
    lost = 0.0
    for _ in range(depth):
        miss = 1 - threshold + threshold * lost
        lost = (1 - two) * miss + two * miss * miss
    return 1 - lost


def repeats_for(recall: float = RECALL, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth)))


_SEED = mixed(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64))
_ROWS = 1021


def _picks(threshold: float) -> np.ndarray:
    """Sampled coordinates by row of a table: one, and with probability 1 / threshold - 1 a second one (else -1)."""
    r = mixed(np.arange(3 * _ROWS, dtype=np.uint64) + np.uint64(12_345)).reshape(3, _ROWS)
    first = (r[0] % np.uint64(COORDINATES)).astype(np.int64)
    second = (first + 1 + (r[1] % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    return np.stack([first, np.where((r[2] >> np.uint64(11)).astype(float) / 2**53 < 1 / threshold - 1, second, -1)], 1)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """One row of COORDINATES 32-bit minima for each (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for i in range(COORDINATES):
        h = ((flat ^ _SEED[2 * i]) * (_SEED[2 * i + 1] | np.uint64(1))) >> np.uint64(32)
        out[:, i] = np.minimum.reduceat(h.astype(np.uint32), starts)
    return out


def sketches(minima: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, packed: COORDINATES / 32 numbers for each set."""
    two = (mixed(minima.astype(np.uint64)) >> np.uint64(62)).reshape(len(minima), -1, 32)
    return (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(2, dtype=np.uint64)


def paths(minima: np.ndarray, threshold: float, depth: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of all walks of all sets."""
    picks, n = _picks(threshold), len(minima)
    rows, leaves = [], []
    for r in range(repeats):
        row, node = np.arange(n), np.full(n, mixed(np.array([r + 1], np.uint64))[0])
        for _ in range(depth):
            chosen = picks[(node % np.uint64(_ROWS)).astype(np.int64)]
            parts = []
            for c in (0, 1):
                has = np.flatnonzero(chosen[:, c] >= 0)
                at = chosen[has, c]
                token = minima[row[has], at].astype(np.uint64) | (at.astype(np.uint64) << np.uint64(32))
                parts.append((row[has], mixed(node[has] * np.uint64(31) + mixed(token))))
            row, node = (np.concatenate(x) for x in zip(*parts, strict=True))
        rows.append(row)
        leaves.append(node)
    return np.concatenate(rows), np.concatenate(leaves)


def set_digest(s: np.ndarray) -> bytes:
    h = mixed(s + np.uint64(0x5851F42D4C957F2D))
    return np.array([s.sum(dtype=np.uint64), h.sum(dtype=np.uint64), len(s)], np.uint64).tobytes()


EMBEDDED = "id long, key binary, digest binary, n int, sketch binary, leaves array<long>"


def _embed(threshold: float, depth: int, repeats: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for x, y in blocks(texts):
                sets = shingle_sets(texts[x:y])
                full = [i for i, s in enumerate(sets) if len(s)]
                sketch: list = [None] * (y - x)
                leaves: list = [[]] * (y - x)
                if full:
                    minima = minhashes([sets[i] for i in full])
                    bits = sketches(minima)
                    row, leaf = paths(minima, threshold, depth, repeats)
                    order = np.lexsort((leaf, row))
                    row, leaf = row[order], leaf[order].view(np.int64)
                    cut = np.searchsorted(row, np.arange(len(full) + 1))
                    for k, i in enumerate(full):
                        sketch[i] = bits[k].tobytes()
                        leaves[i] = np.unique(leaf[cut[k] : cut[k + 1]])
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": b.column("id").slice(x, y - x),
                        "key": b.column("key").slice(x, y - x),
                        "digest": pa.array([set_digest(s) for s in sets], pa.binary()),
                        "n": pa.array([len(s) for s in sets], pa.int32()),
                        "sketch": pa.array(sketch, pa.binary()),
                        "leaves": pa.array(leaves, pa.list_(pa.int64())),
                    }
                )
        b = texts = sets = leaves = None
        trim()

    return run


_ODD = np.uint64(0x5555555555555555)


def alike(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Number of coordinates in which the 2-bit sketches agree."""
    x = many ^ one
    return COORDINATES - np.bitwise_count((x | (x >> np.uint64(1))) & _ODD).sum(1, dtype=np.int64)


def least_alike(threshold: float) -> int:
    """Agreements below which a pair is far (4.5 standard deviations) under the threshold."""
    p = 0.25 + 0.75 * threshold
    return math.floor(COORDINATES * p - 4.5 * math.sqrt(COORDINATES * p * (1 - p)))


def forest(sketch: np.ndarray, sizes: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Edges that connect all sets of a bucket which are alike, directly or through others."""
    least, edges = least_alike(threshold), []
    left = np.arange(len(sketch))
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            at = reached.pop()
            fits = (sizes[left] >= threshold * sizes[at]) & (sizes[at] >= threshold * sizes[left])
            hit = fits & (alike(sketch[at], sketch[left]) >= least)
            new = left[hit]
            edges += [(int(at), int(x)) for x in new]
            reached += new.tolist()
            left = left[~hit]
    return edges


def _buckets(threshold: float):
    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        bucket, sizes, digests = t.column("bucket").to_numpy(), t.column("n").to_numpy(), t.column("digest").to_pylist()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(-1, COORDINATES // 32)
        cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        out = set()
        for k in np.flatnonzero(np.diff(cut) > 1):
            a, b = int(cut[k]), int(cut[k + 1])
            for x, y in forest(sketch[a:b], sizes[a:b], threshold):
                p, q = digests[a + x], digests[a + y]
                out.add((p, q) if p < q else (q, p))
        return pa.RecordBatch.from_pydict({"src": pa.array([e[0] for e in out], pa.binary()), "dst": pa.array([e[1] for e in out], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_ = [], None  # pieces of the bucket that may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            bucket = b.column("bucket").to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1]))
            if last:
                yield found([*held, b.slice(0, last)])
                held = []
            elif held and open_ != bucket[-1]:
                yield found(held)
                held = []
            held.append(b.slice(last))
            open_ = bucket[-1]
        if held:
            yield found(held)
        b, held = None, []
        trim()

    return run


def exact_links(sets: list[np.ndarray], half: int, threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold; ``half`` > 0: only those between the first ``half`` and the others."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, slot, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[slot] > 1
    number = np.cumsum(count > 1) - 1
    slot, owner, width = number[slot[keep]], owner[keep], int((count > 1).sum())
    common = np.zeros((n, n), np.float32)
    order = np.argsort(slot, kind="stable")
    slot, owner = slot[order], owner[order]
    step = 8192
    for a in range(0, width, step):
        x, y = np.searchsorted(slot, (a, a + step))
        m = np.zeros((n, min(step, width - a)), np.float32)
        m[owner[x:y], slot[x:y] - a] = 1
        common += m @ m.T
    union = sizes[:, None] + sizes[None, :] - common
    hit = common >= threshold * union - 1e-6
    np.fill_diagonal(hit, False)
    if half:
        hit[:half, :half] = False
        hit[half:, half:] = False
    return hit


def _verify(threshold: float):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        t = t.sort_by([("side", "ascending"), ("digest", "ascending")])
        ids, weights = t.column("digest").to_pylist(), t.column("copies").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        half = int((t.column("side").to_numpy() == i).sum()) if i != j else 0
        hit = exact_links(sets, half, threshold)
        links = hit.astype(np.int64) @ weights
        edges, left = [], np.arange(len(ids))
        while len(left) > 1:
            reached, left = [left[0]], left[1:]
            while reached and len(left):
                at = reached.pop()
                new = left[hit[at, left]]
                edges += [(ids[at], ids[x]) for x in new]
                reached += new.tolist()
                left = left[~hit[at, left]]
        some = np.flatnonzero(links)
        return pa.table(
            {
                "digest": pa.array([*(ids[i] for i in some), *(e[0] for e in edges)], pa.binary()),
                "other": pa.array([*[None] * len(some), *(e[1] for e in edges)], pa.binary()),
                "links": pa.array([*links[some], *[0] * len(edges)], pa.int64()),
            }
        )

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").to_pylist()
        for x, y in blocks(texts):
            data = [s.tobytes() for s in shingle_sets(texts[x:y])]
            yield pa.RecordBatch.from_pydict({**{c: b.column(c).slice(x, y - x) for c in ("digest", "component", "parts", "copies")}, "shingles": pa.array(data, pa.binary())})


def text_key(column: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(column).cast("string"), F.lit("")), 256))


def buckets_of(sets: DataFrame, split: int) -> DataFrame:
    """bucket, digest, n, sketch: a row for each leaf of each set; of leaves with more than ``split`` sets, one for each pair of parts."""
    leaf = sets.select(F.explode("leaves").alias("bucket"), "digest", "n", "sketch")
    large = stored(leaf.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > split), "large-buckets")
    if not large.limit(1).count():
        return leaf
    parts = large.select("bucket", F.ceil(F.col("members") / F.lit(split)).cast("int").alias("parts"))
    known = leaf.join(sent(parts), "bucket", "left")
    mine = F.pmod(F.xxhash64("digest", "bucket"), F.col("parts")).cast("int")
    dealt = known.where("parts is not null").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    return known.where("parts is null").select(*leaf.columns).unionByName(dealt.select(pair.alias("bucket"), "digest", "n", "sketch"))


def _classes(docs: DataFrame, threshold: float, recall: float, depth: int, text_col: str, id_col: str, split: int) -> DataFrame:
    """id, key, class (null without shingles), class_id, n_links, class_rep of every row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    embedded = stored(texts.mapInArrow(_embed(threshold, depth, repeats_for(recall, threshold, depth)), EMBEDDED), "embedded-sets")

    first = F.struct(F.col("id").isNull().alias("none"), "id", "key", "n", "sketch", "leaves")
    sets = embedded.where("n > 0").groupBy("digest").agg(F.min(first).alias("f"), F.count(F.lit(1)).alias("copies"))
    sets = stored(sets.select("digest", F.col("f.id").alias("rep"), "f.key", "f.n", "f.sketch", "f.leaves", "copies"), "distinct-sets")

    met = buckets_of(sets, split).repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "digest")
    near = stored(met.mapInArrow(_buckets(threshold), "src binary, dst binary"), "candidates").distinct()
    component = connected_components(near)

    # exact comparison within components: members numbered, dealt into blocks, every pair of blocks once
    members = stored(component.withColumnRenamed("node", "digest").join(sets.select("digest", "rep", F.col("key").alias("text_key"), "n", "copies"), "digest"), "members")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(SIDE)), F.ceil(F.sum("n") / F.lit(SIDE_SHINGLES))).cast("int").alias("parts")
    wanted = sent(stored(members.drop("n").join(members.groupBy("component").agg(parts), "component"), "sized-members"))
    picked = texts.join(wanted, F.col("id").eqNullSafe(F.col("rep")) & (F.col("key") == F.col("text_key"))).select("digest", "component", "parts", "copies", "text")
    shingled = stored(picked.mapInArrow(_shingles, "digest binary, component binary, parts int, copies long, shingles binary").dropDuplicates(["digest"]), "shingles")
    dealt = shingled.withColumn("side", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pairs = dealt.withColumn("with", other).select("component", F.least("side", "with").alias("i"), F.greatest("side", "with").alias("j"), "side", "digest", "copies", "shingles")
    verified = stored(pairs.groupBy("component", "i", "j").applyInArrow(_verify(threshold), "digest binary, other binary, links long"), "links")
    links = verified.where("other is null").groupBy("digest").agg(F.sum("links").alias("links"))
    classes = connected_components(verified.where("other is not null"), "digest", "other").withColumnRenamed("node", "digest")

    named = sets.select("digest", "rep", "copies").join(links, "digest", "left").join(classes, "digest", "left").withColumn("class", F.coalesce("component", "digest"))
    ids = named.where("component is not null").groupBy("class").agg(F.min("rep").alias("least"))
    known = named.join(ids, "class", "left").select("digest", "class", F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("rep").alias("class_rep"))
    joined = embedded.where("n > 0").select("id", "key", "digest").join(known, "digest").drop("digest")
    alone = embedded.where("n = 0").select("id", "key", F.lit(None).cast("binary").alias("class"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("class_rep"))
    return joined.unionByName(alone)


def similar_texts(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = DEPTH, text_col: str = "text", id_col: str = "doc_id", split: int = SPLIT) -> DataFrame:
    """One row per row of ``docs``: id_col, class_id (smallest id of the class), n_links (documents linked to it), class_rep (smallest id with the same set)."""
    found = _classes(docs, threshold, recall, depth, text_col, id_col, split)
    return found.select(F.col("id").alias(id_col), "class_id", "n_links", "class_rep")


def drop_similar(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class (that with the smallest id; null ids are the largest), all columns as they were.

    Only the narrow rows of those that go are joined to the texts. Of rows that repeat both id and text, one stays.
    """
    found = _classes(docs, threshold, RECALL, DEPTH, text_col, id_col, SPLIT).where("class is not null").select("class", "id", "key")
    found = stored(found, "classes")
    best = found.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("f"), F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(found.join(best, "class").select("id", "key", (F.col("id").eqNullSafe(F.col("f.id")) & (F.col("key") == F.col("f.key"))).alias("stays")), "class-members")
    return without(docs, members, text_key(text_col), id_col)


def op5(spark, sf_dir: str) -> DataFrame:
    return similar_texts(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {words_sql("text")} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(list_slice(w, i, i + 4), ' ') FOR i IN range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS g
  FROM d WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b, c = x.n AND c = y.n AS equal FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {THRESHOLD} * (x.n + y.n - c) - 1e-9),
ends AS (SELECT a, b, equal FROM link UNION ALL SELECT b, a, equal FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN ends e ON e.a = r.other),
class AS (SELECT doc_id, min(other) AS class_id FROM reach GROUP BY 1),
sums AS (SELECT a AS doc_id, count(*) AS n_links, min(b) FILTER (equal) AS same FROM ends GROUP BY 1)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, least(doc_id, coalesce(same, doc_id)) AS class_rep FROM class LEFT JOIN sums USING (doc_id)
"""
