"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its tokens (words, and runs of signs; with letter case folded), each token's
shape (small, capitalised or capital letters, digits, the signs themselves, and the signs that end a
word), and all pairs of neighbouring tokens and shapes, hashed into ``2**bits`` slots. A slot's value is its count's
logarithm over the length of the vector, so long texts weigh no more than short ones. Whether a token repeats the one
before it is a shape too.

Training takes ``max_rows`` labelled rows at most (those with the smallest hash of the id: a
documented, bounded sample; it makes the model, and nothing else). Their sparse vectors are collected by one task, which
runs FTRL-proximal over them for a few epochs. The model is ``2**bits`` weights whatever the
input, so it is broadcast. Scoring is a sparse dot product for each text, wherever it was read.

Cases: a null text is empty; an empty text has only the bias and scores by that; labels that are null, or whose
row has no text, are ignored; several labels of a document are several rows. Without usable labels, or with one class only, every score
is the share of label 1 (0.5 if there are none). Null ids are scored, never trained on. Labels, language, source and id are no features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table
from .words import blocks, mixed, powers, trim

BITS = 18
#: Labelled rows that training uses at most; 20,000 rows hold some tens of MB of sparse vectors.
MAX_ROWS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.02
THRESHOLD = 0.3

_ALPHA, _UPPER, _DIGIT, _SIGN = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
for _b in range(33, 256):
    _KIND[_b] = _SIGN if _b < 128 and not chr(_b).isalnum() else _DIGIT if _b < 128 and chr(_b).isdigit() else _UPPER if _b < 128 and chr(_b).isupper() else _ALPHA
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(texts: list[str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: slots, values, and where each text's slots start."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*coded, b""]), np.uint8)
    n = len(texts)
    kind = _KIND[data]
    group = np.where(kind == _SIGN, 2, (kind > 0).astype(np.uint8))
    change = np.concatenate([[True], group[1:] != group[:-1]]) if len(data) else np.zeros(0, bool)
    first = np.flatnonzero(change & (group > 0))
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(n + 1, np.int64)
    edges = np.append(np.flatnonzero(change), len(data))
    ends = edges[np.searchsorted(edges, first, "right")]
    lengths = ends - first
    sign = group[first] == 2
    doc_ends = np.cumsum([len(c) + 1 for c in coded])
    doc = np.searchsorted(doc_ends, first, "right")
    inside = np.flatnonzero(group > 0)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(inside)) - np.repeat(starts, lengths)
    p = powers(int(lengths.max()))
    token = mixed(np.add.reduceat((_LOWER[data[inside]].astype(np.uint64) + np.uint64(1)) * p[place], starts) + lengths.astype(np.uint64))
    upper = np.add.reduceat((kind[inside] == _UPPER).astype(np.int32), starts)
    digit = np.add.reduceat((kind[inside] == _DIGIT).astype(np.int32), starts)
    glued = np.zeros(len(first), np.uint64)  # signs that follow a word without a space
    glued[:-1] = ((ends[:-1] == first[1:]) & ~sign[:-1]).astype(np.uint64)
    again = np.zeros(len(first), np.uint64)
    same = doc[1:] == doc[:-1]
    again[1:] = ((token[1:] == token[:-1]) & same).astype(np.uint64)
    case = np.where(digit * 2 > lengths, 5, np.where(upper == 0, 1, np.where((upper > 1) & (upper * 2 > lengths), 3, 2)))
    shape = mixed(np.where(sign, token, case.astype(np.uint64) * np.uint64(8) + glued * np.uint64(2) + again) + np.uint64(77))
    pair = lambda x: mixed(x[:-1] * np.uint64(3) + x[1:] * np.uint64(7_919))[same]
    hashes = np.concatenate([token, shape ^ np.uint64(1 << 60), pair(token) ^ np.uint64(2 << 60), pair(shape) ^ np.uint64(3 << 60)])
    docs = np.concatenate([doc, doc, doc[1:][same], doc[1:][same]])
    keys, counts = np.unique((docs.astype(np.int64) << bits) | (mixed(hashes) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    row, slot = keys >> bits, keys & ((1 << bits) - 1)
    values = np.log1p(counts)
    offsets = np.searchsorted(row, np.arange(n + 1))
    norm = np.sqrt(np.bincount(row, values * values, n))
    return slot, values / norm[row], offsets


def ftrl(slots: np.ndarray, values: np.ndarray, offsets: np.ndarray, labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights of the slots, then the bias, by FTRL-proximal, one update per row; ``rows`` names the rows in the order that the seed shuffles."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        zi = z[at]
        w = (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) > L1, w, 0.0)

    share = labels.mean() if len(labels) else 0.5
    if len(labels) and 0 < share < 1:
        order = np.random.default_rng(7)
        for _ in range(epochs):
            for k in order.permutation(len(labels)):
                i = k if rows is None else rows[k]
                at = np.append(slots[offsets[i] : offsets[i + 1]], size)
                x = np.append(values[offsets[i] : offsets[i + 1]], 1.0)
                w = weights(at)
                g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - labels[i]) * x
                g2 = g * g
                old = n[at]
                z[at] += g - (np.sqrt(old + g2) - np.sqrt(old)) / ALPHA * w
                n[at] = old + g2
        return weights(np.arange(size + 1))
    w = np.zeros(size + 1)
    w[size] = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    return w


def score(texts: list[str | None], model: np.ndarray) -> np.ndarray:
    bits = (len(model) - 1).bit_length() - 1
    out = np.zeros(len(texts))
    for a, b in blocks(texts):
        slot, value, offsets = features(texts[a:b], bits)
        row = np.repeat(np.arange(b - a), np.diff(offsets))
        out[a:b] = np.bincount(row, value * model[slot], b - a) + model[-1]
    return 1.0 / (1.0 + np.exp(-out))


def sample_of(rows: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows, those with the smallest hashes of their ids: the same ones at every run."""
    return rows.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> np.ndarray:
    """The model from at most ``max_rows`` labelled rows of ``docs``."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null")
    taken = F.broadcast(sample_of(marked, max_rows))  # max_rows narrow rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(taken, "id").select("id", "text", "label", F.xxhash64("text").alias("key"))

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for x, y in blocks(texts):
                slot, value, at = features(texts[x:y], bits)
                slots = [slot[at[i] : at[i + 1]].astype("<i4").tobytes() for i in range(y - x)]
                values = [value[at[i] : at[i + 1]].astype("<f4").tobytes() for i in range(y - x)]
                yield pa.RecordBatch.from_pydict({**{c: b.column(c).slice(x, y - x) for c in ("id", "label", "key")}, "slots": pa.array(slots, pa.binary()), "vals": pa.array(values, pa.binary())})
        b = texts = slot = value = slots = values = None
        trim()

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # vectors stay as narrow as they came, in the order in which they came; only their places are sorted
        keys, parts, sizes = [], ([], []), []
        for b in batches:
            keys += zip(*(b.column(c).to_pylist() for c in ("id", "label", "key")), strict=True)
            for held, name, kind in zip(parts, ("slots", "vals"), ("<i4", "<f4"), strict=True):
                column = b.column(name).cast(pa.binary())
                ends = np.frombuffer(column.buffers()[1], "<i4", len(column) + 1, 4 * column.offset) if len(column) else np.zeros(1, "<i4")
                held.append(np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).copy() if ends[-1] > ends[0] else np.zeros(0, kind))
            sizes.append(np.diff(ends) // 4)
        b = column = ends = None
        trim()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))]).astype(np.int64)
        flat = []
        for held, kind in zip(parts, ("<i4", "<f4"), strict=True):
            flat.append(np.concatenate([*held, np.zeros(0, kind)]))
            held.clear()
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        model = ftrl(*flat, offsets, np.array([k[1] for k in keys], float), bits, rows=order)
        flat.clear()
        trim()
        yield pa.RecordBatch.from_pydict({"model": pa.array([model.astype("<f4").tobytes()], pa.binary())})

    vectors = rows.mapInArrow(sparse, f"id {dict(rows.dtypes)['id']}, label int, key long, slots binary, vals binary")
    model = vectors.repartition(1).mapInArrow(fit, "model binary").collect()  # one row of 2**bits weights
    return np.frombuffer(model[0]["model"], "<f4").astype(float) if model else ftrl(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64), np.zeros(0), bits)


def scorer(spark: SparkSession, model: np.ndarray) -> Callable[[Column], Column]:
    """The model as a column function of a text."""
    held = spark.sparkContext.broadcast(model.astype("<f4"))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(texts.tolist(), held.value))
        texts = None
        trim()

    return scored


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training never sees: the remainder of the id's checksum by 5 is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def score_quality(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_rows: int = MAX_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the columns held_out, score and predicted (named apart from those there already)."""
    model = train(docs.where(~held_out(id_col)), labels.where(~held_out(id_col)), max_rows, text_col=text_col, id_col=id_col)
    out, value, said = (free_name(docs, n) for n in ("held_out", "score", "predicted"))
    scored = docs.withColumn(value, scorer(docs.sparkSession, model)(F.col(text_col).cast("string")))
    return scored.withColumn(out, held_out(id_col)).withColumn(said, (F.col(value) >= threshold).cast("int"))


def op4(spark, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
