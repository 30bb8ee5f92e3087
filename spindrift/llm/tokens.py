"""Token counts by a separator scan over flat, unindexed token files.

``write_token_files`` tokenises documents into files of little-endian ids (16 bits where vocabulary and separator
fit, else 32), each document followed by the end-of-document id, and nothing else: no index, no lengths.
``scan`` counts from the files alone. Each file is cut into blocks of ``block_tokens`` by its size; one vectorised
comparison per block finds its separators, which gives the lengths of the documents that end in it and
the length of its open end. A prefix scan over the blocks of a file then stitches: it numbers the
documents, and adds the open ends before a block to the first document that ends in it. Only one
small row per block takes part in the prefix scan, and a document may span any number of blocks.

Cases: a null or empty text has 0 tokens; texts that spell a special token are tokenised as ordinary text, so
they cannot forge a separator, and a separator that the vocabulary itself can produce is refused. Documents keep their place: the writer's manifest names the ids of each file in order;
null and repeated ids are rows like others. Very long texts span blocks. An empty table gives empty results. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, scratch, stored, table, text_or_empty
from .warc import _open_fs as open_fs

#: How the public byte-level vocabulary splits text before merging, and its free id.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
EOD = 50256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_TOKENS = 1 << 18
FILE_TOKENS = 1 << 24

MANIFEST = "path string, ids array<long>"


def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}


def tokenizer(vocabulary: bytes):
    """Encodes a list of texts to lists of ids, from the lines of a .tiktoken file."""
    import tiktoken

    coder = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks_of(vocabulary), special_tokens={})
    return coder.encode_ordinary


def width_of(vocabulary: str, eod: int) -> str:
    """Kind of the numbers in the files: 16 bits where all ids and the separator fit."""
    with open(vocabulary, "rb") as f:
        ids = set(ranks_of(f.read()).values())
    if eod in ids or eod < 0:
        raise ValueError(f"the vocabulary has the id {eod}, so it cannot separate documents")
    return "<u2" if max(eod, *ids) < 1 << 16 else "<u4"


def _write(folder: str, vocabulary, eod: int, width: str, block_tokens: int, file_tokens: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary.value)
        store, base = open_fs(folder)
        out = path = None
        held, n_held, total, ids = [], 0, 0, []

        def drain() -> None:
            nonlocal held, n_held
            if held:
                out.write(np.concatenate(held).tobytes())
            held, n_held = [], 0

        def closed() -> pa.RecordBatch:
            drain()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{path}"], "ids": pa.array([ids], pa.list_(pa.int64()))})

        for b in batches:
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if out is None:
                    store.create_dir(base, recursive=True)
                    path = f"{uuid.uuid4().hex}.bin"
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                    held, n_held, total, ids = [], 0, 0, []
                tokens = np.array([*encode(text), eod], width)
                held.append(tokens)
                ids.append(doc)
                n_held, total = n_held + len(tokens), total + len(tokens)
                if n_held >= block_tokens:
                    drain()
                if total >= file_tokens:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return write


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, eod: int = EOD, block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Write the files below ``folder``; the stored manifest: path, ids in order."""
    with open(vocabulary, "rb") as f:  # a parameter of the driver; executors get its content
        held = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return stored(rows.mapInArrow(_write(folder, held, eod, width_of(vocabulary, eod), block_tokens, file_tokens), MANIFEST), "token-manifest")


def _cut(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                store, place = open_fs(path)
                n = -(-store.get_file_info(place).size // block_bytes)
                yield pa.RecordBatch.from_pydict({"path": pa.array([path] * n, pa.string()), "block": pa.array(np.arange(n), pa.int64())})

    return run


def _scan(eod: int, width: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, numbers, ends, lengths, tails = b.column("path"), b.column("block"), [], [], []
            for path, number in zip(paths.to_pylist(), numbers.to_pylist(), strict=True):
                store, place = open_fs(path)
                with store.open_input_file(place) as f:
                    f.seek(number * block_bytes)
                    tokens = np.frombuffer(f.read(block_bytes), width)
                found = np.flatnonzero(tokens == eod)
                lengths.append(np.diff(found, prepend=-1) - 1)
                ends.append(len(found))
                tails.append(len(tokens) - (int(found[-1]) + 1 if len(found) else 0))
            yield pa.RecordBatch.from_pydict({"path": paths, "block": numbers, "ends": pa.array(ends, pa.int64()), "tail": pa.array(tails, pa.int64()), "lengths": pa.array(lengths, pa.list_(pa.int64()))})

    return run


def scan(files: DataFrame, eod: int = EOD, width: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """path, place, n_tokens of every document, from the paths of flat token files."""
    n, block_bytes = partitions(files.sparkSession), block_tokens * np.dtype(width).itemsize
    spread = files.select("path").mapInArrow(_cut(block_bytes), "path string, block long").repartition(n, "path", "block")
    found = stored(spread.mapInArrow(_scan(eod, width, block_bytes), "path string, block long, ends long, tail long, lengths array<long>"), "separators")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # open ends since the last block with a separator: running sum, less its value at that block
    run = found.withColumn("number", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    run = run.withColumn("sum", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    run = run.withColumn("since", F.coalesce(F.max(F.when(F.col("ends") > 0, F.col("sum"))).over(before), F.lit(0)))
    carry = F.col("sum") - F.col("since")
    each = run.where("ends > 0").withColumn("carry", carry).select("path", "number", "carry", F.posexplode("lengths").alias("i", "n"))
    return each.select("path", (F.col("number") + F.col("i")).alias("place"), (F.col("n") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).alias("n_tokens"))


def token_counts(docs: DataFrame, folder: str | None = None, vocabulary: str = VOCABULARY, eod: int = EOD, block_tokens: int = BLOCK_TOKENS, file_tokens: int = FILE_TOKENS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col and n_tokens of every document, counted in the token files that it is written to."""
    manifest = write_token_files(docs, folder or scratch(docs.sparkSession, "tokens"), vocabulary, eod, block_tokens, file_tokens, text_col, id_col)
    counted = scan(manifest, eod, width_of(vocabulary, eod), block_tokens)
    names = manifest.select("path", F.posexplode("ids").alias("place", id_col)).withColumn("place", F.col("place").cast("long"))
    return counted.join(names, ["path", "place"]).select(id_col, "n_tokens")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
