"""Removal of repeated substrings with a sparse suffix array, built by a distributed merge sort of suffixes.

Every byte is removed that a ``LENGTH``-byte string covers which also starts earlier (in a document with a smaller
id, or earlier in the same one). Texts are UTF-8 bytes; no string crosses documents; all strings are judged on the input.

1. Documents are packed into chunks of some MB, compressed, in the shared folder; later steps fetch a chunk by
   its place, so no text is ever shuffled. A stored manifest lists them, so leftovers of lost tasks are never read.
2. Each ``LENGTH``-byte window owns an anchor: its ``GRAM``-byte string of least hash, the leftmost of equal ones. Equal
   windows have their anchors at the same place, so it is enough to sort the suffixes at anchors, about 2 / 52 of all.
3. Suffixes whose first ``GRAM`` bytes occur once cannot repeat. Chunks send the distinct hashes of theirs by hash bucket
   and get one bit back for each.
4. The other suffixes (``LENGTH`` bytes from the anchor on, then the bytes before it, nearest first) are sorted in each
   chunk into a run per bucket and exchanged front-coded: the length of the prefix shared with the one before, and the
   rest. Equal suffixes with equal windows are sent once per chunk, so a passage that many documents share sends few.
5. A bucket merges its runs by a loser tree in which every loser keeps the length of the prefix that it shares with the
   winner: suffixes are compared from there on only, and mostly not at all.
6. From the merged order and its common prefixes, each window learns whether an equal one (same bytes from the anchor on by
   the shared prefix, same bytes before it, brought together by a hash and compared) starts earlier. One bit mask per anchor goes back to its chunk,
   where windows are laid over the bytes.

Cases: a null text is empty; empty texts and those under ``LENGTH`` bytes lose nothing. Null ids sort after all others.
Rows that repeat an id are documents of their own, in the order in which they were packed. Empty table, empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, scratch, stored, table, text_or_empty
from .warc import _open_fs as open_fs
from .words import mixed

LENGTH, GRAM = 100, 50
REACH = LENGTH - GRAM
ROW = LENGTH + REACH
CHUNK_BYTES = 4_000_000
#: Compressed bytes of chunks for each bucket of suffixes.
BUCKET_BYTES = 4_000_000
#: Bytes whose anchors are sought at once; positions within take 18 bits.
PIECE = 1 << 18
NO_ID = 2**63 - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling."""
    cur, length, power = data.astype(np.uint64) + np.uint64(1), 1, int(_BASE)
    out, have, bits = None, 0, GRAM
    while bits:
        p = np.uint64(power)
        if bits & 1:
            if out is None:
                out, have = cur, length
            else:
                n = len(cur) - have
                if n <= 0:
                    return np.zeros(0, np.uint64)
                out, have = out[:n] * p + cur[have : have + n], have + length
        bits >>= 1
        if bits:
            if len(cur) <= length:
                return np.zeros(0, np.uint64)
            cur = cur[:-length] * p + cur[length:]
            length, power = length * 2, power * power % 2**64
    return mixed(out)


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, hash, least and largest distance to the start of an own window of each anchor; ``ends``: of the documents."""
    found: list[tuple] = []
    starts = np.concatenate([[0], ends[:-1]])
    at, wide = 0, REACH + 1
    while at + LENGTH <= len(data):
        to = min(len(data), at + PIECE)
        g = gram_hashes(data[at:to])
        low = ((g >> np.uint64(18)) << np.uint64(18)) | np.arange(len(g), dtype=np.uint64)
        span = 1
        while span * 2 <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        n = to - at - LENGTH + 1
        low = np.minimum(low[:n], low[wide - span : wide - span + n])
        s = np.arange(at, at + n)
        inside = s + LENGTH <= ends[np.searchsorted(ends, s, "right")]
        s, place = s[inside], (low[inside] & np.uint64((1 << 18) - 1)).astype(np.int64)
        if len(s):
            cut = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(s) > 1)]))
            last = np.concatenate([cut[1:], [len(s)]]) - 1
            p = place[cut]
            found.append((p + at, g[p], p + at - s[last], p + at - s[cut]))
        at += n
    if not found:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def pack(arrays: list[np.ndarray]) -> bytes:
    raw = np.array([a.nbytes for a in arrays], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, kinds: list[str]) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds)), 8 * len(kinds), []
    for kind, n in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at))
        at += int(n)
    return out


_CHUNK = ["<i8", "u1", "<i8", "u1", "<u4", "<u8", "u1", "u1"]  # ids, null ids, ends, bytes, anchors: gap, hash, least and largest distance


def _chunks(folder: str, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_fs(folder)
        out, path, at, refs = None, "", 0, []
        ids, texts, size = [], [], 0

        def flush():
            nonlocal out, path, at, ids, texts, size
            if out is None:
                store.create_dir(base, recursive=True)
                path = f"{uuid.uuid4().hex}.chunks"
                out, at = store.open_output_stream(f"{base}/{path}", compression=None), 0
            data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts]).astype(np.int64)
            pos, h, least, most = anchors(data, ends)
            numbers = np.array([NO_ID if i is None else i for i in ids], "<i8")
            blob = pack([numbers, np.array([i is None for i in ids], "u1"), ends, data, np.diff(pos, prepend=0).astype("<u4"), np.zeros(0, "<u8"), least.astype("u1"), most.astype("u1")])
            out.write(blob)
            refs.append((f"{path}-{at}", f"{folder}/{path}", at, len(blob)))
            at += len(blob)
            ids, texts, size = [], [], 0

        for b in batches:
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                ids.append(i)
                texts.append(data)
                size += len(data)
                if size >= chunk_bytes:
                    flush()
        if ids:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for k, v, t in zip(("chunk", "path", "at", "bytes"), zip(*refs, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)})

    return run


def fetch(path: str, at: int, size: int) -> dict[str, np.ndarray]:
    store, place = open_fs(path)
    with store.open_input_file(place) as f:
        f.seek(at)
        blob = f.read(size)
    ids, none, ends, data, gap, _, least, most = unpack(blob, _CHUNK)
    pos = np.cumsum(gap.astype(np.int64))
    return {"ids": ids, "none": none, "ends": ends, "data": data, "pos": pos, "least": least.astype(np.int64), "most": most.astype(np.int64)}


def hashes_at(data: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The gram hashes at some positions."""
    out = np.empty(len(pos), np.uint64)
    for at in range(0, max(1, len(data)), PIECE):
        a, b = np.searchsorted(pos, (at, at + PIECE))
        if b > a:
            out[a:b] = gram_hashes(data[at : at + PIECE + GRAM - 1])[pos[a:b] - at]
    return out


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.int64) % buckets


def _send_hashes(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, path, at, size in zip(*(b.column(c).to_pylist() for c in ("chunk", "path", "at", "bytes")), strict=True):
                c = fetch(path, at, size)
                h = np.unique(hashes_at(c["data"], c["pos"]))
                k = bucket_of(h, buckets)
                order = np.argsort(k, kind="stable")
                cut = np.searchsorted(k[order], np.arange(buckets + 1))
                h = h[order]
                some = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_pydict(
                    {"bucket": pa.array(some, pa.int32()), "chunk": pa.array([chunk] * len(some), pa.string()), "data": pa.array([h[cut[i] : cut[i + 1]].tobytes() for i in some], pa.binary())}
                )

    return run


def _repeated(key: tuple, t: pa.Table) -> pa.Table:
    """For the hashes that each chunk sent, whether another chunk has them."""
    parts = [np.frombuffer(x, np.uint64) for x in t.column("data").to_pylist()]
    flat = np.concatenate(parts)
    ordered = np.sort(flat)
    more = ordered[1:][ordered[1:] == ordered[:-1]]
    at = np.searchsorted(more, flat)
    at[at == len(more)] = 0
    flag = more[at] == flat if len(more) else np.zeros(len(flat), bool)
    cut = np.cumsum([0] + [len(p) for p in parts])
    bits = [np.packbits(flag[a:b]).tobytes() for a, b in zip(cut, cut[1:])]
    return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "bits": pa.array(bits, pa.binary())})


def rows_at(data: np.ndarray, ends: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The suffix rows: LENGTH bytes from each position on, then the bytes before it backwards, 0 beyond the document."""
    doc = np.searchsorted(ends, pos, "right")
    begin = np.concatenate([[0], ends[:-1]])[doc][:, None]
    at = pos[:, None] + np.concatenate([np.arange(LENGTH), -1 - np.arange(REACH)])[None, :]
    inside = (at >= begin) & (at < ends[doc][:, None])
    return np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)


def prefixes(rows: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        other = rows[1:] != rows[:-1]
        out[1:] = np.where(other.any(1), other.argmax(1), rows.shape[1])
    return out


_RUN = ["u1", "u1", "<i8", "<u4", "u1", "u1"]  # shared prefixes, rests, ids, positions, least and largest distance


def front_coded(rows: np.ndarray, shared: np.ndarray, ids, pos, least, most) -> bytes:
    rest = rows[np.arange(ROW)[None, :] >= shared[:, None]]
    return pack([shared.astype("u1"), rest, ids.astype("<i8"), pos.astype("<u4"), least.astype("u1"), most.astype("u1")])


def decoded(blob: bytes) -> tuple[np.ndarray, ...]:
    """Rows, shared prefixes, ids, positions, distances of a front-coded run."""
    shared, rest, ids, pos, least, most = unpack(blob, _RUN)
    shared = shared.astype(np.int64)
    n = len(shared)
    column = np.arange(ROW)[None, :]
    given = column >= shared[:, None]
    rows = np.zeros((n, ROW), np.uint8)
    rows[given] = rest
    source = np.maximum.accumulate(np.where(given, np.arange(n)[:, None], 0), 0)  # the last row that gives the byte
    return rows[source, column], shared, ids, pos.astype(np.int64), least.astype(np.int64), most.astype(np.int64)


def _send_runs(buckets: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        chunk, path, at, size = (t.column(c)[0].as_py() for c in ("chunk", "path", "at", "bytes"))
        c = fetch(path, at, size)
        h = hashes_at(c["data"], c["pos"])
        distinct, counts = np.unique(h, return_counts=True)
        wanted = counts > 1
        k = bucket_of(distinct, buckets)
        order = np.argsort(k, kind="stable")
        cut = np.searchsorted(k[order], np.arange(buckets + 1))
        for b, bits in zip(t.column("bucket").to_pylist(), t.column("bits").to_pylist(), strict=True):
            mine = order[cut[b] : cut[b + 1]]
            wanted[mine] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mine)).astype(bool)
        some = np.flatnonzero(wanted[np.searchsorted(distinct, h)])
        ids = c["ids"][np.searchsorted(c["ends"], c["pos"][some], "right")]
        k = bucket_of(h[some], buckets)
        out: dict[str, list] = {"bucket": [], "data": [], "mine": []}
        by = np.argsort(k, kind="stable")
        cut = np.searchsorted(k[by], np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)):
            own = some[by[cut[b] : cut[b + 1]]]
            own_ids = ids[by[cut[b] : cut[b + 1]]]
            rows = rows_at(c["data"], c["ends"], c["pos"][own])
            # equal rows stand by the windows that they own, then in the order of documents
            order = np.argsort(rows.view(f"S{ROW}").ravel(), kind="stable")
            shared = prefixes(rows[order])
            group = np.cumsum(shared < ROW)
            order = order[np.lexsort((c["pos"][own][order], own_ids[order], c["most"][own][order], c["least"][own][order], group))]
            least, most = c["least"][own][order], c["most"][own][order]
            again = np.zeros(len(order), bool)
            again[1:] = (group[1:] == group[:-1]) & (least[1:] == least[:-1]) & (most[1:] == most[:-1])
            keep = order[~again]
            pos = c["pos"][own]
            out["bucket"].append(int(b))
            out["data"].append(front_coded(rows[keep], prefixes(rows[keep]), own_ids[keep], pos[keep], c["least"][own][keep], c["most"][own][keep]))
            out["mine"].append(pos[order[again]].astype("<u4").tobytes())  # all windows of these repeat one of this chunk
        return pa.table({"chunk": pa.array([chunk] * len(out["data"]), pa.string()), "bucket": pa.array(out["bucket"], pa.int32()), "data": pa.array(out["data"], pa.binary()), "mine": pa.array(out["mine"], pa.binary())})

    return run


def merged(raw: bytes, ends: list[int], shares: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Runs of sorted rows, one after another in ``raw``, in one order: numbers of the rows, prefix that each shares with the row before.

    ``ends``: where the runs end, in rows; ``shares``: prefix that a row shares with the one before in its run. A
    loser tree: inner node i holds the run that lost there, and ``known`` how many bytes it shares with the
    winner that went on. Of two runs the one that shares more with the last output is smaller; if both share
    the same, bytes are compared from there on. Only the heads of the runs are held as rows.
    """
    n_runs, k = len(ends), 1
    while k < n_runs:
        k *= 2
    place = [0, *ends[:-1]] + [0] * (k - n_runs)
    until = ends + [0] * (k - n_runs)
    known = [0 if a < b else -1 for a, b in zip(place, until, strict=True)]
    head = [raw[a * ROW : a * ROW + ROW] if a < b else b"" for a, b in zip(place, until, strict=True)]
    loser = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether a goes on; the other one's share becomes that with the one that does."""
        x, y = known[a], known[b]
        if x != y:
            return x > y
        if x < 0:
            return True
        s, t = head[a], head[b]
        if s[x:] == t[x:]:
            known[max(a, b)] = ROW
            return a < b
        lo, hi = x, ROW
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if s[x:mid] == t[x:mid]:
                lo = mid
            else:
                hi = mid
        if s < t:
            known[b] = lo
            return True
        known[a] = lo
        return False

    winner = list(range(k))
    while len(winner) > 1:
        half, n = [], len(winner) // 2
        for i in range(n):
            a, b = winner[2 * i], winner[2 * i + 1]
            won, loser[n + i] = (a, b) if beats(a, b) else (b, a)
            half.append(won)
        winner = half
    top = winner[0]
    order, out = array("q"), array("B")
    while known[top] >= 0:
        i = place[top]
        order.append(i)
        out.append(known[top])
        i += 1
        if i < until[top]:
            place[top], head[top], known[top] = i, raw[i * ROW : i * ROW + ROW], shares[i]
        else:
            known[top] = -1
        node, x = (k + top) // 2, known[top]
        while node:
            other = loser[node]
            y = known[other]
            if x < y:
                loser[node], top, x = top, other, y
            elif x == y and not beats(top, other):
                loser[node], top = top, other
                x = known[top]
            node //= 2
    return np.array(order, np.int64), np.array(out, np.int64)


def window_masks(rows: np.ndarray, shared: np.ndarray, rank: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For suffix rows in order: bit o is set if the window that starts o bytes before the anchor has an equal one of smaller rank.

    Hashes of the bytes before only bring rows together: those of one hash are compared byte by byte with the first of them,
    and where any differ, all are numbered by their bytes instead.
    """
    masks = np.zeros(len(rows), np.uint64)
    before = np.full(len(rows), np.uint64(0x2545F4914F6CDD1D))
    for o in range(REACH + 1):
        if o:
            before = before * _BASE + rows[:, LENGTH + o - 1].astype(np.uint64) + np.uint64(1)
        at = np.flatnonzero((least <= o) & (o <= most))
        if len(at) < 2:
            continue
        same = np.cumsum(shared < LENGTH - o)[at]
        key = mixed(before[at] + same.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        for exact in (False, True):
            order = np.argsort(key, kind="stable")
            first = np.concatenate([[0], np.flatnonzero(np.diff(key[order])) + 1])
            sizes = np.diff(np.concatenate([first, [len(order)]]))
            if exact:
                break
            many = np.repeat(sizes > 1, sizes)
            one, head = order[many], order[np.repeat(first, sizes)[many]]
            told = slice(LENGTH, LENGTH + o)
            if (same[one] == same[head]).all() and (rows[at[one], told] == rows[at[head], told]).all():
                break
            whole = np.concatenate([rows[at, told], same.astype("<i8")[:, None].view(np.uint8).reshape(len(at), 8)], 1)
            key = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_inverse=True)[1]
        ranks = rank[at][order]
        low = np.repeat(np.minimum.reduceat(ranks, first), sizes)
        hit = at[order[ranks != low]]
        masks[hit] |= np.uint64(1 << o)
    return masks


def _merge(key: tuple, t: pa.Table) -> pa.Table:
    t = t.sort_by("chunk")
    parts, raw = [], bytearray()
    for x in t.column("data").to_pylist():
        rows, *rest = decoded(x)
        raw += rows.tobytes()
        parts.append(rest)
    ends = np.cumsum([len(p[0]) for p in parts])
    raw = bytes(raw)
    order, share = merged(raw, ends.tolist(), np.concatenate([p[0] for p in parts]).astype(np.uint8).tobytes())
    rows = np.frombuffer(raw, np.uint8).reshape(-1, ROW)[order]
    del raw
    run = np.searchsorted(ends, order, "right")
    ids, pos, least, most = (np.concatenate([p[i] for p in parts])[order] for i in (1, 2, 3, 4))
    by = np.lexsort((pos, run, ids))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    masks = window_masks(rows, share, rank, least, most)
    some = np.flatnonzero(masks)
    some = some[np.argsort(run[some], kind="stable")]
    cut = np.searchsorted(run[some], np.arange(len(parts) + 1))
    data = [pack([pos[some[a:b]].astype("<u4"), masks[some[a:b]]]) for a, b in zip(cut, cut[1:])]
    return pa.table({"chunk": t.column("chunk"), "masks": pa.array(data, pa.binary()), "mine": t.column("mine")})


RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def _remove(with_text: bool):
    def run(key: tuple, t: pa.Table) -> Iterator[pa.RecordBatch] | pa.Table:
        path, at, size = (t.column(c)[0].as_py() for c in ("path", "at", "bytes"))
        c = fetch(path, at, size)
        data, ends, n = c["data"], c["ends"], len(c["data"])
        delta = np.zeros(n + 1, np.int64)

        def cover(starts: np.ndarray) -> None:
            np.add.at(delta, starts, 1)
            np.add.at(delta, starts + LENGTH, -1)

        for blob, mine in zip(t.column("masks").to_pylist(), t.column("mine").to_pylist(), strict=True):
            if blob is not None:
                pos, masks = unpack(blob, ["<u4", "<u8"])
                for o in range(REACH + 1):
                    cover(pos[(masks >> np.uint64(o)) & np.uint64(1) == 1].astype(np.int64) - o)
            if mine:
                pos = np.frombuffer(mine, "<u4").astype(np.int64)
                a = np.searchsorted(c["pos"], pos)
                least, most = c["least"][a], c["most"][a]  # all windows from most to least bytes before
                for o in range(REACH + 1):
                    cover(pos[(least <= o) & (o <= most)] - o)
        gone = np.cumsum(delta[:n]) > 0
        edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out = []
        for i, end in enumerate(ends):
            begin = int(ends[i - 1]) if i else 0
            spans, kept = [], data[begin:end]
            a, b = np.searchsorted(last, begin, "right"), np.searchsorted(first, end, "left")
            if b > a:
                spans = [{"start": max(int(x), begin) - begin, "end": min(int(y), int(end)) - begin} for x, y in zip(first[a:b], last[a:b], strict=True)]
                kept = kept[~gone[begin:end]]
            kept = kept.tobytes()
            out.append((None if c["none"][i] else int(c["ids"][i]), int(end) - begin, spans, kept if with_text else None, hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), _RESULT.types, strict=True)], schema=_RESULT)

    return run


def remove_repeated(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", with_text: bool = True, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per document: id_col, n_bytes, removed spans (bytes), what is kept (if ``with_text``) and its digest."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    chunks = stored(rows.mapInArrow(_chunks(scratch(spark, "chunks"), chunk_bytes), "chunk string, path string, at long, bytes long"), "chunk-manifest")
    # by what is stored: rows name chunks by their place, so their own bytes say little of the work
    held = chunks.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(partitions(spark), -(-held // bucket_bytes))
    spread = chunks.repartition(buckets, "chunk")
    sent = spread.mapInArrow(_send_hashes(buckets), "bucket int, chunk string, data binary")
    flags = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_repeated, "chunk string, bucket int, bits binary")
    flagged = flags.join(chunks, "chunk")
    runs = flagged.repartition(buckets, "chunk").groupBy("chunk").applyInArrow(_send_runs(buckets), "chunk string, bucket int, data binary, mine binary")
    masks = stored(runs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_merge, "chunk string, masks binary, mine binary"), "window-masks")
    out = chunks.join(masks, "chunk", "left").repartition(buckets, "chunk").groupBy("chunk").applyInArrow(_remove(with_text), RESULT)
    return out.withColumnRenamed("doc_id", id_col)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated(table(spark, sf_dir, "documents"), with_text=False)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {LENGTH - 1})) AS p FROM d WHERE len(h) >= {2 * LENGTH})),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {LENGTH} THEN 0 ELSE 1 END AS new FROM r)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM i GROUP BY doc_id, run),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (
  SELECT doc_id, any_value(h) AS h, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k
  FROM cut JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, len(d.h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
