"""Words and shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a maximal run of letters, digits and underscores (Unicode), lower-cased. A text of n words
has n - 4 shingles of five words; one of 1 to 4 words has a single shingle of all its words, so
short texts can still equal each other; one without words has none.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
#: Characters per block that is hashed at once; a longer text is a block of its own.
BLOCK_CHARS = 500_000

_ODD = re.compile(r"[^\w\x00-\x7f]+")
_WORD_BYTE = np.array([b >= 128 or chr(b).isalnum() or b == 95 for b in range(256)])
#: Odd 64-bit multipliers.
_BASE, _MIX1, _MIX2, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits spread over the whole number, one to one."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def normalised(text: str | None) -> str:
    low = (text or "").lower()
    return low if low.isascii() else _ODD.sub(" ", low)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words start (one entry more than texts)."""
    coded = [normalised(t).encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*coded, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    inside = _WORD_BYTE[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    text_ends = np.cumsum([len(c) + 1 for c in coded])
    offsets = np.concatenate([[0], np.searchsorted(starts, text_ends)]).astype(np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    lengths = ends - starts
    at = np.flatnonzero(inside)
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(at)) - np.repeat(firsts, lengths)
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(terms, firsts) + lengths.astype(np.uint64) * _STEP), offsets


def ngrams(words: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, and where each text's runs start."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    total = int(starts[-1])
    if not total:
        return np.zeros(0, np.uint64), starts
    at = np.arange(total) - np.repeat(starts[:-1], counts) + np.repeat(offsets[:-1], counts)
    h = np.zeros(total, np.uint64)
    for k in range(n):
        h = h * _BASE + words[at + k]
    return mixed(h ^ np.uint64(n)), starts


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, offsets = word_hashes(texts)
    grams, starts = ngrams(words, offsets, n)
    out = []
    for i in range(len(texts)):
        if starts[i + 1] > starts[i]:
            out.append(np.unique(grams[starts[i] : starts[i + 1]]))
        else:
            few = words[offsets[i] : offsets[i + 1]]
            out.append(ngrams(few, np.array([0, len(few)]), len(few))[0] if len(few) else np.zeros(0, np.uint64))
    return out


def blocks(texts: list[str | None], chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """(from, to) of consecutive texts with about ``chars`` characters together."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > chars:
            yield begin, i
            begin, size = i, 0
        size += len(t or "") + 1
    if begin < len(texts):
        yield begin, len(texts)


def trim() -> None:
    """Give memory that this process no longer uses back to the system: workers wait for their next task beside the others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
