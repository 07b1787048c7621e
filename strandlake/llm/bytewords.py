"""Words, sentences and word shingles of many texts at once, by array operations on UTF-8 bytes.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased: ASCII letters and
digits, and every character beyond ASCII. Words get 64-bit hashes: a polynomial over random byte
values modulo 2**64, brought to the word's start by the inverse of the base, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SMALL_BYTES = 1 << 18  # where many arrays of eight bytes a place are held at once
_BASE = 0x9E3779B97F4A7C0B  # 3 modulo 8: neighbouring powers differ in nearly all bits
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _lowered() -> np.ndarray:
    """Byte -> its lower case if it belongs to words, else 0."""
    t = np.zeros(256, np.uint8)
    for b in range(256):
        if 65 <= b <= 90:
            t[b] = b + 32
        elif 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            t[b] = b
    return t


LOW = _lowered()
VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
BREAK = np.isin(np.arange(256), [10, 33, 46, 63])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least n places."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = n if n > 4 * SLICE_BYTES else 1 << max(n - 1, SMALL_BYTES).bit_length()
        inv = pow(_BASE, -1, 1 << 64)
        made = []
        for base in (_BASE, inv):
            p = np.full(size, _U(base & (2**64 - 1)))
            p[0] = 1
            made.append(np.cumprod(p))
        have = (made[0], made[1])
        if size <= 4 * SLICE_BYTES:
            _powers[0] = have
    return have


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string array; null is empty. The bytes aren't copied."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if width is np.int32 and not pa.types.is_string(texts.type):
        texts, width = texts.cast(pa.large_string()), np.int64
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def released(run):
    """``run`` over batches, after each of which memory that is no longer used goes back to the system:
    workers are kept from stage to stage, and what allocators hold would add up."""
    def own(batches):
        for out in run(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
            _trim()

    return own


def _trim() -> None:
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it keeps


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of ``most`` bytes together, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def parts(batch: pa.RecordBatch, most: int = SLICE_BYTES, text: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of a batch, without copies, ``most`` bytes of text at a time, or one longer text."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    for i, j in slices(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), most):
        yield batch.slice(i, j - i)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte, text index) of every word of the texts, in order."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    low = LOW[data]
    isword = low != 0
    edge = np.empty(n + 1, bool)
    edge[1:-1] = isword[1:] != isword[:-1]
    edge[0], edge[-1] = isword[0], isword[-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    both = cut[isword[cut] & isword[cut - 1]]  # words that touch where texts meet
    edges = np.flatnonzero(edge)
    if len(both):
        edges = np.sort(np.concatenate([edges, both, both]))
    start, end = edges[0::2], edges[1::2]
    p, inv = powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(VALUES[low] * p[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inv[start] + (end - start).astype(np.uint64))
    return h, start, end, np.searchsorted(offsets, start, "right") - 1


def sentences(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the sentences: where texts start and after each ``.``, ``!``, ``?`` or line break."""
    after = np.flatnonzero(BREAK[data]) + 1
    begins = offsets[:-1][np.diff(offsets) > 0]
    out = np.union1d(after, begins)
    return out[out < len(data)]


_STEPS = mix(np.arange(11, 43, dtype=np.uint64)) | _U(1)


def shingles(h: np.ndarray, doc: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every run of ``size`` words; a text of fewer words (but not none) has one
    shingle of all its words."""
    n = len(h)
    if not n:
        return h, doc
    length = np.bincount(doc)
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    out, of = [], []
    if n >= size:
        at = np.flatnonzero(doc[: n - size + 1] == doc[size - 1 :])
        s = np.zeros(len(at), np.uint64)
        for j in range(size):
            s += h[at + j] * _STEPS[j]
        out.append(s)
        of.append(doc[at])
    for k in range(1, size):
        docs = np.flatnonzero(length == k)
        if len(docs):
            s = np.full(len(docs), _U(k))
            for j in range(k):
                s += h[first[docs] + j] * _STEPS[j]
            out.append(s)
            of.append(docs)
    s, d = np.concatenate(out), np.concatenate(of)
    if len(out) > 1:
        order = np.argsort(d, kind="stable")
        s, d = s[order], d[order]
    return mix(s), d
