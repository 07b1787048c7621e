"""Cost-balanced packing of tokenised documents into sequences of ``LENGTH`` tokens.

1. Every whole text becomes ids (public vocabulary, path given) and an end id. Stretches of
   ``LENGTH`` ids fill a sequence each; what remains (fewer) is to be packed. With it go the crc32
   of its stretches of ``UNIT`` ids, from which the crc32 of any run of them follows, so ids needn't
   travel.
2. Remainders are dealt into blocks of about ``BLOCK`` by a hash of their number. In a block there
   are as many sequences as its tokens need. The longest remainder first, each goes to the sequence
   of lowest estimated cost, LINEAR * n + QUADRATIC * n * n summed over its pieces, that has room
   for it. If none has, it is cut at a multiple of ``UNIT`` to fill the one with the most room, and
   what is left goes on as a shorter remainder.

Words are cut at spaces and line breaks, which no token spans, and each distinct one is tokenised
once for as long as a bounded cache holds it. A word of letters a-z and those of Latin-1, with a
sign after it or not, goes to the vocabulary's merges straight; all else through the whole tokenizer.

Blocks are bounded whatever keys the rows have, so no group grows with the data. Defined cases: a
null text counts as empty and has the end id only; repeated rows are packed each; an empty table
gives no rows; columns other than doc_id and text are left out.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import bytewords as B
from strandlake.llm.common import staged

LENGTH, UNIT, BLOCK, END = 2048, 32, 4096, 1
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
CACHE = 500_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, unit_crcs array<long>"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SIMPLE = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([!-/:-@\\[-`{-~]?)")
_HARD = re.compile("[^\x00-\xff]")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 characters stand for themselves, the other bytes for 256, 257, ... in order."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Words(dict):
    """Word -> its ids as bytes (32 bits each, little-endian). Holds ``CACHE`` words, then starts anew."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        super().__init__({"": b""})

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
            self[""] = b""
        if m := _SIMPLE.fullmatch(word):
            body, sign = m.groups()
            if not body.isascii():
                body = "".join(self.letters[b] for b in body.encode())
            ids = [t.id for t in self.model.tokenize(body)]
            if sign:
                ids += [t.id for t in self.model.tokenize(sign)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        if len(word) > 64:  # too rare to keep
            return np.array(ids, "<u4").tobytes()
        out = self[word] = np.array(ids, "<u4").tobytes()
        return out

    def ids(self, text: str) -> bytes:
        # within Latin-1 lower case maps letters one by one, as the tokenizer's own does
        if text.isascii() or not _HARD.search(text):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_loaded: dict[str, Words] = {}


def loaded(path: str) -> Words:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Words(path)
    return _loaded[path]


def joined_crc(a: int, b: int, length_b: int) -> int:
    """crc32 of two runs of bytes in a row, from theirs and the second one's length."""
    zeros = bytes(length_b)
    return zlib.crc32(zeros, a) ^ zlib.crc32(zeros) ^ b


def pieces(ids: bytes, length: int = LENGTH, unit: int = UNIT) -> Iterator[tuple[int, int, int, list[int] | None]]:
    """(start, length, crc32, crc32 of each unit or None) of a document's full stretches and its remainder."""
    n, view = len(ids) // 4, memoryview(ids)
    for s in range(0, n, length):
        size = min(length, n - s)
        part = view[4 * s : 4 * (s + size)]
        units = None if size == length else [zlib.crc32(part[i : i + 4 * unit]) for i in range(0, 4 * size, 4 * unit)]
        yield s, size, zlib.crc32(part), units


def tokenised(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = loaded(path), END.to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("unit_crcs", pa.list_(pa.int64()))])
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = words.ids(text or "") + end
                    rows += [(doc_id, s, n, crc, len(ids) // 4, units) for s, n, crc, units in pieces(ids)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(B.released(run), PIECES)


def balance(lengths: list[int], length: int = LENGTH, unit: int = UNIT, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(remainder, start in it, length, sequence, offset) of every piece of a block.

    Ties: the earlier remainder, then the lower sequence, comes first."""
    count = max(1, -(-sum(lengths) // length))
    room, cost = np.full(count, length, np.int64), np.zeros(count)
    left = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(left)
    out = []
    while left:
        n, i, s = heapq.heappop(left)
        size = -n
        fits = room >= size
        if fits.any():
            k = int(np.where(fits, cost, np.inf).argmin())
        else:
            k = int(room.argmax())
            if room[k] < unit:
                room, cost = np.append(room, length), np.append(cost, 0.0)
                k = len(room) - 1
        put = min(size, int(room[k]))
        if put < size:
            put -= put % unit
            heapq.heappush(left, (-(size - put), i, s + put))
        out.append((i, s, put, k, length - int(room[k])))
        room[k] -= put
        cost[k] += linear * put + quadratic * put * put
    return out


def packed(docs: DataFrame, path: str | None = None, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    all_pieces = staged(tokenised(docs, path or vocabulary_path()), "pieces").withColumn("_n", F.monotonically_increasing_id())
    full = all_pieces.filter(F.col("length") == length)
    rest = all_pieces.filter(F.col("length") < length)
    blocks = max(1, rest.count() // block)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n", ignore_index=True)
        base = int(pdf["_block"].iloc[0]) << 32
        doc, start, size, total, crcs = (pdf[c].tolist() for c in ("doc_id", "start", "length", "doc_tokens", "unit_crcs"))
        rows = []
        for i, s, n, k, offset in balance(size, length):
            first, crc = s // UNIT, 0
            for j, unit in enumerate(crcs[i][first : -(-(s + n) // UNIT)]):
                crc = joined_crc(crc, int(unit), 4 * min(UNIT, n - j * UNIT))
            rows.append((doc[i], start[i] + s, n, crc, total[i], base + k, offset))
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        return out.astype({"doc_id": "Int64"})

    rest = rest.withColumn("_block", F.pmod(F.xxhash64("_n"), F.lit(blocks).cast("long")))
    mixed = rest.groupBy("_block").applyInPandas(pack, PACKED)
    alone = full.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_n") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return mixed.unionByName(alone)
