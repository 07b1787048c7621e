"""Repeated passages by content-defined chunks with a gear rolling hash.

The gear hash of a place covers the ``WINDOW`` bytes before it: every byte shifts the hash by two
bits and adds its random value. A text is cut where the hash is the least within ``REACH`` bytes on
either side (the first of equals), moved on to the next character. Cuts follow from the bytes near
them alone: an insertion moves the chunks behind it but doesn't change them, and a repeated passage
has the same cuts but for ``WINDOW + REACH`` bytes at its start and ``REACH`` at its end.

Chunks are told apart by a 128-bit BLAKE2 digest of their bytes. Those that occur twice or more, in one document or
several, are gathered, neighbouring ones joined to runs, and runs of ``LEAST`` bytes or more reported, in
pieces by the document that has their chunks first: a chunk always stays at its first place. Digests are counted
by partial aggregation. Joined back, chunks that very many places share aren't dealt by digest
but meet a broadcast of the few such digests (``common.joined``), so neither they nor their list of places meet in one task.

Defined cases: null and empty texts have no chunk; equal texts repeat each other whole (if they have
``LEAST`` bytes); repeats within one document count as others do, but text of a period of ``REACH``
bytes or less has no cuts; an empty table gives no rows; extra columns are left out of ``repeats`` and kept by ``cut``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm import bytewords as B
from strandlake.llm.common import joined, own_name, shielded, staged

WINDOW, REACH, LEAST = 16, 20, 100
GEAR = (B.mix(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
CHUNKS = "doc_id long, starts array<int>, ends array<int>, h1 array<long>, h2 array<long>, news array<boolean>"


def gear(data: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW bytes that end at each place (fewer at the start)."""
    h, width = GEAR[data], 1
    while width < WINDOW:
        more = np.zeros_like(h)
        more[width:] = h[:-width] << np.uint32(2 * width)
        h, width = h + more, 2 * width
    return h


def _least(h: np.ndarray, reach: int) -> np.ndarray:
    """Least of the ``reach`` values after each place; beyond the end all are greatest."""
    padded = np.concatenate([h[1:], np.full(reach, np.iinfo(h.dtype).max, h.dtype)])
    out, width = padded, 1
    while 2 * width <= reach:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    return np.minimum(out[: len(h)], out[reach - width : reach - width + len(h)])


def cuts(data: np.ndarray) -> np.ndarray:
    """Ends of all chunks of one text but the last, as byte offsets."""
    if len(data) <= REACH:
        return np.zeros(0, np.int64)
    h = gear(data)
    after = _least(h, REACH)
    before = _least(h[::-1], REACH)[::-1]
    at = np.flatnonzero((h < before) & (h <= after)) + 1
    at = at[(at > REACH) & (at < len(data) - REACH)]
    for _ in range(3):  # on to where a character starts
        at = at + ((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)
    return np.unique(at[at < len(data)])


def chunks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, both halves of the digest) of a text's chunks."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    ends = np.append(cuts(data), len(data))
    starts = np.concatenate([[0], ends[:-1]])
    raw = data.tobytes()
    digests = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return starts, ends, halves[:, 0], halves[:, 1]


def _news(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which chunks are the first of their digest in their text."""
    order = np.lexsort((h2, h1, doc))  # stable: equals stay in order
    a, b, d = h1[order], h2[order], doc[order]
    out = np.ones(len(order), bool)
    out[order[1:]] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (d[1:] != d[:-1])
    return out


def chunked(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.buffers(batch.column("text"))
            for lo in range(0, len(batch), 256):
                hi = min(len(batch), lo + 256)
                found = [chunks(data[offsets[i] : offsets[i + 1]]) for i in range(lo, hi)]
                at = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
                flat = [np.concatenate([f[k] for f in found]).astype(np.int32 if k < 2 else np.int64) for k in range(4)]
                flat.append(_news(flat[2], flat[3], np.repeat(np.arange(hi - lo), np.diff(at))))
                cols = [pa.ListArray.from_arrays(at, pa.array(x)) for x in flat]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *cols], names=["doc_id", "starts", "ends", "h1", "h2", "news"])

    return docs.mapInArrow(B.released(run), CHUNKS)


def runs(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (mid, start, end, first: mid of the first document that has the piece,
    is_first), and (mid, doc_id)."""
    base = staged(chunked(docs).withColumn("mid", F.monotonically_increasing_id()), "chunks")
    rows = base.select("mid", F.posexplode(F.arrays_zip("starts", "ends", "h1", "h2", "news")).alias("k", "c")).select("mid", "k", "c.*")
    again = staged(rows.groupBy("h1", "h2").agg(F.min("mid").alias("first"), F.count("*").alias("n")).filter("n > 1"), "repeated")
    own = (F.col("first") == F.col("mid")) & F.col("news")
    met = joined(rows, again.drop("n"), ["h1", "h2"], sizes=again).select("mid", "k", "starts", "ends", "first", own.alias("own"))
    return staged(_pieces(met, least), "runs"), base.select("mid", "doc_id")


def _pieces(met: DataFrame, least: int) -> DataFrame:
    """Neighbouring repeated chunks (mid, k, starts, ends, first, own) -> mid, start, end, first, is_first.

    A run is cut where the first document changes. What has its first place elsewhere but is under
    ``least`` bytes stays with the new text beside it."""
    w = Window.partitionBy("mid").orderBy("k")
    before = lambda c: F.lag(c).over(w)
    marked = met.withColumn("r", F.coalesce(F.col("k") != before("k") + 1, F.lit(True)))
    marked = marked.withColumn("s", F.col("r") | (F.col("own") != before("own"))).withColumn("p", F.col("s") | (F.col("first") != before("first")))
    marked = marked.select("mid", "starts", "ends", "first", "own", *[F.sum(F.col(c).cast("int")).over(w).alias(c) for c in "rsp"])
    parts = marked.groupBy("mid", "p").agg(F.min("starts").alias("start"), F.max("ends").alias("end"), *[F.min(c).alias(c) for c in ("first", "own", "r", "s")])
    size = lambda c: F.max("end").over(Window.partitionBy("mid", c)) - F.min("start").over(Window.partitionBy("mid", c))
    parts = parts.withColumn("size", size("r")).withColumn("is_first", F.col("own") | (size("s") < least)).filter(F.col("size") >= least)
    w = Window.partitionBy("mid", "r").orderBy("p")
    parts = parts.withColumn("g", F.coalesce(~F.col("is_first") | ~F.lag("is_first").over(w), F.lit(True)))
    parts = parts.withColumn("g", F.sum(F.col("g").cast("int")).over(w))
    out = parts.groupBy("mid", "r", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first").alias("first"), F.min("is_first").alias("is_first"))
    return out.select("mid", "start", "end", F.when(F.col("is_first"), F.col("mid")).otherwise(F.col("first")).alias("first"), "is_first")


def repeats(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, start, end (bytes of the text's UTF-8, end exclusive), first_doc_id, is_first of every
    repeated run's pieces; ``is_first`` marks the first place of all."""
    found, ids = runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), least)
    firsts = ids.select(F.col("mid").alias("first"), F.col("doc_id").alias("first_doc_id"))
    named = joined(staged(joined(found, ids, ["mid"]), "named"), firsts, ["first"])
    return named.select("doc_id", "start", "end", "first_doc_id", "is_first")


def cut(docs: DataFrame, least: int = LEAST, text_col: str = "text") -> DataFrame:
    """``docs`` without repeated runs at all but their first places; ids must be unique."""
    own, names = shielded(docs)
    key, where = own_name("id"), own_name("spans")
    spans = repeats(docs.select("doc_id", F.col(text_col).alias("text")), least).filter("not is_first")
    spans = spans.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(where))

    @F.pandas_udf("string")
    def without(texts, spans):
        import pandas as pd

        out = []
        for text, own in zip(texts, spans, strict=True):
            if text is not None and own is not None:
                raw, at, parts = text.encode(), 0, []
                for s in own:
                    parts.append(raw[at : s["start"]])
                    at = max(at, s["end"])
                text = b"".join([*parts, raw[at:]]).decode()
            out.append(text)
        return pd.Series(out, dtype=object)

    met = own.join(spans, F.col(names["doc_id"]).cast("long") == F.col(key), "left")
    return met.select(*[(without(n, where) if c == text_col else F.col(n)).alias(c) for c, n in names.items()])
