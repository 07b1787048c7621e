"""Media columns: payloads kept by content in tar shards, rows carry digest, place and length.

A text's payload (its UTF-8 bytes, then bytes 255 up to a positive multiple of ``WIDTH``) is stored
losslessly as an 8-bit grey PNG of ``WIDTH`` columns, named by the payload's sha256, in tar files
under the folder that all executors share. A payload is stored once, however many rows have it.

1. Digests of all rows are computed and those that occur more than once are found.
2. Payloads are written by the task that reads their text, those of repeated digests only where the row
   has the least id of them. The repeated digests and these ids are broadcast while they number no more
   than ``MOST_DIGESTS``; beyond that all rows are dealt by digest.
3. Writers return (digest, shard, offset, length). Each attempt of a task writes files of its own,
   and only those that a finished task returned are ever named, so a retry does no harm.
4. ``headers`` fills metadata columns by reading the first 33 bytes of each payload's range;
   ``features`` reads whole ranges, decodes them and computes the rest.

Defined cases: null and empty texts are one payload of ``WIDTH`` bytes 255; repeated rows share a
payload and each have a row; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm import bytewords as B
from strandlake.llm.common import joined, new_path, staged, text_or_empty

WIDTH, SHARD_BYTES, MOST_DIGESTS, LEVEL = 576, 128 << 20, 500_000, 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
MANIFEST = "digest string, shard string, offset long, length long"


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def digest(text: Column) -> Column:
    """sha256 of the payload, on the JVM."""
    raw = text_or_empty(text).cast("binary")
    size = F.greatest(F.ceil(F.octet_length(raw) / WIDTH), F.lit(1)).cast("int") * WIDTH
    return F.sha2(F.rpad(raw, size, F.lit(b"\xff")), 256)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encoded(data: bytes) -> bytes:
    """The payload as a PNG: 8-bit grey, no filter."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int, int]:
    """width, height, bit depth, colour type from a PNG's first 33 bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", first[16:26])


def decoded(png: bytes) -> bytes:
    width, height, depth, colour = header(png)
    at, body = 8, b""
    while at < len(png):
        (n,) = struct.unpack(">I", png[at : at + 4])
        kind, part = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum is wrong")
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("not 8-bit grey without filters")
    return lines[:, 1:].tobytes()


class Shards:
    """Appends payloads to tar files under a folder; a new file starts at ``SHARD_BYTES``."""

    def __init__(self, folder: str):
        self.fs, self.base = fs.FileSystem.from_uri(folder)
        self.folder, self.out, self.at = folder, None, 0
        self.fs.create_dir(self.base, recursive=True)

    def put(self, name: str, body: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= SHARD_BYTES:
            self.close()
            self.name = f"{uuid.uuid4().hex}.tar"
            self.out, self.at = self.fs.open_output_stream(f"{self.base}/{self.name}"), 0
        info = tarfile.TarInfo(name)
        info.size = len(body)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + body + bytes(-len(body) % 512))
        start = self.at + len(head)
        self.at = start + len(body) + -len(body) % 512
        return f"{self.folder}/{self.name}", start, len(body)

    def close(self):
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


class Ranges:
    """Byte ranges of shards; the shard read last stays open."""

    def __init__(self):
        self.name = self.file = None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.name:
            own, path = fs.FileSystem.from_uri(shard)
            self.name, self.file = shard, own.open_input_file(path)
        return self.file.read_at(length, offset)


def stored(rows: DataFrame, repeated: DataFrame, folder: str, most_digests: int = MOST_DIGESTS) -> DataFrame:
    """rows (``doc_id``, ``digest``, ``text``) -> the manifest. ``repeated``: digest and owner (the least id) of
    what more than one row has."""
    if repeated.count() <= most_digests:
        # 32 bytes a digest are sent, not 64 characters
        own = repeated.select(F.unhex("digest").alias("raw"), "owner", F.lit(True).alias("again"))
        marked = rows.withColumn("raw", F.unhex("digest")).join(F.broadcast(own), "raw", "left")
        own = marked.filter(F.col("again").isNull() | F.col("doc_id").eqNullSafe(F.col("owner")))
    else:
        own = rows.dropDuplicates(["digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder)
        done = []
        for batch in batches:
            for name, text in zip(batch.column("digest").to_pylist(), batch.column("text"), strict=True):
                data = payload(text.as_py())
                if hashlib.sha256(data).hexdigest() != name:
                    raise ValueError("digest and payload differ")
                done.append((name, *shards.put(f"{name}.png", encoded(data))))
        shards.close()  # before any row leaves: what is named is there
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["digest", "shard", "offset", "length"])

    # rows that share id and text may have been written by several tasks: one place counts
    return own.select("digest", "text").mapInArrow(B.released(run), MANIFEST).groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("m")).select("digest", "m.*")


def _by_shard(manifest: DataFrame) -> DataFrame:
    """Ranges of a shard together and in order."""
    n = max(1, manifest.select("shard").distinct().count())
    return manifest.repartition(n, "shard").sortWithinPartitions("shard", "offset")


def headers(manifest: DataFrame) -> DataFrame:
    """The manifest with width, height, bit_depth, from the first 33 bytes of each range only."""
    def run(batches):
        ranges = Ranges()
        for batch in batches:
            got = [header(ranges.read(s, o, 33)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            cols = [pa.array([g[i] for g in got], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "width", "height", "bit_depth"])

    return _by_shard(manifest).mapInArrow(B.released(run), f"{MANIFEST}, width int, height int, bit_depth int")


def _feature(data: bytes) -> str:
    """Samples' mean and spread in hundredths, and their share in 16 equal ranges in thousandths."""
    x = np.frombuffer(data, np.uint8)
    bins = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"{int(x.mean() * 100)}:{int(x.std() * 100)}:" + ".".join(map(str, bins.tolist()))


def features(manifest: DataFrame) -> DataFrame:
    """Per digest what the stored bytes say, after reading them back; header ranges come first."""
    names = ["digest", "shard", "offset", "length", "width", "height", "bit_depth", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        ranges = Ranges()
        for batch in batches:
            rows = []
            for name, shard, offset, length, *head in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                png = ranges.read(shard, offset, length)
                data = decoded(png)
                rows.append((name, shard, offset, length, *head, len(data.rstrip(b"\xff")), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(png), hashlib.sha256(png).hexdigest(), _feature(data)))
            if rows:
                types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    # the headers' rows are already by shard and in order
    return headers(manifest).mapInArrow(B.released(run), f"{MANIFEST}, width int, height int, bit_depth int, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", most_digests: int = MOST_DIGESTS) -> DataFrame:
    """Every row's payload with its place, metadata and features."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest(F.col(text_col)).alias("digest"))
    ids = staged(rows.select("doc_id", "digest"), "digests")
    repeated = staged(ids.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner")).filter("n > 1"), "repeated")
    manifest = staged(stored(rows, repeated, folder or new_path(docs.sparkSession, "shards"), most_digests), "manifest")
    return joined(ids, staged(features(manifest), "features"), ["digest"], "left", sizes=repeated)
