"""Binary genomic files (S11-S17, S23) as Spark data sources.

Large ones (PLINK genotypes, per-base floats) are cut into byte ranges, one a task. The small ones
(array scans and manifests, tens of MB) are parsed a file a task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Field codes of scan files.
IDAT_FIELDS = {1000: "count", 102: "id", 103: "sd", 104: "mean", 107: "beads", 200: "mid"}
MAGIC_BED = bytes([0x6C, 0x1B, 0x01])


def _open(path: str):
    from pyarrow import fs

    own, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return own.open_input_file(name)


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PlinkReader(DataSourceReader):
    """Genotypes of variants first..last of a .bed: SNP-major, two bits a sample."""

    def __init__(self, options):
        self.path, self.samples, self.step = options["path"], int(options["samples"]), int(options.get("step", 10_000))
        self.width = (self.samples + 3) // 4

    def partitions(self):
        with _open(self.path) as f:
            if f.read(3) != MAGIC_BED:
                raise ValueError("not a SNP-major genotype file")
            n = (f.size() - 3) // self.width
        return [_Range(i, min(n, i + self.step)) for i in range(0, n, self.step)]

    def read(self, part: _Range) -> Iterator:
        import numpy as np
        import pyarrow as pa

        with _open(self.path) as f:
            raw = np.frombuffer(f.read_at((part.last - part.first) * self.width, 3 + part.first * self.width), np.uint8)
        bits = np.unpackbits(raw, bitorder="little").reshape(part.last - part.first, -1, 2)[:, : self.samples]
        # the two bits of a sample: 00 hom-ref 1, 01 het 2, 11 hom-alt 3, 10 missing 0
        codes = np.array([1, 2, 0, 3], np.int8)[2 * bits[:, :, 0] + bits[:, :, 1]]
        for i, row in enumerate(codes):
            yield pa.RecordBatch.from_arrays([pa.array([part.first + i], pa.int64()), pa.array([row.tolist()], pa.list_(pa.int32()))], names=["variant", "genotypes"])


class PlinkSource(DataSource):
    """``plink_bed``: variant (its place in the .bim, from 0) and genotypes (0 missing, 1, 2, 3)."""

    @classmethod
    def name(cls):
        return "plink_bed"

    def schema(self):
        return "variant long, genotypes array<int>"

    def reader(self, schema):
        return PlinkReader(self.options)


class FbinReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("step", 1_000_000))
        self.beg, self.end = int(options.get("beg", 0)), int(options.get("end", -1))

    def partitions(self):
        with _open(self.path) as f:
            n = f.size() // 4
        end = n if self.end < 0 else min(n, self.end)
        return [_Range(i, min(end, i + self.step)) for i in range(self.beg, end, self.step)]

    def read(self, part: _Range) -> Iterator:
        import numpy as np
        import pyarrow as pa

        with _open(self.path) as f:
            v = np.frombuffer(f.read_at((part.last - part.first) * 4, part.first * 4), "<f4")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.first + len(v))), pa.array(v.astype(float))], names=["pos0", "score"])


class FbinSource(DataSource):
    """``fbin``: pos0 and score of a file of little-endian floats, of bases beg..end-1 if given."""

    @classmethod
    def name(cls):
        return "fbin"

    def schema(self):
        return "pos0 long, score double"

    def reader(self, schema):
        return FbinReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlinkSource)
    spark.dataSource.register(FbinSource)


def plink(spark: SparkSession, prefix: str, step: int = 10_000) -> DataFrame:
    """Chrom, pos, ref, alt, variant, sample, g in long form."""
    from strandlake.sources.text import _numbered_records

    register(spark)
    col = lambda i: F.get(F.split(F.trim(F.get("parts", 0)), r"\s+"), i)
    fam = _numbered_records(spark, f"{prefix}.fam", 1).select(F.col("record").cast("int").alias("k"), col(1).alias("sample"))
    bim = _numbered_records(spark, f"{prefix}.bim", 1).select(F.col("record").alias("variant"), col(0).alias("chrom"), col(1).alias("id"), col(3).cast("long").alias("pos"), col(4).alias("a1"), col(5).alias("a2"))
    n = fam.count()
    g = spark.read.format("plink_bed").options(path=f"{prefix}.bed", samples=n, step=step).load()
    return g.select("variant", F.posexplode("genotypes").alias("k", "g")).join(bim, "variant").join(fam, "k").drop("k")


def fbin(spark: SparkSession, path: str, beg: int = 0, end: int = -1) -> DataFrame:
    """The bases of a 0-based half-open range only are read."""
    register(spark)
    return spark.read.format("fbin").options(path=path, beg=beg, end=end).load()


class Cursor:
    """Numbers and length-prefixed strings of a byte string, in order."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise ValueError("the file ends early")
        self.at += n
        return out

    def number(self, fmt: str):
        return struct.unpack("<" + fmt, self.take(struct.calcsize("<" + fmt)))[0]

    def numbers(self, fmt: str, n: int) -> list:
        return list(struct.unpack(f"<{n}{fmt}", self.take(n * struct.calcsize("<" + fmt))))

    def string(self) -> str:
        """Seven bits of length; above 127 a second byte counts further 128s."""
        n = self.take(1)[0]
        if n > 127:
            more = self.take(1)[0]
            n += (more - 1) * 128 if more else 0
        return self.take(n).decode("latin-1")


def parse_idat(data: bytes) -> list[tuple]:
    """(probe id, sd, mean, beads, mid block) of a version-3 scan."""
    c = Cursor(data)
    if c.take(4) != b"IDAT" or c.number("I") != 3:
        raise ValueError("not a version 3 IDAT file")
    c.take(4)
    at = dict((code, place) for code, place in ((c.number("H"), c.number("Q")) for _ in range(c.number("I"))))
    named = {IDAT_FIELDS[k]: v for k, v in at.items() if k in IDAT_FIELDS}
    n = Cursor(data, named["count"]).number("I")
    col = lambda name, fmt: Cursor(data, named[name]).numbers(fmt, n)
    mid = Cursor(data, named["mid"]) if "mid" in named else None
    blocks = mid.numbers("I", mid.number("I")) if mid else []
    blocks = (blocks + [None] * n)[:n]
    return list(zip(col("id", "I"), col("sd", "H"), col("mean", "H"), col("beads", "B"), blocks, strict=True))


def parse_bpm(data: bytes) -> list[tuple]:
    """(name, chrom, pos, allele A, allele B) of a manifest, in its order."""
    c = Cursor(data)
    if c.take(3) != b"BPM":
        raise ValueError("not a BPM file")
    c.take(5)
    c.string(), c.string()
    n = c.number("I")
    c.take(4 * n)
    order = {c.string(): i for i in range(n)}
    c.take(n)
    out: list[tuple | None] = [None] * n
    for _ in range(n):
        version = c.number("I")
        _, name = c.string(), c.string()
        c.take(8)
        _, alleles, chrom, *_rest, place = [c.string() for _ in range(6)]
        _ = [c.string() for _ in range(2)]
        c.take(8)
        _ = [c.string() for _ in range(7)]
        if version == 7:
            c.take(20)
        if len(alleles) < 5 or alleles[0] != "[" or alleles[2] != "/":
            raise ValueError(f"alleles {alleles!r} of {name}")
        out[order[name]] = (name, chrom, place, alleles[1], alleles[3])
    return out


def parse_cel(data: bytes) -> list[tuple]:
    """(x, y, mean, sd, pixels) of a version 4 (binary) or version 3 (text) file."""
    if data[:4] == struct.pack("<i", 64):
        c = Cursor(data, 4)
        c.number("i")
        cols, _, cells = c.numbers("i", 3)
        c.take(c.number("i")), c.take(c.number("i")), c.take(c.number("i"))
        c.take(16)
        out = []
        for i in range(cells):
            mean, sd = c.numbers("f", 2)
            out.append((i % cols, i // cols, round(mean, 1), round(sd, 1), c.number("h")))
        return out
    section, out = "", []
    for line in data.decode("latin-1").splitlines():
        if line.startswith("["):
            section = line.strip("[] \r")
        elif section == "INTENSITY" and (parts := line.split()) and parts[0].isdigit():
            out.append((int(parts[0]), int(parts[1]), float(parts[2]), float(parts[3]), int(parts[4])))
    return out


def _files(spark: SparkSession, path, parse, schema: str) -> DataFrame:
    def run(frames):
        import pandas as pd

        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                out = pd.DataFrame(parse(bytes(data)), columns=names)
                out.insert(0, "path", name)
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, {schema}")


def idat(spark: SparkSession, path) -> DataFrame:
    """S14, K14."""
    return _files(spark, path, parse_idat, "probe long, sd int, mean int, beads int, mid long")


def bpm(spark: SparkSession, path) -> DataFrame:
    """S15."""
    return _files(spark, path, parse_bpm, "name string, chrom string, pos string, allele_a string, allele_b string")


def cel(spark: SparkSession, path) -> DataFrame:
    """S17, K14."""
    return _files(spark, path, parse_cel, "x int, y int, mean double, sd double, pixels int")
