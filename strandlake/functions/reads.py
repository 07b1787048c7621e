"""Alignment records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCLUDED_FLAGS = 0xF04


def usable(flag: Column, mapq: Column | None = None, least: int = 0) -> Column:
    """not unmapped, secondary, failed, duplicate or supplementary, and mapped well enough."""
    ok = flag.bitwiseAND(F.lit(EXCLUDED_FLAGS)) == 0
    return ok if mapq is None else ok & (mapq >= least)


def cigar_ops(cigar: Column) -> Column:
    """array of (n, op) in order."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("int").alias("n"), F.right(x, F.lit(1)).alias("op")))


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that M, D, N, = and X span."""
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda s, x: s + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(0))


def end_position(pos: Column, cigar: Column) -> Column:
    """Last reference base (1-based)."""
    return pos + reference_length(cigar) - 1


def overlap_depth(pos: Column, cigar: Column, beg: Column, end: Column) -> Column:
    """Bases of M, = and X that lie in [beg, end)."""
    zero = F.struct(pos.cast("long").alias("at"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        aligned, moves = x["op"].isin("M", "=", "X"), x["op"].isin("M", "D", "N", "=", "X")
        over = F.greatest(F.lit(0).cast("long"), F.least(s["at"] + x["n"], end) - F.greatest(s["at"], beg))
        return F.struct((s["at"] + F.when(moves, x["n"]).otherwise(0)).cast("long").alias("at"), (s["n"] + F.when(aligned, over).otherwise(0)).cast("long").alias("n"))

    return F.aggregate(cigar_ops(cigar), zero, step, lambda s: s["n"])


def soft_clips(cigar: Column) -> Column:
    """Bases clipped by S."""
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda s, x: s + F.when(x["op"] == "S", x["n"]).otherwise(0))


def name_barcode(name: Column, cell: int | None = None) -> tuple[Column, Column]:
    """Barcode and UMI, the last two parts of a read's name."""
    parts = F.split(name, ":")
    barcode = F.element_at(parts, -2)
    return (F.substring(barcode, 1, cell) if cell else barcode), F.element_at(parts, -1)
