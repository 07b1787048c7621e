"""Barcode, UMI and matrix counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import reads as R
from strandlake.operators.ordered import with_row_number


def umi_counts(reads: DataFrame, keys: list[str], umi: str = "umi") -> DataFrame:
    """Distinct UMIs and reads by key, in two levels of aggregation, so that a hot key's UMIs are
    spread over tasks."""
    per = reads.groupBy(*keys, umi).agg(F.count("*").alias("_n"))
    return per.groupBy(*keys).agg(F.count("*").alias("ucnt"), F.sum("_n").alias("dcnt"))


def barcode_transcripts(counts: DataFrame, barcode: str, transcript: str, human: str | None = None) -> DataFrame:
    """A10: transcripts seen by barcode; with a pattern, those of one species apart."""
    more = [F.count_if(F.col(transcript).rlike(human)).alias("n_human")] if human else []
    return counts.groupBy(barcode).agg(F.count("*").alias("n_transcripts"), F.sum("ucnt").alias("n_umis"), *more)


def top_matrix(counts: DataFrame, row: str, barcode: str, value: str, k: int) -> DataFrame:
    """Row x (k most frequent barcodes, ties by name), 0 where absent. k is small: the barcodes
    become columns."""
    best = counts.groupBy(barcode).agg(F.count("*").alias("n")).orderBy(F.desc("n"), barcode).limit(k)
    names = [r[barcode] for r in best.collect()]
    wide = counts.filter(F.col(barcode).isin(names)).groupBy(row).pivot(barcode, names).agg(F.sum(value))
    return wide.fillna(0)


def prefix_histogram(reads: DataFrame, seq: str, lengths: range, umi: int, width: int) -> DataFrame:
    """For each length L the prefix's reads, apart by whether all bases of the UMI's end are T or N
    (those are signs of a barcode that lost bases)."""
    at = reads.withColumn("len", F.explode(F.array(*[F.lit(x) for x in lengths])))
    tail = F.substr(F.col(seq), F.col("len") + umi + 1, F.lit(width) + (F.lit(max(lengths)) - F.col("len")))
    return at.withColumn("prefix", F.substr(F.col(seq), F.lit(1), F.col("len"))).withColumn("trailing", tail.rlike("^[TN ]*$")).groupBy("len", "prefix").agg(F.count_if(~F.col("trailing")).alias("c0"), F.count_if("trailing").alias("c1"))


def collapsing_prefixes(hist: DataFrame, z: float = 2.33, share: float = 0.9) -> DataFrame:
    """Prefixes of L whose children of L+1 are one barcode: p1 > share*c1, z-test of the trailing
    part, and share of all over the largest child. hist: len, prefix, c0, c1."""
    child = hist.select((F.col("len") - 1).alias("len"), F.expr("substring(prefix, 1, len - 1)").alias("prefix"), (F.col("c0") + F.col("c1")).alias("_n"), F.col("c1").alias("_c1"), F.col("prefix").alias("child"))
    sums = child.groupBy("len", "prefix").agg(F.max("_n").alias("largest"), F.sum("_c1").alias("k1"), F.max_by("child", F.struct("_n", "child")).alias("main"))
    j = hist.join(sums, ["len", "prefix"])
    zed = ((F.col("c1") + 0.5) - 0.5 * (F.col("k1") + 1)) / F.sqrt((F.col("k1") + 1) / 4)
    ok = (F.col("c1") > share * F.col("k1")) & (zed > z) & (share * (F.col("c0") + F.col("c1")) >= F.col("largest"))
    return j.filter(ok).select("len", "prefix", "main", F.round(zed, 6).alias("z"))


def resolved(mapping: DataFrame, key: str, to: str, rounds: int = 4) -> DataFrame:
    """Follows key -> to until it ends, at most 2**rounds steps."""
    out = mapping.select(key, to)
    for _ in range(rounds):
        nxt = out.select(F.col(key).alias(to), F.col(to).alias("_next"))
        out = out.join(nxt, to, "left").select(key, F.coalesce("_next", to).alias(to))
    return out


def threshold_counts(hist: DataFrame, keys: list[str], n: str, levels: list[int]) -> DataFrame:
    """How many reach each level."""
    return hist.groupBy(*keys).agg(*[F.count_if(F.col(n) >= x).alias(f"ge_{x}") for x in levels])


def filter_matrix(m: DataFrame, row: str, col: str, value: str, min_col: float, min_row: float) -> DataFrame:
    """Columns (barcodes) with enough weight, then rows (genes) with enough weight in them;
    both numbered anew from 1, and each value's share of its column."""
    wide = m.groupBy(col).agg(F.sum(value).alias("_c")).filter(F.col("_c") >= min_col).select(col)
    kept = m.join(wide, col)
    tall = kept.groupBy(row).agg(F.sum(value).alias("_r")).filter(F.col("_r") >= min_row).select(row)
    kept = kept.join(tall, row)
    # sums are aggregated apart and joined, so that no column's values meet in one task; numbers come from range partitions
    sums = with_row_number(kept.groupBy(col).agg(F.sum(value).alias("_all")), [col], "col_no")
    rows = with_row_number(tall, [row], "row_no")
    out = kept.join(sums, col).join(rows, row)
    return out.withColumn("norm", F.round(F.col(value) / F.col("_all"), 6)).drop("_all")


def pileup(reads: DataFrame) -> DataFrame:
    """By place the distinct UMIs and reads of either strand; forward reads count at their start,
    reverse ones at their end."""
    at = F.when(F.col("strand") == "+", F.col("pos")).otherwise(R.end_position(F.col("pos"), F.col("cigar")))
    placed = reads.withColumn("at", at)
    per = placed.groupBy("chrom", "at", "strand", "umi").agg(F.count("*").alias("_n"))
    fwd = F.col("strand") == "+"
    s = per.groupBy("chrom", "at").agg(F.count_if(fwd).alias("u_fwd"), F.coalesce(F.sum(F.when(fwd, F.col("_n"))), F.lit(0)).alias("d_fwd"), F.count_if(~fwd).alias("u_rev"), F.coalesce(F.sum(F.when(~fwd, F.col("_n"))), F.lit(0)).alias("d_rev"))
    return s.select("chrom", (F.col("at") - 1).alias("beg"), F.col("at").alias("end"), F.greatest("u_fwd", "u_rev").alias("u_max"), "u_fwd", "d_fwd", "u_rev", "d_rev")


def tile_sums(piles: DataFrame, win: int, step: int, method: str = "min") -> DataFrame:
    """UMIs of either strand in sliding tiles, and the least or the geometric mean of both."""
    from strandlake.operators.intervals import tiles

    s = tiles(piles, "end", win, step).groupBy("chrom", "tile").agg(F.sum("u_fwd").alias("u_fwd"), F.sum("u_rev").alias("u_rev"))
    both = F.least("u_fwd", "u_rev").cast("double") if method == "min" else F.sqrt(F.col("u_fwd") * F.col("u_rev"))
    return s.withColumn("score", F.round(both, 6))


def breakpoint_depth(reads: DataFrame, regions: DataFrame, win: int, width: int) -> DataFrame:
    """Aligned bases before, in and after each region over its length, and clipped reads."""
    from strandlake.operators.intervals import overlapping

    placed = reads.withColumn("beg", F.col("pos") - 1).withColumn("end", R.end_position(F.col("pos"), F.col("cigar")))
    wide = regions.select("chrom", F.col("beg").alias("rb"), F.col("end").alias("re"), (F.col("beg") - win).alias("beg2"), (F.col("end") + win).alias("end2"))
    met = overlapping(placed, wide, width)
    part = lambda a, b: F.sum(R.overlap_depth(F.col("pos") - 1, F.col("cigar"), a, b))
    return met.groupBy("chrom", "rb", "re").agg(part(F.col("rb") - win, F.col("rb")).alias("before"), part(F.col("rb"), F.col("re")).alias("inside"), part(F.col("re"), F.col("re") + win).alias("after"), F.count_if(R.soft_clips(F.col("cigar")) > 0).alias("clipped"))


def tandem_shifts(seqs: DataFrame, seq: str, max_del: int, max_shift: int, by_allele: bool = False) -> DataFrame:
    """For each place and deletion length j how far the j-long motif there repeats to the left and
    right (each up to ``max_shift``), counted by j and sum, or ``by_allele`` by the deleted motif and sum.
    Deletions that begin at an N, or reach the last base, are left out. Strings are taken apart by expressions."""
    chars = F.split(F.col(seq), "")
    base = seqs.select(chars.alias("_s")).withColumn("_n", F.size("_s"))
    rows = base.select("_s", "_n", F.posexplode("_s").alias("i", "c")).filter("c != 'N' and c != ''").withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(max_del)))).filter("i + j < _n")

    def run(step: int):
        """Bases next to the motif (from its first base leftward, from its last rightward) that continue it."""
        ks = F.sequence(F.lit(1), F.lit(max_shift))
        at = lambda k: F.get(F.col("_s"), F.col("i") + F.when(F.lit(step) < 0, -k).otherwise(F.col("j") - 1 + k))
        other = lambda k: F.get(F.col("_s"), F.col("i") + F.when(F.lit(step) < 0, F.col("j") - k).otherwise(k - 1))
        ok = lambda k: F.coalesce((F.when((F.lit(step) > 0) | (F.col("i") - k >= 0), at(k)) == other(k)), F.lit(False))
        miss = F.array_min(F.filter(ks, lambda k: ~ok(k)))
        return F.coalesce(miss - 1, F.lit(max_shift))

    if by_allele:
        rows = rows.withColumn("motif", F.array_join(F.slice("_s", F.col("i") + 1, F.col("j")), ""))
    return rows.withColumn("shift", run(-1) + run(1)).groupBy(*(["motif"] if by_allele else ["j"]), "shift").agg(F.count("*").alias("n"))
