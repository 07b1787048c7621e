"""Aggregations of the inventory (A1-A8, A11, A16, A21, A29, A35, A36, A38) and set tools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.ordered import running_sum

#: Cells of the site summary: (ts ? 0 : 1) + (cpg ? 2 : 0) + (known ? 0 : 4)
CELLS = "abcdefgh"


def _ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """Null (NA) where the denominator is 0."""
    return F.when(b != 0, a * scale / b)


def site_counts(known: Column, cpg: Column, kind: Column, gold: Column) -> list[Column]:
    """A1: the additive part of a site summary."""
    cell = F.when(kind == "ts", 0).when(kind == "tv", 1) + F.when(cpg, 2).otherwise(0) + F.when(known, 0).otherwise(4)
    return [F.count("*").alias("n"), F.count_if(known).alias("n_known"), F.count_if(gold).alias("n_gold"), *[F.count_if(cell == i).alias(f"n_{c}") for i, c in enumerate(CELLS)]]


def site_ratios(df: DataFrame, keys: list[str], n_gold: Column | None = None) -> DataFrame:
    """A4: percentages and Ts/Tv of a site summary from its counts."""
    c = {x: F.col(f"n_{x}") for x in CELLS}
    out = df.select(
        *keys, "n", "n_known", F.round(F.col("n_known") * 100 / (F.col("n") + 1e-10), 6).alias("pct_known"),
        F.round(_ratio(c["c"] + c["d"], c["a"] + c["b"] + c["c"] + c["d"], 100.0), 6).alias("pct_cpg_known"),
        F.round(_ratio(c["g"] + c["h"], c["e"] + c["f"] + c["g"] + c["h"], 100.0), 6).alias("pct_cpg_novel"),
        F.round(_ratio(c["a"] + c["c"], c["b"] + c["d"]), 6).alias("tstv_known"), F.round(_ratio(c["e"] + c["g"], c["f"] + c["h"]), 6).alias("tstv_novel"),
        F.round(_ratio(c["a"], c["b"]), 6).alias("tstv_known_noncpg"), F.round(_ratio(c["e"], c["f"]), 6).alias("tstv_novel_noncpg"),
        F.round(F.col("n_gold") * 100 / (F.col("n") + 1e-6), 6).alias("pct_gold"), *([F.round(F.col("n_gold") * 100 / (n_gold + 1e-6), 6).alias("sensitivity")] if n_gold is not None else []),
    )
    return out


def by_filter(sites: DataFrame, counts: list[Column]) -> DataFrame:
    """A1."""
    return sites.groupBy("filter").agg(*counts)


def by_token(sites: DataFrame, counts: list[Column]) -> DataFrame:
    """A2: a site counts for each of its FILTER tokens."""
    return sites.withColumn("token", F.explode(F.array_distinct(F.split("filter", ";")))).groupBy("token").agg(*counts)


def by_pass(sites: DataFrame, counts: list[Column], passes: Column) -> DataFrame:
    """A3: PASS, FAIL and TOTAL."""
    marked = sites.withColumn("status", F.when(passes, "PASS").otherwise("FAIL"))
    return marked.rollup("status").agg(*counts).withColumn("status", F.coalesce("status", F.lit("TOTAL")))


def merge_reports(reports: DataFrame, key: str) -> DataFrame:
    """Reports of n sites and a Ts/Tv ratio: ts = n*r/(1+r), tv = n/(1+r) are summed, then the ratio
    is made anew."""
    r = F.col("tstv")
    s = reports.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * r / (1 + r)).alias("ts"), F.sum(F.col("n") / (1 + r)).alias("tv"))
    return s.select(key, "n", F.round("ts", 4).alias("ts"), F.round("tv", 4).alias("tv"), F.round(_ratio(F.col("ts"), F.col("tv")), 6).alias("tstv"))


def flag_cube(df: DataFrame, flags: list[str], sums: list[str]) -> DataFrame:
    """Every combination of 0, 1 and 2 (all) of the flags; cells without weight are dropped.

    Rows are summed by their own flags first, so that the cube copies 2**flags rows at most, not the table's."""
    out = df.groupBy(*flags).agg(*[F.sum(s).alias(s) for s in sums]).cube(*flags).agg(*[F.sum(s).alias(s) for s in sums], *[F.grouping(f).alias(f"_{f}") for f in flags])
    out = out.select(*[F.when(F.col(f"_{f}") == 1, 2).otherwise(F.col(f).cast("int")).alias(f) for f in flags], *sums)
    return out.filter(reduce(lambda a, b: a + b, [F.col(s) for s in sums]) > 0)


def merge_tables(frames: list[DataFrame], keys: list[str], first: list[str], lenient: bool = True) -> DataFrame:
    """Numeric columns summed by key over all tables; ``first`` columns keep the first table's value,
    and must agree unless ``lenient``."""
    nums = [c for c in frames[0].columns if c not in keys and c not in first]
    all_ = reduce(DataFrame.unionByName, [f.withColumn("_t", F.lit(i)) for i, f in enumerate(frames)])
    same = lambda c: F.when(F.count_distinct(c) > 1, F.raise_error(F.lit(f"{c} differs between tables")).cast(all_.schema[c].dataType)).otherwise(F.min(c))
    return all_.groupBy(*keys).agg(*[(F.min_by(c, "_t") if lenient else same(c)).alias(c) for c in first], *[F.sum(c).alias(c) for c in nums])


def spectrum(df: DataFrame, ac: str) -> DataFrame:
    """Alleles by count, their share, and the neutral expectation (1/i) / sum_{j<=max} 1/j."""
    hist = df.filter(F.col(ac) > 0).groupBy(F.col(ac).cast("int").alias("ac")).agg(F.count("*").alias("n"))
    total = hist.agg(F.sum("n").alias("_total"), F.max("ac").alias("_max"))
    harmonic = F.aggregate(F.sequence(F.lit(1), F.col("_max")), F.lit(0.0), lambda s, j: s + F.lit(1.0) / j)
    return hist.crossJoin(total).select("ac", "n", F.round(F.col("n") / F.col("_total"), 6).alias("fraction"), F.round(F.lit(1.0) / F.col("ac") / harmonic, 6).alias("expected"))


def weighted_moments(hist: DataFrame, keys: list[str], x: str, n: str, cap: float | None = None) -> DataFrame:
    """Weight, mean, variance and variance/mean of a histogram, x capped."""
    v = F.least(F.col(x), F.lit(cap)) if cap is not None else F.col(x)
    s = hist.groupBy(*keys).agg(F.sum(n).alias("weight"), F.sum(v * F.col(n)).alias("_s"), F.sum(v * v * F.col(n)).alias("_q"))
    mean = F.col("_s") / F.col("weight")
    var = F.col("_q") / F.col("weight") - mean * mean
    return s.select(*keys, "weight", F.round(mean, 6).alias("mean"), F.round(var, 6).alias("variance"), F.round(var / mean, 6).alias("vmr"))


def quantile_bins(hist: DataFrame, x: str, y: str, z: str, cuts: list[float]) -> DataFrame:
    """Mean of y by percentile bins of the weight z in the order of x, rows that straddle a cut
    counting in part on either side."""
    total = hist.agg(F.sum(z).alias("_all"))  # one row
    run = running_sum(hist, [x], z, "_to").withColumn("_from", F.col("_to") - F.col(z)).crossJoin(total)
    edges = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
    part = run.withColumn("_e", F.explode(edges))
    part = part.withColumn("_part", F.least("_to", F.col("_e.b") * F.col("_all")) - F.greatest("_from", F.col("_e.a") * F.col("_all"))).filter("_part > 0")
    return part.groupBy(F.col("_e.bin").alias("bin")).agg(F.round(F.sum(F.col("_part") * F.col(y)) / F.sum("_part"), 6).alias("mean"))


def labels_of(df: DataFrame, keys: list[str], label: str, separator: str = ",") -> DataFrame:
    """The distinct labels of each key, sorted and joined."""
    return df.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set(label)), separator).alias("labels"))


def matched_sample(positives: DataFrame, negatives: DataFrame, bin_: str, keys: list[str], seed: int = 1, draw: Column | None = None) -> DataFrame:
    """Negatives kept with chance min(1, positives/negatives) of their bin; the draw is a hash of the
    row's keys (or given, a number in 0..1), so the sample is the same for the same rows."""
    p = positives.groupBy(bin_).agg(F.count("*").alias("_p"))
    n = negatives.groupBy(bin_).agg(F.count("*").alias("_n"))
    draw = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000)) / 1_000_000 if draw is None else draw
    return negatives.join(n, bin_).join(p, bin_).filter(draw < F.col("_p") / F.col("_n")).drop("_p", "_n")


def conflict_free_labels(positives: DataFrame, negatives: DataFrame, keys: list[str]) -> DataFrame:
    """+1 for what only the positives have, -1 for what only the negatives have."""
    both = positives.select(*keys).distinct().withColumn("_s", F.lit(1)).unionByName(negatives.select(*keys).distinct().withColumn("_s", F.lit(-1)))
    return both.groupBy(*keys).agg(F.sum("_s").alias("label")).filter("label != 0")


def read_groups(headers: DataFrame) -> DataFrame:
    """Per file the sample (null unless all agree), the latest date and the number of read groups."""
    return headers.groupBy("file").agg(F.when(F.count_distinct("sm") == 1, F.min("sm")).alias("sm"), F.max("dt").alias("last_date"), F.count("*").alias("n_groups"))
