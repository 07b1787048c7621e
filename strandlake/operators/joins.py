"""Joins of the inventory (J1-J27) as DataFrame operators.

Small sides are broadcast by Catalyst's own size estimate (or AQE's measured one), never by a hint, so
that every join still works when both sides are large.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_or_fail(df: DataFrame, key: str) -> DataFrame:
    """F16: the rows, or an error if a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(key))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.col(key).cast("string")))).otherwise(F.lit(True))
    return df.withColumn("_once", checked.cast("boolean")).filter("_once").drop("_once")


def tsv_join(frames: list[DataFrame], key: str, check: bool = False) -> DataFrame:
    """Inner join of N tables on their key, columns in argument order."""
    own = [unique_or_fail(f, key) for f in frames] if check else frames
    return reduce(lambda a, b: a.join(b, key), own)


def combine_lists(frames: list[DataFrame], names: list[str], out: str, delim: str = "\t") -> DataFrame:
    """Every combination of the (small, given) lists, joined by ``delim``."""
    all_ = reduce(lambda a, b: a.crossJoin(b), [f.select(n) for f, n in zip(frames, names, strict=True)])
    return all_.withColumn(out, F.concat_ws(delim, *names))


def semi_by_id(df: DataFrame, ids: DataFrame, key: str = "id", missing: str = ".") -> DataFrame:
    """Rows whose id is listed; ``.`` never is."""
    return df.filter(F.col(key) != missing).join(ids.select(key).distinct(), key, "left_semi")


def update_listed(df: DataFrame, sites: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """``column`` becomes ``value`` where the site is listed."""
    mark = sites.select(*keys).distinct().withColumn("_listed", F.lit(True))
    return df.join(mark, keys, "left").withColumn(column, F.when(F.col("_listed"), value).otherwise(F.col(column))).drop("_listed")


def flag_listed(df: DataFrame, sites: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Whether the site is listed."""
    mark = sites.select(*keys).distinct().withColumn("_m", F.lit(True))
    return df.join(mark, keys, "left").withColumn(flag, F.coalesce("_m", F.lit(False))).drop("_m")


def add_ids(sites: DataFrame, known: DataFrame, order: str, keep: bool = False, info_key: str | None = None) -> DataFrame:
    """The id of the first known site (by ``order``) at the same place and REF whose ALTs
    hold the site's. known: chrom, pos, ref, alts (array), id, ``order``."""
    alts = known.select("chrom", "pos", "ref", F.explode("alts").alias("alt"), F.col("id").alias("_kid"), F.col(order).alias("_o"))
    first = alts.groupBy("chrom", "pos", "ref", "alt").agg(F.min_by("_kid", "_o").alias("_kid"))
    out = sites.join(first, ["chrom", "pos", "ref", "alt"], "left")
    if info_key:
        hit = F.when(F.col("_kid").isNotNull(), "1").otherwise("0")
        return out.withColumn("id", F.lit(".")).withColumn("info", F.concat("info", F.lit(f";{info_key}="), hit)).drop("_kid")
    return out.withColumn("id", F.coalesce("_kid", F.col("id") if keep else F.lit("."))).drop("_kid")


def external_filters(sites: DataFrame, ext: DataFrame, prefix: str = "") -> DataFrame:
    """FILTER tokens of all matching external rows that aren't PASS are added, prefixed, once
    each; ``.`` counts as PASS; PASS goes once there is a token. Added tokens come sorted."""
    keys = ["chrom", "pos", "ref", "alt"]
    tokens = ext.filter(~F.col("filter").isin("PASS", ".")).select(*keys, F.explode(F.split("filter", ";")).alias("t"))
    more = tokens.groupBy(*keys).agg(F.sort_array(F.collect_set(F.concat(F.lit(prefix), "t"))).alias("_more"))
    own = F.filter(F.split("filter", ";"), lambda t: ~t.isin("PASS", "."))
    all_ = F.array_union(own, F.coalesce("_more", F.array().cast("array<string>")))
    out = F.when(F.size(all_) > 0, F.array_join(all_, ";")).otherwise("PASS")
    return sites.join(more, keys, "left").withColumn("filter", out).drop("_more")


def lookup_or_default(df: DataFrame, table: DataFrame, key: str, value: str, out: str, default: Column | None = None, required: bool = False) -> DataFrame:
    """A value by key; a miss is an error, or gives the default (the key itself if none is given)."""
    pairs = table.select(F.col(key), F.col(value).alias("_v"))
    miss = F.raise_error(F.concat(F.lit("no value for "), F.col(key).cast("string"))).cast("string") if required else (F.col(key) if default is None else default)
    return df.join(pairs, key, "left").withColumn(out, F.coalesce("_v", miss)).drop("_v")


def values_at(rows: DataFrame, table: DataFrame, keys: list[str], value: str, missing: str = "NA") -> DataFrame:
    """Rows with the value (as text) at their place, ``missing`` where the table has none."""
    return rows.join(table.select(*keys, value), keys, "left").withColumn(value, F.coalesce(F.col(value).cast("string"), F.lit(missing)))


def combine_likelihoods(rows: DataFrame, keys: list[str], max_pl: int = 60) -> DataFrame:
    """Full outer merge of call sets in long form: PLs (and depths) are summed per site and
    sample, brought to least 0 and capped."""
    sums = rows.groupBy(*keys).agg(*[F.sum(f"pl{i}").alias(f"_{i}") for i in range(3)], F.count("*").alias("n_sets"))
    low = F.least("_0", "_1", "_2")
    return sums.select(*keys, "n_sets", *[F.least(F.col(f"_{i}") - low, F.lit(max_pl)).cast("int").alias(f"pl{i}") for i in range(3)])


def pairs_within(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every left sample with every right sample of the same variant; columns other than the
    keys get ``_1`` and ``_2``."""
    named = lambda df, k: df.select(*keys, *[F.col(c).alias(f"{c}_{k}") for c in df.columns if c not in keys])
    return named(left, 1).join(named(right, 2), keys)


def carrier_pairs(carriers: DataFrame, variant: str, sample: str) -> DataFrame:
    """Pairs of carriers (first < second) of a variant; meant for rare ones, whose carriers are few."""
    other = carriers.select(variant, F.col(sample).alias("sample2"))
    return carriers.select(variant, F.col(sample).alias("sample1")).join(other, variant).filter("sample1 < sample2")


def fuzzy_barcodes(table: DataFrame, code: str, value: str, parity: Column | None = None) -> DataFrame:
    """All keys that a read may show for a barcode: it with its parity base, with N, and every single
    substitution of either; ``exact`` for the first two. A key of two barcodes is an error."""
    letters = F.array(*[F.lit(b) for b in "ACGTN"])
    ends = F.array(parity, F.lit("N")) if parity is not None else F.array(F.lit(""))
    base = table.select(F.col(code), F.col(value), F.explode(F.transform(F.array_distinct(ends), lambda e: F.concat(F.col(code), e))).alias("key"))
    places = F.sequence(F.lit(1), F.length("key"))
    near = base.select(code, value, F.explode(F.flatten(F.transform(places, lambda i: F.transform(letters, lambda b: F.overlay("key", b, i, F.lit(1)))))).alias("key"), F.lit(False).alias("exact"))
    all_ = base.select(code, value, "key", F.lit(True).alias("exact")).unionByName(near)
    best = all_.groupBy("key").agg(F.max_by(value, F.col("exact")).alias(value), F.max("exact").alias("exact"), F.count_distinct(F.when(F.col("exact"), F.col(value))).alias("_n"))
    ok = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("barcodes conflict at "), F.col("key")))).otherwise(F.lit(True)).cast("boolean")
    return best.filter(ok).drop("_n")


def demultiplexed(reads: DataFrame, seq: str, table: DataFrame, code: str, value: str, width: int, parity: Column | None = None) -> DataFrame:
    """Reads with the barcode's value; ``match`` is exact, mismatch or miss."""
    keys = fuzzy_barcodes(table, code, value, parity)
    out = reads.withColumn("key", F.substring(seq, 1, width)).join(keys, "key", "left")
    return out.withColumn("match", F.when(F.col("exact"), "exact").when(F.col("exact").isNotNull(), "mismatch").otherwise("miss")).drop("exact")


def zipped(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows by their rank in a stated order, without a global sort in one task."""
    from strandlake.operators.ordered import with_row_number

    a, b = with_row_number(left, left_order, "_row"), with_row_number(right, right_order, "_row")
    return a.join(b, "_row").drop("_row")


def unrelated_pairs(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) that no edge joins, in either direction."""
    both = edges.select(F.col("id1").alias("a"), F.col("id2").alias("b")).unionByName(edges.select(F.col("id2").alias("a"), F.col("id1").alias("b")))
    return candidates.join(both.distinct(), ["a", "b"], "left_anti")


def reconciled(a: DataFrame, b: DataFrame, key: str, exclude: DataFrame | None = None, include: DataFrame | None = None) -> DataFrame:
    """Ids of both sides, without the excluded, only the included if any are given."""
    out = a.select(key).intersect(b.select(key))
    out = out.join(exclude.select(key), key, "left_anti") if exclude is not None else out
    return out.join(include.select(key), key, "left_semi") if include is not None else out


def lifted(sites: DataFrame, mapped: DataFrame) -> DataFrame:
    """Sites at their new places (key chrom_pos_ref_alt), the old key in INFO, main chromosomes only."""
    key = F.concat_ws("_", "chrom", F.col("pos").cast("string"), "ref", "alt")
    named = sites.withColumn("key", key)
    new = mapped.select("key", F.col("chrom").alias("_c"), F.col("beg").alias("_b")).filter(F.regexp_replace("_c", "^chr", "").rlike(r"^(\d|1\d|2[0-2]|X|Y|M|MT)$"))
    out = named.join(new, "key")
    return out.select(F.col("_c").alias("chrom"), (F.col("_b") + 1).alias("pos"), "id", "ref", "alt", "filter", F.concat("info", F.lit(";OLD_VARIANT="), "key").alias("info"))


def sparse_scores(sites: DataFrame, carriers: DataFrame, keys: list[str], offsets: str) -> DataFrame:
    """Weight 1 for each carrier haplotype (sample = offset div 2) of the sites listed."""
    one = carriers.select(*keys, F.explode(F.split(offsets, ",")).alias("o")).withColumn("sample", F.floor(F.col("o").cast("long") / 2).cast("long"))
    return sites.join(one, keys)
