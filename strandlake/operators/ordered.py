"""Ordered operators (W3-W13, T1-T11, F15) without single-task global windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.storage import staged


def with_row_number(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """Numbers 1, 2, ... over the whole table: ranks within range partitions, plus the
    partitions' running counts. The order must be total.

    The partitions' boundaries come from samples, so the partitioned table is written to the shared
    folder: both passes see the same ones, also after an executor is lost."""
    cut = staged(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "numbered")
    n = cut.groupBy("_p").agg(F.count("*").alias("_n"))
    before = n.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return cut.withColumn("_k", local).join(before, "_p").withColumn(name, (F.col("_k") + F.col("_before")).cast("long")).drop("_p", "_k", "_before")


def first_per(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return top_per(df, keys, order, 1).drop("rank")


def last_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return first_per(df, keys, [F.col(order).desc()])


def top_per(df: DataFrame, keys: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The k first rows of each key with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The k first rows."""
    return df.orderBy(*order).limit(k)


def genomic_sort(df: DataFrame, chrom: str = "chrom", beg: str = "pos", *more: str) -> DataFrame:
    """By chromosome ordinal, then place."""
    from strandlake.functions.variant import chrom_ordinal

    # a column of its own: an expression in the order would be computed anew at each comparison
    return df.withColumn("_ordinal", chrom_ordinal(F.col(chrom))).orderBy("_ordinal", chrom, beg, *more).drop("_ordinal")


def listed_order(df: DataFrame, order: DataFrame, key: str, rank: str) -> DataFrame:
    """In the order of a list; rows that aren't listed go."""
    return df.join(order.select(key, rank), key).orderBy(rank)


def shuffled(df: DataFrame, keys: list[str], seed: int, draw: Column | None = None) -> DataFrame:
    """By a hash of the row's keys (or a given ``draw``): the same for the same rows. ``place``: 1, 2, ..."""
    draw = F.xxhash64(*keys, F.lit(seed)) if draw is None else draw
    return with_row_number(df.withColumn("_draw", draw), ["_draw", *keys], "place").drop("_draw")


def drop_repeats(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """rows whose value equals that of the row before go.

    Where rows are in the order of the value itself, equal ones are neighbours: the first of each stays,
    and rows are dealt by value too, not by ``partition`` alone."""
    if order[0] == value:
        first = F.row_number().over(Window.partitionBy(*partition, value).orderBy(*order))
        return df.withColumn("_b", first).filter(F.col("_b") == 1).drop("_b")
    before = F.lag(value).over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col(value))).drop("_b")


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` over all rows up to each one, in a total order: sums within range partitions,
    plus those of the partitions before."""
    cut = staged(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "running")
    sums = cut.groupBy("_p").agg(F.sum(value).alias("_s"))
    before = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_k", local).join(before, "_p").withColumn(name, F.col("_k") + F.col("_before")).drop("_p", "_k", "_before")


def tail_fraction(hist: DataFrame, keys: list[str], x: str, n: str) -> DataFrame:
    """Share of the weight at x and above."""
    up = Window.partitionBy(*keys).orderBy(F.col(x).desc())
    return hist.withColumn("tail", F.sum(n).over(up.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(n).over(Window.partitionBy(*keys)))


def running_quantile(hist: DataFrame, keys: list[str], x: str, n: str, q: float) -> DataFrame:
    """The greatest x whose running weight (itself included) is under q of the total; 0 if none is."""
    run = F.sum(n).over(Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(n).over(Window.partitionBy(*keys))
    return hist.withColumn("_r", run).withColumn("_t", total).groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("_r") < F.col("_t") * q, F.col(x))), F.lit(0)).alias("q"))


def knee(hist: DataFrame, key: str, n: str) -> DataFrame:
    """Rank of each key by falling count and the cumulative share up to it."""
    numbered = with_row_number(hist.withColumn("_neg", -F.col(n)), ["_neg", key], "rank")
    total = hist.agg(F.sum(n).alias("_all"))  # one row
    return running_sum(numbered, ["_neg", key], n, "_to").crossJoin(total).withColumn("share", F.col("_to") / F.col("_all")).drop("_neg", "_to", "_all")


def islands(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Maximal runs of equal values: keys, value, start, end, n."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_i", F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, value).orderBy(order)))
    return marked.groupBy(*keys, value, "_i").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("_i")


def longest_run_states(df: DataFrame, keys: list[str], order: str, states: list[str]) -> DataFrame:
    """Each state (boolean column) has runs of consecutive true rows; a row takes the state of the
    longest run over it, of equals the first state; neighbouring rows of one state are joined.

    Rows that no state covers end a stretch and are left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    out = df.withColumn("_k", F.row_number().over(w))
    for s in states:
        off = F.sum(F.when(F.col(s), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn(f"_g_{s}", off)
        out = out.withColumn(f"_n_{s}", F.when(F.col(s), F.count_if(F.col(s)).over(Window.partitionBy(*keys, f"_g_{s}"))).otherwise(0)).drop(f"_g_{s}")
    best = F.greatest(*[F.col(f"_n_{s}") for s in states]) if len(states) > 1 else F.col(f"_n_{states[0]}")
    pick = F.coalesce(*[F.when((F.col(f"_n_{s}") == best) & (best > 0), i) for i, s in enumerate(states)])
    picked = out.withColumn("state", pick).withColumn("run", best).withColumn("_state", F.coalesce(pick, F.lit(-1)))
    change = F.when(F.col("_state") == F.lag("_state").over(w), 0).otherwise(1)
    blocks = picked.withColumn("_b", change)
    blocks = blocks.withColumn("_b", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("state is not null")
    return blocks.groupBy(*keys, "_b", "state").agg(F.min("_k").alias("first"), F.max("_k").alias("last"), F.min(order).alias("start"), F.max(order).alias("end"), F.max("run").alias("longest")).drop("_b")
