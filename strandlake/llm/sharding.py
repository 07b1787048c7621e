"""Reproducible shuffle of a table into shards by a Feistel permutation of its row numbers.

Rows are numbered 0..n-1 in the order of (doc_id, crc32, size). The number goes through a Feistel
network over a x b >= n cells (a = ceil(sqrt n)); numbers that leave 0..n-1 walk on along their
cycle. ``shard = p % shards`` and ``slot = p // shards``: shard sizes differ by one at most, slots
have no gaps, and both follow from a row's number alone (``place``), as the number follows from
them (``unplace``).

Law: ``rows``. ``grown_shard`` is null, as only the law ``key`` defines it.

Defined cases: a null text counts as empty (size 1, crc32 0); null ids come first; rows that are
equal in id and text take neighbouring numbers in any order, so the result as a set of rows is
fixed; an empty table gives no rows; columns of the input other than the id and the text are left
out, whatever they are called.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import let, staged, text_or_empty

SEED = 20_240_601
ROUNDS = 6
#: Steps of a cycle that are always provided for; the rare rows that need more walk on. Fewer than
#: a = ceil(sqrt n) cells lie outside 0..n-1, so no cycle takes more steps than that.
WALK = 64


def _cells(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return a, -(-max(n, 1) // a)


def _div(x: Column, by) -> Column:
    """Whole division; exact, as the remainder is taken off first."""
    return ((x - x % by) / by).cast("long")


def _network(x: Column, a: int, b: int, seed: int, rounds: int) -> Column:
    """One pass over the a x b cells; an even number of rounds brings the halves back in place."""
    start = F.struct((x % a).alias("l"), _div(x, a).alias("r"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))

    def turn(s: Column, k: Column) -> Column:
        mixed = F.pmod(s["l"] + F.pmod(F.xxhash64(F.lit(seed).cast("long"), k, s["r"]), s["a"]), s["a"])
        return F.struct(s["r"].alias("l"), mixed.alias("r"), s["b"].alias("a"), s["a"].alias("b"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(rounds - 1).cast("long")), start, turn, lambda s: s["r"] * a + s["l"])


def permuted(x: Column, n: int, seed: int = SEED, rounds: int = ROUNDS) -> Column:
    """The place of row number ``x`` (a long in 0..n-1) in the shuffle of ``n`` rows."""
    if rounds % 2:
        raise ValueError("rounds must be even")
    a, b = _cells(n)
    first = _network(x, a, b, seed, rounds)
    if a * b > n:
        on = lambda p, _: F.when(p < n, p).otherwise(_network(p, a, b, seed, rounds))
        walk = lambda start, steps: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, on)
        first = walk(first, min(WALK, a * b - n))
        if a * b - n > WALK:
            first = let(first, lambda p: F.when(p < n, p).otherwise(walk(p, a * b - n - WALK)))
    return first


def _hash(seed: int, k: int, r: int) -> int:
    import xxhash

    h = 42
    for v in (seed, k, r):
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
    return h - (1 << 64) if h >> 63 else h


def place(x: int, n: int, shards: int, seed: int = SEED, rounds: int = ROUNDS) -> tuple[int, int]:
    """Shard and slot of row number ``x``, computed without the table."""
    a, b = _cells(n)
    while True:
        left, right, ma, mb = x % a, x // a, a, b
        for k in range(rounds):
            left, right, ma, mb = right, (left + _hash(seed, k, right) % ma) % ma, mb, ma
        x = right * a + left
        if x < n:
            return x % shards, x // shards


def unplace(shard: int, slot: int, n: int, shards: int, seed: int = SEED, rounds: int = ROUNDS) -> int:
    """Row number at a shard and slot: the inverse of ``place``."""
    a, b = _cells(n)
    x = slot * shards + shard
    while True:
        left, right, ma, mb = x % a, x // a, a, b
        for k in reversed(range(rounds)):
            ma, mb = mb, ma
            left, right = (right - _hash(seed, k, left) % ma) % ma, left
        x = right * a + left
        if x < n:
            return x


def numbered(rows: DataFrame, keys: list[str], number: str = "row_no") -> tuple[DataFrame, int]:
    """``rows`` with a global row number in the order of ``keys``, and how many there are.

    Range partitions in key order are written with their ordinal; the ordinals' counts (as many
    as there are partitions) give each partition's first number.
    """
    spark = rows.sparkSession
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    order = [*keys, "_tie"]
    cut = staged(tied.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = sorted((r["_part"], r["n"]) for r in cut.groupBy("_part").agg(F.count("*").alias("n")).collect())
    first, total = [], 0
    for part, n in counts:
        first.append((part, total))
        total += n
    offsets = spark.createDataFrame(first or [(0, 0)], "_part int, _first long")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long")
    out = cut.withColumn("_local", local).join(F.broadcast(offsets), "_part")
    return out.withColumn(number, F.col("_first") + F.col("_local") - 1).drop("_part", "_first", "_local", "_tie"), total


def shard(docs: DataFrame, shards: int = 8, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(rows, ["doc_id", "text_crc32", "size"])
    placed = rows.withColumn("_p", permuted(F.col("row_no"), n, seed))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"), _div(F.col("_p"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )
