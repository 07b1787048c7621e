"""Streaming forms of the ordered operators (Z1, Z2, Z3, session = W1, F15) with Structured Streaming.

Each takes a streaming DataFrame and returns one; state is bounded by the watermark. ``run_available``
drives a stream over what is there to a Parquet table and returns that, so that results can be compared
with a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.storage import new_path


def source(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's Parquet files as a stream; the schema is the table's own."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    r = r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r
    # a stream reads a folder; a single file is one by its glob
    return r.parquet(f"{folder}/{name}.parquet*")


def tumbling(events: DataFrame, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Z2, fixed tiles: counts and sums."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), *keys)
    return w.agg(F.count("*").alias("n"), F.sum("cents").alias("cents")).select(F.col("window.start").alias("start"), *keys, "n", "cents")


def sliding(events: DataFrame, width: str, step: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Overlapping tiles."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), *keys)
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """W1 over time: runs of events no further apart than the gap."""
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), *keys)
    return w.agg(F.count("*").alias("n")).select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end_ts"), "n")


def deduplicated(events: DataFrame, keys: list[str], width: str, late: str = "1 hour") -> DataFrame:
    """One row of each key a tile; a tile's keys are forgotten when the watermark has passed it."""
    w = events.withWatermark("ts", late).select(*keys, F.window("ts", width).alias("window"))
    return w.dropDuplicates([*keys, "window"]).select(*keys, F.col("window.start").alias("start"))


#: Bits of a place within its chromosome; chromosomes follow one another on one scale.
PLACE_BITS = 32


def pileup(reads: DataFrame, within: int = 1000) -> DataFrame:
    """By place the reads of either strand, of a position-sorted stream of chrom_no, pos, strand.

    The genome is the stream's clock, a second a base. Places more than ``within`` bases behind the
    furthest read are closed: written once, and forgotten."""
    at = F.timestamp_seconds(F.shiftleft(F.col("chrom_no").cast("long"), PLACE_BITS) + F.col("pos"))
    w = reads.withColumn("_at", at).withWatermark("_at", f"{within} seconds").groupBy(F.window("_at", "1 second"))
    place = F.unix_seconds(F.col("window.start"))
    low = F.lit((1 << PLACE_BITS) - 1)
    piles = w.agg(F.count_if(F.col("strand") == "+").alias("d_fwd"), F.count_if(F.col("strand") == "-").alias("d_rev"))
    return piles.select(F.shiftright(place, PLACE_BITS).alias("chrom_no"), place.bitwiseAND(low).alias("pos"), "d_fwd", "d_rev")


def joined(left: DataFrame, right: DataFrame, key: str, within: str, late: str = "1 hour") -> DataFrame:
    """Z3: pairs of two streams with one key whose right event comes ``within`` after the left one."""
    a = left.withWatermark("ts", late).select(F.col("ts").alias("lt"), F.col(key).alias("lk"), F.col("event_id").alias("left_id"))
    b = right.withWatermark("ts", late).select(F.col("ts").alias("rt"), F.col(key).alias("rk"), F.col("event_id").alias("right_id"))
    return a.join(b, (F.col("lk") == F.col("rk")) & (F.col("rt") > F.col("lt")) & (F.col("rt") <= F.col("lt") + F.expr(f"INTERVAL {within}"))).select(F.col("lk").alias(key), "left_id", "right_id")


def run_available(stream: DataFrame, mode: str = "append", timeout: int = 600) -> DataFrame:
    """Runs the stream over all input there is and waits for it; returns what it wrote.

    In ``complete`` mode each batch replaces the table."""
    spark = stream.sparkSession
    path, state = new_path(spark, "stream"), new_path(spark, "stream-state")
    writer = stream.writeStream.option("checkpointLocation", state).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        q = writer.format("parquet").option("path", path).start()
    else:
        q = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    if not q.awaitTermination(timeout):
        q.stop()
        raise TimeoutError("the stream did not end")
    return spark.read.schema(stream.schema).parquet(path)
