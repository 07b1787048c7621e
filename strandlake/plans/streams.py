"""Streams over the events table, run to their end: complete mode where whole tables are compared, append
mode where rows are final once written."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.plans.base import Plans
from strandlake.streaming import events as E

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql


def _events(spark, sf_dir):
    """Event time must have a zone; the session's (UTC) is meant."""
    return E.source(spark, sf_dir, "events").withColumns({"ts": F.col("ts").cast("timestamp"), "cents": F.round(F.col("value") * 100).cast("long")})


def _plain(df):
    """Times without a zone again, as in the table."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


CENTS = "CAST(round(value * 100) AS BIGINT)"


@plans.query(f"SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, CAST(sum({CENTS}) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """Z2, S7."""
    return _plain(E.run_available(E.tumbling(_events(spark, sf_dir), "1 hour", ["event_type"]), "complete"))


@plans.query("SELECT time_bucket(INTERVAL '1 hour', ts) - to_hours(k) AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    """Z2."""
    return _plain(E.run_available(E.sliding(_events(spark, sf_dir), "2 hours", "1 hour", ["event_type"]), "complete"))


@plans.query("""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS end_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, sf_dir):
    """W1 over time."""
    return _plain(E.run_available(E.sessions(_events(spark, sf_dir), "30 minutes", ["user_id"]), "complete"))


@plans.query("SELECT DISTINCT user_id, event_type, time_bucket(INTERVAL '1 day', ts) AS start FROM events")
def stream_dedup(spark, sf_dir):
    """One event of each user and kind a day; append mode, so that closed days are forgotten."""
    return _plain(E.run_available(E.deduplicated(_events(spark, sf_dir), ["user_id", "event_type"], "1 day")))


CLOSED = 100


@plans.query(f"""WITH r AS (SELECT event_id // 100000 + 1 AS chrom_no, event_id % 100000 // 3 + 1 AS pos, event_type IN ('click', 'view') AS fwd FROM events),
top AS (SELECT max(chrom_no * 4294967296 + pos) - {CLOSED} AS open FROM r)
SELECT chrom_no, pos, CAST(count_if(fwd) AS BIGINT) AS d_fwd, CAST(count_if(NOT fwd) AS BIGINT) AS d_rev FROM r, top WHERE chrom_no * 4294967296 + pos + 1 <= open GROUP BY chrom_no, pos""")
def stream_pileup(spark, sf_dir):
    """Events as reads sorted by position; piles of all places that the watermark has closed."""
    e = F.col("event_id")
    strand = F.when(F.col("event_type").isin("click", "view"), "+").otherwise("-")
    reads = E.source(spark, sf_dir, "events").select(F.floor(e / 100000).alias("_c"), e, strand.alias("strand"))
    reads = reads.select((F.col("_c") + 1).alias("chrom_no"), (F.floor(e % 100000 / 3) + 1).alias("pos"), "strand")
    return E.run_available(E.pileup(reads, CLOSED))


@plans.query("""SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM events a
JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL '10 minutes'
WHERE a.event_id % 2 = 0 AND b.event_id % 2 = 1""")
def stream_join(spark, sf_dir):
    """Z3: even events with odd ones of the same user up to 10 minutes later; both sides' rows are
    forgotten once the watermarks (an hour late) have passed what they could meet."""
    e = _events(spark, sf_dir)
    return _plain(E.run_available(E.joined(e.filter("event_id % 2 = 0"), _events(spark, sf_dir).filter("event_id % 2 = 1"), "user_id", "10 minutes")))
