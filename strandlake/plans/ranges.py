"""Intervals, histograms, runs, reads, counting and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import reads as R
from strandlake.functions import sequence as S
from strandlake.functions import variant
from strandlake.operators import aggregates as A
from strandlake.operators import counting as N
from strandlake.operators import intervals as I
from strandlake.operators import joins as J
from strandlake.operators import ordered as O
from strandlake.plans.base import Plans
from strandlake.plans.views import ctes, table, view

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql

MERGED = """s AS (SELECT chrom, beg, end_pos, max(end_pos) OVER (PARTITION BY chrom ORDER BY beg, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM intervals),
g AS (SELECT *, sum(CASE WHEN beg <= before THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY beg, end_pos ROWS UNBOUNDED PRECEDING) AS grp FROM s), m AS (SELECT chrom, min(beg) AS beg, max(end_pos) AS end_pos FROM g GROUP BY chrom, grp)"""
CIGAR_SQL = "list_transform(regexp_extract_all(cigar, '([0-9]+[MIDNS])'), lambda x: {'n': CAST(regexp_extract(x, '^[0-9]+') AS INT), 'op': x[-1]})"


def _intervals(spark, sf_dir):
    return view(spark, sf_dir, "intervals").withColumnRenamed("end_pos", "end")


@plans.query(ctes("intervals") + f", {MERGED} SELECT * FROM m")
def interval_merge(spark, sf_dir):
    """W1, U7, S6, C21."""
    return I.merged(_intervals(spark, sf_dir), width=4096).withColumnRenamed("end", "end_pos")


@plans.query(ctes("intervals") + f", {MERGED}, l AS (SELECT chrom, coalesce(lag(end_pos) OVER (PARTITION BY chrom ORDER BY beg), 0) AS b, beg AS e FROM m UNION ALL SELECT chrom, max(end_pos), 120000 FROM m GROUP BY chrom) SELECT chrom, b AS beg, e AS end_pos FROM l WHERE e > b")
def interval_invert(spark, sf_dir):
    """W2."""
    iv = _intervals(spark, sf_dir)
    sizes = iv.select("chrom").distinct().withColumn("size", F.lit(120000).cast("long"))
    return I.inverted(iv, sizes, width=4096).withColumnRenamed("end", "end_pos")


@plans.query(ctes("intervals") + f", {MERGED} SELECT chrom, CAST(sum(end_pos - beg) AS BIGINT) AS size FROM m GROUP BY chrom")
def interval_size(spark, sf_dir):
    """A34."""
    return I.total_size(I.merged(_intervals(spark, sf_dir)), "chrom")


@plans.query(ctes("intervals") + ", p AS (SELECT event_id, concat('chr', CAST(user_id % 5 + 1 AS INT)) AS chrom, (event_id * 91) % 100000 AS pos FROM events) SELECT event_id, iid FROM p JOIN intervals i ON p.chrom = i.chrom AND p.pos >= i.beg AND p.pos < i.end_pos")
def point_in_interval(spark, sf_dir):
    """J15."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("chr"), (F.col("user_id") % 5 + 1).cast("int").cast("string")).alias("chrom"), (F.col("event_id") * 91 % 100000).alias("pos"))
    return I.points_in(e, _intervals(spark, sf_dir), 64).select("event_id", "iid")


@plans.query(ctes("intervals") + ", p AS (SELECT event_id, concat('chr', CAST(user_id % 5 + 1 AS INT)) AS chrom, (event_id * 91) % 100000 AS pos FROM events) SELECT event_id FROM p WHERE NOT EXISTS (SELECT 1 FROM intervals i WHERE p.chrom = i.chrom AND p.pos >= i.beg AND p.pos < i.end_pos)")
def point_outside(spark, sf_dir):
    """exclusion of masked places."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("chr"), (F.col("user_id") % 5 + 1).cast("int").cast("string")).alias("chrom"), (F.col("event_id") * 91 % 100000).alias("pos"))
    return I.points_in(e, _intervals(spark, sf_dir), 64, how="left_anti").select("event_id")


@plans.query(ctes("intervals") + " SELECT a.iid AS a, b.iid AS b FROM intervals a JOIN intervals b ON a.chrom = b.chrom AND a.beg < b.end_pos AND b.beg < a.end_pos WHERE a.iid < b.iid")
def interval_overlap(spark, sf_dir):
    """J16."""
    iv = _intervals(spark, sf_dir)
    a = iv.withColumnRenamed("iid", "a")
    b = iv.select("chrom", F.col("beg").alias("beg2"), F.col("end").alias("end2"), F.col("iid").alias("b"))
    return I.overlapping(a, b, 64).filter("a < b").select("a", "b")


BAND = """e AS (SELECT concat('chr', CAST(user_id % 5 + 1 AS INT)) AS chrom, CASE WHEN event_id % 2 = 0 THEN 'p' ELSE 'm' END AS s, (event_id * 7) % 40000 // 10 * 10 AS b, CAST(round(abs(value) * 10) AS BIGINT) AS d FROM events WHERE round(abs(value) * 10) >= 5),
g AS (SELECT chrom, s, b, CAST(sum(d) AS BIGINT) AS d FROM e GROUP BY ALL)"""


@plans.query(f"WITH {BAND} SELECT p.chrom, CASE WHEN m.b < p.b THEN m.b ELSE p.b END - 1 AS beg, greatest(m.b, p.b) AS end_pos, CASE WHEN m.b < p.b THEN 'div' ELSE 'conv' END AS kind, p.b - m.b AS distance, p.d AS dp, m.d AS dm FROM g p JOIN g m ON p.chrom = m.chrom AND m.b - 50 <= p.b AND p.b < m.b + 200 WHERE p.s = 'p' AND m.s = 'm' AND p.d * m.d >= 100 AND p.d + m.d >= 30")
def tss_band_join(spark, sf_dir):
    """J14, S7, W5, C20."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("chr"), (F.col("user_id") % 5 + 1).cast("int").cast("string")).alias("chrom"), F.col("event_id"), (F.col("event_id") * 7 % 40000).alias("pos"), F.round(F.abs("value") * 10).cast("long").alias("depth"))
    side = lambda k, b, d: I.depth_bins(e.filter(F.col("event_id") % 2 == k), 10, 5).select("chrom", F.col("bin").alias(b), F.col("depth").alias(d))
    return I.band(side(0, "bp", "dp"), side(1, "bm", "dm"), -50, 200, 100, 30).withColumnRenamed("end", "end_pos")


MAP = "m AS (SELECT DISTINCT CAST(p_size % 3 AS INT) AS k, CAST(p_partkey * 10 AS BIGINT) AS x, CAST(p_partkey * 100 + p_size AS DOUBLE) / 10000 AS y FROM part)"


@plans.query(f"""WITH {MAP}, p AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_linenumber % 3 AS INT) AS k, l_partkey * 10 + l_suppkey % 10 AS x FROM lineitem), n AS (SELECT k, x AS x0, y AS y0, lead(x) OVER (PARTITION BY k ORDER BY x) AS x1, lead(y) OVER (PARTITION BY k ORDER BY x) AS y1 FROM m)
SELECT p.l_orderkey, p.l_linenumber, p.l_suppkey, p.x, CASE WHEN p.x = x0 THEN y0 ELSE y0 + (p.x - x0) / (x1 - x0) * (y1 - y0) END AS y FROM p ASOF LEFT JOIN n ON p.k = n.k AND p.x >= n.x0""")
def asof_interpolate(spark, sf_dir):
    """J17, W9, C22."""
    m = table(spark, sf_dir, "part").select((F.col("p_size") % 3).cast("int").alias("k"), (F.col("p_partkey") * 10).alias("mx"), ((F.col("p_partkey") * 100 + F.col("p_size")).cast("double") / 10000).alias("my")).distinct()
    p = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("k"), "l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("x"))
    return I.interpolated(p, m, ["k"], "x", "mx", "my", 4096).select("l_orderkey", "l_linenumber", "l_suppkey", "x", "y")


@plans.query(f"""WITH {MAP}, r AS (SELECT CAST(s_suppkey % 3 AS INT) AS k, s_suppkey * 100 AS lo, s_suppkey * 100 + 50 AS hi, s_suppkey * 0.1 AS ylo, s_suppkey * 0.1 + 0.05 AS yhi FROM supplier)
SELECT r.k, lo, hi, least(lo, min(CASE WHEN y > ylo - 0.5 THEN x END)) AS new_lo, greatest(hi, max(CASE WHEN y < yhi + 0.5 THEN x END)) AS new_hi FROM r JOIN m USING (k) GROUP BY r.k, lo, hi""")
def map_extension(spark, sf_dir):
    """The inverse look-up."""
    m = table(spark, sf_dir, "part").select((F.col("p_size") % 3).cast("int").alias("k"), (F.col("p_partkey") * 10).alias("x"), ((F.col("p_partkey") * 100 + F.col("p_size")).cast("double") / 10000).alias("y")).distinct()
    r = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 3).cast("int").alias("k"), (F.col("s_suppkey") * 100).alias("lo"), (F.col("s_suppkey") * 100 + 50).alias("hi"), (F.col("s_suppkey") * 0.1).alias("ylo"), (F.col("s_suppkey") * 0.1 + 0.05).alias("yhi"))
    return I.extended(r, m, ["k"], 0.5)


@plans.query(ctes("intervals") + ", s AS (SELECT concat('chr', CAST(l_suppkey % 5 + 1 AS INT)) AS chrom, (l_orderkey * 13 + l_linenumber) % 100000 AS pos, l_quantity AS score FROM lineitem) SELECT i.chrom, i.beg, i.end_pos, round(avg(score), 6) AS mean, count(*) AS n FROM (SELECT DISTINCT chrom, beg, end_pos FROM intervals) i JOIN s ON s.chrom = i.chrom AND s.pos >= i.beg AND s.pos < i.end_pos GROUP BY ALL")
def region_means(spark, sf_dir):
    """A33, C37."""
    s = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("chr"), (F.col("l_suppkey") % 5 + 1).cast("int").cast("string")).alias("chrom"), ((F.col("l_orderkey") * 13 + F.col("l_linenumber")) % 100000).alias("pos"), F.col("l_quantity").alias("score"))
    iv = _intervals(spark, sf_dir).select("chrom", "beg", "end").distinct()
    return I.region_mean(iv, s, 64).withColumn("mean", F.round("mean", 6)).withColumnRenamed("end", "end_pos")


PILE = f"""a AS (SELECT rid, chrom, strand, umi, cigar, CASE WHEN strand = '+' THEN pos ELSE pos + CAST(list_sum(list_transform(list_filter({CIGAR_SQL}, lambda o: o.op IN ('M', 'D', 'N')), lambda o: o.n)) AS BIGINT) - 1 END AS place FROM reads),
p AS (SELECT chrom, place - 1 AS beg, place AS end_pos, count(DISTINCT CASE WHEN strand = '+' THEN umi END) AS u_fwd, count(CASE WHEN strand = '+' THEN 1 END) AS d_fwd, count(DISTINCT CASE WHEN strand = '-' THEN umi END) AS u_rev, count(CASE WHEN strand = '-' THEN 1 END) AS d_rev FROM a GROUP BY chrom, place)"""


@plans.query(ctes("reads") + f", {PILE} SELECT chrom, beg, end_pos, greatest(u_fwd, u_rev) AS u_max, u_fwd, d_fwd, u_rev, d_rev FROM p")
def pileup_umi(spark, sf_dir):
    """Z1, X17, S20, C27."""
    return N.pileup(view(spark, sf_dir, "reads")).withColumnRenamed("end", "end_pos")


@plans.query(ctes("reads") + f", {PILE}, t AS (SELECT chrom, unnest(list_filter(list_transform(range(0, 20), lambda i: i * 500), lambda t: t > 0 AND t <= end_pos AND end_pos < t + 1000)) AS tile, u_fwd, u_rev FROM p) SELECT chrom, CAST(tile AS BIGINT) AS tile, CAST(sum(u_fwd) AS BIGINT) AS u_fwd, CAST(sum(u_rev) AS BIGINT) AS u_rev, round(sqrt(sum(u_fwd) * sum(u_rev)), 6) AS score FROM t GROUP BY chrom, tile")
def pileup_tiles(spark, sf_dir):
    """Z2, A31."""
    return N.tile_sums(N.pileup(view(spark, sf_dir, "reads")), 1000, 500, "geometric")


@plans.query(ctes("reads") + f", w AS (SELECT rid, list_reduce(list_concat([{{'n': 0, 'op': 'B'}}], {CIGAR_SQL}), lambda a, o: {{'n': a.n + CASE WHEN o.op IN ('M','D','N','=','X') THEN o.n ELSE 0 END, 'op': ''}}).n AS len FROM reads) SELECT r.rid, w.len AS ref_len, r.pos + w.len - 1 AS end_pos, CAST(regexp_extract(cigar, '^([0-9]+)S', 1) AS INT) AS clip FROM reads r JOIN w USING (rid) WHERE mapq >= 20")
def cigar_end(spark, sf_dir):
    """X17, F9."""
    r = view(spark, sf_dir, "reads").filter(R.usable(F.lit(0), F.col("mapq"), 20))
    return r.select("rid", R.reference_length(F.col("cigar")).alias("ref_len"), R.end_position(F.col("pos"), F.col("cigar")).alias("end_pos"), R.soft_clips(F.col("cigar")).alias("clip"))


DEPTH = """c AS (SELECT rid, chrom, pos - 1 AS b, CAST(regexp_extract(cigar, 'S([0-9]+)M', 1) AS INT) AS m1, CAST(regexp_extract(cigar, 'M([0-9]+)D', 1) AS INT) AS dl FROM reads),
x AS (SELECT rid, chrom, b AS s1, b + m1 AS e1, b + m1 + dl AS s2, b + m1 + dl + 20 AS e2 FROM c), r AS (SELECT DISTINCT chrom, 500 * k AS rb, 500 * k + 60 AS re FROM reads, range(1, 9) t(k)),
j AS (SELECT r.chrom, rb, re, s1, e1, s2, e2 FROM x JOIN r ON x.chrom = r.chrom AND x.s1 < re + 100 AND rb - 100 < x.e2)"""


def _depth_sql(a: str, b: str) -> str:
    return f"CAST(sum(greatest(0, least(e1, {b}) - greatest(s1, {a})) + greatest(0, least(e2, {b}) - greatest(s2, {a}))) AS BIGINT)"


@plans.query(ctes("reads") + f", {DEPTH} SELECT chrom, rb, re, {_depth_sql('rb - 100', 'rb')} AS before, {_depth_sql('rb', 're')} AS inside, {_depth_sql('re', 're + 100')} AS after, count(*) AS clipped FROM j GROUP BY ALL")
def cigar_depth(spark, sf_dir):
    """A32, C35."""
    r = view(spark, sf_dir, "reads")
    regions = r.select("chrom").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(8)))).select("chrom", (F.col("k") * 500).cast("long").alias("beg"), (F.col("k") * 500 + 60).cast("long").alias("end"))
    return N.breakpoint_depth(r, regions, 100, 256)


@plans.query(ctes("reads") + " SELECT chrom, barcode, count(DISTINCT umi) AS ucnt, count(*) AS dcnt FROM reads GROUP BY 1, 2")
def dropseq_counts(spark, sf_dir):
    """A9, C25."""
    return N.umi_counts(view(spark, sf_dir, "reads"), ["chrom", "barcode"])


TRANSCRIPT = "t AS (SELECT 'T' || CAST(pos % 50 AS VARCHAR) AS tx, 'B' || CAST(barcode AS VARCHAR) AS bc, count(DISTINCT umi) AS ucnt FROM reads GROUP BY 1, 2)"


def _transcripts(spark, sf_dir):
    r = view(spark, sf_dir, "reads").select(F.concat(F.lit("T"), (F.col("pos") % 50).cast("string")).alias("tx"), F.concat(F.lit("B"), F.col("barcode").cast("string")).alias("bc"), "umi")
    return N.umi_counts(r, ["tx", "bc"])


@plans.query(ctes("reads") + f", {TRANSCRIPT} SELECT bc, count(*) AS n_transcripts, CAST(sum(ucnt) AS BIGINT) AS n_umis, CAST(count_if(tx LIKE 'T1%') AS BIGINT) AS n_human FROM t GROUP BY bc")
def dropseq_barcodes(spark, sf_dir):
    """A10."""
    return N.barcode_transcripts(_transcripts(spark, sf_dir), "bc", "tx", "^T1")


@plans.query(ctes("reads") + f", {TRANSCRIPT}, b AS (SELECT bc, count(*) AS n FROM t GROUP BY bc ORDER BY n DESC, bc LIMIT 5), r AS (SELECT bc, row_number() OVER (ORDER BY n DESC, bc) AS k FROM b) SELECT tx, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN k = {k} THEN ucnt END), 0) AS BIGINT) AS b{k}" for k in range(1, 6)) + " FROM t JOIN r USING (bc) GROUP BY tx")
def dropseq_topk_pivot(spark, sf_dir):
    """A37, T6."""
    m = N.top_matrix(_transcripts(spark, sf_dir), "tx", "bc", "ucnt", 5)
    return m.select("tx", *[F.col(c).alias(f"b{i + 1}") for i, c in enumerate(c for c in m.columns if c != "tx")])


@plans.query(ctes("reads") + ", h AS (SELECT barcode, count(*) AS n FROM reads GROUP BY 1) SELECT barcode, n, row_number() OVER (ORDER BY n DESC, barcode) AS rank, round(sum(n) OVER (ORDER BY n DESC, barcode ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS share FROM h")
def barcode_knee(spark, sf_dir):
    """A11, W8."""
    h = view(spark, sf_dir, "reads").groupBy("barcode").agg(F.count("*").alias("n"))
    return O.knee(h, "barcode", "n").withColumn("share", F.round("share", 6))


BASES = "CASE {x} WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END"
SEQ = "s AS (SELECT event_id, " + " || ".join(f"substr('ACGT', CAST((user_id // {4**i}) % 4 + 1 AS INT), 1)" for i in range(5)) + " || " + " || ".join(f"substr('ACGT', CAST((event_id // {4**i}) % 4 + 1 AS INT), 1)" for i in range(6)) + " AS seq FROM events)"


def _seqs(spark, sf_dir):
    base = lambda c, i: F.substr(F.lit("ACGT"), (F.floor(F.col(c) / 4**i) % 4 + 1).cast("int"), F.lit(1))
    return table(spark, sf_dir, "events").select("event_id", F.concat(*[base("user_id", i) for i in range(5)], *[base("event_id", i) for i in range(6)]).alias("seq"))


@plans.query(f"WITH {SEQ}, l AS (SELECT *, unnest([4, 5, 6]) AS len FROM s) SELECT CAST(len AS INT) AS len, substr(seq, 1, len) AS prefix, CAST(count_if(NOT regexp_matches(substr(seq, len + 3, 8 - len), '^[TN ]*$')) AS BIGINT) AS c0, CAST(count_if(regexp_matches(substr(seq, len + 3, 8 - len), '^[TN ]*$')) AS BIGINT) AS c1 FROM l GROUP BY len, prefix")
def barcode_prefix_hist(spark, sf_dir):
    """A12, C24."""
    return N.prefix_histogram(_seqs(spark, sf_dir), "seq", range(4, 7), 2, 2)


@plans.query(f"WITH {SEQ}, l AS (SELECT *, unnest([4, 5, 6]) AS len FROM s), h AS (SELECT CAST(len AS INT) AS len, substr(seq, 1, len) AS prefix, count(*) AS n FROM l GROUP BY len, prefix) SELECT len, " + ", ".join(f"CAST(count_if(n >= {k}) AS BIGINT) AS ge_{k}" for k in (1, 10, 100)) + " FROM h GROUP BY len")
def barcode_thresholds(spark, sf_dir):
    """A14."""
    h = N.prefix_histogram(_seqs(spark, sf_dir), "seq", range(4, 7), 2, 2).withColumn("n", F.col("c0") + F.col("c1"))
    return N.threshold_counts(h, ["len"], "n", [1, 10, 100])


@plans.query(f"""WITH {SEQ}, t AS (SELECT substr(seq, 1, 4) || CASE WHEN event_id % 2 = 0 THEN substr(seq, 6, 1) || 'TTTTTT' ELSE substr(seq, 6, 6) END AS seq FROM s), l AS (SELECT *, unnest([4, 5, 6]) AS len FROM t),
h AS (SELECT CAST(len AS INT) AS len, substr(seq, 1, len) AS prefix, count(*) AS n, count_if(regexp_matches(substr(seq, len + 3, 8 - len), '^[TN ]*$')) AS c1 FROM l GROUP BY len, prefix),
c AS (SELECT len - 1 AS len, substr(prefix, 1, len - 1) AS prefix, max(n) AS largest, sum(c1) AS k1, max({{'n': n, 'child': prefix}}).child AS main FROM h GROUP BY 1, 2),
m AS (SELECT h.len, prefix, main, ((c1 + 0.5) - 0.5 * (k1 + 1)) / sqrt((k1 + 1) / 4) AS z FROM h JOIN c USING (len, prefix) WHERE c1 > 0.9 * k1 AND 0.9 * n >= largest)
SELECT a.len, a.prefix, a.main, coalesce(b.main, a.main) AS resolved, round(a.z, 6) AS z FROM m a LEFT JOIN m b ON a.main = b.prefix AND b.z > 1 WHERE a.z > 1""")
def barcode_merge(spark, sf_dir):
    """Which prefixes collapse (half of the reads have lost their last bases), and to what after following the chain."""
    seq = F.concat(F.substring("seq", 1, 4), F.when(F.col("event_id") % 2 == 0, F.concat(F.substring("seq", 6, 1), F.lit("TTTTTT"))).otherwise(F.substring("seq", 6, 6)))
    h = N.prefix_histogram(_seqs(spark, sf_dir).select("event_id", seq.alias("seq")), "seq", range(4, 7), 2, 2)
    merged = N.collapsing_prefixes(h, z=1.0)
    return merged.join(N.resolved(merged, "prefix", "main", 2).withColumnRenamed("main", "resolved"), "prefix")


@plans.query(f"""WITH {SEQ}, b AS (SELECT DISTINCT substr(seq, 1, 5) AS code FROM s WHERE event_id % 40 = 0), n AS (SELECT code AS key, code, TRUE AS exact FROM b UNION ALL SELECT substr(code, 1, CAST(i - 1 AS BIGINT)) || c || substr(code, CAST(i + 1 AS BIGINT)), code, FALSE FROM b, range(1, 6) t(i), (VALUES ('A'), ('C'), ('G'), ('T'), ('N')) u(c)),
k AS (SELECT key, bool_or(exact) AS exact FROM n GROUP BY key) SELECT event_id, CASE WHEN k.exact THEN 'exact' WHEN k.key IS NOT NULL THEN 'mismatch' ELSE 'miss' END AS match FROM s LEFT JOIN k ON substr(seq, 1, 5) = k.key""")
def hamming_demux(spark, sf_dir):
    """J22, C28."""
    s = _seqs(spark, sf_dir)
    codes = s.filter("event_id % 40 = 0").select(F.substring("seq", 1, 5).alias("code")).distinct().withColumn("bid", F.col("code"))
    return J.demultiplexed(s, "seq", codes, "code", "bid", 5).select("event_id", "match")


@plans.query("""WITH c AS (SELECT l_partkey AS gene, l_suppkey AS bcd, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT bcd FROM c GROUP BY bcd HAVING sum(n) >= 590), g AS (SELECT gene FROM c JOIN b USING (bcd) GROUP BY gene HAVING sum(n) >= 12), f AS (SELECT c.* FROM c JOIN b USING (bcd) JOIN g USING (gene))
SELECT gene, bcd, n, round(n / sum(n) OVER (PARTITION BY bcd), 6) AS norm, dense_rank() OVER (ORDER BY gene) AS row_no, dense_rank() OVER (ORDER BY bcd) AS col_no FROM f""")
def mtx_filter_norm(spark, sf_dir):
    """F12, A30, W11, C26."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("bcd")).agg(F.count("*").alias("n"))
    out = N.filter_matrix(m, "gene", "bcd", "n", 590, 12)
    return out.select("gene", "bcd", "n", "norm", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"))


HIST = "h AS (SELECT l_returnflag AS f, l_quantity AS x, count(*) AS n FROM lineitem GROUP BY 1, 2)"


def _hist(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("x")).agg(F.count("*").alias("n"))


@plans.query(f"WITH {HIST}, s AS (SELECT f, sum(n) AS w, sum(least(x, 40) * n) AS s, sum(least(x, 40) * least(x, 40) * n) AS q FROM h GROUP BY f) SELECT f, CAST(w AS BIGINT) AS weight, round(s / w, 6) AS mean, round(q / w - (s / w) * (s / w), 6) AS variance, round((q / w - (s / w) * (s / w)) / (s / w), 6) AS vmr FROM s")
def qc_hist_moments(spark, sf_dir):
    """A29, C34."""
    return A.weighted_moments(_hist(spark, sf_dir), ["f"], "x", "n", cap=40.0)


@plans.query(f"WITH {HIST} SELECT f, x, n, round(sum(n) OVER (PARTITION BY f ORDER BY x DESC ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY f), 6) AS tail FROM h")
def qc_tail_fraction(spark, sf_dir):
    """W6."""
    return O.tail_fraction(_hist(spark, sf_dir), ["f"], "x", "n").withColumn("tail", F.round("tail", 6))


@plans.query(f"WITH {HIST}, r AS (SELECT f, x, sum(n) OVER (PARTITION BY f ORDER BY x ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY f) AS t FROM h) SELECT f, coalesce(max(CASE WHEN run < 0.25 * t THEN x END), 0) AS q FROM r GROUP BY f")
def qc_quartile(spark, sf_dir):
    """W7."""
    return O.running_quantile(_hist(spark, sf_dir), ["f"], "x", "n", 0.25)


@plans.query("""WITH h AS (SELECT l_quantity AS x, round(avg(l_discount), 6) AS y, count(*) AS z FROM lineitem GROUP BY 1), r AS (SELECT x, y, z, sum(z) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) AS hi, sum(z) OVER () AS t FROM h), e AS (SELECT * FROM (VALUES (0, 0.0, 0.05), (1, 0.05, 0.5), (2, 0.5, 0.95), (3, 0.95, 1.0)) v(bin, a, b)),
p AS (SELECT bin, y, least(hi, b * t) - greatest(hi - z, a * t) AS part FROM r, e) SELECT CAST(bin AS INT) AS bin, round(sum(part * y) / sum(part), 6) AS mean FROM p WHERE part > 0 GROUP BY bin""")
def qc_quantile_bins(spark, sf_dir):
    """Bins with fractional overlap."""
    h = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.round(F.avg("l_discount"), 6).alias("y"), F.count("*").alias("z"))
    return A.quantile_bins(h, "x", "y", "z", [0.0, 0.05, 0.5, 0.95, 1.0])


@plans.query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events) SELECT user_id, event_type, min(event_id) AS start, max(event_id) AS end_id, count(*) AS n FROM e GROUP BY user_id, event_type, i""")
def event_islands(spark, sf_dir):
    """Maximal runs."""
    return O.islands(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type").withColumnRenamed("end", "end_id")


STATES = {"s0": "event_id % 2 = 0", "s1": "event_id % 3 > 0", "s2": "event_id % 5 < 3"}


@plans.query(f"""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, {", ".join(f"{q} AS {s}" for s, q in STATES.items())} FROM events), {", ".join(f"g{s} AS (SELECT user_id, k, count(*) OVER (PARTITION BY user_id, grp) AS n FROM (SELECT user_id, k, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS grp FROM e WHERE {s}))" for s in STATES)},
b AS (SELECT e.user_id, e.k, e.event_id, coalesce(gs0.n, 0) AS n0, coalesce(gs1.n, 0) AS n1, coalesce(gs2.n, 0) AS n2 FROM e {" ".join(f"LEFT JOIN g{s} ON e.user_id = g{s}.user_id AND e.k = g{s}.k" for s in STATES)}),
p AS (SELECT *, greatest(n0, n1, n2) AS run, CASE WHEN greatest(n0, n1, n2) = 0 THEN -1 WHEN n0 = greatest(n0, n1, n2) THEN 0 WHEN n1 = greatest(n0, n1, n2) THEN 1 ELSE 2 END AS state FROM b),
c AS (SELECT *, k - row_number() OVER (PARTITION BY user_id, state ORDER BY k) AS i FROM p)
SELECT user_id, CAST(state AS INT) AS state, CAST(min(k) AS INT) AS first, CAST(max(k) AS INT) AS last, min(event_id) AS start, max(event_id) AS end_id, max(run) AS longest FROM c WHERE state >= 0 GROUP BY user_id, state, i""")
def trio_longest_run(spark, sf_dir):
    """W4, C31."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", *[F.expr(q).alias(s) for s, q in STATES.items()])
    return O.longest_run_states(e, ["user_id"], "event_id", list(STATES)).withColumnRenamed("end", "end_id")


@plans.query(f"WITH {SEQ} SELECT event_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, reverse(translate(seq || 'RN', 'ACGTRYSWKMBDHVN', 'TGCAYRSWMKVHDBN')) AS rc_iupac, reverse(translate(lower(seq), 'acgt', 'tgca')) AS rc_cased, CASE WHEN seq[1] IN ('A', 'G') THEN TRUE ELSE FALSE END AS purine, substr(reverse(translate(seq, 'ACGT', 'TGCA')), 1, 4) AS trimmed, rpad(substr(seq, 1, 5), 8, 'A') AS padded, event_id || ':' || substr(seq, 1, 5) || ':' || substr(seq, 6, 3) AS tagged FROM s")
def revcomp(spark, sf_dir):
    """X1, X2, X3, X4, P10, P11, P12."""
    s, seq = _seqs(spark, sf_dir), F.col("seq")
    return s.select("event_id", S.reverse_complement(seq).alias("rc"), S.reverse_complement_iupac(F.concat(seq, F.lit("RN"))).alias("rc_iupac"), S.reverse_complement_cased(F.lower(seq)).alias("rc_cased"), S.iupac_compatible(F.lit("R"), F.substring(seq, 1, 1)).alias("purine"),
                    S.trim_reverse(seq, seq, 4)[0].alias("trimmed"), S.pad_barcode(F.substring(seq, 1, 5), 8).alias("padded"), S.split_barcode(F.col("event_id").cast("string"), seq, 5, 3).alias("tagged"))


@plans.query(f"WITH {SEQ} SELECT event_id, CASE WHEN (seq[5] = 'C' AND seq[6] = 'G') OR (seq[5] = 'G' AND seq[4] = 'C') THEN 1 ELSE 0 END AS cpg, CAST(length(seq) // 3 AS INT) AS n_codons, seq[1:3] IN ('TAA', 'TAG', 'TGA') AS first_stop FROM s")
def cpg_flag(spark, sf_dir):
    """X5, X8, X6."""
    s, seq = _seqs(spark, sf_dir), F.col("seq")
    aa = S.translate_cds(S.assemble_cds(F.array(seq), F.lit("+")))
    return s.select("event_id", S.cpg(F.substring(seq, 4, 1), F.substring(seq, 5, 1), F.substring(seq, 6, 1)).alias("cpg"), F.length(aa).alias("n_codons"), (S.amino_acid(F.substring(seq, 1, 3)) == "*").alias("first_stop"))


def _amino(bases: list[str]) -> str:
    """The letter of a codon in SQL, by the bases' places in TCAG."""
    i, j, k = (f"(strpos('TCAG', {b}) - 1)" for b in bases)
    return f"substr('{S.AMINO_ACIDS}', CAST(16 * {i} + 4 * {j} + {k} + 1 AS BIGINT), 1)"


def _kept(k: int) -> str:
    """How many bases at place k of the codon c keep its amino acid; 0 if only one does."""
    own = [f"c[{x + 1}]" for x in range(3)]
    same = f"len(list_filter(['A', 'C', 'G', 'T'], lambda b: {_amino([*own[:k], 'b', *own[k + 1 :]])} = {_amino(own)}))"
    return f"CASE WHEN {same} = 1 THEN 0 ELSE {same} END"


@plans.query(f"WITH {SEQ} SELECT event_id, array_to_string(flatten(list_transform([substr(seq, 1, 3), substr(seq, 4, 3), substr(seq, 7, 3)], lambda c: [{_kept(0)}, {_kept(1)}, {_kept(2)}])), ',') AS degeneracy FROM s")
def degeneracy(spark, sf_dir):
    """X7."""
    return _seqs(spark, sf_dir).select("event_id", F.array_join(S.degeneracies(F.col("seq")).cast("array<string>"), ",").alias("degeneracy"))


SHIFTS = f"""WITH {SEQ}, p AS (SELECT seq, i, unnest([1, 2, 3]) AS j FROM (SELECT seq, unnest(range(0, length(seq))) AS i FROM s)),
q AS (SELECT seq, i, j, coalesce(list_min(list_filter(range(0, 5), lambda k: i <= k OR seq[i - k] <> seq[i + j - k])), 5) + coalesce(list_min(list_filter(range(0, 5), lambda k: i + j + k >= length(seq) OR seq[i + j + k + 1] <> seq[i + k + 1])), 5) AS shift FROM p WHERE i + j < length(seq))"""


@plans.query(SHIFTS + " SELECT CAST(j AS INT) AS j, CAST(shift AS INT) AS shift, count(*) AS n FROM q GROUP BY j, shift")
def tandem_shift(spark, sf_dir):
    """By size."""
    return N.tandem_shifts(_seqs(spark, sf_dir), "seq", 3, 5)


@plans.query(SHIFTS + " SELECT substr(seq, i + 1, j) AS motif, CAST(shift AS INT) AS shift, count(*) AS n FROM q GROUP BY 1, 2")
def tandem_shift_alleles(spark, sf_dir):
    """By deleted motif."""
    return N.tandem_shifts(_seqs(spark, sf_dir), "seq", 3, 5, by_allele=True)


@plans.query("SELECT n_nationkey, 'chr' || (n_nationkey % 22 + 1) AS chrom, CAST(n_nationkey * 1000 + 1 AS BIGINT) AS beg, CAST(n_nationkey * 2000 AS BIGINT) AS end_pos FROM nation WHERE n_nationkey > 0")
def region_literals(spark, sf_dir):
    """X25, F5."""
    n = table(spark, sf_dir, "nation").filter("n_nationkey > 0")
    k = F.col("n_nationkey").cast("long")
    chrom, beg, end = variant.parse_region(F.concat(F.lit("chr"), (k % 22 + 1).cast("string"), F.lit(":"), F.format_number(k * 1000 + 1, 0), F.lit("-"), (k * 2000).cast("string")))
    return n.select("n_nationkey", chrom.alias("chrom"), beg.alias("beg"), end.alias("end_pos"))
