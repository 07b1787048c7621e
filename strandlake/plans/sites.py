"""Site summaries, cubes, table merges and site joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import sequence, variant
from strandlake.operators import aggregates as A
from strandlake.operators import joins as J
from strandlake.operators import ordered as O
from strandlake.plans.base import Plans
from strandlake.plans.views import ctes, table, view

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql

KNOWN = "known AS (SELECT DISTINCT concat('chr', CAST(p_partkey % 22 + 1 AS INT)) AS chrom, p_partkey * 100 + p_size AS pos FROM part)"
GOLD = "gold AS (SELECT DISTINCT concat('chr', CAST(p_size % 22 + 1 AS INT)) AS chrom, p_partkey * 100 + p_size % 7 AS pos FROM part)"
SITES = f"""{ctes("variants")}, {KNOWN}, {GOLD},
one AS (SELECT * FROM (SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY pos, vorder, vline, filter, ac) AS before FROM variants WHERE length(ref) = 1 AND length(alt) = 1) WHERE before IS NULL OR before <> pos),
sites AS (SELECT v.*, k.chrom IS NOT NULL AS is_known, g.chrom IS NOT NULL AS is_gold, v.vline % 5 = 0 AS is_cpg,
  CASE WHEN v.ref || v.alt IN ('AG','GA','CT','TC') THEN 'ts' WHEN v.ref <> v.alt THEN 'tv' END AS kind
  FROM one v LEFT JOIN known k ON v.chrom = k.chrom AND v.pos = k.pos LEFT JOIN gold g ON v.chrom = g.chrom AND v.pos = g.pos),
cells AS (SELECT *, (CASE kind WHEN 'ts' THEN 0 WHEN 'tv' THEN 1 END) + (CASE WHEN is_cpg THEN 2 ELSE 0 END) + (CASE WHEN is_known THEN 0 ELSE 4 END) AS cell FROM sites)"""
COUNTS = "count(*) AS n, CAST(count_if(is_known) AS BIGINT) AS n_known, CAST(count_if(is_gold) AS BIGINT) AS n_gold, " + ", ".join(f"CAST(count_if(cell = {i}) AS BIGINT) AS n_{c}" for i, c in enumerate(A.CELLS))


def _ratios(keys: str, source: str) -> str:
    def r(a: str, b: str, k: str = "1.0") -> str:
        return f"round(CASE WHEN ({b}) <> 0 THEN ({a}) * {k} / ({b}) END, 6)"

    return f"""SELECT {keys}, n, n_known, round(n_known * 100 / (n + 1e-10), 6) AS pct_known,
{r("n_c + n_d", "n_a + n_b + n_c + n_d", "100.0")} AS pct_cpg_known, {r("n_g + n_h", "n_e + n_f + n_g + n_h", "100.0")} AS pct_cpg_novel,
{r("n_a + n_c", "n_b + n_d")} AS tstv_known, {r("n_e + n_g", "n_f + n_h")} AS tstv_novel, {r("n_a", "n_b")} AS tstv_known_noncpg, {r("n_e", "n_f")} AS tstv_novel_noncpg,
round(n_gold * 100 / (n + 1e-6), 6) AS pct_gold FROM ({source})"""


def _sites(spark, sf_dir):
    """Single-base sites, repeated places dropped, with their known, gold, CpG and Ts/Tv marks."""
    v = view(spark, sf_dir, "variants").filter("length(ref) = 1 AND length(alt) = 1")
    v = O.drop_repeats(v, ["chrom"], ["pos", "vorder", "vline", "filter", "ac"], "pos")
    part = table(spark, sf_dir, "part")
    known = part.select(F.concat(F.lit("chr"), (F.col("p_partkey") % 22 + 1).cast("int").cast("string")).alias("chrom"), (F.col("p_partkey") * 100 + F.col("p_size")).alias("pos"))
    gold = part.select(F.concat(F.lit("chr"), (F.col("p_size") % 22 + 1).cast("int").cast("string")).alias("chrom"), (F.col("p_partkey") * 100 + F.col("p_size") % 7).alias("pos"))
    v = J.flag_listed(J.flag_listed(v, known, ["chrom", "pos"], "is_known"), gold, ["chrom", "pos"], "is_gold")
    return v.withColumn("kind", sequence.transition_class(F.col("ref"), F.col("alt"))).withColumn("is_cpg", F.col("vline") % 5 == 0)


def _counts():
    return A.site_counts(F.col("is_known"), F.col("is_cpg"), F.col("kind"), F.col("is_gold"))


@plans.query(_ratios("filter", f"SELECT filter, {COUNTS} FROM cells GROUP BY filter").replace("SELECT filter, n,", SITES + " SELECT filter, n,", 1))
def vcf_summary_by_filter(spark, sf_dir):
    """A1, A4, J8, X9, F2, F15."""
    return A.site_ratios(A.by_filter(_sites(spark, sf_dir), _counts()), ["filter"])


@plans.query(SITES + ", tok AS (SELECT unnest(list_distinct(string_split(filter, ';'))) AS token, * FROM cells) " + _ratios("token", f"SELECT token, {COUNTS} FROM tok GROUP BY token"))
def vcf_summary_exploded(spark, sf_dir):
    """A2."""
    return A.site_ratios(A.by_token(_sites(spark, sf_dir), _counts()), ["token"])


@plans.query(SITES + ", st AS (SELECT CASE WHEN filter IN ('PASS', '0') THEN 'PASS' ELSE 'FAIL' END AS s, * FROM cells) " + _ratios("status", f"SELECT coalesce(s, 'TOTAL') AS status, {COUNTS} FROM st GROUP BY ROLLUP (s)"))
def vcf_summary_rollup(spark, sf_dir):
    """A3."""
    return A.site_ratios(A.by_pass(_sites(spark, sf_dir), _counts(), variant.pass_like(F.col("filter"))), ["status"])


@plans.query(ctes("variants") + """, b AS (SELECT CASE WHEN ac < 5 THEN '(-Inf,5)' WHEN ac < 20 THEN '[5,20)' ELSE '[20,Inf)' END AS bin,
  '[' || CAST(least(ac, an - ac) // 10 * 10 AS VARCHAR) || ',' || CAST(least(ac, an - ac) // 10 * 10 + 10 AS VARCHAR) || ')' AS mac_bin FROM variants)
SELECT bin, mac_bin, count(*) AS n FROM b GROUP BY 1, 2""")
def vcf_summary_info_bins(spark, sf_dir):
    """P4, P7, P9."""
    v = view(spark, sf_dir, "variants")
    ac, an = variant.info_value(F.col("info"), "AC").cast("int"), variant.info_value(F.col("info"), "AN").cast("int")
    return v.select(variant.break_label(ac, [5, 20]).alias("bin"), variant.uniform_label(variant.minor(ac, an), 10).alias("mac_bin")).groupBy("bin", "mac_bin").agg(F.count("*").alias("n"))


@plans.query(ctes("variants") + """, b AS (SELECT CASE WHEN ac < 1 THEN 'AC=[0,1)' WHEN ac < 2 THEN 'AC=[1,2)' WHEN ac < 5 THEN 'AC=[2,5)' WHEN ac / (an + 1e-6) < 0.1 THEN '[AC=5,AF=0.1)' WHEN ac / (an + 1e-6) < 0.3 THEN 'AF=[0.1,0.3)' ELSE 'AF=[0.3,1]' END AS bin, filter LIKE '%PASS%' AS ok FROM variants)
SELECT bin, ok, count(*) AS n FROM b GROUP BY 1, 2""")
def summary_v2_mixed_breaks(spark, sf_dir):
    """P8, C3."""
    v = view(spark, sf_dir, "variants")
    return v.select(variant.mixed_label(F.col("ac"), F.col("an"), [1, 2, 5, 0.1, 0.3]).alias("bin"), variant.pass_like(F.col("filter"), exact=False).alias("ok")).groupBy("bin", "ok").agg(F.count("*").alias("n"))


@plans.query(ctes("variants") + """, t AS (SELECT CASE WHEN vline = 3 THEN 'multi' WHEN vline = 5 THEN 'indel' ELSE 'snp' END AS vtype, * FROM variants)
SELECT filter, vtype, count(*) AS n, CAST(sum(ac) AS BIGINT) AS alleles FROM t GROUP BY 1, 2""")
def summary_by_type(spark, sf_dir):
    """A5: one table for single-base, indel and multi-allelic sites."""
    v = view(spark, sf_dir, "variants").withColumn("alt", F.when(F.col("vline") == 3, F.concat("alt", F.lit(",T"))).when(F.col("vline") == 5, F.concat("alt", F.lit("GG"))).otherwise(F.col("alt")))
    kind = F.when(F.contains("alt", F.lit(",")), "multi").when((F.length("ref") != 1) | (F.length("alt") != 1), "indel").otherwise("snp")
    return v.groupBy("filter", kind.alias("vtype")).agg(F.count("*").alias("n"), F.sum("ac").alias("alleles"))


@plans.query("""WITH m AS (SELECT date_trunc('month', l_shipdate) AS mon, l_returnflag AS filter, count(*) AS n, round(count_if(l_linenumber % 3 <> 0) / count_if(l_linenumber % 3 = 0), 6) AS tstv FROM lineitem GROUP BY 1, 2 HAVING count_if(l_linenumber % 3 = 0) > 0),
s AS (SELECT filter, CAST(sum(n) AS BIGINT) AS n, sum(n * tstv / (1 + tstv)) AS ts, sum(n / (1 + tstv)) AS tv FROM m GROUP BY 1)
SELECT filter, n, round(ts, 4) AS ts, round(tv, 4) AS tv, round(CASE WHEN tv <> 0 THEN ts / tv END, 6) AS tstv FROM s""")
def summary_merge(spark, sf_dir):
    """Reports by month, merged."""
    li = table(spark, sf_dir, "lineitem")
    tv = F.count_if(F.col("l_linenumber") % 3 == 0)
    monthly = li.groupBy(F.date_trunc("month", "l_shipdate").alias("mon"), F.col("l_returnflag").alias("filter")).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("l_linenumber") % 3 != 0) / F.nullif(tv, F.lit(0)), 6).alias("tstv")).filter("tstv is not null")
    return A.merge_reports(monthly, "filter")


FLAGS = ["indel", "multi", "dbsnp", "kg", "coding", "nonsyn", "lof"]
FLAG_SQL = "CAST(l_linenumber = 5 AS INT) AS indel, CAST(l_linenumber = 3 AS INT) AS multi, CAST(l_orderkey % 3 = 0 AS INT) AS dbsnp, CAST(l_partkey % 2 AS INT) AS kg, CAST(l_suppkey % 4 < 3 AS INT) AS coding, CAST(l_suppkey % 4 < 2 AS INT) AS nonsyn, CAST(l_suppkey % 4 < 1 AS INT) AS lof"


@plans.query(f"""WITH f AS (SELECT {FLAG_SQL}, CAST(l_quantity AS BIGINT) AS het, CAST(l_quantity / 5 AS BIGINT) AS hom, CAST(l_linenumber % 3 <> 0 AS BIGINT) AS ts, CAST(l_linenumber % 3 = 0 AS BIGINT) AS tv FROM lineitem),
c AS (SELECT {", ".join(f"CASE WHEN grouping({f}) = 1 THEN 2 ELSE {f} END AS {f}" for f in FLAGS)}, CAST(sum(het) AS BIGINT) AS het, CAST(sum(hom) AS BIGINT) AS hom, CAST(sum(ts) AS BIGINT) AS ts, CAST(sum(tv) AS BIGINT) AS tv FROM f GROUP BY CUBE ({", ".join(FLAGS)}))
SELECT *, round((het + 0.5) / (hom + 1), 6) AS hethom, round((ts + 0.33) / (tv + 0.66), 6) AS tstv FROM c WHERE het + hom + ts + tv > 0""")
def isaac_cube(spark, sf_dir):
    """A7, C5."""
    li = table(spark, sf_dir, "lineitem").selectExpr(*[x.strip() for x in FLAG_SQL.split(", CAST") for x in [x if x.startswith("CAST") else "CAST" + x]], "CAST(round(l_quantity) AS BIGINT) AS het", "CAST(round(l_quantity / 5) AS BIGINT) AS hom", "CAST(l_linenumber % 3 <> 0 AS BIGINT) AS ts", "CAST(l_linenumber % 3 = 0 AS BIGINT) AS tv")
    c = A.flag_cube(li, FLAGS, ["het", "hom", "ts", "tv"])
    return c.withColumn("hethom", F.round((F.col("het") + 0.5) / (F.col("hom") + 1), 6)).withColumn("tstv", F.round((F.col("ts") + 0.33) / (F.col("tv") + 0.66), 6))


@plans.query("""SELECT a.id, a.n_cust, a.bal, b.n_supp FROM (SELECT c_nationkey AS id, count(*) AS n_cust, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS id, count(*) AS n_supp FROM supplier GROUP BY 1) b ON a.id = b.id""")
def tsv_inner_join(spark, sf_dir):
    """J1, F16, S24, T1."""
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("n_cust"), F.round(F.sum("c_acctbal"), 2).alias("bal"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").alias("n_supp"))
    return J.tsv_join([a, b], "id", check=True)


@plans.query("SELECT r_name, n_name, r_name || ':' || n_name AS combo FROM region CROSS JOIN nation")
def tsv_combine_cross(spark, sf_dir):
    """Lists of a job's settings (small by nature)."""
    return J.combine_lists([table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")], ["r_name", "n_name"], "combo", ":")


@plans.query("""WITH u AS (SELECT l_partkey AS k, 'p' || (l_partkey % 7) AS name, CAST(l_quantity AS BIGINT) AS qty, l_linenumber AS line FROM lineitem)
SELECT k, name, CAST(sum(qty) AS BIGINT) AS qty, CAST(sum(line) AS BIGINT) AS line FROM u GROUP BY k, name""")
def merge_tsv_sum(spark, sf_dir):
    """Tables by return flag, summed by key."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.concat(F.lit("p"), (F.col("l_partkey") % 7).cast("string")).alias("name"), F.round("l_quantity").cast("long").alias("qty"), F.col("l_linenumber").cast("long").alias("line"), "l_returnflag")
    return A.merge_tables([li.filter(F.col("l_returnflag") == f).drop("l_returnflag") for f in "ANR"], ["k"], ["name"], lenient=False)


@plans.query(ctes("variants") + " SELECT id, chrom, pos, ref, alt FROM variants WHERE id <> '.' AND id IN (SELECT concat('rs', o_orderkey) FROM orders WHERE o_orderkey % 5 = 0)")
def rs_semi_join(spark, sf_dir):
    """J4."""
    ids = table(spark, sf_dir, "orders").filter("o_orderkey % 5 = 0").select(F.concat(F.lit("rs"), F.col("o_orderkey").cast("string")).alias("id"))
    return J.semi_by_id(view(spark, sf_dir, "variants"), ids).select("id", "chrom", "pos", "ref", "alt")


@plans.query(ctes("variants") + ", s AS (SELECT DISTINCT chrom, pos, ref, alt FROM variants WHERE vorder % 4 = 0) SELECT v.vorder, v.vline, CASE WHEN s.pos IS NOT NULL THEN 'PASS' ELSE v.filter END AS filter FROM variants v LEFT JOIN s USING (chrom, pos, ref, alt)")
def pass_variants(spark, sf_dir):
    """J5, C10."""
    v = view(spark, sf_dir, "variants")
    return J.update_listed(v, v.filter("vorder % 4 = 0"), ["chrom", "pos", "ref", "alt"], "filter", "PASS").select("vorder", "vline", "filter")


KNOWN_IDS = """k AS (SELECT chrom, pos, ref, unnest([alt, CASE alt WHEN 'A' THEN 'C' ELSE 'A' END]) AS alt, concat('rs', vorder) AS kid, vorder * 10 + vline AS o FROM variants WHERE vorder % 2 = 0),
f AS (SELECT chrom, pos, ref, alt, min_by(kid, o) AS kid FROM k GROUP BY ALL)"""


@plans.query(ctes("variants") + f", {KNOWN_IDS} SELECT v.vorder, v.vline, coalesce(f.kid, '.') AS id FROM variants v LEFT JOIN f USING (chrom, pos, ref, alt)")
def add_rsid(spark, sf_dir):
    """J6, W12, C8."""
    v = view(spark, sf_dir, "variants")
    known = v.filter("vorder % 2 = 0").select("chrom", "pos", "ref", F.array("alt", F.when(F.col("alt") == "A", "C").otherwise("A")).alias("alts"), F.concat(F.lit("rs"), F.col("vorder").cast("string")).alias("id"), (F.col("vorder") * 10 + F.col("vline")).alias("o"))
    return J.add_ids(v, known, "o").select("vorder", "vline", "id")


@plans.query(ctes("variants") + f", {KNOWN_IDS} SELECT v.vorder, v.vline, '.' AS id, v.info || ';KNOWN=' || CASE WHEN f.kid IS NULL THEN '0' ELSE '1' END AS info FROM variants v LEFT JOIN f USING (chrom, pos, ref, alt)")
def add_known_key(spark, sf_dir):
    """J6 with a key, P6."""
    v = view(spark, sf_dir, "variants")
    known = v.filter("vorder % 2 = 0").select("chrom", "pos", "ref", F.array("alt", F.when(F.col("alt") == "A", "C").otherwise("A")).alias("alts"), "id", (F.col("vorder") * 10 + F.col("vline")).alias("o"))
    return J.add_ids(v, known, "o", info_key="KNOWN").select("vorder", "vline", "id", "info")


@plans.query(ctes("variants") + """, e AS (SELECT chrom, pos, ref, alt, list_sort(list_distinct(list('X_' || t))) AS more FROM (SELECT chrom, pos, ref, alt, unnest(string_split(filter, ';')) AS t FROM variants WHERE filter NOT IN ('PASS', '.')) GROUP BY ALL),
o AS (SELECT v.vorder, v.vline, list_concat(list_filter(string_split(v.filter, ';'), lambda t: t NOT IN ('PASS', '.')), coalesce(e.more, [])) AS ts FROM variants v LEFT JOIN e USING (chrom, pos, ref, alt))
SELECT vorder, vline, CASE WHEN len(ts) > 0 THEN array_to_string(ts, ';') ELSE 'PASS' END AS filter FROM o""")
def ext_filter_union(spark, sf_dir):
    """J7, U6, P16, C9, Z3."""
    v = view(spark, sf_dir, "variants")
    return J.external_filters(v, v, "X_").select("vorder", "vline", "filter")


@plans.query(ctes("variants") + ", w AS (SELECT DISTINCT o_orderkey AS num FROM orders WHERE o_orderkey % 7 = 0), d AS (SELECT CAST(substr(id, 3) AS BIGINT) AS num, min(chrom) AS chrom, min(pos) AS pos FROM variants WHERE id <> '.' GROUP BY 1) SELECT w.num, coalesce(d.chrom, '.') AS chrom, coalesce(CAST(d.pos AS VARCHAR), '.') AS pos FROM w LEFT JOIN d USING (num)")
def lookup_rsid(spark, sf_dir):
    """J21."""
    v = view(spark, sf_dir, "variants").filter("id <> '.'").groupBy(F.expr("substring(id, 3)").cast("long").alias("num")).agg(F.min("chrom").alias("chrom"), F.min("pos").alias("pos"))
    want = table(spark, sf_dir, "orders").filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("num")).distinct()
    return want.join(v, "num", "left").select("num", F.coalesce("chrom", F.lit(".")).alias("chrom"), F.coalesce(F.col("pos").cast("string"), F.lit(".")).alias("pos"))


@plans.query("SELECT l_orderkey, l_linenumber, p_name AS gene, CASE WHEN p_size > 25 THEN p_brand ELSE CAST(l_partkey AS VARCHAR) END AS mapped FROM lineitem JOIN part ON l_partkey = p_partkey")
def gene_conv(spark, sf_dir):
    """J19 (a miss is an error), J20 (a miss keeps its own value), P13, S33."""
    part = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").cast("string").alias("key"))
    named = J.lookup_or_default(li, part.select(F.col("p_partkey").cast("string").alias("key"), "p_name"), "key", "p_name", "gene", required=True)
    some = part.filter("p_size > 25").select(F.col("p_partkey").cast("string").alias("key"), "p_brand")
    return J.lookup_or_default(named, some, "key", "p_brand", "mapped").drop("key")


@plans.query(ctes("variants") + """, h AS (SELECT ac, count(*) AS n FROM variants WHERE ac > 0 GROUP BY ac), t AS (SELECT CAST(sum(n) AS DOUBLE) AS total, max(ac) AS mx FROM h), s AS (SELECT sum(1.0 / i) AS hs FROM t, unnest(range(1, mx + 1)) u(i))
SELECT ac, n, round(n / total, 6) AS fraction, round(1.0 / ac / hs, 6) AS expected FROM h, t, s""")
def afs_neutral(spark, sf_dir):
    """A21, C19."""
    return A.spectrum(view(spark, sf_dir, "variants"), "ac")


@plans.query(ctes("variants") + " SELECT vorder, vline, ac > 25 AS over_25, FALSE AS has_db, contains(filter, 'SVM') AS svm, contains(info, 'AN=') AS has_an FROM variants")
def info_predicates(spark, sf_dir):
    """F7, O12."""
    v, i = view(spark, sf_dir, "variants"), F.col("info")
    return v.select("vorder", "vline", variant.info_predicate(i, "AC>25").alias("over_25"), variant.info_predicate(i, "DB").alias("has_db"), variant.info_predicate(i, "FILTER~SVM", F.col("filter")).alias("svm"), variant.info_predicate(i, "AN").alias("has_an"))


@plans.query(ctes("variants") + """ SELECT vorder, vline, CAST(ac AS DOUBLE) AS ac_feature, 7.0 AS missing, 'AC=' || CAST(ac AS VARCHAR) AS dropped, info || ';DB=1' AS more, pos - 1 AS beg, pos + length(ref) - 1 AS end_pos, substr(chrom, 4) AS plain, CAST(substr(chrom, 4) AS INT) AS ordinal, substr(chrom, 4) || '.' || lpad(CAST(pos AS VARCHAR), 9, '0') AS fpos, CASE WHEN ac > 0 THEN CAST(trunc(log10(ac) * 10 + 1e-12) AS INT) END AS logbin FROM variants""")
def site_columns(spark, sf_dir):
    """P5, P6, P14, P15, X14, X18, X19."""
    v, i = view(spark, sf_dir, "variants"), F.col("info")
    beg, end = variant.bed_interval(F.col("pos"), F.col("ref"))
    return v.select("vorder", "vline", variant.feature(i, "AC").alias("ac_feature"), variant.feature(i, "DP", 7.0).alias("missing"), variant.info_drop(i, "AN").alias("dropped"), variant.info_append(i, "DB", F.lit(1)).alias("more"), beg.alias("beg"), end.alias("end_pos"),
                    variant.plain_chrom(F.col("chrom")).alias("plain"), variant.chrom_ordinal(F.col("chrom")).alias("ordinal"), variant.fpos(variant.chrom_ordinal(F.col("chrom")), F.col("pos")).alias("fpos"), variant.log_bin(F.col("ac")).alias("logbin"))


@plans.query(ctes("variants") + """, m AS (SELECT DISTINCT chrom || '_' || pos || '_' || ref || '_' || alt AS key, concat('chr', CAST(substr(chrom, 4) AS INT) % 22 + 1) AS c, pos + 5000 AS b FROM variants WHERE pos % 3 <> 0)
SELECT c AS chrom, b + 1 AS pos, id, ref, alt, filter, info || ';OLD_VARIANT=' || key AS info FROM (SELECT *, chrom || '_' || pos || '_' || ref || '_' || alt AS key FROM variants) v JOIN m USING (key)""")
def liftover(spark, sf_dir):
    """J26, C38."""
    v = view(spark, sf_dir, "variants")
    key = F.concat_ws("_", "chrom", F.col("pos").cast("string"), "ref", "alt")
    mapped = v.filter("pos % 3 <> 0").select(key.alias("key"), F.concat(F.lit("chr"), (variant.chrom_ordinal(F.col("chrom")) % 22 + 1).cast("string")).alias("chrom"), (F.col("pos") + 5000).alias("beg")).distinct()
    return J.lifted(v, mapped)


@plans.query(ctes("variants") + """ SELECT s, count(*) AS n FROM (SELECT CASE WHEN p AND NOT q THEN 1 WHEN q AND NOT p THEN -1 END AS s FROM (SELECT chrom, pos, ref, alt, bool_or(vorder % 2 = 0) AS p, bool_or(vorder % 3 = 0) AS q FROM variants WHERE vorder % 2 = 0 OR vorder % 3 = 0 GROUP BY ALL)) WHERE s IS NOT NULL GROUP BY s""")
def label_conflicts(spark, sf_dir):
    """U5."""
    v = view(spark, sf_dir, "variants")
    return A.conflict_free_labels(v.filter("vorder % 2 = 0"), v.filter("vorder % 3 = 0"), ["chrom", "pos", "ref", "alt"]).groupBy(F.col("label").cast("int").alias("s")).agg(F.count("*").alias("n"))


@plans.query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey % 10 <> 0 AND c_nationkey < 12")
def reconcile_ids(spark, sf_dir):
    """J25, U3, U4, F14, S34."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return J.reconciled(c, o, "c_custkey", c.filter("c_custkey % 10 = 0"), c.filter("c_nationkey < 12"))


@plans.query("SELECT DISTINCT id FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT o_custkey FROM orders)")
def union_ids(spark, sf_dir):
    """U1, U2."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).union(table(spark, sf_dir, "orders").select("o_custkey")).distinct()


@plans.query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS labels FROM orders GROUP BY 1")
def distinct_labels(spark, sf_dir):
    """A35."""
    return A.labels_of(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority")


@plans.query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def last_write_wins(spark, sf_dir):
    """W13."""
    return O.first_per(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@plans.query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS row_no FROM orders")
def dense_numbers(spark, sf_dir):
    """A global row number by range partitions."""
    return O.with_row_number(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"])


@plans.query("SELECT a.o_orderkey, b.l_orderkey AS other FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) a JOIN (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) b USING (r)")
def positional_zip(spark, sf_dir):
    """J23, P19."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("other"), "l_linenumber")
    return J.zipped(o, li, ["o_orderkey"], ["other", "l_linenumber"]).drop("l_linenumber")


@plans.query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def top_keys(spark, sf_dir):
    """T2, T6, T8, T9."""
    return O.top(table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")), [F.desc("n"), F.col("l_partkey")], 20)


@plans.query(ctes("variants") + ", p AS (SELECT CAST(trunc(log10(ac) * 10 + 1e-12) AS INT) AS b, count(*) AS np FROM variants WHERE ac > 0 AND filter = 'PASS' GROUP BY 1), q AS (SELECT CAST(trunc(log10(ac) * 10 + 1e-12) AS INT) AS b, count(*) AS nn FROM variants WHERE ac > 0 AND filter <> 'PASS' GROUP BY 1) SELECT b, np, nn, round(least(1.0, np / nn), 6) AS chance FROM p JOIN q USING (b)")
def ac_match_chances(spark, sf_dir):
    """What each bin's negatives are kept with (the draw is ``matched_sample``)."""
    v = view(spark, sf_dir, "variants").filter("ac > 0").withColumn("b", variant.log_bin(F.col("ac")))
    s = v.groupBy("b").agg(F.count_if(F.col("filter") == "PASS").alias("np"), F.count_if(F.col("filter") != "PASS").alias("nn")).filter("np > 0 AND nn > 0")
    return s.withColumn("chance", F.round(F.least(F.lit(1.0), F.col("np") / F.col("nn")), 6))


@plans.query(ctes("variants") + """, v AS (SELECT vorder, vline, filter, CAST(trunc(log10(ac) * 10 + 1e-12) AS INT) AS b FROM variants WHERE ac > 0), p AS (SELECT b, count(*) AS np FROM v WHERE filter = 'PASS' GROUP BY 1), q AS (SELECT b, count(*) AS nn FROM v WHERE filter <> 'PASS' GROUP BY 1)
SELECT vorder, vline, b FROM v JOIN p USING (b) JOIN q USING (b) WHERE filter <> 'PASS' AND (vorder * 7919 + vline * 104729) % 1000003 / 1000003.0 < CAST(np AS DOUBLE) / nn""")
def ac_matched_negatives(spark, sf_dir):
    """The sample itself."""
    draw = (F.col("vorder") * 7919 + F.col("vline") * 104729) % 1000003 / 1000003
    v = view(spark, sf_dir, "variants").filter("ac > 0").withColumn("b", variant.log_bin(F.col("ac")))
    return A.matched_sample(v.filter("filter = 'PASS'"), v.filter("filter <> 'PASS'"), "b", ["vorder", "vline"], draw=draw).select("vorder", "vline", "b")


@plans.query("SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey * 7919 % 31, n_nationkey) AS place FROM nation")
def shuffled_tasks(spark, sf_dir):
    """T11."""
    return O.shuffled(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], 11, draw=F.col("n_nationkey") * 7919 % 31)
