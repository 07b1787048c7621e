"""Site filters, column functions, orders and merges that the other modules don't exercise."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import genotype as G
from strandlake.functions import variant
from strandlake.operators import aggregates as A
from strandlake.operators import classify
from strandlake.operators import concordance as C
from strandlake.operators import joins as J
from strandlake.operators import ordered as O
from strandlake.plans.base import Plans
from strandlake.plans.genotypes import TRIO, _pairs, _trios
from strandlake.plans.sites import COUNTS, SITES, _counts, _ratios, _sites
from strandlake.plans.views import ctes, table, view

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql

MIXED = "CASE WHEN vline = 3 THEN alt || ',T' WHEN vline = 5 THEN alt || 'GG' ELSE alt END"


def _mixed(spark, sf_dir):
    """Variants, some with an indel or several alleles."""
    alt = F.when(F.col("vline") == 3, F.concat("alt", F.lit(",T"))).when(F.col("vline") == 5, F.concat("alt", F.lit("GG"))).otherwise(F.col("alt"))
    return view(spark, sf_dir, "variants").withColumn("alt", alt)


@plans.query(ctes("variants") + f""", m AS (SELECT vorder, vline, chrom, ref, {MIXED} AS alt, ac, an FROM variants)
SELECT vorder, vline, length(ref) = 1 AND length(alt) = 1 AS snp, NOT contains(alt, ',') AND length(alt) > 1 AS indel, TRUE AS autosome, least(ac, an - ac) / CAST(an AS DOUBLE) BETWEEN 0.05 AND 0.3 AS maf_ok, ac > 0 AND ac < an AS varied FROM m""")
def site_filters(spark, sf_dir):
    """F3, F4, F8, F13."""
    snp, indel = variant.is_snp(F.col("ref"), F.col("alt")), variant.is_indel(F.col("ref"), F.col("alt"))
    return _mixed(spark, sf_dir).select("vorder", "vline", snp.alias("snp"), indel.alias("indel"), variant.autosomal(F.col("chrom")).alias("autosome"), variant.maf_between(F.col("ac"), F.col("an"), 0.05, 0.3).alias("maf_ok"), variant.polymorphic(F.col("ac"), F.col("an")).alias("varied"))


EFFECTS = ["stop_gained", "missense_variant", "synonymous_variant", "intron_variant", "inframe_deletion"]


@plans.query(f"SELECT l_orderkey, l_linenumber, l_suppkey, e = 0 AS lof, e IN (0, 1, 4) AS nonsyn, e IN (0, 1, 2, 4) AS coding FROM (SELECT *, l_partkey % {len(EFFECTS)} AS e FROM lineitem)")
def effect_classes(spark, sf_dir):
    """X10."""
    info = F.concat(F.lit("AC=1;EFF="), F.element_at(F.array(*[F.lit(e) for e in EFFECTS]), (F.col("l_partkey") % len(EFFECTS) + 1).cast("int")), F.lit("(HIGH|x)"))
    flags = variant.effect_flags(info)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", *[flags[k].alias(k) for k in ("lof", "nonsyn", "coding")])


@plans.query("""SELECT o_orderkey, CAST(greatest(a, b) * (greatest(a, b) + 1) // 2 + least(a, b) AS INT) AS pl_index, 'x' || a || 'y,x' || b || 'y' AS ids, 'run-' || a || '-of-' || b || '.sh' AS command, CAST((a - b) * (a - b) + (o_orderkey % 7 - a) * (o_orderkey % 7 - a) AS BIGINT) AS square, strftime(o_orderdate, '%Y%m%d') AS day, printf('%.2f', a / 4.0) AS text
FROM (SELECT *, o_custkey % 5 AS a, o_orderkey % 3 AS b FROM orders)""")
def number_functions(spark, sf_dir):
    """X16, X20, X21, X22, X23, X26."""
    a, b, o = F.col("a"), F.col("b"), F.col("o_orderkey")
    say = lambda c: c.cast("string")
    rows = table(spark, sf_dir, "orders").withColumn("a", F.col("o_custkey") % 5).withColumn("b", o % 3)
    return rows.select("o_orderkey", G.pl_index(a, b).cast("int").alias("pl_index"), variant.join_affixed(F.array(say(a), say(b)), ",", "x", "y").alias("ids"), variant.substituted("run-$a$-of-${b}$.sh", {"a": say(a), "b": say(b)}).alias("command"),
                       variant.pair_squares([(a, b), (o % 7, a)]).alias("square"), F.date_format("o_orderdate", "yyyyMMdd").alias("day"), F.format_string("%.2f", a / 4).alias("text"))


@plans.query("SELECT o_orderkey, least(255, a * 10) || ',' || least(255, b * 10) || ',0' AS pls FROM (SELECT *, o_custkey % 40 AS a, o_orderkey % 9 AS b FROM orders)")
def likelihoods_as_phred(spark, sf_dir):
    """log10 likelihoods, the greatest 0."""
    gls = F.array(-(F.col("o_custkey") % 40).cast("double"), -(F.col("o_orderkey") % 9).cast("double"), F.lit(0.0))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(G.pls_from_gl(gls).cast("array<string>"), ",").alias("pls"))


@plans.query(_ratios("filter, vtype", f"SELECT filter, vtype, {COUNTS} FROM typed GROUP BY filter, vtype").replace("SELECT filter, vtype, n,", SITES + ", typed AS (SELECT *, CASE WHEN vline = 3 THEN 'multi' WHEN vline = 5 THEN 'indel' ELSE 'snp' END AS vtype FROM cells) SELECT filter, vtype, n,", 1))
def summary_by_type_ratios(spark, sf_dir):
    """A5: the ratio columns of each kind of site."""
    kind = F.when(F.col("vline") == 3, "multi").when(F.col("vline") == 5, "indel").otherwise("snp")
    return A.site_ratios(_sites(spark, sf_dir).withColumn("vtype", kind).groupBy("filter", "vtype").agg(*_counts()), ["filter", "vtype"])


@plans.query(ctes("genotypes") + f""", {TRIO}, x AS (SELECT vid, d > 0 AND m > 0 AND k > 0 AS full_, d - 1 AS d, m - 1 AS m, k - 1 AS k FROM t)
SELECT vid, full_ AND [{", ".join(map(str, C.DISCORDANT_TRIO_X))}][CASE WHEN full_ THEN 9 * d + 3 * m + k + 1 ELSE 1 END] = 1 AS disc FROM x""")
def trio_masks_x(spark, sf_dir):
    """X of a male child."""
    return _trios(spark, sf_dir).select("vid", C.masked(F.col("d"), F.col("m"), F.col("k"), x_linked=True).alias("disc"))


@plans.query(ctes("genotypes") + " SELECT a.vid, CAST(count_if(a.g > 0 AND b.g > 0 AND a.g <> b.g) AS BIGINT) AS n_disc FROM genotypes a JOIN genotypes b ON a.vid = b.vid AND b.sample = a.sample + 1 WHERE a.sample % 2 = 0 GROUP BY a.vid")
def pair_masks(spark, sf_dir):
    """Two samples of one person, by the 9-cell mask."""
    return _pairs(spark, sf_dir).groupBy("vid").agg(F.count_if(C.masked_pair(F.col("g1"), F.col("g2"))).alias("n_disc"))


@plans.query(ctes("variants") + f""", a AS (SELECT DISTINCT chrom, pos, ref, {MIXED} AS alt FROM variants WHERE vorder % 2 = 0), b AS (SELECT DISTINCT chrom, pos, ref, {MIXED} AS alt FROM variants WHERE vorder % 3 = 0) SELECT chrom, pos, ref, alt, CAST(length(ref) + length(alt) AS INT) AS size FROM a JOIN b USING (chrom, pos, ref, alt)""")
def sites_of_both(spark, sf_dir):
    """Sites of two sets on all four keys, with their total allele length."""
    m, keys = _mixed(spark, sf_dir), ["chrom", "pos", "ref", "alt"]
    a, b = m.filter("vorder % 2 = 0").select(*keys).distinct(), m.filter("vorder % 3 = 0").select(*keys).distinct()
    return a.join(b, keys).withColumn("size", F.length("ref") + F.length("alt"))


@plans.query("WITH p AS (SELECT 'chr' || (o_custkey % 5 + 1) AS chrom, o_orderkey % 5000 AS pos, min(CAST(floor(o_totalprice) AS BIGINT)) AS p FROM orders GROUP BY 1, 2) SELECT l.event_id, l.chrom, l.pos, coalesce(CAST(p.p AS VARCHAR), 'NA') AS p FROM (SELECT event_id, 'chr' || (user_id % 5 + 1) AS chrom, event_id % 7000 AS pos FROM events) l LEFT JOIN p USING (chrom, pos)")
def linkage_with_values(spark, sf_dir):
    """Rows with the value at their place, NA where there is none."""
    o = table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("chr"), (F.col("o_custkey") % 5 + 1).cast("string")).alias("chrom"), (F.col("o_orderkey") % 5000).alias("pos")).agg(F.min(F.floor("o_totalprice")).alias("p"))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("chr"), (F.col("user_id") % 5 + 1).cast("string")).alias("chrom"), (F.col("event_id") % 7000).alias("pos"))
    return J.values_at(rows, o, ["chrom", "pos"], "p")


@plans.query(ctes("variants") + " SELECT chrom, pos, vorder, vline FROM variants ORDER BY CAST(substr(chrom, 4) AS INT), pos, vorder, vline LIMIT 200")
def genomic_first(spark, sf_dir):
    """The first places of the genome (a top-k report)."""
    return O.genomic_sort(view(spark, sf_dir, "variants"), "chrom", "pos", "vorder", "vline").select("chrom", "pos", "vorder", "vline").limit(200)


@plans.query("SELECT c_custkey, c_nationkey * 7 % 25 AS rank FROM customer WHERE c_nationkey < 20")
def in_listed_order(spark, sf_dir):
    """Rows in the order of a list, with their rank in it."""
    order = table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") * 7 % 25).alias("rank"))
    return O.listed_order(table(spark, sf_dir, "customer"), order, "c_nationkey", "rank").select("c_custkey", "rank")


@plans.query("SELECT user_id, count(*) AS n FROM (SELECT * FROM events ORDER BY event_id LIMIT 5000) GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def frequent_in_first(spark, sf_dir):
    """The most frequent keys of the first reads (a sampling operator)."""
    first = O.top(table(spark, sf_dir, "events"), [F.col("event_id")], 5000)
    return O.top(first.groupBy("user_id").agg(F.count("*").alias("n")), [F.desc("n"), F.col("user_id")], 10)


@plans.query(ctes("variants") + """, r AS (SELECT vorder, vline, chrom = 'chr22' AS on_x, ac, vline % 5 - 12 AS ex, vorder % 8 - 5 AS xex, vorder % 9 = 0 AS cen, vorder % 11 AS disc FROM variants)
SELECT vorder, vline, CASE WHEN len(f) > 0 THEN array_to_string(f, ';') ELSE 'PASS' END AS filter, NOT cen AND ac >= 2 AND disc >= 3 AND disc > ac * 0.05 AS negative FROM (SELECT *, list_filter([CASE WHEN ac % 7 < 2 OR ac = 0 THEN 'SVM' END, CASE WHEN cen THEN 'CEN' END, CASE WHEN disc > 8 THEN 'DISC' END, CASE WHEN ex < -10 THEN 'EXHET' END, CASE WHEN on_x AND xex < -3 THEN 'CHRXHET' END], lambda x: x IS NOT NULL) AS f FROM r)""")
def discordance_filters(spark, sf_dir):
    """M8: negatives by discordance, and the filters of the family-based classifier."""
    v = view(spark, sf_dir, "variants")
    cen, disc, x = F.col("vorder") % 9 == 0, F.col("vorder") % 11, F.col("chrom") == "chr22"
    rules = classify.milk_rules((F.col("ac") % 7).cast("double"), F.col("ac"), cen, disc > 8, (F.col("vline") % 5 - 12).cast("double"), (F.col("vorder") % 8 - 5).cast("double"), x, 2.0)
    return v.select("vorder", "vline", rules.alias("filter"), classify.negatives_by_discordance(F.col("ac"), disc, F.col("ac"), F.lit(True), cen).alias("negative"))
