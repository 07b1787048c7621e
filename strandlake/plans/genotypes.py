"""Genotype comparison, likelihoods, pedigrees and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import genotype as G
from strandlake.operators import classify, concordance as C, joins as J, likelihood as L, pedigree as P
from strandlake.plans.base import Plans
from strandlake.plans.views import ctes, table, view
from strandlake.storage import spread

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql

PAIR = "p AS (SELECT a.vid, a.sample AS s1, b.sample AS s2, a.g AS g1, b.g AS g2 FROM genotypes a JOIN genotypes b ON a.vid = b.vid AND b.sample = a.sample + 1 WHERE a.sample % 2 = 0)"
CELL_SQL = ", ".join(f"CAST(count_if(g1 = {i} AND g2 = {j}) AS BIGINT) AS c{i}{j}" for i in range(4) for j in range(4))
TRIO = "t AS (SELECT d.vid, d.g AS d, m.g AS m, k.g AS k FROM genotypes d JOIN genotypes m ON d.vid = m.vid JOIN genotypes k ON d.vid = k.vid WHERE d.sample = 0 AND m.sample = 1 AND k.sample = 2)"


def _pairs(spark, sf_dir):
    """Both genotypes of each pair of samples. One shuffle by variant serves the join and what follows by variant:
    the samples are matched beside the key, as the join would shuffle by them otherwise."""
    g, rows = view(spark, sf_dir, "genotypes"), table(spark, sf_dir, "orders").count() * 4
    a = g.filter("sample % 2 = 0").select("vid", F.col("sample").alias("s1"), F.col("g").alias("g1"))
    b = g.filter("sample % 2 = 1").select("vid", F.col("sample").alias("s2"), F.col("g").alias("g2"))
    a, b = spread(a, rows, "vid"), spread(b, rows, "vid")
    return a.join(b, (a["vid"] == b["vid"]) & (b["s2"] - a["s1"] == 1)).drop(b["vid"]).select("vid", "s1", "g1", "s2", "g2")


def _trios(spark, sf_dir):
    """Each variant's dad (sample 0), mom (1) and kid (2), in one pass."""
    g = view(spark, sf_dir, "genotypes").filter("sample < 3")
    at = lambda k: F.max(F.when(F.col("sample") == k, F.col("g")))
    return g.groupBy("vid").agg(at(0).alias("d"), at(1).alias("m"), at(2).alias("k"))


@plans.query(ctes("genotypes") + f", {PAIR} SELECT vid, {CELL_SQL} FROM p GROUP BY vid")
def geno_confusion_snp(spark, sf_dir):
    """A15, J10, J11."""
    return C.confusion(_pairs(spark, sf_dir), ["vid"])


@plans.query(ctes("genotypes") + f", {PAIR} SELECT s1, s2, {CELL_SQL} FROM p GROUP BY s1, s2")
def geno_confusion_ind(spark, sf_dir):
    """A15."""
    return C.confusion(_pairs(spark, sf_dir), ["s1", "s2"])


@plans.query(ctes("genotypes") + f""", {PAIR}, f AS (SELECT vid, count_if(g1 = g2 AND g1 IN (1, 3)) < count_if((g1 = 1 AND g2 = 3) OR (g1 = 3 AND g2 = 1)) AS flip FROM p GROUP BY vid),
q AS (SELECT p.vid, g1, CASE WHEN flip AND g2 IN (1, 3) THEN 4 - g2 ELSE g2 END AS g2 FROM p JOIN f USING (vid)), c AS (SELECT vid, {CELL_SQL} FROM q GROUP BY vid),
v AS (SELECT *, c21 + c22 + c23 + 2 * (c31 + c32 + c33) AS ac, c11 + c12 + c13 + c21 + c22 + c23 + c31 + c32 + c33 AS an FROM c)
SELECT ac // 2 * 2 AS ac_bin, count(*) AS n_snps, CAST(sum(an) AS BIGINT) AS n_all, CAST(sum(c11 + c22 + c33) AS BIGINT) AS n_same, CAST(sum(c22 + c33) AS BIGINT) AS n_same_nref, CAST(sum(an - c11) AS BIGINT) AS n_nref,
round(sum(c11 + c22 + c33) / sum(an), 6) AS overall, round(CASE WHEN sum(an - c11) > 0 THEN sum(c22 + c33) / sum(an - c11) END, 6) AS nref FROM v WHERE an > 0 GROUP BY 1""")
def geno_concordance_ac(spark, sf_dir):
    """A15 with strand flip, A16, C15."""
    return C.concordance_by_count(C.confusion(C.flipped(_pairs(spark, sf_dir), "vid"), ["vid"]), 2)


VERDICT = """CASE WHEN d = 0 OR m = 0 OR k = 0 THEN 'miss' WHEN d = 1 AND m = 1 THEN CASE WHEN k = 1 THEN 'conc' ELSE 'disc' END WHEN (d = 1 AND m = 2) OR (d = 2 AND m = 1) THEN CASE WHEN k = 3 THEN 'disc' ELSE 'free' END
WHEN (d = 1 AND m = 3) OR (d = 3 AND m = 1) THEN CASE WHEN k = 2 THEN 'conc' ELSE 'disc' END WHEN d = 2 AND m = 2 THEN 'free' WHEN (d = 2 AND m = 3) OR (d = 3 AND m = 2) THEN CASE WHEN k = 1 THEN 'disc' ELSE 'free' END ELSE CASE WHEN k = 3 THEN 'conc' ELSE 'disc' END END"""


@plans.query(ctes("genotypes") + f""", {TRIO}, v AS (SELECT *, vid % 10 AS grp, {VERDICT} AS verdict FROM t),
s AS (SELECT grp, CAST(count_if(verdict = 'conc') AS BIGINT) AS n_conc, CAST(count_if(verdict = 'disc') AS BIGINT) AS n_disc, CAST(count_if(verdict = 'miss') AS BIGINT) AS n_miss, CAST(count_if(d = 1 AND m = 1 AND k = 1) AS BIGINT) AS all_ref, CAST(count_if(d = 3 AND m = 3 AND k = 3) AS BIGINT) AS all_alt FROM v GROUP BY grp)
SELECT *, round((n_disc + 5e-11) / (n_conc + n_disc - all_ref - all_alt + 1e-10), 6) AS het_disc FROM s""")
def mendel_trio_disc(spark, sf_dir):
    """A17, C16."""
    return C.trio_summary(_trios(spark, sf_dir).withColumn("grp", F.col("vid") % 10), ["grp"])


@plans.query(ctes("genotypes") + f""", {PAIR}, s AS (SELECT s1, s2, count(*) AS n, CAST(count_if(g1 > 0 AND g2 > 0 AND g1 <> g2) AS BIGINT) AS n_disc, CAST(count_if(g1 = 0 OR g2 = 0) AS BIGINT) AS n_miss, CAST(count_if(g1 = g2 AND g1 IN (1, 3)) AS BIGINT) AS n_hom_same FROM p GROUP BY s1, s2)
SELECT *, round((n_disc + 5e-11) / (n - n_miss - n_hom_same + 1e-10), 6) AS het_disc FROM s""")
def dup_disc(spark, sf_dir):
    """A18."""
    return C.pair_summary(_pairs(spark, sf_dir), ["s1", "s2"])


@plans.query(ctes("genotypes") + f""", {TRIO}, x AS (SELECT vid, d > 0 AND m > 0 AND k > 0 AND {VERDICT} = 'disc' AS disc FROM t) SELECT vid, disc FROM x""")
def trio_masks(spark, sf_dir):
    """The 27-cell mask agrees with the possible genotypes of a kid."""
    return _trios(spark, sf_dir).select("vid", C.masked(F.col("d"), F.col("m"), F.col("k")).alias("disc"))


@plans.query("SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_and(o_totalprice > 5000)")
def family_all_pass(spark, sf_dir):
    """A20."""
    return C.families_passing(table(spark, sf_dir, "orders").withColumn("ok", F.col("o_totalprice") > 5000), "o_custkey", "ok")


@plans.query(ctes("genotypes") + """, a AS (SELECT vid, avg((g - 1) / 2.0) AS af FROM genotypes WHERE g > 0 GROUP BY vid), q AS (SELECT x.sample AS sample_1, y.sample AS sample_2, a.af, pow(10, -x.pl0 / 10.0) AS a0, pow(10, -x.pl1 / 10.0) AS a1, pow(10, -x.pl2 / 10.0) AS a2, pow(10, -y.pl0 / 10.0) AS b0, pow(10, -y.pl1 / 10.0) AS b1, pow(10, -y.pl2 / 10.0) AS b2
FROM genotypes x JOIN genotypes y ON x.vid = y.vid JOIN a ON a.vid = x.vid WHERE x.sample < 4 AND y.sample >= 4 AND af > 0 AND af < 1)
SELECT sample_1, sample_2, round(sum(ln((1-af)*(1-af)*a0*b0 + 2*af*(1-af)*a1*b1 + af*af*a2*b2) - ln(((1-af)*(1-af)*a0 + 2*af*(1-af)*a1 + af*af*a2) * ((1-af)*(1-af)*b0 + 2*af*(1-af)*b1 + af*af*b2))), 3) AS llr, count(*) AS n FROM q GROUP BY 1, 2""")
def sample_match_matrix(spark, sf_dir):
    """A23, J12, M6, C12."""
    g = view(spark, sf_dir, "genotypes")
    af = g.filter("g > 0").groupBy("vid").agg(F.avg((F.col("g") - 1) / 2).alias("af"))
    rows = J.pairs_within(g.filter("sample < 4").drop("g"), g.filter("sample >= 4").drop("g"), ["vid"]).join(af, "vid")
    return C.sample_likelihoods(rows, ["sample_1", "sample_2"]).withColumn("llr", F.round("llr", 3))


RARE = "c AS (SELECT vid, sample FROM genotypes WHERE g IN (2, 3) AND pl0 < 30), r AS (SELECT vid FROM c GROUP BY vid HAVING count(*) <= 3)"


@plans.query(ctes("genotypes") + f", {RARE}, o AS (SELECT c.* FROM c JOIN r USING (vid)) SELECT a.sample AS sample1, b.sample AS sample2, count(*) AS n_shared FROM o a JOIN o b ON a.vid = b.vid AND a.sample < b.sample GROUP BY 1, 2")
def f2_sharing(spark, sf_dir):
    """J13, A22, C18."""
    c = view(spark, sf_dir, "genotypes").filter("g IN (2, 3) AND pl0 < 30").select("vid", "sample")
    rare = c.groupBy("vid").agg(F.count("*").alias("n")).filter("n <= 3").select("vid")
    return J.carrier_pairs(c.join(rare, "vid"), "vid", "sample").groupBy("sample1", "sample2").agg(F.count("*").alias("n_shared"))


@plans.query(ctes("genotypes") + f", {RARE}, o AS (SELECT vid, min(sample) AS sample FROM c GROUP BY vid HAVING count(*) = 1) SELECT sample, count(*) AS n_singletons FROM o GROUP BY 1")
def singletons(spark, sf_dir):
    """A22."""
    return C.singletons(view(spark, sf_dir, "genotypes").filter("g IN (2, 3) AND pl0 < 30"), "vid", "sample")


@plans.query(ctes("genotypes") + """, u AS (SELECT vid, sample, pl0, pl1, pl2 FROM genotypes WHERE vid % 2 = 0 UNION ALL SELECT vid, sample, pl1, pl2, pl0 FROM genotypes WHERE vid % 3 = 0), s AS (SELECT vid, sample, count(*) AS n_sets, sum(pl0) AS a, sum(pl1) AS b, sum(pl2) AS c FROM u GROUP BY 1, 2)
SELECT vid, sample, n_sets, CAST(least(a - least(a, b, c), 60) AS INT) AS pl0, CAST(least(b - least(a, b, c), 60) AS INT) AS pl1, CAST(least(c - least(a, b, c), 60) AS INT) AS pl2 FROM s""")
def combine_gls_full_outer(spark, sf_dir):
    """J9, A25, X12, C11."""
    g = view(spark, sf_dir, "genotypes").drop("g")
    other = g.filter("vid % 3 = 0").select("vid", "sample", F.col("pl1").alias("pl0"), F.col("pl2").alias("pl1"), F.col("pl0").alias("pl2"))
    return J.combine_likelihoods(g.filter("vid % 2 = 0").unionByName(other), ["vid", "sample"])


@plans.query(ctes("genotypes") + """, h AS (SELECT o.vid % 50 AS site, o.vid % 7 AS other, CAST(o.g >= 2 AS INT) AS h1, CAST(o.pl0 > 30 AS INT) AS h2 FROM genotypes o),
c AS (SELECT site, other, CAST(count_if(h1=0 AND h2=0) AS BIGINT) AS n00, CAST(count_if(h1=0 AND h2=1) AS BIGINT) AS n01, CAST(count_if(h1=1 AND h2=0) AS BIGINT) AS n10, CAST(count_if(h1=1 AND h2=1) AS BIGINT) AS n11 FROM h GROUP BY 1, 2),
r AS (SELECT *, round((CAST(n11 AS DOUBLE)*n00 - CAST(n10 AS DOUBLE)*n01) ** 2 / (CAST(n00+n01 AS DOUBLE)*(n10+n11)*(n00+n10)*(n01+n11) + 1e-6), 4) AS r2 FROM c)
SELECT other, min(CASE WHEN r2 > 0.005 THEN site END) AS from_pos, max(CASE WHEN r2 > 0.005 THEN site END) AS to_pos, CAST(count_if(r2 > 0.005) AS BIGINT) AS n_inside FROM r GROUP BY other""")
def ld_r2(spark, sf_dir):
    """A26, A27, C22."""
    h = view(spark, sf_dir, "genotypes").select((F.col("vid") % 50).alias("site"), (F.col("vid") % 7).alias("other"), (F.col("g") >= 2).cast("int").alias("h1"), (F.col("pl0") > 30).cast("int").alias("h2"))
    return C.boundaries(C.linkage(h, ["site", "other"]), ["other"], "site", 0.005)


def _em(rounds: int) -> str:
    """Unrolled EM in SQL: each round is one more pair of CTEs."""
    sql = ctes("genotypes") + """, l AS (SELECT vid, sample, pow(10, -pl0 / 10.0) AS a, pow(10, -pl1 / 10.0) AS b, pow(10, -pl2 / 10.0) AS c, pl0, pl1, pl2 FROM genotypes),
e0 AS (SELECT vid, (count_if(pl1 = 0) + 2 * count_if(pl2 = 0)) / nullif(count_if(pl0 = 0) + count_if(pl1 = 0) + count_if(pl2 = 0), 0) / 2 AS af FROM l GROUP BY vid)"""
    for i in range(1, rounds + 1):
        sql += f", e{i} AS (SELECT vid, (sum((2*af*(1-af)*b + 2*af*af*c + 1e-30) / ((1-af)*(1-af)*a + 2*af*(1-af)*b + af*af*c + 1e-30)) + 1e-6) / (2 * count(*) + 2e-6) AS af FROM l JOIN e{i - 1} USING (vid) GROUP BY vid)"
    return sql


def _until() -> str:
    """EM to its stop rule in SQL: a fold over 100 rounds that keeps a state that is done."""
    free = [f"(t.l{i} * s.g{i} + 1e-30) / (t.l0 * s.g0 + t.l1 * s.g1 + t.l2 * s.g2 + 3e-30)" for i in range(3)]
    part = lambda x: f"list_sum(list_transform(ls, lambda t: {x}))"
    af = part("(2*s.af*(1-s.af)*t.l1 + 2*s.af*s.af*t.l2 + 1e-30) / ((1-s.af)*(1-s.af)*t.l0 + 2*s.af*(1-s.af)*t.l1 + s.af*s.af*t.l2 + 1e-30)")
    new = f"{{'af': ({af} + 1e-6) / (2 * len(ls) + 2e-6), " + ", ".join(f"'g{i}': ({part(x)} + 1e-10) / (len(ls) + 3e-10)" for i, x in enumerate(free)) + "}"
    moved = " + ".join(f"(s.{k} - z.{k}) * (s.{k} - z.{k})" for k in ("af", "g1", "g2"))
    step = f"list_transform([{new}], lambda z: {{'af': z.af, 'g0': z.g0, 'g1': z.g1, 'g2': z.g2, 'rounds': s.rounds + 1, 'done': coalesce({moved} <= 1e-4, TRUE)}})[1]"
    zero = "{'af': CAST(NULL AS DOUBLE), 'g0': CAST(NULL AS DOUBLE), 'g1': CAST(NULL AS DOUBLE), 'g2': CAST(NULL AS DOUBLE), 'rounds': 0, 'done': FALSE}"
    start = "{'af': CAST(af AS DOUBLE), 'g0': CAST((1-af)*(1-af) AS DOUBLE), 'g1': CAST(2*af*(1-af) AS DOUBLE), 'g2': CAST(af*af AS DOUBLE), 'rounds': 0, 'done': FALSE}"
    return ctes("genotypes") + f""", v AS (SELECT vid, list({{'l0': pow(10, -pl0 / 10.0), 'l1': pow(10, -pl1 / 10.0), 'l2': pow(10, -pl2 / 10.0)}} ORDER BY sample) AS ls, (count_if(pl1 = 0) + 2 * count_if(pl2 = 0)) / nullif(count_if(pl0 = 0) + count_if(pl1 = 0) + count_if(pl2 = 0), 0) / 2 AS af FROM genotypes GROUP BY vid),
u AS (SELECT vid, ls, list_reduce(list_concat([{start}], list_transform(range(100), lambda i: {zero})), lambda s, x: CASE WHEN s.done THEN s ELSE {step} END) AS e FROM v)"""


@plans.query(_until() + " SELECT vid, round(e.af, 6) AS af, CAST(e.rounds AS INT) AS rounds, round(e.g1, 6) AS g1 FROM u")
def em_af(spark, sf_dir):
    """M1: to its stop rule."""
    v = L.by_variant(view(spark, sf_dir, "genotypes"), ["vid"], "sample")
    e = v.select("vid", L.em_until(F.col("ls"), L.start_af(F.col("ls"))).alias("e"))
    return e.select("vid", F.round("e.af", 6).alias("af"), "e.rounds", F.round("e.g1", 6).alias("g1"))


@plans.query(_em(10) + """, p AS (SELECT vid, sample, (1-af)*(1-af)*a AS a, 2*af*(1-af)*b AS b, af*af*c AS c FROM l JOIN e10 USING (vid) WHERE af IS NOT NULL)
SELECT vid, sample, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS gt, round(greatest(a, b, c) / (a + b + c), 6) AS gp FROM p""")
def em_genotypes(spark, sf_dir):
    """M3: 10 rounds, GP and GT."""
    g = view(spark, sf_dir, "genotypes")
    v = L.by_variant(g, ["vid"], "sample").withColumn("af", L.em_af(F.col("ls"), L.start_af(F.col("ls")), 10)).filter("af is not null")
    c = L.called(F.col("x"), F.col("af"))
    return v.select("vid", "af", F.explode("ls").alias("x")).select("vid", F.col("x.sample").alias("sample"), c["gt"].alias("gt"), F.round(c["gp"], 6).alias("gp"))


def _free(g: list[str]) -> str:
    return "list_sum(list_transform(ls, lambda t: ln(" + " + ".join(f"t.l{i} * {x}" for i, x in enumerate(g)) + " + 3e-30)))"


@plans.query(_until() + f""", a AS (SELECT vid, ls, e.af AS af, e.g0 AS g0, e.g1 AS g1, e.g2 AS g2, (1-e.af)*(1-e.af) AS h0, 2*e.af*(1-e.af) AS h1, e.af*e.af AS h2 FROM u)
SELECT vid, round(af, 6) AS af, round(2 * ({_free(["g0", "g1", "g2"])} - {_free(["h0", "h1", "h2"])}), 4) AS lrt, round(1 - list_sum(list_transform(ls, lambda t: (t.l1*h1 + 1e-30) / (t.l0*h0 + t.l1*h1 + t.l2*h2 + 3e-30))) / (h1 * len(ls)), 4) AS fic, round(g0, 6) AS gf0, round(g1, 6) AS gf1, round(g2, 6) AS gf2 FROM a""")
def hwe_test(spark, sf_dir):
    """M2, C13."""
    g = view(spark, sf_dir, "genotypes")
    return L.hardy_weinberg(L.by_variant(g, ["vid"], "sample"), ["vid"])


_T = G.TRANSMISSION
_LR = " + ".join(f"g{d}*g{m}*d{d}*m{m}*(k0*{_T[3 * d + m][0]} + k1*{_T[3 * d + m][1]} + k2*{_T[3 * d + m][2]})*(x0*{_T[3 * d + m][0]} + x1*{_T[3 * d + m][1]} + x2*{_T[3 * d + m][2]})" for d in range(3) for m in range(3))


@plans.query(ctes("genotypes") + f""", w AS (SELECT vid, {", ".join(f"max(CASE WHEN sample = {s} THEN pow(10, -pl{i} / 10.0) END) AS {n}{i}" for s, n in enumerate("dmkx") for i in range(3))}, 0.64 AS g0, 0.32 AS g1, 0.04 AS g2 FROM genotypes WHERE sample < 4 GROUP BY vid),
b AS (SELECT vid, {" + ".join(f"(-10 * log10(g0*{n}0 + g1*{n}1 + g2*{n}2 + 1e-100))" for n in "dmkx")} AS lu, -10 * log10({_LR} + 1e-100) AS lr FROM w) SELECT vid, round(lu, 4) AS lu, round(lr, 4) AS lr, round(lu - lr, 4) AS bf FROM b""")
def family_bf(spark, sf_dir):
    """M4, M5, C14: two kids, allele frequency 0.2."""
    g = view(spark, sf_dir, "genotypes").filter("sample < 4")
    v = L.by_variant(g, ["vid"], "sample").select("vid", F.col("ls")[0].alias("dad"), F.col("ls")[1].alias("mom"), F.slice("ls", 3, 2).alias("kids"))
    return L.family_factor(v, ["vid"], F.lit(0.2))


@plans.query(ctes("pairs") + """, e AS (SELECT DISTINCT id1, id2 FROM pairs WHERE kin_milli > 900), s AS (SELECT id1 AS u, id2 AS v FROM e UNION SELECT id2, id1 FROM e)
SELECT n.id, least(n.id, coalesce(min(r.root), n.id)) AS rep FROM (SELECT DISTINCT id1 AS id FROM pairs UNION SELECT DISTINCT id2 FROM pairs) n LEFT JOIN (WITH RECURSIVE w AS (SELECT u AS node, u AS root FROM s UNION SELECT s.v, w.root FROM w JOIN s ON s.u = w.node) SELECT * FROM w) r ON r.node = n.id GROUP BY n.id""")
def infer_ped_dups(spark, sf_dir):
    """Sets of samples of one person are connected components."""
    p = view(spark, sf_dir, "pairs").select("id1", "id2", F.when(F.col("kin_milli") > 900, "DUP").otherwise("ETC").alias("rel"))
    return P.duplicate_sets(p)


FAMILIES = """, r AS (SELECT DISTINCT id1, id2, CASE WHEN kin_milli / 1000.0 > 0.98 THEN 'DUP' WHEN kin_milli / 1000.0 > 0.6 AND ibs0_permille / 1000.0 < 0.0035 THEN 'PO' WHEN kin_milli / 1000.0 > 0.6 THEN 'FS' ELSE 'ETC' END AS rel FROM pairs),
e AS (SELECT * FROM r WHERE rel <> 'ETC'), s AS (SELECT id1 AS u, id2 AS v FROM e WHERE rel = 'DUP' UNION SELECT id2, id1 FROM e WHERE rel = 'DUP'),
w AS (SELECT * FROM (WITH RECURSIVE w AS (SELECT u AS node, u AS root FROM s UNION SELECT s.v, w.root FROM w JOIN s ON s.u = w.node) SELECT * FROM w)),
reps AS (SELECT n.id, least(n.id, coalesce(min(w.root), n.id)) AS rep FROM (SELECT id1 AS id FROM e UNION SELECT id2 FROM e) n LEFT JOIN w ON w.node = n.id GROUP BY n.id),
o AS (SELECT DISTINCT a.rep AS id1, b.rep AS id2, rel FROM e JOIN reps a ON a.id = e.id1 JOIN reps b ON b.id = e.id2 WHERE a.rep <> b.rep),
near AS (SELECT id1 AS kid, id2 AS p FROM o WHERE rel = 'PO' UNION SELECT id2, id1 FROM o WHERE rel = 'PO'),
two AS (SELECT kid, min(p) AS a, max(p) AS b FROM near GROUP BY kid HAVING count(*) = 2),
sexed AS (SELECT kid, a, b, x.c_custkey % 2 + 1 AS sa, y.c_custkey % 2 + 1 AS sb FROM two JOIN customer x ON x.c_custkey = a JOIN customer y ON y.c_custkey = b WHERE NOT EXISTS (SELECT 1 FROM o WHERE (o.id1 = a AND o.id2 = b) OR (o.id1 = b AND o.id2 = a))),
trio AS (SELECT kid, CASE WHEN sa < sb THEN a ELSE b END AS dad, CASE WHEN sa < sb THEN b ELSE a END AS mom FROM sexed WHERE sa <> sb),
kept AS (SELECT * FROM trio WHERE dad IN (SELECT dad FROM trio GROUP BY dad HAVING count(DISTINCT mom) = 1) AND mom IN (SELECT mom FROM trio GROUP BY mom HAVING count(DISTINCT dad) = 1))
SELECT kid, dad, mom FROM kept WHERE dad NOT IN (SELECT kid FROM kept) AND mom NOT IN (SELECT kid FROM kept)"""


@plans.query(ctes("pairs") + FAMILIES)
def infer_ped_families(spark, sf_dir):
    """M13, J24, S27."""
    p = view(spark, sf_dir, "pairs")
    rel = P.relation(F.col("kin_milli") / 1000, F.col("ibs0_permille") / 1000, dup=0.98, rel=0.6)
    sexes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2 + 1).cast("int").alias("sex"))
    edges = p.select("id1", "id2", rel.alias("rel")).filter("rel <> 'ETC'").distinct()
    return P.families(edges, sexes)


@plans.query(ctes("genotypes") + """ SELECT vid, sample, CASE WHEN g <> 2 THEN g WHEN pl0 < pl2 THEN 1 WHEN pl2 < pl0 THEN 3 WHEN (vid * 31 + sample * 17) % 100 / 100.0 < 0.3 THEN 3 ELSE 1 END AS g FROM genotypes""")
def resolve_chrx_hets(spark, sf_dir):
    """P17, C32, F11."""
    tie = ((F.col("vid") * 31 + F.col("sample") * 17) % 100) / 100
    return view(spark, sf_dir, "genotypes").select("vid", "sample", G.resolve_male_het(F.col("g"), F.col("pl0"), F.col("pl2"), F.lit(0.3), tie).alias("g"))


@plans.query(ctes("genotypes") + """, x AS (SELECT vid, sample, pl0 AS n, least(pl1, pl0) AS e FROM genotypes), l AS (SELECT *, e*ln(0.01)+(n-e)*ln(0.99) AS l0, e*ln(0.5)+(n-e)*ln(0.5) AS l1, e*ln(0.99)+(n-e)*ln(0.01) AS l2 FROM x)
SELECT vid, sample, CASE WHEN n >= 5 AND e >= 3 AND e <= n THEN CASE WHEN round(l0, 9) >= round(l1, 9) AND round(l0, 9) >= round(l2, 9) THEN 0 WHEN round(l1, 9) >= round(l2, 9) THEN 1 ELSE 2 END END AS call FROM l""")
def hard_calls(spark, sf_dir):
    """P18, F10."""
    return view(spark, sf_dir, "genotypes").select("vid", "sample", G.call_from_counts(F.least("pl1", "pl0"), F.col("pl0"), 0.01).cast("int").alias("call"))


@plans.query(ctes("genotypes") + " SELECT vid, sample, '0/' || (g % 2) AS gt, pl0 || ',' || pl1 || ',' || pl2 AS pl, CAST(g % 2 + 1 AS INT) AS code FROM genotypes")
def view_gt(spark, sf_dir):
    """Fields by FORMAT from wide rows, one row a sample."""
    g = view(spark, sf_dir, "genotypes")
    cell = F.concat(F.lit("0/"), (F.col("g") % 2).cast("string"), F.lit(":"), F.col("pl0").cast("string"), F.lit(":"), F.concat_ws(",", F.col("pl0").cast("string"), F.col("pl1").cast("string"), F.col("pl2").cast("string")))
    wide = g.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("sample", cell.alias("cell")))).alias("samples")).withColumn("format", F.lit("GT:DP:PL"))
    long = wide.select("vid", "format", F.explode("samples").alias("s"))
    gt = G.gt_only(F.col("s.cell"), F.col("format"))
    return long.select("vid", F.col("s.sample").alias("sample"), gt.alias("gt"), G.field(F.col("s.cell"), F.col("format"), "PL").alias("pl"), G.gt_code(gt).alias("code"))


@plans.query(ctes("variants") + """, k AS (SELECT DISTINCT chrom, pos, ref, alt FROM variants WHERE vorder % 6 = 0), o AS (SELECT o_orderkey AS vorder, o_custkey AS a, o_custkey + 1 AS b FROM orders), c AS (SELECT v.chrom, v.pos, v.ref, v.alt, unnest([a, b]) // 2 AS sample FROM variants v JOIN o USING (vorder)),
s AS (SELECT k.chrom, sample, count(*) AS score FROM k JOIN c USING (chrom, pos, ref, alt) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY score DESC, sample) AS rank FROM s) SELECT chrom, sample, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def sparse_match_top10(spark, sf_dir):
    """A24, J27, T7, C33."""
    from strandlake.operators.ordered import top_per

    v = view(spark, sf_dir, "variants")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vorder"), F.concat_ws(",", F.col("o_custkey").cast("string"), (F.col("o_custkey") + 1).cast("string")).alias("offsets"))
    keys = ["chrom", "pos", "ref", "alt"]
    met = J.sparse_scores(v.filter("vorder % 6 = 0").select(*keys).distinct(), v.join(o, "vorder").select(*keys, "offsets"), keys, "offsets")
    return top_per(met.groupBy("chrom", "sample").agg(F.count("*").alias("score")), ["chrom"], [F.desc("score"), F.col("sample")], 10)


@plans.query(ctes("variants") + """, r AS (SELECT vorder, vline, ac, ac % 7 AS s, filter, vorder % 9 = 0 AS cen, vline % 5 - 14 AS ex FROM variants)
SELECT vorder, vline, CASE WHEN len(f) > 0 THEN array_to_string(f, ';') ELSE 'PASS' END AS generic, CASE WHEN filter = 'PASS' AND ac = 0 THEN 'SVM' ELSE array_to_string(list_transform(string_split(filter, ';'), lambda t: CASE WHEN t = 'SVM' THEN 'EXTSVM' ELSE t END), ';') END AS ext
FROM (SELECT *, list_filter([CASE WHEN s < 2 OR ac = 0 THEN 'SVM' END, CASE WHEN cen THEN 'CEN' END, CASE WHEN vline = 2 THEN 'NEG' END, CASE WHEN ex < -13.81551 THEN 'EXHET' END], lambda x: x IS NOT NULL) AS f FROM r)""")
def svm_filter_rules(spark, sf_dir):
    """M11, P16."""
    v = view(spark, sf_dir, "variants")
    score, ex, cen = (F.col("ac") % 7).cast("double"), (F.col("vline") % 5 - 14).cast("double"), F.col("vorder") % 9 == 0
    return v.select("vorder", "vline", classify.generic_rules(score, F.col("ac"), cen, F.col("vline") == 2, ex, 2.0).alias("generic"), classify.external_rules(F.col("filter"), score, F.col("ac"), cen, ex, 2.0).alias("ext"))


def _horner(x: str, cs: list[float]) -> str:
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _probit(p: str) -> str:
    """The normal quantile of a column of chances, in SQL."""
    t = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    q = f"({p} - 0.5::DOUBLE)"
    tail = f"{_horner(t, classify._C)} / ({_horner(t, classify._D)} * {t} + 1)"
    mid = f"{_horner(f'({q} * {q})', classify._A)} * {q} / ({_horner(f'({q} * {q})', classify._B)} * {q} * {q} + 1)"
    return f"CASE WHEN {p} < 0.02425 THEN {tail} WHEN {p} > 1 - 0.02425 THEN -({tail}) ELSE {mid} END"


@plans.query(ctes("variants") + f""", c AS (SELECT ac AS v, count(*) AS n FROM variants GROUP BY ac),
r AS (SELECT v, n, sum(n) OVER (ORDER BY v) - (n - 1) / 2.0 AS rank, sum(n) OVER () AS total FROM c),
p AS (SELECT v, n, CAST((rank - 0.5) / total AS DOUBLE) AS p FROM r)
SELECT v AS ac, n, round({_probit("p")}, 6) + 0.0 AS z FROM p""")
def quantile_ranks(spark, sf_dir):
    """The normal quantiles of mean ranks."""
    v = view(spark, sf_dir, "variants").select("ac")
    out = classify.inverse_normal(v, ["ac"]).groupBy("ac").agg(F.count("*").alias("n"), F.first("ac_norm").alias("z"))
    return out.select("ac", "n", (F.round("z", 6) + F.lit(0.0)).alias("z"))


@plans.query()
def svm_generic_filter(spark, sf_dir):
    """Features, inverse-normal, kernel SVM, FILTER. Weaker check: rows and columns."""
    v = view(spark, sf_dir, "variants").withColumn("score_a", F.col("ac").cast("double")).withColumn("score_b", (F.col("pos") % 97).cast("double"))
    label = F.when((F.col("vorder") % 5 == 0) & (F.col("ac") > 25), 1).when((F.col("vorder") % 5 == 1) & (F.col("ac") <= 25), -1)
    scored = classify.svm_scores(v.withColumn("label", label), ["score_a", "score_b"], "label", features=32, iterations=10)
    rules = classify.generic_rules(F.col("score"), F.col("ac"), F.lit(False), F.lit(False), F.lit(0.0))
    return scored.select("vorder", "vline", F.round("score", 6).alias("score"), rules.alias("filter"))


@plans.query()
def svm_family_filter(spark, sf_dir):
    """M8: negatives by discordance; X has a model of its own. Weaker check: rows and columns."""
    v = view(spark, sf_dir, "variants").withColumn("score_a", F.col("ac").cast("double")).withColumn("score_b", (F.col("pos") % 97).cast("double"))
    disc, cen, x = F.col("vorder") % 11, F.col("vorder") % 9 == 0, F.col("chrom") == "chr22"
    negative = classify.negatives_by_discordance(F.col("ac"), disc, F.col("ac"), F.lit(True), cen)
    rows = v.withColumn("label", F.when(negative, -1).when(F.col("vorder") % 5 == 0, 1))
    scored = classify.svm_scores_apart(rows, ["score_a", "score_b"], "label", [x, ~x], features=32, iterations=10)
    rules = classify.milk_rules(F.col("score"), F.col("ac"), cen, disc > 8, F.lit(0.0), F.lit(0.0), x)
    return scored.select("vorder", "vline", F.round("score", 6).alias("score"), rules.alias("filter"))


@plans.query()
def svm_external_filter(spark, sf_dir):
    """M9: negatives from another call set's FILTER, and the chance that a site is good. Weaker check:
    rows and columns."""
    v = view(spark, sf_dir, "variants").withColumn("score_a", F.col("ac").cast("double")).withColumn("score_b", (F.col("pos") % 97).cast("double"))
    rows = v.withColumn("label", F.when(F.col("filter").contains("SVM"), -1).when(F.col("vorder") % 5 == 0, 1))
    scored = classify.with_probability(classify.svm_scores(rows, ["score_a", "score_b"], "label", features=32, iterations=10), "label")
    rules = classify.external_rules(F.col("filter"), F.col("score"), F.col("ac"), F.lit(False), F.lit(0.0))
    return scored.select("vorder", "vline", F.round("score", 6).alias("score"), F.round("probability", 6).alias("probability"), rules.alias("ext"))


@plans.query(ctes("variants") + """, w AS (SELECT DISTINCT a || b || c AS kmer, CAST(ascii(a) * 3 + ascii(b) * 5 + ascii(c) * 3 - 500 AS DOUBLE) AS weight FROM (VALUES ('A'),('C'),('G'),('T')) x(a), (VALUES ('A'),('C'),('G'),('T')) y(b), (VALUES ('A'),('C'),('G'),('T')) z(c)),
b AS (SELECT kmer, max(weight) AS weight FROM (SELECT kmer, weight FROM w UNION ALL SELECT reverse(translate(kmer, 'ACGT', 'TGCA')), weight FROM w) GROUP BY kmer),
s AS (SELECT vorder, vline, pos, sign, 'AC' || allele || 'GT' AS seq, length(allele) AS la FROM (SELECT vorder, vline, pos, unnest([{'sign': -1, 'allele': ref}, {'sign': 1, 'allele': alt}], recursive := true) FROM (SELECT DISTINCT vorder, vline, pos, ref, alt FROM variants))),
k AS (SELECT vorder, vline, pos, sign / (3 + la - 1) AS f, unnest(list_transform(range(1, length(seq) - 1), lambda i: substr(seq, i, 3))) AS kmer FROM s)
SELECT vorder, vline, pos, round(sum(f * coalesce(weight, 0)) * 3, 6) + 0.0 AS delta FROM k LEFT JOIN b USING (kmer) GROUP BY ALL""")
def kmer_score(spark, sf_dir):
    """M12, J28, X1, C29."""
    v = view(spark, sf_dir, "variants").select("vorder", "vline", "pos", "ref", "alt").distinct().withColumn("left", F.lit("AC")).withColumn("right", F.lit("GT"))
    bases = F.array(*[F.lit(b) for b in "ACGT"])
    w = spark.range(1, numPartitions=1).select(F.explode(bases).alias("x")).select("x", F.explode(bases).alias("y")).select("x", "y", F.explode(bases).alias("z"))
    w = w.select(F.concat("x", "y", "z").alias("kmer"), (F.ascii("x") * 3 + F.ascii("y") * 5 + F.ascii("z") * 3 - 500).cast("double").alias("weight"))
    return classify.delta_scores(v, w, 3, ["vorder", "vline", "pos"])


@plans.query("SELECT c_custkey, round(c_nationkey * 1000 / (1e-6 - ln(1 - c_nationkey / 100.0)), 4) AS library FROM customer")
def library_size(spark, sf_dir):
    """M15."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.round(classify.library_size(F.col("c_nationkey") * 1000, F.col("c_nationkey") / 100), 4).alias("library"))


@plans.query("SELECT l_orderkey AS row, l_linenumber % 3 AS axis, round(sum(l_quantity * (l_suppkey % 5)), 4) AS score FROM lineitem GROUP BY 1, 2")
def pca_projection(spark, sf_dir):
    """Rows of a sparse matrix on given axes."""
    li = table(spark, sf_dir, "lineitem")
    m = li.select(F.col("l_orderkey").alias("row"), F.concat_ws(":", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("c"), F.col("l_quantity").alias("v"))
    w = li.select(F.concat_ws(":", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string")).alias("c"), (F.col("l_linenumber") % 3).alias("axis"), (F.col("l_suppkey") % 5).alias("w")).distinct()
    return classify.project(m, w, "row", "c", "v", "axis", "w").withColumn("score", F.round("score", 4))


CELLS = "SELECT l_suppkey AS cell, l_partkey % 50 AS gene, CAST(sum(l_quantity) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2"


def _normalised(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), (F.col("l_partkey") % 50).alias("gene"))
    return classify.log_normalised(li.agg(F.sum("l_quantity").cast("double").alias("v")), "cell", "v")


@plans.query(f"""WITH c AS ({CELLS}), n AS (SELECT gene, ln(1 + v / sum(v) OVER (PARTITION BY cell) * 10000) AS x, (SELECT count(DISTINCT cell) FROM c) AS cells FROM c),
s AS (SELECT gene, sum(x) / max(cells) AS mean, sum(x) AS s, sum(x * x) AS q, max(cells) AS cells FROM n GROUP BY gene)
SELECT gene, round(mean, 5) AS mean, round((q - s * mean) / (cells - 1), 5) AS var, round((q - s * mean) / (cells - 1) / mean, 5) AS dispersion FROM s""")
def variable_genes(spark, sf_dir):
    """Log-normalised counts, and the genes' dispersion."""
    m = _normalised(spark, sf_dir)
    stats = classify.variable_rows(m, "gene", "norm", m.select("cell").distinct().count())
    return stats.select("gene", *[F.round(c, 5).alias(c) for c in ("mean", "var", "dispersion")])


@plans.query()
def cell_axes(spark, sf_dir):
    """Cells on the first axes of the ten most variable genes. Weaker check: the axes' signs are free."""
    m = _normalised(spark, sf_dir)
    stats = classify.variable_rows(m, "gene", "norm", m.select("cell").distinct().count())
    top = [r["gene"] for r in stats.orderBy(F.desc("dispersion"), "gene").limit(10).collect()]
    return classify.principal_axes(m, top, "gene", "cell", "norm", 3).select("cell", F.round(F.abs(F.col("pc")[0]), 4).alias("pc1"), F.round(F.abs(F.col("pc")[1]), 4).alias("pc2"))
