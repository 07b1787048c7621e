"""Genotype comparison (A15-A20, A22, A23, A26, A27, M6): codes 0 missing, 1 ref, 2 het, 3 alt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.genotype import phred_chance

# Which of the 27 cells 9*dad+3*mom+kid (0/1/2 ALT) break inheritance, on autosomes and on
# X for a male child; and the 9 cells of two samples of one person.
DISCORDANT_TRIO = [0, 1, 1, 0, 0, 1, 1, 0, 1, 0, 0, 1, 0, 0, 0, 1, 0, 0, 1, 0, 1, 1, 0, 0, 1, 1, 0]
DISCORDANT_TRIO_X = [0, 1, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 1, 1, 0]
DISCORDANT_PAIR = [0, 1, 1, 1, 0, 1, 1, 1, 0]


def confusion(pairs: DataFrame, keys: list[str], g1: str = "g1", g2: str = "g2") -> DataFrame:
    """The 16 counts c_ij by key, in one pass."""
    return pairs.groupBy(*keys).agg(*[F.count_if((F.col(g1) == i) & (F.col(g2) == j)).alias(f"c{i}{j}") for i in range(4) for j in range(4)])


def flipped(pairs: DataFrame, key: str) -> DataFrame:
    """Hom-ref and hom-alt of the second set change places where c11 + c33 < c13 + c31."""
    same, cross = F.count_if(F.col("g1").isin(1, 3) & (F.col("g1") == F.col("g2"))), F.count_if(F.col("g1").isin(1, 3) & (F.col("g1") + F.col("g2") == 4) & (F.col("g1") != F.col("g2")))
    flip = pairs.groupBy(key).agg((same < cross).alias("flip"))
    return pairs.join(flip, key).withColumn("g2", F.when(F.col("flip") & F.col("g2").isin(1, 3), 4 - F.col("g2")).otherwise(F.col("g2")))


def concordance_by_count(cells: DataFrame, unit: int) -> DataFrame:
    """From the 16 counts by variant: overall and non-ref concordance by allele-count bin."""
    c = lambda i, j: F.col(f"c{i}{j}")
    ac = sum((c(2, j) + 2 * c(3, j) for j in (1, 2, 3)), F.lit(0))
    an = sum((c(i, j) for i in (1, 2, 3) for j in (1, 2, 3)), F.lit(0))
    binned = cells.withColumn("ac", ac).withColumn("an", an).filter("an > 0").withColumn("ac_bin", (F.floor(F.col("ac") / unit) * unit).cast("long"))
    same = sum((c(i, i) for i in (2, 3)), c(1, 1))
    out = binned.withColumn("_same", same).withColumn("_nref", F.col("an") - c(1, 1)).groupBy("ac_bin").agg(F.count("*").alias("n_snps"), F.sum("an").alias("n_all"), F.sum("_same").alias("n_same"), F.sum(F.col("_same") - c(1, 1)).alias("n_same_nref"), F.sum("_nref").alias("n_nref"))
    return out.withColumn("overall", F.round(F.col("n_same") / F.col("n_all"), 6)).withColumn("nref", F.round(F.when(F.col("n_nref") > 0, F.col("n_same_nref") / F.col("n_nref")), 6))


def trio_verdict(d: Column, m: Column, k: Column) -> Column:
    """``disc`` for impossible children, ``conc`` where only one genotype is possible, ``free`` where
    several are, ``miss`` if one is missing."""
    possible = {}
    gametes = {1: {0}, 2: {0, 1}, 3: {1}}
    for a in (1, 2, 3):
        for b in (1, 2, 3):
            possible[a, b] = sorted({x + y + 1 for x in gametes[a] for y in gametes[b]})
    out = F.when((d == 0) | (m == 0) | (k == 0), "miss")
    for (a, b), kids in possible.items():
        here = (d == a) & (m == b)
        out = out.when(here & ~k.isin(*kids), "disc").when(here, "conc" if len(kids) == 1 else "free")
    return out


def trio_summary(trios: DataFrame, keys: list[str]) -> DataFrame:
    """Concordance of trios (d, m, k) and het discordance
    (disc + 5e-11) / (conc + disc - all-ref - all-alt + 1e-10)."""
    v = trio_verdict(F.col("d"), F.col("m"), F.col("k"))
    s = trios.withColumn("_v", v).groupBy(*keys).agg(
        F.count_if(F.col("_v") == "conc").alias("n_conc"), F.count_if(F.col("_v") == "disc").alias("n_disc"), F.count_if(F.col("_v") == "miss").alias("n_miss"),
        F.count_if((F.col("d") == 1) & (F.col("m") == 1) & (F.col("k") == 1)).alias("all_ref"), F.count_if((F.col("d") == 3) & (F.col("m") == 3) & (F.col("k") == 3)).alias("all_alt"))
    return s.withColumn("het_disc", F.round((F.col("n_disc") + 5e-11) / (F.col("n_conc") + F.col("n_disc") - F.col("all_ref") - F.col("all_alt") + 1e-10), 6))


def pair_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Two samples of one person: het discordance of (g1, g2)."""
    both = (F.col("g1") > 0) & (F.col("g2") > 0)
    s = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(both & (F.col("g1") != F.col("g2"))).alias("n_disc"), F.count_if(~both).alias("n_miss"), F.count_if((F.col("g1") == F.col("g2")) & F.col("g1").isin(1, 3)).alias("n_hom_same"))
    return s.withColumn("het_disc", F.round((F.col("n_disc") + 5e-11) / (F.col("n") - F.col("n_miss") - F.col("n_hom_same") + 1e-10), 6))


def masked(d: Column, m: Column, k: Column, x_linked: bool = False) -> Column:
    """Whether a complete trio breaks inheritance, by the 27-cell mask."""
    cells = F.array(*[F.lit(v) for v in (DISCORDANT_TRIO_X if x_linked else DISCORDANT_TRIO)])
    return F.when((d > 0) & (m > 0) & (k > 0), F.get(cells, (9 * (d - 1) + 3 * (m - 1) + (k - 1)).cast("int")) == 1).otherwise(F.lit(False))


def masked_pair(a: Column, b: Column) -> Column:
    """Whether two known genotypes of one person differ, by the 9-cell mask."""
    cells = F.array(*[F.lit(v) for v in DISCORDANT_PAIR])
    return F.when((a > 0) & (b > 0), F.get(cells, (3 * (a - 1) + (b - 1)).cast("int")) == 1).otherwise(F.lit(False))


def families_passing(members: DataFrame, family: str, ok: str) -> DataFrame:
    """Families all of whose members pass."""
    return members.groupBy(family).agg(F.bool_and(ok).alias("ok")).filter("ok").drop("ok")


def sample_likelihoods(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Ln of same-person over unrelated likelihood, summed over variants, of rows with af and
    pl0_1..pl2_1, pl0_2..pl2_2; variants with af 0 or 1 are left out."""
    af = F.col("af")
    prior = [(1 - af) * (1 - af), 2 * af * (1 - af), af * af]
    l1, l2 = [phred_chance(F.col(f"pl{i}_1")) for i in range(3)], [phred_chance(F.col(f"pl{i}_2")) for i in range(3)]
    same = sum((p * a * b for p, a, b in zip(prior[1:], l1[1:], l2[1:], strict=True)), prior[0] * l1[0] * l2[0])
    one = sum((p * a for p, a in zip(prior[1:], l1[1:], strict=True)), prior[0] * l1[0])
    two = sum((p * b for p, b in zip(prior[1:], l2[1:], strict=True)), prior[0] * l2[0])
    return pairs.filter((af > 0) & (af < 1)).groupBy(*keys).agg(F.sum(F.log(same) - F.log(one * two)).alias("llr"), F.count("*").alias("n"))


def singletons(carriers: DataFrame, variant: str, sample: str) -> DataFrame:
    """Variants with one carrier, by that carrier."""
    one = carriers.groupBy(variant).agg(F.count("*").alias("n"), F.min(sample).alias(sample)).filter("n = 1")
    return one.groupBy(sample).agg(F.count("*").alias("n_singletons"))


def linkage(haplotypes: DataFrame, keys: list[str], a: str = "h1", b: str = "h2") -> DataFrame:
    """r2 = (n11 n00 - n10 n01)^2 / (p q r s + 1e-6) of two sites' haplotypes (0/1), to 4 digits."""
    n = lambda x, y: F.count_if((F.col(a) == x) & (F.col(b) == y))
    s = haplotypes.groupBy(*keys).agg(n(0, 0).alias("n00"), n(0, 1).alias("n01"), n(1, 0).alias("n10"), n(1, 1).alias("n11"))
    c = {k: F.col(k).cast("double") for k in ("n00", "n01", "n10", "n11")}
    d = c["n11"] * c["n00"] - c["n10"] * c["n01"]
    margins = (c["n00"] + c["n01"]) * (c["n10"] + c["n11"]) * (c["n00"] + c["n10"]) * (c["n01"] + c["n11"])
    return s.withColumn("r2", F.round(d * d / (margins + 1e-6), 4))


def boundaries(ld: DataFrame, keys: list[str], pos: str, least: float) -> DataFrame:
    """Span and number of the sites whose r2 is over ``least``."""
    hit = F.col("r2") > least
    return ld.groupBy(*keys).agg(F.min(F.when(hit, F.col(pos))).alias("from_pos"), F.max(F.when(hit, F.col(pos))).alias("to_pos"), F.count_if(hit).alias("n_inside"))
