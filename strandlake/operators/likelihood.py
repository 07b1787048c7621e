"""Allele frequencies, Hardy-Weinberg and family likelihoods from PLs (M1-M5).

A variant's samples are an array of PL triples; the iterations run over it inside one expression, so a
variant is one row of one task, and no Python is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.genotype import TRANSMISSION, phred_chance


def by_variant(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a variant with ``ls``: its samples' likelihood triples in the order of ``order``."""
    one = F.struct(order, *[phred_chance(F.col(f"pl{i}")).alias(f"l{i}") for i in range(3)])
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("ls"))


def _posterior(x: Column, g0: Column, g1: Column, g2: Column) -> tuple[Column, Column, Column, Column]:
    a, b, c = x["l0"] * g0, x["l1"] * g1, x["l2"] * g2
    return a, b, c, a + b + c


def start_af(ls: Column) -> Column:
    """(n1 + 2 n2) / (n0 + n1 + n2) / 2 with n_k the samples whose PL_k is 0."""
    n = [F.size(F.filter(F.transform(ls, lambda x: x[name]), lambda v: v == 1.0)) for name in ("l0", "l1", "l2")]
    return F.try_divide(n[1] + 2 * n[2], n[0] + n[1] + n[2]) / 2


def em_af(ls: Column, af0: Column, rounds: int) -> Column:
    """M3: ``rounds`` of EM: af = (sum (p1 + 2 p2 + 1e-30) / (p0 + p1 + p2 + 1e-30) + 1e-6) / (2n + 2e-6)."""
    def round_(af: Column, _: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            _, b, c, t = _posterior(x, (1 - af) * (1 - af), 2 * af * (1 - af), af * af)
            return s + (b + 2 * c + 1e-30) / (t + 1e-30)

        return (F.aggregate(ls, F.lit(0.0), step) + 1e-6) / (2 * F.size(ls) + 2e-6)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), af0.cast("double"), round_)


def em_until(ls: Column, af0: Column, most: int = 100, least: float = 1e-4) -> Column:
    """M1: EM of the allele frequency under Hardy-Weinberg and of free genotype frequencies side by side,
    until the squares of the changes of af, g1 and g2 sum to ``least`` or less, ``most`` rounds at most:
    struct of af, g0, g1, g2, rounds, done."""

    def state(af: Column, g: list[Column], rounds: Column, done: Column) -> Column:
        return F.struct(af.alias("af"), *[x.alias(f"g{i}") for i, x in enumerate(g)], rounds.alias("rounds"), done.alias("done"))

    def round_(s: Column, _: Column) -> Column:
        af = s["af"]

        def step(t: Column, x: Column) -> Column:
            _, b, c, all_ = _posterior(x, (1 - af) * (1 - af), 2 * af * (1 - af), af * af)
            f = [x[f"l{i}"] * s[f"g{i}"] for i in range(3)]
            total = f[0] + f[1] + f[2] + 3e-30
            return F.struct((t["ac"] + (b + 2 * c + 1e-30) / (all_ + 1e-30)).alias("ac"), *[(t[f"g{i}"] + (f[i] + 1e-30) / total).alias(f"g{i}") for i in range(3)])

        zero = F.struct(F.lit(0.0).alias("ac"), *[F.lit(0.0).alias(f"g{i}") for i in range(3)])
        n = F.size(ls)
        sums = F.aggregate(ls, zero, step, lambda t: F.struct(((t["ac"] + 1e-6) / (2 * n + 2e-6)).alias("af"), *[((t[f"g{i}"] + 1e-10) / (n + 3e-10)).alias(f"g{i}") for i in range(3)]))
        square = lambda a, b: (a - b) * (a - b)
        moved = lambda z: square(s["af"], z["af"]) + square(s["g1"], z["g1"]) + square(s["g2"], z["g2"])
        new = F.transform(F.array(sums), lambda z: state(z["af"], [z[f"g{i}"] for i in range(3)], s["rounds"] + 1, F.coalesce(moved(z) <= least, F.lit(True))))[0]
        return F.when(s["done"], s).otherwise(new)

    af = af0.cast("double")
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), state(af, [(1 - af) * (1 - af), 2 * af * (1 - af), af * af], F.lit(0), F.lit(False)), round_)


def log_likelihood(ls: Column, g0: Column, g1: Column, g2: Column) -> Column:
    return F.aggregate(ls, F.lit(0.0), lambda s, x: s + F.log(_posterior(x, g0, g1, g2)[3] + 3e-30))


def hardy_weinberg(variants: DataFrame, keys: list[str]) -> DataFrame:
    """M2: af, the likelihood ratio 2 (lnL_free - lnL_hwe) and FIC = 1 - sum P(het) / (2 af (1 - af) n)."""
    af = F.col("_af")  # a name that no result has: inside lambdas a result's name would be taken first
    hwe = ((1 - af) * (1 - af), 2 * af * (1 - af), af * af)
    out = variants.withColumn("g", em_until(F.col("ls"), start_af(F.col("ls")))).withColumn("_af", F.col("g.af"))
    free = [F.col(f"g.g{i}") for i in range(3)]

    def het(s: Column, x: Column) -> Column:
        _, b, _, t = _posterior(x, *hwe)
        return s + (b + 1e-30) / (t + 3e-30)

    lrt = 2 * (log_likelihood(F.col("ls"), *free) - log_likelihood(F.col("ls"), *hwe))
    fic = 1 - F.aggregate("ls", F.lit(0.0), het) / (2 * af * (1 - af) * F.size("ls"))
    return out.select(*keys, F.round(af, 6).alias("af"), F.round(lrt, 4).alias("lrt"), F.round(fic, 4).alias("fic"), *[F.round(free[i], 6).alias(f"gf{i}") for i in range(3)])


def called(x: Column, af: Column) -> dict[str, Column]:
    """M3: GP, GT (of equals the fewer ALT) and GQ = floor(-10 log10(1 - GP + 1e-100)), at most 255."""
    a, b, c, t = _posterior(x, (1 - af) * (1 - af), 2 * af * (1 - af), af * af)
    gt = F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)
    gp = F.greatest(a, b, c) / t
    return {"gt": gt, "gp": gp, "gq": F.least(F.lit(255), F.floor(-10 * F.log10(1 - gp + 1e-100)).cast("int"))}


def unrelated(ls: Column, g: list[Column]) -> Column:
    """M4: sum over samples of -10 log10 of their likelihood."""
    return F.aggregate(ls, F.lit(0.0), lambda s, x: s - 10 * F.log10(_posterior(x, *g)[3] + 1e-100))


def related(dad: Column, mom: Column, kids: Column, g: list[Column]) -> Column:
    """M4: -10 log10 sum over parents' genotypes of their chances and likelihoods times, for each kid, the
    sum over its genotypes of transmission and likelihood: 9 terms however many kids."""
    total = F.lit(0.0)
    for d in range(3):
        for m in range(3):
            t = TRANSMISSION[3 * d + m]
            child = F.aggregate(kids, F.lit(1.0), lambda s, x: s * (x["l0"] * t[0] + x["l1"] * t[1] + x["l2"] * t[2]))
            total = total + g[d] * g[m] * dad[f"l{d}"] * mom[f"l{m}"] * child
    return -10 * F.log10(total + 1e-100)


def family_factor(families: DataFrame, keys: list[str], af: Column) -> DataFrame:
    """M4: Bayes factor LUE - LRE of rows with dad, mom (triples) and kids (array), under Hardy-Weinberg."""
    g = [(1 - af) * (1 - af), 2 * af * (1 - af), af * af]
    lu = unrelated(F.concat(F.array("dad", "mom"), "kids"), g)
    lr = related(F.col("dad"), F.col("mom"), F.col("kids"), g)
    return families.select(*keys, F.round(lu, 4).alias("lu"), F.round(lr, 4).alias("lr"), F.round(lu - lr, 4).alias("bf"))
