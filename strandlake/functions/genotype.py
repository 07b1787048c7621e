"""Genotypes and likelihoods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mendelian transmission: chances of kid genotypes 0/1/2 ALT by 3 * dad + mom.
TRANSMISSION = [(1, 0, 0), (0.5, 0.5, 0), (0, 1, 0), (0.5, 0.5, 0), (0.25, 0.5, 0.25), (0, 0.5, 0.5), (0, 1, 0), (0, 0.5, 0.5), (0, 0, 1)]


def field(sample: Column, format_: Column, name: str) -> Column:
    """A sample's sub-field by its place in FORMAT; null if it isn't there."""
    at = F.array_position(F.split(format_, ":"), name).cast("int")
    return F.when(at > 0, F.try_element_at(F.split(sample, ":"), at))


def gt_only(sample: Column, format_: Column) -> Column:
    """GT alone; FORMAT must start with it."""
    return F.when(format_.rlike("^GT(:|$)"), F.split(sample, ":")[0]).otherwise(F.raise_error(F.lit("FORMAT must start with GT")).cast("string"))


def gt_code(gt: Column) -> Column:
    """0 missing, 1 hom-ref, 2 het, 3 hom-alt; alleles other than 0 count as alternate."""
    a, b = F.regexp_extract(gt, r"^(\d+|\.)", 1), F.regexp_extract(gt, r"^(?:\d+|\.)[/|](\d+|\.)", 1)
    second = F.when(b == "", a).otherwise(b)
    alt = lambda x: F.when(x == "0", 0).otherwise(1)
    return F.when((a == "") | (a == ".") | (second == "."), 0).otherwise(1 + alt(a) + alt(second))


def phred_chance(pl: Column) -> Column:
    """X11: 10^(-min(pl,255)/10)."""
    return F.pow(F.lit(10.0), -F.least(pl, F.lit(255)) / 10)


def normalise_pls(pls: Column) -> Column:
    """Least 0, none over 255."""
    low = F.least(F.lit(255), F.array_min(pls))
    return F.transform(pls, lambda x: F.least(x - low, F.lit(255)))


def pls_from_gl(gls: Column, scale: float = 1.0) -> Column:
    """log10 likelihoods as whole phred values, least 0, none over 255."""
    top = F.array_max(gls)
    return F.transform(gls, lambda g: F.least(F.lit(255), F.floor(-10 * scale * (g - top) + 0.5).cast("int")))


def pl_index(a: Column, b: Column) -> Column:
    """Place of genotype a/b among likelihoods."""
    hi, lo = F.greatest(a, b), F.least(a, b)
    return (hi * (hi + 1) / 2).cast("int") + lo


def call_from_counts(e: Column, n: Column, error: float = 0.1, min_depth: int = 5, min_alt: int = 3) -> Column:
    """0, 1 or 2 ALT copies of greatest binomial likelihood for e ALT of n reads; null under the
    thresholds; of equals the fewer copies."""
    ll = [e * F.log(F.lit(p)) + (n - e) * F.log(F.lit(1 - p)) for p in (error, 0.5, 1 - error)]
    best = F.when((ll[0] >= ll[1]) & (ll[0] >= ll[2]), 0).when(ll[1] >= ll[2], 1).otherwise(2)
    return F.when((n >= min_depth) & (e >= min_alt) & (e <= n), best)


def resolve_male_het(code: Column, pl0: Column, pl2: Column, af: Column, tie: Column) -> Column:
    """A het call (2) of a male outside the shared regions becomes the homozygote of lesser PL; of
    equal ones hom-alt if ``tie`` (a number in 0..1 that follows from the row's key) is under af."""
    return F.when(code != 2, code).when(pl0 < pl2, 1).when(pl2 < pl0, 3).when(tie < af, 3).otherwise(1)


def in_par(pos: Column, start: int, stop: int) -> Column:
    """outside start..stop of X."""
    return (pos < start) | (pos > stop)
