"""Pedigree inference from kinship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.operators.graph import components
from strandlake.operators.joins import unrelated_pairs


def relation(kinship: Column, ibs0: Column, dup: float = 0.4, rel: float = 0.175, po: float = 0.0035) -> Column:
    """DUP, PO, FS or ETC by kinship and the share of sites without a common allele."""
    return F.when(kinship > dup, "DUP").when((kinship > rel) & (ibs0 < po), "PO").when(kinship > rel, "FS").otherwise("ETC")


def relation_named(kind: Column) -> Column:
    """Of reports that name the relation."""
    return F.when(kind == "Dup/MZ", "DUP").when(kind.isin("PO", "FS"), kind).otherwise("ETC")


def duplicate_sets(edges: DataFrame) -> DataFrame:
    """id, rep: samples of one person share the least id. edges: id1, id2, rel."""
    dup = edges.filter("rel = 'DUP'").select(F.col("id1").alias("u"), F.col("id2").alias("v"))
    ids = edges.select(F.col("id1").alias("id")).union(edges.select("id2")).distinct()
    return ids.join(components(dup).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("rep"))


def families(edges: DataFrame, sexes: DataFrame) -> DataFrame:
    """kid, dad, mom of every representative with exactly two parent-offspring neighbours that have no
    recorded relation to each other and are of different sex (the lower code is the father), where
    neither parent is paired with someone else and neither is a child."""
    reps = duplicate_sets(edges)
    a = reps.select(F.col("id").alias("id1"), F.col("rep").alias("r1"))
    b = reps.select(F.col("id").alias("id2"), F.col("rep").alias("r2"))
    own = edges.join(a, "id1").join(b, "id2").filter("r1 != r2").select(F.col("r1").alias("id1"), F.col("r2").alias("id2"), "rel").distinct()
    po = own.filter("rel = 'PO'")
    near = po.select(F.col("id1").alias("kid"), F.col("id2").alias("p")).union(po.select("id2", "id1")).distinct()
    two = near.groupBy("kid").agg(F.count("*").alias("n"), F.min("p").alias("a"), F.max("p").alias("b")).filter("n = 2").drop("n")
    apart = unrelated_pairs(two, own)
    s = lambda c: sexes.select(F.col("id").alias(c), F.col("sex").alias(f"sex_{c}"))
    sexed = apart.join(s("a"), "a").join(s("b"), "b").filter("sex_a != sex_b")
    trio = sexed.select("kid", F.when(F.col("sex_a") < F.col("sex_b"), F.col("a")).otherwise(F.col("b")).alias("dad"), F.when(F.col("sex_a") < F.col("sex_b"), F.col("b")).otherwise(F.col("a")).alias("mom"))
    once = lambda who, mate: trio.groupBy(who).agg(F.count_distinct(mate).alias("m")).filter("m = 1").select(who)
    kept = trio.join(once("dad", "mom"), "dad", "left_semi").join(once("mom", "dad"), "mom", "left_semi")
    kids = kept.select(F.col("kid").alias("k"))
    return kept.join(kids, kept["dad"] == kids["k"], "left_anti").join(kids, kept["mom"] == kids["k"], "left_anti").select("kid", "dad", "mom")


def without_overlap(members: DataFrame) -> DataFrame:
    """Families (family, id) that share no member with an earlier one by name."""
    first = members.groupBy("id").agg(F.min("family").alias("first"))
    late = members.join(first, "id").filter("family != first").select("family").distinct()
    return members.join(late, "family", "left_anti")
