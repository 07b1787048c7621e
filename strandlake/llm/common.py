"""Helpers shared by the corpus operators: shared storage, table access, joins, linear folds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.storage import new_path, staged, work_dir

__all__ = ["disjoint", "joined", "let", "new_path", "own_name", "running", "shielded", "staged", "table", "text_or_empty", "work_dir"]

#: A key counts as hot if it has more than one in ``HOT`` of all rows, so fewer than ``HOT`` keys do.
HOT, LEAST_HOT = 1000, 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def own_name(label: str) -> str:
    """A column name that no table has."""
    return f"_{label}_{uuid.uuid4().hex}"


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of names that no table has, and these by the old ones."""
    names = {c: own_name("c") for c in docs.columns}
    return docs.toDF(*names.values()), names


def _inside(v: Column, k: Column) -> Column:
    """Places of the k-th of about sqrt(n) parts of an array of n."""
    width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1)).cast("int")
    return F.sequence(k * width, F.least((k + 1) * width, F.size(v)) - 1)


def running(rows: DataFrame, values: str, out: str, zero: int, op) -> DataFrame:
    """``rows`` with ``out``: for each place of the int array ``values``, ``op`` (associative) over all
    values before it, from ``zero`` on. Parts of about sqrt(n) places come first, so that appending
    costs n**1.5, not n**2. A null array counts as empty."""
    heads = own_name("heads")
    none = F.array().cast("array<int>")
    begun = lambda x: F.struct(x.alias("now"), none.alias("out"))
    add = lambda s, x: F.struct(op(s["now"], x).alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out"))

    def totals(v: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(v))), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / width).cast("int") - 1), lambda k: F.aggregate(_inside(v, k), F.lit(zero), lambda s, i: op(s, v[i])))

    some = F.size(values) > 0
    rows = rows.withColumn(heads, F.when(some, F.aggregate(let(F.col(values), totals), begun(F.lit(zero)), add, lambda s: s["out"])))
    both = F.struct(F.col(values).alias("v"), F.col(heads).alias("h"))
    each = let(both, lambda x: F.transform(x["h"], lambda h, k: F.aggregate(_inside(x["v"], k), begun(h), lambda s, i: add(s, x["v"][i]), lambda s: s["out"])))
    return rows.withColumn(out, F.when(some, F.flatten(each)).otherwise(none)).drop(heads)


def disjoint(rows: DataFrame, spans: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the (start, end) of ``spans`` as a sorted array of disjoint spans, where spans
    that touch are one. A null array counts as empty."""
    own, ends, most = own_name("spans"), own_name("ends"), own_name("most")
    rows = rows.withColumn(own, F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))))
    rows = running(rows.withColumn(ends, F.transform(own, lambda x: x["end"])), ends, most, -1, lambda a, b: F.greatest(a, b))

    def made(x: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(x["s"]) - 1), lambda i: x["s"][i]["start"] > x["e"][i])
        stop = lambda f, k: F.coalesce(x["e"][F.get(f, k + 1)], x["z"])
        return let(firsts, lambda f: F.transform(f, lambda i, k: F.struct(x["s"][i]["start"].alias("start"), stop(f, k).alias("end"))))

    both = F.struct(F.col(own).alias("s"), F.col(most).alias("e"), F.array_max(ends).alias("z"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return rows.withColumn(out, F.when(F.size(own) > 0, let(both, made)).otherwise(none)).drop(own, ends, most)


def joined(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` (many a key) with ``side`` (one row a key).

    Rows of hot keys aren't dealt by key: as fewer than ``HOT`` keys are hot, their rows of ``side``
    are broadcast. All others are shuffled. ``sizes`` (``on``, ``n``) says how many rows keys have,
    if known. ``rows`` and ``side`` are read twice if a key is hot, so they should be written tables."""
    counts = rows.groupBy(*on).agg(F.count("*").alias("n")) if sizes is None else sizes.select(*on, "n")
    total = rows.count()
    hot = staged(counts.filter(F.col("n") > max(LEAST_HOT, total // HOT)).select(*on), "hot")
    if hot.isEmpty():
        return rows.join(side, on, how)
    hot = F.broadcast(hot)
    cold = rows.join(hot, on, "left_anti").join(side, on, how)
    return cold.unionByName(rows.join(hot, on, "left_semi").join(F.broadcast(side.join(hot, on, "left_semi")), on, how))
