"""Genomic tables derived from the provided ones by plain SQL that Spark and DuckDB both run.

``{name}`` stands for a table: Spark gets the DataFrame, DuckDB the table's name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "variants": """SELECT concat('chr', CAST(l_suppkey % 22 + 1 AS INT)) AS chrom,
       l_partkey * 100 + l_orderkey % 100 AS pos,
       CASE WHEN l_orderkey % 3 = 0 THEN concat('rs', l_orderkey) ELSE '.' END AS id,
       substr('ACGT', CAST(l_linenumber % 4 + 1 AS INT), 1) AS ref,
       substr('ACGT', CAST((l_linenumber + 1 + l_orderkey % 3) % 4 + 1 AS INT), 1) AS alt,
       CASE l_returnflag WHEN 'N' THEN 'PASS' WHEN 'A' THEN 'SVM' ELSE 'SVM;CEN' END AS filter,
       CAST(l_quantity AS INT) AS ac,
       100 AS an,
       concat('AC=', CAST(l_quantity AS INT), ';AN=100') AS info,
       l_orderkey AS vorder, l_linenumber AS vline
FROM {lineitem}""",
    "genotypes": """SELECT o_orderkey AS vid, s.sample AS sample,
       CAST((o_orderkey * 7 + s.sample * 13 + o_custkey) % 4 AS INT) AS g,
       CAST((o_orderkey * 3 + s.sample * 5) % 61 AS INT) AS pl0,
       CAST((o_orderkey * 5 + s.sample * 11) % 61 AS INT) AS pl1,
       CAST((o_orderkey * 11 + s.sample * 3) % 61 AS INT) AS pl2
FROM {orders} CROSS JOIN (SELECT CAST(n_nationkey AS BIGINT) AS sample FROM {nation} WHERE n_nationkey < 8) s""",
    "intervals": """SELECT concat('chr', CAST(o_custkey % 5 + 1 AS INT)) AS chrom,
       (o_orderkey * 37) % 100000 AS beg,
       (o_orderkey * 37) % 100000 + 1 + o_custkey % 50 AS end_pos,
       o_orderkey AS iid
FROM {orders}""",
    "reads": """SELECT event_id AS rid,
       concat('chr', CAST(user_id % 3 + 1 AS INT)) AS chrom,
       (event_id * 13) % 5000 + 1 AS pos,
       CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
       CAST(user_id % 64 AS INT) AS barcode,
       CAST((event_id * 7) % 16 AS INT) AS umi,
       concat(CAST(event_id % 5 + 1 AS INT), 'S', CAST(event_id % 40 + 10 AS INT), 'M', CAST(event_id % 3 + 1 AS INT), 'D', 20, 'M') AS cigar,
       CAST(event_id % 60 AS INT) AS mapq
FROM {events}""",
    "pairs": """SELECT o_custkey AS id1, (o_custkey + o_orderkey % 7 + 1) AS id2,
       CAST(o_orderkey % 1000 AS INT) AS kin_milli,
       CAST(o_custkey % 10 AS INT) AS ibs0_permille
FROM {orders}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in sorted(set(re.findall(r"\{(\w+)\}", sql)))})


def ctes(*names: str) -> str:
    """``WITH`` clause of the views for DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in names)
