"""Writers (K1-K9, K11, K15): text with header lines, partitioned layouts, matrices, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.variant import chrom_ordinal
from strandlake.operators.ordered import genomic_sort
from strandlake.sources.text import VCF


def _text(df: DataFrame, columns: list, path: str, header: list[str], compression: str | None) -> None:
    """Header lines first in one small file, rows in order in the others: names sort by part number."""
    spark = df.sparkSession
    body = df.select(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit(".")) for c in columns]).alias("value"))
    w = body.write.mode("overwrite")
    (w.option("compression", compression) if compression else w).text(f"{path}/body")
    spark.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def write_vcf(df: DataFrame, path: str, header: list[str] | None = None, compression: str | None = "gzip") -> None:
    """K2, K4: sites in genomic order."""
    lines = [*(header or ["##fileformat=VCFv4.2"]), "#" + "\t".join(c.upper() for c in VCF)]
    _text(genomic_sort(df), [F.col(c) for c in VCF], path, lines, compression)


def rewritten_header(meta: list[str], add: list[str] = (), drop: str | None = None) -> list[str]:
    """K4: meta lines without those that contain ``drop``, new ones at their end."""
    return [m for m in meta if not (drop and drop in m)] + list(add)


def write_by_region(df: DataFrame, path: str, bucket: int = 1_000_000) -> None:
    """K3: Parquet by chromosome, sorted by place within files: regions read few files and row groups."""
    df.repartitionByRange("chrom", F.floor(F.col("pos") / bucket)).sortWithinPartitions("chrom", "pos").write.mode("overwrite").partitionBy("chrom").parquet(path)


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """K5: a folder for each key."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def write_mtx(m: DataFrame, path: str, value: str = "n") -> None:
    """K7: gene, barcode, row_no, col_no and values as a matrix with its names."""
    n = m.agg(F.max("row_no").alias("r"), F.max("col_no").alias("c"), F.count("*").alias("n")).first()
    head = ["%%MatrixMarket matrix coordinate real general", "%", f"{n['r'] or 0} {n['c'] or 0} {n['n']}"]
    spark = m.sparkSession
    spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    m.orderBy("col_no", "row_no").select(F.concat_ws(" ", F.col("row_no").cast("string"), F.col("col_no").cast("string"), F.col(value).cast("string")).alias("value")).write.mode("overwrite").text(f"{path}/matrix")
    for no, name in (("row_no", "gene"), ("col_no", "bcd")):
        m.select(no, F.col(name).cast("string").alias("value")).distinct().orderBy(no).select("value").write.mode("overwrite").text(f"{path}/{name}")


def write_libsvm(df: DataFrame, label: str, features: list[str], path: str) -> None:
    """K8: label and 1-based index:value pairs; zeros are left out."""
    cells = F.array(*[F.when(F.col(f) != 0, F.concat(F.lit(f"{i + 1}:"), F.col(f).cast("string"))) for i, f in enumerate(features)])
    df.select(F.concat_ws(" ", F.col(label).cast("string"), F.array_join(F.filter(cells, lambda x: x.isNotNull()), " ")).alias("value")).write.mode("overwrite").text(path)


def write_ped(df: DataFrame, path: str) -> None:
    """K9: fam, ind, dad, mom (0 if null), sex, pheno (-9 if null)."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(d)) for c, d in (("fam", "."), ("ind", "."), ("dad", "0"), ("mom", "0"), ("sex", "0"), ("pheno", "-9"))]
    df.select(F.concat_ws("\t", *named).alias("value")).write.mode("overwrite").text(path)


def write_genes(model: DataFrame, path: str) -> None:
    """K6: transcripts, and genes over them, in genomic order."""
    order = [chrom_ordinal(F.col("chrom")), "chrom", "beg", "end"]
    model.orderBy(*order).write.mode("overwrite").parquet(f"{path}/transcripts")
    genes = model.groupBy("gene_id", "chrom", "strand").agg(F.max("gene_name").alias("gene_name"), F.min("beg").alias("beg"), F.max("end").alias("end"), F.count("*").alias("n_transcripts"))
    genes.orderBy(*order).write.mode("overwrite").parquet(f"{path}/genes")


def write_bed(df: DataFrame, path: str) -> None:
    """K15."""
    genomic_sort(df, "chrom", "beg", "end").select(F.concat_ws("\t", "chrom", F.col("beg").cast("string"), F.col("end").cast("string")).alias("value")).write.mode("overwrite").text(path)
