"""Delimited genomic text (S1-S3, S5-S10, S18-S22, S24-S34): Spark's text and csv readers plus expressions.

Gzip is handled by Hadoop's codecs. Paths may be globs, lists or folders (``recursive``). Region
restrictions are predicates on columns; written by chromosome (see ``sinks``) they prune files.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.variant import parse_region
from strandlake.storage import staged

VCF = ["chrom", "pos", "id", "ref", "alt", "qual", "filter", "info"]


def lines(spark: SparkSession, path, recursive: bool = False) -> DataFrame:
    """``value`` and ``path`` of every line."""
    return spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path).select("value", F.input_file_name().alias("path"))


def delimited(spark: SparkSession, path, schema: str, sep: str = "\t", header: bool = False, comment: str | None = "#") -> DataFrame:
    r = spark.read.schema(schema).option("sep", sep).option("header", header).option("nullValue", "")
    return (r.option("comment", comment) if comment else r).csv(path)


def whitespace(spark: SparkSession, path, names: list[str], comment: str = "#") -> DataFrame:
    """Columns between runs of white space; what follows the last name stays together as ``rest``."""
    kept = spark.read.text(path).filter(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+", len(names) + 1)
    return kept.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)], F.get(parts, len(names)).alias("rest"))


def vcf(spark: SparkSession, path, region: str | None = None) -> DataFrame:
    """Site columns, FORMAT and the samples' fields as an array."""
    rows = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.col("value") != ""))
    cells = rows.select(F.split("value", "\t").alias("c"))
    named = [F.get("c", i).alias(n) if n != "pos" else F.get("c", 1).cast("long").alias("pos") for i, n in enumerate(VCF)]
    out = cells.select(*named, F.get("c", 8).alias("format"), F.when(F.size("c") > 9, F.slice("c", 10, 1 << 30)).otherwise(F.array().cast("array<string>")).alias("samples"))
    return out.filter(in_region(region)) if region else out


def in_region(region: str, chrom: str = "chrom", pos: str = "pos") -> Column:
    """``chr``, or ``chr:beg-end`` with both ends in."""
    if ":" not in region:
        return F.col(chrom) == region
    c, b, e = parse_region(F.lit(region))
    return (F.col(chrom) == c) & F.col(pos).between(b, e)


def vcf_header(spark: SparkSession, path) -> dict:
    """Meta lines, FILTER names and sample names, from the lines that begin with #."""
    head = [r["value"] for r in spark.read.text(path).filter(F.col("value").startswith("#")).collect()]
    import re

    columns = next((h.split("\t") for h in head if h.startswith("#CHROM")), [])
    return {"meta": [h for h in head if h.startswith("##")], "filters": [m[1] for h in head if (m := re.match(r"##FILTER=<ID=([^,>]+)", h))], "samples": columns[9:]}


def vcf_genotypes(sites: DataFrame, samples: list[str]) -> DataFrame:
    """One row for each site and sample."""
    names = F.array(*[F.lit(s) for s in samples])
    return sites.select("chrom", "pos", "ref", "alt", "format", F.posexplode("samples").alias("k", "cell")).withColumn("sample", F.get(names, F.col("k"))).drop("k")


def bed(spark: SparkSession, path) -> DataFrame:
    """S6."""
    return whitespace(spark, path, ["chrom", "beg", "end"]).withColumns({"beg": F.col("beg").cast("long"), "end": F.col("end").cast("long")})


def bedgraph(spark: SparkSession, path) -> DataFrame:
    """Chrom, beg, end, depth (with its sign)."""
    return whitespace(spark, path, ["chrom", "beg", "end", "depth"]).select("chrom", F.col("beg").cast("long").alias("beg"), F.col("end").cast("long").alias("end"), F.col("depth").cast("double").alias("depth"))


def fasta(spark: SparkSession, path, fai) -> DataFrame:
    """Chrom, start (1-based) and sequence of every line. Offsets come from the index, so that each
    line finds its place by itself: FASTA needs no single reader."""
    index = delimited(spark, fai, "chrom string, length long, offset long, bases long, width long")
    text = spark.read.format("binaryFile").load(path).select("content")
    whole = text.crossJoin(F.broadcast(index))  # the index has a row a chromosome
    n = F.ceil(F.col("length") / F.col("bases"))
    at = whole.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    start = F.col("k") * F.col("bases")
    piece = F.substring("content", (F.col("offset") + F.col("k") * F.col("width") + 1).cast("int"), F.least(F.col("bases"), F.col("length") - start).cast("int"))
    return at.select("chrom", (start + 1).alias("start"), piece.cast("string").alias("seq"))


def sequence_of(chunks: DataFrame, chrom: str, beg: int, end: int) -> DataFrame:
    """Bases beg..end (1-based, both in) of a chromosome as one string."""
    met = chunks.filter((F.col("chrom") == chrom) & (F.col("start") <= end) & (F.col("start") + F.length("seq") > beg))
    s = met.agg(F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("p"))
    joined, first = F.array_join(F.transform("p", lambda x: x["seq"]), ""), F.get("p", 0)["start"]
    return s.select(F.substr(joined, (F.lit(beg) - first + 1).cast("int"), F.lit(end - beg + 1)).alias("seq"))


def gtf(spark: SparkSession, path) -> DataFrame:
    """Rows with their gene and transcript names."""
    raw = delimited(spark, path, "chrom string, source string, feature string, beg long, end long, score string, strand string, phase string, attributes string")
    at = lambda k: F.regexp_extract("attributes", rf'{k} "([^"]*)"', 1)
    return raw.select("chrom", "feature", "beg", "end", "strand", *[F.nullif(at(k), F.lit("")).alias(k) for k in ("gene_id", "gene_name", "transcript_id")])


def gene_model(rows: DataFrame) -> DataFrame:
    """A transcript a row, with its exons and CDS in order."""
    of = lambda f: F.array_sort(F.collect_list(F.when(F.col("feature") == f, F.struct("beg", "end"))))
    t = rows.filter("transcript_id is not null").groupBy("gene_id", "transcript_id", "chrom", "strand")
    return t.agg(F.max("gene_name").alias("gene_name"), F.min("beg").alias("beg"), F.max("end").alias("end"), of("exon").alias("exons"), of("CDS").alias("cds"))


def gene_pred(model: DataFrame) -> DataFrame:
    """The flat gene prediction columns, 0-based starts."""
    ends = lambda k, d: F.concat(F.array_join(F.transform("exons", lambda x: (x[k] - d).cast("string")), ","), F.lit(","))
    return model.select("gene_name", "transcript_id", "chrom", "strand", (F.col("beg") - 1).alias("tx_start"), F.col("end").alias("tx_end"), (F.coalesce(F.get("cds", 0)["beg"], F.col("end") + 1) - 1).alias("cds_start"), F.coalesce(F.try_element_at("cds", F.lit(-1))["end"], F.col("end")).alias("cds_end"), F.size("exons").alias("n_exons"), ends("beg", 1).alias("exon_starts"), ends("end", 0).alias("exon_ends"))


def ped(spark: SparkSession, path) -> DataFrame:
    """Ids are arrays (duplicates are comma-joined); parents ``0`` and phenotype -9 are null."""
    rows = whitespace(spark, path, ["fam", "ind", "dad", "mom", "sex", "pheno"])
    ids = lambda c: F.when(F.col(c) != "0", F.split(c, ","))
    return rows.select("fam", F.split("ind", ",").alias("ind"), ids("dad").alias("dad"), ids("mom").alias("mom"), F.col("sex").try_cast("int").alias("sex"), F.nullif("pheno", F.lit("-9")).alias("pheno"))


def kinship(spark: SparkSession, path) -> DataFrame:
    """id1, id2, rel of either report layout: new ones name the relation, old ones have kinship and
    IBS0 to tell it by."""
    from strandlake.operators.pedigree import relation, relation_named

    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    new = "InfType" in raw.columns
    rel = relation_named(F.col("InfType")) if new else relation(F.col("Kinship").cast("double"), F.col("IBS0").cast("double"))
    return raw.select(F.col("ID1").alias("id1"), F.col("ID2").alias("id2"), rel.alias("rel"))


def _numbered_lines(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Lines of each file as ``value``, ``file`` and ``line`` (from 0), and the files: file, path, n_lines; files
    are numbered by name. A split's lines are numbered by themselves, and splits by the lines before them.

    The lines are written to the shared folder: both passes see the same splits."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    cut = staged(raw, "lines")
    splits = cut.groupBy("path", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    files = splits.groupBy("path").agg(F.sum("_n").alias("n_lines")).withColumn("file", F.row_number().over(Window.orderBy("path")))
    w = Window.partitionBy("path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))).join(files, "path").select("path", "_start", "file", (F.col("_before") - F.col("_first")).alias("_add"))
    # a row a split, and one a file
    return cut.join(F.broadcast(before), ["path", "_start"]).select("file", (F.col("_id") + F.col("_add")).alias("line"), "value"), files


def _numbered_records(spark: SparkSession, path, size: int) -> DataFrame:
    """Lines of each file in groups of ``size``: path, record, parts; ``place`` numbers the records of all
    files, in the order of their names. Files are read by splits; what a split or a batch cuts is put together
    by a shuffle of these lines alone."""
    def grouped(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            file, line = batch.column("file").to_numpy(), batch.column("line").to_numpy()
            value, at = batch.column("value"), np.arange(len(line))
            whole = at[(line % size == 0) & (at + size <= len(line))]
            for k in range(1, size):
                whole = whole[(line[whole + k] == line[whole] + k) & (file[whole + k] == file[whole])]
            within = (whole[:, None] + np.arange(size)).ravel()
            rest = np.setdiff1d(at, within)
            first = np.concatenate([whole, rest])
            ends = np.concatenate([[0], np.cumsum(np.repeat([size, 1], [len(whole), len(rest)]))])
            parts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), value.take(pa.array(np.concatenate([within, rest]))))
            yield pa.RecordBatch.from_arrays([pa.array(file[first]), pa.array(line[first] // size), pa.array(line[first] % size), parts], names=["file", "record", "k", "parts"])

    numbered, files = _numbered_lines(spark, path)
    if size == 1:
        records = numbered.select("file", F.col("line").alias("record"), F.array("value").alias("parts"))
    else:
        runs = numbered.mapInArrow(grouped, "file int, record long, k long, parts array<string>")
        cut = runs.filter(F.size("parts") < size).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("k", F.get("parts", 0).alias("v")))).alias("p"))
        put = cut.filter(F.size("p") == size).select("file", "record", F.transform("p", lambda x: x["v"]).alias("parts"))
        records = runs.filter(F.size("parts") == size).drop("k").unionByName(put)
    full = F.floor(F.col("n_lines") / size)
    first = files.select("file", "path", F.coalesce(F.sum(full).over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    return records.join(F.broadcast(first), "file").select("path", "record", (F.col("record") + F.col("_first")).alias("place"), "parts")


def _fastq(spark: SparkSession, path) -> DataFrame:
    r = _numbered_records(spark, path, 4)
    return r.select("path", "record", "place", F.regexp_extract(F.get("parts", 0), r"^@(\S+)", 1).alias("name"), F.get("parts", 1).alias("seq"), F.get("parts", 3).alias("qual"))


def fastq(spark: SparkSession, path) -> DataFrame:
    """Path, record, name, seq, qual."""
    return _fastq(spark, path).drop("place")


def fastq_pairs(spark: SparkSession, first, second) -> DataFrame:
    """Both reads of a pair by their record, over all files of either end; names (without /1, /2) must
    agree."""
    plain = lambda c: F.regexp_replace(c, "/[12]$", "")
    a = _fastq(spark, first).drop("record").withColumnRenamed("place", "record")
    b = _fastq(spark, second).select(F.col("place").alias("record"), F.col("name").alias("name2"), F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    same = F.when(plain(F.col("name")) == plain(F.col("name2")), plain(F.col("name"))).otherwise(F.raise_error(F.concat(F.lit("names differ at record "), F.col("record").cast("string"))).cast("string"))
    return a.join(b, "record").select("record", same.alias("name"), F.col("seq").alias("seq1"), "seq2", F.col("qual").alias("q1"), F.col("qual2").alias("q2"))


def sam(spark: SparkSession, path) -> DataFrame:
    """Alignment records; header lines are left out."""
    cells = spark.read.text(path).filter(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("c"))
    kinds = [("qname", "string"), ("flag", "int"), ("chrom", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string")]
    return cells.select(*[F.get("c", i).cast(t).alias(n) for i, (n, t) in enumerate(kinds)])


def sam_read_groups(spark: SparkSession, path) -> DataFrame:
    """File, id, sm, dt of every @RG line."""
    rg = lines(spark, path).filter(F.col("value").startswith("@RG"))
    at = lambda k: F.nullif(F.regexp_extract("value", rf"\t{k}:([^\t]+)", 1), F.lit(""))
    return rg.select(F.col("path").alias("file"), at("ID").alias("id"), at("SM").alias("sm"), at("DT").alias("dt"))


def matrix_market(spark: SparkSession, folder: str, new: bool = False) -> DataFrame:
    """Gene, barcode, n of a count matrix; names as in either generation of the layout. Each of the three may
    be a folder of files in the order of their names."""
    gz = ".gz" if new else ""
    coo = spark.read.text(f"{folder}/matrix.mtx{gz}").filter(~F.col("value").startswith("%")).select(F.split("value", " ").alias("c"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_k"))
    first = coo.agg(F.min("_k").alias("_first"))  # the line of sizes: the first of the first file, by name
    body = coo.join(F.broadcast(first)).filter("_k > _first").select(F.get("c", 0).cast("long").alias("i"), F.get("c", 1).cast("long").alias("j"), F.get("c", 2).cast("double").alias("n"))
    names = lambda f: _numbered_records(spark, f, 1).select((F.col("place") + 1).alias("k"), F.split(F.get("parts", 0), "\t").alias("c"))
    genes = names(f"{folder}/{'features' if new else 'genes'}.tsv{gz}").select(F.col("k").alias("i"), F.get("c", 0).alias("gene"))
    cells = names(f"{folder}/barcodes.tsv{gz}").select(F.col("k").alias("j"), F.get("c", 0).alias("barcode"))
    return body.join(genes, "i").join(cells, "j").select("gene", "barcode", "n")


def genetic_map(spark: SparkSession, path) -> DataFrame:
    """Chrom, bp, rate, cm."""
    return whitespace(spark, path, ["chrom", "bp", "rate", "cm"]).select("chrom", F.col("bp").try_cast("long").alias("bp"), F.col("rate").try_cast("double").alias("rate"), F.col("cm").try_cast("double").alias("cm")).filter("bp is not null")


def ref_flat(spark: SparkSession, path) -> DataFrame:
    """Genes with their exons; trailing commas are dropped."""
    r = delimited(spark, path, "name1 string, name2 string, chrom string, strand string, tx_start long, tx_end long, cds_start long, cds_end long, n_exons int, starts string, ends string")
    nums = lambda c: F.transform(F.array_remove(F.split(c, ","), ""), lambda x: x.cast("long"))
    return r.withColumns({"starts": nums("starts"), "ends": nums("ends")})


def kmer_weights(spark: SparkSession, path) -> DataFrame:
    """Kmer, weight of two- or three-column files; comments, ``kmer`` and ``bias`` lines go."""
    rows = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#|kmer|bias)") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("c"))
    return rows.select(F.get("c", 0).alias("kmer"), F.element_at("c", -1).cast("double").alias("weight"))


def dictionary(spark: SparkSession, path, key: str = "key", value: str = "value") -> DataFrame:
    """S33."""
    return whitespace(spark, path, [key, value]).select(key, value)


def id_list(spark: SparkSession, given: str | Iterable[str], is_file: bool = False) -> DataFrame:
    """Ids from a file, a comma-joined literal or a list."""
    if is_file:
        return whitespace(spark, given, ["id"]).select("id")
    names = given.split(",") if isinstance(given, str) else list(given)
    return spark.createDataFrame([(n,) for n in names], "id string")


def tables(spark: SparkSession, paths: list[str], sep: str = "\t") -> list[DataFrame]:
    """Tables whose headers must agree."""
    own = [spark.read.option("sep", sep).option("header", True).option("inferSchema", True).csv(p) for p in paths]
    if any(t.columns != own[0].columns for t in own):
        raise ValueError("headers differ between tables")
    return own


def r_vectors(spark: SparkSession, path) -> DataFrame:
    """Name, i, value of every ``name = c(v1,v2,...)``; NA is null."""
    found = lines(spark, path).filter(F.col("value").rlike(r"c\(.*\)"))
    name, body = F.regexp_extract("value", r"^\s*([\w.]+)\s*(?:=|<-)", 1), F.regexp_extract("value", r"c\((.*)\)", 1)
    return found.select("path", name.alias("name"), F.posexplode(F.split(body, ",")).alias("i", "v")).select("path", "name", "i", F.trim("v").try_cast("double").alias("value"))


def key_key_value(spark: SparkSession, path) -> DataFrame:
    """Path, group, key, value of reports whose lines are ``group key value``."""
    k = lines(spark, path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).select("path", F.split(F.trim("value"), r"\s+", 3).alias("c"))
    return k.select("path", F.get("c", 0).alias("group"), F.get("c", 1).alias("key"), F.get("c", 2).alias("value"))


def wide_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row a file with a column for each key named."""
    return rows.groupBy("path").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys])


def site_frequencies(spark: SparkSession, bim, frq) -> DataFrame:
    """Sites of a .bim with the frequencies of its .frq. Both list the same sites in one order; they
    are joined on the site's id, so that neither has to be read in order. Frequency NA is null."""
    b = whitespace(spark, bim, ["chrom", "id", "cm", "pos", "a1", "a2"]).select("chrom", F.col("pos").cast("long").alias("pos"), "id", "a1", "a2")
    f = whitespace(spark, frq, ["_c", "id", "_a1", "_a2", "maf", "n"]).filter("_c != 'CHR'")
    return b.join(f.select("id", F.col("maf").try_cast("double").alias("maf"), F.col("n").try_cast("long").alias("n")), "id")


def numbered(spark: SparkSession, prefix: str, suffix: str, digits: int = 3) -> list[str]:
    """The files prefix001suffix, prefix002suffix, ... up to the first number that is missing."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(prefix).getFileSystem(spark._jsc.hadoopConfiguration())
    out: list[str] = []
    while fs.exists(fs_path(name := f"{prefix}{len(out) + 1:0{digits}d}{suffix}")):
        out.append(name)
    return out
