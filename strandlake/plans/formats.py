"""Formats: each query writes a table in a format to the shared folder, scans it, and returns what it read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import reads as R
from strandlake.operators import aggregates as A
from strandlake.plans.base import Plans
from strandlake.plans.ranges import SEQ, _seqs
from strandlake.plans.views import ctes, table, view
from strandlake.sources import sinks, text
from strandlake.storage import new_path, staged

plans = Plans()
queries, oracle_sql = plans.queries, plans.oracle_sql


def _lines(df: DataFrame, *columns, sep: str = "\t", path: str | None = None, one: list[str] | None = None) -> str:
    """Writes lines of the columns, in ``one`` file in the order of these columns if they are given."""
    path = path or new_path(df.sparkSession, "lines")
    if one:  # formats whose records are told apart by their place in the file
        df = df.repartition(1).sortWithinPartitions(*one)
    df.select(F.concat_ws(sep, *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]).alias("value")).write.text(path)
    return path


def _vcf(spark, sf_dir) -> str:
    path = new_path(spark, "vcf")
    sinks.write_vcf(view(spark, sf_dir, "variants").withColumn("qual", F.lit(".")), path, sinks.rewritten_header(["##fileformat=VCFv4.2", "##old=1"], ["##new=1"], "old"))
    return f"{path}/body"


@plans.query(ctes("variants") + " SELECT chrom, pos, id, ref, alt, filter, info FROM variants")
def scan_vcf(spark, sf_dir):
    """Gzip."""
    return text.vcf(spark, _vcf(spark, sf_dir)).select("chrom", "pos", "id", "ref", "alt", "filter", "info")


@plans.query(ctes("variants") + " SELECT chrom, pos, ref, alt FROM variants WHERE chrom = 'chr3' AND pos BETWEEN 1000 AND 90000")
def scan_vcf_region(spark, sf_dir):
    """S3, F5."""
    return text.vcf(spark, _vcf(spark, sf_dir), "chr3:1,000-90,000").select("chrom", "pos", "ref", "alt")


@plans.query(ctes("variants") + " SELECT vorder, vline, pos FROM variants WHERE chrom = 'chr7' AND pos BETWEEN 1 AND 70000")
def region_of_index(spark, sf_dir):
    """K3: Parquet laid out by region; a region reads its chromosome's files."""
    path = new_path(spark, "regions")
    sinks.write_by_region(view(spark, sf_dir, "variants").select("chrom", "pos", "vorder", "vline"), path)
    return spark.read.parquet(path).filter(text.in_region("chr7:1-70000")).select("vorder", "vline", "pos")


@plans.query("SELECT 'F' || n_nationkey AS name, 'filter' AS kind FROM nation UNION ALL SELECT 'S' || r_regionkey, 'sample' FROM region")
def scan_vcf_header(spark, sf_dir):
    """FILTER names and samples of a header."""
    n = table(spark, sf_dir, "nation").select(F.format_string("##FILTER=<ID=F%d,Description=\"x\">", "n_nationkey").alias("value"))
    names = table(spark, sf_dir, "region").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("S"), F.col("r_regionkey").cast("string")))), "\t").alias("s"))
    head = names.select(F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), F.col("s")).alias("value"))
    got = text.vcf_header(spark, _lines(n.unionByName(head), "value"))
    return spark.createDataFrame([(x, "filter") for x in got["filters"]] + [(x, "sample") for x in got["samples"]], "name string, kind string")


@plans.query(ctes("intervals") + " SELECT chrom, beg, end_pos FROM intervals")
def scan_bed(spark, sf_dir):
    """S6, K15."""
    path = new_path(spark, "bed")
    sinks.write_bed(view(spark, sf_dir, "intervals").withColumnRenamed("end_pos", "end"), path)
    return text.bed(spark, path).select("chrom", "beg", F.col("end").alias("end_pos"))


DEPTHS = "SELECT 'chr' || CAST(user_id % 5 + 1 AS INT) AS chrom, event_id * 10 AS beg, CAST(round(value * 100) AS BIGINT) AS depth FROM events"


@plans.query(f"SELECT chrom, beg, beg + 10 AS end_pos, CAST(depth AS DOUBLE) AS depth FROM ({DEPTHS})")
def scan_bedgraph(spark, sf_dir):
    """S7."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("chr"), (F.col("user_id") % 5 + 1).cast("int").cast("string")).alias("chrom"), (F.col("event_id") * 10).alias("beg"), F.round(F.col("value") * 100).cast("long").alias("depth"))
    got = text.bedgraph(spark, _lines(e, "chrom", "beg", F.col("beg") + 10, "depth"))
    return got.select("chrom", "beg", F.col("end").alias("end_pos"), "depth")


@plans.query("SELECT 'c' || n_nationkey AS chrom, CAST(10 * k + 1 AS BIGINT) AS start, substr(repeat('ACGTTGCA', CAST(5 + n_nationkey AS INT)), CAST(10 * k + 1 AS INT), 10) AS seq FROM nation, unnest(range(0, CAST(ceil((5 + n_nationkey) * 0.8) AS BIGINT))) t(k)")
def scan_fasta(spark, sf_dir):
    """Lines of a FASTA by their index."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k")).withColumn("len", (F.col("k") + 5) * 8).withColumn("head", F.concat(F.lit(">c"), F.col("k").cast("string")))
    whole = F.expr("repeat('ACGTTGCA', k + 5)")
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.col("len") / 10).cast("int") - 1), lambda i: F.substr(whole, i * 10 + 1, F.lit(10))), "\n")
    size = F.length("head") + 1 + F.col("len") + F.ceil(F.col("len") / 10)
    fasta = _lines(n, F.concat("head", F.lit("\n"), body), one=["k"])
    at, rows = 0, []  # an index has a row a chromosome
    for r in n.select("k", "len", F.length("head").alias("h"), size.alias("size")).orderBy("k").collect():
        rows.append((f"c{r['k']}", r["len"], at + r["h"] + 1))
        at += r["size"]
    fai = _lines(spark.createDataFrame(rows, "chrom string, length long, offset long"), "chrom", "length", "offset", F.lit(10), F.lit(11))
    return text.fasta(spark, fasta, fai)


GENES = "SELECT p_partkey AS k, CAST(p_size AS BIGINT) * 100 + 1 AS b FROM part"


@plans.query(f"SELECT 'N' || k AS gene_name, 'T' || k AS transcript_id, 'chr' || (k % 22 + 1) AS chrom, '+' AS strand, b - 1 AS tx_start, b + 50 AS tx_end, b + 2 AS cds_start, b + 9 AS cds_end, 2 AS n_exons, (b - 1) || ',' || (b + 29) || ',' AS exon_starts, (b + 9) || ',' || (b + 50) || ',' AS exon_ends FROM ({GENES})")
def scan_gtf(spark, sf_dir):
    """Exons and CDS of each transcript as flat columns."""
    return text.gene_pred(_genes(spark, sf_dir))


def _genes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size").cast("long") * 100 + 1).alias("b"))
    parts = [("exon", 30, 50), ("exon", 0, 9), ("CDS", 3, 9)]
    rows = p.withColumn("x", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), (F.col("b") + i).alias("beg"), (F.col("b") + j).alias("end")) for f, i, j in parts])))
    names = F.format_string('gene_id "G%d"; gene_name "N%d"; transcript_id "T%d";', "k", "k", "k")
    chrom = F.concat(F.lit("chr"), (F.col("k") % 22 + 1).cast("string"))
    return text.gene_model(text.gtf(spark, _lines(rows, chrom, F.lit("x"), "x.f", "x.beg", "x.end", F.lit("."), F.lit("+"), F.lit("."), names)))


@plans.query(f"SELECT 'G' || k AS gene_id, 'chr' || (k % 22 + 1) AS chrom, b AS beg, b + 50 AS end_pos, CAST(1 AS BIGINT) AS n_transcripts FROM ({GENES})")
def written_genes(spark, sf_dir):
    """K6: the table of genes."""
    path = new_path(spark, "genes")
    sinks.write_genes(_genes(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/genes").select("gene_id", "chrom", "beg", F.col("end").alias("end_pos"), "n_transcripts")


@plans.query(f"WITH {SEQ} SELECT 'r' || event_id AS name, seq AS seq1, reverse(seq) AS seq2 FROM s")
def scan_fastq_pairs(spark, sf_dir):
    """S18, S19."""
    s = _seqs(spark, sf_dir).withColumn("q", F.expr("repeat('I', length(seq))"))
    # files in order, by ranges; rows of one id come in the same order in both ends
    s = s.orderBy("event_id", "seq")
    end = lambda k, seq: _lines(s, F.concat_ws("\n", F.format_string(f"@r%d/{k} x", "event_id"), seq, F.lit("+"), "q"))
    return text.fastq_pairs(spark, end(1, F.col("seq")), end(2, F.reverse("seq"))).select("name", "seq1", "seq2")


@plans.query(ctes("reads") + " SELECT rid, 'B' || barcode AS barcode, 'U' || umi AS umi, chrom, pos, cigar FROM reads WHERE strand = '+' AND mapq >= 10")
def scan_sam(spark, sf_dir):
    """Usable records, and the barcode in their names."""
    r = view(spark, sf_dir, "reads").withColumn("qname", F.format_string("%d:B%d:U%d", "rid", "barcode", "umi")).withColumn("flag", F.when(F.col("strand") == "+", 16).otherwise(0x404))
    path = _lines(r, "qname", "flag", "chrom", "pos", "mapq", "cigar", F.lit("*"), F.lit(0), F.lit(0), F.lit("A"), F.lit("I"))
    got = text.sam(spark, path).filter(R.usable(F.col("flag"), F.col("mapq"), 10))
    barcode, umi = R.name_barcode(F.col("qname"))
    return got.select(F.split("qname", ":")[0].cast("long").alias("rid"), barcode.alias("barcode"), umi.alias("umi"), "chrom", "pos", "cigar")


@plans.query("SELECT CASE WHEN count(DISTINCT c_mktsegment) = 1 THEN min(c_mktsegment) END AS sm, max('20' || lpad(CAST(c_custkey % 30 AS VARCHAR), 2, '0')) AS last_date, count(*) AS n_groups FROM customer GROUP BY c_nationkey")
def read_group_reports(spark, sf_dir):
    """Headers of all files of a folder tree."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.concat_ws("\t", F.lit("@RG"), F.concat(F.lit("ID:"), F.col("c_custkey").cast("string")), F.concat(F.lit("SM:"), "c_mktsegment"), F.concat(F.lit("DT:20"), F.lpad((F.col("c_custkey") % 30).cast("string"), 2, "0"))).alias("value"))
    path = new_path(spark, "headers")
    c.repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    return A.read_groups(text.sam_read_groups(spark, path)).drop("file")


@plans.query("SELECT 'g' || (l_partkey + 1) AS gene, 'c' || (l_suppkey + 1) AS barcode, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2")
def scan_mtx(spark, sf_dir):
    """A count matrix and its names."""
    m = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") + 1).alias("i"), (F.col("l_suppkey") + 1).alias("j")).agg(F.count("*").alias("n"))
    m, path = staged(m, "counts"), new_path(spark, "mtx")
    top = m.agg(F.max("i").alias("i"), F.max("j").alias("j"), F.count("*").alias("n"))
    head = top.select(F.format_string("%%%%MatrixMarket matrix\n%%\n%d %d %d", "i", "j", "n").alias("v"))
    # the sizes' file comes first by its number; the others need no order
    _lines(head.coalesce(1).unionByName(m.select(F.concat_ws(" ", F.col("i").cast("string"), F.col("j").cast("string"), F.col("n").cast("string")).alias("v"))), "v", path=f"{path}/matrix.mtx")
    size = top.first()
    # ranges are written in order, a file each
    names = lambda n, p: spark.range(1, (n or 0) + 1, numPartitions=(n or 0) // 500_000 + 1).select(F.concat(F.lit(p), F.col("id").cast("string")).alias("v"))
    _lines(names(size["i"], "g"), "v", "v", path=f"{path}/genes.tsv")
    _lines(names(size["j"], "c"), "v", path=f"{path}/barcodes.tsv")
    return text.matrix_market(spark, path)


@plans.query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def scan_tables(spark, sf_dir):
    """Several tables with one header."""
    c, paths = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), []
    for k in range(3):
        paths.append(new_path(spark, "table"))
        c.filter(F.col("c_custkey") % 3 == k).write.option("sep", "\t").option("header", True).csv(paths[-1])
    a, b, d = text.tables(spark, paths)
    return a.unionByName(b).unionByName(d).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@plans.query("SELECT c_custkey, c_name, c_mktsegment AS kind FROM customer")
def demultiplexed_files(spark, sf_dir):
    """K5: a folder for each key."""
    path = new_path(spark, "keyed")
    sinks.write_by_key(table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("kind")), path, "kind")
    return spark.read.parquet(path).withColumn("kind", F.col("kind").cast("string"))


@plans.query("SELECT 'f' || c_nationkey AS fam, 'i' || c_custkey || ',d' || c_custkey AS ind, CASE WHEN c_custkey % 3 > 0 THEN 'i' || (c_custkey - 1) END AS dad, CAST(c_custkey % 2 + 1 AS INT) AS sex, CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 5 AS VARCHAR) END AS pheno FROM customer")
def scan_ped(spark, sf_dir):
    """S28, K9."""
    k, say = F.col("c_custkey"), lambda p, c: F.concat(F.lit(p), c.cast("string"))
    path = new_path(spark, "ped")
    sinks.write_ped(table(spark, sf_dir, "customer").select(say("f", F.col("c_nationkey")).alias("fam"), F.concat_ws(",", say("i", k), say("d", k)).alias("ind"), F.when(k % 3 > 0, say("i", k - 1)).alias("dad"), F.lit(None).cast("string").alias("mom"), (k % 2 + 1).alias("sex"), F.when(k % 5 > 0, (k % 5).cast("string")).alias("pheno")), path)
    return text.ped(spark, path).select("fam", F.array_join("ind", ",").alias("ind"), F.array_join("dad", ",").alias("dad"), "sex", "pheno")


@plans.query(ctes("pairs") + " SELECT CAST(id1 AS VARCHAR) AS id1, CAST(id2 AS VARCHAR) AS id2, CASE WHEN kin_milli > 400 THEN 'DUP' WHEN kin_milli > 175 AND ibs0_permille < 3.5 THEN 'PO' WHEN kin_milli > 175 THEN 'FS' ELSE 'ETC' END AS rel FROM pairs")
def scan_kinship(spark, sf_dir):
    """The older layout of kinship reports."""
    p, path = view(spark, sf_dir, "pairs"), new_path(spark, "kin")
    p.select(F.col("id1").alias("ID1"), F.col("id2").alias("ID2"), F.format_string("%.4f", F.col("ibs0_permille") / 1000).alias("IBS0"), F.format_string("%.3f", F.col("kin_milli") / 1000).alias("Kinship")).write.option("sep", "\t").option("header", True).csv(path)
    return text.kinship(spark, path)


@plans.query("SELECT 'c' || (p_size % 5) AS chrom, p_partkey AS bp, CAST(p_size AS DOUBLE) AS rate, p_partkey / 100.0 AS cm FROM part")
def scan_genetic_map(spark, sf_dir):
    """S31."""
    p = table(spark, sf_dir, "part")
    return text.genetic_map(spark, _lines(p, F.concat(F.lit("c"), (F.col("p_size") % 5).cast("string")), "p_partkey", "p_size", F.format_string("%.2f", F.col("p_partkey") / 100), sep=" "))


@plans.query("SELECT 'G' || p_partkey AS name1, 'chr' || (p_size % 22 + 1) AS chrom, CAST(2 AS INT) AS n_exons, p_partkey * 10 AS first, p_partkey * 10 + 9 AS last FROM part")
def scan_ref_flat(spark, sf_dir):
    """Genes with trailing commas in their exon lists."""
    k = F.col("p_partkey") * 10
    name, lists = F.format_string("G%d", "p_partkey"), [F.concat_ws(",", (k + a).cast("string"), (k + b).cast("string"), F.lit("")) for a, b in ((0, 5), (2, 9))]
    got = text.ref_flat(spark, _lines(table(spark, sf_dir, "part"), name, name, F.format_string("chr%d", F.col("p_size") % 22 + 1), F.lit("+"), k, k + 9, k, k + 9, F.lit(2), *lists))
    return got.select("name1", "chrom", "n_exons", F.get("starts", 0).alias("first"), F.element_at("ends", -1).alias("last"))


@plans.query("SELECT 'K' || p_partkey AS kmer, p_size / 100.0 AS weight FROM part")
def scan_kmer_weights(spark, sf_dir):
    """Three columns, with header lines to leave out."""
    p = table(spark, sf_dir, "part").select(F.format_string("K%d\tR%d\t%.2f", "p_partkey", "p_partkey", F.col("p_size") / 100).alias("v"))
    return text.kmer_weights(spark, _lines(p.unionByName(spark.createDataFrame([("# c",), ("kmer rc weight",), ("bias 1",)], "v string")), "v"))


@plans.query("SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_custkey IN (1, 5, 9)")
def scan_dictionary(spark, sf_dir):
    """Pairs from a file, ids from a literal and from a file."""
    c = table(spark, sf_dir, "customer")
    pairs = text.dictionary(spark, _lines(c, "c_name", "c_mktsegment"))
    wanted = text.id_list(spark, "1,5,9").join(text.id_list(spark, _lines(c, "c_custkey"), is_file=True), "id", "left_semi")
    return pairs.join(c.join(wanted, c["c_custkey"].cast("string") == wanted["id"], "left_semi").select(F.col("c_name").alias("key")), "key", "left_semi")


@plans.query("SELECT 'v' || n_nationkey AS name, CAST(k AS INT) AS i, CASE WHEN k <> 1 THEN CAST(n_nationkey * 10 + k AS DOUBLE) END AS value FROM nation, unnest(range(0, 3)) t(k)")
def scan_r_vectors(spark, sf_dir):
    """Named vectors with missing values."""
    k = F.col("n_nationkey")
    return text.r_vectors(spark, _lines(table(spark, sf_dir, "nation"), F.format_string("v%d = c(%d,NA,%d)", "n_nationkey", k * 10, k * 10 + 2))).drop("path")


@plans.query("SELECT CAST(n_nationkey AS VARCHAR) AS size, n_name AS name FROM nation")
def scan_reports(spark, sf_dir):
    """A row a file of reports with a line a key."""
    n = table(spark, sf_dir, "nation").withColumn("file", F.col("n_nationkey"))
    rows = n.select("file", F.explode(F.array(F.concat(F.lit("all size "), F.col("n_nationkey").cast("string")), F.concat(F.lit("all name "), F.col("n_name")))).alias("value"))
    path = new_path(spark, "reports")
    rows.repartition("file").write.partitionBy("file").text(path)
    return text.wide_report(text.key_key_value(spark, path), ["size", "name"]).drop("path")


@plans.query("SELECT l_linenumber % 2 || CASE WHEN l_suppkey % 3 > 0 THEN ' 1:' || (l_suppkey % 3) ELSE '' END || CASE WHEN l_partkey % 4 > 0 THEN ' 2:' || (l_partkey % 4) ELSE '' END AS line, count(*) AS n FROM lineitem WHERE l_suppkey % 3 + l_partkey % 4 > 0 GROUP BY 1")
def written_libsvm(spark, sf_dir):
    """K8: lines by how often they occur."""
    path = new_path(spark, "libsvm")
    li = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 2).alias("y"), (F.col("l_suppkey") % 3).alias("a"), (F.col("l_partkey") % 4).alias("b")).filter("a + b > 0")
    sinks.write_libsvm(li, "y", ["a", "b"], path)
    return spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@plans.query("SELECT 's' || p_partkey AS id, CAST(p_size % 22 + 1 AS VARCHAR) AS chrom, p_partkey * 10 AS pos, CASE WHEN p_size % 7 > 0 THEN p_size / 128.0 END AS maf, p_size * 2 AS n FROM part")
def scan_bim_frq(spark, sf_dir):
    """A .bim and the .frq beside it."""
    p = table(spark, sf_dir, "part").select("p_size", F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") % 22 + 1).alias("chrom"), (F.col("p_partkey") * 10).alias("pos"))
    bim = _lines(p, "chrom", "id", F.lit(0), "pos", F.lit("A"), F.lit("C"))
    maf = F.when(F.col("p_size") % 7 > 0, (F.col("p_size") / 128).cast("string")).otherwise("NA")
    frq = _lines(p, F.concat(F.lit(" "), F.col("chrom").cast("string")), "id", F.lit("A"), F.lit("C"), maf, F.col("p_size") * 2, sep="   ")
    return text.site_frequencies(spark, bim, frq).select("id", "chrom", "pos", "maf", F.col("n").cast("long").alias("n"))


@plans.query("SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey < 3")
def scan_numbered(spark, sf_dir):
    """Numbered parts of one table, up to the first that is missing."""
    prefix, n = new_path(spark, "part"), table(spark, sf_dir, "nation")
    for i, region in ((1, 0), (2, 1), (3, 2), (5, 3)):
        _lines(n.filter(F.col("n_regionkey") == region), "n_nationkey", "n_name", path=f"{prefix}{i:03d}.tsv")
    return text.delimited(spark, text.numbered(spark, prefix, ".tsv"), "k long, name string")
