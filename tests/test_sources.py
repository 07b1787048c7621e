"""Round trips and small files of every format."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pytest

from strandlake.sources import binary, sinks, text


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(path, content):
    (path.write_bytes if isinstance(content, bytes) else path.write_text)(content)
    return str(path)


def test_vcf(spark, tmp_path):
    body = "##fileformat=VCFv4.2\n##FILTER=<ID=SVM,Description=x>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n1\t10\t.\tA\tC,T\t.\tPASS\tAC=1\tGT:PL\t0/1:1,0,9\t./.\n2\t20\trs1\tAT\tA\t5\tSVM\tDB\tGT\t1|1\t0/0\n"
    (tmp_path / "a.vcf.gz").write_bytes(gzip.compress(body.encode()))
    path = str(tmp_path / "a.vcf.gz")
    head = text.vcf_header(spark, path)
    assert head["samples"] == ["s1", "s2"] and head["filters"] == ["SVM"]
    sites = text.vcf(spark, path)
    assert [(r.chrom, r.pos, r.alt) for r in sites.orderBy("pos").collect()] == [("1", 10, "C,T"), ("2", 20, "A")]
    assert text.vcf(spark, path, "2:1-20").count() == 1
    assert text.vcf_genotypes(sites, head["samples"]).filter("cell = '1|1'").first()["sample"] == "s1"
    sinks.write_vcf(sites, str(tmp_path / "out"), head["meta"])
    assert text.vcf(spark, str(tmp_path / "out/body")).count() == 2


def test_fasta_across_lines(spark, tmp_path):
    fa = put(tmp_path / "a.fa", ">1\nACGTA\nCGTNN\nAC\n>2\nTTTTT\nG\n")
    fai = put(tmp_path / "a.fa.fai", "1\t12\t3\t5\t6\n2\t6\t21\t5\t6\n")
    chunks = text.fasta(spark, fa, fai).persist()
    assert text.sequence_of(chunks, "1", 4, 11).first()["seq"] == "TACGTNNA"
    assert text.sequence_of(chunks, "2", 5, 6).first()["seq"] == "TG"


def test_fastq_pairs(spark, tmp_path):
    a = put(tmp_path / "1.fq", "@r1/1 x\nACGT\n+\nIIII\n@r2/1\nAC\n+\nII\n")
    b = put(tmp_path / "2.fq", "@r1/2\nGG\n+\n##\n@r2/2\nTT\n+\n##\n")
    assert rows(text.fastq_pairs(spark, a, b).select("name", "seq1", "seq2")) == [("r1", "ACGT", "GG"), ("r2", "AC", "TT")]
    c = put(tmp_path / "3.fq", "@q1/2\nGG\n+\n##\n@r2/2\nTT\n+\n##\n")
    with pytest.raises(Exception, match="names differ"):
        text.fastq_pairs(spark, a, c).collect()


def test_gtf_and_gene_pred(spark, tmp_path):
    line = '1\tx\t{f}\t{a}\t{b}\t.\t+\t.\tgene_id "g1"; gene_name "N"; transcript_id "t1";\n'
    path = put(tmp_path / "a.gtf", "#c\n" + "".join(line.format(f=f, a=a, b=b) for f, a, b in [("exon", 30, 40), ("exon", 1, 10), ("CDS", 5, 10)]))
    model = text.gene_model(text.gtf(spark, path))
    r = text.gene_pred(model).first()
    assert (r.tx_start, r.tx_end, r.cds_start, r.cds_end, r.n_exons, r.exon_starts, r.exon_ends) == (0, 40, 4, 10, 2, "0,29,", "10,40,")


def test_ped_kin_bed_dictionaries(spark, tmp_path):
    p = text.ped(spark, put(tmp_path / "a.ped", "f k,k2 d 0 1 -9\n")).first()
    assert (p.ind, p.dad, p.mom, p.sex, p.pheno) == (["k", "k2"], ["d"], None, 1, None)
    new = put(tmp_path / "n.kin0", "FID1\tID1\tFID2\tID2\tInfType\n1\ta\t2\tb\tDup/MZ\n1\ta\t2\tc\tUN\n")
    old = put(tmp_path / "o.kin0", "ID1\tID2\tIBS0\tKinship\na\tb\t0.0\t0.2\nb\tc\t0.01\t0.2\n")
    assert rows(text.kinship(spark, new)) == [("a", "b", "DUP"), ("a", "c", "ETC")]
    assert rows(text.kinship(spark, old)) == [("a", "b", "PO"), ("b", "c", "FS")]
    assert rows(text.bed(spark, put(tmp_path / "a.bed", "1\t0\t5\tx y\n")))[0][:3] == ("1", 0, 5)
    assert rows(text.dictionary(spark, put(tmp_path / "d", "# c\na  b\n"))) == [("a", "b")]
    assert rows(text.kmer_weights(spark, put(tmp_path / "w", "#c\nkmer w\nbias 1\nAAA TTT 0.5\n"))) == [("AAA", 0.5)]
    assert [r.value for r in text.r_vectors(spark, put(tmp_path / "r", "x = c(1,NA,3)\n")).orderBy("i").collect()] == [1.0, None, 3.0]


def test_matrix_market(spark, tmp_path):
    put(tmp_path / "matrix.mtx", "%%MatrixMarket\n%\n2 2 2\n1 2 5\n2 1 7\n")
    put(tmp_path / "genes.tsv", "g1\tn1\ng2\tn2\n")
    put(tmp_path / "barcodes.tsv", "AA\nCC\n")
    assert rows(text.matrix_market(spark, str(tmp_path))) == [("g1", "CC", 5.0), ("g2", "AA", 7.0)]


def test_sam(spark, tmp_path):
    p = put(tmp_path / "a.sam", "@HD\tVN:1\n@RG\tID:1\tSM:s\tDT:2020\nq:AC:GG\t16\t1\t5\t60\t3M\t*\t0\t0\tACG\tIII\n")
    assert text.sam(spark, p).first()["pos"] == 5
    assert text.sam_read_groups(spark, p).first()["sm"] == "s"


def test_plink_with_a_ragged_last_byte(spark, tmp_path):
    # five samples: codes 1 2 3 0 1 and 3 3 3 3 3
    bits = {1: 0b00, 2: 0b10, 3: 0b11, 0: 0b01}
    def pack(gs):
        out = bytearray(2)
        for i, g in enumerate(gs):
            out[i // 4] |= bits[g] << 2 * (i % 4)
        return bytes(out)

    put(tmp_path / "a.bed", bytes([0x6C, 0x1B, 1]) + pack([1, 2, 3, 0, 1]) + pack([3] * 5))
    put(tmp_path / "a.bim", "1 rs1 0 10 A C\n1 rs2 0 20 G T\n")
    put(tmp_path / "a.fam", "".join(f"f i{k} 0 0 1 -9\n" for k in range(5)))
    got = binary.plink(spark, str(tmp_path / "a"), step=1)
    assert [r.g for r in got.filter("variant = 0").orderBy("sample").collect()] == [1, 2, 3, 0, 1]
    assert got.filter("g = 3").count() == 6


def test_fbin_slice(spark, tmp_path):
    p = put(tmp_path / "a.fbin", np.arange(10, dtype="<f4").tobytes())
    assert [tuple(r) for r in binary.fbin(spark, p, 3, 6).orderBy("pos0").collect()] == [(3, 3.0), (4, 4.0), (5, 5.0)]


def test_idat_and_cel(spark, tmp_path):
    n, head = 2, 16 + 10 * 6
    blocks = [(1000, struct.pack("<I", n)), (102, struct.pack("<2I", 7, 8)), (103, struct.pack("<2H", 1, 2)), (104, struct.pack("<2H", 300, 400)), (107, bytes([9, 10])), (200, struct.pack("<3I", 2, 70, 80))]
    data, at = b"", head
    index = b""
    for code, body in blocks:
        index += struct.pack("<HQ", code, at)
        data += body
        at += len(body)
    p = put(tmp_path / "a.idat", b"IDAT" + struct.pack("<III", 3, 0, len(blocks)) + index + data)
    assert rows(binary.idat(spark, p).drop("path")) == [(7, 1, 300, 9, 70), (8, 2, 400, 10, 80)]
    cel = struct.pack("<iiiiii", 64, 4, 2, 1, 2, 0) + struct.pack("<ii", 0, 0) + bytes(16) + struct.pack("<ffh", 5.5, 1.25, 3) + struct.pack("<ffh", 6.0, 2.0, 4)
    assert binary.parse_cel(cel) == [(0, 0, 5.5, 1.2, 3), (1, 0, 6.0, 2.0, 4)]
    assert binary.parse_cel(b"[HEADER]\nCols=2\n[INTENSITY]\nNumberCells=1\nCellHeader=X\n 0 1 5.0 1.0 9\n") == [(0, 1, 5.0, 1.0, 9)]
    assert rows(binary.cel(spark, put(tmp_path / "a.cel", cel)).drop("path"))[0] == (0, 0, 5.5, 1.2, 3)


def test_numbered_files_stop_at_the_first_gap(spark, tmp_path):
    for i in (1, 2, 4):
        put(tmp_path / f"p{i:03d}.tsv", f"{i}\n")
    assert [f[-8:] for f in text.numbered(spark, f"{tmp_path}/p", ".tsv")] == ["p001.tsv", "p002.tsv"]
    assert text.numbered(spark, f"{tmp_path}/q", ".tsv") == []


def test_matrix_and_names_in_several_files(spark, tmp_path):
    for name, parts in {"matrix.mtx": ["%%MatrixMarket\n%\n3 2 3\n", "1 2 5\n2 1 7\n", "3 1 1\n"], "genes.tsv": ["g1\tx\n", "g2\tx\ng3\tx\n"], "barcodes.tsv": ["AA\n", "CC\n"]}.items():
        (tmp_path / name).mkdir()
        for i, part in enumerate(parts):
            put(tmp_path / name / f"part-{i}", part)
    assert rows(text.matrix_market(spark, str(tmp_path))) == [("g1", "CC", 5.0), ("g2", "AA", 7.0), ("g3", "AA", 1.0)]


def test_scan_mtx_writes_its_matrix_by_many_tasks(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from pyspark.sql import functions as F

    from strandlake.plans import formats

    monkeypatch.setattr(formats, "new_path", lambda spark, label: f"{tmp_path}/{label}")
    many = spark.range(1000).repartition(4).select((F.col("id") % 50).alias("l_partkey"), (F.col("id") % 7).alias("l_suppkey"))
    monkeypatch.setattr(formats, "table", lambda *a: many)
    monkeypatch.setattr(formats, "staged", lambda df, label: df.repartition(3), raising=False)
    assert formats.scan_mtx(spark, "").count() == 350
    assert len(list(Path(f"{tmp_path}/mtx/matrix.mtx").glob("part-*"))) > 2


def test_fastq_pairs_over_several_files_and_splits(spark, tmp_path):
    record = lambda k, end: f"@r{k}/{end} x\n{'ACGT'[k % 4] * (k % 9 + 1)}\n+\n{'@' * (k % 9 + 1)}\n"
    for end, cuts in ((1, [0, 700, 701, 2000]), (2, [0, 1200, 2000])):
        (tmp_path / str(end)).mkdir()
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            put(tmp_path / str(end) / f"part-{i}", "".join(record(k, end) for k in range(lo, hi)))
    put(tmp_path / "1" / "part-9", "@cut/1\nAC\n")  # not a whole record
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5003")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "101")
        got = text.fastq_pairs(spark, str(tmp_path / "1"), str(tmp_path / "2")).orderBy("record").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [(r.record, r["name"]) for r in got] == [(k, f"r{k}") for k in range(2000)]
    assert all(r.seq1 == r.seq2 == "ACGT"[k % 4] * (k % 9 + 1) and set(r.q1) == {"@"} for k, r in enumerate(got))
