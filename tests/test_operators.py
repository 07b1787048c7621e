"""Hand-made cases: edges of intervals, ties, missing values, and what SQL doesn't check."""

from __future__ import annotations

import random
from collections import Counter
from statistics import NormalDist

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from strandlake.functions import genotype, sequence, variant
from strandlake.operators import aggregates, classify, counting, graph, intervals, joins, likelihood, ordered, pedigree


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_touching_intervals_join_and_complement_is_its_own_inverse(spark):
    iv = spark.createDataFrame([("1", 0, 5), ("1", 5, 9), ("1", 20, 30), ("1", 22, 25), ("2", 3, 4), ("2", 3, 4)], "chrom string, beg long, end long")
    sizes = spark.createDataFrame([("1", 40), ("2", 10)], "chrom string, size long")
    merged = intervals.merged(iv)
    assert rows(merged) == [("1", 0, 9), ("1", 20, 30), ("2", 3, 4)]
    gaps = intervals.inverted(iv, sizes)
    assert rows(gaps) == [("1", 9, 20), ("1", 30, 40), ("2", 0, 3), ("2", 4, 10)]
    assert rows(intervals.inverted(gaps, sizes)) == rows(merged)


def test_equal_intervals_are_one_in_whatever_order_they_come(spark, monkeypatch):
    iv = spark.createDataFrame([("1", 10 * k, 10 * k + 4) for k in range(40)] * 3, "chrom string, beg long, end long")
    # a plan that Spark may choose: the intervals are broadcast, and equal ones leave the join in another order
    monkeypatch.setattr(type(iv), "join", lambda self, *a, f=type(iv).join: f(self.hint("broadcast"), *a))
    assert rows(intervals.merged(iv)) == [("1", 10 * k, 10 * k + 4) for k in range(40)]


def test_point_join_is_half_open_or_closed(spark):
    iv = spark.createDataFrame([("1", 10, 20)], "chrom string, beg long, end long")
    p = spark.createDataFrame([("1", x) for x in (9, 10, 19, 20, 21)], "chrom string, pos long")
    assert [r[1] for r in rows(intervals.points_in(p, iv, 4))] == [10, 19]
    assert [r[1] for r in rows(intervals.points_in(p, iv, 4, closed=True))] == [10, 19, 20]


def test_row_numbers_follow_the_order(spark):
    df = spark.createDataFrame([(i, (i * 7919) % 501) for i in range(500)], "k long, v long")
    got = ordered.with_row_number(df, ["v", "k"]).orderBy("row_no").collect()
    assert [r["row_no"] for r in got] == list(range(1, 501))
    assert [(r["v"], r["k"]) for r in got] == sorted((r["v"], r["k"]) for r in got)


def test_duplicate_keys_fail(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "id long, x string")
    with pytest.raises(Exception, match="duplicate key"):
        joins.tsv_join([df, df], "id", check=True).collect()


def test_dictionary_miss_fails(spark):
    df, d = spark.createDataFrame([("a",)], "key string"), spark.createDataFrame([("b", "x")], "key string, v string")
    with pytest.raises(Exception, match="no value for a"):
        joins.lookup_or_default(df, d, "key", "v", "out", required=True).collect()


def test_conflicting_barcodes_fail(spark):
    t = spark.createDataFrame([("AC", "1"), ("AC", "2")], "code string, id string")
    with pytest.raises(Exception, match="conflict"):
        joins.fuzzy_barcodes(t, "code", "id").collect()


def test_degeneracies_follow_the_code(spark):
    for codon in ("GCT", "ATG", "TTA", "NNN"):
        got = one(spark, sequence.degeneracies(F.lit(codon)))
        want = []
        for k in range(3):
            own = sequence.CODONS.get(codon)
            same = sum(sequence.CODONS[codon[:k] + b + codon[k + 1 :]] == own for b in "ACGT") if own else -1
            want.append(0 if same == 1 else same)
        assert got == want


def test_info_and_genotype_parsing(spark):
    info = F.lit("AC=3;DB;AF=1e-2;AC=9")
    assert one(spark, variant.info_value(info, "AC")) == "3"
    assert one(spark, variant.info_value(info, "C")) is None
    assert one(spark, variant.info_map(info)) == {"AC": "3", "DB": "1", "AF": "1e-2"}
    assert one(spark, variant.feature(info, "AF")) == 0.01
    assert [one(spark, genotype.gt_code(F.lit(g))) for g in ("./.", "0/0", "0|1", "1/2", ".", "1")] == [0, 1, 2, 3, 0, 3]
    assert one(spark, variant.parse_region(F.lit("chrX:1,000-2,000"))[2]) == 2000


def test_tandem_shifts_match_plain_python(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACG") for _ in range(40)) for _ in range(5)] + ["ACACACACAC", "N", ""]
    want = Counter()
    for s in seqs:
        for i, c in enumerate(s):
            for j in range(1, 4):
                if c != "N" and i + j < len(s):
                    k = m = 0
                    while k < 5 and i - k - 1 >= 0 and s[i - k - 1] == s[i + j - k - 1]:
                        k += 1
                    while m < 5 and i + j + m < len(s) and s[i + j + m] == s[i + m]:
                        m += 1
                    want[j, k + m] += 1
    df = spark.createDataFrame([(s,) for s in seqs], "seq string")
    assert {(r["j"], r["shift"]): r["n"] for r in counting.tandem_shifts(df, "seq", 3, 5).collect()} == dict(want)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(rows(graph.components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    written, keep = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, label: written.append(label) or keep(df, label))
    edges = [(100 * c, 100 * c + i) for c in range(5) for i in range(1, 20)]
    got = dict(rows(graph.components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {v: u for u, v in edges} and len(written) == 1


def test_pedigree(spark):
    edges = spark.createDataFrame([(1, 2, "PO"), (1, 3, "PO"), (4, 5, "PO"), (4, 6, "PO"), (5, 6, "FS"), (1, 9, "DUP")], "id1 long, id2 long, rel string")
    sexes = spark.createDataFrame([(i, 1 + i % 2) for i in range(1, 10)], "id long, sex int")
    assert rows(pedigree.families(edges, sexes)) == [(1, 2, 3)]
    assert dict(rows(pedigree.duplicate_sets(edges)))[9] == 1


def test_hwe_matches_plain_python(spark):
    rng = random.Random(5)
    pls = [[(rng.randint(0, 60), rng.randint(0, 60), rng.randint(0, 60)) for _ in range(8)] for _ in range(4)]
    for v in pls:
        v[0] = (0, 10, 20)
    df = spark.createDataFrame([(v, s, *pl) for v, x in enumerate(pls) for s, pl in enumerate(x)], "vid int, sample int, pl0 int, pl1 int, pl2 int")
    got = likelihood.hardy_weinberg(likelihood.by_variant(df, ["vid"], "sample"), ["vid"]).orderBy("vid").collect()
    for r, x in zip(got, pls, strict=True):
        ls = [[10 ** (-p / 10) for p in t] for t in x]
        n = [sum(t[i] == 0 for t in x) for i in range(3)]
        af = (n[1] + 2 * n[2]) / sum(n) / 2
        g = ((1 - af) ** 2, 2 * af * (1 - af), af * af)
        for _ in range(100):
            prior = ((1 - af) ** 2, 2 * af * (1 - af), af * af)
            s, sums = 0.0, [0.0] * 3
            for t in ls:
                a, b, c = (p * q for p, q in zip(t, prior, strict=True))
                s += (b + 2 * c + 1e-30) / (a + b + c + 1e-30)
                f = [p * q for p, q in zip(t, g, strict=True)]
                sums = [y + (z + 1e-30) / (sum(f) + 3e-30) for y, z in zip(sums, f, strict=True)]
            was, old = af, g
            af, g = (s + 1e-6) / (2 * len(ls) + 2e-6), [(y + 1e-10) / (len(ls) + 3e-10) for y in sums]
            if (af - was) ** 2 + (g[1] - old[1]) ** 2 + (g[2] - old[2]) ** 2 <= 1e-4:
                break
        assert abs(r["af"] - af) < 2e-6 and abs(r["gf1"] - g[1]) < 2e-6


def test_ordered_passes_over_many_ranges(spark):
    rng = random.Random(9)
    iv = [(c, b, b + rng.randint(1, 40)) for c in "12" for b in (rng.randint(0, 3000) for _ in range(150))] + [("1", 100, 900), ("3", 5, 6)]
    df = spark.createDataFrame(iv, "chrom string, beg long, end long")
    want = []
    for c, b, e in sorted(iv):
        if want and want[-1][0] == c and b <= want[-1][2]:
            want[-1] = (c, want[-1][1], max(e, want[-1][2]))
        else:
            want.append((c, b, e))
    sizes = spark.createDataFrame([(c, 4000) for c in "123"], "chrom string, size long")
    for width in (7, 64, 1 << 20):
        assert rows(intervals.merged(df, width=width)) == want
        assert rows(intervals.inverted(intervals.inverted(df, sizes, width=width), sizes, width=width)) == want
    t = spark.createDataFrame([("a", x, float(x * x)) for x in (10, 500, 520, 3000)], "k string, tx long, ty double")
    p = spark.createDataFrame([("a", x) for x in (5, 10, 11, 499, 500, 510, 2999, 3000, 3001)] + [("b", 7)], "k string, x long")
    one_range = rows(intervals.interpolated(p, t, ["k"], "x", "tx", "ty").select("k", "x", "y").fillna(-1))
    assert one_range == rows(intervals.interpolated(p, t, ["k"], "x", "tx", "ty", 16).select("k", "x", "y").fillna(-1))
    assert [r[2] for r in one_range] == pytest.approx([-1, 100, 100 + (250000 - 100) / 490, 250000 - (250000 - 100) / 490, 250000, 260200, 9e6 - (9e6 - 270400) / 2480, 9e6, -1, -1])


def test_sampling_keeps_the_stated_share(spark):
    pos = spark.range(300).select(F.lit(1).alias("b"), "id")
    neg = spark.range(3000).select(F.lit(1).alias("b"), "id")
    n = aggregates.matched_sample(pos, neg, "b", ["id"]).count()
    assert 230 < n < 370
    assert aggregates.matched_sample(neg, pos, "b", ["id"]).count() == 300


def test_inverse_normal_is_symmetric(spark):
    got = classify.inverse_normal(spark.range(101).select(F.col("id").cast("double").alias("x")), ["x"]).orderBy("x").collect()
    z = [r["x_norm"] for r in got]
    assert abs(z[50]) < 1e-9 and all(abs(a + b) < 1e-9 for a, b in zip(z, reversed(z), strict=True)) and z == sorted(z)


def test_prefix_merge_follows_chains(spark):
    h = spark.createDataFrame([(8, "AAAAAAAA", 100, 900), (9, "AAAAAAAAC", 40, 300), (9, "AAAAAAAAG", 20, 200)], "len int, prefix string, c0 long, c1 long")
    assert [r["prefix"] for r in counting.collapsing_prefixes(h).collect()] == ["AAAAAAAA"]
    m = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a")], "k string, to string")
    assert dict(rows(counting.resolved(m, "k", "to"))) == {"b": "a", "c": "a", "d": "a"}


def test_genomic_order_follows_ordinals(spark):
    d = spark.createDataFrame([("chrX", 1), ("10", 5), ("chr2", 9), ("chr2", 3), ("odd", 1), ("chrM", 2), (None, 4)], "chrom string, pos long")
    got = ordered.genomic_sort(d)
    assert got.columns == ["chrom", "pos"]
    known = [tuple(r) for r in got.collect() if r["chrom"] not in (None, "odd")]
    assert known == [("chr2", 3), ("chr2", 9), ("10", 5), ("chrX", 1), ("chrM", 2)]


def test_inverse_normal_equals_the_quantile(spark):
    values = [3.0, 1.0, 1.0, 7.0, 5.0, 5.0, 5.0, 9.0]
    got = dict(classify.inverse_normal(spark.createDataFrame([(v,) for v in values], "x double"), ["x"]).distinct().collect())
    for v, z in got.items():
        rank = sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2
        assert abs(z - NormalDist().inv_cdf((rank - 0.5) / len(values))) < 1e-7


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(-40, 40)), max_size=12), st.lists(st.tuples(st.integers(0, 50), st.integers(-40, 40)), min_size=1, max_size=6))
def test_map_extension_equals_the_product(spark, points, regions):
    """Maps that don't grow with x, ties and regions beyond the map's ends as well."""
    m = spark.createDataFrame([("a", x, y / 8) for x, y in points], "k string, x long, y double")
    r = spark.createDataFrame([("a", lo, lo + 3, y / 8, y / 8 + 0.5) for lo, y in regions] + [("b", 1, 2, None, 0.0)], "k string, lo long, hi long, ylo double, yhi double")
    want = [("a", lo, lo + 3, min([lo, *(x for x, v in points if v > y - 4)]), max([lo + 3, *(x for x, v in points if v < y + 8)])) for lo, y in regions]
    assert rows(intervals.extended(r, m, ["k"], 0.5, 1.0)) == sorted([*want, ("b", 1, 2, 1, 2)])


def test_streams_drop_late_rows(spark, tmp_path):
    """The last file's first row comes days behind the first file's last: its tile is closed. Rows are late
    from the batch on that follows the one which moved the watermark."""
    import os

    from strandlake.streaming import events as E

    for i, ids in enumerate(([0, 9000], [9001], [10, 9002])):
        df = spark.createDataFrame([(k, "u") for k in ids], "event_id long, user string").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 60))
        df.toPandas().astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / f"events.parquet{i}")
        os.utime(tmp_path / f"events.parquet{i}", (1_000_000 + i * 100, 1_000_000 + i * 100))
    schema = spark.read.parquet(str(tmp_path / "events.parquet0")).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    per_id = rows(E.run_available(E.deduplicated(stream(), ["event_id"], "1 hour")).select("event_id"))
    assert per_id == [(0,), (9000,), (9001,), (9002,)]
    reads = stream().select(F.lit(1).alias("chrom_no"), F.col("event_id").alias("pos"), F.lit("+").alias("strand"))
    # 10 comes late, the last places are still open
    assert rows(E.run_available(E.pileup(reads, 100))) == [(1, 0, 1, 0)]


def test_principal_axes_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, (20, 4)).astype(float)
    m = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(20) for j in range(4) if x[i, j]], "cell long, gene long, v double")
    got = {r["cell"]: r["pc"] for r in classify.principal_axes(m, [0, 1, 2, 3], "gene", "cell", "v", 2).collect()}
    axes = np.linalg.svd(x - x.mean(0))[2][:2]
    for i in range(20):
        assert np.allclose(np.abs(x[i] @ axes.T), np.abs(got[i]), atol=1e-8)


def test_spread_follows_the_rows(spark):
    from strandlake.storage import spread

    df = spark.range(100)
    assert spread(df, 100, "id").rdd.getNumPartitions() == 4 and spread(df, 100, "id", per_task=10).rdd.getNumPartitions() == 10


def test_pairs_are_shuffled_once_by_variant(spark, sf_dir):
    from strandlake.plans import genotypes, values

    for q in (genotypes.geno_confusion_snp, values.pair_masks):
        plan = q(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 2


def test_interpolation_sorts_by_tasks_that_follow_the_rows(spark):
    t = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 2.0)], "k string, tx long, ty double")
    p = spark.range(20).select(F.lit("a").alias("k"), F.col("id").alias("x"))
    plan = intervals.interpolated(p, t, ["k"], "x", "tx", "ty", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1


def test_region_means_meet_places_once(spark):
    s = spark.createDataFrame([("1", 5, 1.0)] * 50 + [("1", 6, 4.0), ("1", 7, None), ("1", 90, None)], "chrom string, pos long, score double")
    r = spark.createDataFrame([("1", 0, 10), ("1", 7, 9), ("1", 80, 99)], "chrom string, beg long, end long")
    plan = intervals.region_mean(r, s, 8)
    assert rows(plan.fillna(-1.0)) == [("1", 0, 10, 54 / 51, 52), ("1", 7, 9, -1.0, 1), ("1", 80, 99, -1.0, 1)]
    assert "sum(score" in plan._jdf.queryExecution().optimizedPlan().toString()
