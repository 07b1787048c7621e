"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

from __future__ import annotations

import tracemalloc

import brute
import numpy as np
import pyarrow as pa

import corpus_pipeline
from strandlake.llm import bytewords, toxicity
from strandlake.llm.common import staged, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, sf_dir), name)
        before, after = {r.doc_id: r for r in docs.collect()}, out.collect()
        if name != "packing":
            assert out.columns == columns and len({r.doc_id for r in after}) == len(after)
        if name == "toxicity":
            model = toxicity.train(docs, table(spark, sf_dir, "labels"))
            low = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < 0.5}
            assert {r.doc_id for r in after} == low
        elif name == "near_duplicates":
            assert {r.doc_id for r in after} == set(brute.near_classes([(r.doc_id, r.text) for r in before.values()]).values())
        elif name == "decontamination":
            hit = {x[0]: x for x in brute.contamination([(r.doc_id, r.text) for r in before.values()], items)}
            for r in after:
                assert len(brute.words(r.text)) == hit[r.doc_id][1] - hit[r.doc_id][2]
                assert hit[r.doc_id][5] or r == before[r.doc_id]
            assert {i for i, x in hit.items() if x[2] <= 0.5 * x[1]} == {r.doc_id for r in after}
        elif name == "secrets":
            assert {r.doc_id for r in after} == set(before)
            for r in after:
                found = brute.secret_spans(before[r.doc_id].text)[4]
                assert bool(found) == ("[REDACTED]" in r.text) and (found or r == before[r.doc_id])
        else:
            assert {r.doc_id for r in after} == set(before)
        docs = out


def test_toxicity_holds_arrays_of_small_slices_only():
    texts = pa.array(["Some words are said here. You are a fool! " * 40, None, "", "ein Wort " * 900] * 400)
    toxic = np.arange(len(texts)) % 4 == 0
    model = toxicity.fit(texts.slice(0, 40), toxic[:40])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    parts = list(bytewords.parts(batch, 1 << 16))
    assert pa.concat_arrays([p.column("text") for p in parts]).equals(texts)
    assert max(sum(len(t or "") for t in p.column("text").to_pylist()) for p in parts) <= 1 << 16
    tracemalloc.start()
    got = toxicity.score_texts(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 << 20
    assert np.array_equal(got["score"], np.concatenate([toxicity.score_texts(model, p.column("text"))["score"] for p in parts]))


def test_features_of_small_slices_are_summed():
    texts = pa.array([f"word{i % 7} stays, word{i} goes" for i in range(500)])
    toxic = (np.arange(500) % 3 == 0).astype(np.int64)
    slices = [part for i in range(0, 500, 50) for part in toxicity.occurrences(texts.slice(i, 50), toxic[i : i + 50])]
    for want, got in zip(next(toxicity.occurrences(texts, toxic)), toxicity.summed(list(toxicity.gathered(iter(slices), 200))), strict=True):
        assert np.array_equal(want, got)
    assert len(list(toxicity.gathered(iter(slices)))) == 1 < len(list(toxicity.gathered(iter(slices), 200))) < len(slices)
