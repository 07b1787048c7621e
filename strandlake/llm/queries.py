"""The ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.llm import decontaminate, langid, licenses, media, neardup, oracles, packing, secrets, sharding, substrings, toxicity
from strandlake.llm.common import table


def op1_secret_scan(spark, sf_dir):
    """Secrets in every whole text: counts and a digest of the base spans, and all spans."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark, sf_dir):
    """Language of every whole text by PPM code lengths, learnt from ids that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op3_toxicity(spark, sf_dir):
    """Toxicity of every whole text by noisy-or over its sentences, and where the offending ones are."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    spans = F.transform("offending", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return scored.withColumn("offending", F.array_join(spans, ","))


def op4_sharding(spark, sf_dir):
    """Shard and slot of every document by a Feistel permutation of row numbers (law ``rows``)."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_license_scan(spark, sf_dir):
    """Licence passages of every whole text, by trained classifier and templates."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(docs))


def op6_near_duplicates(spark, sf_dir):
    """Class of every document by ProbMinHash, banding and exact verification."""
    return neardup.classes(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark, sf_dir):
    """Passages that repeat anywhere, by content-defined chunks: every occurrence, and the first."""
    return substrings.repeats(table(spark, sf_dir, "documents"))


def op8_media_columns(spark, sf_dir):
    """Payload, place in tar shards, header fields and features of every document."""
    return media.media(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark, sf_dir):
    """Words of every whole text that lie in windows of the benchmark."""
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark, sf_dir):
    """Pieces of every document in sequences of at most 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_secret_scan, op2_language_id, op3_toxicity, op4_sharding, op5_license_scan, op6_near_duplicates, op7_repeated_passages, op8_media_columns, op9_decontaminate, op10_packing)}


def oracle_sql():
    """The others are beyond SQL (trained models, sketches, tokenisers, crc32, file formats)."""
    return dict(oracles.SQL)
