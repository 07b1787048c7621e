"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence with features f has the chance p = sigmoid(b + sum of w[f]); a document is toxic if any
sentence is: P = 1 - prod(1 - p) (noisy-or). Only documents have labels, so b and w are fitted to
those through P; what the sentences then score on their own locates the offending ones. Features
are the sentence's words and the words' first bytes (``PREFIXES``), as sets.

The model is fitted on a bounded sample of labelled documents: ``max_docs`` of those allowed for
learning (crc32 of the id modulo 5 is not 0), the first by a hash of the id, with their whole texts. These are
read where they lie: the driver gets the features that go with label 1, and for each document the
sentences that have any of them, but no text. The model is a few thousand numbers. Scoring reads every whole text once, in
slices, without a shuffle.

Defined cases: a null or empty text has no sentence and scores 0; repeated rows each get their
score; labels that are null are left out, an id with several labels counts as toxic if one is;
without a toxic or a clean label every score is 0; an empty table gives no rows; extra columns are
left out of ``score`` and kept by ``reject``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm import bytewords as B
from strandlake.llm.common import staged

MAX_DOCS, MIN_DOCS, LEAST_Z = 6000, 4, 3.0
PREFIXES = (4, 5)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, n_offending long, worst_start long, worst_end long, worst_score double, offending array<struct<start:long,end:long,score:double>>"


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.near = np.zeros(1 << 16, bool)  # of the hashes' high bits; spares most searches
        self.near[(self.features >> np.uint64(48)).astype(np.int64)] = True

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in h of the model's features, and which they are."""
        at = np.flatnonzero(self.near[(h >> np.uint64(48)).astype(np.int64)])
        k = np.searchsorted(self.features, h[at])
        k[k == len(self.features)] = 0
        ok = self.features[k] == h[at] if len(self.features) else np.zeros(len(at), bool)
        return at[ok], k[ok]


#: Where labels don't differ there is nothing to learn: no sentence is toxic.
NONE = Model(np.zeros(1, np.uint64), np.zeros(1), -60.0)


def softplus(z):
    return np.logaddexp(0.0, z)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hash, sentence) of all words and prefixes, and the sentences' starts. Sentences
    without words count as well."""
    h, start, end, _ = B.words(data, offsets)
    sent = B.sentences(data, offsets)
    of = np.searchsorted(sent, start, "right") - 1
    hs, ofs = [h], [of]
    if len(h):
        low = B.LOW[data]
        p, inv = B.powers(len(data))
        total = np.concatenate([[np.uint64(0)], np.cumsum(B.VALUES[low] * p[: len(data)])])
        for k in PREFIXES:
            long = end - start > k
            s = start[long]
            hs.append(B.mix((total[s + k] - total[s]) * inv[s] + np.uint64(1_000_003 * k)))
            ofs.append(of[long])
    return np.concatenate(hs), np.concatenate(ofs), sent


def _slices(texts: pa.Array, of: Model | None = None) -> Iterator[tuple]:
    """(feature, sentence, sentences' texts, first text, text after the last) of a slice of the texts at a
    time; of the features of ``of`` only, by their place in it, if it is given."""
    data, offsets = B.buffers(texts)
    for i, j in B.slices(offsets, B.SMALL_BYTES):
        own = offsets[i : j + 1] - offsets[i]
        h, sent, starts = features(data[offsets[i] : offsets[j]], own)
        if of is not None:
            at, h = of.known(h)
            sent = sent[at]
        yield h, sent, np.searchsorted(own, starts, "right") - 1 + i, i, j


def occurrences(texts: pa.Array, toxic: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(feature, documents that have it, toxic ones of these), a slice at a time."""
    for h, sent, doc, _, _ in _slices(texts):
        names, f = np.unique(h, return_inverse=True)
        pair = np.unique(doc[sent].astype(np.int64) * max(1, len(names)) + f)
        f, y = pair % max(1, len(names)), toxic[pair // max(1, len(names))]
        yield names, np.bincount(f, minlength=len(names)), np.bincount(f, weights=y, minlength=len(names)).astype(np.int64)


def summed(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``occurrences`` gives, of several slices together."""
    h, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return h, *(np.bincount(of, weights=np.concatenate([p[k] for p in parts]), minlength=len(h)).astype(np.int64) for k in (1, 2))


def gathered(parts: Iterator[tuple], most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``summed`` of slices that have ``most`` features or a little more, so that small slices give no more rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= most:
            yield summed(held)
            held, n = [], 0
    if held:
        yield summed(held)


def sentences(texts: pa.Array, kept: Model) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per text: how many sentences it has, and the (sentence, feature) pairs of the kept features."""
    for f, sent, doc, i, j in _slices(texts, kept):
        size = np.bincount(doc - i, minlength=j - i)
        first = np.concatenate([[0], np.cumsum(size)])
        pair = np.unique(sent.astype(np.int64) * len(kept.features) + f)
        sent, f = pair // len(kept.features), pair % len(kept.features)
        cut = np.searchsorted(sent, first)
        for k in range(j - i):
            yield int(size[k]), (sent[cut[k] : cut[k + 1]] - first[k]).astype(np.int32), f[cut[k] : cut[k + 1]].astype(np.int32)


def _kept(h: np.ndarray, df: np.ndarray, dp: np.ndarray, share: float) -> np.ndarray:
    """Features that go with label 1; if there are none, the first that a toxic document has."""
    z = (dp - df * share) / np.sqrt(df * share * (1 - share) + 1e-9)
    keep = (df >= MIN_DOCS) & (z >= LEAST_Z)
    return np.sort(h[keep]) if keep.any() else np.sort(h[dp > 0])[:1]


def fit(texts: pa.Array, toxic: np.ndarray) -> Model:
    """The model of texts and labels that are at hand: what ``train`` does where texts lie."""
    y = toxic.astype(bool)
    if not y.any() or y.all():
        return NONE
    h, df, dp = summed(list(occurrences(texts, y.astype(np.int64))))
    kept = Model(names := _kept(h, df, dp, y.mean()), np.zeros(len(names)), 0.0)
    return solved(kept, y, list(sentences(texts, kept)))


def solved(kept: Model, y: np.ndarray, docs: list[tuple[int, np.ndarray, np.ndarray]], steps: int = 250, l1: float = 1e-4, rate: float = 0.15) -> Model:
    """Noisy-or likelihood of the document labels ``y`` by proximal Adam. ``docs``: as ``sentences`` gives."""
    keep = kept.features
    if not len(keep):
        return NONE
    n_sent = np.array([d[0] for d in docs])
    doc = np.repeat(np.arange(len(docs)), [len(d[1]) for d in docs])
    sent = np.concatenate([d[1] for d in docs]) + np.concatenate([[0], np.cumsum(n_sent)])[doc]
    f = np.concatenate([d[2] for d in docs])
    # sentences without a kept feature are alike: only their number in a document matters
    used, at, sent = np.unique(sent, return_index=True, return_inverse=True)
    doc = doc[at]
    plain = n_sent - np.bincount(doc, minlength=len(y))
    w, b = np.full(len(keep), 0.1), float(np.log(y.mean() / max(1.0, n_sent.mean())))
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    for t in range(1, steps + 1):
        zs = b + np.bincount(sent, weights=w[f], minlength=len(used))
        a = plain * softplus(b) + np.bincount(doc, weights=softplus(zs), minlength=len(y))
        ga = np.where(y, -1 / np.expm1(np.maximum(a, 1e-9)), 1.0) / len(y)
        gz = ga[doc] / (1 + np.exp(-zs))
        g = np.append(np.bincount(f, weights=gz[sent], minlength=len(keep)), gz.sum() + (ga * plain).sum() / (1 + np.exp(-b)))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
        pull = rate * l1 / (np.sqrt(v[:-1] / (1 - 0.99**t)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(pull, rate), 0)
    on = w != 0
    if not on.any():
        return Model(np.zeros(1, np.uint64), np.zeros(1), b)
    order = np.argsort(keep[on])
    return Model(keep[on][order], w[on][order], b)


def score_texts(model: Model, texts: pa.Array) -> dict[str, np.ndarray]:
    """Per text: score, number of sentences, of offending ones (p >= 0.5), the worst sentence, and the places of
    all offending ones (code points)."""
    data, offsets = B.buffers(texts)
    n = len(offsets) - 1
    out = {"score": np.zeros(n), "n_sentences": np.zeros(n, np.int64), "n_offending": np.zeros(n, np.int64), "worst_start": np.zeros(n, np.int64), "worst_end": np.zeros(n, np.int64), "worst_score": np.zeros(n)}
    spans = []
    for i, j in B.slices(offsets, B.SMALL_BYTES):
        part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if not len(part):
            continue
        h, of, starts = features(part, own)
        at, k = model.known(h)
        pair = np.unique(of[at].astype(np.int64) * len(model.features) + k)
        zs = model.bias + np.bincount(pair // len(model.features), weights=model.weights[pair % len(model.features)], minlength=len(starts))
        doc = np.searchsorted(own, starts, "right") - 1
        a = np.bincount(doc, weights=softplus(zs), minlength=j - i)
        out["score"][i:j] = -np.expm1(-a)
        out["n_sentences"][i:j] = np.bincount(doc, minlength=j - i)
        out["n_offending"][i:j] = np.bincount(doc, weights=zs >= 0, minlength=j - i)
        order = np.lexsort((starts, -zs, doc))
        docs, first = np.unique(doc[order], return_index=True)
        worst = order[first]
        ends = np.minimum(np.append(starts[1:], len(part)), own[1:][doc])
        # code points, not bytes: those that continue a character don't count
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        base = chars[own[:-1][docs]]
        out["worst_start"][i + docs] = chars[starts[worst]] - base
        out["worst_end"][i + docs] = chars[ends[worst]] - base
        out["worst_score"][i + docs] = 1 / (1 + np.exp(-zs[worst]))
        bad = np.flatnonzero(zs >= 0)
        spans.append((chars[starts[bad]] - chars[own[:-1][doc[bad]]], chars[ends[bad]] - chars[own[:-1][doc[bad]]], 1 / (1 + np.exp(-zs[bad]))))
    parts = [pa.array(np.concatenate([s[k] for s in spans]) if spans else np.zeros(0, np.int64 if k < 2 else float)) for k in range(3)]
    at = np.concatenate([[0], np.cumsum(out["n_offending"])]).astype(np.int32)
    out["offending"] = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(parts, ["start", "end", "score"]))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """text, toxic of at most ``max_docs`` labelled documents that may be learnt from."""
    order = F.xxhash64(F.col("doc_id"), F.lit(3))
    ids = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    ids = ids.orderBy(order, "doc_id").limit(max_docs)
    own = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return own.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    own = staged(sample(docs, labels, max_docs), "labelled")
    n, pos = own.agg(F.count("*"), F.sum("toxic")).first()
    if not pos or pos == n:
        return NONE

    def occur(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, df, dp in gathered(occurrences(batch.column("text"), batch.column("toxic").to_numpy().astype(np.int64))):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(df), pa.array(dp)], names=["h", "df", "dp"])

    seen = own.mapInArrow(B.released(occur), "h long, df long, dp long").groupBy("h").agg(F.sum("df").alias("df"), F.sum("dp").alias("dp"))
    seen = staged(seen.filter(F.col("dp") > 0), "features")
    share = pos / n
    # what may be kept, as ``_kept`` decides; of the others one is enough
    may = seen.filter((F.col("df") >= MIN_DOCS) & (F.col("dp") - F.col("df") * share >= LEAST_Z * F.sqrt(F.col("df") * share * (1 - share)) - 1e-6)).toArrow()
    if not len(may):
        may = seen.orderBy(F.expr("h < 0"), "h").limit(1).toArrow()  # hashes are unsigned
    h, df, dp = may.column("h").to_numpy().view(np.uint64), may.column("df").to_numpy(), may.column("dp").to_numpy()
    kept = Model(names := _kept(h, df, dp, share), np.zeros(len(names)), 0.0)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(sentences(batch.column("text"), kept))
            cols = [batch.column("toxic"), pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[k].tolist() for r in rows], pa.list_(pa.int32())) for k in (1, 2)]]
            yield pa.RecordBatch.from_arrays(cols, names=["toxic", "n", "s", "f"])

    # in one order whatever the partitions, so that sums are the same each time
    got = own.mapInArrow(B.released(located), "toxic int, n long, s array<int>, f array<int>").orderBy("toxic", "n", "s", "f").toArrow()
    ints = lambda c, k: np.array(got.column(c)[k].as_py() or [], np.int64)
    parts = [(got.column("n")[k].as_py(), ints("s", k), ints("f", k)) for k in range(len(got))]
    return solved(kept, got.column("toxic").to_numpy().astype(bool), parts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted and where the worst and all offending sentences are, for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.parts(batch):
                got = score_texts(model, part.column("text"))
                names = ["doc_id", "held_out", "score", "predicted", *list(got)[1:]]
                cols = [part.column("doc_id"), part.column("held_out"), pa.array(got["score"]), pa.array((got["score"] >= 0.5).astype(np.int32)), *[got[k] if k == "offending" else pa.array(got[k]) for k in list(got)[1:]]]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return own.mapInArrow(B.released(run), SCHEMA)


def reject(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``limit`` or more; rows keep all their columns."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in B.parts(batch):
                yield part.filter(pa.array(score_texts(model, part.column("text"))["score"] < limit))

    return docs.mapInArrow(B.released(run), schema)
