"""Language identification by prediction by partial matching (PPM).

Each language has a variable-order tree of byte contexts (up to ``ORDER`` bytes) with the counts of
the bytes that followed. A byte is coded at the longest context that was seen: with chance
c / (n + d) if it followed there (c times of n, d different bytes), else with the escape's chance
d / (n + d) and then at the next shorter context, down to all 256 bytes alike. Statistics are
frozen, so a text's code length under each language is exact and the same wherever it is computed;
the shortest wins. ``score`` is the winner's share of 2**-length.

The trees of all languages are held as one: a node has a value for each language, escapes
included, so that a byte needs one search for all of them. Bytes are first brought to lower case,
digits to ``0`` and other ASCII to a space; ``ORDER`` spaces stand before a text.

The model is fitted on a bounded sample: of the documents that may be learnt from (crc32 of the id
modulo 4 is not 2, language and text not null) ``per_lang`` of each language, the first by a hash of
the id. Their whole texts are counted where they lie; the driver gets the counts of the distinct
byte strings of ``ORDER`` + 1, no text. Prediction reads every whole text once, in slices, without a shuffle.

Defined cases: a null text or one without a letter is ``und`` with score 0, as are all texts if there
is nothing to learn from; equal lengths give the first language by name; repeated rows each get
their prediction; an empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm import bytewords as B

ORDER, PER_LANG, MOST_DOCS, PART = 4, 200, 50_000, 1 << 22
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits double, bits_next double"
LETTER = re.compile(r"[^\W\d_]")
_U = np.uint64


def _folded() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    for b in range(256):
        if 48 <= b <= 57:
            t[b] = 48
        elif B.LOW[b]:
            t[b] = B.LOW[b]
    return t


FOLD = _folded()


class Table:
    """Keys in open addressing -> their row in ``values``."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.values = values
        self.keys = np.zeros(1 << self.bits, np.uint64)  # key + 1, 0: free
        self.rows = np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(keys))
        at = self._home(keys)
        while len(left):
            free = self.keys[at] == 0
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]] = keys[left[put]] + _U(1)
            self.rows[at[put]] = left[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys):
        return (B.mix(keys) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if there is none."""
        at = self._home(keys)
        out = np.full(len(keys), -1, np.int64)
        want = keys + _U(1)
        open_ = np.arange(len(keys))
        while len(open_):
            have = self.keys[at]
            hit = have == want
            out[open_[hit]] = self.rows[at[hit]]
            go = ~hit & (have != 0)
            open_, want, at = open_[go], want[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out


def _grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(the ``order`` bytes before and the byte itself, as one number; texts' ends among them)."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    padded = np.full(len(data) + order * len(n), 32, np.uint8)
    at = np.arange(len(data)) + order * (doc + 1)
    padded[at] = FOLD[data]
    key = np.zeros(len(data), np.uint64)
    for j in range(order, -1, -1):
        key = (key << _U(8)) | padded[at - j].astype(np.uint64)
    return key, offsets[1:]


def _parts(data: np.ndarray, offsets: np.ndarray, most: int, order: int) -> Iterator[tuple]:
    """(first text, text after the last, their offsets, first byte, byte after the last, grams): texts of ``most``
    bytes together, a longer one by itself in parts of ``PART`` bytes."""
    for i, j in B.slices(offsets, most):
        own, part = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        for lo in range(0, len(part), PART):
            hi = min(len(part), lo + PART)
            if hi - lo == len(part):
                grams, _ = _grams(part, own, order)
            else:
                back = min(lo, order)
                grams = _grams(part[lo - back : hi], np.array([0, hi - lo + back]), order)[0][back:]
            yield i, j, own, lo, hi, grams


def counts(texts: pa.Array, langs: np.ndarray, order: int = ORDER) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, gram, how often it occurs) of the texts, a part at a time."""
    data, offsets = B.buffers(texts)
    for i, j, own, lo, hi, grams in _parts(data, offsets, B.SLICE_BYTES, order):
        of = np.searchsorted(own, np.arange(lo, hi), "right") - 1 + i
        for lang in sorted(set(langs[i:j])):
            yield lang, *np.unique(grams[langs[of] == lang], return_counts=True)


class Model:
    """Code lengths (bits, negative) of each node for each language, by order."""

    def __init__(self, langs: list[str], counted: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        """``counted``: per language the distinct grams and how often they occur."""
        self.langs, self.order = langs, order
        size = len(langs)

        def shorter(g: np.ndarray, n: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
            keys, of = np.unique(g & mask, return_inverse=True)
            return keys, np.bincount(of, weights=n, minlength=len(keys))

        self.syms: list[Table | None] = [None] * (order + 1)
        self.ctxs: list[Table | None] = [None] * (order + 1)
        self.base = np.full((256, size), -8.0)
        for k in range(order + 1):
            mask = _U((1 << 8 * (k + 1)) - 1)
            seen = [shorter(g, n, mask) for g, n in counted]
            keys = np.unique(np.concatenate([s[0] for s in seen]) if seen else np.zeros(0, np.uint64))
            ctx = np.unique(keys >> _U(8))
            esc = np.zeros((len(ctx), size))
            own = np.full((len(keys), size), np.nan)
            for i, (s, c) in enumerate(seen):
                of = np.searchsorted(ctx, s >> _U(8))
                n, d = np.bincount(of, weights=c, minlength=len(ctx)), np.bincount(of, minlength=len(ctx))
                esc[:, i] = np.log2(np.where(n > 0, d, 1) / np.where(n > 0, n + d, 1))
                own[np.searchsorted(keys, s), i] = np.log2(c / (n + d)[of])
            if k == 0:
                value = np.broadcast_to(esc[0] if len(esc) else np.zeros(size), (256, size)) - 8.0
                value = value.copy()
                value[keys.astype(np.int64)] = np.where(np.isnan(own), value[keys.astype(np.int64)], own)
                self.base = value
                continue
            after = self.lengths(keys & _U((1 << 8 * k) - 1), k - 1)
            value = np.where(np.isnan(own), esc[np.searchsorted(ctx, keys >> _U(8))] + after, own)
            self.syms[k], self.ctxs[k] = Table(keys, value.astype(np.float32)), Table(ctx, esc.astype(np.float32))

    def lengths(self, grams: np.ndarray, order: int | None = None) -> np.ndarray:
        """log2 of each gram's last byte's chance after the bytes before it, for each language."""
        order = self.order if order is None else order
        out = np.zeros((len(grams), len(self.langs)))
        left = np.arange(len(grams))
        for k in range(order, 0, -1):
            grams = grams & _U((1 << 8 * (k + 1)) - 1)
            row = self.syms[k].find(grams)
            hit = row >= 0
            out[left[hit]] += self.syms[k].values[row[hit]]
            left, grams = left[~hit], grams[~hit]
            if not len(left):
                return out
            ctx = self.ctxs[k].find(grams >> _U(8))
            met = ctx >= 0
            out[left[met]] += self.ctxs[k].values[ctx[met]]
        out[left] += self.base[(grams & _U(255)).astype(np.int64)]
        return out

    def predict(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Per text: the index of the language (-1: undetermined), its share, and the two least bits."""
        data, offsets = B.buffers(texts)
        n, size = len(offsets) - 1, len(self.langs)
        bits = np.zeros((n, size))
        for i, j, own, lo, hi, grams in _parts(data, offsets, max(1 << 16, (1 << 21) // max(size, 4)), self.order) if size else ():
            total = np.concatenate([np.zeros((1, size)), np.cumsum(self.lengths(grams), axis=0)])
            at = np.clip(own, lo, hi) - lo
            bits[i:j] -= total[at[1:]] - total[at[:-1]]
        letters = np.array([LETTER.search(t.as_py() or "") is not None for t in texts], bool) if n else np.zeros(0, bool)
        if not size:
            return {"lang": np.full(n, -1), "score": np.zeros(n), "bits": np.zeros(n), "bits_next": np.zeros(n)}
        best = bits.argmin(axis=1) if n else np.zeros(0, np.int64)
        least = bits[np.arange(n), best]
        share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        after = np.sort(bits, axis=1)[:, min(1, size - 1)] if n else np.zeros(0)
        return {"lang": np.where(letters, best, -1), "score": np.where(letters, share, 0.0), "bits": least, "bits_next": after}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_lang: int = PER_LANG, order: int = ORDER) -> Model:
    may = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in may.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    per_lang = max(1, min(per_lang, MOST_DOCS // max(1, len(sizes))))
    # a hash of the id decides; ids far beyond the wanted ones needn't meet in one task to be ranked
    rank = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30))
    near = F.lit(False)
    for lang, size in sorted(sizes.items()):
        near = near | ((F.col("lang") == lang) & (rank < int(min(1.0, 4 * (per_lang + 25) / size) * (1 << 30))))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(rank, "doc_id"))
    ids = may.filter(near).select("lang", "doc_id").distinct().withColumn("_n", first).filter(F.col("_n") <= per_lang).drop("_n")
    own = may.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, grams, n in counts(batch.column("text"), batch.column("lang").to_numpy(zero_copy_only=False), order):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    got = own.select("lang", "text").mapInArrow(B.released(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    by = got.column("lang").to_numpy(zero_copy_only=False) if len(got) else np.zeros(0, object)
    langs, grams, n = sorted(set(by)), got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    return Model(langs, [(grams[by == x], n[by == x]) for x in langs], order)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.langs, "und"], object)
        for batch in batches:
            got = own.predict(batch.column("text"))
            cols = [batch.column("doc_id"), batch.column("held_out"), pa.array(names[got["lang"]], pa.string()), *[pa.array(got[k]) for k in ("score", "bits", "bits_next")]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "lang_pred", "score", "bits", "bits_next"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(B.released(run), SCHEMA)
