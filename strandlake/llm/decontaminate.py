"""Benchmark decontamination: training text against a hash set of benchmark word n-grams.

Text is lower-cased in A-Z only; words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. A window is
``n`` consecutive words of an item; an item of fewer words (but not none) is one window. Each
document is scanned once: at every word a key over four words of the window there is looked up in
the hash set; candidates are then verified on the window's words, so keys that agree by chance do no
harm. All of it runs on DataFrame functions.

The hash set is a bit table with ``BITS`` bits and ``PROBES`` probes a key, sent to the tasks as a literal. One table
holds at most ``keys_per_pass`` keys; a larger benchmark is dealt over several tables, with a scan
for each, so what is sent has a bound and no window is ever shuffled unless a table answers for it.
The windows that candidates are verified on are broadcast while they measure no more than
``most_bytes``, and joined by shuffle beyond.

Verified hits are gathered per distinct text, not per row, so a third of all rows being copies of
one contaminated text is a few rows to the join; rows without a candidate never reach it, and those
of a text that many rows have aren't dealt by it (``common.joined``).

Defined cases: a null text has no words (0 words, 0 hits, not contaminated); a null item text has
no window; a null item_id still marks words but isn't listed; repeated rows each get their result;
an empty benchmark marks nothing; extra columns are left out of ``scan`` and kept by ``clean``,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import disjoint, joined, let, own_name, shielded, staged, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before A-Z are lower-cased
N = 10
BITS, PROBES, KEYS_PER_PASS, MOST_BYTES = 32, 3, 500_000, 32 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text_or_empty(text), UPPER, LOWER), NOT_WORD), "")


def _key(w: Column, i: Column, k: int) -> Column:
    """Over the first, the last and two words between (all, of short windows)."""
    at = sorted({0, (k - 1) // 3, 2 * (k - 1) // 3, k - 1})
    return F.xxhash64(F.lit(k), *[w[i + j] for j in at])


def _window(w: Column, i: Column, k: int) -> Column:
    return F.array_join(F.slice(w, i + 1, k), " ")


def _starts(w: Column, k: int) -> Column:
    """0, 1, ... for each place of a window of k words; empty if there is none."""
    return F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))


def windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """k, key, win, items: each distinct window of the benchmark with the items that have it."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    out = None
    for k in range(1, n + 1):
        own = items.filter(F.size("w") >= n) if k == n else items.filter(F.size("w") == k)
        own = own.select("item", F.explode(let(F.col("w"), lambda w: F.transform(_starts(w, k), lambda i: F.struct(F.lit(k).alias("k"), _key(w, i, k).alias("key"), _window(w, i, k).alias("win"))))).alias("x")).select("item", "x.*")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("k", "key", "win").agg(F.collect_set("item").alias("items"))


def _place(key: Column, probe: int, size: int) -> Column:
    """A key's ``probe``-th place of ``size``."""
    first = F.pmod(key, F.lit(size).cast("long"))
    return F.pmod(first + F.pmod(F.xxhash64(key, F.lit(7)), F.lit(size).cast("long")) * probe, F.lit(size).cast("long")) if probe else first


def _tables(found: DataFrame, keys_per_pass: int) -> list[tuple[int, str]]:
    """Bit tables of all keys of ``found``: (number of bits, their longs as text)."""
    keys = found.select("key").distinct()
    n = keys.count()
    passes, out = -(-n // keys_per_pass), []
    for k in range(passes):
        own = keys.filter(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(passes)) == k)
        size = -(-max(1024, own.count() * BITS) // 64) * 64
        at = own.select(F.explode(F.array(*[_place(F.col("key"), j, size) for j in range(PROBES)])).alias("at"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
        longs = ["0"] * (size // 64)
        for r in at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("i")).agg(F.bit_or(bit).alias("v")).collect():
            longs[r["i"]] = str(r["v"])
        out.append((size, ",".join(longs)))
    return out


def _candidates(w: Column, ks: list[int], table: tuple[int, str]) -> Column:
    """(start, k, win) of the windows of the words ``w`` whose keys the table answers for."""
    size, longs = table
    bits = F.split(F.lit(longs), ",").cast("array<long>")  # of literals alone: made once

    def holds(key: Column) -> Column:
        out = F.lit(True)
        for j in range(PROBES):
            at = _place(key, j, size)
            out = out & (F.call_function("shiftrightunsigned", F.get(bits, F.floor(at / 64).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
        return out

    def of(k: int) -> Column:
        keys = F.transform(_starts(w, k), lambda i: _key(w, i, k))
        some = lambda x: F.transform(F.filter(_starts(w, k), lambda i: holds(x[i])), lambda i: F.struct(i.alias("start"), F.lit(k).alias("k"), _window(w, i, k).alias("win")))
        return let(keys, some)

    return F.concat(*[of(k) for k in ks])


def _covered(spans: Column) -> Column:
    """How many words the disjoint spans cover."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]).cast("long"))


def verified(docs: DataFrame, benchmark: DataFrame, n: int = N, keys_per_pass: int = KEYS_PER_PASS, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame, list, list]:
    """Per row: doc_id, n_words, digest (null: no candidate). Per distinct text with hits: digest, spans,
    items. And the window lengths and tables."""
    found = staged(windows(benchmark, n), "windows")
    ks, tables = [r["k"] for r in found.select("k").distinct().orderBy("k").collect()], _tables(found, keys_per_pass)
    base = docs.select("doc_id", text_or_empty("text").alias("text"))
    none = F.array().cast("array<struct<start:int,k:int,win:string>>")
    rows = cands = None
    for table in tables or [None]:
        scan = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), (_candidates(w, ks, table) if table else none).alias("hits"))  # noqa: B023, E731
        own = base.withColumn("s", let(words(F.col("text")), scan)).withColumn("digest", F.when((F.size("s.hits") > 0) | F.lit(len(tables) > 1), F.sha2("text", 256)))
        if len(tables) > 1:
            if rows is None:
                rows = staged(own.select("doc_id", "s.n_words", "digest"), "counts")
            some = own.filter(F.size("s.hits") > 0).select("digest", "s.hits")
        else:
            own = staged(own.select("doc_id", "s.n_words", "digest", "s.hits"), "hits")
            rows, some = own.drop("hits"), own.filter(F.size("hits") > 0).select("digest", "hits")
        some = some.dropDuplicates(["digest"]).select("digest", F.explode("hits").alias("x")).select("digest", "x.*")
        cands = some if cands is None else cands.unionByName(some)
    sets = found.select("k", "win", "items")
    if (sets.agg(F.sum(F.octet_length("win") + F.octet_length(F.array_join("items", ",")) + 64)).first()[0] or 0) <= most_bytes:
        met = cands.join(F.broadcast(sets), ["k", "win"])
    else:
        met = joined(staged(cands, "windows"), sets, ["k", "win"])
    ends = F.struct("start", (F.col("start") + F.col("k")).alias("end"))
    spans = met.groupBy("digest").agg(F.collect_set(ends).alias("all"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return rows, disjoint(spans, "all", "spans").select("digest", "spans", "items"), ks, tables


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, keys_per_pass: int = KEYS_PER_PASS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    rows, spans, _, _ = verified(docs, benchmark, n, keys_per_pass, most_bytes)
    spans = staged(spans.select("digest", _covered(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "spans")
    empty = F.sha2(F.lit(""), 256)
    out = lambda df, hit, items, sha: df.select("doc_id", "n_words", hit.alias("n_hit"), items.alias("n_items"), sha.alias("items_sha256"), (hit > 0).alias("contaminated"))
    zero = F.lit(0).cast("long")
    clean = out(rows.filter(F.col("digest").isNull()), zero, zero, empty)
    met = joined(rows.filter(F.col("digest").isNotNull()), spans, ["digest"], "left")
    return clean.unionByName(out(met, F.coalesce("n_hit", zero), F.coalesce("n_items", zero), F.coalesce("items_sha256", empty)))


def clean(docs: DataFrame, benchmark: DataFrame, n: int = N, most: float = 0.5, text_col: str = "text", length_col: str | None = "n_chars", keys_per_pass: int = KEYS_PER_PASS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` with the words of benchmark windows cut out; documents of which more than ``most``
    of the words are hit go. All columns of ``docs`` stay; ``length_col`` is set anew where text
    changes. Texts without a hit stay as they are.

    Hit texts' spans are broadcast while they measure no more than ``most_bytes``. Beyond that rows whose text has a
    candidate, and no others, are joined by digest."""
    own, names = shielded(docs)
    digest, where, hits, changed = (own_name(x) for x in ("digest", "spans", "hits", "text"))
    text = F.col(names[text_col])
    _, spans, ks, tables = verified(docs.select(F.lit(None).alias("doc_id"), F.col(text_col).alias("text")), benchmark, n, keys_per_pass, most_bytes)
    spans = staged(spans.select(F.col("digest").alias(digest), F.col("spans").alias(where), _covered(F.col("spans")).alias(hits)), "spans")
    src = own.withColumn(digest, F.sha2(text_or_empty(text), 256))
    if (spans.agg(F.sum(F.size(where) * 16 + 96)).first()[0] or 0) <= most_bytes:
        met = src.join(F.broadcast(spans), digest, "left")
    else:
        maybe = own_name("maybe")
        src = src.withColumn(maybe, let(words(text), lambda w: F.concat(*[_candidates(w, ks, t) for t in tables])))
        src = staged(src.withColumn(maybe, F.size(maybe) > 0), "candidates")
        rest = src.filter(~F.col(maybe)).select("*", F.lit(None).cast(spans.schema[where].dataType).alias(where), F.lit(None).cast("long").alias(hits))
        met = joined(src.filter(maybe), spans, [digest], "left").unionByName(rest)

    def cut(w: Column) -> Column:
        """The words between spans, each with what parts it from the next, after what comes first."""
        words_, gaps, spans_ = w["words"], w["gaps"], w["spans"]
        begin = lambda k: F.when(k > 0, spans_[k - 1]["end"]).otherwise(0)
        end = lambda k: F.when(k < F.size(spans_), F.get(spans_, k)["start"]).otherwise(F.size(words_))
        between = lambda k: F.when(end(k) > begin(k), F.transform(F.sequence(begin(k), end(k) - 1), lambda i: F.concat(words_[i], gaps[i + 1]))).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(F.array(gaps[0]), F.flatten(F.transform(F.sequence(F.lit(0), F.size(spans_)), between))), "")

    hit = F.col(hits).isNotNull()
    parts = F.struct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), F.split(text, WORD).alias("gaps"), F.col(where).alias("spans"))
    kept = met.filter(~hit | (F.col(hits) <= F.size(words(text)) * most)).withColumn(changed, F.when(hit, let(parts, cut)).otherwise(text))
    out = {c: F.col(n) for c, n in names.items()} | {text_col: F.col(changed)}
    if length_col in names and length_col != text_col:
        out[length_col] = F.when(hit, F.length(changed).cast(docs.schema[length_col].dataType)).otherwise(out[length_col])
    return kept.select(*[x.alias(c) for c, x in out.items()])
