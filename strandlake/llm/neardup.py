"""Near-duplicate texts by ProbMinHash, banding and exact verification.

Shingles are five words (see ``bytewords``), weighted by how often the text has them. Similarity is
the probability Jaccard of the weights, J = sum over common i of 1 / sum_j max(x_j/x_i, y_j/y_i): it
doesn't change with a text's length, and is the plain Jaccard where weights are alike.

1. ProbMinHash: every shingle has a Poisson process whose rate is its weight and whose marks fall on
   the ``REGISTERS`` alike; a register keeps the shingle that came first. Shingles stop as soon as
   their next arrival comes after all registers' ones. Two texts agree in a register with chance J.
2. Equal texts (sha256) are one node. Nodes that agree in all ``ROWS`` registers of one of ``BANDS``
   bands share a bucket. At J = 0.8 a pair is missed with chance (1 - 0.8**7)**56 = 2e-6.
3. In each bucket its least node is the centre, and only pairs with the centre are verified, exactly,
   from both texts' shingles. Components of verified pairs are found.
4. Buckets that still hold several components are compared again, in blocks: ``FINE`` more registers, a
   byte of each, estimate J for pairs of different components. First the block's medoid (near copies of one text may be near to it,
   but less near to each other; looked for in the first ``MEDOID_BANDS`` bands) and then each node's best partners in every other component are verified,
   if the estimate is no more than five standard errors under 0.8: one each at first, then
   ``GROWTH`` times as many a round, until no candidate between components is left. A pair is only
   looked at in the first band that it shares.

A group of n copies gives n pairs with its centre, not all pairs; all candidates are verified only between
components that stay apart. A centre with
many partners is dealt over several tasks, its shingles going along to each.

A bucket of n unlike texts has its registers compared all with all, in pairs of blocks of ``BLOCK``: each member is
sent to n / ``BLOCK`` of them, and a pair costs a comparison of ``FINE`` bytes, no row. No finer
banding could replace that without losing links: two texts of J = 0.7 meet in bands of any length
nearly as often as two of 0.8.

Defined cases: a null text counts as empty; texts without words are near nothing but equal texts; a
text of fewer than five words has one shingle; repeated rows are one class; an empty table gives no
rows; extra columns are left out of ``classes`` and kept by ``distinct``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import bytewords as B
from strandlake.llm.common import joined, own_name, shielded, staged, text_or_empty
from strandlake.operators.graph import components

SIZE, LIMIT, ROWS, BANDS = 5, 0.8, 7, 56
REGISTERS = ROWS * BANDS
FINE = 1024  # registers for estimates, a byte each
SHARE, BLOCK, MOST_KEYS, GROWTH, MEDOID_BANDS = 400, 4096, 300_000, 8, 8
_U = np.uint64
_AGREE = LIMIT + (1 - LIMIT) / 256  # chance that a byte agrees at the limit: bytes of unlike shingles may as well
#: Fewer equal bytes lie over five standard errors under what the limit gives.
LEAST_EQUAL = math.floor(FINE * _AGREE - 5 * math.sqrt(FINE * _AGREE * (1 - _AGREE)))


def weighted(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, weight, text index), each shingle once a text, by text and shingle."""
    h, _, _, doc = B.words(data, offsets)
    s, d = B.shingles(h, doc, size)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    if not len(s):
        return s, np.zeros(0), d
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])])
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s))).astype(float), d[at]


def registers(s: np.ndarray, w: np.ndarray, d: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """n x m: the shingle whose arrival is each register's first; 0 for texts without shingles."""
    first, kept = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    time, step = np.zeros(len(s)), 0
    while len(s):
        k = int(np.clip(20_000 // len(s), 1, 256))
        t = np.arange(step + 1, step + k + 1, dtype=np.uint64) * _U(0xD1342543DE82EF95)
        r = B.mix(s[:, None] + t[None, :])
        u = ((r >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        when = time[:, None] + np.cumsum(-np.log(u), axis=1) / w[:, None]
        reg = (B.mix(r ^ _U(0x5851F42D4C957F2D)) % _U(m)).astype(np.int64)
        at, flat = (d[:, None] * m + reg).ravel(), when.ravel()
        low = flat < first[at]
        at, flat, who = at[low], flat[low], np.repeat(s, k)[low]
        np.minimum.at(first, at, flat)
        won = first[at] == flat
        kept[at[won]] = who[won]
        time, step = when[:, -1], step + k
        last = first.reshape(n, m).max(axis=1)
        on = time < last[d]
        s, w, d, time = s[on], w[on], d[on], time[on]
    return kept.reshape(n, m)


def bands(kept: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """n x bands: a hash of each band's registers and its number."""
    n, m = kept.shape
    out = np.empty((n, m // rows), np.uint64)
    for b in range(m // rows):
        h = np.full(n, _U(b + 1))
        for j in range(rows):
            h = B.mix(h * _U(0x9E3779B97F4A7C15) + kept[:, b * rows + j])
        out[:, b] = h
    return out


def similarity(s: np.ndarray, x: np.ndarray, t: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard of weights x of shingles s and y of t, both sorted."""
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    both = t[at] == s if len(t) else np.zeros(len(s), bool)
    if not both.any():
        return 0.0
    a, b = x[both], y[at[both]]
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    # sum_j max(x_j/x_i, y_j/y_i): x's part where x_j/y_j is the larger ratio, y's part elsewhere;
    # shingles of one text only count for that text
    lo = np.searchsorted(ratio, ratio, "right")
    ca, cb = np.concatenate([[0], np.cumsum(a)]), np.concatenate([[0], np.cumsum(b)])
    xs, ys = x.sum() - ca[lo], cb[lo] + (y.sum() - cb[-1])
    return float((1 / (xs / a + ys / b)).sum())


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, digest, bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.buffers(batch.column("text"))
            for i, j in B.slices(offsets, 1 << 19):
                own = offsets[i : j + 1] - offsets[i]
                s, w, d = weighted(data[offsets[i] : offsets[j]], own)
                keys = bands(registers(s, w, d, j - i)).view(np.int64)
                some = np.isin(np.arange(j - i), d)
                lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some * BANDS)]).astype(np.int32), keys[some].ravel())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("digest"), lists], names=["doc_id", "digest", "bands"])

    return docs.mapInArrow(B.released(run), "doc_id long, digest binary, bands array<long>")


def shingled(docs: DataFrame) -> DataFrame:
    """(node, text) -> node, and as bytes its shingles, weights and ``sig``: bands and fine registers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = B.buffers(batch.column("text"))
            for i, j in B.slices(offsets, 1 << 19):
                own = offsets[i : j + 1] - offsets[i]
                s, w, d = weighted(data[offsets[i] : offsets[j]], own)
                keys = bands(registers(s, w, d, j - i))
                fine = B.mix(registers(s, w, d, j - i, FINE)).astype(np.uint8)
                cut = np.searchsorted(d, np.arange(j - i + 1))
                rows = [(s[a:b].tobytes(), w[a:b].astype(np.float32).tobytes(), keys[k].tobytes() + fine[k].tobytes()) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
                cols = [pa.array(c, pa.binary()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), *cols], names=["node", "s", "w", "sig"])

    return docs.mapInArrow(B.released(run), "node long, s binary, w binary, sig binary")


def _sent(table: DataFrame, most_keys: int) -> DataFrame:
    """A written table of ids, broadcast while it has no more than ``most_keys`` rows: what it meets isn't dealt out."""
    return F.broadcast(table) if table.count() <= most_keys else table


def verified(pairs: DataFrame, held: DataFrame, limit: float = LIMIT, most_keys: int = MOST_KEYS) -> DataFrame:
    """Those of ``pairs`` (u, v; distinct; a written table) whose similarity is ``limit`` or more. ``held``: node, s, w."""
    near = F.broadcast if pairs.count() <= most_keys else lambda x: x
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / SHARE).cast("long").alias("parts"))
    dealt = pairs.join(near(many), "u").withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts"))).drop("parts")
    right = held.select(F.col("node").alias("v"), "s", "w").join(near(dealt), "v").select("u", "part", "v", "s", "w")
    heads = held.select(F.col("node").alias("u"), "s", "w").join(near(dealt.select("u", "part").distinct()), "u").select("u", "part", F.lit(None).cast("long").alias("v"), "s", "w")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, key = None, None
        for batch in frames:
            us, vs = [], []
            for u, part, v, s, w in zip(*[batch.column(c) for c in ("u", "part", "v", "s", "w")], strict=True):
                s, w = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(w.as_buffer(), np.float32).astype(float)
                if not v.is_valid:
                    head, key = (s.copy(), w.copy()), (u.as_py(), part.as_py())
                    continue
                assert key == (u.as_py(), part.as_py()), "a pair without its centre"
                if similarity(*head, s, w) >= limit - 1e-12:
                    us.append(key[0])
                    vs.append(v.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    dealt = heads.unionByName(right).repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    return dealt.mapInArrow(B.released(run), "u long, v long")


def _medoids(sig: np.ndarray, root: np.ndarray, meet) -> Iterator[tuple[int, int]]:
    """The member that most registers' majorities agree with, and who isn't of its component yet."""
    ordered = np.sort(sig, axis=0)
    middle = ordered[len(sig) // 2]  # a value that most members have is the middle one
    k = int((sig == middle).sum(axis=1).argmax())
    at, _ = meet(k)
    for a in at:
        yield k, a


def _partners(most: int):
    """The ``most`` best partners in every other component of each member, but those of the largest
    component: they are others' partners. A pair (-1, -1) says that the block has more."""
    def pick(sig: np.ndarray, root: np.ndarray, meet) -> Iterator[tuple[int, int]]:
        names, n = np.unique(root, return_counts=True)
        for k in np.flatnonzero(root != names[n.argmax()]):
            at, near = meet(k)
            at = at[np.lexsort((at, -near, root[at]))]
            _, start, size = np.unique(root[at], return_index=True, return_counts=True)
            rank = np.arange(len(at)) - np.repeat(start, size)
            for a in at[rank < most]:
                yield k, a
            if len(size) and size.max() > most:
                yield -1, -1

    return pick


def _across(members: DataFrame, held: DataFrame, roots: DataFrame, pick, most_keys: int = MOST_KEYS) -> DataFrame:
    """Pairs to verify between components that share buckets, as ``pick`` chooses them in each block; and
    (-1, band) for blocks of each bucket that has more.

    A pair is only looked at in the first band that it shares, so no pair comes twice."""
    marked = members.join(_sent(roots, most_keys), "node", "left").select("b", "band", "node", F.coalesce("root", "node").alias("root"))
    open_ = marked.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.count("*").alias("n")).filter("a != z").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    open_ = _sent(staged(open_, "open"), most_keys)
    # a bucket of several blocks is compared block by block: each node goes to the blocks' pairs it is in
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = marked.join(open_, "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("b", "band", "node", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = rows.join(held.select("node", "sig"), "node")

    def chosen(cols: dict[str, np.ndarray], sigs: list) -> tuple[list[int], list[int]]:
        whole = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), 8 * BANDS + FINE)
        keys, sig = np.ascontiguousarray(whole[:, : 8 * BANDS]).view(np.uint64), np.ascontiguousarray(whole[:, 8 * BANDS :])
        node, root, own, b = cols["node"], cols["root"], cols["own"], int(cols["b"][0])
        two = cols["i"][0] != cols["j"][0]

        def meet(k: int) -> tuple[np.ndarray, np.ndarray]:
            """Members of other components whose estimate suffices and whose first common band is this one."""
            near = np.count_nonzero(sig == sig[k], axis=1)
            at = np.flatnonzero((near >= LEAST_EQUAL) & (root != root[k]) & ~(two & (own == own[k])))
            if b and len(at):
                at = at[~(keys[at, :b] == keys[k, :b]).any(axis=1)]
            return at, near[at]

        out = sorted({(min(node[k], node[a]), max(node[k], node[a])) if k >= 0 else (-1, cols["band"][0]) for k, a in pick(sig, root, meet)})
        return [u for u, _ in out], [v for _, v in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come one after the other; a batch may end within one."""
        rest = None
        for batch in _with_end(batches):
            table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks() if rest is not None or batch is not None else None
            if table is None or not len(table):
                continue
            cols = {c: table.column(c).to_numpy() for c in ("b", "band", "node", "root", "own", "i", "j")}
            change = (np.diff(cols["band"]) != 0) | (np.diff(cols["i"]) != 0) | (np.diff(cols["j"]) != 0)
            starts = np.concatenate([[0], np.flatnonzero(change) + 1, [len(table)]])
            done = len(starts) - 1 if batch is None else len(starts) - 2
            us, vs = [], []
            sigs = table.column("sig").to_pylist()
            for a, z in zip(starts[:done], starts[1 : done + 1], strict=True):
                u, v = chosen({c: x[a:z] for c, x in cols.items()}, sigs[a:z])
                us += u
                vs += v
            rest = None if batch is None else table.slice(starts[done]).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    blocks = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")
    return blocks.mapInArrow(B.released(run), "u long, v long")


def _with_end(items: Iterator) -> Iterator:
    yield from items
    yield None


def widened(roots: DataFrame, more: DataFrame, most_keys: int = MOST_KEYS) -> DataFrame:
    """``roots`` as ``components`` gives them, after the links ``more`` (u, v): only the components that these
    join are put together anew."""
    known = _sent(roots, most_keys)
    ends = more.join(known.toDF("u", "a"), "u", "left").join(known.toDF("v", "b"), "v", "left")
    top = components(ends.select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")))
    moved = top.select(F.col("node").alias("root"), F.col("root").alias("least"))
    # a component of any size may move: its rows aren't dealt by root
    met = roots.join(F.broadcast(moved), "root", "left") if top.count() <= most_keys else joined(roots, moved, ["root"], "left")
    return staged(met.select("node", F.coalesce("least", "root").alias("root")).unionByName(top), "roots")


def grouped(docs: DataFrame, limit: float = LIMIT, most_keys: int = MOST_KEYS) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> (doc_id, digest, mid) of every row, and for every digest: how many rows have
    it (n), the size of its class and the class' first row (by doc_id, nulls last, and mid)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.sha2(text_or_empty("text"), 256)).alias("digest"))
    # ids are made before the table is written, so they stay
    base = staged(sketched(rows).withColumn("mid", F.monotonically_increasing_id()), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mid", "digest")).alias("first")
    nodes = staged(base.groupBy("digest").agg(F.min("mid").alias("node"), F.count("*").alias("n"), first), "nodes")
    reps = base.join(nodes.select(F.col("node").alias("mid")), "mid").select(F.col("mid").alias("node"), F.posexplode("bands").alias("b", "band"))
    multi = reps.groupBy("band").agg(F.min("node").alias("centre"), F.max("node").alias("last")).filter("centre != last").select("band", "centre")
    members = staged(reps.join(multi, "band"), "members")
    keys = members.select("node").distinct().join(nodes.select("node", "digest"), "node")
    keys = staged(keys, "candidates")
    near = F.broadcast(keys) if keys.count() <= most_keys else keys
    held = staged(shingled(rows.join(near, "digest").dropDuplicates(["node"]).select("node", "text")), "shingles")
    stars = members.filter("node != centre").select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct()
    roots = components(staged(verified(staged(stars, "stars"), held, limit, most_keys), "links"))
    # medoids only spare partners' pairs, so a few bands are enough for them; partners go through all
    tried = staged(_across(members.filter(F.col("b") < MEDOID_BANDS), held, roots, _medoids, most_keys), "across")
    if not tried.isEmpty():
        roots = widened(roots, staged(verified(tried, held, limit, most_keys), "near"), most_keys)
    most, left = 1, members
    while True:  # until no candidate between components is left: more partners a round, none verified twice
        found = staged(_across(left, held, roots, _partners(most), most_keys), "across")
        new = staged(found.filter("u >= 0").join(tried, ["u", "v"], "left_anti"), "partners")
        near = staged(verified(new, held, limit, most_keys), "near")
        if not near.isEmpty():
            roots = widened(roots, near, most_keys)
        tried, most = tried.unionByName(new), GROWTH * most
        # a bucket that had no more than these has all its candidates verified
        more = found.filter("u < 0").select(F.col("v").alias("band"))
        if more.isEmpty():
            break
        left = staged(left.join(more, "band", "left_semi"), "left")
    # classes are put together from digests, so rows are joined once and copies never meet in one task
    rooted = staged(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    sums = staged(rooted.groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"), F.count("*").alias("texts")), "sums")
    named = joined(rooted.select("digest", "n", "root"), sums.drop("texts"), ["root"], sizes=sums.withColumnRenamed("texts", "n"))
    return base.select("doc_id", "digest", "mid"), staged(named.select("digest", "n", "class_size", "first"), "classes")


def classes(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size, keep for every row (``limit``: ``LIMIT`` or more): ``keep`` marks
    the one row of the class that stays."""
    rows, named = grouped(docs, limit)
    out = joined(rows, named.drop("n"), ["digest"], sizes=named)
    return out.select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("mid") == F.col("first.mid")).alias("keep"))


def distinct(docs: DataFrame, limit: float = LIMIT, most_keys: int = MOST_KEYS) -> DataFrame:
    """``docs`` with one row of each class: that of the least doc_id. All columns stay.

    Texts aren't dealt out: rows meet the (digest, id) pairs that go, broadcast while they number no
    more than ``most_keys``, else joined on both columns, which no hot text makes uneven."""
    rows, named = grouped(docs.select("doc_id", "text"), limit, most_keys)
    several = named.filter("class_size > 1").drop("n")
    pairs = staged(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "pairs")
    stays = (F.col("digest") == F.col("first.digest")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    digest, id_, here, key, names = own_name("digest"), own_name("id"), own_name("stays"), own_name("key"), shielded(docs)[1]
    marked = joined(pairs, several, ["digest"]).select(F.col("digest").alias(digest), F.col("doc_id").alias(id_), stays.alias(here), "n").filter(~F.col(here) | (F.col("n") > 1)).drop("n")
    marked = staged(marked, "leaving")
    near = F.broadcast(marked) if marked.count() <= most_keys else marked
    own = docs.toDF(*names.values())
    own = own.withColumn(key, F.unhex(F.sha2(text_or_empty(names["text"]), 256)))
    met = own.join(near, (F.col(key) == F.col(digest)) & F.col(names["doc_id"]).cast("long").eqNullSafe(F.col(id_)), "left")
    # rows equal in id and text: one of them stays
    repeated = met.filter(F.col(here)).dropDuplicates([digest, id_])
    left = met.filter(F.col(here).isNull()).unionByName(repeated)
    return left.select(*[F.col(n).alias(c) for c, n in names.items()])
