"""Secret scans: patterns, and sliding-window Shannon entropy by character class.

Spans are (start, end, kind) in code points, end exclusive. The kinds, in this order:

- ``assign``: a credential name, a sign of assignment and a value of 6+ characters;
- ``access``: an access key id of 20+ characters;
- ``hex``: a run of 24+ lower-case hexadecimal digits;
- ``entropy_hex``, ``entropy_b64``: in a run of the class's characters, what the windows cover whose
  entropy reaches the class's limit.

Entropy is kept by counts: a step of the window lowers the count of the character that leaves,
raises that of the one that enters, and changes the sum of c*log2(c) by those two terms. Counts are
held in five bits a character, ``PER`` to a long, and the terms are whole numbers (millionths of a
bit), so results don't depend on the order of additions.

The allow-list: placeholder words (``PLACEHOLDER``) end a run on either side, so no window touches
them; runs that are dashed unique ids, or lack a digit and one of the two cases, or lack letters,
have no span.

Everything is DataFrame functions, and the work grows in proportion to the text: runs are taken
apart in pieces of ``PIECE`` windows, and places follow from sums in two levels.

Defined cases: a null text counts as empty (no span); a run of any length is scanned whole; repeated
rows each get their result; an empty table gives no rows; extra columns are left out of ``scan`` and
kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import disjoint, let, own_name, running, shielded, text_or_empty

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_b64")
#: Letters in either case are spelt out: engines differ in what else ignoring case matches.
NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token"))
ASSIGN = rf"""({NAMES}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # of runs only long ones count, so shorter ones needn't be matched at all
#: class: (characters, window, least entropy in bits)
CLASSES = {
    "entropy_hex": ("0123456789abcdefABCDEF", 24, 3.0),
    "entropy_b64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.0),
}
ALLOW = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$|^[^0-9A-Z]*$|^[^0-9a-z]*$|^[^A-Za-z]*$"
PLACEHOLDER, BLANK = "EXAMPLE|example", "       "  # as long as the words, so places stay
MARK = "[REDACTED]"
PIECE, PER, REDACT_PIECE = 512, 12, 1024

SPAN = "array<struct<start:int,ord:int,end:int>>"


def terms(window: int) -> list[int]:
    """c*log2(c) in millionths of a bit for c = 0..window."""
    return [round(c * math.log2(c) * 1e6) if c else 0 for c in range(window + 1)]


def most_terms(window: int, least: float) -> int:
    """A window reaches ``least`` bits when its terms sum to this or less."""
    return math.floor(window * (math.log2(window) - least) * 1e6)


def _matches(rows: DataFrame, text: str, pattern: str, out: str, group: int = 0) -> DataFrame:
    """``rows`` with ``out``: (start, m, v) of each leftmost match, in order: its place, its text and that
    of its group. Null where the text has no match."""
    found, steps, before = own_name("found"), own_name("steps"), own_name("before")
    t = F.col(text)
    parts = F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(t, F.lit(pattern), F.lit(group)).alias("v"), F.split(t, pattern).alias("g"))
    rows = rows.withColumn(found, F.when(t.rlike(pattern), parts))
    # before a match lie the texts between, its own among them, and the matches before it
    gap = lambda x, i: F.length(x["g"][i]) + F.when(i > 0, F.length(x["m"][i - 1])).otherwise(0)
    rows = rows.withColumn(steps, let(F.col(found), lambda x: F.transform(x["m"], lambda _, i: gap(x, i))))
    rows = running(rows, steps, before, 0, lambda a, b: a + b)
    all_ = F.struct(F.col(found).alias("x"), F.col(steps).alias("d"), F.col(before).alias("b"))
    places = let(all_, lambda a: F.transform(a["x"]["m"], lambda m, i: F.struct((a["b"][i] + a["d"][i]).alias("start"), m.alias("m"), a["x"]["v"][i].alias("v"))))
    return rows.withColumn(out, F.when(F.col(found).isNotNull(), places)).drop(found, steps, before)


def _span(start: Column, length: Column, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("ord"), (start + length).cast("int").alias("end"))


def _base(rows: DataFrame, text: str, out: str) -> DataFrame:
    none, found = F.array().cast(SPAN), []
    for kind, pattern, group, least in (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24)):
        found.append(own_name(kind))
        rows = _matches(rows, text, pattern, found[-1], group)
        long = F.filter(found[-1], lambda x: F.length(x["v"]) >= least)  # noqa: B023
        # a lambda's parameters are all Spark's, so the limit comes from the scope
        rows = rows.withColumn(found[-1], F.coalesce(F.transform(long, lambda x: _span(x["start"], F.length(x["m"]), kind)), none))  # noqa: B023
    return rows.withColumn(out, F.concat(*found)).drop(*found)


def _pieces(run: Column, window: int) -> Column:
    """The run in pieces of PIECE characters, each with the window - 1 that follow."""
    parts = F.regexp_extract_all(run, F.lit(f".{{1,{PIECE}}}"), F.lit(0))
    after = lambda p, k: F.concat(F.coalesce(F.get(p, k + 1), F.lit("")), F.coalesce(F.get(p, k + 2), F.lit("")))
    return let(parts, lambda p: F.transform(p, lambda x, k: F.concat(x, F.substr(after(p, k), F.lit(1), F.lit(window - 1)))))


def _cover(piece: Column, kind: str) -> Column:
    """What the piece's windows cover whose entropy reaches the limit: (start, end) in order, apart."""
    chars, window, least = CLASSES[kind]
    t, limit = terms(window), most_terms(window, least)
    up = F.array(*[F.lit(b - a) for a, b in zip(t, t[1:], strict=False)])  # what one more of a character adds
    words = [f"w{k}" for k in range(-(-len(chars) // PER))]
    none, one = F.array().cast("array<struct<start:int,end:int>>"), F.lit(1).cast("long")
    # each character as the word that holds its count, the count's place there, and one at that place
    codes = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(chars), c) - 1)
    placed = F.transform(codes, lambda c: F.struct(F.floor(c / PER).cast("int").alias("w"), (c % PER * 5).alias("s"), F.call_function("shiftleft", one, c % PER * 5).alias("d")))

    def count(s: Column, x: Column) -> Column:
        word = s[words[0]]
        for k, name in enumerate(words[1:], 1):
            word = F.when(x["w"] == k, s[name]).otherwise(word)
        return F.call_function("shiftrightunsigned", word, x["s"]).bitwiseAND(F.lit(31).cast("long")).cast("int")

    def moved(s: Column, x: Column, gone: Column | None = None) -> list[Column]:
        """Counts and sum with x in, and ``gone`` out."""
        add = lambda k, c: F.when(c["w"] == k, c["d"]).otherwise(0)
        if gone is None:
            return [*[(s[w] + add(k, x)).alias(w) for k, w in enumerate(words)], (s["sum"] + up[count(s, x)]).alias("sum")]
        had = count(s, x) - F.when((x["w"] == gone["w"]) & (x["s"] == gone["s"]), 1).otherwise(0)
        return [*[(s[w] + add(k, x) - add(k, gone)).alias(w) for k, w in enumerate(words)], (s["sum"] - up[count(s, gone) - 1] + up[had]).alias("sum")]

    def closed(s: Column) -> Column:
        return F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def seen(s: Column, at: Column) -> list[Column]:
        """The open span is made longer by a window that touches it; one apart closes it."""
        yes = s["sum"] <= limit
        apart = yes & (at > s["end"])
        return [F.when(apart, at).otherwise(s["start"]).alias("start"), F.when(yes, at + window).otherwise(s["end"]).alias("end"), F.when(apart & (s["end"] > 0), closed(s)).otherwise(s["done"]).alias("done")]

    def over(code: Column) -> Column:
        last = F.size(code) - window
        zero = F.struct(*[F.lit(0).cast("long").alias(w) for w in words], F.lit(0).alias("sum"))
        whole = lambda s: F.struct(*[s[w].alias(w) for w in words], s["sum"].alias("sum"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), none.alias("done"))
        first = F.aggregate(F.sequence(F.lit(0), F.lit(window - 1)), zero, lambda s, i: F.struct(*moved(s, code[i])), whole)
        step = lambda s, i: F.struct(*moved(s, code[i + window - 1], code[i - 1]), *seen(s, i - 1))
        end = lambda s: let(F.struct(*seen(s, last)), lambda z: F.when(z["end"] > 0, closed(z)).otherwise(none))
        rest = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.when(last >= 0, F.aggregate(rest, first, step, end)).otherwise(none)

    return let(placed, over)


def _entropy(rows: DataFrame, text: str, kind: str, out: str) -> DataFrame:
    """``rows`` with ``out``: what the class's windows cover, as disjoint spans."""
    _, window, _ = CLASSES[kind]
    one = "0-9A-Fa-f" if kind == "entropy_hex" else "A-Za-z0-9+/_=-"
    own, found, covers, flat = own_name("text"), own_name("found"), own_name("covers"), own_name("flat")
    rows = rows.withColumn(own, F.when(F.col(text).rlike(PLACEHOLDER), F.regexp_replace(text, PLACEHOLDER, BLANK)).otherwise(F.col(text)))
    rows = _matches(rows, own, rf"(?<![{one}])[{one}]{{{window},}}", found)
    runs = F.filter(found, lambda x: ~x["m"].rlike(ALLOW))
    # pieces of all runs of a text, with their places in it
    each = F.flatten(F.transform(runs, lambda x: F.transform(_pieces(x["m"], window), lambda p, k: F.struct((x["start"] + k * PIECE).alias("at"), p.alias("p")))))
    rows = rows.withColumn(covers, each)
    rows = rows.withColumn(flat, F.flatten(F.transform(covers, lambda x: F.transform(_cover(x["p"], kind), lambda c: F.struct((x["at"] + c["start"]).alias("start"), (x["at"] + c["end"]).alias("end"))))))
    rows = disjoint(rows, flat, out)
    return rows.withColumn(out, F.transform(out, lambda x: _span(x["start"], x["end"] - x["start"], kind))).drop(own, found, covers, flat)


def _string(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", names[s["ord"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def found(rows: DataFrame, text: str, base: str, all_: str) -> DataFrame:
    """``rows`` with the spans (start, ord, end) of ``text`` (not null): ``base`` by the patterns, ``all_`` of
    all kinds."""
    more = [own_name(k) for k in CLASSES]
    rows = _base(rows, text, base)
    for kind, name in zip(CLASSES, more, strict=True):
        rows = _entropy(rows, text, kind, name)
    return rows.withColumn(all_, F.concat(base, *more)).drop(*more)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of ``docs``."""
    rows = found(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")), "text", "base", "all")
    count = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")
    return rows.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_string(F.col("base")), 256).alias("base_sha256"), _string(F.col("all")).alias("spans"))


def redact(docs: DataFrame, mark: str = MARK, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; ``length_col`` is set
    anew where text changes. No row goes."""
    rows, kept = shielded(docs)
    base, every, spans, whole, text = *[own_name(x) for x in ("base", "all", "spans", "whole")], F.col(kept[text_col])
    rows = rows.withColumn(whole, text_or_empty(text))
    rows = disjoint(found(rows, whole, base, every), every, spans)

    def cut(part: Column, k: Column, own: Column) -> Column:
        """Of a piece of the text, what no span covers, and a mark where a span begins."""
        at = k * REDACT_PIECE

        def step(s: Column, x: Column) -> Column:
            start, end = F.greatest(x["start"] - at, F.lit(0)), F.least(x["end"] - at, F.lit(REDACT_PIECE))
            more = F.concat(s["out"], F.substr(part, s["at"] + 1, start - s["at"]), F.when(x["start"] >= at, F.lit(mark)).otherwise(""))
            return F.struct(more.alias("out"), end.alias("at"))

        inside = F.filter(own, lambda x: (x["start"] < at + REDACT_PIECE) & (x["end"] > at))
        return F.aggregate(inside, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda s: F.concat(s["out"], F.substr(part, s["at"] + 1)))

    hit = F.size(spans) > 0
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{REDACT_PIECE}}}"), F.lit(0))
    new = F.when(hit, F.array_join(let(F.col(spans), lambda own: F.transform(parts, lambda p, k: cut(p, k, own))), "")).otherwise(text)
    out = [new.alias(c) if c == text_col else F.col(n).alias(c) for c, n in kept.items()]
    if length_col in docs.columns and length_col != text_col:
        changed = own_name("text")
        out = [F.col(changed).alias(c) if c == text_col else F.col(n).alias(c) for c, n in kept.items()]
        own = F.when(hit, F.length(changed).cast(docs.schema[length_col].dataType)).otherwise(F.col(kept[length_col]))
        return rows.withColumn(changed, new).select(*[own.alias(c) if c == length_col else x for c, x in zip(kept, out, strict=True)])
    return rows.select(*out)
