"""Site-level values: INFO, FILTER, bins, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
LOF = "frameshift_variant|start_lost|stop_gained|splice_acceptor_variant|splice_donor_variant"
NONSYN = "disruptive_inframe|inframe|initiator_codon_variant|missense_variant|stop_lost"


def info_value(info: Column, key: str) -> Column:
    """The value of ``key``; null if the key is missing."""
    found = F.regexp_extract(info, rf"(?:^|;){re.escape(key)}=([^;]*)", 1)
    return F.when(info.rlike(rf"(?:^|;){re.escape(key)}="), found)


def info_flag(info: Column, key: str) -> Column:
    return info.rlike(rf"(?:^|;){re.escape(key)}(?:;|=|$)")


def info_map(info: Column) -> Column:
    """INFO as a map; flags have the value 1; of repeated keys the first counts."""
    pairs = F.filter(F.split(info, ";"), lambda x: (x != "") & (x != "."))
    kv = F.transform(pairs, lambda x: F.struct(F.split(x, "=", 2)[0].alias("k"), F.coalesce(F.try_element_at(F.split(x, "=", 2), F.lit(2)), F.lit("1")).alias("v")))
    keys = F.array_distinct(F.transform(kv, lambda x: x["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.filter(kv, lambda x: x["k"] == k)[0]["v"])))


def is_number(s: Column) -> Column:
    """X18."""
    return s.rlike(NUMBER)


def feature(info: Column, key: str, default: float = 0.0) -> Column:
    """P5: a key as a number; what isn't one is 0, a missing key the default."""
    v = info_value(info, key)
    return F.when(v.isNull(), F.lit(float(default))).when(is_number(v), v.try_cast("double")).otherwise(0.0)


def info_append(info: Column, key: str, value: Column) -> Column:
    """P6."""
    one = F.concat(F.lit(key + "="), value.cast("string"))
    return F.when(info.isNull() | info.isin("", "."), one).otherwise(F.concat(info, F.lit(";"), one))


def info_drop(info: Column, key_pattern: str) -> Column:
    """Without the keys that match; ``.`` if nothing is left."""
    kept = F.filter(F.split(info, ";"), lambda x: ~x.rlike(rf"^(?:{key_pattern})(?:=|$)"))
    return F.when(F.size(kept) > 0, F.array_join(kept, ";")).otherwise(".")


def break_label(v: Column, breaks: list[float], name: str = "") -> Column:
    """``(-Inf,b0)``, ``[b0,b1)`` ... ``[bk,Inf)``; null gives ``.``."""
    say = lambda x: f"{x:g}"
    out = F.when(v.isNull(), ".").when(v < breaks[0], f"{name}(-Inf,{say(breaks[0])})")
    for a, b in zip(breaks, breaks[1:], strict=False):
        out = out.when(v < b, f"{name}[{say(a)},{say(b)})")
    return out.otherwise(f"{name}[{say(breaks[-1])},Inf)")


def uniform_label(v: Column, width: int) -> Column:
    """``[floor(v/w)*w, +w)`` by truncation."""
    low = (v / width).cast("long") * width
    return F.when(v.isNull(), ".").otherwise(F.concat(F.lit("["), low.cast("string"), F.lit(","), (low + width).cast("string"), F.lit(")")))


def mixed_label(ac: Column, an: Column, breaks: list[float]) -> Column:
    """Breaks of 1 and more are counts, those under 1 frequencies ac/(an+1e-6); counts come first,
    a 0 before them; the bin between both kinds is named by both."""
    breaks = [0, *breaks] if breaks[0] != 0 else list(breaks)
    counts, freqs = [b for b in breaks if b == 0 or b >= 1], [b for b in breaks if 0 < b < 1]
    say, af = lambda x: f"{x:g}", ac / (an + 1e-6)
    out = F.when(ac.isNull(), ".")
    for a, b in zip(counts, counts[1:], strict=False):
        out = out.when(ac < b, f"AC=[{say(a)},{say(b)})")
    if not freqs:
        return out.otherwise(f"AC=[{say(counts[-1])},Inf)")
    out = out.when(af < freqs[0], f"[AC={say(counts[-1])},AF={say(freqs[0])})")
    for a, b in zip(freqs, freqs[1:], strict=False):
        out = out.when(af < b, f"AF=[{say(a)},{say(b)})")
    return out.otherwise(f"AF=[{say(freqs[-1])},1]")


def minor(ac: Column, an: Column) -> Column:
    """P9."""
    return F.least(ac, an - ac)


def bed_interval(pos: Column, ref: Column) -> tuple[Column, Column]:
    """0-based half-open interval of a site."""
    return pos - 1, pos + F.length(ref) - 1


def plain_chrom(chrom: Column) -> Column:
    """Without ``chr``; PLINK's 23-26 and M by name."""
    c = F.regexp_replace(chrom, "^chr", "")
    return F.when(c == "23", "X").when(c == "24", "Y").when(c == "25", "X").when(c.isin("26", "M"), "MT").otherwise(c)


def chrom_ordinal(chrom: Column) -> Column:
    """1-22, X 23, Y 24, MT 25; others after them."""
    c = plain_chrom(chrom)
    return F.when(c == "X", 23).when(c == "Y", 24).when(c == "MT", 25).otherwise(F.coalesce(c.try_cast("int"), F.lit(99)))


def prefix_filter(filter_: Column, prefix: str = "", renames: dict[str, str] | None = None) -> Column:
    """Each FILTER token renamed or prefixed; PASS and ``.`` stay."""
    def one(t: Column) -> Column:
        out = F.when(t.isin("PASS", "."), t)
        for a, b in (renames or {}).items():
            out = out.when(t == a, b)
        return out.otherwise(F.concat(F.lit(prefix), t))

    return F.array_join(F.transform(F.split(filter_, ";"), one), ";")


def effect_flags(info: Column) -> dict[str, Column]:
    """Lof implies nonsyn implies coding."""
    eff = F.coalesce(F.regexp_extract(info, r"EFF=([^(]+)", 1), F.lit(""))
    lof, non = eff.rlike(LOF), eff.rlike(f"{LOF}|{NONSYN}")
    return {"lof": lof, "nonsyn": non, "coding": non | eff.rlike("synonymous_variant")}


def fpos(ordinal: Column, pos: Column) -> Column:
    """``ordinal.pos`` with nine digits of position."""
    return F.concat(ordinal.cast("string"), F.lit("."), F.lpad(pos.cast("string"), 9, "0"))


def from_fpos(s: Column) -> tuple[Column, Column]:
    return F.split_part(s, F.lit("."), F.lit(1)).cast("int"), F.split_part(s, F.lit("."), F.lit(2)).cast("long")


def log_bin(ac: Column) -> Column:
    """int(10 * log10 ac)."""
    return F.when(ac > 0, (F.log10(ac) * 10).cast("int"))


def join_affixed(ids: Column, separator: str, prefix: str = "", suffix: str = "") -> Column:
    """X20."""
    return F.array_join(F.transform(ids, lambda x: F.concat(F.lit(prefix), x, F.lit(suffix))), separator)


def parse_region(s: Column) -> tuple[Column, Column, Column]:
    """``chr:beg-end``, ends may have thousands' commas."""
    num = lambda k: F.regexp_replace(F.regexp_extract(s, r"^(.+):([\d,]+)-([\d,]+)$", k), ",", "").try_cast("long")
    return F.regexp_extract(s, r"^(.+):([\d,]+)-([\d,]+)$", 1), num(2), num(3)


_TEST = re.compile(r"^\s*(\w+)\s*(>=|<=|==|!=|>|<|=)\s*(\S+)\s*$")


def info_predicate(info: Column, test: str, filter_: Column | None = None) -> Column:
    """``KEY>VAL`` (numbers where both are), ``KEY`` (present), or ``FILTER~text`` (contains)."""
    if test.startswith("FILTER~"):
        return F.contains(filter_, F.lit(test[7:]))
    m = _TEST.match(test)
    if not m:
        return info_flag(info, test.strip())
    key, op, val = m.groups()
    v = info_value(info, key)
    left, right = (v.try_cast("double"), F.lit(float(val))) if re.match(NUMBER, val) else (v, F.lit(val))
    found = {">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right, "=": left == right, "==": left == right, "!=": left != right}[op]
    return F.coalesce(found, F.lit(False))


def pass_like(filter_: Column, exact: bool = True) -> Column:
    """PASS or 0 exactly, or (``exact=False``) a string that contains PASS."""
    return filter_.isin("PASS", "0") if exact else F.contains(filter_, F.lit("PASS"))


def is_snp(ref: Column, alt: Column) -> Column:
    """one base on either side."""
    return (F.length(ref) == 1) & (F.length(alt) == 1)


def is_indel(ref: Column, alt: Column) -> Column:
    """one ALT, of another length than one base for one."""
    return ~F.contains(alt, F.lit(",")) & ((F.length(ref) > 1) | (F.length(alt) > 1))


def autosomal(chrom: Column) -> Column:
    """F4."""
    return chrom.rlike(r"^(chr)?\d+$")


def maf_between(ac: Column, an: Column, low: float, high: float) -> Column:
    """F8: the minor allele's share, both ends in."""
    return (minor(ac, an) / an).between(low, high)


def polymorphic(ac: Column, an: Column) -> Column:
    """Both alleles occur."""
    return (ac > 0) & (ac < an)


def substituted(template: str, values: dict[str, Column]) -> Column:
    """``$k$`` and ``${k}$`` of a template by each row's values."""
    out = F.lit(template)
    for name, value in values.items():
        for mark in (f"${name}$", f"${{{name}}}$"):
            out = F.replace(out, F.lit(mark), value)
    return out


def pair_squares(pairs: list[tuple[Column, Column]]) -> Column:
    """Sum of the squared differences of the pairs."""
    return sum(((a - b) * (a - b) for a, b in pairs[1:]), (pairs[0][0] - pairs[0][1]) * (pairs[0][0] - pairs[0][1]))
