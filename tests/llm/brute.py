"""Plain Python versions of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from math import log2

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(ASCII_LOWER))


def contamination(docs, items, n=10):
    """{doc index: (n_words, n_hit, n_items, sha, contaminated)}"""
    wins = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        if k:
            for i in range(len(w) - k + 1):
                wins.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(x) for x in wins}
    out = []
    for doc_id, text in docs:
        w, hit, got = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if found := wins.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    got |= found
        got = sorted(str(x) for x in got if x is not None)
        out.append((doc_id, len(w), len(hit), len(got), sha(",".join(got)), bool(hit)))
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_b64")
ALLOW = re.compile(r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$|^[^0-9A-Z]*$|^[^0-9a-z]*$|^[^A-Za-z]*$")


def entropy(s):
    return -sum(c / len(s) * log2(c / len(s)) for c in Counter(s).values())


def secret_spans(text):
    text = text or ""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    more = []
    for kind, chars, least in (("entropy_hex", "0-9A-Fa-f", 3.0), ("entropy_b64", "A-Za-z0-9+/_=-", 4.0)):
        for m in re.finditer(f"[{chars}]{{24,}}", re.sub("example|EXAMPLE", " " * 7, text)):
            run = m[0]
            if ALLOW.search(run):
                continue
            at = [i for i in range(len(run) - 23) if entropy(run[i : i + 24]) >= least - 1e-7]
            spans = []
            for i in at:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + 24
                else:
                    spans.append([i, i + 24])
            more += [(kind, m.start() + a, m.start() + b) for a, b in spans]
    key = lambda x: (x[1], KINDS.index(x[0]), x[2])
    say = lambda xs: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(xs, key=key))
    n = Counter(k for k, _, _ in base)
    return n["assign"], n["access"], n["hex"], sha(say(base)), say(base + more)


def crc(text):
    return zlib.crc32((text or "").encode())


def shingle_counts(text, size=5):
    w = words(text)
    if not w:
        return Counter()
    if len(w) < size:
        return Counter([tuple(w)])
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def probability_jaccard(x, y):
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in x.keys() | y.keys()) for i in x.keys() & y.keys())


def near_classes(docs, limit=0.8):
    """Class (least doc_id) of each (doc_id, text), over all pairs that share a shingle."""
    up = {}

    def find(a):
        while up.setdefault(a, a) != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    first, sets, holds = {}, [], {}
    for k, (_, text) in enumerate(docs):
        text = text or ""
        if text in first:
            up[find(k)] = find(first[text])
            sets.append(None)
            continue
        first[text] = k
        sets.append(shingle_counts(text))
        for s in sets[-1]:
            holds.setdefault(s, []).append(k)
    shared = Counter((a, b) for ks in holds.values() for i, a in enumerate(ks) for b in ks[i + 1 :])
    for (a, b), n in shared.items():
        if n >= 0.5 * min(len(sets[a]), len(sets[b])) and find(a) != find(b) and probability_jaccard(sets[a], sets[b]) >= limit:
            up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        least[r] = min(least.get(r, i), i)
    return {k: least[find(k)] for k in range(len(docs))}


def ppm_trees(texts, order=4):
    """Per context of up to ``order`` bytes: how often each byte followed."""
    tree = {}
    for t in texts:
        raw = b" " * order + fold(t)
        for i in range(order, len(raw)):
            for k in range(order + 1):
                tree.setdefault(raw[i - k : i], Counter())[raw[i]] += 1
    return tree


def fold(text):
    return bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())


def ppm_bits(tree, text, order=4):
    raw, bits = b" " * order + fold(text), 0.0
    for i in range(order, len(raw)):
        for k in range(order, -1, -1):
            after = tree.get(raw[i - k : i])
            if after is None:
                continue
            n, d = sum(after.values()), len(after)
            if raw[i] in after:
                bits -= log2(after[raw[i]] / (n + d))
                break
            bits -= log2(d / (n + d))
        else:
            bits += 8
    return bits


def sentences_of(text):
    """(start, end) in code points: a sentence ends after . ! ? or a line break."""
    out, at = [], 0
    for i, c in enumerate(text or ""):
        if c in ".!?\n":
            out.append((at, i + 1))
            at = i + 1
    if at < len(text or ""):
        out.append((at, len(text)))
    return out
