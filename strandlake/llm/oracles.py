"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from strandlake.llm import secrets

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"coalesce(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

DECONTAMINATE = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, k, unnest(list_transform(range(0, len(w) - k + 1), lambda i: array_to_string(w[i + 1:i + k], ' '))) AS win FROM (SELECT item, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT rid, k, i, array_to_string(w[i + 1:i + k], ' ') AS win FROM (SELECT rid, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM d, ks)),
hit AS (SELECT rid, i, k, item FROM dw JOIN win USING (k, win)),
cov AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM hit)) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, sha256(array_to_string(list_sort(list_distinct(list(item))), ',')) AS sha FROM hit GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(name: str, pattern: str, group: int, source: str = "d") -> str:
    """(rid, start, m, v) of every match: its place from the texts between matches."""
    p = _quoted(pattern)
    size = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)"
    return f"""{name} AS (SELECT rid, CAST({size.format("g[1:i]")} + {size.format("m[1:i - 1]")} AS BIGINT) AS start, m[i] AS m, v[i] AS v FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM
(SELECT rid, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v, string_split_regex(t, {p}) AS g FROM {source} WHERE regexp_matches(t, {p}))))"""


def _entropy(name: str, chars: str, window: int, least: float) -> str:
    """Windows of the runs that aren't allowed, those of enough entropy, and what they cover."""
    return f"""{_matches(f"{name}_r", f"[{chars}]{{{window},}}", 0, "blanked")},
{name}_w AS (SELECT rid, start, unnest(range(0, length(m) - {window} + 1)) AS i, m FROM {name}_r WHERE NOT regexp_matches(m, {_quoted(secrets.ALLOW)})),
{name}_c AS (SELECT rid, start, i, ch, count(*) AS c FROM (SELECT rid, start, i, unnest(string_split(substr(m, i + 1, {window}), '')) AS ch FROM {name}_w) GROUP BY ALL),
{name}_h AS (SELECT rid, start, i FROM {name}_c GROUP BY rid, start, i HAVING sum(CAST(round(c * log2(c) * 1e6) AS BIGINT)) <= {secrets.most_terms(window, least)}),
{name}_g AS (SELECT *, sum(CASE WHEN i <= before + {window} THEN 0 ELSE 1 END) OVER (PARTITION BY rid, start ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(i) OVER (PARTITION BY rid, start ORDER BY i) AS before FROM {name}_h)),
{name} AS (SELECT rid, start + min(i) AS start, start + max(i) + {window} AS stop FROM {name}_g GROUP BY rid, {name}_g.start, g)"""


SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), blanked AS (SELECT rid, doc_id, regexp_replace(t, '{secrets.PLACEHOLDER}', '{secrets.BLANK}', 'g') AS t FROM d),
{_matches("a", secrets.ASSIGN, 2)}, {_matches("k", secrets.ACCESS, 0)}, {_matches("x", secrets.HEX, 0)},
{_entropy("eh", "0-9A-Fa-f", 24, 3.0)}, {_entropy("eb", "A-Za-z0-9+/_=-", 24, 4.0)},
s AS (SELECT rid, start, start + length(m) AS stop, 0 AS ord, 'assign' AS kind FROM a WHERE length(v) >= 6 UNION ALL SELECT rid, start, start + length(m), 1, 'access' FROM k WHERE length(m) >= 20 UNION ALL SELECT rid, start, start + length(m), 2, 'hex' FROM x
  UNION ALL SELECT rid, start, stop, 3, 'entropy_hex' FROM eh UNION ALL SELECT rid, start, stop, 4, 'entropy_b64' FROM eb),
n AS (SELECT rid, count_if(ord = 0) AS na, count_if(ord = 1) AS nk, count_if(ord = 2) AS nx, coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop) FILTER (WHERE ord < 3), '') AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord, stop) AS spans FROM s GROUP BY rid)
SELECT doc_id, CAST(coalesce(na, 0) AS BIGINT) AS n_assign, CAST(coalesce(nk, 0) AS BIGINT) AS n_access, CAST(coalesce(nx, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n USING (rid)"""

SQL = {"op1_secret_scan": SECRETS, "op9_decontaminate": DECONTAMINATE}
