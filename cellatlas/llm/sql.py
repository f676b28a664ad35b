"""DuckDB's SQL for the queries that SQL can express."""

from __future__ import annotations

import math

from . import quality as Q
from . import secrets as S
from .secrets import BASE

SPACE = r"[\x20\x09-\x0D]"

_FAILED = {
    "base": "n_words < 50 OR 100 * n_repeat_words > 50 * n_words",
    "symbols": "20 * n_symbols > word_chars",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars > 15 * n_words OR word_chars < 2 * n_words",
}

QUALITY = f"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
w AS (SELECT row, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (SELECT row, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS words FROM t)),
win AS (SELECT row, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS three FROM w WINDOW o AS (PARTITION BY row ORDER BY i)),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, three) AS n FROM win WHERE three IS NOT NULL) WHERE n > 1),
rep AS (SELECT row, count(*) AS n FROM (SELECT row, i FROM again UNION SELECT row, i + 1 FROM again UNION SELECT row, i + 2 FROM again) GROUP BY row),
wc AS (SELECT row, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars FROM w GROUP BY row),
ln AS (SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
c AS (SELECT doc_id, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines FROM t LEFT JOIN wc USING (row) LEFT JOIN rep USING (row) LEFT JOIN ln USING (row)),
f AS (SELECT *, {", ".join(f"({x}) AS f_{k}" for k, x in _FAILED.items())} FROM c),
a AS (SELECT *, {" OR ".join(f"f_{k}" for k in _FAILED)} AS any_failed FROM f),
h AS (SELECT source AS host, count(*) AS n, sum(CASE WHEN any_failed THEN 1 ELSE 0 END) AS failed FROM a GROUP BY 1),
m AS (SELECT (sum(failed) + 0.5) / (sum(n) + 1) AS mean, avg(failed / n) AS plain, avg(power(failed / n, 2)) AS square, avg(1 / n) AS inverse FROM h),
s AS (SELECT mean, square - plain * plain - plain * (1 - plain) * inverse AS spread FROM m),
p AS (SELECT mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 0.5), 1e6) ELSE 1e6 END AS strength FROM s),
r AS (SELECT host, (failed + mean * strength) / (n + strength) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_base AS base_failed, round(rate, 6) AS host_rate, {Q.ODDS["none"]} * rate < 1 - rate AS host_kept,
  NOT f_base AND {Q.ODDS["none"]} * rate < 1 - rate AND (NOT any_failed OR {" * ".join(f"(CASE WHEN f_{k} THEN {Q.ODDS[k]} ELSE 1 END)" for k in _FAILED)} * rate < 1 - rate) AS kept
FROM a JOIN r ON source IS NOT DISTINCT FROM host"""

_ASSIGN = S.ASSIGN.replace("'", "''")


def _found(name: str, pattern: str, kind: str, rank: int, group: int) -> str:
    return f"""{name}_p AS (SELECT row, regexp_split_to_array(text, '{pattern}') AS gap, regexp_extract_all(text, '{pattern}') AS whole, regexp_extract_all(text, '{pattern}', {group}) AS own FROM t WHERE regexp_matches(text, '{pattern}')),
{name}_u AS (SELECT row, unnest(whole) AS w, unnest(own) AS g, unnest(gap[1:len(whole)]) AS before, generate_subscripts(whole, 1) AS i FROM {name}_p),
{name} AS (SELECT row, '{kind}' AS kind, {rank} AS rank, g, e - length(w) AS b, e FROM (SELECT *, CAST(sum(length(before) + length(w)) OVER (PARTITION BY row ORDER BY i) AS BIGINT) AS e FROM {name}_u))"""


_HIGH = " ".join(f"WHEN regexp_matches(g, '{p}') THEN {least}" for p, least in S.HIGH)
SECRETS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
{_found("assign", _ASSIGN, "assign", 0, 2)},
{_found("access", S.ACCESS, "access", 1, 0)},
{_found("hex", S.HEX, "hex", 2, 0)},
{_found("cand", S.CANDIDATE, "entropy", 3, 0)},
base AS (SELECT * FROM assign WHERE length(g) >= 6 UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
strings AS (SELECT DISTINCT g FROM cand WHERE regexp_matches(g, '[0-9]') AND regexp_matches(g, '[A-Za-z]') AND NOT regexp_matches(g, '{S.ALLOWED}') AND NOT (contains(g, '/') AND NOT contains(g, '//') AND regexp_matches(g, '{S.PATH}'))),
windows AS (SELECT g, k, substr(g, k, {S.WINDOW}) AS x FROM (SELECT g, unnest(range(1, length(g) - {S.WINDOW} + 2)) AS k FROM strings)),
letters AS (SELECT g, k, c, count(*) AS n FROM (SELECT g, k, unnest(string_split(x, '')) AS c FROM windows) GROUP BY ALL),
entropy AS (SELECT g, max(h) AS h FROM (SELECT g, k, {math.log2(S.WINDOW)!r} - sum(n * log2(n)) / {S.WINDOW} AS h FROM letters GROUP BY 1, 2) GROUP BY 1),
more AS (SELECT cand.* FROM cand JOIN entropy USING (g) WHERE round(h, 9) >= CASE {_HIGH} END AND NOT EXISTS (SELECT 1 FROM base WHERE base.row = cand.row AND base.b < cand.e AND cand.b < base.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more),
s AS (SELECT row, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)}, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (kind <> 'entropy') AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans FROM every GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN s USING (row)"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEARDUP = f"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{SPACE}+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) USING (doc_id)"""

NEGATIVES = """
WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT row, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT row, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM v)),
s AS (SELECT a.row AS a, b.row AS b, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM q a JOIN v ON v.row = a.row AND vec_id % 100 = 0 JOIN q b ON a.i = b.i AND a.row <> b.row GROUP BY 1, 2),
t AS (SELECT s.*, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same FROM s JOIN v a ON a.row = s.a JOIN v b ON b.row = s.b),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS r FROM t WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, t.vec_id AS negative_id, p.score AS positive_score, t.score AS negative_score,
  row_number() OVER (PARTITION BY p.a, p.b ORDER BY t.score DESC, t.vec_id, t.b) AS rank FROM p JOIN t ON t.a = p.a AND NOT t.same AND 80 * p.score <= 100 * t.score AND 100 * t.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
