"""SQL for DuckDB that gives the rows of llm queries by brute force."""

from __future__ import annotations

from .decontam import K, THRESHOLD
from .secrets import BASE_KINDS, KINDS
from .suffix import PASSAGE

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

MINHASH = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
d AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT y.t, r.c FROM r JOIN (SELECT a AS f, b AS t FROM l UNION ALL SELECT b, a FROM l) y ON y.f = r.doc_id)
SELECT d.doc_id, len(any_value(s)) AS n_shingles, min(c) AS component_id, d.doc_id = min(c) AS kept FROM d JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id
"""

SUFFIX = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(0, len(ws) - {PASSAGE - 1})) AS i FROM w WHERE len(ws) >= {PASSAGE}),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + {PASSAGE}], ' ')) AS h FROM s),
r AS (SELECT h FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {PASSAGE} THEN 1 ELSE 0 END AS new FROM h SEMI JOIN r USING (h)),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
x AS (SELECT doc_id, min(i) AS a, max(i) + {PASSAGE} AS b FROM k GROUP BY doc_id, k.k)
SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_repeated_words, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM x GROUP BY doc_id
"""


#: Every window of an item's size that lies over a shared shingle; only pairs with too few shared shingles are left out.
LEAKS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, ws, len(ws) AS size, least({K}, len(ws)) AS k FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
a AS (SELECT item_id, x, count(*) AS c FROM (SELECT item_id, unnest(list_transform(range(1, size - k + 2), lambda p: array_to_string(ws[p : p + k - 1], ' '))) AS x FROM i) GROUP BY ALL),
s AS (SELECT doc_id, len(ws) AS n_words, k, unnest(range(0, len(ws) - k + 1)) AS p, unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p : p + k - 1], ' '))) AS x FROM d, (SELECT DISTINCT k FROM i) WHERE len(ws) >= k),
h AS (SELECT doc_id, item_id, p, x, c, least(size, n_words) AS words, least(size, n_words) - i.k + 1 AS n, size - i.k + 1 AS m, n_words FROM s JOIN a USING (x) JOIN i USING (item_id) WHERE s.k = i.k),
q AS (SELECT doc_id, item_id, n, m, words, n_words, min(p) AS lo, max(p) AS hi FROM h GROUP BY ALL HAVING (1 + {THRESHOLD}) * count(*) >= {THRESHOLD} * (n + m) - 1e-6),
w AS (SELECT doc_id, item_id, n, m, words, unnest(range(greatest(0, lo - n + 1), least(hi, n_words - words) + 1)) AS start FROM q),
b AS (SELECT doc_id, item_id, w.n, w.m, w.words, start, x, least(count(*), any_value(c)) AS k FROM w JOIN h USING (doc_id, item_id) WHERE p BETWEEN start AND start + w.n - 1 GROUP BY ALL),
j AS (SELECT doc_id, item_id, words, start, sum(k)::DOUBLE / (n + m - sum(k)) AS similarity FROM b GROUP BY doc_id, item_id, words, start, n, m)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_max(start, (similarity, -start)) AS first_word, any_value(words) AS words FROM j WHERE similarity >= {THRESHOLD} GROUP BY doc_id, item_id
"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_PATTERNS = {
    "assign": "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + """)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "bearer": r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{16,}=*",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----",
    "token": r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}",
}
_KEEP = {"assign": "len(v) >= 6", "access": "len(m) >= 20", "hex": "len(m) >= 24"}


def _kind(at: int, kind: str) -> str:
    """Matches of a kind with their places: what lies between them, and the matches before, add up to a start."""
    p = _PATTERNS[kind].replace("'", "''")
    value = f"regexp_extract_all(t, '{p}', 2)" if kind == "assign" else "ms"
    return f"""SELECT doc_id, {at} AS o, '{kind}' AS kind, start, start + len(m) AS stop FROM (SELECT doc_id, m, v, sum(len(g)) OVER w + sum(len(m)) OVER w - len(m) AS start FROM
 (SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1 : len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (SELECT doc_id, ms, {value} AS vs, regexp_split_to_array(t, '{p}') AS gs FROM (SELECT doc_id, t, regexp_extract_all(t, '{p}') AS ms FROM d)))
 WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {_KEEP.get(kind, "true")}"""


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_kind(i, k) for i, k in enumerate(KINDS))}),
s AS (SELECT doc_id, o, start, kind || ':' || start::BIGINT || ':' || stop::BIGINT AS s FROM f)
SELECT d.doc_id, {", ".join(f"count(*) FILTER (WHERE o = {i}) AS n_{k}" for i, k in enumerate(BASE_KINDS))},
 sha256(coalesce(string_agg(s, ',' ORDER BY start, o) FILTER (WHERE o < {len(BASE_KINDS)}), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, o), '') AS spans
FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
