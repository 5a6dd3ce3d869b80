"""SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

#: Words of a text, in order.
WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(_LOWER.format('text'))} AS w FROM documents),
sets AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM d
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
    SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2) p
    JOIN sizes m ON m.doc_id = p.x JOIN sizes n ON n.doc_id = p.y WHERE 100 * c >= 75 * (m.n + n.n - c)
),
reach(doc_id, root) AS (SELECT DISTINCT x, x FROM links UNION SELECT links.y, reach.root FROM reach JOIN links ON links.x = reach.doc_id),
least AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id),
degree AS (SELECT x AS doc_id, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.root, d.doc_id) AS component_id, coalesce(g.n, 0) AS n_links
FROM d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id) LEFT JOIN degree g USING (doc_id)
"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    whole, part, piece = f"regexp_extract_all(t, {p}, 0)", f"regexp_extract_all(t, {p}, {group})", f"regexp_split_to_array(t, {p})"
    return f"""(SELECT list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'s': coalesce(list_sum(list_transform(q[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
        'r': {rank}, 'n': length(m[i]), 'k': '{kind}', 'v': length(g[i])}}), lambda x: x.v >= {least}) FROM (SELECT {whole} AS m, {part} AS g, {piece} AS q))"""


def op5_sql(rules) -> str:
    spelled = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
    lists = ", ".join(_spans(k, r.kind, r.pattern.replace("(?i:password|passwd|secret|token|api_?key)", spelled), r.group, r.least) for k, r in enumerate(rules))
    show = "list_transform({}, lambda x: x.k || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.s + x.n AS BIGINT))"
    count = ", ".join(f"CAST(len(list_filter(f, lambda x: x.k = '{k}')) AS BIGINT) AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, list_sort(flatten([{lists}])) AS f FROM d)
SELECT doc_id, {count}, sha256(array_to_string({show.format('list_filter(f, lambda x: x.r < 3)')}, ',')) AS base_sha256, array_to_string({show.format('f')}, ',') AS spans FROM s
"""


OP8_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN least USING (s) WHERE first < doc_id),
removed AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
    sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: ps IS NULL OR NOT list_contains(ps, i)), lambda i: w[i]), ' ')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id)
"""
