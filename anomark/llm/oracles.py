"""DuckDB oracles of the numbered operators that SQL can express."""

from __future__ import annotations

# Fixed values of the contracts and of the operators' defaults.
WORD = r"[^\x20\x09-\x0D]+"
RATIOS = {
    "symbol_ratio": ("n_symbols", "n_words", "0.05"),
    "dup_line_ratio": ("n_dup_lines", "n_lines", "0.20"),
    "repeat_ratio": ("n_repeat_words", "n_words", "0.10"),
    "word_length": ("word_chars", "n_words", "1.0"),
}
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, "length(v) >= 8"),
    "access": (r"AKIA[A-Z0-9]+", 0, "length(v) >= 16"),
    "hex": (r"[0-9a-f]{32,}", 0, "true"),
    "id": (
        r"""(?i)(access_?key_?id|client_?id|account_?id|user_?name|login)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9@._-]+)""", 2, "length(v) >= 3",
    ),
    "key": (
        r"[A-Za-z0-9+/]{24,}", 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')",
    ),
    "endpoint": (r"https?://[A-Za-z0-9.-]+", 0, "true"),
}


def quality() -> str:
    """Exact quantiles of each cell (a sketch of fewer documents than its k is exact)."""
    fence = {
        r: f"""list_sort(list({a}::double / {b}))[ceil(0.75 * count(*))::bigint] + 3.0::double * greatest(
            list_sort(list({a}::double / {b}))[ceil(0.75 * count(*))::bigint]
            - list_sort(list({a}::double / {b}))[ceil(0.25 * count(*))::bigint], {spread}::double) AS {r}"""
        for r, (a, b, spread) in RATIOS.items()
    }
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
g AS (SELECT uid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT uid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
r AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, gram) AS c FROM g) WHERE c > 1),
n AS (SELECT uid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY uid),
s AS (SELECT w.uid, doc_id, lang, source, len(words)::bigint AS n_words,
             length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
             len(lines)::bigint AS n_lines, (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines,
             coalesce(n.n, 0)::bigint AS n_repeat_words
      FROM w LEFT JOIN n ON n.uid = w.uid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
small AS (SELECT lang, source, count(*) AS n, {", ".join(fence.values())} FROM b WHERE NOT base_failed GROUP BY lang, source),
large AS (SELECT lang, {", ".join(fence.values())} FROM b WHERE NOT base_failed GROUP BY lang),
cells AS (SELECT small.lang, small.source,
                 {", ".join(f"CASE WHEN n >= 100 THEN small.{r} ELSE large.{r} END AS {r}" for r in RATIOS)}
          FROM small JOIN large ON small.lang IS NOT DISTINCT FROM large.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(f"coalesce({a}::double / nullif({b}, 0) <= cells.{r}, true)" for r, (a, b, _) in RATIOS.items())} AS kept
FROM b LEFT JOIN cells ON b.lang IS NOT DISTINCT FROM cells.lang AND b.source IS NOT DISTINCT FROM cells.source
"""


def secrets() -> str:
    kinds = list(PATTERNS)
    found = " UNION ALL ".join(
        f"""SELECT uid, {kinds.index(k)} AS kind, '{k}' AS name, regexp_extract_all(t, '{p}', 0) AS m,
            regexp_extract_all(t, '{p}', {group}) AS v, string_split_regex(t, '{p}') AS g FROM d"""
        for k, (p, group, _) in PATTERNS.items()
    )
    check = " ".join(f"WHEN name = '{k}' THEN {ok}" for k, (_, _, ok) in PATTERNS.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
l AS (SELECT uid, kind, name, unnest(range(1, len(m) + 1)) AS i, m, v, g FROM f WHERE len(m) > 0),
p AS (SELECT uid, kind, name, v[i] AS v, length(m[i]) AS len,
             list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS stop FROM l),
ok AS (SELECT uid, kind, name, (stop - len)::bigint AS start, stop::bigint AS stop FROM p WHERE CASE {check} END),
role AS (SELECT *, CASE WHEN name IN ('access', 'id') THEN 'i' WHEN name IN ('assign', 'hex', 'key') THEN 's' ELSE 'e' END AS role FROM ok),
kept AS (SELECT * FROM role AS a WHERE kind < 3 OR (
    (role = 'i' OR EXISTS (SELECT 1 FROM role AS b WHERE b.uid = a.uid AND b.role = 'i' AND abs(b.start - a.start) <= 256))
    AND (role = 's' OR EXISTS (SELECT 1 FROM role AS b WHERE b.uid = a.uid AND b.role = 's' AND abs(b.start - a.start) <= 256)))),
s AS (SELECT uid, count(*) FILTER (name = 'assign') AS a, count(*) FILTER (name = 'access') AS c, count(*) FILTER (name = 'hex') AS h,
             string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
             string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
      FROM kept GROUP BY uid)
SELECT doc_id, coalesce(a, 0)::bigint AS n_assign, coalesce(c, 0)::bigint AS n_access, coalesce(h, 0)::bigint AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s ON s.uid = d.uid
"""


def repeats(length: int = 200) -> str:
    """Bytes as hexadecimal text, every window by its md5, removed stretches as islands of repeated windows."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
-- blocks first: a substring costs its distance from the beginning
q AS (SELECT uid, j, substr(h, 2 * j + 1, {2 * (500 + length - 1)}) AS part
      FROM (SELECT uid, h, unnest(range(0, length(h) // 2, 500)) AS j FROM d WHERE length(h) >= {2 * length})),
p AS (SELECT uid, j, part, unnest(range(0, least(500, length(part) // 2 - {length - 1}))) AS k FROM q WHERE length(part) >= {2 * length}),
w AS (SELECT uid, j + k AS k, md5(substr(part, 2 * k + 1, {2 * length})) AS m FROM p),
r AS (SELECT uid, k FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT uid, k, sum(fresh) OVER (PARTITION BY uid ORDER BY k) AS n
      FROM (SELECT uid, k, CASE WHEN k <= lag(k) OVER (PARTITION BY uid ORDER BY k) + {length} THEN 0 ELSE 1 END AS fresh FROM r)),
cut AS (SELECT uid, n, min(k) AS start, max(k) + {length} AS stop FROM g GROUP BY uid, n),
c AS (SELECT uid, list(start ORDER BY start) AS a, list(stop ORDER BY start) AS b FROM cut GROUP BY uid),
o AS (SELECT d.uid, doc_id, h, coalesce(a, []) AS a, coalesce(b, []) AS b FROM d LEFT JOIN c ON c.uid = d.uid),
s AS (SELECT *, list_transform(range(0, len(a) + 1), lambda i: substr(h, 2 * coalesce(b[i], 0) + 1,
             2 * (coalesce(a[i + 1], length(h) // 2) - coalesce(b[i], 0)))) AS kept FROM o)
SELECT doc_id, (length(h) // 2)::bigint AS n_bytes,
       coalesce(list_sum(b) - list_sum(a), 0)::bigint AS n_removed, len(a)::bigint AS n_spans,
       sha256(unhex(array_to_string(kept, ''))) AS kept_sha256
FROM s
"""


def hard_negatives() -> str:
    """All scores of each anchor, ranked by window functions."""
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::double)) AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::bigint AS score
      FROM v AS a, v AS b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::int AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def prefix_trie() -> str:
    """Every beginning of every rebuilt conversation as text, grouped; subtrees by the beginnings of each beginning."""
    return """
WITH t AS (SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) || ':' || length(coalesce(text, '')) AS turn,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(turn ORDER BY i) AS own FROM t GROUP BY conv_id),
-- crc32, eight shifts a byte
h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
             lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::bigint ELSE 0 END))),
             4294967295::bigint) % 6 AS h FROM c),
r AS (SELECT h.conv_id, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS turns
      FROM h LEFT JOIN c AS b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM r),
k AS (SELECT conv_id, n, depth, array_to_string(turns[1:depth], ',') AS node, array_to_string(turns[1:depth - 1], ',') AS parent,
             coalesce(string_split(turns[depth], ':')[2]::bigint, 0) AS chars FROM p),
m AS (SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS value,
             sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM k GROUP BY node, depth),
x AS (SELECT m.*, coalesce(o.n, 0) AS n_children, u.conv_id AS parent_conv_id FROM m
      LEFT JOIN (SELECT parent, depth - 1 AS depth, count(*) AS n FROM m WHERE depth > 0 GROUP BY ALL) AS o ON o.parent = m.node AND o.depth = m.depth
      LEFT JOIN m AS u ON u.node = m.parent AND u.depth = m.depth - 1),
-- every node under each beginning of its least member
s AS (SELECT k.node, k.depth, sum(x.value) AS saved, count(*) FILTER (x.n_children = 0) AS leaves
      FROM x JOIN k ON k.conv_id = x.conv_id AND k.depth <= x.depth GROUP BY k.node, k.depth)
SELECT x.conv_id, x.depth::bigint AS depth, parent_conv_id, n_convs, n_children::bigint AS n_children, leaves::bigint AS n_leaves,
       saved::bigint AS saved_tokens, ends_sha256
FROM x JOIN s ON s.node = x.node AND s.depth = x.depth
"""
