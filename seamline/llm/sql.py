"""SQL of the longer checks."""

PREFIX_TRIE = """
WITH RECURSIVE ids AS (
    SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL
), crc(conv_id, s, i, c) AS (
    SELECT conv_id, s, 0, CAST(4294967295 AS BIGINT) FROM ids
    UNION ALL
    SELECT conv_id, s, i + 1, xor(v // 2, CASE WHEN v % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)
    FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(s[i // 8 + 1]) AS BIGINT)) ELSE c END AS v FROM crc WHERE i < 8 * length(s))
), shares AS (
    SELECT conv_id, conv_id - conv_id % 100 AS base, xor(c, CAST(4294967295 AS BIGINT)) % 6 AS h FROM crc WHERE i = 8 * length(s)
), hashed AS (
    SELECT conv_id, turn, length(coalesce(text, '')) AS len, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS symbol
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, symbol, len, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, symbol) AS pos FROM hashed
), rebuilt AS (
    SELECT s.conv_id, 0 AS part, pos, symbol, len FROM shares s JOIN own o ON o.conv_id = s.base AND o.pos <= s.h
    UNION ALL
    SELECT s.conv_id, 1 AS part, pos, symbol, len FROM shares s JOIN own o ON o.conv_id = s.conv_id AND o.pos > s.h
), seq AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, symbol, len FROM rebuilt
), pref AS (
    SELECT conv_id, d, sha256(string_agg(symbol, '') OVER (PARTITION BY conv_id ORDER BY d)) AS name, len FROM seq
    UNION ALL
    SELECT conv_id, 0, '', 0 FROM ids
), ends AS (
    SELECT conv_id, max(d) AS n FROM pref GROUP BY conv_id
), node AS (
    SELECT d, name, min(conv_id) AS m, count(*) AS n_convs, any_value(len) AS len,
           string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d) AS ending
    FROM pref JOIN ends USING (conv_id) GROUP BY d, name
), child AS (
    SELECT node.d, node.name, p.name AS above FROM node JOIN pref p ON p.conv_id = node.m AND p.d = node.d - 1
), kids AS (
    SELECT d - 1 AS d, above AS name, count(*) AS n_children FROM child GROUP BY ALL
), valued AS (
    SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len END AS saved
    FROM node LEFT JOIN kids USING (d, name)
), totals AS (
    SELECT p.d, p.name, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(v.saved) AS saved_tokens
    FROM valued v JOIN pref p ON p.conv_id = v.m AND p.d <= v.d GROUP BY ALL
)
SELECT v.m AS conv_id, v.d AS depth, up.m AS parent_conv_id, v.n_convs, v.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
       CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(v.ending, '')) AS ends_sha256
FROM valued v JOIN totals t USING (d, name) LEFT JOIN child c USING (d, name) LEFT JOIN node up ON up.d = v.d - 1 AND up.name = c.above
"""

DECONTAMINATION = r"""
WITH words AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i : i + 9], ' ') AS pattern
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), places AS (
    SELECT r, l, i, array_to_string(w[i : i + l - 1], ' ') AS pattern
    FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM words, (SELECT DISTINCT l FROM windows))
), found AS (
    SELECT DISTINCT r, l, i, pattern FROM places WHERE pattern IN (SELECT pattern FROM windows)
), matched AS (
    SELECT f.r, f.i, f.l, w.item_id FROM found f JOIN windows w USING (l, pattern)
), hits AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM matched) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM matched WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""


def _centroids(rounds: int = 3) -> str:
    nearest = """assigned{n} AS (
    SELECT r, v, c, d FROM (
        SELECT k.r, k.v, m.c, CAST(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - m.v[i]) * (k.v[i] - m.v[i]))) AS BIGINT) AS d FROM kept k, centre{n} m
    ) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)"""
    moved = """sums{n} AS (
    SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM assigned{n}, range(1, 65) AS t(i) GROUP BY c, i
), means{n} AS (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM sums{n} GROUP BY c
), centre{next} AS (
    SELECT c, coalesce(u.v, m.v) AS v FROM centre{n} m LEFT JOIN means{n} u USING (c)
)"""
    steps = [x.format(n=n, next=n + 1) for n in range(rounds) for x in (nearest, moved)] + [nearest.format(n=rounds)]
    return f"""
WITH kept AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < 2097152)) = 64
), centre0 AS (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL
    QUALIFY c < 16
), {", ".join(steps)}
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM assigned{rounds} a JOIN kept k USING (r) JOIN centre{rounds} m ON m.c = a.c
"""


CENTROIDS = _centroids()
