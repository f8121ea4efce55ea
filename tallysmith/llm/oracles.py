"""DuckDB counterparts of the text queries that SQL can express."""

WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

CONTAMINATION = rf"""
WITH iw AS (SELECT item_id, {WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[s:s + 12], ' ') AS phrase, least(len(w), 13) AS size
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM iw WHERE len(w) > 0)
),
dw AS (SELECT doc_id, {WORDS} AS w FROM {{docs}}),
runs AS (
  SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS phrase
  FROM (
    SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s
    FROM dw, (SELECT DISTINCT size FROM win) WHERE len(w) >= size
  )
),
met AS (SELECT DISTINCT r.doc_id, r.s, r.size, r.phrase FROM runs r SEMI JOIN win USING (phrase, size)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM met) GROUP BY doc_id
),
own AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met JOIN win USING (phrase, size))
  GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""

LINES = r"""
WITH n AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS i, line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS o FROM documents WHERE text IS NOT NULL)
),
runs AS (
  SELECT doc_id, i, 2 AS size, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS body FROM n
  UNION ALL
  SELECT doc_id, i, 1, line FROM n WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50
),
ranked AS (
  SELECT doc_id, i, size, row_number() OVER (PARTITION BY size, body ORDER BY doc_id, i) AS r
  FROM runs WHERE body IS NOT NULL AND body <> chr(10)
),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM ranked WHERE r > 1
),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
    string_agg(line, chr(10) ORDER BY n.i) FILTER (WHERE g.i IS NULL) AS body
  FROM n LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(length(coalesce(body, '')) AS BIGINT) AS kept_chars, sha256(coalesce(body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0
      AS u
  FROM documents
),
q AS (SELECT doc_id, avg(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
k AS (
  SELECT doc_id, source, size, -ln(u) / CASE WHEN quality >= 0.5 THEN 2.0 WHEN quality < 0.5 THEN 0.5 ELSE 1.0 END AS key
  FROM d LEFT JOIN q USING (doc_id)
),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
s1 AS (
  SELECT source, source_size, source_size * 3.0 AS cap,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s0
),
s2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s1 WINDOW w AS (ORDER BY cap / weight, source NULLS LAST)
),
s3 AS (
  SELECT *, (SELECT arg_min(level, row(cap / weight, source)) FROM s2 WHERE level <= cap / weight) AS common FROM s2
),
s AS (
  SELECT source, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, common * weight) END AS target FROM s3
),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round_even(target, 0) AS BIGINT) // source_size ELSE 0 END AS epochs FROM s
),
r AS (
  SELECT k.*, source_size, target, epochs, CAST(round_even(target, 0) AS BIGINT) - epochs * source_size AS goal,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, goal - before)) AS BIGINT) AS taken
FROM r
"""


def clusters(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3") -> str:
    """k-means in whole numbers, each round two or three common table expressions."""
    gap = f"list_sum([(x[i] - c[i]) * (x[i] - c[i]) for i in range(1, {dims + 1})])"
    head = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS n,
    [CAST(floor({scale}.0 * CAST(v AS DOUBLE)) AS BIGINT) for v in embedding] AS x
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), x) - 1 AS cluster, x AS c
  FROM kept QUALIFY cluster < {k}
)"""
    parts = [head]
    for r in range(rounds + 1):
        parts.append(f"""
a{r} AS MATERIALIZED (
  SELECT n, min(struct_pack(distance := CAST({gap} AS BIGINT), cluster := cluster)) AS best
  FROM kept CROSS JOIN c{r} GROUP BY n
)""")
        if r < rounds:
            parts.append(f"""
s{r} AS MATERIALIZED (
  SELECT cluster, i, sum(v) AS s, count(*) AS m
  FROM (SELECT a.best.cluster AS cluster, unnest(x) AS v, unnest(range({dims})) AS i FROM kept JOIN a{r} a USING (n))
  GROUP BY cluster, i
),
c{r + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(t.c, o.c) AS c
  FROM c{r} o LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY cluster
  ) t USING (cluster)
)""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM (SELECT vec_id, a.best.cluster AS cluster, a.best.distance AS distance FROM kept JOIN a{rounds} a USING (n))
JOIN c{rounds} USING (cluster)
"""

DIVERGENCE = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
),
groups AS (SELECT DISTINCT lang, source FROM docs),
met AS (SELECT lang, source, unnest(w) AS term FROM docs),
cell AS (SELECT lang, source, term, count(*) AS n FROM met GROUP BY ALL),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM docs)
  GROUP BY lang, term HAVING count(*) >= 3
),
kinds AS (SELECT g.lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM groups) g LEFT JOIN kept k USING (lang) GROUP BY g.lang),
own AS (SELECT c.* FROM cell c JOIN kept USING (lang, term)),
size AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total FROM groups LEFT JOIN own USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
    1 + 1000000000 * (CAST(coalesce(n, 0) AS HUGEINT) + 1) // (total + v) AS p
  FROM groups g JOIN kept k USING (lang) JOIN kinds USING (lang) JOIN size USING (lang, source)
    LEFT JOIN own USING (lang, source, term)
),
whole AS (
  SELECT lang, term, 1 + 1000000000 * (CAST(s AS HUGEINT) + 1) // (sum(s) OVER (PARTITION BY lang) + v) AS q
  FROM (SELECT lang, term, sum(n) AS s FROM own GROUP BY lang, term) JOIN kinds USING (lang)
),
pair AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
rows_ AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN pair ON pair.lang = g.lang AND pair.source = g.source AND pair.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows_)
WHERE part = 'pair' OR rank <= 200
"""
