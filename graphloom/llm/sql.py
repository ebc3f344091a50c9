"""DuckDB SQL that gives the same rows as the queries of the same name."""

CHAT = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL
), r AS (
  SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS n_context,
    coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')
      || '<|assistant|>' || chr(10) AS prompt
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, turn, n_context, prompt, text AS reply, CAST(length(prompt) AS INTEGER) AS loss_start,
  CAST(length(prompt) + length(text) AS INTEGER) AS loss_end
FROM r WHERE role = 'assistant'
"""

# every row whose id is divisible by 100 is a query
TOP_K = """
WITH v AS (SELECT vec_id, min(embedding)::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL GROUP BY vec_id),
d AS (
  SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.v, b.v) AS distance
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)
SELECT vec_id, rank, neighbor_id, round(distance, 6) AS distance FROM r WHERE rank <= 10
"""

# runs as short as they can be with 12 words and two sentences, from either side, and long single sentences; the place of a
# run among all equal runs decides; sentences are compared without case and outer white space
SPANS = r"""
WITH s AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^.!?,;:\n]*[.!?,;:\n]+[ \t\n\x0b\f\r]*|[^.!?,;:\n]+$') AS raw FROM documents
), b AS (
  SELECT doc_id, list_transform(raw, lambda x: lower(trim(x, chr(32) || chr(9) || chr(13) || chr(10)))) AS xs FROM s
), n AS (
  SELECT doc_id, unnest(xs) AS x, unnest(range(len(xs))) AS pos FROM b
), w AS (
  SELECT doc_id, pos, length(x) - length(replace(x, ' ', '')) + 1 AS w FROM n
), m AS (
  SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM w
), p AS (
  SELECT m.doc_id, m.pos, o.pos - m.pos + 1 AS n, o.c - m.c + m.w AS total, m.w AS w1, o.w AS w2
  FROM m JOIN m o ON m.doc_id = o.doc_id AND o.pos > m.pos AND o.pos < m.pos + 12
), runs AS (
  SELECT doc_id, pos, n, xs[pos + 1 : pos + n] AS run FROM p JOIN b USING (doc_id) WHERE total >= 12 AND (n = 2 OR total - w1 < 12 OR total - w2 < 12)
  UNION ALL
  SELECT doc_id, pos, 1, [x] FROM n JOIN w USING (doc_id, pos) WHERE w > 24
), later AS (
  SELECT doc_id, pos, n FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS i FROM runs) WHERE i > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(pos, pos + n)))) AS gone FROM later GROUP BY doc_id
)
SELECT s.doc_id,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(raw, lambda x, i: NOT list_contains(gone, i - 1)), '') END AS text,
  CAST(coalesce(len(gone), 0) AS INTEGER) AS n_removed
FROM s LEFT JOIN gone USING (doc_id)
"""

# the best window of an item's length begins where one of its shingles does
LEAKS = r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS sh FROM b WHERE len(w) > 2),
size AS (SELECT item_id, count(DISTINCT sh) AS size, count(*) AS length FROM i GROUP BY item_id),
t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
d AS (SELECT doc_id, unnest(range(len(w) - 2)) AS pos, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS sh FROM t WHERE len(w) > 2),
hit AS (SELECT doc_id, item_id, pos, sh, size, length FROM d JOIN (SELECT DISTINCT item_id, sh FROM i) USING (sh) JOIN size USING (item_id)),
inside AS (
  SELECT a.doc_id, a.item_id, a.pos, a.size, count(DISTINCT c.sh) AS n
  FROM hit a JOIN hit c ON a.doc_id = c.doc_id AND a.item_id = c.item_id AND c.pos >= a.pos AND c.pos < a.pos + a.length
  GROUP BY a.doc_id, a.item_id, a.pos, a.size
)
SELECT doc_id, item_id, round(max(n / size), 6) AS containment FROM inside WHERE n >= ceil(size * 0.7 - 1e-9) GROUP BY doc_id, item_id
"""

ORACLES: dict[str, str] = {
    "op3_substring_dedup": SPANS,
    "op5_chat_prefix_targets": CHAT,
    "op6_exact_top_k": TOP_K,
    "op7_decontamination": LEAKS,
}
