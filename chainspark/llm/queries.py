"""The registered queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op3_ann
from .bpe import op7_bpe
from .brown import op9_brown
from .infill import op11_infill
from .minhash import op4_minhash
from .mixing import op8_mixing
from .periodic import op12_periods
from .pivots import op13_pivots
from .sharding import op10_sharding
from .suffixes import op2_suffixes
from .topk import op6_topk
from .toxicity import op1_toxicity
from .wordrepeats import op5_substrings

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_suffixes, op3_ann, op4_minhash, op5_substrings, op6_topk, op7_bpe, op8_mixing, op9_brown, op10_sharding, op11_infill, op12_periods, op13_pivots)}

SQL = {
    "op6_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op2_suffixes": """
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), k AS (
  SELECT r, p, count(*) OVER (PARTITION BY h) > 1 AS again
  FROM (SELECT r, p, md5(b[p:p + 399]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS p FROM t))
), c AS (
  SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p), 401) AS gap FROM k WHERE again
), e AS (
  SELECT r, min(p) AS first, max(p) + 399 AS last
  FROM (SELECT r, p, sum(CAST(gap > 400 AS INT)) OVER (PARTITION BY r ORDER BY p) AS span FROM c) GROUP BY r, span
), l AS (
  SELECT r, first, last, coalesce(lag(last) OVER w, 0) AS before, lead(first) OVER w IS NULL AS final FROM e WINDOW w AS (PARTITION BY r ORDER BY first)
), g AS (
  SELECT r, CAST(sum(last - first + 1) AS BIGINT) AS n_removed, count(*) AS n_spans,
    string_agg(hex(b[before + 1:first - 1]) || CASE WHEN final THEN hex(b[last + 1:octet_length(b)]) ELSE '' END, '' ORDER BY first) AS kept
  FROM l JOIN t USING (r) GROUP BY r
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN kept IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM t LEFT JOIN g USING (r)
""",
    "op5_substrings": r"""
WITH t AS (
  SELECT doc_id, coalesce(doc_id, -9223372036854775808) AS did, md5(coalesce(text, '')) AS same,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), d AS (
  SELECT DISTINCT did, same, w FROM t
), s AS (
  SELECT did, same, unnest(range(1, len(w) - 18)) AS p, w FROM d
), k AS (
  SELECT did, same, p, array_to_string(w[p:p + 19], ' ') AS g FROM s
), f AS (
  SELECT did, same, p, (did, p) > first_value((did, p)) OVER (PARTITION BY g ORDER BY did, p) AS late FROM k
), c AS (
  SELECT did, same, list_distinct(flatten(list(range(p, p + 20)))) AS gone FROM f WHERE late GROUP BY did, same
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM t LEFT JOIN c USING (did, same)
""",
    "op11_infill": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t
), c AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(pre || mid || suf) AS restored_sha256 FROM p
""",
}
