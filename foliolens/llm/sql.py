"""DuckDB SQL for the registered queries of this subpackage that SQL can express."""

from __future__ import annotations

from foliolens.llm import centroids


def centroid_sql(clusters: int = centroids.CLUSTERS, rounds: int = centroids.ROUNDS, dimensions: int = centroids.DIMENSIONS,
                 scale: int = centroids.SCALE, seed: int = centroids.SEED) -> str:
    """Clustering with one row for each component; a round is an assignment and floored means."""
    steps = [f"""w AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dimensions}
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
x AS (SELECT r, vec_id, unnest(v) AS a, unnest(range({dimensions})) AS i FROM w),
first_ones AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c FROM w),
c0 AS (SELECT c, unnest(v) AS b, unnest(range({dimensions})) AS i FROM first_ones WHERE c < {clusters})"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT r, vec_id, c, d FROM (SELECT r, vec_id, c, CAST(sum((a - b) * (a - b)) AS BIGINT) AS d FROM x JOIN c{k} USING (i) GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT c, i, CAST(sum(a) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} USING (r) GROUP BY ALL),
c{k + 1} AS (
  SELECT c, i, CASE WHEN n IS NULL THEN b ELSE (s - ((s % n) + n) % n) // n END AS b FROM c{k} LEFT JOIN m{k} USING (c, i))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN (SELECT c, sha256(string_agg(CAST(b AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)"""


def trie_sql(family: int = 100, heads: int = 6) -> str:
    """Prefixes as strings of their turns; a subtree is what conversations through a node also visit."""
    return f"""WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS v FROM turns
  UNION ALL
  SELECT conv_id, s, i + 1, xor(w >> 1, (w & 1) * 3988292384)
  FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(v, CAST(ascii(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE v END AS w
        FROM crc WHERE i < 8 * length(s))),
convs AS (SELECT conv_id, xor(v, 4294967295) % {heads} AS own_from, conv_id - conv_id % {family} AS base FROM crc WHERE i = 8 * length(s)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.own_from
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.own_from),
path AS (
  SELECT conv_id, row_number() OVER o AS depth, length(text) AS chars,
         string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER o AS prefix
  FROM rebuilt WINDOW o AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM path),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(CASE WHEN is_end THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM ended GROUP BY depth, prefix),
parents AS (
  SELECT DISTINCT p.depth, p.prefix, q.prefix AS parent FROM path p JOIN path q ON p.conv_id = q.conv_id AND q.depth = p.depth - 1),
children AS (SELECT depth - 1 AS depth, parent AS prefix, count(*) AS n_children FROM parents GROUP BY ALL),
below AS (SELECT DISTINCT a.depth, a.prefix, b.depth AS d2, b.prefix AS p2 FROM path a JOIN path b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT w.depth, w.prefix, CAST(sum((n.n_convs - 1) * n.chars) AS BIGINT) AS saved_tokens,
         count(*) FILTER (WHERE k.n_children IS NULL) AS n_leaves
  FROM below w JOIN nodes n ON n.depth = w.d2 AND n.prefix = w.p2 LEFT JOIN children k ON k.depth = w.d2 AND k.prefix = w.p2 GROUP BY ALL)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s USING (depth, prefix) LEFT JOIN children k USING (depth, prefix)
LEFT JOIN parents p USING (depth, prefix) LEFT JOIN nodes q ON q.depth = p.depth - 1 AND q.prefix = p.parent"""
