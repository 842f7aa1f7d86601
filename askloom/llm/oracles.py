"""DuckDB SQL for the registered queries of this subpackage, where SQL can express them."""

from askloom.llm.line_dedup import MIN_PAGES, RATIO

ORACLES: dict[str, str] = {}

ORACLES["op1_substring_dedup"] = r"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), runs AS (
  SELECT row_id, doc_id, list_transform(range(0, greatest(len(ws) - 12, 0)),
    lambda p: array_to_string(ws[p + 1:p + 13], ' ')) AS rs FROM texts
), keyed AS (
  SELECT row_id, doc_id, unnest(rs) AS run, generate_subscripts(rs, 1) - 1 AS place FROM runs
), firsts AS (
  SELECT run, min(doc_id) AS first_id FROM keyed GROUP BY run
), gone AS (
  SELECT DISTINCT row_id, unnest(range(place, place + 13)) AS place
  FROM keyed JOIN firsts USING (run) WHERE first_id < doc_id
), words AS (
  SELECT row_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS place FROM texts
), kept AS (
  SELECT row_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS kept_text
  FROM words ANTI JOIN gone USING (row_id, place) GROUP BY row_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n_kept, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept_text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (row_id)
"""

ORACLES["op7_line_dedup"] = rf"""
WITH texts AS (
  SELECT page_id, html,
    lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '')) AS host,
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:html|head|body|title|nav|ul|ol|li|div|article|section|header|footer|h[1-6]|p|br|table|tr|td|th|pre|blockquote)(?:\s[^>]*)?/?>',
      chr(10), 'g'), '<[^>]*>', '', 'g') AS text
  FROM pages
), lined AS (
  SELECT page_id, host, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM texts
), each AS (
  SELECT row_id, page_id, host, lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS place
  FROM (SELECT row_number() OVER () AS row_id, * FROM lined)
), site AS (
  SELECT host, count(DISTINCT lines) AS pages FROM lined WHERE host <> '' GROUP BY host
), common AS (
  SELECT host, line FROM (SELECT host, line, count(DISTINCT lines) AS n FROM each WHERE host <> '' GROUP BY host, line)
  JOIN site USING (host) WHERE n >= {MIN_PAGES} AND n > {RATIO}::DOUBLE * pages
), kept AS (
  SELECT row_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY place) AS kept_text
  FROM each ANTI JOIN common USING (host, line) GROUP BY row_id
)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - coalesce(n_kept, 0))::BIGINT AS n_dropped,
  coalesce(kept_text, '') AS kept_text
FROM (SELECT row_number() OVER () AS row_id, * FROM lined) LEFT JOIN kept USING (row_id)
"""

ORACLES["op10_exact_topk"] = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 10
"""

ORACLES["op11_hard_negatives"] = """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
    list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM whole a JOIN whole c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


def _clustering(rounds: int) -> str:
    """Each round as two more tables: the assignment to the centroids before, and the centroids after."""
    nearest = """
nearest{i} AS MATERIALIZED (
  SELECT row_id, vec_id, v, cluster, distance FROM (
    SELECT row_id, vec_id, w.v AS v, cluster,
      list_sum(list_transform(list_zip(w.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
    FROM whole w, centroids{i} c)
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, cluster) = 1
)"""
    moved = """
centroids{j} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM centroids{i} c LEFT JOIN (
    SELECT cluster, list(mean ORDER BY place) AS v FROM (
      SELECT cluster, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS mean
      FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM nearest{i})
      GROUP BY cluster, place)
    GROUP BY cluster) m USING (cluster)
)"""
    steps = [nearest.format(i=i) + "," + moved.format(i=i, j=i + 1) for i in range(rounds)]
    return ",".join([*steps, nearest.format(i=rounds)])


ORACLES["op13_orchard_clustering"] = f"""
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), centroids0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster, v FROM whole QUALIFY cluster < 40
), {_clustering(5)}
SELECT vec_id, n.cluster::INT AS cluster, distance,
  (sum(distance) OVER (PARTITION BY n.cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM nearest5 n JOIN centroids5 c ON n.cluster = c.cluster
"""
