"""SQL counterparts of the clustering, tensored MinHash and lexical search queries."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEXICAL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
q AS MATERIALIZED (SELECT item_id, term, CAST(count(*) AS BIGINT) AS times
      FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tf AS MATERIALIZED (SELECT doc_id, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d)
       WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(any_value(big_n) AS DOUBLE) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM tf, total GROUP BY term),
s AS (SELECT item_id, tf.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l))))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n ON n.doc_id = tf.doc_id, total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0
QUALIFY rank <= 10"""

TENSORED = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id
      JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(x.n) + any_value(y.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN least ON least.doc_id = d.doc_id"""


def clustering(k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """Rounds of exact assignment, one after another; vectors stay lists, and distances are taken component by component."""
    parts = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims})""",
             f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS INTEGER) AS cluster, x FROM v
      ORDER BY sha256('{seed}:' || vec_id), x LIMIT {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(v.x) AS x, min_by(cluster, (d, cluster)) AS cluster, min(d) AS distance
      FROM (SELECT vec_id, v.x, cluster, list_sum(list_transform(range(1, {dims + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS d FROM v, c{i} c) v
      GROUP BY vec_id)""")
        if i < rounds:
            mean = "CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
            parts.append(f"""m{i} AS (SELECT cluster, list(m ORDER BY place) AS x FROM (SELECT cluster, place, {mean} AS m
      FROM (SELECT cluster, unnest(x) AS e, unnest(range({dims})) AS place FROM a{i}) GROUP BY cluster, place) GROUP BY cluster)""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.cluster = c.cluster)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""
