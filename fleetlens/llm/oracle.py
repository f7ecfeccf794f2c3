"""SQL for the training-data queries that SQL can express, from their definitions."""

from __future__ import annotations

_SPLIT = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

REPEATS = f"""
WITH d AS (SELECT doc_id, {_SPLIT} AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i+34], ' ') AS run
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
again AS (SELECT run FROM w GROUP BY run HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM w WHERE run IN (SELECT run FROM again)),
every_word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM d),
left_over AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.j) AS kept, count(*) AS n FROM every_word e
              ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over l ON d.doc_id = l.doc_id
"""


def _components(nodes: str, links: str) -> str:
    """The smallest node that each node reaches, from links in both directions."""
    return f"""reach(node, other) AS (SELECT node, node FROM ({nodes})
      UNION SELECT r.node, l.b FROM reach r JOIN ({links}) l ON r.other = l.a),
    least AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.replace("coalesce(text, '')", f"coalesce({_LOWER}, '')")} AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
             ELSE array_to_string(words[i:i+4], ' ') END AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM d WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b
              ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_have h JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * h.n >= 75 * (x.n + y.n - h.n)),
{_components("SELECT doc_id AS node FROM d", "SELECT a, b FROM links")}
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component AS component_id, d.doc_id = component AS kept
FROM d LEFT JOIN sizes z ON z.doc_id = d.doc_id JOIN least ON least.node = d.doc_id
"""

VECTORS = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
          AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
{_components("SELECT vec_id AS node FROM v", "SELECT a, b FROM links")}
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component AS component_id, vec_id = component AS kept
FROM v LEFT JOIN counts ON a = vec_id JOIN least ON node = vec_id
"""
