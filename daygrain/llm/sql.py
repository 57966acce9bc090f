"""DuckDB SQL for the queries that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS no
    FROM documents
), solid AS (
    SELECT *, lead(line, 1) OVER w AS second, lead(line, 2) OVER w AS third, lead(no, 2) OVER w AS last
    FROM lines WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
    WINDOW w AS (PARTITION BY doc_id ORDER BY no)
), placed AS (
    SELECT doc_id, no, last,
           row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, no) AS occurrence
    FROM solid WHERE last IS NOT NULL
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(no, last + 1)) AS no FROM placed WHERE occurrence > 1
), kept AS (
    SELECT l.doc_id, count(*) AS n_lines, count(c.no) AS n_removed,
           string_agg(line, chr(10) ORDER BY l.no) FILTER (WHERE c.no IS NULL) AS text
    FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.no = l.no GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
OP5 = f"""
WITH hashed AS (SELECT doc_id, sha256({LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM hashed WINDOW g AS (PARTITION BY text_sha256)
"""



def _clustering(k: int = 16, rounds: int = 3, dims: int = 64) -> str:
    """The rounds of clustering, written out one after the other."""
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, vec_id, embedding FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
)""",
        """points AS MATERIALIZED (
    SELECT row_id, generate_subscripts(embedding, 1) AS i, CAST(floor(64 * CAST(unnest(embedding) AS DOUBLE)) AS HUGEINT) AS x
    FROM kept
)""",
        f"""centers0 AS MATERIALIZED (
    SELECT cluster, i, x FROM (
        SELECT row_id, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, vec_id, embedding) - 1 AS cluster
        FROM kept
    ) JOIN points USING (row_id) WHERE cluster < {k}
)""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""nearest{r} AS MATERIALIZED (
    SELECT row_id, cluster, distance FROM (
        SELECT p.row_id, c.cluster, sum((p.x - c.x) * (p.x - c.x)) AS distance
        FROM points p JOIN centers{r} c USING (i) GROUP BY p.row_id, c.cluster
    ) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, cluster) = 1
)"""
        )
        if r < rounds:
            steps.append(
                f"""centers{r + 1} AS MATERIALIZED (
    SELECT c.cluster, c.i, coalesce((s.total - ((s.total % s.n) + s.n) % s.n) // s.n, c.x) AS x
    FROM centers{r} c LEFT JOIN (
        SELECT a.cluster, p.i, sum(p.x) AS total, count(*) AS n FROM nearest{r} a JOIN points p USING (row_id)
        GROUP BY a.cluster, p.i
    ) s ON s.cluster = c.cluster AND s.i = c.i
)"""
            )
    return f"""WITH {", ".join(steps)}, digests AS (
    SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM centers{rounds} GROUP BY cluster
)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN nearest{rounds} USING (row_id) JOIN digests USING (cluster)
"""


#: Words and windows of ten; items with fewer words are one window.
OP12 = f"""
WITH doc AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
    FROM documents
), item AS (
    SELECT item_id, regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark
), wanted AS MATERIALIZED (
    SELECT DISTINCT item_id, least(10, len(words)) AS size, unnest(
        list_transform(range(1, greatest(len(words) - 9, 1) + 1), lambda i: array_to_string(words[i : i + 9], ' '))
    ) AS passage
    FROM item WHERE len(words) > 0
), place AS (
    SELECT row_id, words, size, unnest(range(1, len(words) - size + 2)) AS pos
    FROM doc CROSS JOIN (SELECT DISTINCT size FROM wanted)
), hit AS MATERIALIZED (
    SELECT row_id, pos, w.size, item_id FROM (
        SELECT row_id, pos, size, array_to_string(words[pos : pos + size - 1], ' ') AS passage FROM place
    ) p JOIN wanted w ON w.size = p.size AND w.passage = p.passage
), word AS (
    SELECT row_id, count(DISTINCT pos) AS n_hit FROM (SELECT row_id, unnest(range(pos, pos + size)) AS pos FROM hit) GROUP BY row_id
), items AS (
    SELECT row_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
    FROM (SELECT DISTINCT row_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY row_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (row_id) LEFT JOIN items USING (row_id)
"""

ORACLE = {
    "op1_line_dedup": OP1,
    "op5_exact_dedup": OP5,
    "op11_centroid_clustering": _clustering(),
    "op12_decontamination": OP12,
}
