"""DuckDB SQL for the queries that SQL can express, each by its plain definition.

The others have no SQL: merges of a vocabulary, heaps, compression, trained scores and packing are
beyond it, the licence rules are regular expressions with a look around, and all 50-byte strings of
whole tables take DuckDB more memory than there is. Tests hold those against brute force."""

LOWERED = (
    "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)
BLANK = "[\\x20\\x09-\\x0D]+"

# Every node with itself, and all that can be reached from it.
REACHED = """
    reached(id, other) AS (
      SELECT id, id FROM nodes
      UNION
      SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.other),
    component AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)"""

NGRAM = f"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(
        string_split_regex({LOWERED.format("coalesce(text, '')")}, '{BLANK}'), lambda w: w <> ''
      ) AS w FROM documents),
    sets AS (
      SELECT doc_id, list_distinct(CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      END) AS s FROM words),
    nodes AS (SELECT doc_id AS id, len(s) AS n FROM sets),
    shingles AS (SELECT doc_id AS id, unnest(s) AS shingle FROM sets),
    common AS (
      SELECT x.id AS a, y.id AS b, count(*) AS n
      FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.id <> y.id GROUP BY 1, 2),
    links AS (
      SELECT c.a, c.b FROM common c JOIN nodes p ON p.id = c.a JOIN nodes q ON q.id = c.b
      WHERE 100 * c.n >= 80 * (p.n + q.n - c.n)),
    {REACHED}
    SELECT n.id AS doc_id, CAST(n.n AS BIGINT) AS n_shingles, c.component_id
    FROM nodes n JOIN component c ON c.id = n.id"""

EMBEDDINGS = f"""
    WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
    usable AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL
            OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
      SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q
        ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
      WHERE list_cosine_similarity(p.v, q.v) >= 0.98),
    {REACHED},
    counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT c.id AS vec_id, coalesce(l.n, 0) AS n_links, c.component_id,
           c.id = c.component_id AS kept
    FROM component c LEFT JOIN counted l ON l.a = c.id"""

LINES = f"""
    WITH split AS (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    lines AS (
      SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS n FROM split),
    keyed AS (
      SELECT *, {LOWERED.format(f"regexp_replace(line, '^{BLANK}|{BLANK}$', '', 'g')")} AS key
      FROM lines),
    shared AS (
      SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    judged AS (
      SELECT k.doc_id, k.line, k.n, s.key IS NOT NULL AND k.doc_id <> s.last AS gone
      FROM keyed k LEFT JOIN shared s ON s.key = k.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), ''))
             AS kept_sha256
    FROM judged GROUP BY doc_id"""

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": NGRAM,
    "op2_embedding_dedup": EMBEDDINGS,
    "op6_line_dedup": LINES,
}
