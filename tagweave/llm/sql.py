"""DuckDB SQL for the queries of this subpackage that SQL can express."""

#: Words of every text, and of the lower-cased one (A-Z only), in order.
_WORDS = r"w AS (SELECT doc_id, regexp_extract_all({text}, '[^\x20\x09-\x0D]+') AS w FROM documents)"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = f"""WITH RECURSIVE {_WORDS.format(text=_LOWER)},
 g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
 r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id AND r.c < l.b)
 SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(c) FROM r WHERE r.doc_id = w.doc_id) AS component_id, (SELECT count(*) FROM l WHERE l.a = w.doc_id) AS n_links FROM w LEFT JOIN n USING (doc_id)"""

SUBSTRING = f"""WITH {_WORDS.format(text="coalesce(text, '')")},
 v AS (SELECT doc_id, i AS pos, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
 m AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM v),
 gone AS (SELECT DISTINCT doc_id, pos + x AS pos FROM (SELECT doc_id, pos, unnest(range(0, 20)) AS x FROM m WHERE n > 1)),
 f AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w), k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM f ANTI JOIN gone USING (doc_id, pos) GROUP BY 1), c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
 SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)"""

VECTOR_DEDUP = """WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS s FROM e),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.v, b.v) >= 0.9e0 * a.s * b.s),
 r AS (SELECT vec_id, vec_id AS c FROM e UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id AND r.c < l.b), m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY 1)
 SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM m"""
