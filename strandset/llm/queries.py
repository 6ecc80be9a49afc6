"""The registered queries of this subpackage and their DuckDB SQL."""

from . import ann, bpe, embedding_dedup, jaccard_join, langid, lm, packing, substring_dedup, suffix_dedup, toxicity


def pipeline(spark, sf_dir):
    """Query: the stages of corpus_pipeline over documents; each stage tells what odd rows give."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_langid": langid.op1_langid,
    "op2_packing": packing.op2_packing,
    "op3_ann": ann.op3_ann,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_bpe": bpe.op5_bpe,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_lm": lm.op8_lm,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "pipeline": pipeline,
}

#: Vectors of any size but the usual one take no part; the tables have one size only.
_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
#: What str.split() takes for white space.
_BLANKS = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

_NEAREST = f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND {_SOUND}),
d AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS place FROM d) SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM r WHERE place <= 10"""
_SAME_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND {_SOUND}),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN n USING (vec_id)"""
_SIMILAR = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{_BLANKS}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS shingle FROM w WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE c * 10 >= 8 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a), n AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_links, class_id, doc_id = class_id AS kept FROM least LEFT JOIN n USING (doc_id)"""
_REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM p), many AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w JOIN many USING (m)),
runs AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit),
spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, b AS x, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS y FROM spans UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, length(h) // 2) - x)), '' ORDER BY x) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed FROM spans GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op3_ann": _NEAREST, "op7_embedding_dedup": _SAME_VECTORS, "op9_suffix_dedup": _REPEATS, "op10_jaccard_join": _SIMILAR}
