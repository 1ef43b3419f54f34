"""The queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidara.llm import bpe, embeddings, ftrl, gam, lexical, licenses, outliers, packing, pieces, quotes, simhash, token_files, variants


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_p_stable_embeddings": embeddings.query,
        "op2_ftrl_toxicity": ftrl.query,
        "op3_quotation_links": quotes.query,
        "op4_bin_completion_packing": packing.query,
        "op5_wavelet_token_files": token_files.query,
        "op6_robust_outliers": outliers.query,
        "op7_simhash_tiles": simhash.query,
        "op8_additive_model_quality": gam.query,
        "op9_distinct_word_bpe": bpe.query,
        "op10_license_paragraphs": licenses.query,
        "op11_piece_agenda": pieces.query,
        "op12_block_max_wand": lexical.query,
        "op13_anagram_variants": variants.query,
    }


#: All pairs of vectors, and what each reaches. Operators without SQL are trained, search, or need hashes and tokenizers that SQL lacks.
EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY ALL), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY ALL)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

#: Scores of all documents that share a term with an item, in whole numbers but for the logarithm.
SEARCH = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS size, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY ALL), c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * size * n) // l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""

#: Near words by their spellings with a letter left out or open; crc32 a bit at a time.
VARIANTS = """
WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
k AS (SELECT doc_id, run, count(*) AS n, doc_id || ':' || run AS x FROM r WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, xor(list_reduce([4294967295::BIGINT] || flatten([[('0x' || substr(hex(x), 2 * i + 1, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR i IN range(strlen(x))]),
  lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295) AS h FROM k),
m AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 7 GROUP BY ALL HAVING sum(n) >= 2),
o AS (SELECT word, n, unnest([substr(word, 1, i) || '*' || substr(word, i + 2) FOR i IN range(length(word))]) AS x FROM v),
l AS (SELECT DISTINCT word, n, replace(x, '*', '') AS x FROM o),
p AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM o a JOIN o b ON a.x = b.x AND a.word <> b.word UNION SELECT l.word, l.n, v.word, v.n FROM l JOIN v ON l.x = v.word UNION SELECT v.word, v.n, l.word, l.n FROM l JOIN v ON l.x = v.word),
f AS (SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS form, max(near_n) AS form_n FROM p GROUP BY ALL),
g AS (SELECT word, form, form_n FROM f WHERE form_n >= 10 * n),
t AS (SELECT word, word AS root FROM v UNION ALL SELECT t.word, g.form FROM t JOIN g ON g.word = t.root),
e AS (SELECT word, root FROM t WHERE root NOT IN (SELECT word FROM g))
SELECT v.word, g.form, e.root, v.n, coalesce(f.n_near, 0)::BIGINT AS n_near, g.form_n FROM v JOIN e USING (word) LEFT JOIN f USING (word) LEFT JOIN g USING (word)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_p_stable_embeddings": EMBEDDINGS, "op12_block_max_wand": SEARCH, "op13_anagram_variants": VARIANTS}
