"""The queries of this subpackage, each over the whole of its tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, licenses, lm_score, mixing, packing, phrases, prefix_trie, quality, sharding, token_counts, token_files
from marlstone.llm.embedding_dedup import near_duplicates
from marlstone.llm.ngram_join import jaccard_components
from marlstone.staging import new_path, stage

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(table(spark, sf_dir, "documents"), "word_bpe_49k.json")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP2_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT x AS u, y AS v FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.v FROM r JOIN e ON r.b = e.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY ALL
"""


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
m AS (SELECT DISTINCT m FROM v),
g AS (SELECT doc_id, m, unnest(range(1, len(w) - m + 2)) AS i, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g FROM d, m WHERE len(w) >= m),
h AS (SELECT doc_id, g.m, i, item_id FROM g JOIN v ON g.g = v.g AND g.m = v.m),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE x AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.v FROM r JOIN l ON r.b = l.u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN r ON r.a = e.vec_id LEFT JOIN n ON n.u = e.vec_id GROUP BY e.vec_id, n.n
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select(F.col("row.doc_id").alias("doc_id"), "p_text", "p_meta", "score", "keep")


def op6_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"))


def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return lm_score.entropy_difference(table(spark, sf_dir, "documents"), good)


def op8_token_count_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted, all counts revised by a new tokenizer version, toxic documents deleted, a batch sent twice."""
    docs, gone = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    rows = stage(token_counts.counted(docs, "spaced-1", "alnum-1"), "op8-counts")
    old, new = (token_counts.version(rows, t) for t in ("spaced-1", "alnum-1"))
    roll = token_counts.Rollup(spark, new_path(spark, "op8-rollup"))
    roll.commit("insert", token_counts.inserts(old))
    roll.commit("revise", token_counts.revisions(old, new))
    roll.commit("delete", token_counts.deletes(token_counts.version(rows.join(gone, "doc_id", "left_semi"), "alnum-1")))
    roll.commit("insert", token_counts.inserts(old))
    return roll.totals()


OP8_SQL = r"""
SELECT source, lang, 'alnum-1' AS tokenizer, count(*) AS n_docs,
  CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[0-9A-Za-z\x{80}-\x{10FFFF}]+'))) AS BIGINT) AS n_tokens
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source, lang
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.templates(spark))


def _op9_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(licenses.NOTICES.items()))
    cut = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"
    return rf"""
WITH t AS (SELECT template_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM (VALUES {rows}) AS v(template_id, text)),
ts AS (SELECT DISTINCT template_id, unnest({cut}) AS g FROM t),
tn AS (SELECT template_id, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS step FROM ts GROUP BY template_id),
d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
ds AS (SELECT doc_id, unnest({cut}) AS g, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END)) AS i FROM d),
h AS (SELECT doc_id, template_id, ds.g, i, n, step, i // step AS k FROM ds JOIN ts USING (g) JOIN tn USING (template_id)),
win AS (SELECT doc_id, template_id, g, i, n, k * step AS start FROM h UNION SELECT doc_id, template_id, g, i, n, greatest(k - 1, 0) * step FROM h),
c AS (SELECT doc_id, template_id, start, count(DISTINCT g) / any_value(n) AS containment, min(i) AS i FROM win GROUP BY ALL)
SELECT doc_id, template_id, max(containment) AS containment, min(i) AS first_word, count(*) AS n_windows
FROM c WHERE containment >= 0.8 GROUP BY doc_id, template_id
"""


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


#: SQL has no crc32 there, so its bits are folded one by one; a node's name is its turns with their lengths.
OP11_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS head, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
k AS (SELECT c.*, least(h, coalesce(n, 0)) AS lent FROM c LEFT JOIN (SELECT conv_id AS head, count(*) AS n FROM t GROUP BY conv_id) USING (head)),
r AS (SELECT k.conv_id, p AS d, role, text FROM k JOIN t ON t.conv_id = k.head AND p <= h UNION ALL SELECT k.conv_id, p - h + lent, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND p > h),
s AS (SELECT conv_id, d, strlen(text) AS bytes, string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY d) OVER (PARTITION BY conv_id ORDER BY d) AS node FROM r
  UNION ALL SELECT conv_id, 0, 0, '' FROM k),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM s GROUP BY node, d),
e AS (SELECT node, d, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT * FROM s QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY node, d),
u AS (SELECT n.*, m.conv_id AS parent_conv_id, m.node AS up FROM n LEFT JOIN s ON s.conv_id = n.conv_id AND s.d = n.d - 1 LEFT JOIN n m ON m.node = s.node AND m.d = s.d),
ch AS (SELECT up AS node, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN ch USING (node, d)),
b AS (SELECT s.node, s.d, count_if(v.n_children = 0) AS n_leaves, CAST(sum((v.n_convs - 1) * v.bytes) AS BIGINT) AS saved_tokens FROM v JOIN s ON s.conv_id = v.conv_id AND s.d <= v.d GROUP BY s.node, s.d)
SELECT conv_id, d AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM v JOIN b USING (node, d) LEFT JOIN e USING (node, d)
"""


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(spark, packing.pack(table(spark, sf_dir, "documents")))


def op13_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, len, unnest(list_transform(range(1, len(w) - len + 2), lambda i: array_to_string(w[i:i + len - 1], ' '))) AS phrase FROM p, (SELECT unnest(range(1, 6)) AS len) WHERE len(w) >= len),
f AS (SELECT lang, len, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
c AS (SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE len >= 2),
k AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.lang = c.lang AND d.len > c.len AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
s AS (SELECT k.lang, k.phrase, k.a, x.f AS l, y.f AS r, t.n, i, (1000 * CAST(k.a AS HUGEINT) * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM (SELECT *, unnest(range(1, len)) AS i FROM k) k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[:i], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[i + 1:], ' ') JOIN t ON t.lang = k.lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_id_output, op2_ngram_jaccard_join, op3_benchmark_decontamination, op4_embedding_near_dedup, op5_quality_classifier,
        op6_balanced_shards, op7_cross_entropy_difference, op8_token_count_rollup, op9_license_scan, op10_source_mixing, op11_conversation_trie, op12_best_fit_packing, op13_phrase_collocation,
    )
}
ORACLE_SQL = {
    "op2_ngram_jaccard_join": OP2_SQL,
    "op3_benchmark_decontamination": OP3_SQL,
    "op4_embedding_near_dedup": OP4_SQL,
    "op8_token_count_rollup": OP8_SQL,
    "op9_license_scan": _op9_sql(),
    "op11_conversation_trie": OP11_SQL,
    "op13_phrase_collocation": OP13_SQL,
}
