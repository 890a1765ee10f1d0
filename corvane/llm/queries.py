"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cas_store, decontam, hard_negatives, jaccard, langid, layout, licenses, matroska, packing, quality, secret_scan, suffix_dedup, vector_dedup

#: The tokenizer file of the queries; operators take any file of the tokenizers library.
TOKENIZER = "word_bpe_49k.json"
#: Grades of the ratings: 0 toxic, 1 of low quality, 2 good.
GRADES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learned_languages(docs: DataFrame) -> langid.Model:
    """The model of the rows outside the held-out fold."""
    return langid.fit(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out()))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.classify(docs.select("doc_id", "text"), learned_languages(docs))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digest(matroska.write(table(spark, sf_dir, "documents")))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.find(table(spark, sf_dir, "documents")).drop("spans")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades from both labels; documents with a tail probability of SELECT or more are selected."""
    labels = table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, ratings, GRADES))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = cas_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=2)
    return cas_store.read_digests(store)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=0)


def op11_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.plan(table(spark, sf_dir, "documents"))


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.classes(table(spark, sf_dir, "embeddings"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_license_scan, op3_matroska, op4_suffix_dedup, op5_secret_scan, op6_quality, op7_token_store, op8_jaccard_join, op9_decontamination, op10_packing, op11_layout, op12_vector_dedup, op13_hard_negatives)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
e AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.doc_id)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

_OP9 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(ws), 10) AS m, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda j: array_to_string(ws[j:j + least(len(ws), 10) - 1], ' '))) AS g FROM i WHERE len(ws) > 0),
m AS (SELECT DISTINCT m FROM iw),
dp AS (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, m WHERE len(ws) >= m),
hit AS (SELECT DISTINCT doc_id, p, dp.m, item FROM dp JOIN iw ON iw.m = dp.m AND iw.g = array_to_string(ws[p:p + dp.m - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT doc_id, p, m FROM hit)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# CRC-32 bit by bit; coordinates by counting smaller rows; boxes and cells compared one by one.
_OP11 = r"""
WITH d AS (SELECT doc_id, encode(source) AS a, encode(lang) AS b, coalesce(strlen(text), -1) AS c,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
     lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])), lambda h, k: xor(h >> 1, (h & 1) * 3988292384))), 4294967295) % 365 AS e
  FROM documents),
r AS (SELECT doc_id, (rank() OVER (ORDER BY a NULLS FIRST) - 1) * 16 // count(*) OVER () AS c0, (rank() OVER (ORDER BY b NULLS FIRST) - 1) * 16 // count(*) OVER () AS c1,
  (rank() OVER (ORDER BY c) - 1) * 16 // count(*) OVER () AS c2, (rank() OVER (ORDER BY e NULLS FIRST) - 1) * 16 // count(*) OVER () AS c3 FROM d),
z AS (SELECT *, CAST(list_sum(list_transform(range(4), lambda i: ((c0 >> i) & 1) * (8 << (4 * i)) + ((c1 >> i) & 1) * (4 << (4 * i)) + ((c2 >> i) & 1) * (2 << (4 * i)) + ((c3 >> i) & 1) * (1 << (4 * i)))) AS BIGINT) AS z FROM r),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM z),
f AS (SELECT *, position // 1000 AS file FROM p),
b AS (SELECT file, min(c0) AS l0, max(c0) AS h0, min(c1) AS l1, max(c1) AS h1, min(c2) AS l2, max(c2) AS h2, min(c3) AS l3, max(c3) AS h3 FROM f GROUP BY file),
q AS (SELECT DISTINCT z, c0, c1, c2, c3 FROM f),
fc AS (SELECT DISTINCT file, c0, c1, c2, c3 FROM f),
t AS (SELECT z, count(*) AS files_touched FROM q JOIN b ON c0 BETWEEN l0 AND h0 AND c1 BETWEEN l1 AND h1 AND c2 + 2 >= l2 AND c2 - 2 <= h2 AND c3 + 2 >= l3 AND c3 - 2 <= h3 GROUP BY z),
m AS (SELECT q.z, count(DISTINCT file) AS files_matching FROM q JOIN fc ON q.c0 = fc.c0 AND q.c1 = fc.c1 AND abs(q.c2 - fc.c2) <= 2 AND abs(q.c3 - fc.c3) <= 2 GROUP BY q.z)
SELECT doc_id, z, position, file, files_touched, files_matching, concat_ws(',', l0, h0, l1, h1, l2, h2, l3, h3) AS file_bounds
FROM f JOIN b USING (file) JOIN t USING (z) JOIN m USING (z)
"""

_OP12 = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS x FROM embeddings),
n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
u AS (SELECT * FROM n WHERE norm > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.9),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.vec_id),
k AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT r.vec_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_links, min(c) AS component_id, r.vec_id = min(c) AS kept FROM r LEFT JOIN k ON k.vec_id = r.vec_id GROUP BY r.vec_id
"""

_OP13 = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""


def oracle_sql() -> dict[str, str]:
    """The other operators need models, tokenizers, file formats or byte windows and are tested against brute force."""
    return {"op8_jaccard_join": _OP8, "op9_decontamination": _OP9, "op11_layout": _OP11, "op12_vector_dedup": _OP12, "op13_hard_negatives": _OP13}
