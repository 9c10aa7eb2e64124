"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.chat_format import rotate
from lodestone.llm.decontamination import overlaps
from lodestone.llm.lang_id import identify
from lodestone.llm.license_scan import scan_licenses
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.ngram_join import near_duplicates
from lodestone.llm.packing import pack
from lodestone.llm.quality_rules import score_quality
from lodestone.llm.token_counts import token_counts
from lodestone.llm.voronoi_topk import top_k

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = rotate(_table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return views.withColumn("mask", spans)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, drop_emptied=False, count_as="n_deleted")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    found = [op1_token_counts, op2_chat_format, op3_quality, op4_license_scan, op5_line_dedup, op6_exact_topk, op7_packing, op8_decontamination, op9_ngram_join, op10_language_id, pipeline]
    return {f.__name__: f for f in found}


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.e::DOUBLE[], x.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
SELECT query_id, rn::INTEGER AS "rank", vec_id, score FROM r WHERE rn <= 10
"""


CHAT_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, coalesce(floor(turn / 64)::BIGINT, -1) AS block
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), r AS (
  SELECT t.conv_id, speaker, block, turn, role, text, role = speaker AS own,
    '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head,
    text || '<|im_end|>' || chr(10) AS body
  FROM t JOIN p USING (conv_id)
), s AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, block ORDER BY turn NULLS LAST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a
  FROM r
)
SELECT conv_id, speaker, block, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
  string_agg(head || body, '' ORDER BY turn NULLS LAST, role, text) AS text,
  coalesce(string_agg(a::BIGINT::VARCHAR || '-' || (a + length(body))::BIGINT::VARCHAR, ',' ORDER BY turn NULLS LAST, role, text) FILTER (own), '') AS mask
FROM s GROUP BY ALL
"""

LINES_SQL = r"""
WITH c AS (SELECT doc_id, string_split(regexp_replace(text, '(\n|[.!?] )', '\1' || chr(1), 'g'), chr(1)) AS x FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), c2 AS (SELECT doc_id, flatten(list_transform(x, lambda p: CASE WHEN strlen(p) > 120 THEN string_split(regexp_replace(p, '([,;:] )', '\1' || chr(1), 'g'), chr(1)) ELSE [p] END)) AS x FROM c
), c3 AS (SELECT doc_id, flatten(list_transform(x, lambda p: CASE WHEN strlen(p) > 120 THEN string_split(regexp_replace(p, '(e )', '\1' || chr(1), 'g'), chr(1)) ELSE [p] END)) AS x FROM c2
), u AS (
  SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS k FROM c3
), b AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(13)) AS bare FROM u
), n AS (SELECT doc_id, k, bare, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM b WHERE bare <> ''
), w AS (
  SELECT doc_id, i, bare, bare || chr(1) || lead(bare, 1) OVER d || chr(1) || lead(bare, 2) OVER d AS run FROM n WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), f AS (SELECT run, min({'d': doc_id, 'i': i}) AS first FROM w WHERE run IS NOT NULL GROUP BY run
), l AS (SELECT doc_id, i FROM w JOIN f USING (run) WHERE doc_id <> f.first.d OR i >= f.first.i + 3
), g AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 3 THEN 0 ELSE 1 END AS begins FROM l
), h AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g
), r AS (SELECT doc_id, island, min(i) AS a, max(i) + 2 AS z FROM h GROUP BY ALL
), q AS (
  SELECT r.doc_id, a, z FROM r JOIN n ON n.doc_id = r.doc_id AND n.i BETWEEN a AND z
  GROUP BY r.doc_id, a, z HAVING sum(length(bare) - length(replace(bare, ' ', '')) + 1) >= 25
), m AS (
  SELECT b.doc_id, b.k, b.line, b.bare, coalesce(max(n.i) OVER (PARTITION BY b.doc_id ORDER BY b.k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS i
  FROM b LEFT JOIN n ON n.doc_id = b.doc_id AND n.k = b.k
), e AS (SELECT m.*, EXISTS (SELECT 1 FROM q WHERE q.doc_id = m.doc_id AND m.i BETWEEN a AND z) AS gone FROM m)
SELECT doc_id, coalesce(string_agg(line, '' ORDER BY k) FILTER (NOT gone), '') AS text, count(*) FILTER (gone AND bare <> '') AS n_deleted
FROM e GROUP BY doc_id
UNION ALL SELECT doc_id, text, 0 FROM documents WHERE doc_id IS NULL OR text IS NULL
"""

SEEDS_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL
), t AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS v FROM benchmark WHERE item_id IS NOT NULL
), m AS (SELECT unnest(['1101100111', '1110011011', '1011011101']) AS mask
), dp AS (SELECT doc_id, w, unnest(range(0, len(w) - 9)) AS p FROM d WHERE len(w) >= 10
), tp AS (SELECT item_id, v, unnest(range(0, len(v) - 9)) AS q FROM t WHERE len(v) >= 10
), ds AS (SELECT doc_id, w, p, mask, list_aggregate(list_transform(range(0, 10), lambda j: CASE WHEN substr(mask, (j + 1)::BIGINT, 1) = '1' THEN w[p + j + 1] ELSE '' END), 'string_agg', ' ') AS s FROM dp, m
), ts AS (SELECT item_id, v, q, mask, list_aggregate(list_transform(range(0, 10), lambda j: CASE WHEN substr(mask, (j + 1)::BIGINT, 1) = '1' THEN v[q + j + 1] ELSE '' END), 'string_agg', ' ') AS s FROM tp, m
), h AS (SELECT DISTINCT doc_id, item_id, w, v, p, q, least(15, len(v)) AS n FROM ds JOIN ts USING (mask, s)
), x AS (SELECT *, unnest(range(0, least(p, q, 5) + 1)) AS back FROM h
), y AS (SELECT doc_id, item_id, n, p - back AS a, q - back AS b, list_sum(list_transform(range(1, n + 1), lambda j: (w[p - back + j] = v[q - back + j])::INT)) AS agree FROM x WHERE p - back + n <= len(w) AND q - back + n <= len(v)
), z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agree DESC, a, b) AS rn FROM y WHERE agree >= 0.8 * n)
SELECT doc_id, item_id, agree::BIGINT AS n_agree, n::BIGINT AS n_compared, a::BIGINT AS doc_start, b::BIGINT AS item_start FROM z WHERE rn = 1
"""


JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT DISTINCT a AS v, a AS u FROM e UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u
), c AS (SELECT v, min(u) AS label FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.label, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.v = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": CHAT_SQL, "op5_line_dedup": LINES_SQL, "op6_exact_topk": TOP_K_SQL, "op8_decontamination": SEEDS_SQL, "op9_ngram_join": JACCARD_SQL}
