"""The corpus queries: one for each operator, over its whole table, with the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def _file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), _file("byte_bpe_50k.json"), _pattern(), digest=True)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_digest

    return encode_digest(table(spark, sf_dir, "documents"), _file("byte_bpe_multi_50k.tiktoken"), _pattern())


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines

    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), grams=3, num=9, den=10)


def op6_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .transducer import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), _file("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    remainder = "pmod(crc32(cast(cast(doc_id as string) as binary)), 4)"
    scored = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn_from=f"{remainder} <> 2")
    return scored.select("doc_id", F.expr(f"{remainder} = 2").alias("held_out"), "score", "predicted")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op8_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import loss_difference

    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return loss_difference(table(spark, sf_dir, "documents"), good)


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .surrogates import replace_personal

    return replace_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_packing": op1_packing, "op2_linededup": op2_linededup, "op3_quality": op3_quality, "op4_bpe": op4_bpe, "op5_jaccard": op5_jaccard, "op6_tokencount": op6_tokencount, "op7_topk": op7_topk, "op8_lmscore": op8_lmscore, "op9_ann": op9_ann, "op10_pii": op10_pii}
#: DuckDB SQL for those that SQL can express.
ORACLES: dict[str, str] = {
    "op7_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op5_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS grams FROM w
), g AS (
  SELECT r, doc_id, len(grams) AS n, unnest(grams) AS gram FROM s WHERE doc_id IS NOT NULL
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.r <> b.r AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.r, b.r, a.doc_id, b.doc_id, a.n, b.n HAVING 19 * count(*) >= 9 * (a.n + b.n)
), reach(doc, least_id) AS (
  SELECT DISTINCT a, a FROM links UNION SELECT l.b, c.least_id FROM reach c JOIN links l ON l.a = c.doc WHERE c.least_id < l.b
)
SELECT doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, CASE WHEN len(grams) = 0 THEN doc_id ELSE coalesce((SELECT min(least_id) FROM reach WHERE doc = doc_id), doc_id) END AS component_id FROM s
""",
    "op2_linededup": """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS held FROM documents
), numbered AS (
  SELECT doc_id, line, n, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(held) AS line, unnest(range(len(held))) AS n FROM split)
), owners AS (
  SELECT key, min(doc_id) AS owner FROM numbered WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT n.*, o.owner IS NOT NULL AND n.doc_id <> o.owner AS dropped FROM numbered n LEFT JOIN owners o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
