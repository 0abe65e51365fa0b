"""The training-data queries, each over its whole table, and their SQL where it can be had."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorewell.llm import bpe, chat, counts, exact, lm, minhash, packing, quality, sharding, substring


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(_documents(spark, sf_dir)).drop("uid")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json")).drop("uid")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = exact.exact_dedup(_documents(spark, sf_dir))
    return marks.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir), sharding.layout(16), sharding.layout(17))


#: Words with their places, for the two queries below.
WORDS_SQL = """
d AS (SELECT doc_id, list_filter(string_split_regex({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
word AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d)"""

OP2_SQL = """
WITH RECURSIVE {words},
run AS (SELECT doc_id, n, i, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM word),
shingle AS (SELECT DISTINCT doc_id, s FROM run WHERE i <= greatest(1, n - 4)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT way.b, reach.c FROM reach JOIN way ON way.a = reach.doc_id),
component AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM component LEFT JOIN size USING (doc_id)
""".format(words=WORDS_SQL.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"))

OP3_SQL = """
WITH {words},
run AS (SELECT doc_id, n, i, x, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k FROM word),
seen AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS copy FROM run WHERE i <= n - 19),
mark AS (
  SELECT word.doc_id, word.x, word.i,
         coalesce(bool_or(copy) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM word LEFT JOIN seen ON seen.doc_id = word.doc_id AND seen.i = word.i),
left_over AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS r, string_agg(x, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM mark GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN left_over USING (doc_id)
""".format(words=WORDS_SQL.format(text="coalesce(text, '')"))

OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, replace(coalesce(text, ''), '<|', '<\|') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role) - 1 AS rank
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
r AS (
  SELECT t.conv_id, speaker, CAST(floor(rank / 64) AS BIGINT) AS part, rank, role = speaker AS own,
         '<|start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
                             ELSE 'user name=' || replace(role, '<|', '<\|') END || chr(10) AS head,
         text || '<|end|>' || chr(10) AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY rank) AS stop FROM r)
SELECT conv_id, speaker, part, count(*) AS n_turns, count(*) FILTER (own) AS n_masked,
       string_agg(head || body, '' ORDER BY rank) AS text,
       coalesce(string_agg(CAST(stop - length(body) AS BIGINT) || ':' || CAST(stop AS BIGINT), ';' ORDER BY rank) FILTER (own), '') AS mask
FROM o GROUP BY conv_id, speaker, part
"""

OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe_round_trip": op1_bpe_round_trip,
        "op2_minhash_near_dedup": op2_minhash_near_dedup,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_token_counts": op4_token_counts,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_quality_rules": op9_quality_rules,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_minhash_near_dedup": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op5_chat_formatting": OP5_SQL, "op7_exact_dedup": OP7_SQL}
