"""The queries opN_<name> over the driver's tables and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import contained_items
from .exact_dedup import exact_dedup
from .html_extract import extract_pages
from .lm_mixing import score_texts
from .mixing import mix_sources
from .pii_crf import find_pii
from .simhash import simhash_components
from .token_counts import count_tokens
from .tool_calls import conversation_calls, conversation_schemas, link_tool_calls, other_messages
from .toxicity import fit, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@_query("""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS k,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


@_query()
def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents")).drop("is_first")


@_query()
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@_query(f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS sh FROM d WHERE len(w) >= 5),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS sh FROM i WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS s FROM its GROUP BY item_id)
SELECT doc_id, item_id, any_value(s) AS item_shingles, count(*) AS shared_shingles, count(*) / any_value(s) AS containment
FROM ds JOIN its USING (sh) JOIN n USING (item_id) GROUP BY doc_id, item_id
HAVING count(*) >= ceil(0.8 * any_value(s) - 1e-9)
""")
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit(docs, _table(spark, sf_dir, "labels")))


@_query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query()
def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


@_query()
def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents")).drop("found")


@_query("""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS body FROM conversations),
c AS (
  SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name,
         CASE role WHEN 'user' THEN to_json({'prompt': body, 'turn': turn}) ELSE to_json({'instructions': body}) END AS arguments, role
  FROM m WHERE role IN ('user', 'system')),
i AS (
  SELECT *, sum(CASE WHEN before = turn - 2 THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn % 2, role ORDER BY turn) AS island
  FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id, turn % 2, role ORDER BY turn) AS before FROM c)),
-- a user's parent may be any call two turns before
d AS (
  SELECT u.*, CASE WHEN role = 'system' THEN 0 ELSE
    row_number() OVER (PARTITION BY conv_id, turn % 2, role, island ORDER BY turn) - 1
    + CASE WHEN EXISTS (SELECT 1 FROM c s WHERE s.role = 'system' AND s.conv_id = u.conv_id AND s.turn + 2 =
        (SELECT min(turn) FROM i x WHERE x.conv_id = u.conv_id AND x.turn % 2 = u.turn % 2 AND x.role = u.role AND x.island = u.island)) THEN 1 ELSE 0 END END AS depth
  FROM i u),
r AS (SELECT conv_id, turn AS result_turn, 'c' || conv_id || '-' || (turn - 1) AS call_id, body AS content FROM m WHERE role = 'assistant'),
j AS (
  SELECT coalesce(d.conv_id, r.conv_id) AS conv_id, coalesce(d.call_id, r.call_id) AS call_id, name, turn, result_turn, depth, arguments, content,
         CASE WHEN d.conv_id IS NULL THEN 0 ELSE 1 END AS n_calls, CASE WHEN r.conv_id IS NULL THEN 0 ELSE 1 END AS n_results
  FROM d FULL JOIN r ON d.conv_id = r.conv_id AND d.call_id = r.call_id),
s AS (SELECT *, CASE WHEN n_calls = 0 THEN 'orphan' WHEN n_results = 0 THEN 'pending' WHEN result_turn <= turn THEN 'early' ELSE 'linked' END AS status FROM j)
SELECT conv_id, call_id, name, turn, result_turn, CAST(depth AS BIGINT) AS depth, CAST(n_calls AS BIGINT) AS n_calls, CAST(n_results AS BIGINT) AS n_results, status,
       CASE WHEN n_calls = 1 THEN '' END AS errors,
       '{' || array_to_string(list_filter([
         CASE WHEN arguments IS NOT NULL THEN '"arguments":' || arguments END, '"id":' || to_json(call_id),
         CASE WHEN name IS NOT NULL THEN '"name":' || to_json(name) END, CASE WHEN content IS NOT NULL THEN '"result":' || to_json(content) END,
         '"status":' || to_json(status)], lambda x: x IS NOT NULL), ',') || '}' AS record,
       lpad(coalesce(CAST(CAST(depth AS BIGINT) AS VARCHAR), repeat('9', 19)), 19, '0') || ':' || lpad(CAST(coalesce(turn, result_turn) AS VARCHAR), 19, '0') || ':' || call_id AS order_key
FROM s
""")
def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _table(spark, sf_dir, "conversations")
    linked = link_tool_calls(*conversation_calls(messages), conversation_schemas(spark)).unionByName(other_messages(messages))
    return linked.withColumn("errors", F.array_join("errors", ","))


@_query()
def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    scored = score_texts(_table(spark, sf_dir, "documents"), ~held_out)
    return scored.withColumn("held_out", held_out)
