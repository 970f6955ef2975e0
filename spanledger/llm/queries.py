"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.session import work_dir

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_hyperminhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanledger.llm.minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir))


def op1_budgeted_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanledger.llm.chat import format_conversations, read_back

    said = F.lit("\\### Assistant: </turn> ok")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(given.unionByName(added)))


def op3_sparse_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanledger.llm.repeats import repeated_passages

    return repeated_passages(_documents(spark, sf_dir))


def op2_anchored_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanledger.llm.pii import find_personal_data

    return find_personal_data(_documents(spark, sf_dir))


def op6_assigned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanledger.llm.secrets import find_secrets

    return find_secrets(_documents(spark, sf_dir))


def op7_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanledger.llm.toxicity import classify

    return classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanledger.llm.packing import pack

    return pack(_documents(spark, sf_dir))


def op10_context_mixed_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanledger.llm.tokenfile import read_tokens, write_tokens

    path = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(_documents(spark, sf_dir), path)
    return read_tokens(spark, path)


def op5_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanledger.llm.decontaminate import contaminated

    return contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_hash")


def op9_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanledger.llm.fingerprint import fingerprints

    return fingerprints(_documents(spark, sf_dir))


def op11_segmented_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanledger.llm.urls import judged

    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_automaton_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanledger.llm.periods import planted, run_digests

    return run_digests(_documents(spark, sf_dir), planted)


def op13_hashed_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanledger.llm.importance import resample

    return resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Query] = {
    "op1_budgeted_chat_windows": op1_budgeted_chat_windows,
    "op2_anchored_personal_data": op2_anchored_personal_data,
    "op3_sparse_suffix_repeats": op3_sparse_suffix_repeats,
    "op4_hyperminhash_near_duplicates": op4_hyperminhash_near_duplicates,
    "op5_benchmark_containment": op5_benchmark_containment,
    "op6_assigned_secrets": op6_assigned_secrets,
    "op7_recurrent_toxicity": op7_recurrent_toxicity,
    "op8_bounded_space_packing": op8_bounded_space_packing,
    "op9_bottom_k_fingerprints": op9_bottom_k_fingerprints,
    "op10_context_mixed_token_files": op10_context_mixed_token_files,
    "op11_segmented_url_verdicts": op11_segmented_url_verdicts,
    "op12_automaton_period_runs": op12_automaton_period_runs,
    "op13_hashed_importance_resampling": op13_hashed_importance_resampling,
}
_SETS = """
    SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN ['=' || array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS s
    FROM (SELECT {key}, list_filter(regexp_split_to_array({low}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM {table})"""
_ASCII = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOWER = "lower(coalesce(text, ''))"
# CRC-32 by its table of 256 entries, which the rule of its polynomial fills
_CRC = """crc AS (SELECT CAST(i AS BIGINT) AS i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) t(i)
      UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8)
    , crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8)"""

ORACLES: dict[str, str] = {
    "op4_hyperminhash_near_duplicates": "WITH RECURSIVE sets AS (" + _SETS.format(key="doc_id", low=_ASCII, table="documents") + """)
    , sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id)
    , links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id
      JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*)))
    , both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links)
    , reach AS (SELECT DISTINCT x AS root, x AS node FROM both_ways UNION SELECT r.root, b.y FROM reach r JOIN both_ways b ON r.node = b.x)
    , least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
    SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.root, d.doc_id) AS component_id, coalesce(l.root, d.doc_id) = d.doc_id AS kept
    FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.node = d.doc_id""",
    "op5_benchmark_containment": "WITH held AS (" + _SETS.format(key="doc_id", low=_LOWER, table="documents") + "), items AS ("
    + _SETS.format(key="item_id", low=_LOWER, table="benchmark") + """), sizes AS (SELECT item_id, count(*) AS q FROM items GROUP BY item_id)
    SELECT doc_id, item_id, q AS item_shingles, count(*) AS shared, count(*) / CAST(q AS DOUBLE) AS containment
    FROM held JOIN items USING (s) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, q HAVING 100 * count(*) >= 75 * q""",
    "op13_hashed_importance_resampling": "WITH RECURSIVE " + _CRC + f""", said AS (
      SELECT 0 AS side, doc_id, unnest(regexp_extract_all({_ASCII}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS w FROM documents
      UNION ALL SELECT 1, item_id, unnest(regexp_extract_all({_ASCII}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) FROM benchmark)
    , spelt AS (SELECT w, list_transform(range(1, len(hex(encode(w))) + 1, 2), lambda p: CAST('0x' || substr(hex(encode(w)), p, 2) AS BIGINT)) AS b FROM (SELECT DISTINCT w FROM said))
    , hashed AS (SELECT w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM spelt, crc_table)
    , counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM said JOIN hashed USING (w) GROUP BY bucket)
    , totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counts)
    , gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM counts, totals)
    , held AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM said JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id)
    , scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM documents d LEFT JOIN held h ON h.doc_id = d.doc_id)
    , placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed""",
}
