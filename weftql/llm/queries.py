"""The operators' queries over the test tables, and their SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftql.llm import chat, decontaminate, fixity, jaccard, mixing, quality, sharding, suffixes, tokens, toxicity
from weftql.llm.common import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_conversations(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(tokens.count_tokens(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~toxicity.learnt_from(F.col("doc_id"))).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))


def op5_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' archive against a replica in which every record of a 97th of the ids has a byte changed or its end cut off."""
    records = fixity.warc_records(table(spark, sf_dir, "pages"))
    part, kind = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(97)) == 5, F.when(F.pmod("page_id", F.lit(2)) == 0, "flip").otherwise("cut")
    both = fixity.damaged(records.withColumn("original", F.col("record")), part, kind).withColumnsRenamed({"record": "replica", "original": "record"})
    both = both.select("file", "slot", "offset", "page_id", F.sha2("record", 256).alias("digest"), F.length("record").alias("length"), F.sha2("replica", 256).alias("replica_digest"), F.length("replica").alias("replica_length"))
    both = materialize(both, "fixity-records")
    left, right = (both.select(F.col("file").cast("long").alias("file"), "slot", "offset", F.col(n).cast("long").alias("length"), F.col(d).alias("digest")) for n, d in (("length", "digest"), ("replica_length", "replica_digest")))
    return fixity.audit(left, right).join(both.select("file", "slot", "page_id"), ["file", "slot"], "left").select("page_id", "fault")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("lang")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 16)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("item_ids", ","), 256)
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), items.alias("items_sha256"), "contaminated")


QUERIES: dict[str, Query] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_chat_format": op2_chat_format,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_fixity_audit": op5_fixity_audit,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_shards": op9_shards,
    "op10_jaccard_join": op10_jaccard_join,
}

DECONTAMINATE_SQL = """
WITH normal AS (
  SELECT 'i' AS kind, CAST(item_id AS VARCHAR) AS item, 0 AS rid, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM benchmark
  UNION ALL SELECT 'd', CAST(doc_id AS VARCHAR), row_number() OVER (), translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM documents
), worded AS (
  SELECT kind, item, rid, regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM normal
), phrases AS (
  SELECT DISTINCT item, array_to_string(list_slice(words, i, i + least(len(words), 10) - 1), ' ') AS w, least(len(words), 10) AS n
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM worded WHERE kind = 'i' AND len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM phrases),
windows AS (
  SELECT rid, n, i, array_to_string(list_slice(words, i, i + n - 1), ' ') AS w
  FROM (SELECT d.rid, d.words, s.n, unnest(range(1, len(d.words) - s.n + 2)) AS i FROM worded d, sizes s WHERE d.kind = 'd')
), found AS (SELECT w.rid, w.i, w.n, p.item FROM windows w JOIN phrases p USING (w, n)),
hit AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM found) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT CAST(d.item AS BIGINT) AS doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM worded d LEFT JOIN hit h USING (rid) LEFT JOIN items i USING (rid) WHERE d.kind = 'd'
"""

ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.mixing_oracle(),
    "op2_chat_format": chat.CHAT_SQL,
    "op5_fixity_audit": "SELECT page_id, 'changed' AS fault FROM pages WHERE page_id % 97 = 5",
    "op6_quality_rules": quality.quality_oracle(),
    "op7_decontaminate": DECONTAMINATE_SQL,
    "op9_shards": sharding.sharding_oracle(),
}
