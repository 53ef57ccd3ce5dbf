"""Shards by jump consistent hashing: a document's shard follows from its id and the number of shards alone.

There is no ring or table to keep. When a shard is appended, a document stays where it is or moves into the new shard,
and one in n + 1 moves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftql.llm.common import key_hash, prefix_sums

#: Fixed values of the published algorithm (Lamping and Veach 2014): the multiplier of its 64-bit generator.
MULTIPLIER = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key among the given number."""
    key, shard = keys.astype(np.uint64).copy(), np.full(len(keys), -1, np.int64)
    ahead, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
    while len(live):
        shard[live] = ahead[live]
        key[live] = key[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        draw = ((key[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        ahead[live] = ((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard.astype(np.int32)


def shard_documents(docs: DataFrame, shards: int = 16, *, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), seed: str = "shard") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the columns in keep.

    size: UTF-8 bytes of the text (null: none) plus 1. law is `key`. slot: 0, 1, ... within the shard, in a hash order of
    id, checksum, size and what is kept; equal rows get neighbouring slots. grown_shard: with
    one shard more. A null id is a key of its own; null text has the checksum of no bytes; an empty table gives no rows.
    """

    octets = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    sized = docs.select(F.col(key), *keep, (F.length(octets) + 1).cast("long").alias("size"), F.crc32(octets).alias("text_crc32")).withColumn("__at", _placing(shards)(key_hash(F.col(key), seed=seed)))
    order = key_hash(F.col(key), "text_crc32", "size", *([F.xxhash64(*keep)] if keep else []), seed=seed)
    sized = sized.select(F.col(key), *keep, "size", "text_crc32", order.alias("__h"), F.col("__at.shard").alias("shard"), F.col("__at.grown_shard").alias("grown_shard"), F.lit(1).alias("__one"))
    numbered = prefix_sums(sized, "shard", "__h", {"slot": "__one"}, [key, "text_crc32", "size"], wide=bool(keep))
    return numbered.select(F.col(key), *keep, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _placing(shards: int):
    @F.pandas_udf("shard int, grown_shard int")
    def place(keys: pd.Series) -> pd.DataFrame:
        k = keys.to_numpy(np.int64).astype(np.uint64)
        return pd.DataFrame({"shard": jump(k, shards), "grown_shard": jump(k, shards + 1)})

    return place


def crc32_table() -> list[int]:
    """The checksum's table of 256 entries, by its rule: the reflected polynomial of IEEE 802.3."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


def sharding_oracle(documents: str = "documents", shards: int = 16, seed: str = "shard") -> str:
    """The same rows in DuckDB's SQL: the checksum byte by byte, the jumps as a recursive query."""
    hashed = lambda text: f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"
    named = f"'{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')"
    return f"""
WITH RECURSIVE octets AS (
  SELECT row_number() OVER () AS rid, doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS o FROM {documents}
), sized AS (
  SELECT rid, doc_id, len(o) + 1 AS size, {hashed(named)} AS h,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), o), lambda c, x: xor(c >> 8, list_extract({crc32_table()}, CAST(xor(c & 255, x) AS BIGINT) + 1))), 4294967295) AS text_crc32
  FROM octets
), jumped(rid, shards, state, shard, ahead) AS (
  SELECT rid, n, CAST(h AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM sized, (VALUES ({shards}), ({shards + 1})) AS v(n)
  UNION ALL
  SELECT rid, shards, next, ahead, CAST(floor((ahead + 1) * (CAST(2147483648 AS DOUBLE) / CAST(next // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT rid, shards, ahead, (state * {MULTIPLIER} + 1) % 18446744073709551616 AS next FROM jumped WHERE ahead < shards)
)
SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, s.text_crc32, 'key' AS law, CAST(a.shard AS INT) AS shard,
       row_number() OVER (PARTITION BY a.shard ORDER BY {hashed(f"{named} || '|' || text_crc32 || '|' || size")}, doc_id, text_crc32, size) - 1 AS slot, CAST(b.shard AS INT) AS grown_shard
FROM sized s JOIN jumped a ON a.rid = s.rid AND a.shards = {shards} AND a.ahead >= {shards} JOIN jumped b ON b.rid = s.rid AND b.shards = {shards + 1} AND b.ahead >= {shards + 1}
"""
