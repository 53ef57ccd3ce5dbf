"""Token counts as an exact histogram of encoded lengths.

Documents are encoded whole with a public byte-level tokenizer; only lengths leave the tasks. The histogram's running sums
answer, for every context limit that matters (each length that occurs), how many documents fit, how many tokens there are,
what is left when documents are cut at the limit, and at which quantile the limit stands.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TOKENIZER = os.environ.get("WEFTQL_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the pattern by which this vocabulary's texts are split.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Lengths of one run of running sums.
RUN = 4096

_encodings: dict = {}


def encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in batch.column("__text").to_pylist()], pa.int64())
            kept = [i for i, f in enumerate(batch.schema.names) if f != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), n], schema=pa.schema([*(batch.schema.field(i) for i in kept), ("n_tokens", pa.int64())]))

    return run


def count_tokens(docs: DataFrame, path: str = TOKENIZER, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and n_tokens for every row of docs(text, ...). Null text has none; strings of special tokens are ordinary text."""
    out = docs.select(*keep, F.col("text").alias("__text"))
    names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in out.schema if f.name != "__text")
    return out.mapInArrow(_lengths(path), f"{names}n_tokens long")


def length_histogram(counted: DataFrame) -> DataFrame:
    """context_limit, n_docs, docs_within, docs_over, tokens_within, total_tokens, kept_tokens, quantile, a row for each length that occurs in counted(n_tokens).

    kept_tokens: tokens left when every document is cut at the limit. quantile: share of documents within the limit. Running
    sums go over runs of RUN lengths and over the runs' totals. No documents: no rows.
    """
    by_length = counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs")).withColumn("run", F.expr(f"n_tokens DIV {RUN}"))
    by_run = by_length.groupBy("run").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    every = Window.partitionBy()
    before = every.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_run.select(
        "run", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens")
    )
    inside = Window.partitionBy("run").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    summed = by_length.select("*", F.sum("n_docs").over(inside).alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside).alias("t")).join(offsets, "run")
    within, tokens = F.col("d0") + F.col("d"), F.col("t0") + F.col("t")
    return summed.select(
        F.col("n_tokens").alias("context_limit"), "n_docs", within.alias("docs_within"), (F.col("all_docs") - within).alias("docs_over"), tokens.alias("tokens_within"),
        F.col("all_tokens").alias("total_tokens"), (tokens + F.col("n_tokens") * (F.col("all_docs") - within)).alias("kept_tokens"), (within / F.col("all_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_within, total_tokens, kept_tokens for any limits, from the row of the greatest length within each."""
    asked = histogram.sparkSession.createDataFrame([(x,) for x in limits], "limit long")
    row = F.struct("context_limit", "docs_within", "docs_over", "tokens_within", "total_tokens")
    best = histogram.select(F.explode(F.array(*[F.when(F.col("context_limit") <= x, F.struct(F.lit(x).cast("long").alias("limit"), row.alias("r"))) for x in limits])).alias("x")).where("x IS NOT NULL")
    best = best.groupBy("x.limit").agg(F.max("x.r").alias("r"))
    total = histogram.agg(F.max("total_tokens").alias("tokens"), F.max(F.col("docs_within") + F.col("docs_over")).alias("docs"))
    return asked.join(best, "limit", "left").crossJoin(F.broadcast(total)).select(
        "limit", F.coalesce("r.docs_within", F.lit(0)).alias("docs_within"), F.coalesce("tokens", F.lit(0)).alias("total_tokens"),
        F.coalesce(F.col("r.tokens_within") + F.col("limit") * F.col("r.docs_over"), F.col("limit") * F.col("docs"), F.lit(0)).alias("kept_tokens"),
    )
