"""Fixity audit of archived web records by Merkle trees.

A replica is a set of WARC files; a file is a sequence of records at ordered offsets. Leaves are the records' SHA-256 digests
with their offsets and lengths; a node hashes the digests of a run of FANOUT neighbours in order; a file's top nodes are
joined over runs of files up to one root. Replicas are compared from the root down: each level joins only the children of
nodes that differ, so two sound replicas cost one comparison, and a corrupt record one path.

Trees are small tables (a row a node), built and compared by Spark; no node sees more than FANOUT children.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftql.llm.common import key_hash, materialize, prefix_sums

FANOUT = 64
#: Bytes of records that a WARC file holds, about.
FILE_BYTES = 1 << 20
TARGET_HEADER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "


def warc_records(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """file, slot, offset, record (bytes), page_id for pages(page_id, url, html): a WARC archive's records.

    Pages are dealt to files by a hash of id, url and content and ordered in them by it. slot: 0, 1, ... in the file; offset: where the
    record begins. Null url and html are empty; a null id is a value like others; repeated pages are records of their own.
    """
    body, head = F.coalesce(F.col("html").cast("binary"), F.lit(b"")), F.coalesce("url", F.lit(""))
    record = F.concat(F.concat(F.lit(TARGET_HEADER), head, F.lit("\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary"), body, F.lit(b"\r\n\r\n"))
    rows = pages.select("page_id", record.alias("record"), "url").withColumn("size", F.length("record").cast("long")).withColumn("one", F.lit(1))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count("*").alias("n")).collect()[0]
    files = max(1, -(-total["b"] // file_bytes))
    rows = rows.withColumn("digest", F.sha2("record", 256)).withColumn("h", key_hash("page_id", "url", "digest", seed="warc")).drop("url")
    rows = rows.withColumn("file", F.pmod(F.col("h"), F.lit(files)).cast("int"))
    return prefix_sums(rows, "file", "h", {"slot": "one", "offset": "size"}, ["page_id", "size", "digest"], wide=True).select("file", "slot", "offset", "record", "page_id")


def digests(records: DataFrame) -> DataFrame:
    """Leaves: file, slot, offset, length, digest of records(file, slot, offset, record)."""
    return records.select(F.col("file").cast("long").alias("file"), "slot", "offset", F.length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))


class Tree:
    """Levels of a replica: nodes of level l of a file are runs of FANOUT^l slots; above the files' tops, runs of files."""

    def __init__(self, leaves: DataFrame, slots: int, files: int, label: str):
        self.levels, self.heights = [], (_height(slots), _height(files))
        leaf = F.sha2(F.concat_ws("|", "offset", "length", "digest"), 256)
        level = materialize(leaves.select("file", F.col("slot").alias("node"), leaf.alias("digest"), "offset", F.col("length").alias("bytes")), label)
        self.levels.append(level)
        for step in range(sum(self.heights)):
            inside = step < self.heights[0]
            up = [F.col("file"), F.expr(f"node DIV {FANOUT}").alias("node")] if inside else [F.expr(f"file DIV {FANOUT}").alias("file"), F.lit(0).cast("long").alias("node")]
            place = F.col("node") if inside else F.col("file")
            rows = level.select(*up, place.alias("place"), "digest", "offset", "bytes")
            children = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda x: F.concat(x["place"].cast("string"), F.lit(":"), x["digest"])))
            level = materialize(rows.groupBy("file", "node").agg(F.sha2(children, 256).alias("digest"), F.min("offset").alias("offset"), F.sum("bytes").alias("bytes")), label)
            self.levels.append(level)


def _height(n: int) -> int:
    return max(0, math.ceil(math.log(max(1, n), FANOUT) - 1e-9))


def extent(leaves: DataFrame) -> tuple[int, int]:
    found = leaves.agg(F.max("slot").alias("s"), F.max("file").alias("f")).collect()[0]
    return (found["s"] or 0) + 1, (found["f"] or 0) + 1


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """file, slot, offset, fault for each record at which two replicas' leaves (see digests) differ.

    fault: `missing` (not in the right replica), `added` (not in the left), `moved` (same content at another offset) or
    `changed`. Slots are the left replica's, or the right's where added. Equal replicas, or two empty ones, give no rows.
    """
    a, b = extent(left), extent(right)
    slots, files = max(a[0], b[0]), max(a[1], b[1])
    trees = Tree(left, slots, files, "fixity-left"), Tree(right, slots, files, "fixity-right")
    inner = trees[0].heights[0]
    suspects = None  # nodes of the level above that differ
    for step in range(len(trees[0].levels) - 1, -1, -1):
        l, r = (t.levels[step].select("file", "node", F.col("digest").alias(f"digest_{s}")) for t, s in zip(trees, "lr", strict=True))
        if suspects is not None:
            up = (F.col("file"), F.expr(f"node DIV {FANOUT}")) if step < inner else (F.expr(f"file DIV {FANOUT}"), F.lit(0).cast("long"))
            l, r = (x.withColumn("pf", up[0]).withColumn("pn", up[1]).join(suspects.select(F.col("file").alias("pf"), F.col("node").alias("pn")), ["pf", "pn"], "left_semi").drop("pf", "pn") for x in (l, r))
        differ = l.join(r, ["file", "node"], "full").where(~F.col("digest_l").eqNullSafe(F.col("digest_r"))).select("file", "node")
        suspects = materialize(differ, "fixity-suspects") if step else differ
    wrong = suspects.select("file", F.col("node").alias("slot"))
    l = wrong.join(left, ["file", "slot"]).select("file", "slot", F.col("offset").alias("lo"), F.col("digest").alias("ld"))
    r = wrong.join(right, ["file", "slot"]).select("file", "slot", F.col("offset").alias("ro"), F.col("digest").alias("rd"))
    fault = F.when(F.col("ld").isNull(), "added").when(F.col("rd").isNull(), "missing").when(F.col("ld") == F.col("rd"), "moved").otherwise("changed")
    return l.join(r, ["file", "slot"], "full").select(F.col("file").cast("int").alias("file"), "slot", F.coalesce("lo", "ro").alias("offset"), fault.alias("fault"))


def damaged(records: DataFrame, part: Column, kind: Column) -> DataFrame:
    """A replica in which the records where `part` holds lost a byte's value (kind `flip`) or their tail (kind `cut`)."""
    flipped = F.concat(F.substring("record", 1, 20), F.lit(b"\x00"), F.expr("substring(record, 22)"))
    return records.withColumn("record", F.when(part & (kind == "flip"), flipped).when(part & (kind == "cut"), F.expr("substring(record, 1, length(record) - 3)")).otherwise(F.col("record")))
