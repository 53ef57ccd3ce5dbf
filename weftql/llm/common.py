"""What several operators share: shared-folder tables, word patterns, and prefix sums that never order a group in one task."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space, as a regular-expression class, separates words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on one machine, where that is unset, one temporary folder for the application."""
    found, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not found and app not in _own_dirs:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="weftql-")
    return found.rstrip("/") if found else _own_dirs[app]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_hash(*cols: Column | str, seed: str = "") -> Column:
    """60 bits of an MD5 of the columns' text, as a long: the same in every run, session and engine."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bucket_bits(rows: int, per_bucket: int = 1000) -> int:
    """Bits of a 60-bit hash that cut rows evenly into buckets of about per_bucket."""
    return max(0, min(36, math.ceil(math.log2(max(1, rows) / per_bucket)) if rows > per_bucket else 0))


#: Copies of a row that are made at once.
COPIES = 1024


def prefix_sums(df: DataFrame, group: str, hashed: str, sums: dict[str, str], order: list[str], *, wide: bool = False) -> DataFrame:
    """Add columns {out: value}: the sum of value over the rows of the same group that come before, by (hashed, *order).

    No group is ever ordered in one task. Rows are cut into buckets by the leading bits of the 60-bit hash; the sums of
    buckets, and of runs of 1,024 buckets, are ordered instead, and only the rows of one bucket are ordered among
    themselves. Equal rows are counted before that, one row for all of them, and made rows again afterwards, so however many
    there are, they are one row to sort. Rows that are equal in hashed only do meet: hash what tells rows apart. group must
    not be null. wide: the rows carry texts; they are left as they are and equal ones not counted.
    """
    rows = df.withColumn("__n", F.lit(1).cast("long")) if wide else materialize(df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("__n")), "sums")
    bits, outs = bucket_bits(rows.count()), list(sums)
    value = {out: F.col(v) * F.col("__n") for out, v in sums.items()}
    fine = rows.withColumn("__b", F.shiftright(F.col(hashed), 60 - bits).cast("long"))
    totals = fine.groupBy(group, "__b").agg(*[F.sum(value[o]).alias(f"__s_{o}") for o in outs]).withColumn("__c", F.shiftright("__b", 10))
    before = lambda o, w: F.coalesce(F.sum(f"__s_{o}").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs, within = Window.partitionBy(group).orderBy("__c"), Window.partitionBy(group, "__c").orderBy("__b")
    coarse = totals.groupBy(group, "__c").agg(*[F.sum(f"__s_{o}").alias(f"__s_{o}") for o in outs]).select(group, "__c", *[before(o, runs).alias(f"__r_{o}") for o in outs])
    offsets = totals.select("*", *[before(o, within).alias(f"__w_{o}") for o in outs]).join(coarse, [group, "__c"]).select(group, "__b", *[(F.col(f"__w_{o}") + F.col(f"__r_{o}")).alias(f"__o_{o}") for o in outs])
    inside = Window.partitionBy(group, "__b").orderBy(hashed, *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = fine.join(offsets, [group, "__b"]).withColumns({f"__p_{o}": (F.coalesce(F.sum(value[o]).over(inside), F.lit(0)) + F.col(f"__o_{o}")).cast("long") for o in outs})
    copy = F.lit(0).cast("long")
    if not wide:
        placed = placed.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / COPIES))))
        placed = placed.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(COPIES - 1).cast("long"), F.col("__n") - 1 - F.col("__k") * COPIES))))
        copy = F.col("__k") * COPIES + F.col("__i")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"__p_{o}") + copy * F.col(sums[o])).cast("long").alias(o) for o in outs])
