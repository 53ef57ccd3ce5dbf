"""A corpus pipeline over the training-data operators: five stages, each written and read again as the next one's documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. They work
on whatever the stage before kept. Stages decide by the row, not by the id: ids may be null or repeated. Rows that are equal
in COLUMNS are copies of one another; columns beyond these come along, of copies those of any. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftql.llm import decontaminate, jaccard, mixing, quality, sharding
from weftql.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Stands for a null id in joins. A document with this very id would be taken for one without; its row key still tells them apart.
NO_ID = -(1 << 63)


def row_key() -> Column:
    """Tells rows apart, together with the id."""
    return F.xxhash64(*(x for c in COLUMNS for x in (c, F.col(c).isNull())))


def marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__id", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("__row", row_key())


def one_of_each(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """A row of docs for each of keys(__id, __row, __rows, ...), with what else is in keys. __rows: equal rows chosen; only these need to meet."""
    keyed = marked(docs).join(keys, ["__id", "__row"])
    return keyed.where("__rows = 1").unionByName(keyed.where("__rows > 1").dropDuplicates(["__id", "__row"]))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: a row is judged by its own text and language (null: a language of its own).

    Null and empty texts have no words and go. Copies of a row share its fate. A null or unlabelled id proves nothing.
    """
    others = {c: f"__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang")}
    renamed = docs.withColumnsRenamed(others)
    judged = quality.judge_quality(renamed, table(spark, sf_dir, "labels"), keep=tuple(renamed.columns), recount=True)
    return judged.where("kept").select(*renamed.columns).withColumnsRenamed({v: k for k, v in others.items()})


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, 0.8) one row stays: the least id, null last, then the least set and row.

    Documents without words (null, empty, blank) link to nothing and stay, repeated rows of them once. Rows without an id form
    components like others and leave one row, too.
    """
    joined = jaccard.jaccard_join(docs, k=5, percent=80, row=row_key()).where("stays")
    keys = joined.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.col("row").alias("__row")).agg(F.count("*").alias("__rows"))
    return one_of_each(docs, materialize(keys, "pipeline-rows")).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark passage occurs go, row by row. Null and empty texts hold none and stay."""
    others = {c: f"__{i}" for i, c in enumerate(docs.columns) if c != "text"}
    renamed = docs.withColumnsRenamed(others)
    hits = decontaminate.decontaminate(renamed, table(spark, sf_dir, "benchmark"), keep=tuple(renamed.columns))
    return hits.where("NOT contaminated").select(*renamed.columns).withColumnsRenamed({v: k for k, v in others.items()})


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a row is there once for each copy that the mix takes of it, and rows stand in training order.

    Copies are whole, so a source misses its target by half a document at most; equal rows are each counted. A null source is
    one, the last. Rows without words are not taken. Ties in training time stand in any order.
    """
    mixed = mixing.mix_sources(docs.withColumn("__row", row_key()), whole=True, keep=("__row",)).where("copies > 0")
    mixed = materialize(mixed.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), "__row", F.array_compact(F.array("position", "again")).alias("__dues")), "pipeline-mix")
    keys = mixed.groupBy("__id", "__row").agg(F.count("*").alias("__rows"), F.first("__dues").alias("__dues"))
    rows = one_of_each(docs, materialize(keys, "pipeline-rows"))
    single = rows.where("__rows = 1").withColumn("__due", F.explode("__dues"))
    several = rows.where("__rows > 1").drop("__dues").join(mixed, ["__id", "__row"]).withColumn("__due", F.explode("__dues"))
    return single.unionByName(several).orderBy("__due").select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard by its id (null is one) and its slot there; copies get neighbouring slots. Null text has size 1."""
    return sharding.shard_documents(docs, 16, keep=tuple(c for c in COLUMNS if c != "doc_id"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("mix", mixing_stage),
    ("shard", sharding_stage),
]

#: The near-duplicate stage's components aren't expressible as one SQL query at these sizes; tests compare every stage with Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
