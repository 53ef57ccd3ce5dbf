"""Mixing sources to target weights by a curriculum whose weights vary over training time.

Each source has a schedule: weight as a piecewise linear function of training time in [0, 1]. Its integral is the
source's share of the words that the mix takes; a target stops at max_epochs times the source's words, and what is cut
off goes to the other sources by weight. A source's words are laid end to end in a hash order; the word at cumulative
position x of a target T is due at the time t at which the integral of the schedule reaches the share x / T of the whole.
Documents are sorted by that time, over ranges.

Only DataFrame operations run here. The sources themselves (a row each) are ordered in one task; documents are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftql.llm.common import key_hash, materialize, prefix_sums, words_count

#: A schedule: (time, weight) knots from time 0 to time 1. These three integrate to 5, 2 and 1.
Schedule = list[tuple[float, float]]
SCHEDULES: list[Schedule] = [
    [(0.0, 7.0), (0.5, 5.0), (1.0, 3.0)],
    [(0.0, 2.0), (1.0, 2.0)],
    [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)],
]


def integral(schedule: Schedule) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))


def inverse_sql(schedule: Schedule, share: str) -> str:
    """SQL for the time at which the schedule's integral reaches the given share of the whole.

    Within a segment of slope a that starts with weight w and integral c: y = x - c = w s + a s^2 / 2, whose root
    is s = 2 y / (w + sqrt(w^2 + 2 a y)), which also holds for a = 0.
    """
    x, c, cases = f"({share}) * CAST({integral(schedule)!r} AS DOUBLE)", 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        a, y = (w1 - w0) / (t1 - t0), f"greatest({x} - CAST({c!r} AS DOUBLE), CAST(0 AS DOUBLE))"
        root = f"CAST({t0!r} AS DOUBLE) + 2 * {y} / (CAST({w0!r} AS DOUBLE) + sqrt(greatest(CAST({w0 * w0!r} AS DOUBLE) + CAST({2 * a!r} AS DOUBLE) * {y}, CAST(0 AS DOUBLE))))"
        c += (t1 - t0) * (w0 + w1) / 2
        cases.append((c, root))
    early = " ".join(f"WHEN {x} < CAST({c!r} AS DOUBLE) THEN {r}" for c, r in cases[:-1])
    return f"CASE {early} ELSE {cases[-1][1]} END" if early else cases[-1][1]


def time_sql(schedules: list[Schedule], share: str) -> str:
    """inverse_sql for the schedule whose number is in the column schedule."""
    return "CASE schedule " + " ".join(f"WHEN {i} THEN {inverse_sql(s, share)}" for i, s in enumerate(schedules)) + " END"


#: Water-filling over sources(source, source_size): sorted by the level at which a source is full, the level that spends
#: what the full ones before leave. The first source, in this order, that isn't full at its level gives the level.
LEVELS_SQL = """
WITH ranked AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY CASE WHEN source IS NULL THEN 1 ELSE 0 END, source) - 1) % {n} AS INT) AS schedule
  FROM {sources}
), weighed AS (
  SELECT source, source_size, schedule, CASE schedule {weights} END AS weight, CAST({epochs} AS DOUBLE) * source_size AS most,
         CAST({share} AS DOUBLE) * sum(source_size) OVER () AS demand
  FROM ranked
), filled AS (
  SELECT *, (demand - coalesce(sum(most) OVER (ORDER BY most / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY most / weight, weight, source NULLS LAST) AS place
  FROM weighed
), settled AS (
  SELECT *, (SELECT min_by(level, place) FROM filled WHERE level * weight <= most * (1 + 1e-12)) AS settled_level FROM filled
)
SELECT source, CAST(source_size AS BIGINT) AS source_size, schedule, least(most, coalesce(settled_level * weight, most)) AS target FROM settled
"""


def levels_sql(sources: str, schedules: list[Schedule], share: float, epochs: float) -> str:
    weights = " ".join(f"WHEN {i} THEN CAST({integral(s)!r} AS DOUBLE)" for i, s in enumerate(schedules))
    return LEVELS_SQL.format(n=len(schedules), sources=sources, weights=weights, share=share, epochs=epochs)


def source_targets(sizes: DataFrame, schedules: list[Schedule], share: float, max_epochs: float) -> DataFrame:
    """source, source_size, schedule, target of each source of sizes(source, size)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sizes.sparkSession.sql(levels_sql("{totals}", schedules, share, max_epochs), totals=totals)


def mix_sources(
    docs: DataFrame,
    *,
    schedules: list[Schedule] | None = None,
    share: float = 1.5,
    max_epochs: int = 2,
    size: Column | None = None,
    seed: str = "mix",
    whole: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs(doc_id, source, text): doc_id, source, size, source_size, target, taken, copies, position, again.

    size counts words unless given as a column; null text: 0. Sources are ordered by code point, null last, and take the
    schedules in turn. share: of all words, to be taken in total. taken: words taken of this row, repeats counted; the words
    of a source add up to its target, rounded. copies: passes that begin in this row. position: training time of the first
    pass's first word, null where nothing is taken; again: of the second pass. whole: a copy is taken whole or not at all,
    by whether its middle is below the target, so a source misses its target by half a document at most.
    Rows are sorted by position, null last, then doc_id. A null doc_id is a value like others, repeated rows each count,
    an empty table gives no rows. max_epochs is 1 or 2. keep: further columns of docs, sortable, that come along and break ties.
    """
    if max_epochs not in (1, 2):
        raise ValueError("max_epochs is 1 or 2")
    schedules = schedules or SCHEDULES
    sized = docs.select("doc_id", "source", (words_count(F.col("text")) if size is None else size.cast("long")).alias("size"), key_hash("doc_id", *keep, seed=seed).alias("h"), *keep)
    sized = materialize(sized.withColumn("grp", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))), "mix-sizes")
    targets = source_targets(sized, schedules, share, max_epochs).withColumn("grp", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).drop("source")
    placed = prefix_sums(sized, "grp", "h", {"start": "size"}, ["doc_id", "size", *keep]).join(targets, "grp")
    goal = F.round("target").cast("long")
    if whole:
        middle = F.col("start") + F.col("size") / 2
        first, second = [F.when((middle + F.col("source_size") * k < goal) & (F.col("size") > 0), F.col("size")).otherwise(0) for k in (0, 1)]
    else:
        first, second = [F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col("start") - F.col("source_size") * k)) for k in (0, 1)]
    placed = placed.select("*", first.cast("long").alias("one"), second.cast("long").alias("two"))
    due = lambda k: F.expr(time_sql(schedules, f"least(CAST(start + {k} * source_size AS DOUBLE) / target, CAST(1 AS DOUBLE))"))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", (F.col("one") + F.col("two")).alias("taken"),
        (F.signum("one") + F.signum("two")).cast("int").alias("copies"), F.when(F.col("one") > 0, due(0)).alias("position"), F.when(F.col("two") > 0, due(1)).alias("again"), *keep,
    ).orderBy(F.asc_nulls_last("position"), "doc_id")


def mixing_oracle(documents: str = "documents", schedules: list[Schedule] = SCHEDULES, share: float = 1.5, epochs: int = 2, seed: str = "mix") -> str:
    """The same rows in DuckDB's SQL, without the order of rows."""
    due = lambda k: time_sql(schedules, f"least(CAST(start + {k} * source_size AS DOUBLE) / target, CAST(1 AS DOUBLE))")
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM {documents}
), totals AS (SELECT source, sum(size) AS source_size FROM sized GROUP BY source),
levels AS ({levels_sql("totals", schedules, share, epochs)}),
placed AS (
  SELECT s.doc_id, s.source, s.size, l.source_size, l.target, l.schedule,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN levels l ON s.source IS NOT DISTINCT FROM l.source
), cut AS (
  SELECT *, greatest(0, least(size, CAST(round(target) AS BIGINT) - start)) AS one, greatest(0, least(size, CAST(round(target) AS BIGINT) - start - source_size)) AS two FROM placed
)
SELECT doc_id, source, size, source_size, target, CAST(one + two AS BIGINT) AS taken, CAST(sign(one) + sign(two) AS INT) AS copies,
       CASE WHEN one > 0 THEN {due(0)} END AS position, CASE WHEN two > 0 THEN {due(1)} END AS again
FROM cut
"""
