"""Quality rules whose cutoffs are chosen under a risk bound.

Every rule rejects documents whose metric is above a cutoff. Candidate cutoffs are a fixed grid. A stratum (language)
may use a cutoff only if its labelled good documents prove that it rejects few of the good documents there. alpha, the share
that all rules together may reject, is divided among them. With k of n good documents rejected, the exact binomial tail
P[Bin(n, alpha / rules) <= k] must be at most delta divided by strata x rules (Bonferroni). A rule's cutoffs are nested and
tested from the highest down until one fails, a fixed sequence, which needs no further correction; the last one proved is
used, without one the rule rejects nothing in that stratum. With probability 1 - delta the rules together reject no more than
alpha of any stratum's good documents. At the defaults and with four strata that takes 597 labelled good documents of a
stratum at least; a stratum with fewer has the base rule only.

Only DataFrame operations run here; Python gets no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftql.llm.common import WORD, materialize

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Rule: (metric over the counts, as SQL, grid of cutoffs).
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3]),
    "shouting": ("n_upper / greatest(word_chars, 1)", [0.15, 0.25, 0.4, 0.6]),
    "exclaiming": ("n_bangs / greatest(n_words, 1)", [0.05, 0.1, 0.2, 0.4, 0.8]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.05, 0.1, 0.15, 0.2, 0.25]),
    "duplicate_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.1, 0.2, 0.3, 0.5]),
}
BROADCAST_STRATA = 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs")


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use mentions it."""
    return F.transform(F.array(value), use)[0]


def window_hashes(words: Column) -> Column:
    """Hashes of all windows of WINDOW (a power of two) words of an array of more: hashes of words, of pairs, of pairs of pairs ..."""

    def paired(h: Column, apart: int) -> Column:
        return F.zip_with(h, F.slice(h, apart + 1, F.size(h) - apart), lambda a, b: F.xxhash64(a, b))

    def doubled(h: Column, apart: int) -> Column:
        # zip_with fills the shorter array with nulls, so the last entries stand for no window
        return bound(paired(h, apart), lambda x: doubled(x, 2 * apart)) if 2 * apart < WINDOW else F.slice(paired(h, apart), 1, F.size(h) - (WINDOW - 1))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1))


def repeat_words(words: Column) -> Column:
    """Words inside windows that occur twice or more, windows being told apart by 64-bit hashes. Only where two are equal are
    hashes sorted; neighbours that agree mark their positions."""

    def covered(p: Column) -> Column:
        gaps = F.aggregate(F.sequence(F.lit(2), F.size(p)), F.lit(0), lambda s, k: s + F.least(F.lit(WINDOW), F.element_at(p, k) - F.element_at(p, k - 1)))
        return gaps + WINDOW

    def marked(s: Column) -> Column:
        same = lambda a, b: F.element_at(s, a)["h"] == F.element_at(s, b)["h"]
        alike = F.filter(s, lambda x, k: F.when(k > 0, same(k + 1, k)).otherwise(False) | F.when(k + 2 <= F.size(s), same(k + 1, F.least(k + 2, F.size(s)))).otherwise(False))
        return F.sort_array(F.transform(alike, lambda x: x["i"]))

    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bound(bound(placed(h), marked), covered))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(bound(window_hashes(words), count)).cast("long")


def count_features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """keep and COUNTS for every row of docs(text, ...). Null text counts as empty. Line: a part between newlines that has a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = lambda chars: F.regexp_count(F.col("__marks"), F.lit(f"[{chars}]")).cast("long")
    words, lines = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    found = docs.select(
        *keep,
        F.regexp_replace(text, f"[^A-Z!{SYMBOLS}]+", "").alias("__marks"),
        bound(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("all"))).alias("__l"),
        bound(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), repeat_words(w).alias("repeat"))).alias("__w"),
    )
    marks = [counted(SYMBOLS).alias("n_symbols"), counted("A-Z").alias("n_upper"), counted("!").alias("n_bangs")]
    found = found.select(*keep, "__l", "__w", *marks)
    return found.select(*keep, F.col("__w.n").alias("n_words"), F.col("__w.chars").alias("word_chars"), "n_symbols", F.col("__l.dup").alias("n_dup_lines"), F.col("__w.repeat").alias("n_repeat_words"), F.col("__l.all").alias("n_lines"), "n_upper", "n_bangs")


BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def binomial_tail(n: Column, k: Column, alpha: float) -> Column:
    """P[Bin(n, alpha) <= k], exact up to rounding, summed in logarithms; 1 where k is over n alpha, which proves nothing."""
    start = n * math.log1p(-alpha)
    step = lambda acc, j: bound(
        acc["t"] + F.log((n - j + 1) / j) + math.log(alpha / (1 - alpha)),
        lambda t: F.struct(t.alias("t"), (F.greatest(t, acc["s"]) + F.log1p(F.exp(-F.abs(t - acc["s"])))).alias("s")),
    )
    tail = F.aggregate(F.sequence(F.lit(1), k), F.struct(start.alias("t"), start.alias("s")), step, lambda acc: F.exp(acc["s"]))
    return F.when((n == 0) | (k > n * alpha), 1.0).when(k == 0, F.exp(start)).otherwise(tail)


def proved_cutoffs(counted: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """lang, rule, cutoff: the lowest cutoff of each rule that the labelled good documents of the stratum prove. Tails grow as
    cutoffs fall, so the lowest proved is the last one before the first that fails.

    Good: some label says quality 1 and none says otherwise. Documents that the base rule rejects prove nothing.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("worst"), F.max("quality").alias("best")).where("worst = 1 AND best = 1").select("doc_id")
    tests = [(rule, c) for rule, (_, grid) in RULES.items() for c in grid]
    known = counted.where(f"NOT ({BASE_FAILED})").join(good, "doc_id", "left_semi")
    by_stratum = known.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(F.expr(f"CAST({RULES[r][0]} > {c}D AS BIGINT)")).alias(f"t{i}") for i, (r, c) in enumerate(tests)])
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"t{i}").alias("k")) for i, (r, c) in enumerate(tests)])).alias("x")
    each = by_stratum.select("lang", "n", F.count("*").over(_everything()).alias("strata"), rows).select("lang", "n", "strata", "x.*")
    proved = each.where(binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES)) <= F.lit(delta) / (F.col("strata") * len(RULES)))
    return proved.groupBy("lang", "rule").agg(F.min("cutoff").alias("cutoff"))


def _everything():
    from pyspark.sql.window import Window

    return Window.partitionBy()


def judge_quality(docs: DataFrame, labels: DataFrame, *, alpha: float = 0.05, delta: float = 0.05, keep: tuple[str, ...] = ("doc_id", "lang"), recount: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text, lang): keep, COUNTS, base_failed, kept.

    recount: counts are made once for the cutoffs and again for the verdicts, rather than written in between; for rows that carry
    their texts, which then are neither written nor exchanged.

    A null language is a stratum of its own; so is one without labels, where only the base rule rejects. A null doc_id has no
    label. Repeated rows each get a verdict. An empty table gives no rows. Other columns of docs are not looked at.
    """
    counted = count_features(docs, keep) if recount else materialize(count_features(docs, keep), "quality-counts")
    cutoffs = proved_cutoffs(count_features(docs) if recount else counted, labels, alpha, delta).groupBy("lang").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    cutoffs = materialize(cutoffs.select(F.col("lang").alias("__lang"), *[F.col(r).alias(f"__{r}") for r in RULES]), "quality-cutoffs")
    if cutoffs.count() <= BROADCAST_STRATA:  # a row each; beyond that both sides are shuffled
        cutoffs = F.broadcast(cutoffs)
    over = [F.coalesce(F.expr(metric) > F.col(f"__{rule}"), F.lit(False)) for rule, (metric, _) in RULES.items()]
    failed, rejected = F.expr(BASE_FAILED), over[0]
    for x in over[1:]:
        rejected = rejected | x
    judged = counted.join(cutoffs, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    return judged.select(*keep, *COUNTS, failed.alias("base_failed"), (~failed & ~rejected).alias("kept"))


def quality_oracle(documents: str = "documents", labels: str = "labels", alpha: float = 0.05, delta: float = 0.05) -> str:
    alpha /= len(RULES)
    tests = ", ".join(f"('{r}', {c})" for r, (_, grid) in RULES.items() for c in grid)
    metric = "CASE rule " + " ".join(f"WHEN '{r}' THEN {m}" for r, (m, _) in RULES.items()) + " END"
    return f"""
WITH worded AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM {documents}
), windows AS (
  SELECT rid, i, list_slice(words, i, i + {WINDOW - 1}) AS w FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM worded)
), marked AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows),
covered AS (
  SELECT rid, sum(least({WINDOW}, coalesce(next - i, {WINDOW}))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS next FROM marked WHERE n > 1) GROUP BY rid
), counted AS (
  SELECT doc_id, lang, len(words) AS n_words, length(translate(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')) AS word_chars,
         length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
         length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper, length(text) - length(replace(text, '!', '')) AS n_bangs
  FROM worded LEFT JOIN covered c USING (rid)
), good AS (SELECT doc_id FROM {labels} WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1),
known AS (SELECT * FROM counted WHERE NOT ({BASE_FAILED}) AND doc_id IN (FROM good)),
tests(rule, cutoff) AS (VALUES {tests}),
tested AS (
  SELECT lang, rule, cutoff, count(*) AS n, CAST(sum(CAST({metric} > cutoff AS INT)) AS BIGINT) AS k FROM known, tests GROUP BY ALL
), tails AS (
  SELECT lang, rule, cutoff, sum(exp(lgamma(n + 1) - (CASE WHEN j = 0 THEN 0 ELSE lgamma(j + 1) END) - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln(1 - {alpha}))) AS tail
  FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM tested WHERE k <= n * {alpha}) GROUP BY ALL
), proved AS (
  SELECT lang, rule, min(cutoff) AS cutoff FROM tails
  WHERE tail <= {delta} / ((SELECT count(DISTINCT coalesce('=' || lang, '')) FROM known) * {len(RULES)}) GROUP BY ALL
), rejected AS (
  SELECT DISTINCT d.lang, d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, d.n_lines, d.n_upper, d.n_bangs, 1 AS hit
  FROM counted d JOIN proved p ON d.lang IS NOT DISTINCT FROM p.lang WHERE {metric} > p.cutoff
)
SELECT d.doc_id, {", ".join(f"CAST(d.{c} AS BIGINT) AS {c}" for c in COUNTS)}, ({BASE_FAILED.replace("n_", "d.n_")}) AS base_failed,
       NOT ({BASE_FAILED.replace("n_", "d.n_")}) AND r.hit IS NULL AS kept
FROM counted d LEFT JOIN rejected r ON d.lang IS NOT DISTINCT FROM r.lang AND {" AND ".join(f"d.{c} = r.{c}" for c in COUNTS)}
"""
