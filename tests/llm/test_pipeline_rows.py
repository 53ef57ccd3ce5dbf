"""The pipeline's stages on several null and repeated ids, where the id doesn't tell rows apart."""

from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from tests.llm.test_mixing import reshare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(name, n=40, changed=None):
    return " ".join("changed" if i == changed else f"{name}{i}" for i in range(n))


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b, c, d, e, f = (text(x) for x in "abcdef")
    near = {x: text(x, changed=39) for x in "abcf"}
    rows = [
        (1, a), (None, near["a"]), (None, a), (None, a),  # one with an id, others without
        (None, b), (None, b), (None, near["b"]),  # none with an id
        (None, c), (9, near["c"]), (2, c),
        (None, d),  # alone
        (3, f), (9, near["f"]), (9, e), (9, e),  # a repeated id, of two components
        (4, f + " and more"), (None, None), (5, None), (6, " ")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], SCHEMA)
    for df in (docs, docs.repartition(3)):
        kept = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicate_stage(spark, df, "").collect()]
        of_b = [r for r in kept if r in [(None, b), (None, near["b"])]]
        assert len(of_b) == 1
        assert Counter(r for r in kept if r not in of_b) == Counter([(1, a), (2, c), (None, d), (3, f), (9, e), (None, None), (5, None), (6, " ")])


def test_rows_differing_in_source_only(spark):
    docs = spark.createDataFrame([(1, text("a"), "en", s, 1) for s in ("s", None, "t", "s")], SCHEMA)
    assert pipeline.near_duplicate_stage(spark, docs, "").count() == 1


def test_mix_of_null_and_repeated_ids(spark):
    rows = [(None, text(f"n{i}x", 10 + i % 20), "en", "abc"[i % 3], i) for i in range(150)]
    rows += [(7, text(f"r{i}x", 10 + i % 20), "en", "abc"[i % 3], i) for i in range(60)]
    rows += [(8, text("same", 20), "en", "a", 1)] * 9 + [(None, text("same", 20), None, "b", 1)] * 9
    docs = spark.createDataFrame(rows, SCHEMA)
    after = Counter(tuple(r) for r in pipeline.mixing_stage(spark, docs, "").collect())
    there, sizes, taken = Counter(rows), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    for r, n in after.items():
        assert n <= 2 * there[r]
        taken[r[3]] += n * len(r[1].split())
    targets = reshare(sizes, dict(zip("abc", (5, 2, 1), strict=True)), 1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - targets[s]) <= 30 for s in "abc")
