"""Every stage of the pipeline against a plain Python version, on its own input."""

import random
from collections import Counter, defaultdict

import pyspark.sql.functions as F
import pytest

import corpus_pipeline as pipeline
from tests.llm.test_jaccard import brute as brute_join
from tests.llm.test_mixing import reshare
from tests.llm.test_small import brute_hits, features
from weftql.llm.mixing import mix_sources

ITEMS = [(1, " ".join(f"q{i}" for i in range(14))), (2, "short item")]


def documents():
    rng, rows = random.Random(11), []
    for i in range(240):
        words = [f"{rng.choice('abcdef')}{rng.randrange(400)}" for _ in range(rng.choice([5, 30, 60, 90]))]
        rows.append([i, " ".join(words), rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None])])
    for i in range(240, 330):
        words = rows[rng.randrange(240)][1].split()
        for _ in range(rng.choice([0, 1, 1, 8])):
            words[rng.randrange(len(words))] = "changed"
        rows.append([i, " ".join(words), "en", "s1"])
    for i in range(330, 345):
        rows.append([i, f"{rows[i % 7][1]} and {ITEMS[i % 2][1].upper()} it ends {' '.join(f'z{i}x{k}' for k in range(30))}", "en", "s2"])
    rows += [[345, "the same eight words come again and again " * 20, "en", "s1"], [346, None, "en", "s1"], [None, " ".join(f"n{k}" for k in range(40)), "en", "s3"], rows[3], rows[3]]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def rows_of(df):
    return [tuple(r) for r in df.select(*pipeline.COLUMNS).collect()]


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    before = rows_of(docs)

    kept = stages["quality"](spark, docs, folder)
    assert kept.columns == docs.columns
    after = rows_of(kept)
    passes = lambda n, repeats: n >= 20 and 100 * repeats <= 30 * n
    assert Counter(after) == Counter(r for r in before if passes(features(r[1])[0], features(r[1])[4]))

    before, kept = after, spark.createDataFrame(after, docs.schema)
    unique = stages["near_duplicates"](spark, kept, folder)
    after = rows_of(unique)
    answers = brute_join([r[:2] for r in before], k=5, percent=80)
    stay = {doc for doc, n, component, _ in answers if doc == component or n == 0}
    assert Counter(after) == Counter(dict.fromkeys([r for r in before if r[0] in stay], 1)) and len(after) < len(before)

    before, unique = after, spark.createDataFrame(after, docs.schema)
    clean = stages["decontaminate"](spark, unique, folder)
    after = rows_of(clean)
    hit = {doc for doc, _, n, _ in brute_hits([r[:2] for r in before], ITEMS) if n}
    assert Counter(after) == Counter(r for r in before if r[0] not in hit) and hit

    before, clean = after, spark.createDataFrame(after, docs.schema)
    mixed = stages["mix"](spark, clean, folder)
    after = rows_of(mixed)
    assert mixed.columns == docs.columns
    copies, sizes, taken = Counter(after), defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r[3]] += len(r[1].split())
        taken[r[3]] += len(r[1].split()) * copies[r]
    assert set(after) <= set(before) and max(copies.values()) <= 2
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    targets = reshare(sizes, {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - targets[s]) <= 90 for s in sizes)

    mixed = spark.createDataFrame(after, docs.schema)
    dealt = stages["shard"](spark, mixed, folder)
    assert Counter(rows_of(dealt)) == Counter(after)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for _, rs in grouped(dealt.collect()))


def grouped(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["shard"]].append(r)
    return out.items()


def test_run_and_odd_tables(spark, folder, odd, empty):
    assert pipeline.run(spark, folder).count() > 200
    for docs in (odd, empty):
        for name, stage in pipeline.STAGES:
            columns, docs = docs.columns, stage(spark, docs, folder)
            assert name == "shard" or docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.where(F.col("shard").isNull()).count() == 0


def test_mix_stands_in_training_order(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(3 + i % 9)), "en", "ab"[i % 2], i) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stood = [r["doc_id"] for r in pipeline.mixing_stage(spark, docs, "").collect()]
    due = sorted((t, r["doc_id"]) for r in mix_sources(docs.withColumn("__row", pipeline.row_key()), whole=True, keep=("__row",)).collect() for t in (r["position"], r["again"]) if t is not None)
    assert stood == [doc for _, doc in due]
