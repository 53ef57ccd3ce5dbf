"""Prefix sums over equal rows, shards and the mix against SQL with repeated and null ids, and toxicity by hand."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftql.llm import common, decontaminate, fixity, mixing, sharding, toxicity
from weftql.llm.common import key_hash, prefix_sums, shared_dir
from weftql.llm.textscan import shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def many_nulls(n=900):
    """Half of the rows without an id, a third of all rows equal."""
    rng, rows = random.Random(12), []
    for i in range(n):
        words = " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(0, 9)))
        rows.append((None, "the same row", "en", "a", 0) if i % 3 == 0 else (None if i % 4 == 1 else i // 2, words, "en", rng.choice(["a", "b", None]), i))
    return rows


@pytest.mark.parametrize("wide", [False, True])
def test_prefix_sums(spark, monkeypatch, wide):
    monkeypatch.setattr(common, "COPIES", 7)
    rng = random.Random(1)
    rows = [(rng.choice("xy"), rng.randrange(5), rng.randrange(4)) for _ in range(3000)] + [("x", 2, 3)] * 500
    df = spark.createDataFrame(rows, "g string, k int, v int").withColumn("h", key_hash("k"))
    got = prefix_sums(df.withColumn("one", F.lit(1)), "g", "h", {"before": "v", "place": "one"}, ["v"], wide=wide)
    by_group = defaultdict(list)
    for r in got.collect():
        by_group[r["g"]].append((r["place"], r["before"], r["h"], r["v"]))
    assert Counter((r[0], r[1], r[2]) for r in rows) == Counter((r["g"], r["k"], r["v"]) for r in got.collect())
    for placed in by_group.values():
        placed.sort()
        assert [p for p, *_ in placed] == list(range(len(placed)))
        assert [(h, v) for _, _, h, v in placed] == sorted((h, v) for _, _, h, v in placed)
        total = 0
        for _, before, _, v in placed:
            assert before == total
            total += v


def test_equal_rows_are_one_to_sort(spark):
    """However many rows are equal, and however many ids null, no bucket of a window has many."""
    df = spark.createDataFrame([(None, i % 50) for i in range(3000)] + [(i, 1) for i in range(3000)], "id long, size int").withColumn("g", F.lit("g")).withColumn("h", key_hash("id", "size"))
    buckets = df.distinct().groupBy("h").count().agg(F.max("count")).collect()[0][0]
    assert buckets == 1
    assert prefix_sums(df, "g", "h", {"s": "size"}, ["id", "size"]).count() == 6000


def compared(duck_rows, spark_rows, digits=9):
    plain = lambda rows: Counter(tuple(f"{v:.{digits}g}" if isinstance(v, float) else v for v in r) for r in rows)
    return plain(duck_rows), plain(spark_rows)


def test_shards_against_sql(spark, tmp_path):
    for name, rows in (("nulls", many_nulls()), ("texts", [(i, "é" * (i % 5) + f"text {i}", "en", "a", 1) for i in range(300)] + [(7, None, None, None, None)])):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
        columns = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
        want = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({sharding.sharding_oracle(f"'{path}/*.parquet'")})").fetchall()
        got = [tuple(r) for r in sharding.shard_documents(spark.read.parquet(path), 16).select(*columns).collect()]
        assert Counter(got) == Counter(want)
        for i, t, *_ in rows[:50]:
            assert any(r[0] == i and r[2] == zlib.crc32((t or "").encode()) for r in got)


def test_jump_in_whole_numbers():
    """The published algorithm with Python's integers, key by key."""

    def jumped(key, buckets):
        b, j = -1, 0
        while j < buckets:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b

    rng = random.Random(2)
    keys = [0, 1, (1 << 64) - 1, *(rng.randrange(1 << 64) for _ in range(500))]
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump(np.array(keys, np.uint64), n).tolist() == [jumped(k, n) for k in keys]


def test_mix_against_sql_with_null_ids(spark, tmp_path):
    path = f"{tmp_path}/docs"
    spark.createDataFrame(many_nulls(), SCHEMA).coalesce(1).write.parquet(path)
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "copies"]
    want = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({mixing.mixing_oracle(f"'{path}/*.parquet'")})").fetchall()
    got = [tuple(r) for r in mixing.mix_sources(spark.read.parquet(path)).select(*columns).collect()]
    want, got = compared(want, got)
    assert got == want


def test_archive_of_repeated_pages(spark):
    pages = [(None, "u", "<p>same</p>")] * 40 + [(i, f"u{i}", "x" * i) for i in range(60)] + [(None, None, None)]
    rows = fixity.warc_records(spark.createDataFrame(pages, "page_id long, url string, html string"), file_bytes=2000).collect()
    files = defaultdict(list)
    for r in rows:
        files[r["file"]].append((r["slot"], r["offset"], len(r["record"])))
    assert len(rows) == len(pages) and len(files) > 2
    for records in files.values():
        records.sort()
        assert [s for s, *_ in records] == list(range(len(records)))
        assert [o for _, o, _ in records] == [sum(n for *_, n in records[:i]) for i in range(len(records))]


def test_several_passes_over_the_documents(spark, monkeypatch):
    from tests.llm.test_small import brute_hits

    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 12)
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(9)}" for _ in range(n))
    items = [(i, text(rng.choice([3, 10, 14]))) for i in range(12)]
    rows = [(i, text(40) + " " + items[i % 12][1] + text(3)) for i in range(60)] + [(None, None)]
    for slices in (1, 2, 50):
        monkeypatch.setattr(decontaminate, "PASS_SLICES", slices)
        found = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert found.columns == ["doc_id", "n_words", "n_hit", "item_ids", "spans", "contaminated"]
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in found.collect()) == brute_hits(rows, items)


def test_shared_folder_must_be_named_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            applicationId, master = "app-of-a-cluster", "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def all_maximal(scores, base=0):
    """Ruzzo and Tompa's definition: the best segment, then the same of what is left and right of it."""
    best = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, a, b = best
    return [*all_maximal(scores[:a], base), (base + a, base + b), *all_maximal(scores[b:], base + b)]


def test_all_maximal_segments():
    rng = np.random.default_rng(4)
    for _ in range(150):
        scores = np.where(rng.random(25) < 0.35, rng.random(25) * 1.5, toxicity.DRIFT)
        assert [(b, e) for b, e, _ in toxicity.segments(scores)] == all_maximal(scores.tolist())


def exact_tail(k, n, p):
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))


def weight_of(t, c, n_toxic, n_clean, tests):
    """A token's log-odds, by the formula: None if it isn't known."""
    if t < 3:
        return None
    if exact_tail(t, t + c, n_toxic / (n_toxic + n_clean)) > toxicity.RISK / tests or t <= (t + c) * n_toxic / (n_toxic + n_clean):
        return 0.0 if c >= 3 else None
    prior = toxicity.PRIOR_DOCS * (t + c) / (n_toxic + n_clean)
    odds = lambda x, n: (x + prior) / max(n + toxicity.PRIOR_DOCS - x - prior, 0.5)
    delta, error = math.log(odds(t, n_toxic) / odds(c, n_clean)), math.sqrt(1 / (t + prior) + 1 / (c + prior))
    return delta - toxicity.PRUDENCE * error if delta > toxicity.PRUDENCE * error else None


def hash3(text):
    return next(shingle_sets([text.encode()])).tolist()


def test_learning_and_scores_by_hand(spark):
    rng = random.Random(17)
    common_words, bad = [f"{a}{b}{c}" for a in "bcdfgh" for b in ("ala", "ero", "inu", "ost") for c in "stuvw"], ["vilest", "nastyish", "scabby", "grubbed"]
    rows = []
    for i in range(900):
        words = [rng.choice(common_words) for _ in range(rng.randrange(12, 40))]
        if i % 6 == 0:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"))

    # documents that share a signature count once: the least id of each, if it is that by both signatures
    signs = [(i, t, y, min(hash3(t)), " ".join(t.split()[:8])) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    least, first = {}, {}
    for i, _, _, a, b in signs:
        least[a], first[b] = min(i, least.get(a, i)), min(i, first.get(b, i))
    known = [(t, y) for i, t, y, a, b in signs if least[a] == i and first[b] == i]
    counts = {y: Counter(t for text, label in known if label == y for t in {t for w in set(text.encode().split()) for t in toxicity.tokens_of(w)}) for y in (0, 1)}
    n_clean, n_toxic = sum(y == 0 for _, y in known), sum(y for _, y in known)
    tests = sum(n >= 3 for n in counts[1].values())
    weights = {t: weight_of(n, counts[0][t], n_toxic, n_clean, tests) for t, n in counts[1].items()}
    positive = {t: w for t, w in weights.items() if w}
    found = {t: w for t, w in model.weights.items() if w > 0}
    assert set(found) == set(positive) and all(math.isclose(found[t], positive[t], rel_tol=1e-9) for t in found)
    silent = {t for t, w in weights.items() if w == 0} | {t for t, c in counts[0].items() if c >= 3 and not positive.get(t)}

    def score(text):
        words = text.encode().split()
        each = []
        for w in words:
            token = next((t for t in toxicity.tokens_of(w) if t in positive or t in silent), None)
            each.append(positive.get(token, 0.0) or toxicity.DRIFT)
        strength = 0.0
        for b, e in all_maximal(each):
            s = sum(each[b:e])
            if 1 - math.exp(-model.k * len(words) * math.exp(-model.lam * s)) <= toxicity.MAX_P:
                strength += max(0.0, model.lam * s - math.log(max(model.k * len(words), 1.0)))
        return 1 / (1 + math.exp(-(model.slope * strength + model.offset)))

    texts = {i: t for i, t, _ in rows}
    out = toxicity.score_toxicity(docs, model).collect()
    assert all(math.isclose(r["score"], score(texts[r["doc_id"]]), rel_tol=1e-6) for r in out)
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in out) > 880
