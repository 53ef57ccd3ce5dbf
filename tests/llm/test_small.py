"""Token counts, fixity, quality rules, decontamination, shards, toxicity and components on small tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftql.llm import decontaminate, fixity, quality, sharding, tokens, toxicity
from weftql.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.skipif(not os.path.exists(tokens.TOKENIZER), reason="no tokenizer")
def test_token_histogram(odd, empty):
    lengths = [len(tokens.encoding(tokens.TOKENIZER).encode_ordinary(r["text"] or "")) for r in odd.collect()]
    counted = tokens.count_tokens(odd)
    assert Counter(r["n_tokens"] for r in counted.collect()) == Counter(lengths)
    rows = {r["context_limit"]: r for r in tokens.length_histogram(counted).collect()}
    assert set(rows) == set(lengths)
    for limit, r in rows.items():
        assert r["docs_within"] == sum(n <= limit for n in lengths) and r["docs_over"] == len(lengths) - r["docs_within"]
        assert r["kept_tokens"] == sum(min(n, limit) for n in lengths) and r["total_tokens"] == sum(lengths)
        assert math.isclose(r["quantile"], r["docs_within"] / len(lengths))
    for r in tokens.at_limits(tokens.length_histogram(counted), [0, 5, 100, 10**9]).collect():
        assert r["kept_tokens"] == sum(min(n, r["limit"]) for n in lengths)
    assert tokens.length_histogram(tokens.count_tokens(empty)).collect() == []


def replica(spark, records):
    return fixity.digests(spark.createDataFrame(records, "file int, slot long, offset long, record binary"))


def test_audit(spark):
    rng = random.Random(1)
    records, at = [], {}
    for i in range(700):
        f, body = i % 3, rng.randbytes(rng.randrange(1, 40))
        records.append((f, i // 3, at.get(f, 0), body))
        at[f] = at.get(f, 0) + len(body)
    sound = replica(spark, records)
    assert fixity.audit(sound, sound).collect() == []
    bad = list(records)
    bad[5] = (*bad[5][:3], b"changed")
    bad[400] = (*bad[400][:2], 999_999, bad[400][3])
    del bad[699]
    bad.append((2, 5000, 7, b"added"))
    found = {(r["file"], r["slot"], r["fault"]) for r in fixity.audit(sound, replica(spark, bad)).collect()}
    assert found == {(2, 1, "changed"), (1, 133, "moved"), (0, 233, "missing"), (2, 5000, "added")}
    none = replica(spark, [])
    assert fixity.audit(none, none).collect() == []


def test_archive(spark):
    pages = spark.createDataFrame([(i // 2 if i else None, f"u{i}" if i % 3 else None, "x" * (i % 50) if i % 7 else None, 1) for i in range(300)], "page_id long, url string, html string, slot int")
    records = fixity.warc_records(pages, file_bytes=3000).collect()
    files = {r["file"] for r in records}
    assert len(records) == 300 and len(files) > 3
    for f in files:
        own = sorted((r for r in records if r["file"] == f), key=lambda r: r["slot"])
        assert [r["slot"] for r in own] == list(range(len(own)))
        assert [r["offset"] for r in own] == np.cumsum([0, *(len(r["record"]) for r in own)])[:-1].tolist()
    assert fixity.warc_records(pages.limit(0)).collect() == []


def features(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    many, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if many[w] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5)] + [(None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rng = random.Random(6)
    extra = [(100 + i, "\n".join(" ".join(rng.choice(["a", "b", "c#", "d"]) for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 12))), "en") for i in range(60)]
    docs = odd.select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    out = quality.judge_quality(docs, labels).collect()
    want = Counter((r["doc_id"], *features(r["text"])) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out) == want
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"]) for r in out)
    assert quality.judge_quality(empty, labels).collect() == []
    assert quality.judge_quality(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_binomial_tail(spark):
    cases = [(n, k) for n in (1, 50, 400, 3000) for k in (0, 1, 3, 5, 20) if k <= n]
    got = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.01).alias("p")).collect()
    for r in got:
        exact = sum(math.comb(r["n"], j) * 0.01**j * 0.99 ** (r["n"] - j) for j in range(r["k"] + 1))
        assert math.isclose(r["p"], exact if r["k"] <= r["n"] * 0.01 else 1.0, rel_tol=1e-9)


def test_quality_keeps_its_promise(spark):
    """Good documents rarely have symbols, bad ones often: the proved cutoff takes the bad, and few of the good."""
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        good = i % 3 > 0
        share = 0.001 if good else 0.5
        rows.append((i, " ".join(f"w{rng.randrange(10**6)}" + ("#" * 3 if rng.random() < share else "") for _ in range(30)), "en", int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    out = quality.judge_quality(docs, docs.select("doc_id", "quality"), keep=("doc_id", "lang", "quality")).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r["quality"]: r["kept"] for r in out}
    assert kept[1] > 0.98 and kept[0] < 0.01


def clean_words(text):
    return (text or "").encode().translate(decontaminate.LOWER_ALNUM).split()


def brute_hits(rows, items, window=10):
    phrases = {}
    for name, text in items:
        w = clean_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add("null" if name is None else str(name))
    sizes = {len(p) for p in phrases}
    out = Counter()
    for doc, text in rows:
        w, hit, found = clean_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if got := phrases.get(tuple(w[i : i + n])):
                    found |= got
                    hit |= set(range(i, i + n))
        out[doc, len(w), len(hit), tuple(sorted(found))] += 1
    return out


def test_decontamination(spark, odd, empty, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)] + ["é1", "Zz"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([3, 10, 14, 25]))) for i in range(15)] + [(99, None), (None, "w1 w2 w3"), (98, "..."), (3, "w1, W2. w4"), (100, "a b c d e f g h i j")]
    rows = [(i, text(rng.randrange(0, 60)) + ". " + (rng.choice(items)[1] or "").upper() + " " + text(5)) for i in range(150)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for symbols, words in ((1 << 20, 2_000_000), (300, 40)):  # one shard and slice, and many
        monkeypatch.setattr(decontaminate, "SHARD_SYMBOLS", symbols)
        monkeypatch.setattr(decontaminate, "SLICE_WORDS", words)
        hits = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in hits) == brute_hits(rows, items)
        assert all(sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_hit"] and r["contaminated"] == (r["n_hit"] > 0) for r in hits)
    own = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in decontaminate.decontaminate(odd, benchmark).collect()) == brute_hits(own, items)
    assert decontaminate.decontaminate(empty, benchmark).collect() == []
    assert decontaminate.decontaminate(odd, benchmark.limit(0)).where("contaminated").count() == 0


def test_suffix_array_and_index():
    rng = np.random.default_rng(2)
    symbols = np.append(rng.integers(0, 4, 400), 0)
    index = decontaminate.FMIndex(symbols)
    text = symbols.tolist()
    for n in (1, 2, 5):
        phrases = rng.integers(1, 4, (30, n))
        low, high = index.search(phrases, np.full(30, n))
        for p, a, b in zip(phrases.tolist(), low, high, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text)) if text[i : i + n] == p]


def test_shards(spark, odd, empty):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 7).cast("int")).alias("text"), F.lit("x").alias("size"))
    out = sharding.shard_documents(df, 16).collect()
    for s in range(16):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and 150 < len(slots) < 350
    assert all(r["grown_shard"] in (r["shard"], 16) for r in out) and 100 < sum(r["grown_shard"] == 16 for r in out) < 400
    assert all(r["size"] == 2 * (r["doc_id"] % 7) + 1 and r["text_crc32"] == zlib.crc32(("é" * (r["doc_id"] % 7)).encode()) and r["law"] == "key" for r in out)
    assert sorted(map(tuple, out)) == sorted(map(tuple, sharding.shard_documents(df.repartition(9), 16).collect()))
    own = sharding.shard_documents(odd, 16).collect()
    assert len(own) == odd.count() and len({(r["shard"], r["slot"]) for r in own}) == len(own)
    assert len({r["shard"] for r in own if r["doc_id"] == 1}) == 1
    assert sharding.shard_documents(empty, 16).collect() == []


def test_jump_moves_into_the_new_shard_only():
    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    now = sharding.jump(keys, 1)
    for n in range(2, 40):
        after = sharding.jump(keys, n)
        moved = after != now
        assert (after[moved] == n - 1).all() and abs(moved.mean() - 1 / n) < 0.02
        now = after


def test_segments_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = np.where(rng.random(30) < 0.3, rng.random(30) * 3, toxicity.DRIFT)
        best = max(((scores[a:b].sum(), a, b) for a in range(30) for b in range(a + 1, 31)), default=(0,))
        found = toxicity.segments(scores)
        assert all(math.isclose(scores[b:e].sum(), s) for b, e, s in found)
        assert all(e1 <= b2 for (_, e1, _), (b2, _, _) in zip(found, found[1:], strict=False))
        if best[0] > 0:
            assert math.isclose(max(s for *_, s in found), best[0])


def test_toxicity_on_held_out_rows(spark, odd, empty):
    rng = random.Random(7)
    common, bad = [f"{a}{b}" for a in "bcdfgh" for b in ("ala", "ero", "inu", "ost")], ["vilest", "nastyish", "scabby", "grubbed"]
    rows = []
    for i in range(3000):
        toxic = i % 7 == 0
        words = [rng.choice(common) + str(rng.randrange(9)) * 0 for _ in range(rng.randrange(20, 90))]
        for _ in range(4 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    out = toxicity.score_toxicity(docs, model, keep=("doc_id", "toxic")).where(~toxicity.learnt_from(F.col("doc_id"))).collect()
    assert len(out) > 800
    assert sum(r["predicted"] == r["toxic"] for r in out) / len(out) > 0.99
    own = toxicity.score_toxicity(odd, model).collect()
    assert len(own) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == 0 for r in own)
    assert toxicity.score_toxicity(empty, model).collect() == []
    unlabelled = toxicity.learn(docs.drop("toxic"), docs.select("doc_id", "toxic").limit(0))
    assert toxicity.score_toxicity(odd, unlabelled).where("predicted = 1").count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, x) for x in range(501, 560)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    for kind in ("long", "string"):
        df = spark.createDataFrame(edges, "a long, b long").selectExpr(f"cast(a + 1000 as {kind}) a", f"cast(b + 1000 as {kind}) b")
        got = connected_components(df, "test-components").collect()
        assert {int(r["node"]) - 1000: int(r["root"]) - 1000 for r in got} == want and len(got) == len(want)


def test_md5_hash_is_stable(spark):
    from weftql.llm.common import key_hash

    got = spark.range(3).select(key_hash("id", seed="s").alias("h")).collect()
    assert [r["h"] for r in got] == [int(hashlib.md5(f"s|{i}".encode()).hexdigest()[:15], 16) for i in range(3)]
