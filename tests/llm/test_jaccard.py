"""The join against all pairs compared in Python."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from weftql.llm.components import connected_components
from weftql.llm.jaccard import PLAIN, _profile, _shared, families_of, jaccard_join, signatures, spare


def brute(rows, k=3, percent=90):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set())
    root, links = list(range(len(rows))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.update((a, b))
            root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = find(i)
            least[r] = min(least.get(r, doc), doc)
    return Counter((doc, len(s), doc if not s else least.get(find(i)), links[i]) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed=5):
    rng, rows = random.Random(seed), []
    for f in range(12):
        base = [f"f{f}w{rng.randrange(50)}" for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.choice([1, 2, 15, 40])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(1000)}"
            rows.append((len(rows), " ".join(words)))
    return rows


def found(df, **options):
    return Counter(tuple(r) for r in jaccard_join(df, **options).select("doc_id", "n_shingles", "component_id", "n_links").collect())


def test_near_copies(spark, monkeypatch):
    rows = near_copies()
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    monkeypatch.setattr("weftql.llm.jaccard.BLOCK_ROWS", 7)  # families of many blocks
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert found(odd) == brute(rows)
    assert found(empty) == Counter()


def test_other_limits(spark):
    rows = near_copies(9)
    assert found(spark.createDataFrame(rows, "doc_id long, text string"), k=5, percent=80) == brute(rows, 5, 80)


def test_half_and_all(spark):
    rows = near_copies(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (50, 65, 100):
        assert found(df, percent=percent) == brute(rows, 3, percent)


def test_linked_sets_share_signatures():
    rng = np.random.default_rng(1)
    for percent in (50, 80, 90, 97):
        for n in (2, 3, 5, 9, 17, 40, 130, 700):
            for _ in range(30):
                x = rng.integers(0, 1 << 63, n, np.uint64)
                gone = rng.integers(0, max(1, n * (100 - percent) // 100) + 1)
                come = rng.integers(0, max(1, n * (100 - percent) // 100) + 1)
                y = np.append(x[gone:], rng.integers(0, 1 << 63, come, np.uint64))
                both = len(np.intersect1d(x, y))
                if 100 * both < percent * (len(x) + len(y) - both) or not (gone or come):
                    continue
                (sx, lx), (sy, ly) = signatures(np.sort(x), percent), signatures(np.sort(y), percent)
                shared = np.isin(sx, sy)
                assert any(shared[lx == level].sum() >= (1 if level >= PLAIN else spare(level, percent)) for level in set(lx) & set(ly))


def test_unrelated_sets_form_no_families(spark):
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))) for i in range(3000)]
    rows += [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + " " + passage) for i in range(3000, 4000)]
    docs = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "0L AS row", "xxhash64(text) AS hash")
    for k, percent in ((3, 90), (5, 80)):
        signed = docs.mapInArrow(*_profile(k, percent)).repartition(F.when(F.col("kind") == 2, F.xxhash64("signature", "k1")).otherwise(F.col("signature"))).sortWithinPartitions("signature", "k1")
        shared = signed.mapInArrow(_shared, "id long, n long, k1 long, k2 long, row long, hash long, signature long, level byte").where("signature IS NOT NULL")
        members = families_of(shared.select("signature", "k1", "level"), percent).collect()
        assert len(members) <= (0 if percent == 90 else 30)  # of the thousand that have more than half of their text in common


def test_common_signatures_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = near_copies(7)
        assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components_of_long_chains(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(1, 300)] + [(1000, 2000), (2000, 1500), (5, 7)]
    want = {**{i: 1 for i in range(1, 301)}, 1000: 1000, 1500: 1000, 2000: 1000}
    for limit in (200_000, 10):
        monkeypatch.setattr("weftql.llm.components.FOREST_EDGES", limit)
        for kind in ("long", "string"):
            named = [tuple(x if kind == "long" else f"{x:09d}" for x in e) for e in edges]
            got = connected_components(spark.createDataFrame(named, f"a {kind}, b {kind}"), "test").collect()
            assert len(got) == len(want) and {int(r["node"]): int(r["root"]) for r in got} == want
