"""Targets and shares against water-filling by repeated resharing in Python."""

import math
from collections import defaultdict

from weftql.llm.mixing import SCHEDULES, integral, mix_sources


def reshare(sizes, weights, total, epochs=2):
    """Targets by name: what is above a limit goes to the others by weight, until none is above."""
    target, open_ = {}, dict(weights)
    while open_:
        left = total - sum(target.values())
        level = left / sum(open_.values())
        full = [s for s, w in open_.items() if level * w > epochs * sizes[s]]
        if not full:
            return target | {s: level * w for s, w in open_.items()}
        for s in full:
            target[s] = epochs * sizes[s]
            del open_[s]
    return target


def check(rows, whole=False):
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"] and (r["position"] is None) == (r["taken"] == 0)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weights = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}
    want = reshare(sizes, weights, 1.5 * sum(sizes.values()))
    for s in sizes:
        assert math.isclose(targets[s], want[s], rel_tol=1e-9, abs_tol=1e-6) and targets[s] <= 2 * sizes[s]
        assert abs(taken[s] - targets[s]) <= (max(r["size"] for r in rows if r["source"] == s) if whole else 1)
    seen = [r["position"] for r in rows if r["position"] is not None]
    assert all(0 <= p <= 1 for p in seen) and seen == sorted(seen)


def test_schedules():
    assert [integral(s) for s in SCHEDULES] == [5.0, 2.0, 1.0]


def test_table(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), ["a", "a", "a", "b", "c", "d", None][i % 7] if i % 3 else "e") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(df).collect()
    assert len(out) == 3000
    check(out)
    assert sorted(map(repr, out)) == sorted(map(repr, mix_sources(df.repartition(7)).collect()))
    check(mix_sources(df, whole=True).collect(), whole=True)


def test_odd_rows(odd, empty):
    out = mix_sources(odd).collect()
    assert len(out) == odd.count()
    check(out)
    assert mix_sources(empty).collect() == []
