"""Removal of repeats against a dictionary of all windows, and the column-wise BWT against plain classes of windows."""

import hashlib
import random
from collections import Counter

import numpy as np

from weftql.llm.suffixes import anchored, common_strings, equal_windows, remove_repeats, same_pieces


def brute(rows, length=50):
    least: dict[bytes, int] = {}
    rows = [(1 << 62 if i is None else i, (t or "").encode()) for i, t in rows]
    for i, t in rows:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            if i < least.get(w, 1 << 63):
                least[w] = i
    out = Counter()
    for i, t in rows:
        gone = bytearray(len(t) + 1)
        reach = 0
        for k in range(len(t) - length + 1):
            if least[t[k : k + length]] < i:
                for x in range(max(reach, k), k + length):
                    gone[x] = 1
                reach = k + length
        runs = sum(1 for x in range(len(t)) if gone[x] and not gone[x - 1 if x else len(t)])
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out[None if i == 1 << 62 else i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def found(df, length=50):
    return Counter((r["doc_id"], r["n_bytes"], sum(s["end"] - s["begin"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in remove_repeats(df, length).collect())


def test_classes_of_windows():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 30))) for _ in range(200)]
    data, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    starts = np.cumsum(sizes) - sizes
    place, group = equal_windows(data, starts, sizes, 8)
    want = {}
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        for k in range(a, a + n - 7):
            want[k] = data[k : k + 8].tobytes()
    assert sorted(place.tolist()) == sorted(want)
    names = {}
    assert all(names.setdefault(g, want[p]) == want[p] for p, g in zip(place.tolist(), group.tolist(), strict=True))
    assert len(names) == len(set(want.values()))


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert found(odd) == brute(rows)
    assert found(empty) == Counter()


def test_shared_passages(spark, monkeypatch):
    monkeypatch.setattr("weftql.llm.suffixes.BLOCK_BYTES", 4000)
    monkeypatch.setattr("weftql.llm.suffixes.BUCKET_BYTES", 9000)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    passages = ["".join(word() for _ in range(rng.choice([8, 11, 14, 30]))) for _ in range(6)] + ["-" * 80, "ab" * 60]
    rows = []
    for i in range(120):
        parts = ["".join(word() for _ in range(rng.randrange(1, 20))) for _ in range(rng.randrange(1, 4))]
        for _ in range(rng.randrange(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        rows.append((1000 - 7 * i if i % 10 else 5, "".join(parts)))
    rows += rows[:5]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_windows_have_one_anchor_each(monkeypatch):
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.choice([0, 3, 49, 50, 51, 400]))) for _ in range(60)]
    sizes = np.array([len(t) for t in texts])
    starts, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(texts), np.uint8)
    common = np.random.default_rng(1).random(1 << 22) < 0.3
    for part in (1 << 17, 64):
        for table in (None, common):
            monkeypatch.setattr("weftql.llm.suffixes.PART", part)
            runs = anchored(data, starts, sizes, 50, table)
            places = [p for a, n in zip(runs.first.tolist(), runs.windows.tolist(), strict=True) for p in range(a, a + n)]
            assert places == [a + k for a, n in zip(starts.tolist(), sizes.tolist(), strict=True) for k in range(n - 49)]
            of = dict(zip(places, np.repeat(runs.anchor, runs.windows).tolist(), strict=True))
            by_bytes = {}
            assert all(by_bytes.setdefault(data[p : p + 50].tobytes(), h) == h for p, h in of.items())


def test_same_pieces_of_equal_hashes():
    data = np.frombuffer(b"x" * 60 + b"y" * 60 + b"x" * 60 + b"y" * 61, np.uint8)
    first, windows = np.array([0, 60, 120, 180]), np.array([11, 11, 11, 12])
    number, leads = same_pieces(data, np.zeros(4, np.uint64), first, windows, 50)
    assert number[0] == number[2] != number[1] and len(set(number.tolist())) == 3 and sorted(leads.tolist()) == [0, 1, 3]


def test_a_string_in_thousands_of_surroundings(spark, monkeypatch):
    """One of 30 bytes in all documents: right rows, and no bucket gets its pieces."""
    monkeypatch.setattr("weftql.llm.suffixes.BUCKET_BYTES", 40_000)
    monkeypatch.setattr("weftql.llm.suffixes.SAMPLE_PART", 2)
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = [(i, word(rng.randrange(40, 90)) + "a line of thirty bytes exactly" + word(rng.randrange(40, 90))) for i in range(3000)]
    rows += [(5000 + i, rows[i * 7][1][10:] + word(20)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)
    size = sum(len(t) for _, t in rows)
    common = common_strings(df, size, 50).value
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    sizes = np.array([len(t) for _, t in rows])
    for table, most in ((None, 3000), (common, 120)):
        runs = anchored(data, np.cumsum(sizes) - sizes, sizes, 50, table)
        _, counts = np.unique(np.unique(np.stack([runs.anchor, runs.content]), axis=1)[0], return_counts=True)
        assert counts.max() >= 250 if table is None else counts.max() <= most


def test_whole_documents_in_one_transform():
    """The transform itself takes whole documents too: pieces only bound its rounds."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(0, 400))).encode() for _ in range(30)]
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    place, group = equal_windows(data, np.cumsum(sizes) - sizes, sizes, 20)
    names = {}
    assert all(names.setdefault(g, data[p : p + 20].tobytes()) == data[p : p + 20].tobytes() for p, g in zip(place.tolist(), group.tolist(), strict=True))
    assert len(names) == len(set(names.values()))
