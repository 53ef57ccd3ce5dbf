"""Benchmark decontamination with an FM-index for each training shard.

A task cuts its documents into shards of bounded size. A shard's text is its words as symbols of the benchmark's
vocabulary. A word outside that vocabulary can't be part of a match, so it only separates, and stretches shorter than the
shortest phrase are left out: this loses no occurrence. Over the rest the shard builds an FM-index: suffix array,
Burrows-Wheeler transform, a wavelet matrix for ranks, and suffix positions sampled at every 32nd place. All phrases are
searched backwards together; occurrences are located by walking to a sampled row, and their spans merged.

Documents aren't shuffled. The phrases are broadcast in slices of bounded size. A pass over the documents takes a bounded number
of slices, so that no worker ever holds more; a larger benchmark takes more passes, each written and read by the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftql.llm.common import materialize
from weftql.llm.textscan import LOWER_ALNUM, octets

WINDOW = 10
#: A shard ends at so many indexed symbols or bytes of text, whichever comes first (one document may hold more).
SHARD_SYMBOLS, SHARD_BYTES = 1 << 20, 32 << 20
SAMPLE = 32
#: Words of benchmark items in a slice of phrases, which is broadcast (some 100 bytes each), and slices of one pass over the documents.
SLICE_WORDS, PASS_SLICES = 1_000_000, 2


class WaveletMatrix:
    """Ranks and symbols over an array of small integers."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.int32)
            before = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=before[1:])
            self.ones.append(before)
            self.zeros.append(len(bit) - int(before[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each (symbol, end): how often the symbol stands before end."""
        first = np.zeros_like(ends)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            one = (symbols >> (self.bits - 1 - level) & 1).astype(bool)
            a, b = ones[first], ones[ends]
            first, ends = np.where(one, zeros + a, first - a), np.where(one, zeros + b, ends - b)
        return ends - first


class FMIndex:
    """Of symbols >= 1, with a 0 after each stretch. Inside, all are one higher, so that the end of the text is unique and least."""

    def __init__(self, symbols: np.ndarray):
        symbols = np.append(symbols + 1, 0).astype(np.int64)
        order = suffix_array(symbols)
        self.bwt = symbols[order - 1]
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(symbols.max()).bit_length()))
        self.before = np.zeros(int(symbols.max()) + 2, np.int64)
        np.cumsum(np.bincount(symbols), out=self.before[1:])
        sampled = order % SAMPLE == 0
        self.sampled, self.samples = np.concatenate([[0], np.cumsum(sampled)]), order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; phrases are rows of symbols, filled up on the right."""
        phrases = phrases + 1
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.bwt), np.int64)
        filled = np.arange(phrases.shape[1]) >= lengths[:, None]
        known = ((phrases < len(self.before) - 1) | filled).all(axis=1)
        high[~known] = 0
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((low < high) & (step < lengths))
            if not len(live):
                break
            c = phrases[live, lengths[live] - 1 - step]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows of the index."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            here = self.sampled[r + 1] > self.sampled[r]
            out[live[here]] = self.samples[self.sampled[r[here]]] + steps[live[here]]
            live, r = live[~here], r[~here]
            c = self.bwt[r]
            rows[live] = self.before[c] + self.wavelet.rank(c, r)
            steps[live] += 1
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; after a round only suffixes that still share their rank are sorted again."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    fresh = np.empty(n, bool)
    fresh[0], fresh[1:] = True, symbols[order[1:]] != symbols[order[:-1]]
    group = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # a rank is the place where its group begins
    rank = np.empty(n, np.int64)
    rank[order] = group
    alone, width = np.append(fresh[1:], True) & fresh, 1
    open_ = np.flatnonzero(~alone)
    while len(open_) and width < n:
        suffix = order[open_]
        after = np.where(suffix + width < n, rank[np.minimum(suffix + width, n - 1)], -1)
        again = np.lexsort((after, group[open_]))
        suffix, after, own = suffix[again], after[again], group[open_][again]
        order[open_] = suffix
        fresh = np.empty(len(open_), bool)
        fresh[0], fresh[1:] = True, (own[1:] != own[:-1]) | (after[1:] != after[:-1])
        group[open_] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
        rank[suffix] = group[open_]
        alone = np.append(fresh[1:], True) & fresh
        open_, width = open_[~alone], width * 2
    return order


class Phrases:
    """The windows of benchmark items as rows of symbols, and the items of each."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.names = [name for name, _ in items]
        self.vocabulary = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for _, words in items for w in words))}
        found: dict[tuple[int, ...], set[int]] = {}
        for item, (_, words) in enumerate(items):
            ids = [self.vocabulary[w] for w in words]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + window]), set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.lengths = np.array([len(x) for x in found], np.int64)
        self.rows = np.ones((len(found), window), np.int64)
        for i, x in enumerate(found):
            self.rows[i, : len(x)] = x
        self.least = int(self.lengths.min()) if len(found) else 0


def benchmark_items(benchmark: DataFrame) -> Iterator[tuple[str, list[bytes]]]:
    """Items with words, read a partition at a time; a null id is named `null`, which no long is. Rows of the same id are one item each."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")).alias("text")).toLocalIterator()
    for name, text in rows:
        if words := text.encode().translate(LOWER_ALNUM).split():
            yield name, words


def shard_hits(words: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all occurrences over the concatenated documents (a gap of one after each): (begin, length), then (document, item)."""
    none = np.empty(0, np.int64)
    get, vocabulary = phrases.vocabulary.get, []
    for w in words:
        vocabulary.append(np.fromiter(map(get, w, repeat(0)), np.int32, len(w)))
        vocabulary.append(np.zeros(1, np.int32))
    symbols = np.concatenate(vocabulary) if vocabulary else np.empty(0, np.int32)
    known = np.concatenate([[False], symbols > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    begins, ends = edges[0::2], edges[1::2]
    long_enough = ends - begins >= max(1, phrases.least)
    begins, ends = begins[long_enough], ends[long_enough]
    if not len(begins) or not len(phrases.rows):
        return none, none, none, none
    sizes = ends - begins + 1  # each stretch with the 0 after it
    places = np.repeat(begins - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    kept = symbols[np.minimum(places, len(symbols) - 1)]
    kept[np.cumsum(sizes) - 1] = 0
    # symbols of the shard are numbered anew, densely, to keep the wavelet matrix low
    present, dense = np.unique(kept, return_inverse=True)
    renumber = np.full(len(phrases.vocabulary) + 1, len(present), np.int64)
    renumber[present] = np.arange(len(present))
    index = FMIndex(dense)
    low, high = index.search(renumber[phrases.rows], phrases.lengths)
    count = high - low
    which = np.repeat(np.arange(len(count)), count)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    at = places[index.locate(rows)] if len(rows) else none
    length = phrases.lengths[which]
    # exact check: the symbols found are the phrase's
    for j in range(phrases.rows.shape[1]):
        inside = j < length
        assert (symbols[at[inside] + j] == phrases.rows[which[inside], j]).all(), "the index located a false occurrence"
    doc_ends = np.cumsum([len(w) + 1 for w in words])
    doc = np.searchsorted(doc_ends, at, side="right")
    n_items = np.array([len(x) for x in phrases.items])
    item = np.concatenate([phrases.items[i] for i in which]) if len(which) else none
    return at, length, np.repeat(doc, n_items[which]) if len(which) else none, item


FOUND = pa.schema([("__n_words", pa.int64()), ("__n_hit", pa.int64()), ("__item_ids", pa.list_(pa.string())), ("__spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))])


def _scan(slices: list, last: bool):
    """What a task's documents have of these slices, together with what they have of those before: columns of FOUND, if there.
    The last pass leaves the texts behind."""

    def shard(held: list[pa.RecordBatch], words: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum([len(w) + 1 for w in words])
        cover, names = np.zeros((ends[-1] if len(ends) else 0) + 1, np.int64), [set() for _ in words]
        starts = ends - [len(w) + 1 for w in words] if len(ends) else ends
        if "__spans" in held[0].schema.names:
            before = [(ids, spans) for batch in held for ids, spans in zip(batch.column("__item_ids").to_pylist(), batch.column("__spans").to_pylist(), strict=True)]
            for d, (ids, spans) in enumerate(before):
                names[d].update(ids)
                for span in spans:
                    cover[starts[d] + span["begin"]] += 1
                    cover[starts[d] + span["end"]] -= 1
        for part in slices:
            phrases = part.value
            at, length, doc, item = shard_hits(words, phrases)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + length, -1)
            for d, i in set(zip(doc.tolist(), item.tolist(), strict=True)):
                names[d].add(phrases.names[i])
        hit = np.cumsum(cover) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit]).astype(np.int8)))
        spans: list[list[dict]] = [[] for _ in words]
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            d = int(np.searchsorted(ends, a, side="right"))
            spans[d].append({"begin": a - int(starts[d]), "end": b - int(starts[d])})
        n, at = [len(w) for w in words], 0
        for batch in held:
            now = slice(at, at := at + batch.num_rows)
            arrays = [pa.array(n[now], pa.int64()), pa.array([sum(s["end"] - s["begin"] for s in x) for x in spans[now]], pa.int64()), pa.array([sorted(x) for x in names[now]], pa.list_(pa.string())), pa.array(spans[now], FOUND.field("__spans").type)]
            kept = [i for i, f in enumerate(batch.schema.names) if f not in FOUND.names and not (last and f == "__text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *arrays], schema=pa.schema([*(batch.schema.field(i) for i in kept), *FOUND]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words, size, symbols = [], [], 0, 0
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                texts = octets(batch.column("__text"))
                held.append(batch)
                words += [t.translate(LOWER_ALNUM).split() for t in texts]
                size, symbols = size + sum(map(len, texts)), symbols + sum(map(len, words[-len(texts) :]))
                if size >= SHARD_BYTES or symbols >= SHARD_SYMBOLS:
                    yield from shard(held, words)
                    held, words, size, symbols = [], [], 0, 0
        if held:
            yield from shard(held, words)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs(text, ...): keep, n_words, n_hit, item_ids, spans, contaminated.

    Words are runs of ASCII letters and digits, lower-cased, and of all characters beyond ASCII. A word is hit if it lies in
    an occurrence of `window` consecutive words of a benchmark item (of all words of a shorter item). item_ids: items with an
    occurrence, sorted as strings; spans: the hit stretches of words, merged. Null text has no words, an item without words
    no phrase; an empty benchmark hits nothing. Rows are judged one by one, so null and repeated ids make no difference.
    """
    out = docs.select(*keep, F.col("text").alias("__text"))
    schema, passes = out.schema, batched_slices(benchmark, window)
    slices = next(passes)
    while slices is not None:
        after = next(passes, None)
        names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema if f.name != "__text" or after is not None)
        found = _scan([docs.sparkSession.sparkContext.broadcast(x) for x in slices], after is None)
        out = out.mapInArrow(found, f"{names}__n_words long, __n_hit long, __item_ids array<string>, __spans array<struct<begin: long, end: long>>")
        out, slices = out if after is None else materialize(out, "decontaminate"), after
    return out.select(*keep, *[F.col(f"__{c}").alias(c) for c in ("n_words", "n_hit", "item_ids", "spans")], (F.col("__n_hit") > 0).alias("contaminated"))


def batched_slices(benchmark: DataFrame, window: int) -> Iterator[list[Phrases]]:
    """The benchmark's phrases in slices, as many at a time as one pass takes; once none at all for an empty benchmark."""
    slices, held, size, some = [], [], 0, False
    for name, words in benchmark_items(benchmark):
        held.append((name, words))
        if (size := size + len(words)) >= SLICE_WORDS:
            slices.append(Phrases(held, window))
            held, size = [], 0
        if len(slices) == PASS_SLICES:
            yield slices
            slices, some = [], True
    if held:
        slices.append(Phrases(held, window))
    if slices or not some:
        yield slices
