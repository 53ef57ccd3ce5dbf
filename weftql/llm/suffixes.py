"""Removal of repeated byte strings, with a column-wise built Burrows-Wheeler transform of the repeated regions.

Every byte is covered by windows of `length` bytes. A window is anchored at the leftmost least of its inner strings of ANCHOR
bytes, so equal windows have equal anchors, wherever they stand. Least by hash, but strings that stand in many different
surroundings come last (`common_strings`): else all of these would meet in one bucket.

1. Documents are dealt into blocks. A block tells, packed and bucketed by hash, which anchors it has; an anchor that only one
   document has can't be repeated, and its windows are out.
2. The stretches of text around the other anchors ("pieces", at most 2 length - ANCHOR bytes) go, packed, to buckets by anchor.
   Equal pieces of a block go once, with their least id: a passage that a third of all documents share costs a block one piece.
3. A bucket builds the collection's BWT from right to left, one symbol of every piece a round, by merging the new suffixes
   into the sequence of old ones in sequential passes; it keeps with each suffix whether it shares `length` bytes with the
   one before. Runs of such suffixes are the classes of equal windows, whose least id decides.
4. Blocks get back the least ids of their pieces' windows and remove what a smaller id has.

All exchanges are packed and grow with the input; blocks and buckets have bounded size, and their number follows the input.
The sequences of step 3 are arrays in memory, of a bucket's bounded size, not files on a machine's disk. Hashes choose anchors
and pair up candidates; that two windows or pieces are equal is decided by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftql.llm.common import materialize
from weftql.llm.textscan import mixed, octets, prefix_hash

#: Bytes of an anchor string, so that a window of 50 holds 26 of them.
ANCHOR = 25
BLOCK_BYTES, BUCKET_BYTES = 5 << 20, 2 << 20
#: Windows that are worked on at once.
PART = 1 << 17
LAST_ID = (1 << 63) - 1
#: Documents of so many bytes at most, and of one part of the whole, tell which strings are common. Any list gives the same
#: result; it only keeps buckets even.
SAMPLE_BYTES, SAMPLE_PART, SAMPLE_ROUNDS, SAMPLE_TASK = 256 << 20, 32, 4, 16 << 20
#: Leading bits of a hash by which common strings are known.
COMMON_BITS = 22
CODEC = pa.Codec("zstd", compression_level=6)


def packed(*arrays: np.ndarray | bytes) -> bytes:
    raw = b"".join(x if isinstance(x, bytes) else x.tobytes() for x in arrays)
    return np.int64(len(raw)).tobytes() + CODEC.compress(raw, asbytes=True)


def unpacked(data: bytes) -> bytes:
    return CODEC.decompress(data[8:], decompressed_size=int(np.frombuffer(data, np.int64, 1)[0]), asbytes=True)


@dataclass
class Runs:
    """Neighbouring windows with the same anchor: the anchor's hash, first window, number of windows, and a hash of all their bytes."""

    anchor: np.ndarray
    first: np.ndarray
    windows: np.ndarray
    content: np.ndarray

    def __getitem__(self, which) -> Runs:
        return Runs(self.anchor[which], self.first[which], self.windows[which], self.content[which])


def anchored(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int, common: np.ndarray | None = None) -> Runs:
    """The runs of all windows of texts that stand end to end in data, from left to right. A part's end also ends a run."""
    found = [(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64))]
    change = np.zeros(len(data) + 1, np.int8)  # windows that begin in the last length - 1 bytes of a text would cross its end
    ends = starts + sizes
    np.add.at(change, np.maximum(starts, ends - length + 1), 1)
    np.add.at(change, ends, -1)
    crossing = np.cumsum(change[:-1], dtype=np.int8) > 0
    span = length - ANCHOR + 1
    for base in range(0, len(data) - length + 1, PART):
        part = data[base : base + PART + length - 1]
        p, inv = prefix_hash(part)
        h = mixed((p[ANCHOR:] - p[:-ANCHOR]) * inv[: len(part) - ANCHOR + 1])
        best = h & np.uint64(0x7FFFFFFF)  # not the leading bits: these deal anchors to buckets
        if common is not None:
            best |= common[(h >> np.uint64(64 - COMMON_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(31)
        best = best << np.uint64(32) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size < span:  # the least of each span, by doubling
            step = min(size, span - size)
            best = np.minimum(best[:-step], best[step:])
            size += step
        at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        there = np.flatnonzero(~crossing[base : base + len(at)])
        if not len(there):
            continue
        at = at[there]
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (there[1:] != there[:-1] + 1)]))
        first, windows = there[new], np.diff(np.append(new, len(there)))
        stop = first + windows + length - 1
        found.append((h[at[new]], first + base, windows, mixed((p[stop] - p[first]) * inv[first], 31)))
    return Runs(*(np.concatenate(x) for x in zip(*found, strict=True)))


def alike(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows at a and at b are the same bytes."""
    if not len(a):
        return np.zeros(0, bool)
    windows = np.ndarray((len(data) - length + 1,), f"S{length}", np.ascontiguousarray(data), strides=(1,))
    return np.concatenate([windows[a[i : i + 65536]] == windows[b[i : i + 65536]] for i in range(0, len(a), 65536)])


def same_pieces(data: np.ndarray, content: np.ndarray, first: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of its class of each piece, first piece of each class): equal bytes make a class. Numbers follow the content's hash."""
    key = mixed(content + windows.astype(np.uint64), 37)
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]]) if len(order) else np.empty(0, bool)
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    # a piece is covered by its first and last windows and those between at steps of length
    a, b, n = first[order], first[lead], windows[order]
    equal = n == windows[lead]
    for at in range(0, int(n.max(initial=0)), length):
        step = np.minimum(at, n - 1)
        equal[equal] = alike(data, (a + step)[equal], (b + step)[equal], length)
    equal[equal] = alike(data, (a + n - 1)[equal], (b + n - 1)[equal], length)
    new |= ~equal  # equal hashes of different pieces: the later ones are classes of their own
    lead = np.where(equal, lead, order)
    leads = order[new]
    number = np.empty(len(order), np.int64)
    of = np.empty(len(order), np.int64)
    of[leads] = np.arange(len(leads))
    number[order] = of[lead]
    return number, leads


class Block:
    """A block's documents, in an order that is the same in every run: by id, then text."""

    def __init__(self, table: pa.Table):
        ids, texts = [LAST_ID if x is None else x for x in table.column("doc_id").to_pylist()], octets(table.column("text"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids, self.texts = np.array([ids[i] for i in order], np.int64), [texts[i] for i in order]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = b"".join(self.texts)
        self.data = np.frombuffer(self.bytes, np.uint8)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        """The number of the text that each place of a non-empty text is in."""
        return np.searchsorted(self.starts, places, side="right") - 1

    def pieces(self, answers: pa.Table, length: int, common) -> tuple[Runs, np.ndarray, np.ndarray]:
        """The runs whose anchors others have too, the number of each one's class of equal pieces, and the first of each class.
        As texts are in the order of ids, that first has the class's least id."""
        shared = [np.empty(0, np.uint64), *(_hashes(x) for x in answers.column("hashes").to_pylist() if x is not None)]
        shared = np.unique(np.concatenate(shared) | TWICE)
        runs = anchored(self.data, self.starts, self.sizes, length, common)
        if len(shared):
            own = (runs.anchor & HASH) | TWICE
            runs = runs[shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own]
        else:
            runs = runs[:0]
        return runs, *same_pieces(self.data, runs.content, runs.first, runs.windows, length)


#: What is sent of an anchor's hash: 47 bits, and one that says that two documents have it.
HASH, TWICE = np.uint64(0xFFFFFFFFFFFE0000), np.uint64(0x10000)


def _six(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h).astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _hashes(six: bytes) -> np.ndarray:
    out = np.zeros((len(six) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(six, np.uint8).reshape(-1, 6)
    return out.view("<u8")[:, 0].astype(np.uint64)


def _by_bucket(h: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted hashes for each bucket that has any."""
    bounds = np.searchsorted(((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, slice(bounds[b], bounds[b + 1])


def _surroundings(length: int, common):
    """(anchor, different pieces around it) of the anchors that have several, in a task's texts."""
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty((0, 2), np.uint64)]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                texts = octets(whole.slice(at, 512).column("text"))
                sizes = np.array([len(t) for t in texts], np.int64)
                runs = anchored(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes, length, common and common.value)
                _, once = np.unique(runs.anchor + mixed(runs.content), return_index=True)
                held.append(np.stack([runs.anchor[once], runs.content[once]], axis=1))
        anchor, content = np.concatenate(held).T
        order = np.lexsort((content, anchor))
        anchor, content = anchor[order], content[order]
        other = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])])[: len(anchor)]
        anchor, n = np.unique(anchor[other], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(anchor[n > 1].view(np.int64)), pa.array(n[n > 1])], schema=schema)

    return run, "anchor long, n long"


def common_strings(rows: DataFrame, size: int, length: int):
    """By the leading bits of their hashes, broadcast, the strings whose different pieces would fill an eighth of a bucket, judging
    by a sample. As others take the place of those found, they are looked for again, a few times. None if there are none."""
    part = max(SAMPLE_PART, -(-size // SAMPLE_BYTES))
    many = max(8, BUCKET_BYTES // (8 * (2 * length - ANCHOR)) // part)
    sample = rows.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(part)) == 0).select("text")
    sample = materialize(sample.repartition(max(1, size // part // SAMPLE_TASK), F.xxhash64("text")), "suffixes-sample")
    table, common = np.zeros(1 << COMMON_BITS, bool), None
    for _ in range(SAMPLE_ROUNDS):
        found = sample.mapInArrow(*_surroundings(length, common)).groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= many)
        hashes = np.array([r["anchor"] for r in found.select("anchor").collect()], np.int64).view(np.uint64)
        places = (hashes >> np.uint64(64 - COMMON_BITS)).astype(np.int64)
        if table[places].all():
            break
        table[places] = True
        common = rows.sparkSession.sparkContext.broadcast(table.copy())
    return common


def _announce(length: int, buckets: int, common):
    """Rows (bucket, block, hashes) of a block: its distinct anchors, and whether two of its documents have them."""

    def run(table: pa.Table) -> pa.Table:
        block = Block(table)
        runs = anchored(block.data, block.starts, block.sizes, length, common and common.value)
        text, h = block.text_of(runs.first), runs.anchor & HASH
        order = np.argsort(h, kind="stable")
        h, text = h[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        h = h[first] | TWICE * (text[first] != text[np.append(first[1:], len(text)) - 1]) if len(first) else h
        rows = list(_by_bucket(h, buckets))
        name = table.column("block")[0].as_py()
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "block": pa.array([name] * len(rows), pa.int32()), "hashes": pa.array([_six(h[s]) for _, s in rows], pa.binary())})

    return run, "bucket int, block int, hashes binary"


def _answer(table: pa.Table) -> pa.Table:
    """For a bucket: rows (block, hashes) of the anchors that more than one document has."""
    blocks, sets = table.column("block").to_pylist(), [_hashes(x) for x in table.column("hashes").to_pylist()]
    all_ = np.concatenate(sets)
    h, inverse, counts = np.unique(all_ | TWICE, return_inverse=True, return_counts=True)
    several = counts > 1
    several[inverse[(all_ & TWICE) > 0]] = True
    keep, ends = several[inverse], np.cumsum([len(x) for x in sets]).tolist()
    out = [(block, _six(x[keep[end - len(x) : end]])) for block, x, end in zip(blocks, sets, ends, strict=True) if keep[end - len(x) : end].any()]
    return pa.table({"block": pa.array([b for b, _ in out], pa.int32()), "hashes": pa.array([x for _, x in out], pa.binary())})


def _send(length: int, buckets: int, common):
    """Rows (bucket, block, pieces) of a block: the distinct pieces around shared anchors with their numbers and least ids."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"bucket": [], "block": [], "pieces": []}
        if docs.num_rows and answers.num_rows:
            block = Block(docs)
            runs, _, leads = block.pieces(answers, length, common and common.value)
            order = np.argsort(runs.anchor[leads], kind="stable")
            own = runs[leads[order]]
            least, sizes = block.ids[block.text_of(own.first)], (own.windows + length - 1).astype(np.int32)
            begins, ends = own.first.tolist(), (own.first + sizes).tolist()
            name = docs.column("block")[0].as_py()
            for b, s in _by_bucket(own.anchor, buckets):
                out["bucket"].append(b)
                out["block"].append(name)
                body = b"".join([block.bytes[x:y] for x, y in zip(begins[s], ends[s], strict=True)])
                out["pieces"].append(packed(np.int64(s.stop - s.start), order[s].astype(np.int32), least[s], sizes[s], body))
        return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "block": pa.array(out["block"], pa.int32()), "pieces": pa.array(out["pieces"], pa.binary())})

    return run, "bucket int, block int, pieces binary"


def _unpack_pieces(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = unpacked(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int32, n, 8), np.frombuffer(raw, np.int64, n, 8 + 4 * n), np.frombuffer(raw, np.int32, n, 8 + 12 * n), raw[8 + 16 * n :]


def equal_windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in data, class) of every window of `length` bytes of the strings: equal windows have equal classes.

    The collection's BWT is built column by column: round r inserts each string's suffix of r symbols. In a stable sort of the
    BWT's symbols, the k-th symbol stands for the k-th suffix after the empty ones, so the suffixes of old symbols keep their
    order and those of the symbols inserted last go between them, in one sequential merge.
    """
    m, ends = len(starts), starts + sizes
    symbols = data.astype(np.uint16) + 1  # 0: a string's beginning
    place = ends.astype(np.int32)  # where each suffix begins
    string = np.arange(m, dtype=np.int32)
    bwt = np.where(sizes > 0, symbols[np.maximum(ends - 1, 0)] if len(data) else 0, 0).astype(np.uint16)
    fresh = np.ones(m, bool)
    same = np.zeros(m, bool)  # shares `length` bytes with the suffix before
    for size in range(1, int(sizes.max(initial=0)) + 1):
        order = np.argsort(bwt, kind="stable")[len(bwt) - np.count_nonzero(bwt) :]
        new = fresh[order]
        came = order[new]
        total = m + len(order)
        slots = np.concatenate([np.zeros(m, bool), new])
        where, who = place[came] - 1, string[came]

        def merged(old, added, kind, slots=slots, total=total):
            out = np.empty(total, kind)
            out[slots], out[~slots] = added, old
            return out

        before = np.where(where > starts[who], symbols[np.maximum(where - 1, 0)], 0)
        place, string = merged(place, where, np.int32), merged(string, who, np.int32)
        bwt, same, fresh = merged(bwt, before, np.uint16), merged(same, False, bool), slots
        if size >= length:
            touched = np.flatnonzero(slots | np.concatenate([[False], slots[:-1]]))
            touched = touched[touched > 0]
            a, b = place[touched - 1], place[touched]
            able = (ends[string[touched - 1]] - a >= length) & (ends[string[touched]] - b >= length)
            able[able] = alike(data, a[able], b[able], length)
            same[touched] = able
    whole = ends[string] - place >= length
    # a shorter suffix may stand between two equal windows only if it were a prefix of both: it would be sorted before them
    return place[whole], np.cumsum(~same[whole]) - 1


def repeated_pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Which strings have a window whose hash occurs twice: only these can share a window, with others or within."""
    hashes, owners, first = [], [], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + PART)))
        base, end = int(starts[first]), int(starts[last - 1] + sizes[last - 1])
        p, inv = prefix_hash(data[base:end])
        counts = np.maximum(sizes[first:last] - length + 1, 0)
        owner = np.repeat(np.arange(first, last), counts)
        at = np.repeat(starts[first:last] - base - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        hashes.append((p[at + length] - p[at]) * inv[at])
        owners.append(owner.astype(np.int32))
        first = last
    out = np.zeros(len(starts), bool)
    if hashes:
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h)
        h = h[order]
        twice = np.zeros(len(h) + 1, bool)
        twice[1:-1] = h[1:] == h[:-1]
        out[owner[order[twice[1:] | twice[:-1]]]] = True
    return out


def content_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + PART)))
        base = int(starts[first])
        p, inv = prefix_hash(data[base : int(starts[last - 1] + sizes[last - 1])])
        a = starts[first:last] - base
        out[first:last] = (p[a + sizes[first:last]] - p[a]) * inv[a]
        first = last
    return out


def _judge(length: int):
    """For a bucket: rows (block, verdicts): the least id that has each window of each piece, by runs of windows.

    A piece that no other block has and none of whose windows recurs gets no verdict: its block knows the least id itself.
    """

    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        numbers, least, sizes, bodies = zip(*(_unpack_pieces(x) for x in table.column("pieces").to_pylist()), strict=True)
        rows_of = [len(x) for x in numbers]
        numbers, least, all_sizes = np.concatenate(numbers), np.concatenate(least), np.concatenate(sizes).astype(np.int64)
        body = b"".join(bodies)
        all_data = np.frombuffer(body, np.uint8)
        del bodies
        all_starts = np.cumsum(all_sizes) - all_sizes
        piece_of, leads = same_pieces(all_data, content_hashes(all_data, all_starts, all_sizes), all_starts, all_sizes - length + 1, length)
        ids = np.full(len(leads), LAST_ID, np.int64)
        np.minimum.at(ids, piece_of, least)
        sizes = all_sizes[leads]
        data = np.frombuffer(b"".join([body[a:b] for a, b in zip(all_starts[leads].tolist(), (all_starts[leads] + sizes).tolist(), strict=True)]), np.uint8)
        starts = np.cumsum(sizes) - sizes
        again = np.flatnonzero(repeated_pieces(data, starts, sizes, length))
        alone = np.flatnonzero(np.bincount(piece_of, minlength=len(sizes)) > 1)
        alone = alone[~np.isin(alone, again)]
        place, group = equal_windows(data, starts[again], sizes[again], length)
        piece = np.searchsorted(starts, place, side="right") - 1
        first = np.full(int(group.max(initial=-1)) + 1, LAST_ID, np.int64)
        np.minimum.at(first, group, ids[piece])
        order = np.argsort(place)
        place, piece, low = place[order], piece[order], first[group[order]]
        change = np.concatenate([[True], (piece[1:] != piece[:-1]) | (low[1:] != low[:-1])]) if len(place) else np.empty(0, bool)
        run_piece = np.concatenate([piece[change], alone])
        order = np.argsort(run_piece, kind="stable")
        run_at = np.concatenate([(place - starts[piece])[change], np.zeros(len(alone), np.int64)]).astype(np.int32)[order]
        run_piece, run_low = run_piece[order], np.concatenate([low[change], ids[alone]])[order]
        bounds = np.searchsorted(run_piece, np.arange(len(sizes) + 1))
        out, end = [], 0
        for block, n in zip(blocks, rows_of, strict=True):
            own, own_numbers = piece_of[end : end + n], numbers[end : end + n]
            end += n
            counts = bounds[own + 1] - bounds[own]
            at = np.repeat(bounds[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            if len(at):
                out.append((block, packed(np.int64(len(at)), np.repeat(own_numbers, counts).astype(np.int32), run_at[at], run_low[at])))
        return pa.table({"block": pa.array([b for b, _ in out], pa.int32()), "verdicts": pa.array([x for _, x in out], pa.binary())})

    return run, "block int, verdicts binary"


def _unpack_verdicts(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = unpacked(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.int32, n, 8), np.frombuffer(raw, np.int32, n, 8 + 4 * n), np.frombuffer(raw, np.int64, n, 8 + 8 * n)


def removed_bytes(block: Block, answers: pa.Table, length: int, common) -> np.ndarray:
    """Which bytes of a block's texts, end to end, go."""
    change = np.zeros(len(block.data) + 1, np.int32)
    runs, piece, leads = block.pieces(answers, length, common)
    if len(runs.first):
        parts = [_unpack_verdicts(x) for x in answers.column("verdicts").to_pylist() if x is not None]
        quiet = np.ones(len(leads), bool)
        for told, *_ in parts:
            quiet[told] = False
        quiet = np.flatnonzero(quiet)
        parts.append((quiet.astype(np.int32), np.zeros(len(quiet), np.int32), block.ids[block.text_of(runs.first[leads[quiet]])]))
        number, at, low = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, number))
        number, at, low = number[order], at[order].astype(np.int64), low[order]
        bounds = np.searchsorted(number, np.arange(len(leads) + 1))
        stop = np.where(np.append(number[1:] != number[:-1], True), runs.windows[leads][number], np.append(at[1:], 0))
        counts = bounds[piece + 1] - bounds[piece]
        told = np.repeat(bounds[piece] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        use = np.repeat(np.arange(len(piece)), counts)
        hit = low[told] < block.ids[block.text_of(runs.first)][use]
        use, told = use[hit], told[hit]
        np.add.at(change, runs.first[use] + at[told], 1)
        np.add.at(change, runs.first[use] + stop[told] + length - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _remove(length: int, common):
    """Rows (doc_id, n_bytes, spans, kept) of a block."""
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "spans": [], "kept": []}
        if docs.num_rows:
            block = Block(docs)
            gone = removed_bytes(block, answers, length, common and common.value)
            counts = np.concatenate([[0], np.cumsum(gone)])
            counts = counts[block.starts + block.sizes] - counts[block.starts]
            for i, t, start, n, less in zip(block.ids.tolist(), block.texts, block.starts.tolist(), block.sizes.tolist(), counts.tolist(), strict=True):
                spans, kept = [], t
                if less == n:
                    spans, kept = [{"begin": 0, "end": n}] if n else [], b""
                elif less:
                    own = gone[start : start + n]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    spans = [{"begin": a, "end": b} for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True)]
                    kept = block.data[start : start + n][~own].tobytes()
                out["doc_id"].append(None if i == LAST_ID else i)
                out["n_bytes"].append(n)
                out["spans"].append(spans)
                out["kept"].append(kept)
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "spans": pa.array(out["spans"], pa.list_(span)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out["kept"]], pa.string()), "kept": pa.array(out["kept"], pa.binary())})

    return run, "doc_id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, spans, kept_sha256, kept (the bytes that remain).

    A byte goes if a string of `length` bytes (ANCHOR + 1 at least) that covers it also starts in a document with a smaller
    doc_id. Texts are UTF-8 bytes, null is empty; strings don't cross documents. A null doc_id counts as larger than all others
    (as the largest long, which it ties with), rows of the same id don't remove each other's bytes. Strings are judged on the
    input, so a removed one still removes others. Extra columns are ignored; an empty table gives no rows.
    """
    if length <= ANCHOR:
        raise ValueError(f"length is {ANCHOR + 1} at least")
    rows = docs.select("doc_id", "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).collect()[0]["n"]
    blocks, buckets = max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // BUCKET_BYTES))
    common = common_strings(rows, size, length)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    by_block = dealt.groupBy("block")
    answers = by_block.applyInArrow(*_announce(length, buckets, common)).groupBy("bucket").applyInArrow(_answer, "block int, hashes binary")
    pieces = by_block.cogroup(answers.groupBy("block")).applyInArrow(*_send(length, buckets, common))
    verdicts = pieces.groupBy("bucket").applyInArrow(*_judge(length))
    told = answers.select("block", "hashes", F.lit(None).cast("binary").alias("verdicts")).unionByName(verdicts.select("block", F.lit(None).cast("binary").alias("hashes"), "verdicts"))
    return by_block.cogroup(told.groupBy("block")).applyInArrow(*_remove(length, common))
