"""Words and their hashes for batches of texts, vectorised: what Python-side operators use inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; bounds the working memory of a task (about 60 bytes for each).
CHUNK = 256 << 10
#: Any odd base; hashes are polynomials in it modulo 2^64, then mixed.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z lower-cased and every white-space byte a blank.
LOWER_BLANK = bytes(32 if b in b" \t\n\r\x0b\x0c" else LOWER[b] for b in range(256))
#: A-Z lower-cased and every ASCII byte that isn't a letter or digit a blank.
LOWER_ALNUM = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        made = []
        for base in (BASE, INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if size > CHUNK + 4096:  # a long text: not kept
            return made[0], made[1]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = h + np.uint64((salt * 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, inverse powers): the hash of data[a:b] is (P[b] - P[a]) * inverse[a]."""
    p, inv = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * p[: len(data)], out=out[1:])
    return out, inv


def octets(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes, each of one text at least."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield first, i
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes], table: bytes = LOWER_BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text). Words are what blanks separate after translation by table."""
    joined = b" ".join(texts).translate(table) + b" "
    data = np.frombuffer(joined, np.uint8)
    inside = np.empty(len(data) + 1, bool)
    inside[0], inside[1:] = False, data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    p, inv = prefix_hash(data)
    hashes = mixed((p[ends] - p[starts]) * inv[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingle_sets(texts: list[bytes], k: int = 3, table: bytes = LOWER_BLANK) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of the whole sequence where it has fewer words."""
    for a, b in chunks(texts):
        words, counts = word_hashes(texts[a:b], table)
        n, rolled = len(words), np.zeros(len(words), np.uint64)
        for j in range(k):
            rolled[: max(0, n - j)] += mixed(words[j:], j + 1) * np.uint64(2 * j + 3) if j < n else np.uint64(0)
        rolled = mixed(rolled)
        at = 0
        for c in counts.tolist():
            if c >= k:
                yield np.unique(rolled[at : at + c - k + 1])
            elif c:
                whole = np.uint64(c)
                for j in range(c):
                    whole = mixed(np.array([whole ^ words[at + j]], np.uint64), j + 1)[0]
                yield np.array([whole], np.uint64)
            else:
                yield np.empty(0, np.uint64)
            at += c
