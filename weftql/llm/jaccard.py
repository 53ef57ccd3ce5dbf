"""N-gram Jaccard join by vertical partitioning.

1. Every text becomes a set of hashed word shingles. Texts of equal sets form a class; classes are compared, not copies.
2. The global n-gram order (by hash) is cut into fragments, by sizes of sets: a level for every octave of sizes; a set takes
   part in its own level and, where larger partners may lie in the next, in that. Linked sets of n n-grams differ in at most
   `differing(n)` n-grams, so they agree on all other fragments. Empty fragments count for nothing; of the others a set sends
   its largest, as many as can differ and `spare(level)` more: linked sets share `spare` signatures at least (`signatures`
   has the proof, and what sets with too few fragments do). A class of which fewer are shared with others has no links; such
   classes leave, in rounds, as with every one more signatures stand alone. Of what remains each drops its `spare` - 1 most
   frequent signatures; two linked ones still share one. Families are the components of classes that share what is left.
   No pair is listed.
3. Families are cut into blocks of bounded size. Where two blocks of a family meet, the order is cut into fragments again;
   overlaps are counted separately for each fragment, summed for each pair of classes, and compared with the exact bound.
4. The links are exact; their components and numbers are the result. No pair of classes leaves its block's task.

Sets are told apart by 64-bit hashes of their n-grams and a 128-bit key of the whole set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import exp

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftql.llm.common import materialize
from weftql.llm.components import connected_components
from weftql.llm.textscan import mixed, octets, shingle_sets

#: Classes and n-grams of a block; columns of a fragment of a block.
BLOCK_ROWS, BLOCK_GRAMS, FRAGMENT = 1024, 500_000, 2048
#: Classes in families, 64 bytes each, up to which they are broadcast to the texts. Beyond that both sides are shuffled.
BROADCAST_ROWS = 300_000
#: Rounds in which classes with too few shared signatures leave. Any number gives the same links.
LEAVING_ROUNDS = 2
#: Signatures that a task holds before it passes them on, and class keys that it remembers.
HELD, REMEMBERED = 400_000, 200_000
#: Levels above this one are those of sets with too few fragments for their level.
PLAIN = 64
NO_ID = -(1 << 63)


def set_key(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set: two sums of mixed hashes, as signed longs."""
    return tuple(mixed(grams, s).sum(dtype=np.uint64).astype(np.int64).item() for s in (11, 12))


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    return shingle_sets(octets(batch.column("text")), k)


def differing(n: int, percent: int) -> int:
    """N-grams in which a set of n differs at most, both sides counted, from one that it links to: that one has n / t at most."""
    return n * (100 - percent) // percent


@cache
def levels(n: int, percent: int) -> list[int]:
    """The octave of sizes that n lies in, and the next one where larger partners may lie there."""
    own = (n - 1).bit_length()
    return [own, own + 1] if n * 100 // percent > 1 << own else [own]


@cache
def spare(level: int, percent: int) -> int:
    """Signatures that linked sets of a level share at least. Any number from 1 gives the same links; more of them tell sets that
    only have a passage in common from near copies, and are more to send."""
    top, k = 1 << level, differing(1 << level, percent)
    return max(1, min(12 * k * (100 - percent) // (5 * percent), 8 * top // 10 - k), min(8, (top - k) // 3))


@cache
def fragments(level: int, percent: int) -> int:
    """Into how many fragments the order is cut: so many that the largest sets of the level fill some more than they send."""
    top = 1 << level
    enough = min(1.1 * (differing(top, percent) + spare(level, percent)) + 2, 0.9 * top)
    parts = 4
    while parts < 8 * top and parts * (1 - exp(-top / parts)) < enough:
        parts += 1 + parts // 16
    return parts


def signatures(grams: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, level) of the fragments that a set sends, a signature being a hash of all n-grams in a fragment.

    At a level, let x have m fragments that aren't empty and y link to x. They differ in k n-grams at most, so at most k of
    either's fragments differ, with k = differing(|x|) as with differing(|y|). Both order fragments by (largest, signature),
    and send the first k + spare. Of those that x sends, k at most are not y's: spare or more are common, and the first spare
    of the common ones are among the first k + spare of both. So both have spare shared signatures. If x has fewer than
    k + spare, it sends all; then every common one that y sends is shared, which again are spare or more if y has k + spare.
    If neither has, both are `plain` as well: they also send the n - ceil(t n) + 1 least n-grams, of which linked sets share one.
    Sets of which nothing may differ (k = 0) link to equal sets only, their own class, and send nothing.
    """
    none, k, signs, at = np.empty(0, np.uint64), differing(len(grams), percent), [], []
    for level in levels(len(grams), percent) if k else []:
        part = ((grams >> np.uint64(32)) * np.uint64(fragments(level, percent))) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sign = mixed(np.add.reduceat(mixed(grams, 13), first), 20 + level)
        if len(first) > (send := k + spare(level, percent)):
            sign = sign[np.lexsort((sign, -np.diff(np.append(first, len(grams)))))[:send]]
        elif len(first) < send:
            plain = mixed(grams[: len(grams) - -(-percent * len(grams) // 100) + 1], 200 + level)
            signs.append(plain)
            at.append(np.full(len(plain), PLAIN + level, np.int8))
        signs.append(sign)
        at.append(np.full(len(sign), level, np.int8))
    return (np.concatenate(signs), np.concatenate(at)) if signs else (none, np.empty(0, np.int8))


#: What a row on its way to the exchange is: a signature that one class of the task has; one that several have, with the least
#: of them; another class of these; or a text.
ONE, LEAST, OTHER, TEXT = range(4)
SIGNED = pa.schema([("kind", pa.int8()), ("signature", pa.int64()), ("k1", pa.int64()), ("level", pa.int8()), ("payload", pa.binary())])


def _profile(k: int, percent: int):
    """Rows for the exchange. A task sends a signature once, so no signature, however common, meets in one task with all its
    classes; what is said of the other classes is dealt by itself. Texts are dealt by batches, so copies don't meet either. A text's
    payload is (id, n, k2, row, text hash)."""

    def rows_of(kind, signature, k1, level, payload=None) -> pa.RecordBatch:
        payload = pa.nulls(len(signature), pa.binary()) if payload is None else payload
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int8()), pa.array(signature, pa.int64()), pa.array(k1, pa.int64()), pa.array(level, pa.int8()), payload], schema=SIGNED)

    def passed(held: list[tuple]) -> pa.RecordBatch:
        sign, key, level = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((key, sign))
        sign, key, level = sign[order], key[order], level[order]
        first = np.concatenate([[True], sign[1:] != sign[:-1]])
        kind = np.where(first, np.where(np.append(~first[1:], False), LEAST, ONE), OTHER).astype(np.int8)
        order = np.argsort(key, kind="stable")  # rows of a class one after another take less room in the exchange
        return rows_of(kind[order], sign[order], key[order], level[order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0
        place = TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch, place = whole.slice(at, 2048), place + 1
                k1s, payloads = [], []
                for i, row, h, s in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "hash")), _sets(batch, k), strict=True):
                    key = set_key(s)
                    k1s.append(key[0])
                    payloads.append(np.array([i, len(s), key[1], row, h], np.int64).tobytes())
                    if len(s) and key[0] not in seen:
                        seen.add(key[0])
                        sign, level = signatures(s, percent)
                        held.append((sign.view(np.int64), np.full(len(sign), key[0], np.int64), level))
                        size += len(sign)
                yield rows_of(np.full(len(k1s), TEXT, np.int8), np.full(len(k1s), place), k1s, np.zeros(len(k1s), np.int8), pa.array(payloads, pa.binary()))
                if len(seen) > REMEMBERED:  # copies that come later are only repeated
                    seen.clear()
                if size >= HELD:
                    yield passed(held)
                    held, size = [], 0
        if size:
            yield passed(held)
        held.clear()
        pa.default_memory_pool().release_unused()

    return run, "kind byte, signature long, k1 long, level byte, payload binary"


PROFILE = pa.schema([*((c, pa.int64()) for c in ("id", "n", "k1", "k2", "row", "hash", "signature")), ("level", pa.int8())])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by signature and class: texts, and (signature, k1, level) where several classes have the signature.

    What is carried from batch to batch is one class of a signature that may still turn out to be shared.
    """
    carried: tuple | None = None  # signature, k1, level, whether it is known to be shared

    for batch in batches:
        kind, sign, key, level = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "signature", "k1", "level"))
        text = kind == TEXT
        values = np.frombuffer(b"".join(batch.column("payload").filter(pa.array(text)).to_pylist()), np.int64).reshape(-1, 5)
        again = np.concatenate([[False], (sign[1:] == sign[:-1]) & (key[1:] == key[:-1])])[: len(sign)]  # of a copy in another task
        other, own = (kind == OTHER) & ~again, (kind < OTHER) & (~again | (kind == LEAST))
        found = [(sign[other], key[other], level[other])]
        s, c, lv, known = sign[own], key[own], level[own], kind[own] == LEAST
        if carried:
            s, c, lv, known = np.append(carried[0], s), np.append(carried[1], c), np.append(carried[2], lv), np.append(carried[3], known)
        if len(s):
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            several = np.logical_or.reduceat(known, first) | (np.maximum.reduceat(c, first) != np.minimum.reduceat(c, first))
            last = s[-1], c[-1], lv[-1], bool(several[-1])
            several = np.repeat(several, np.diff(np.append(first, len(s))))
            found.append((s[several], c[several], lv[several]))
            carried = last
        sign, key, level = (np.concatenate(x) for x in zip(*found, strict=True))
        n, m = len(values), len(sign)
        columns = [pa.array(np.append(x, np.zeros(m, np.int64))) for x in (values[:, 0], values[:, 1])]
        columns.append(pa.array(np.append(batch.column("k1").to_numpy(zero_copy_only=False)[text], key)))
        columns += [pa.array(np.append(x, np.zeros(m, np.int64))) for x in (values[:, 2], values[:, 3], values[:, 4])]
        columns.append(pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(sign, pa.int64())]))
        columns.append(pa.array(np.append(np.zeros(n, np.int8), level).astype(np.int8)))
        yield pa.RecordBatch.from_arrays(columns, schema=PROFILE)


def families_of(shared: DataFrame, percent: int) -> DataFrame:
    """k1, family of the classes of shared(signature, k1, level) that may have links.

    Linked classes share `need` signatures at a level. Once too few shared ones have made classes leave, each class drops its
    need - 1 most frequent signatures. The rarest that two linked ones share stays with both: either has need - 1 more frequent
    ones that they share. So a passage in common, whose signatures many have, doesn't tie groups of near copies together.
    A row that is there twice, as rows of copies in several tasks may be, counts twice, which only keeps more.
    """
    need = F.element_at(F.array(*[F.lit(1 if level >= PLAIN else spare(level, percent)) for level in range(2 * PLAIN)]), F.col("level") + 1)
    edges, alike = shared, [F.min("k1").alias("least"), F.max("k1").alias("most"), F.count("*").alias("many")]
    for _ in range(LEAVING_ROUNDS):
        staying = edges.groupBy("k1", "level").agg(F.count("*").alias("have")).where(F.col("have") >= need).select("k1", "level")
        stayed = materialize(edges.select("signature", "k1", "level").join(staying, ["k1", "level"], "left_semi"), "jaccard-signatures")
        edges = materialize(stayed.join(stayed.groupBy("signature").agg(*alike).where("least < most"), "signature").select("signature", "k1", "level", "many"), "jaccard-signatures")
    # the most frequent need - 1 of each go; "many" orders signatures alike for all classes
    frequent_first = Window.partitionBy("k1", "level").orderBy(F.desc("many"), "signature")
    rare = materialize(edges.withColumn("place", F.row_number().over(frequent_first)).where(F.col("place") >= need).select("signature", "k1"), "jaccard-signatures")
    edges = rare.join(rare.groupBy("signature").agg(*alike).where("least < most"), "signature")
    return connected_components(edges.select(F.col("k1").alias("a"), F.col("least").alias("b")), "jaccard-families").withColumnsRenamed({"node": "k1", "root": "family"})


MEMBERS = pa.schema([("family", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("side", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("copies", pa.int64()), ("grams", pa.binary())])


def _members(k: int):
    """A row for each block pair that a class takes part in; a task sends a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows: list[tuple] = []
                for family, k1, k2, copies, own, blocks, s in zip(*(batch.column(c).to_pylist() for c in ("family", "k1", "k2", "copies", "block", "blocks")), _sets(batch, k), strict=True):
                    if set_key(s) != (k1, k2) or (k1, k2) in sent:  # another text with the same id and hash, or a copy
                        continue
                    sent.add((k1, k2))
                    packed = s.tobytes()
                    rows += [(family, min(own, x), max(own, x), int(own > x), k1, k2, copies, packed) for x in range(blocks)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), MEMBERS, strict=True)], schema=MEMBERS)
            if len(sent) > REMEMBERED:
                sent.clear()

    return run, "family long, low int, high int, side int, k1 long, k2 long, copies long, grams binary"


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, as the sum of separate counts for the fragments of the global order."""
    grams = np.concatenate([*left, *right]) if left or right else np.empty(0, np.uint64)
    distinct, places, counts = np.unique(grams, return_inverse=True, return_counts=True)
    at = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)
    shared = int((counts > 1).sum())
    column, row = at[places], np.repeat(np.arange(len(left) + len(right)), [len(s) for s in [*left, *right]])
    keep = column >= 0
    column, row = column[keep], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, shared, FRAGMENT):
        a, b = np.searchsorted(column, (first, first + FRAGMENT))
        segments = np.zeros((len(left) + len(right), min(FRAGMENT, shared - first)), np.float32)
        segments[row[a:b], column[a:b] - first] = 1
        total += segments[: len(left)] @ segments[len(left) :].T
    return total.astype(np.int64)


def least_labels(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links the least index that each index reaches."""
    labels, none = np.arange(len(linked)), len(linked)
    while True:
        new = np.minimum(labels, np.where(linked, labels[None, :], none).min(axis=1, initial=none))
        new = new[new]
        if (new == labels).all():
            return labels
        labels = new


def _verify(percent: int):
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("links", pa.int64())])

    def block(rows: list[tuple], two_sided: bool) -> Iterator[tuple[str, str, int]]:
        """For a block pair: (class, least class it reaches here, copies it links to here)."""
        rows = list({r[1:3]: r for r in rows}.values())
        rows.sort(key=lambda r: r[0])
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        names = [f"{r[1] & 0xFFFFFFFFFFFFFFFF:016x}{r[2] & 0xFFFFFFFFFFFFFFFF:016x}" for r in rows]
        sizes, copies = np.array([len(s) for s in sets]), np.array([r[3] for r in rows])
        cut = sum(r[0] == 0 for r in rows)
        left, right = (slice(0, cut), slice(cut, len(rows))) if two_sided else (slice(0, len(rows)),) * 2
        both = overlaps(sets[left], sets[right])
        union = sizes[left, None] + sizes[None, right] - both
        near = 100 * both >= percent * union
        linked = np.zeros((len(rows), len(rows)), bool)
        linked[left, right] |= near
        linked[right, left] |= near.T
        np.fill_diagonal(linked, False)
        order = np.argsort(np.array(names))
        labels = least_labels(linked[np.ix_(order, order)])
        for i, o in enumerate(order):
            if labels[i] != i or linked[o].any():
                yield names[o], names[order[labels[i]]], int(linked[o] @ copies)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, found = None, [], []
        def links() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], x.type) for i, x in enumerate(schema)], schema=schema)

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                for family, low, high, *row in zip(*(batch.column(c).to_pylist() for c in MEMBERS.names), strict=True):
                    if (family, low, high) != now:
                        found += block(rows, now[1] != now[2]) if len(rows) > 1 else []
                        now, rows = (family, low, high), []
                    rows.append(tuple(row))
                if len(found) > 10_000:
                    yield links()
                    found = []
        found += block(rows, now[1] != now[2]) if len(rows) > 1 else []
        yield links()

    return run, "a string, b string, links long"


def jaccard_join(docs: DataFrame, *, k: int = 3, percent: int = 90, row: Column | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_shingles, component_id, n_links.

    Two rows link when their sets of k-word shingles (A-Z lower-cased; fewer words: the whole sequence as one) have a
    Jaccard similarity of at least percent / 100. component_id: the least doc_id reachable by links. n_links: rows linked to.
    Null or wordless text: no shingles, no links, its own id. A null doc_id takes part like others, but is never the least
    id of a component that has another. Repeated rows link to each other. An empty table gives no rows.
    row: a long that tells rows apart. With it come the columns row and stays: whether the row is its component's first by id,
    null last, then class, then row; components of null ids have one too, and a row without shingles always stays.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is 50 to 100")
    ids = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text", (F.lit(0).cast("long") if row is None else row).alias("row"), F.xxhash64("text").alias("hash"))
    signed = ids.mapInArrow(*_profile(k, percent)).repartition(F.when(F.col("kind") == OTHER, F.xxhash64("signature", "k1")).otherwise(F.col("signature"))).sortWithinPartitions("signature", "k1")
    profile = materialize(signed.mapInArrow(_shared, "id long, n long, k1 long, k2 long, row long, hash long, signature long, level byte"), "jaccard-profile")
    sets = profile.where("signature IS NULL").select("id", "n", "k1", "k2", "row", "hash")
    classes = sets.where("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("id", "hash")).alias("text"), F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("least_id"), F.count("*").alias("copies"), F.first("n").alias("n"), *([] if row is None else [F.min(F.struct((F.col("id") == NO_ID).alias("no_id"), "id", "row")).alias("first")]))
    families = families_of(profile.where("signature IS NOT NULL").select("signature", "k1", "level"), percent)

    members = materialize(classes.join(families, "k1"), "jaccard-members")
    cut = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"), F.count("*").alias("many")).where("many > 1")
    placed = members.join(cut, "family").withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks").cast("long")).cast("int"))
    placed = placed.select(F.col("text.id").alias("id"), F.col("text.hash").alias("hash"), "family", "k1", "k2", "copies", "block", "blocks")
    if members.count() <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    rows = ids.select("id", "hash", "text").join(placed, ["id", "hash"]).mapInArrow(*_members(k))
    rows = rows.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")
    links = materialize(rows.mapInArrow(*_verify(percent)), "jaccard-links")
    roots = connected_components(links.select("a", "b"), "jaccard-components")
    key = F.concat(F.lpad(F.lower(F.hex("k1")), 16, "0"), F.lpad(F.lower(F.hex("k2")), 16, "0"))
    counts = links.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    named = classes.withColumn("key", key).join(roots.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"), *([] if row is None else [F.min(F.struct("first.no_id", "first.id", "k1", "k2", "first.row")).alias("stay")]))
    stay = [] if row is None else [F.when((F.col("stay.k1") == F.col("k1")) & (F.col("stay.k2") == F.col("k2")), F.struct("stay.id", "stay.row")).alias("stay")]
    named = named.join(least, "root").select("k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), *stay)
    real = F.when(F.col("id") != NO_ID, F.col("id"))
    kept = [] if row is None else ["row", ((F.col("n") == 0) | F.coalesce((F.col("stay.id") == F.col("id")) & (F.col("stay.row") == F.col("row")), F.lit(False))).alias("stays")]
    return sets.join(named, ["k1", "k2"], "left").select(
        real.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, real).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), *kept
    )
