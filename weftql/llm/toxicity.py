"""Toxic passages as maximum-scoring segments of token log-odds.

Learning: labelled documents (a bounded sample) give document frequencies of tokens - words and their prefixes of 4 to 9
bytes - in toxic and in clean texts. A token's weight is its log-odds with an informative Dirichlet prior, less PRUDENCE
standard errors. Tokens whose toxic share could be chance (binomial tail, corrected for the number of tokens) weigh nothing.
Documents that share their first words or the least hash of their shingles count once, so copies don't vouch for each other.
A word scores the weight of the longest token known of it; a token that clean documents have often, without standing out, is
known to weigh nothing. Any other word scores a small negative drift, which makes the expected score of clean text negative.

Scoring: one linear scan finds all maximal scoring segments (Ruzzo and Tompa 1999). A segment of score s in n words has the
extreme-value tail 1 - exp(-K n exp(-lambda s)); lambda solves the moment equation of the clean background, K is fitted to
the best segments of clean documents. The significant segments' normalised scores are summed, and a logistic curve over the
sums of the labelled documents turns them into a probability.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftql.llm.common import materialize
from weftql.llm.textscan import LOWER_BLANK, octets, shingle_sets

#: Bound of the classifier's sample: labelled documents. Its vocabulary has no other; tokens are tested where their counts are.
MAX_LABELLED = 200_000
PREFIXES = range(4, 10)
PRIOR_DOCS, RISK, PRUDENCE, DRIFT = 10.0, 0.01, 1.0, -0.15
MAX_P, BIN = 0.05, 0.5
#: In the fit of the logistic curve, and only there, a strength above this counts as this: the curve has long been flat there,
#: and single huge strengths would otherwise decide its slope.
FIT_TOP = 20.0
#: Lower-cased ASCII letters and all bytes beyond ASCII stay; the rest is blank.
LETTERS = bytes(b if b >= 128 or chr(b).islower() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(LETTERS).split()


def tokens_of(word: bytes) -> list[bytes]:
    """The word itself, marked, and its prefixes, longest first."""
    return [b"=" + word, *(word[:n] for n in reversed(PREFIXES) if n <= len(word))]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score), left to right, in one pass."""
    out: list[list] = []  # begin, end, total before, total after
    total, at = 0.0, 0
    for i in np.flatnonzero(scores > 0).tolist():
        total += DRIFT * (i - at)
        now = [i, i + 1, total, total := total + float(scores[i])]
        at = i + 1
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= now[2]:
                j -= 1
            if j < 0 or out[j][3] >= now[3]:
                out.append(now)
                break
            now = [out[j][0], now[1], out[j][2], now[3]]
            del out[j:]
    return [(b, e, after - before) for b, e, before, after in out]


class Model:
    """Weights of tokens, the background's lambda and K, and the logistic curve."""

    def __init__(self, weights: dict[bytes, float], lam: float = 1.0, k: float = 1.0, slope: float = 1.0, offset: float = -2.0):
        self.weights, self.lam, self.k, self.slope, self.offset = weights, lam, k, slope, offset

    def scorer(self):
        cache: dict[bytes, float] = {}
        weights = self.weights

        def score(word: bytes) -> float:
            found = cache.get(word)
            if found is None:
                if len(cache) > 400_000:
                    cache.clear()
                found = cache[word] = next((weights[t] for t in tokens_of(word) if t in weights), 0.0) or DRIFT
            return found

        return lambda words: np.fromiter(map(score, words), np.float64, len(words))

    def significant(self, found: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float, float]]:
        """(begin, end, normalised score, p) of segments unlikely in n clean words."""
        out = []
        for b, e, s in found:
            p = -math.expm1(-self.k * max(n, 1) * math.exp(-min(self.lam * s, 700)))
            if p <= MAX_P:
                out.append((b, e, max(0.0, self.lam * s - math.log(max(self.k * n, 1.0))), p))
        return out

    def probability(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * strength + self.offset))))


def learnt_from(doc_id, folds: int = 3, held: int = 1):
    """Rows that learning may use: those whose id's checksum isn't in the held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != held, F.lit(True))


def _document_frequencies(model=None):
    """(token, toxic, clean): labelled texts of a task that have it, of tokens in words that the model finds toxic, or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean, toxic = counts = Counter(), Counter()
        scorer = model and model.value.scorer()

        def passed() -> pa.RecordBatch:
            tokens = list(clean.keys() | toxic.keys())
            return pa.RecordBatch.from_pydict({"token": pa.array(tokens, pa.binary()), **{name: pa.array([c[t] for t in tokens], pa.int64()) for name, c in (("toxic", toxic), ("clean", clean))}})

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = list(set(words_of(text)))
                if scorer:
                    words = [words[i] for i in np.flatnonzero(scorer(words) > 0)]
                counts[label].update({t for w in words for t in tokens_of(w)})
            if len(clean) + len(toxic) > 500_000:
                yield passed()
                clean.clear()
                toxic.clear()
        yield passed()

    return run, "token binary, toxic long, clean long"


def _weights(n_toxic: int, n_clean: int, tests: int):
    """(token, weight) of the tokens that log_odds knows, from (token, toxic, clean)."""
    schema = pa.schema([("token", pa.binary()), ("weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, toxic, clean = (batch.column(c).to_pylist() for c in ("token", "toxic", "clean"))
            found = log_odds(dict(zip(tokens, toxic, strict=True)), dict(zip(tokens, clean, strict=True)), n_toxic, n_clean, tests)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.float64())], schema=schema)

    return run, "token binary, weight double"


def _hiding(model):
    """Of tokens without a weight those that keep a word from a shorter token's weight; no others change a score."""

    def hides(token: bytes) -> bool:
        stem, end = (token[1:], len(token)) if token[:1] == b"=" else (token, len(token))
        return any(stem[:n] in model.value.weights for n in PREFIXES if n < end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"token": pa.array([t for t in batch.column("token").to_pylist() if hides(t)], pa.binary())})

    return run, "token binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, toxic and two signatures of the text that near copies are likely to share."""
    for batch in batches:
        texts = octets(batch.column("text"))
        least = [int(s[0]) if len(s) else 0 for s in shingle_sets(texts)]
        first = [hash_words(t.translate(LOWER_BLANK).split()[:8]) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(np.array(least, np.uint64).view(np.int64)), pa.array(first, pa.int64())], names=["doc_id", "toxic", "least", "first"])


def hash_words(words: list[bytes]) -> int:
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "big", signed=True)


def _strengths(model):
    """For labelled texts: counts by label of (kind, bin): document strengths, best scores of segments, and word scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, counts = model.value.scorer(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                scores = scorer(words_of(text))
                found = segments(scores)
                strength = sum(x[2] for x in model.value.significant(found, len(scores)))
                counts["strength", round(strength / BIN), toxic] += 1
                if not toxic:
                    counts["best", round(max((s for *_, s in found), default=0.0) / BIN), 0] += 1
                    counts["words", 0, 0] += len(scores)
                    for s in scores[scores > 0].tolist():
                        counts["score", round(s / BIN), 0] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_pydict({"kind": pa.array([k[0] for k in keys], pa.string()), "bin": pa.array([k[1] for k in keys], pa.int32()), "toxic": pa.array([k[2] for k in keys], pa.int32()), "n": pa.array(list(counts.values()), pa.int64())})

    return run, "kind string, bin int, toxic int, n long"


def log_odds(toxic: dict[bytes, int], clean: dict[bytes, int], n_toxic: int, n_clean: int, tests: int) -> dict[bytes, float]:
    """Weights of the tokens that stand out among so many tested, by log-odds with a Dirichlet prior in proportion to the token's overall frequency."""
    out = {}
    for token, t in toxic.items():
        c = clean.get(token, 0)
        prior = PRIOR_DOCS * (t + c) / (n_toxic + n_clean)
        at, ac = t + prior, c + prior
        if binomial_tail(t, t + c, n_toxic / (n_toxic + n_clean)) > RISK / tests:
            if c >= 3:
                out[token] = 0.0
            continue
        delta = math.log(at / max(n_toxic + PRIOR_DOCS - at, 0.5)) - math.log(ac / max(n_clean + PRIOR_DOCS - ac, 0.5))
        error = math.sqrt(1 / at + 1 / ac)
        if delta > PRUDENCE * error:
            out[token] = delta - PRUDENCE * error
    return out


def binomial_tail(k: int, n: int, p: float) -> float:
    """P[Bin(n, p) >= k] where k is over n p, else 1: the sum falls at least geometrically from its first term."""
    if k <= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, j = term, k
    while j < n and term > total * 1e-12:
        term *= (n - j) / (j + 1) * p / (1 - p)
        total, j = total + term, j + 1
    return total


def background_lambda(scores: dict[int, int], words: int) -> float:
    """lambda > 0 with the clean background's mean of exp(lambda score) equal to 1."""
    positive = sum(scores.values())
    if not positive or not words:
        return 1.0
    mean = lambda x: sum(n * math.exp(x * b * BIN) for b, n in scores.items()) / words + (words - positive) / words * math.exp(x * DRIFT) - 1
    low, high = 0.0, 1.0
    while mean(high) < 0 and high < 64:
        high *= 2
    if mean(1e-3) >= 0:  # the background would drift upwards: no lambda; take a cautious one
        return 0.1
    low = 1e-3
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if mean(middle) < 0 else (low, middle)
    return min(low, 5.0)


def fit_logistic(strengths: dict[tuple[int, int], int]) -> tuple[float, float]:
    """Slope and offset by Newton's method with a little shrinkage, over counts of (bin, toxic)."""
    x, y, n = (np.array(v, float) for v in zip(*((b * BIN, t, c) for (b, t), c in strengths.items()), strict=True)) if strengths else (np.zeros(1),) * 3
    x = np.minimum(x, FIT_TOP)
    at = np.array([0.5, -2.0])

    def loss(at: np.ndarray) -> float:
        z = at[0] * x + at[1]
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + 0.05 * at[0] ** 2 + 0.005 * at[1] ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -30, 30)))
        w = n * p * (1 - p)
        g = np.array([(n * (y - p) * x).sum() - 0.1 * at[0], (n * (y - p)).sum() - 0.01 * at[1]])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step, now = np.linalg.solve(h, g), loss(at)
        while loss(at + step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if np.abs(step).max() < 1e-9:
            break
        at = at + step
    return max(float(at[0]), 0.0), float(at[1])


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from labelled rows outside the held-out fold.

    A document labelled several times is toxic if any label says so; null labels and ids are no labels. Labels beyond
    max_labelled are thinned by a hash of the id; those kept are broadcast.
    """
    context = docs.sparkSession.sparkContext
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnt_from(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if (n := usable.count()) > max_labelled:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * 0.98 * max_labelled / n))
    # the documents are read once; what follows reads the bounded sample's texts
    labelled = materialize(docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("doc_id", "text", "toxic"), "toxicity-labelled")
    signed = materialize(labelled.mapInArrow(_signatures, "doc_id long, toxic int, least long, first long"), "toxicity-signatures")
    alone = signed.groupBy("least").agg(F.min("doc_id").alias("doc_id")).join(signed.groupBy("first").agg(F.min("doc_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id").distinct()
    rows = labelled.join(F.broadcast(alone), "doc_id").select("text", "toxic")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Model({}, offset=-4.0)

    def frequencies(rows: DataFrame, model=None) -> DataFrame:
        return rows.select("text", "toxic").mapInArrow(*_document_frequencies(model)).groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    tested = materialize(frequencies(rows.where("toxic IN (0, 1)")).where("toxic >= 3"), "toxicity-tokens")
    weighed = tested.mapInArrow(*_weights(sizes[1], sizes[0], tested.count()))
    positive = {bytes(r["token"]): r["weight"] for r in weighed.where("weight > 0").collect()}
    found = context.broadcast(Model(positive))

    def hiding(tokens: DataFrame) -> dict[bytes, float]:
        return {bytes(r["token"]): 0.0 for r in tokens.select("token").mapInArrow(*_hiding(found)).collect()}

    model = Model({**hiding(weighed.where("weight = 0")), **positive})
    model.weights = {**hiding(frequencies(rows.where("toxic = 0"), context.broadcast(model)).where("clean >= 3")), **model.weights}

    def counted():
        kinds: dict[str, dict] = {"strength": {}, "best": {}, "score": {}, "words": {}}
        for r in rows.mapInArrow(*_strengths(context.broadcast(model))).groupBy("kind", "bin", "toxic").agg(F.sum("n").alias("n")).collect():
            kinds[r["kind"]][(r["bin"], r["toxic"]) if r["kind"] == "strength" else r["bin"]] = r["n"]
        return kinds

    kinds = counted()
    words = kinds["words"].get(0, 0)
    model.lam = background_lambda(kinds["score"], words)
    mean_words = max(1.0, words / sizes[0])
    # K from the median of clean documents' best scores: half of them lie below ln(K n / ln 2) / lambda
    best, half, below = kinds["best"], sizes[0] / 2, 0
    median = next((b * BIN for b in sorted(best) if (below := below + best[b]) >= half), 0.0)
    model.k = min(1.0, max(math.log(2) * math.exp(min(model.lam * median, 50.0)) / mean_words, 1e-4))
    model.slope, model.offset = fit_logistic(counted()["strength"])
    return model


def _scan(model):
    schema = pa.schema([("score", pa.float64()), ("n_words", pa.int64()), ("passages", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.value.scorer()
        for batch in batches:
            scores, sizes, passages = [], [], []
            for text in batch.column("__text").to_pylist():
                each = scorer(words_of(text))
                found = model.value.significant(segments(each), len(each))
                scores.append(model.value.probability(sum(x[2] for x in found)))
                sizes.append(len(each))
                passages.append([{"begin": b, "end": e, "p": p} for b, e, _, p in found])
            kept = [i for i, f in enumerate(batch.schema.names) if f != "__text"]
            arrays = [pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(passages, schema.field("passages").type)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *arrays], schema=pa.schema([*(batch.schema.field(i) for i in kept), *schema]))

    return run


def score_toxicity(docs: DataFrame, model: Model, *, keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.7) -> DataFrame:
    """One row per row of docs(text, ...): keep, score, n_words, passages (spans of words with their tail probability), predicted.

    Null and empty texts have no passage and get the score of a text without any. Rows are scored one by one, by their text alone.
    """
    out = docs.select(*keep, F.col("text").alias("__text"))
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name != "__text")
    scored = out.mapInArrow(_scan(docs.sparkSession.sparkContext.broadcast(model)), f"{names}, score double, n_words long, passages array<struct<begin: long, end: long, p: double>>")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
