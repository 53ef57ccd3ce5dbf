"""The vocabulary that toxicity learns from has no bound besides the sample's."""

import random
import zlib
from itertools import islice, product

from weftql.llm import toxicity


def test_rare_toxic_word_among_many_common_ones(spark):
    rng = random.Random(3)
    common = ["".join(x) for x in islice(product("bcdfghklmnprstvwz", repeat=5), 0, None, 47)]  # with their prefixes over 50,000 tokens
    ids = list(islice((i for i in range(1000) if zlib.crc32(str(i).encode()) % 3 != 1), 60))
    rows = []
    for n, i in enumerate(ids):
        words = [f"q{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}"] + rng.sample(common, len(common)) + ["vilest"] * (n < 16)
        rows.append((i, " ".join(words), int(n < 20)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert len({t for w in common for t in toxicity.tokens_of(w.encode())}) > 50_000
    assert model.weights.get(b"=vilest", 0) > 0
    assert set(model.weights) == set(toxicity.tokens_of(b"vilest"))
