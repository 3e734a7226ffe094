import math
from collections import Counter

import numpy as np
import pyarrow as pa

from parley.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"
TRAIN = [(i, t, l, "x") for i, (t, l) in enumerate([("the cat and the dog are here", "en"), ("der hund und die katze sind hier", "de"), ("le chat et le chien sont ici", "fr")] * 4)]


def brute_bits(text: bytes, samples: list[bytes], order: int) -> float:
    """Code length of a text from counts kept in plain dictionaries."""
    counts: dict[bytes, Counter] = {}
    for sample in samples:
        padded = b"\0" * order + sample
        for i in range(order, len(padded)):
            for d in range(order + 1):
                counts.setdefault(padded[i - d : i], Counter())[padded[i]] += 1
    total, padded = 0.0, b"\0" * order + text
    for i in range(order, len(padded)):
        for d in range(order, -2, -1):
            if d < 0:
                total += 8
                break
            seen = counts.get(padded[i - d : i])
            if seen is None:
                continue
            n, q = sum(seen.values()), len(seen)
            if seen[padded[i]]:
                total -= math.log2(seen[padded[i]] / (n + q))
                break
            total -= math.log2(q / (n + q))
    return total


def test_code_lengths_equal_those_of_plain_dictionaries(spark):
    model = langid.fit(spark.createDataFrame(TRAIN, SCHEMA), order=3)
    texts = ["the hund", "x", "zzzé le chat 9", ""]
    got = model.score(pa.array(texts))
    for k, lang in enumerate(model.languages):
        samples = [r[1].encode() for r in TRAIN if r[2] == lang]
        wanted = [brute_bits(t.encode(), samples, 3) for t in texts]
        assert np.allclose(got[:, k], wanted, rtol=1e-4, atol=1e-3)


def test_null_empty_long_and_repeated_texts(spark):
    model = langid.fit(spark.createDataFrame(TRAIN, SCHEMA))
    rows = [(1, None, "en", "x"), (2, "", "en", "x"), (3, "12 34 !", None, "x"), (4, "the dog and the cat " * 9000, None, "x"), (4, "the dog and the cat " * 9000, None, "x"), (None, "und die katze", None, "x")]
    got = langid.identify(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "en", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got)
    assert got[0].score == 0 and got[3].score == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.fit(empty) is None
    assert langid.identify(empty, None).count() == 0
    assert langid.identify(spark.createDataFrame(TRAIN, SCHEMA), None).where("lang_pred <> 'und'").count() == 0
