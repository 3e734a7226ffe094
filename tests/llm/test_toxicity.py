import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from parley.llm import kernels as K
from parley.llm import queries, toxicity

SMALL = "/root/testdata/sf0.01"

SCHEMA = "doc_id long, text string, score string"


def corpus(n):
    rng = random.Random(8)
    words = ["".join(rng.choice("aeioubcdfg") for _ in range(5)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(60)]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(("Idiot", "moron,", "scum", "vexing" + rng.choice(words)))
        docs.append((i, " ".join(text), "x"))
        if i % 5 < 2:  # labelled rows are a fair sample, so that their share of positives is the class prior
            labels.append((i, int(bad)))
    return docs, labels


def test_unlabelled_toxic_texts_are_found(spark):
    docs, labels = corpus(900)
    frame = spark.createDataFrame(docs, SCHEMA)
    model = toxicity.fit(frame.where("doc_id < 600"), spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 600"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame, model).collect()}
    held = [i for i in range(600, 900)]
    right = sum(got[i].predicted == int(i % 6 == 0) for i in held)
    assert right / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_odd_rows(spark):
    docs, labels = corpus(300)
    model = toxicity.fit(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    rows = [(1, None, "x"), (2, "", "x"), (3, "idiot moron scum " + "so " * 100_000, "x"), (3, "idiot", "x"), (None, "...", "x")]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, SCHEMA), model).collect()
    assert len(got) == 5 and got[0].score == got[1].score == got[4].score < 0.5 and got[2].predicted == 1


def test_nothing_to_learn_from(spark):
    docs, empty = spark.createDataFrame(corpus(10)[0], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, empty) is None
    assert toxicity.score_toxicity(docs, None).where("score = 0 and predicted = 0").count() == 10
    assert toxicity.score_toxicity(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_risk_and_its_gradient_against_finite_differences():
    rng = np.random.default_rng(4)
    for prior, shift in ((0.1, 0.0), (0.4, 1.0), (0.3, -3.0)):
        z, positive = rng.normal(shift, 1, 30), np.arange(30) < 8
        plain = lambda x: [float(np.log(1 + np.exp(-s * x))) for s in (1, -1)]  # noqa: E731; loss as positive and as negative
        losses = np.array([plain(x) for x in z])
        inner = losses[~positive, 1].mean() - prior * losses[positive, 1].mean()
        value, grad = toxicity.risk(z, positive, prior)
        assert np.isclose(value, prior * losses[positive, 0].mean() + max(0, inner))
        if inner < 0:
            continue
        for i in range(30):
            step = np.zeros(30)
            step[i] = 1e-5
            slope = (toxicity.risk(z + step, positive, prior)[0] - toxicity.risk(z - step, positive, prior)[0]) / 2e-5
            assert np.isclose(grad[i], slope, atol=1e-8)


def test_a_step_leads_out_where_the_inner_part_is_negative():
    z, positive = np.array([3.0, 3.0, -4.0, -4.0]), np.array([True, True, False, False])
    value, grad = toxicity.risk(z, positive, 0.5)
    inner = lambda x: np.logaddexp(0, x[~positive]).mean() - 0.5 * np.logaddexp(0, x[positive]).mean()
    assert inner(z) < 0 and np.isclose(value, 0.5 * np.logaddexp(0, -3.0)) and inner(z - 0.1 * grad) > inner(z)


EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def held_buckets(text, seen):
    """Buckets of a text, by regular expression and one word at a time."""
    found = set()
    for word in re.findall(rb"[^ \t-\r" + re.escape(EDGE) + rb"]+", (text or "").encode().lower()):
        if word not in seen:
            size = lambda b: int(K.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0])
            short = [int(K.mix(np.array([(size(word[:k]) + k) % 2**64], np.uint64))[0]) for k in toxicity.PREFIXES if len(word) > k]
            seen[word] = {h % toxicity.BUCKETS for h in [size(word), *short]}
        found |= seen[word]
    return sorted(found)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the given tables")
def test_query_against_a_plain_version(spark):
    docs = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SMALL}/labels.parquet").to_pylist()}
    fold = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in docs}
    seen = {}
    held = {r["doc_id"]: held_buckets(r["text"], seen) for r in docs}
    learn = [r["doc_id"] for r in docs if fold[r["doc_id"]] and r["text"] is not None]
    known = [i for i, t in labels.items() if t is not None and zlib.crc32(str(i).encode()) % 5]
    bad = [i for i in learn if labels.get(i) == 1]
    prior = (sum(labels[i] for i in known) + 1) / (len(known) + 2)
    p, u = np.zeros(toxicity.BUCKETS), np.zeros(toxicity.BUCKETS)
    for i in bad:
        p[held[i]] += 1
    for i in learn:
        u[held[i]] += 1
    chosen = np.flatnonzero((p >= toxicity.MIN_POSITIVE) & (p / len(bad) / ((u + 1) / (len(learn) + 1)) > toxicity.MIN_LIFT))
    place = {b: k for k, b in enumerate(chosen.tolist())}
    slots = {i: [place[b] for b in held[i] if b in place] for i in held}
    lists = sorted(slots[i] for i in bad) + sorted(slots[i] for i in learn)
    rows, cols = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([c for x in lists for c in x])
    weights, bias = toxicity.train(rows, cols, np.arange(len(lists)) < len(bad), len(chosen), prior)
    want = {i: 1 / (1 + np.exp(-(weights[slots[i]].sum() + bias))) for i in held}
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, SMALL).collect()}
    assert set(got) == set(want) and len(chosen) > 100
    for i, r in got.items():
        assert abs(r.score - want[i]) < 1e-4 and r.held_out == (fold[i] == 0) and r.predicted == int(r.score >= 0.5)


def test_parts_cover_all_unlabelled_texts_and_repeat_exactly(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PART_TEXTS", 250)
    rows = [([0, 1],)] * 600 + [([2],)] * 250 + [([],)] * 150  # a third and more are copies
    slots = spark.createDataFrame(rows, "slots array<int>").repartition(3)
    positive = (np.array([1, 1]), np.array([2, 2], np.int32))
    weights, bias = toxicity.train_parts(slots, positive, 3, 0.3)
    again = toxicity.train_parts(slots, positive, 3, 0.3)
    assert (weights == again[0]).all() and bias == again[1]
    assert weights[2] > 0 > weights[0] and abs(weights[0] - weights[1]) < 1e-6


def test_learning_in_parts_and_from_all_labels_toxic(spark, monkeypatch):
    docs, labels = corpus(900)
    frame = spark.createDataFrame(docs, SCHEMA)
    monkeypatch.setattr(toxicity, "PART_TEXTS", 200)
    model = toxicity.fit(frame.where("doc_id < 600"), spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id < 600"))
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame, model).collect()}
    assert sum(got[i].predicted == int(i % 6 == 0) for i in range(600, 900)) / 300 > 0.95
    only = toxicity.fit(frame, spark.createDataFrame([(i, 1) for i in range(0, 60, 6)], "doc_id long, toxic int"))
    assert 0 < only.prior < 1 and np.isfinite(only.bias) and np.isfinite(only.weights).all()
