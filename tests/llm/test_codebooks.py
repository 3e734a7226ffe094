import hashlib
import math
import random
import struct

import duckdb
import pytest

from parley.llm import codebooks, queries

SCHEMA = "vec_id long, embedding array<float>, label int, _row string"
COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def exact(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((-(-len(v) // parts) for _, v, _ in kept), default=0)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            for k, xs in groups.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, labels = [], {}
    for i, v, label in kept:
        found = [near(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        labels[label] = labels.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in found), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    narrow = lambda e: e if e < 1 << 63 else None
    return sorted(((i, c, narrow(e), narrow(labels[label]), sha) for i, c, e, label in out), key=repr)


def found(spark, rows, report=None):
    frame = spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], SCHEMA)
    return sorted((tuple(r[c] for c in COLUMNS) for r in codebooks.compress(frame, report=report).collect()), key=repr)


def test_against_loops_with_many_equal_parts(spark):
    rng = random.Random(3)
    pool = [[exact(rng.gauss(0, 0.2)) for _ in range(2)] for _ in range(30)]
    rows = [(i, [x for _ in range(8) for x in pool[0 if i % 3 == 0 else rng.randrange(30)]], rng.choice([1, 2, None])) for i in range(400)]
    report = {}
    assert found(spark, rows, report) == brute(rows)
    assert report["distinct"] <= 8 * 30  # far fewer than 8 * 400 parts


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0] * 8, 1), (3, [1.0] * 8, 1), (3, [-0.3] * 8, None), (1, None, 1), (2, [None] * 8, 1), (4, [nan] * 8, 1), (5, [inf] + [0.0] * 7, 2), (None, [0.1] * 8, None), (6, [], 3), (7, [0.7] * 11, 3)]
    assert found(spark, rows) == brute([(i, [exact(x) if x is not None else None for x in v] if v is not None else None, label) for i, v, label in rows])
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1)]) == []
    assert found(spark, [(1, [], 1), (2, [], 1)]) == brute([(1, [], 1), (2, [], 1)])


def test_large_components_are_exact_and_too_large_ones_an_error(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-(1 << 20), 1 << 20) << 20) for _ in range(8)], i % 2) for i in range(60)]
    got = found(spark, rows)
    assert got == brute(rows) and any(r[3] is None for r in got)
    with pytest.raises(ValueError, match="too large"):
        found(spark, [(1, [1e30] * 8, 1)])


def test_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    embeddings = duckdb.sql(f"SELECT * FROM '{sf_dir}/embeddings.parquet'")  # noqa: F841
    wanted = duckdb.sql(queries.OP12_SQL).to_arrow_table().select(COLUMNS).to_pylist()
    got = queries.op12_code_compression(spark, sf_dir).toArrow().select(COLUMNS).to_pylist()
    key = lambda r: r["vec_id"]
    assert sorted(got, key=key) == sorted(wanted, key=key)
