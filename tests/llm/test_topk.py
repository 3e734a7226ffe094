import math
import random

import duckdb

from parley.llm import mtree, queries

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k, every, limit=lambda s: s):
    def sound(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if sound(v)]
    out = []
    for q, x in {(i, tuple(v)) for i, v in whole if i % every == 0}:
        scored = sorted((-limit(sum(a * b for a, b in zip(x, v, strict=False))), i) for i, v in whole if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, k=10, every=100):
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(frame, k, every).collect())


def exact(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def test_against_all_pairs_with_ties_and_many_copies(spark):
    rng = random.Random(9)
    vector = lambda: [exact(rng.gauss(0, 0.3)) for _ in range(6)]
    same = vector()
    rows = [(i, same if i % 3 == 0 else vector()) for i in range(2500)]
    assert found(spark, rows) == brute(rows, 10, 100)


def test_the_tree_splits_and_passes_over_rows_that_bounds_rule_out(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE_ROWS", 40)
    monkeypatch.setattr(mtree, "FANOUT", 4)
    rng = random.Random(11)
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(12)]
    rows = [(i, [exact(c + rng.gauss(0, 0.02)) for c in centres[i % 12]]) for i in range(2400)]
    report = []
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in mtree.top_k(frame, 10, 100, report).collect())
    assert got == brute(rows, 10, 100)
    assert len(report) > 3  # root, inner nodes, leaves
    assert sum(r["computed"] for r in report) < 0.5 * 24 * 2400 and sum(r["passed"] for r in report) > 0


def test_large_values_are_exact(spark):
    rows = [(100 * (i == 0) + i, [float(1 << 21) + i, -float(1 << 20) * i, 0.5]) for i in range(30)]
    assert found(spark, rows) == brute(rows, 10, 100)


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.25, -1.0]), (5, [0.25, -1.0]), (100, [0.0, 0.0]), (200, []), (7, [0.0, 0.0])]
    assert found(spark, rows) == brute(rows, 10, 100)
    assert found(spark, [(0, [1.0])]) == []
    assert mtree.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    embeddings = duckdb.sql(f"SELECT * FROM '{sf_dir}/embeddings.parquet'")  # noqa: F841
    wanted = duckdb.sql(queries.OP9_SQL).fetchall()
    got = queries.op9_exact_top_k(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(wanted)


def test_long_vectors_a_few_units_apart(spark, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE_ROWS", 32)
    monkeypatch.setattr(mtree, "FANOUT", 4)
    rng = random.Random(12)
    centre = [float(rng.randrange(-(1 << 17), 1 << 17)) for _ in range(3)]
    near = lambda: [exact(c + rng.randrange(-4, 5) / 64) for c in centre]
    rows = [(i, near()) for i in range(900)]  # whole components of about 1e8 that lie a few units apart
    assert max(abs(x) for _, v in rows for x in v) * 1024 > 1e8
    assert found(spark, rows) == brute(rows, 10, 100)


def test_scores_beyond_64_bits_count_as_the_nearest(spark):
    rng = random.Random(13)
    rows = [(i, [exact(rng.choice((-1, 1)) * 10.0 ** rng.randrange(0, 11)) for _ in range(2)]) for i in range(250)] + [(300, [3e9, 3e9]), (301, [-3e9, -3e9]), (400, [exact(3e37), 1.0])]
    limit = lambda s: min(max(s, -(1 << 63) + 1), (1 << 63) - 1)
    assert found(spark, rows) == brute(rows, 10, 100, limit)
    assert any(r[3] == (1 << 63) - 1 for r in found(spark, rows))
    few = [(0, [3e9, 0.0]), (7, [-3e9, 1.0]), (8, [-4e9, 1.0]), (9, [1.0, 0.0])]
    assert found(spark, few, 2) == brute(few, 2, 100, limit)
