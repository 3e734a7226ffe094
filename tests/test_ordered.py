"""Numbers, sums, medians and folds against plain Python, with keys that hold most rows."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parley.operators import folds, ordered, signal


def plan_of(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_running_sums_of_a_hot_key_over_ranges(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 50}" if i % 5 else None, i, rng.choice([None, 1, 2, 3]), "x") for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at long, v long, _part string")
    got = ordered.running(df, ["k"], ["at"], {"total": F.col("v")}, parts=7)
    assert got.columns == ["k", "at", "v", "_part", "total"]
    sums, wanted = {}, []
    for k, at, v, x in sorted(rows, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + (v or 0)
        wanted.append((k, at, v, x, sums[k]))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == wanted
    numbers = ordered.numbered(df, [], [F.col("at").desc()], parts=5).orderBy("at").collect()
    assert [r.position for r in numbers] == list(range(3000, 0, -1))
    assert ordered.numbered(df.limit(0), ["k"], ["at"]).count() == 0


def test_numbering_of_a_whole_table_has_no_single_task(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    plan = plan_of(ordered.numbered(df, [], ["v", "id"], parts=4))
    # The one row a range that is carried may meet in one task; the rows may not.
    assert plan.count("SinglePartition") <= 1 and "hashpartitioning(_part" in plan


@pytest.mark.parametrize("few", [3, 4096])
def test_upper_median_of_hot_and_odd_keys(spark, few):
    rng = random.Random(2)
    nan, inf = float("nan"), float("inf")
    groups = {
        "hot": [rng.lognormvariate(0, 40) * rng.choice([-1, 1]) for _ in range(4001)],
        "ties": [rng.choice([1.0, 2.0]) for _ in range(1000)],
        "one": [5.0],
        "two": [5.0, 7.0],
        "nulls": [None, None],
        "mixed": [None, nan, inf, -inf, 3.0, nan, nan],
        "low": [-inf, -inf, 1.0],
        "wide": [1.7e308, -1.7e308, 1e-300, -1e-300, 0.0, 5e-324],
        None: [1.0, 2.0, 3.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")

    def wanted(vs):
        kept = sorted((v for v in vs if v is not None), key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))
        return repr(kept[len(kept) // 2] if kept else None)

    got = {r.k: repr(r["median"]) for r in ordered.upper_median(df, ["k"], "v", few).collect()}
    assert got == {k: wanted(vs) for k, vs in groups.items()}
    assert [repr(r["median"]) for r in ordered.upper_median(df.where("k = 'hot'"), [], "v", few).collect()] == [wanted(groups["hot"])]
    assert ordered.upper_median(df.limit(0), ["k"], "v", few).count() == 0
    assert "collect_list" not in plan_of(ordered.upper_median(df, ["k"], "v", few))


def loop(rows):
    floors, out = {}, []
    for s, ts, level in sorted(rows, key=lambda r: (repr(r[0]), r[1], r[2])):
        floor = floors.get(s, level)
        speech = level > max(3 * floor, 120)
        floor = min(floor, level) if speech else floor + (level - floor) * (0.25 if level < floor else 0.02)
        floors[s] = floor
        out.append((s, ts, level, speech, floor))
    return out


def test_gate_of_a_session_that_crosses_ranges_equals_a_loop(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"s{i % 40}" if i % 7 else None, i, rng.choice([20.0, 60.0, 90.0, 500.0, 900.0]) * rng.random()) for i in range(6000)]
    df = spark.createDataFrame(rows, "session string, ts_ms long, level double")
    report = []
    got = signal.gated(df, ["session"], parts=9, report=report).collect()
    assert sorted(map(tuple, got), key=lambda r: (repr(r[0]), r[1], r[2])) == loop(rows)
    assert report and report[0] >= 5 and len(report) <= 4  # ranges side by side, and few rounds


def test_a_fold_that_never_forgets_is_exact_too(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), "id")

    def step(total, rows):
        total, out = total or 0, []
        for v in rows.column("id").to_pylist():
            total = (total * 31 + v) % 1_000_003
            out.append(total)
        return total, [pa.array(out, pa.int64())]

    report = []
    got = [r.total for r in folds.scan(df, ["k"], ["id"], step, "total long", parts=6, report=report).orderBy("id").collect()]
    total, wanted = 0, []
    for v in range(1000):
        total = (total * 31 + v) % 1_000_003
        wanted.append(total)
    assert got == wanted and 2 < len(report) <= 6
    assert folds.scan(df.limit(0), ["k"], ["id"], step, "total long").count() == 0


def test_gate_report_and_pacing_equal_loops(spark):
    rng = random.Random(4)
    rows = [(f"s{i % 3}", i, 50.0 + 400 * (rng.random() < 0.05 * (1 + i // 300)) + rng.random()) for i in range(1500)]
    frames = signal.gated(spark.createDataFrame(rows, "session string, ts_ms long, level double"), ["session"])
    made = loop(rows)
    for r in signal.gate_report(frames, ["session"]).collect():
        mine = [m for m in made if m[0] == r.session]
        floors, tail = sorted(m[4] for m in mine), sorted(m[4] for i, m in enumerate(mine) if 3 * i >= 2 * len(mine))
        assert (r.median_floor, r.tail_floor, r.peak_floor) == (floors[len(floors) // 2], tail[len(tail) // 2], floors[-1])
        assert (r.accepted, r.accepted_fixed) == (sum(m[3] for m in mine), sum(m[2] > 450 for m in mine))
    for r in signal.paced_inferences(frames, ["session"]).collect():
        waited, idle, pace, heard, runs = 0, 0, 1, False, 0
        for m in (m for m in made if m[0] == r.session):
            waited, heard = waited + 1, heard or m[3]
            if waited >= pace * 10:
                idle = 0 if heard else idle + 1
                pace = 1 if heard else min(3, pace + 1) if idle >= 2 else pace
                waited, heard, runs = 0, False, runs + 1
        assert r.inferences == runs


def test_a_million_frames_in_one_session_take_linear_time(spark):
    import time

    took = []
    for n in (100_000, 1_000_000):
        frames = spark.range(n).select(F.lit("a").alias("session"), F.col("id").alias("ts_ms"), (F.pmod(F.xxhash64("id"), F.lit(300)) / 1.0).alias("level"))
        begun = time.perf_counter()
        signal.gated(frames, ["session"]).write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - begun)
    assert took[1] < 25 * took[0]  # ten times the frames; a square would be a hundred
