import random
import re
import zlib

import duckdb

from parley.llm import queries, sharding

SCHEMA = "doc_id long, text string, shard string, _text string, _range int"


def found(spark, rows, shards=8, **options):
    return [r.asDict() for r in sharding.shard(spark.createDataFrame(rows, SCHEMA), shards, **options).collect()]


def check(rows, got, shards=8, tolerance=sharding.TOLERANCE):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted((repr(i), size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert all(0 <= s < shards for s in by)
    for members in by.values():
        assert sorted(r["slot"] for r in members) == list(range(len(members)))
    total, at = sum(size(t) for _, t, *_ in rows), 0
    ordered = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    for s in range(1, shards):
        at = sum(r["size"] for r in got if r["shard"] < s)
        # As near to the wanted bound as the tolerance, or as half of a row at the bound.
        edge = [r["size"] for r in [*[x for x in ordered if x["shard"] < s][-1:], *[x for x in ordered if x["shard"] >= s][:1]]]
        assert abs(at - total * s / shards) <= max(tolerance * total / shards, max(edge) / 2 if edge else 0) + 1e-6
    return by


def test_bytes_are_near_equal_and_slots_gapless(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randrange(0, 300) + str(i), "x", "y", 1) for i in range(3000)]
    by = check(rows, found(spark, rows, range_bytes=20_000))
    assert len(by) == 8


def test_a_text_with_a_third_of_all_rows_is_cut_and_other_groups_stay_whole(spark):
    rows = [(i, "hot text" * 20 if i % 3 == 0 else f"text {i // 6} " + "w" * (i // 6 % 90), "x", "y", 1) for i in range(6000)]
    report = []
    got = found(spark, rows, report=report, range_bytes=10_000)
    by = check(rows, got)
    shards = {}
    texts = {i: t for i, t, *_ in rows}
    for s, members in by.items():
        for r in members:
            shards.setdefault(texts[r["doc_id"]], set()).add(s)
    cut = {t for t, s in shards.items() if len(s) > 1}
    assert "hot text" * 20 in cut and len(cut) <= 3
    assert len(report) > 1  # probes were refined


def test_equal_rows_are_cut_too(spark):
    rows = [(7, "same", "x", "y", 1)] * 900 + [(None, None, "x", "y", 1)] * 300 + [(8, "", None, None, None)] * 50
    check(rows, found(spark, rows, range_bytes=500))


def test_odd_rows(spark):
    rows = [(1, "a" * 200_000, "x", "y", 1), (2, "", "x", "y", 1), (None, "b", "x", "y", 1), (2, None, None, None, None)]
    got = found(spark, rows)
    check(rows, got)
    assert set(got[0]) == {"doc_id", "text", "_text", "_range", "size", "text_crc32", "shard", "slot"}
    assert {r["_text"] for r in got} == {"y", None} and {r["_range"] for r in got} == {1, None}
    assert found(spark, []) == []
    assert [(r["shard"], r["slot"]) for r in found(spark, rows[:1], shards=1)] == [(0, 0)]


def test_one_exchange_and_no_python(spark):
    plan = sharding.shard(spark.createDataFrame([(i, str(i), "", "", 1) for i in range(100)], SCHEMA), 8, ["doc_id"])
    text = plan._jdf.queryExecution().explainString(plan._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert len(re.findall(r"Exchange", text)) == 1
    assert not re.search("Python|Pandas|Arrow", text)


def test_files_hold_whole_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}" * (i % 9), "s", "t", i) for i in range(300)], SCHEMA).drop("shard")
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.select("doc_id", "text", "_range").exceptAll(docs.select("doc_id", "text", "_range")).count() == 0 and back.count() == 300
    assert {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_query_over_whole_documents(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    got = [r.asDict() for r in queries.op13_sharding(spark, sf_dir).collect()]
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    check(rows, got)
