"""Changes of stored tables against a dictionary, and what they touch."""

import os

import pytest
from pyspark.sql import functions as F

from parley.sources.stored import StoredTable


def made(spark, tmp_path, rows=None, buckets=8):
    rows = rows if rows is not None else [(m, v, f"b{m}-{v}") for m in range(30) for v in range(3)]
    return StoredTable.create(spark.createDataFrame(rows, "meeting_id long, version int, body string"), f"file://{tmp_path}/t", ["meeting_id"], buckets)


def held(table):
    return {(r.meeting_id, r.version): r.body for r in table.rows().collect()}


def files(tmp_path):
    return {os.path.join(d, f) for d, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".parquet")}


def test_changes_equal_a_dictionary_and_repeat_without_effect(spark, tmp_path):
    table = made(spark, tmp_path)
    wanted = {(m, v): f"b{m}-{v}" for m in range(30) for v in range(3)}
    new = spark.createDataFrame([(1, 1, "x"), (99, 0, "y"), (None, 0, "z")], "meeting_id int, version long, body string")
    for _ in range(2):
        table.upsert(new, ["meeting_id", "version"])
        wanted |= {(1, 1): "x", (99, 0): "y"}
        assert {k: v for k, v in held(table).items() if k[0] is not None} == wanted
    assert table.rows().where("meeting_id IS NULL").count() >= 1
    table.delete(spark.createDataFrame([(2,), (3,), (500,)], "meeting_id long"), ["meeting_id"])
    table.replace(spark.createDataFrame([(4, 0, "only")], "meeting_id long, version int, body string"), ["meeting_id"])
    table.update((F.col("version") == 2) & (F.col("meeting_id") < 10), {"body": F.lit("late")})
    wanted = {k: v for k, v in wanted.items() if k[0] not in (2, 3, 4)} | {(4, 0): "only"}
    wanted = {k: "late" if k[1] == 2 and k[0] < 10 else v for k, v in wanted.items()}
    assert {k: v for k, v in held(table).items() if k[0] is not None} == wanted
    table.upsert(spark.createDataFrame([(5, 0, "no"), (5, 7, "yes")], "meeting_id long, version int, body string"), ["meeting_id", "version"], keep_old=True)
    assert held(table)[5, 0] == wanted[5, 0] and held(table)[5, 7] == "yes"


def test_only_touched_buckets_are_written_and_an_emptied_one_is_empty(spark, tmp_path):
    table = made(spark, tmp_path, [(1, 0, "a"), (2, 0, "b")], buckets=16)
    before = files(tmp_path)
    assert len(table.delete(spark.createDataFrame([(1,)], "meeting_id long"), ["meeting_id"])) == 1
    after = files(tmp_path)
    assert held(table) == {(2, 0): "b"}
    assert len({os.path.dirname(f) for f in before ^ after}) == 1
    assert table.update(F.col("meeting_id") == 77, {"body": F.lit("x")}) == [] and files(tmp_path) == after


def test_errors(spark, tmp_path):
    table = made(spark, tmp_path)
    with pytest.raises(LookupError):
        table.update_one(F.col("meeting_id") == 77, {"body": F.lit("x")})
    with pytest.raises(ValueError):
        table.delete(spark.createDataFrame([(1,)], "version int"), ["version"])
    with pytest.raises(ValueError):
        table.update(F.col("version") == 1, {"meeting_id": F.lit(1)})


def test_terms_of_the_same_place_or_id_are_replaced(spark, tmp_path):
    schema = "id long, surface string, canonical string, language string, scope string, meeting_id long, kind int"
    old = spark.createDataFrame([(1, "a", "A", "en", "global", None, 0), (2, "b", "B", "en", "meeting", 5, 0), (3, "c", "C", "en", "global", None, 0)], schema)
    table = StoredTable.create(old, f"file://{tmp_path}/terms", ["surface"], 8)
    new = spark.createDataFrame([(9, "a", "AA", "en", "global", None, 0), (3, "moved", "CC", "en", "global", None, 0)], schema)
    for _ in range(2):
        table.write_terms(new)
        assert sorted((r.id, r.surface, r.canonical) for r in table.rows().collect()) == [(2, "b", "B"), (3, "moved", "CC"), (9, "a", "AA")]
