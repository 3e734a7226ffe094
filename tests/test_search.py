"""The stored index against one made afresh."""

import random

from parley.operators import search
from pyspark.sql import functions as F

WORDS = "the theme nation action billing биллинга über zebra a an".split()


def docs(spark, rows):
    return spark.createDataFrame(rows, "ref_id string, body string")


def same(index, rows, spark):
    for query in ("the", "a", "the tion", "биллин", "UBER", "zebra the", '"', "*", "a OR", ""):
        got = [tuple(r) for r in index.search(query, 1000).collect()]
        assert got == [tuple(r) for r in search.search(docs(spark, rows), query, 1000).collect()], query


def test_changes_by_document_equal_an_index_made_afresh(spark, tmp_path):
    rng = random.Random(1)
    body = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12)))
    rows = {f"d{i:03}": body() for i in range(120)}
    index = search.SearchIndex(spark, f"file://{tmp_path}/index")
    assert index.search("the").count() == 0
    assert index.change(docs(spark, list(rows.items()))) == 0
    same(index, list(rows.items()), spark)
    changed = {f"d{i:03}": body() for i in range(0, 150, 7)}
    gone = [f"d{i:03}" for i in range(0, 120, 11)]
    # A document that is both removed and given anew is there.
    assert index.change(docs(spark, list(changed.items())), docs(spark, [(g, None) for g in gone])) == 1
    rows = {k: v for k, v in rows.items() if k not in gone} | changed
    same(index, list(rows.items()), spark)
    index.change(docs(spark, list(changed.items())), docs(spark, [(g, None) for g in gone]))  # again: nothing changes
    same(index, list(rows.items()), spark)
    small = index.compact(f"file://{tmp_path}/small")
    assert small.batches() == [0]
    same(small, list(rows.items()), spark)


def test_a_change_that_is_not_committed_is_not_there(spark, tmp_path):
    index = search.SearchIndex(spark, f"file://{tmp_path}/index")
    index.change(docs(spark, [("a", "the one")]))
    search.postings(docs(spark, [("b", "the other")])).withColumn("head", F.substring("term", 1, 2)).write.partitionBy("head").parquet(f"{tmp_path}/index/postings/batch=1")
    assert [r.ref_id for r in index.search("the").collect()] == ["a"]
    assert index.change(docs(spark, [("c", "the third")])) == 1  # takes the place of what was left
    assert sorted(r.ref_id for r in index.search("the").collect()) == ["a", "c"]


def test_a_search_reads_the_partitions_of_its_words(spark, tmp_path):
    index = search.SearchIndex(spark, f"file://{tmp_path}/index")
    index.change(docs(spark, [(str(i), " ".join(WORDS)) for i in range(50)]))
    hits = index.hits(["th", "tion"])
    plan = hits._jdf.queryExecution().explainString(hits._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "PartitionFilters: [" in plan and "head#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    scan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in scan
    assert len({r.word for r in hits.collect()}) == 1  # the, theme; no word begins with tion
