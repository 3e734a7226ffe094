"""Measurement reports: agreement, sweeps, histograms and verdicts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.functions import scalars
from parley.operators import ordered
from parley.sources import shared

BLURRED = 0.15


def histogram(values: DataFrame, column: str, keys: list[str], buckets: int = 10) -> DataFrame:
    """Counts in equal buckets of 0 to 1; 1 falls into the last."""
    bucket = F.least(F.floor(F.col(column) * buckets), F.lit(buckets - 1)).cast("int")
    return values.where(F.col(column).isNotNull()).groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def threshold_sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """For each threshold the pairs that reach it and the words of their shorter sides."""
    levels = pairs.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    hit = F.col("similarity") >= F.col("threshold")
    return pairs.crossJoin(F.broadcast(levels)).groupBy("threshold").agg(F.count_if(hit).alias("pairs"), F.sum(F.when(hit, F.col("shorter")).otherwise(0)).alias("words"))


def lowest_threshold(sweep: DataFrame, control_percent: int = 5) -> DataFrame:
    """The lowest thresholds at which the control has at most so many per cent of the pairs, and none; null without control pairs.

    ``sweep`` has threshold, pairs and control.
    """
    some = F.max("control") > 0
    within = F.min(F.when(100 * F.col("control") <= control_percent * F.col("pairs"), F.col("threshold")))
    clean = F.min(F.when(F.col("control") == 0, F.col("threshold")))
    return sweep.agg(F.when(some, within).alias("few"), F.when(some, clean).alias("none"))


def gap_verdict(real: DataFrame, control: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Upper medians of two similarity columns, of each key if there are keys, and what their gap says."""
    keys = keys or []
    side = lambda rows, name: ordered.upper_median(rows, keys, "similarity").withColumnRenamed("median", name)
    a, b = side(real, "real"), side(control, "control")
    both = a.join(b, keys, "full") if keys else a.crossJoin(b)  # one row each without keys
    gap = F.col("real") - F.col("control")
    return both.withColumn("verdict", F.when(gap.isNull(), "nothing").when(gap < BLURRED, "blurred").otherwise("clear"))


def greedy_assignment(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one pairs of speaker and cluster: cells by ms, then speaker, then cluster; taken if both are free.

    Cells come sorted as a stream, so that a task holds the speakers and clusters taken so far in one
    meeting, as each choice depends on those before it, and no meeting as a whole.
    """
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    names = [*keys, "speaker_id", "cluster", "ms"]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, people, clusters = None, set(), set()
        for batch in batches:
            kept = []
            key = zip(*(batch.column(k).to_pylist() for k in keys), strict=True)
            for i, (at, who, which) in enumerate(zip(key, batch.column("speaker_id").to_pylist(), batch.column("cluster").to_pylist(), strict=True)):
                if at != now:
                    now, people, clusters = at, set(), set()
                if who not in people and which not in clusters:
                    people.add(who)
                    clusters.add(which)
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    rows = cells.where("ms > 0").select(*names).repartition(*keys).sortWithinPartitions(*keys, F.desc("ms"), "speaker_id", "cluster")
    return rows.mapInArrow(take, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def agreement(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy, wholeness and purity of clusters against labels, each 0 where there is nothing to divide by.

    ``cells`` is written once, as each of the four measures reads it: the join behind it runs once.
    """
    cells = shared.written(cells.select(*keys, "speaker_id", "cluster", "ms"))
    pairs = greedy_assignment(cells, keys).groupBy(*keys).agg(F.sum("ms").alias("paired"))
    of_person = cells.groupBy(*keys, "speaker_id").agg(F.max("ms").alias("best")).groupBy(*keys).agg(F.sum("best").alias("whole"))
    of_cluster = cells.groupBy(*keys, "cluster").agg(F.max("ms").alias("best")).groupBy(*keys).agg(F.sum("best").alias("pure"))
    total = cells.groupBy(*keys).agg(F.sum("ms").alias("ms"))
    share = lambda c: F.when(F.col("ms") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col("ms")).otherwise(0.0)
    both = total.join(pairs, keys, "left").join(of_person, keys, "left").join(of_cluster, keys, "left")
    return both.select(*keys, share("paired").alias("accuracy"), share("whole").alias("wholeness"), share("pure").alias("purity"))


def evidence(shared: DataFrame) -> DataFrame:
    """Shared time against what the densities of two tracks let expect: more than a fifth above it is evidence."""
    expected = F.when(F.col("wall_ms") > 0, F.floor(F.col("a_ms") * F.col("b_ms") / F.col("wall_ms"))).otherwise(0).cast("long")
    rows = shared.withColumn("expected_ms", expected)
    return rows.withColumn("same", F.col("shared_ms") > F.col("expected_ms") + F.floor(F.col("expected_ms") / 5))


def plateau(sweep: DataFrame, slack: float = 0.005) -> DataFrame:
    """The best accuracy, the middle of the thresholds within ``slack`` of it, and whether that is at the edge.

    ``sweep`` is a report of a few thresholds with their accuracy.
    """
    best = sweep.agg(F.max("accuracy").alias("best"), F.min("threshold").alias("low"), F.max("threshold").alias("high"), F.count("*").alias("n"))
    near = sweep.crossJoin(best).where(F.col("accuracy") >= F.col("best") - slack)
    out = near.groupBy("best", "low", "high", "n").agg(scalars.upper_median(F.collect_list("threshold")).alias("middle"), F.count("*").alias("near"))
    verdict = F.when(F.col("n") < 3, "too short").when(F.col("near") == F.col("n"), "stuck").when((F.col("middle") == F.col("low")) | (F.col("middle") == F.col("high")), "at edge").otherwise("plateau")
    return out.select("best", "middle", verdict.alias("verdict"))


def two_sided_errors(windows: DataFrame, thresholds: list[float], loud: float = 120.0) -> DataFrame:
    """For each threshold the share of the owner's windows that are taken for echo and of the others' that are missed.

    ``windows`` has kind, explained and reference_rms; only windows with a loud reference count.
    """
    levels = windows.sparkSession.createDataFrame([(t,) for t in thresholds], "threshold double")
    echo = F.col("explained") >= F.col("threshold")
    rows = windows.where(F.col("reference_rms") >= loud).crossJoin(F.broadcast(levels))
    part = lambda kind, bad: F.coalesce(F.avg(F.when(F.col("kind") == kind, bad.cast("double"))), F.lit(0.0))
    return rows.groupBy("threshold").agg(part("owner", echo).alias("owner_eaten"), part("others", ~echo).alias("others_missed"))


def rule_totals(candidates: DataFrame) -> DataFrame:
    """Candidates and occurrences of each mining rule over all meetings."""
    return candidates.groupBy("rule").agg(F.count("*").alias("candidates"), F.sum("occurrences").alias("occurrences"))


def bucket_levels(levels: DataFrame, keys: list[str], bucket_ms: int = 10_000) -> DataFrame:
    """Upper median level of each bucket, the frames over a fixed level, and all frames."""
    bucket = F.floor(F.col("ts_ms") / bucket_ms).alias("bucket")
    rows = levels.select(*keys, bucket, "level")
    counts = rows.groupBy(*keys, "bucket").agg(F.count_if(F.col("level") > 450).alias("accepted"), F.count("*").alias("frames"))
    middle = ordered.upper_median(rows, [*keys, "bucket"], "level").withColumnRenamed("median", "median_level")
    return middle.join(counts, [*keys, "bucket"]).select(*keys, "bucket", "median_level", "accepted", "frames")

