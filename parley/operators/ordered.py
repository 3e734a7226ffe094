"""Numbers, running sums and medians over an order that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.sources.shared import written

#: Buckets that a round counts for each key, and values of a key that are numbered at once.
BUCKETS, FEW = 256, 4096


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Equality of those columns of two tables, null with null."""
    both = F.lit(True)
    for name in names:
        both = both & a[f"`{name}`"].eqNullSafe(b[f"`{name}`"])
    return both


def running(rows: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``rows`` with running sums of each key in that order, the row itself included.

    ``sums`` names new columns and gives what each adds up. Rows are dealt over ranges of (keys,
    order), so a key of any size, or the whole table where there are no keys, is spread over
    ``parts`` ranges (the session's shuffle partitions). Each range sums for itself; only a key that
    crosses a bound gets what earlier ranges have, at most one row for each bound. Null keys are one
    key, null sums add 0, an empty table gives none; rows that are equal in keys and order share a range, and their order is free.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = free_name(rows, "_part")
    ordered = [F.col(f"`{k}`") for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    dealt = rows.withColumns({name: F.coalesce(value, F.lit(0)) for name, value in sums.items()})
    dealt = written(dealt.repartitionByRange(parts, *ordered).withColumn(part, F.spark_partition_id()))
    whole = [part, *keys]
    until = Window.partitionBy(*(f"`{k}`" for k in whole)).orderBy(*ordered[len(keys) :]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.withColumns({name: F.sum(name).over(until) for name in sums})
    before = Window.partitionBy(*(f"`{k}`" for k in keys)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*(f"`{k}`" for k in whole)).agg(*(F.sum(name).alias(name) for name in sums))
    carried = totals.select(*(F.col(f"`{k}`") for k in whole), *(F.sum(name).over(before).alias(name) for name in sums)).where(F.col(next(iter(sums))).isNotNull())
    found = local.join(F.broadcast(carried), _same(local, carried, whole), "left")
    made = {name: (local[name] + F.coalesce(carried[name], F.lit(0))).alias(name) for name in sums}
    return found.select(*(made.get(c, local[f"`{c}`"]) for c in dealt.columns if c != part))


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str = "position", parts: int | None = None) -> DataFrame:
    """``rows`` with the place of each in its key by that order, from 1; see ``running``."""
    return running(rows, keys, order, {name: F.lit(1).cast("long")}, parts)


def upper_median(rows: DataFrame, keys: list[str], column: str, few: int = FEW) -> DataFrame:
    """The upper median of each key: the value at half the count, from 0, of its values in order (NaN last).

    Rank selection: a key's range of values is cut into BUCKETS, values are counted for each with a
    partial step, and the search goes on in the bucket that holds the rank, on the range that its
    values fill, until it has one value or ``few`` of them, which are then numbered. No key's values
    are gathered, so a hot key costs a few counting passes. Nulls do not count; a key of nulls alone
    has a null median. Values are compared as doubles.
    """
    value, ks = F.col("_v"), [f"`{k}`" for k in keys]
    base = written(rows.select(*ks, F.col(column).cast("double").alias("_v")))
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    finite = (value > low) & (value < high)
    count = lambda c: F.count_if(c).alias
    state = base.groupBy(*ks).agg(F.count("_v").alias("_n"), count(value == low)("_low"), count(finite)("_finite"), count(value == high)("_high"), F.min(F.when(finite, value)).alias("_a"), F.max(F.when(finite, value)).alias("_b"))
    rank = F.floor(F.col("_n") / 2)
    above = rank - F.col("_low") - F.col("_finite")
    odd = F.when(F.col("_n") == 0, F.lit(None)).when(rank < F.col("_low"), low).when(above < 0, F.lit(None)).when(above < F.col("_high"), high).otherwise(F.lit(float("nan")))
    searched = (F.col("_n") > 0) & (rank >= F.col("_low")) & (above < 0)
    state = written(state.select(*ks, searched.alias("_open"), odd.alias("median"), (rank - F.col("_low")).alias("_rank"), F.col("_finite").alias("_count"), "_a", "_b"))
    done = [state.where(~F.col("_open")).select(*ks, "median")]
    state, left = state.where("_open").drop("_open", "median"), base.where(finite)
    while True:
        one = F.col("_a") == F.col("_b")
        done.append(state.where(one).select(*ks, F.col("_a").alias("median")))
        small = state.where(~one & (F.col("_count") <= few))
        place = F.row_number().over(Window.partitionBy(*ks).orderBy("_v")) - 1
        near = _within(left, small, keys).withColumn("_place", place)
        done.append(near.where("_place = _rank").select(*ks, F.col("_v").alias("median")))
        state = state.where(~one & (F.col("_count") > few))
        if state.isEmpty():
            break
        left = written(_within(left, state, keys).select(*ks, "_v", "_rank", "_a", "_b"))
        # Halves, as the whole range may be beyond a double.
        share = (F.col("_v") / 2 - F.col("_a") / 2) / (F.col("_b") / 2 - F.col("_a") / 2)
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
        counts = left.withColumn("_k", bucket).groupBy(*ks, "_k").agg(F.count("*").alias("_count"), F.first("_rank").alias("_rank"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        before = F.coalesce(F.sum("_count").over(Window.partitionBy(*ks).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        state = counts.withColumn("_rank", F.col("_rank") - before).where("_rank >= 0 AND _rank < _count").drop("_k")
        state, left = written(state), left.select(*ks, "_v")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found


def _within(values: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The values that lie in their key's range, with the state of the search."""
    state = state if keys else F.broadcast(state)  # one row
    inside = _same(values, state, keys) & values["_v"].between(state["_a"], state["_b"])
    return values.join(state, inside).select(*(values[f"`{k}`"] for k in keys), "_v", "_rank", "_a", "_b")
