"""Folds over the rows of a key in order, in linear time, with a key of any size spread over ranges.

A fold carries a small state from row to row. Rows are dealt over ranges of (keys, order); most
keys lie in one range, and a task folds them as it reads them. A key that crosses bounds is folded
range by range side by side, each from a guess; ranges whose entering state turns out to be another
are folded again, until every range begins where the one before ended. Rules that forget, as gates and
agreement do, are right after two or three rounds; any other rule takes a round for each range.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parley.operators.ordered import _same, free_name
from parley.sources.shared import written
from parley.sources.shipping import ship

#: Takes a state (None at a key's first row) and rows in order; gives the state after them and the new columns.
Step = Callable[[Any, pa.RecordBatch], tuple[Any, list[pa.Array]]]


def _runs(batch: pa.RecordBatch, names: list[str]) -> list[int]:
    """Places at which the values of ``names`` change, 0 and the end included."""
    n = batch.num_rows
    change = np.zeros(max(n - 1, 0), bool)
    for name in names:
        a, b = batch.column(name).slice(0, n - 1), batch.column(name).slice(1)
        other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        change |= other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return [0, *(np.flatnonzero(change) + 1).tolist(), n]


def _walk(batches: Iterator[pa.RecordBatch], names: list[str], part: str, step: Step, enter: dict[int, bytes]) -> Iterator[tuple]:
    """Batches sorted by part, keys and order: (first of its run, batch, state after it, new columns).

    A state enters a part's first run from ``enter``; every other run starts with None.
    """
    last, state, at = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = _runs(batch, [part, *names])
        parts = batch.column(part)
        for a, b in zip(edge, edge[1:], strict=False):
            run = batch.slice(a, b - a)
            key = tuple(run.column(c)[0] for c in names)
            p = parts[a].as_py()
            fresh = (p, key) != last
            if fresh:
                held = enter.get(p) if p != at else None
                state = pickle.loads(held) if held is not None else None
                last, at = (p, key), p
            state, made = step(state, run)
            yield fresh, run, state, made


def scan(rows: DataFrame, keys: list[str], order: list[str], step: Step, output: str, parts: int | None = None, report: list[int] | None = None) -> DataFrame:
    """``rows`` with the columns ``output`` that ``step`` makes of each key's rows in order.

    The state must be picklable and small. Null keys are one key; rows equal in keys and order come in
    free order, so ``order`` should tell rows apart. An empty table gives none. ``report`` gets the number of
    ranges that each round folded.
    """
    spark = rows.sparkSession
    ship(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = free_name(rows, "_part")
    by = [F.col(f"`{c}`") for c in (*keys, *order)]
    dealt = written(rows.repartitionByRange(parts, *by).withColumn(part, F.spark_partition_id()))
    whole = [f"`{k}`" for k in keys]
    # Ranges again, each read in order by one task.
    sorted_again = lambda df: df.repartitionById(parts, F.col(part)).sortWithinPartitions(part, *by)
    # Keys that cross a bound: at most one for each bound.
    spread = dealt.groupBy(*whole).agg(F.min(part).alias("_low"), F.max(part).alias("_high")).where("_low < _high")
    crossing = [(r["_low"], r["_high"]) for r in spread.select("_low", "_high").collect()]
    enter: dict[int, bytes] = {}
    if crossing:
        pieces = written(dealt.join(F.broadcast(spread), _same(dealt, spread, keys), "left_semi"))
        enter = _entering(crossing, lambda open_parts, held: _ends(sorted_again(pieces.where(F.col(part).isin(open_parts))), keys, part, step, held), report)
    held = dict(enter)
    names = StructType.fromDDL(output).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, piece, _, made in _walk(batches, keys, part, step, held):
            old = [c for c in piece.schema.names if c != part]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in old), *made], [*old, *names])

    old = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return sorted_again(dealt).mapInArrow(run, f"{old}, {output}")


def _ends(pieces: DataFrame, keys: list[str], part: str, step: Step, held: dict[int, bytes]) -> dict[int, bytes]:
    """The state at the end of each part, in which the last key goes on."""

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Any] = {}
        for _, run, state, _ in _walk(batches, keys, part, step, held):
            found[run.column(part)[0].as_py()] = state
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([pickle.dumps(s) for s in found.values()], pa.binary())], ["p", "state"])

    return {r["p"]: bytes(r["state"]) for r in pieces.mapInArrow(states, "p int, state binary").collect()}


def _entering(crossing: list[tuple[int, int]], fold: Callable[[list[int], dict[int, bytes]], dict[int, bytes]], report: list[int] | None) -> dict[int, bytes]:
    """The state that enters each part from the one before, for keys that lie in the parts low to high.

    The driver holds one state for each part.
    """
    last = {p: high for low, high in crossing for p in range(low, high)}
    inner = {p for low, high in crossing for p in range(low + 1, high)}
    enter: dict[int, bytes] = {}
    ends: dict[int, bytes] = {}
    open_parts = sorted(last)
    filled: set[int] = set()
    while open_parts:
        got = fold(open_parts, dict(enter))
        filled = filled or {*got, *(high for _, high in crossing)}
        if report is not None:
            report.append(len(got))
        open_parts = []
        for p in sorted(got):
            if ends.get(p) == got[p]:
                continue
            ends[p] = got[p]
            follower = next(q for q in range(p + 1, last[p] + 1) if q in filled)
            enter[follower] = got[p]
            if follower in inner and follower < last[p]:
                open_parts.append(follower)
    return enter
