"""Shards of nearly equal bytes by a histogram sort, with DataFrame operations alone."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import storage
from parley.operators.ordered import free_name

LAW = "bytes"
#: A shard's bound may miss its share of the bytes by this part of a shard before probes are refined.
TOLERANCE = 0.005
#: Ranges that rows are exchanged in: one for about so many bytes, and as many at most; what a range holds follows the input beyond.
RANGE_BYTES, MOST_RANGES = 16 << 20, 8192
#: Buckets that a round counts, and so rows that come to the driver in a round.
BUCKETS = 1 << 16
#: The key: a hash of the text, so that equal texts are neighbours; of the id; and a place among equal rows.
KEY = ("_text", "_id", "_row")
_BITS = 62


@dataclass
class Probe:
    """Rows between two key bounds (both included), with the bytes and rows below them and in them."""

    low: tuple[int, ...]
    high: tuple[int, ...]
    size_below: int
    rows_below: int
    size: int
    rows: int

    def split(self) -> int | None:
        """The first part of the key in which the rows may differ."""
        return next((i for i in range(len(KEY)) if self.low[i] != self.high[i]), None)


def keyed(docs: DataFrame, id_column: str, text_column: str, carry: list[str]) -> DataFrame:
    """The key, size and crc32 of every row, written once, with the columns in ``carry``."""
    text = F.col(f"`{text_column}`")
    positive = lambda h: F.shiftrightunsigned(h, 64 - _BITS)
    return storage.written(
        docs.select(
            *(F.col(f"`{c}`") for c in carry),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            positive(F.xxhash64(F.lit("text"), text)).alias(KEY[0]),
            positive(F.xxhash64(F.lit("id"), F.col(f"`{id_column}`"))).alias(KEY[1]),
            F.monotonically_increasing_id().alias(KEY[2]),
        )
    )


def at_least(bound: list[Column]) -> Column:
    """Whether the key is at that bound or above it."""
    found = F.lit(True)
    for name, b in reversed(list(zip(KEY, bound, strict=True))):
        found = (F.col(name) > b) | ((F.col(name) == b) & found)
    return found


def place_among(rows: DataFrame, bounds: list[tuple[int, ...]], name: str) -> DataFrame:
    """``rows`` with the number of sorted ``bounds`` at or below their key: a binary search, a column a step."""
    rows = rows.withColumn(name, F.lit(0))
    step = 1 << max(len(bounds) - 1, 0).bit_length()
    lists = [F.array(*(F.lit(b[i]).cast("long") for b in bounds)) for i in range(len(KEY))]
    while step and bounds:
        place = F.col(name) + step
        here = [F.get(a, place - 1) for a in lists]
        rows = rows.withColumn(name, F.when((place <= len(bounds)) & at_least(here), place).otherwise(F.col(name)))
        step >>= 1
    return rows


def count_between(rows: DataFrame, probes: list[Probe]) -> list[Probe]:
    """One round: each probe is cut evenly by key and its rows and exact bytes are counted; probes with rows come back in order."""
    each = max(2, BUCKETS // len(probes))
    found = place_among(rows, [p.low for p in probes], "_probe").where("_probe > 0")
    pick = lambda values: F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col("_probe") - 1)
    cut = [p.split() for p in probes]
    value = F.lit(None)
    for i, name in enumerate(KEY):
        value = F.when(pick([i == c for c in cut]) == 1, F.col(name)).otherwise(value)
    first = [p.low[c] for p, c in zip(probes, cut, strict=True)]
    last = [p.high[c] for p, c in zip(probes, cut, strict=True)]
    width = [(b - a) // each + 1 for a, b in zip(first, last, strict=True)]
    found = found.withColumns({"_value": value, "_first": pick(first), "_last": pick(last), "_width": pick(width)})
    # A probe's rows agree in the parts of the key before the one that cuts it.
    for i, name in enumerate(KEY):
        found = found.where((pick([c > i for c in cut]) == 0) | (F.col(name) == pick([p.low[i] for p in probes])))
    found = found.where("_value BETWEEN _first AND _last").withColumn("_bucket", F.expr("(_value - _first) DIV _width"))
    ends = [f(name).alias(f"{kind}{name}") for name in KEY for kind, f in (("low", F.min), ("high", F.max))]
    counted = found.groupBy("_probe", "_bucket").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), *ends).collect()
    made, size, count = [], {}, {}
    for r in sorted(counted, key=lambda r: (r["_probe"], r["_bucket"])):
        p = probes[r["_probe"] - 1]
        i, c = r["_probe"], cut[r["_probe"] - 1]
        # Beyond a part in which rows differ, the others range freely.
        free = next((k for k in range(c, len(KEY)) if r[f"low{KEY[k]}"] != r[f"high{KEY[k]}"]), len(KEY))
        low = tuple(r[f"low{name}"] if k <= free else 0 for k, name in enumerate(KEY))
        high = tuple(r[f"high{name}"] if k <= free else (1 << 63) - 1 for k, name in enumerate(KEY))
        made.append(Probe(low, high, p.size_below + size.get(i, 0), p.rows_below + count.get(i, 0), r["size"], r["rows"]))
        size[i], count[i] = size.get(i, 0) + r["size"], count.get(i, 0) + r["rows"]
    return made


@dataclass
class Splitter:
    """The first key of a range, with the exact bytes and rows below it; ``shard`` where it begins one."""

    key: tuple[int, ...]
    size_below: int
    rows_below: int
    shards: int = 0


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES, report: list[dict] | None = None) -> tuple[list[Splitter], int]:
    """Key bounds of the shards and of the ranges inside them, and the number of rows.

    A shard's bound wants a multiple of total bytes / ``shards`` below it. A range's wants a multiple of
    the same weight, half of it bytes and half rows, so that neither long texts nor many short ones
    fill a task; it is content with half a range. A bucket that holds a wanted bound gives the nearer of
    its ends if that is within the tolerance or its rows can't be told apart; else it is counted again.
    """
    whole = Probe((0,) * len(KEY), ((1 << _BITS) - 1, *((1 << 63) - 1,) * (len(KEY) - 1)), 0, 0, 0, 0)
    # The bounds of the whole key: every row passes.
    probes = count_between(rows, [whole])
    if not probes:
        return [], 0
    size, count = probes[-1].size_below + probes[-1].size, probes[-1].rows_below + probes[-1].rows
    ranges = max(1, min(MOST_RANGES, -(-size // range_bytes)))
    wanted = [("size", size * k / shards, tolerance * size / shards, 1) for k in range(1, shards)]
    wanted += [("weight", 2 * size * count * k / ranges, size * count / ranges, 0) for k in range(1, ranges)]
    measure = {"size": lambda s, n: s, "weight": lambda s, n: s * count + n * size}
    found: dict[tuple[int, ...], Splitter] = {}
    while wanted:
        if report is not None:
            report.append({"wanted": len(wanted), "buckets": len(probes)})
        again: dict[tuple[int, ...], Probe] = {}
        later = []
        ends = {kind: [m(p.size_below + p.size, p.rows_below + p.rows) for p in probes] for kind, m in measure.items()}
        for kind, target, slack, shard in wanted:
            p = probes[min(bisect.bisect_left(ends[kind], target), len(probes) - 1)]
            below, above = target - measure[kind](p.size_below, p.rows_below), measure[kind](p.size_below + p.size, p.rows_below + p.rows) - target
            if min(below, above) > slack and p.rows > 1 and p.split() is not None:
                again[p.low] = p
                later.append((kind, target, slack, shard))
                continue
            if below <= above:
                s = Splitter(p.low, p.size_below, p.rows_below)
            else:
                s = Splitter(_next(p.high), p.size_below + p.size, p.rows_below + p.rows)
            found.setdefault(s.key, s).shards += shard
        wanted = later
        probes = count_between(rows, [again[k] for k in sorted(again)]) if again else []
    return [found[k] for k in sorted(found)], count


def _next(high: tuple[int, ...]) -> tuple[int, ...]:
    """The smallest key above all that begin as ``high`` does where the rest of it is open."""
    end = (1 << 63) - 1
    k = max(i for i, v in enumerate(high) if v < end)
    return (*high[:k], high[k] + 1, *(0,) * (len(high) - k - 1))


def shard(docs: DataFrame, shards: int = 8, carry: list[str] | None = None, id_column: str = "doc_id", text_column: str = "text", tolerance: float = TOLERANCE, range_bytes: int = RANGE_BYTES, report: list[dict] | None = None) -> DataFrame:
    """The columns in ``carry`` (all by default), size, text_crc32, shard and slot of every row.

    A histogram sort: the exact bytes below candidate bounds of the key are counted across all
    partitions, probes around the wanted bounds are refined until the bounds meet the tolerance, and
    the rows are exchanged once, into ranges that each lie in one shard. Size is the text's UTF-8 bytes,
    none for a null, plus 1. Law: ``bytes`` - each shard begins within ``tolerance`` of its share of
    all bytes, or as near as whole rows allow. Equal texts are neighbours and share a shard unless
    a bound must cut them. ``slot`` numbers a shard's rows without a gap from 0, in order of the key.

    Null texts are equal, and so are empty ones. Repeated ids, and rows equal in all, count row by row;
    which of equal rows comes first is free. With fewer rows than shards, some shards stay empty. An
    empty table gives no rows. Columns of docs named as a result are not carried; other names are free.
    """
    results = {"size", "text_crc32", "shard", "slot"}
    names = [c for c in (docs.columns if carry is None else carry) if c not in results]
    taken = {c: f"_c{i}" for i, c in enumerate(names)}
    named = docs.select(F.col(f"`{id_column}`").alias("_of_id"), F.col(f"`{text_column}`").alias("_of_text"), *(F.col(f"`{c}`").alias(n) for c, n in taken.items()))
    rows = keyed(named, "_of_id", "_of_text", list(taken.values()))
    bounds, _ = splitters(rows, shards, tolerance, range_bytes, report)
    placed = place_among(rows, [s.key for s in bounds], "_range")
    begins, before, number, rows_before = [], [], 0, 0
    for s in [Splitter((0,), 0, 0), *bounds]:
        number += s.shards
        rows_before = s.rows_below if s.shards else rows_before
        begins.append(number)
        before.append(s.rows_below - rows_before)
    pick = lambda values: F.get(F.array(*(F.lit(v).cast("long") for v in values)), F.col("_range"))
    # The one exchange: a range to a partition, as its bounds say.
    dealt = placed.repartitionById(len(bounds) + 1, F.col("_range"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*KEY)) - 1
    return dealt.select(
        *(F.col(n).alias(c) for c, n in taken.items()),
        "size",
        "text_crc32",
        pick(begins).cast("int").alias("shard"),
        (pick(before) + place).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, folder: str, shards: int = 8, **options) -> None:
    """Writes whole rows as Parquet, a folder ``shard=k`` for each shard that has rows; files of a shard in order of slot."""
    free = free_name(docs, "_order")
    shard(docs, shards, **options).withColumn(free, F.col("slot")).sortWithinPartitions("shard", free).drop(free).write.partitionBy("shard").parquet(folder)
