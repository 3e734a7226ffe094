"""Bulk-synchronous best-fit packing of token pieces into sequences of fixed capacity."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import kernels as K
from parley.llm import storage, word_bpe

CAPACITY = 4096
END_ID = 1
#: Rows of one task of a sorted table, about.
TASK_ROWS = 20_000
#: Ranges of a sorted table at most; beyond, a range holds more rows, of a few numbers each.
MOST_PARTS = 4096
#: Ratio of the lengths that are packed in one band of sweeps: fewer bands are fewer jobs.
BAND = 8
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of each document's ids followed by ``end_id``; only documents over ``capacity`` have several.

    Returns doc_id, piece, start, length and ids_crc32. A null or empty text is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch):
                rows: list[tuple[int, int, int, int, int]] = []
                for doc_id, ids in zip(block.column(0).to_pylist(), word_bpe.encoder(path).encode(block.column(1)), strict=True):
                    raw = np.append(ids, end_id).astype("<u4")
                    for k in range(0, len(raw), capacity):
                        part = raw[k : k + capacity]
                        rows.append((doc_id, k // capacity, k, len(part), K.crc(part.tobytes())))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return K.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, _PIECES)


def _sorted(rows: DataFrame, n: int, *order) -> DataFrame:
    """The rows in order over range partitions of TASK_ROWS rows, or over MOST_PARTS larger ones; ``order`` must tell rows apart, so that no value is hot."""
    return rows.repartitionByRange(max(1, min(MOST_PARTS, -(-n // TASK_ROWS))), *order).sortWithinPartitions(*order)


def numbered(rows: DataFrame, n: int, order: list, name: str) -> DataFrame:
    """``n`` rows with their number in an order, from 0: places inside range partitions plus the counts of those before."""
    spark = rows.sparkSession
    names = rows.columns

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(k, part, np.int32)), pa.array(np.arange(at, at + k))], [*names, "_part", "_place"])
            at += k

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    K.ship(spark)
    local = storage.written(_sorted(rows, n, *order).mapInArrow(places, f"{schema}, _part int, _place long"))
    counts = sorted((r["_part"], r["n"]) for r in local.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one a partition
    base = dict(zip([p for p, _ in counts], np.cumsum([0, *(n for _, n in counts)]).tolist(), strict=False))
    bases = spark.createDataFrame(list(base.items()), "_part int, _base long")
    return local.join(F.broadcast(bases), "_part").select(*names, (F.col("_base") + F.col("_place")).alias(name))


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches a sorted range of gaps and documents: size falling, of equal sizes gaps first.

    A document's successor is the smallest gap that holds it; if that is taken by one of a smaller
    rank, it is the next one. In falling order that gap is the last one met that is not yet taken.
    Documents for which this range has no gap are lone, gaps without a document are open; both are
    numbered, for the ranges before hold the successors of the lone.
    """
    part = TaskContext.get().partitionId()
    open_gaps: list[int] = []
    lone = 0
    for batch in batches:
        docs = []
        for size, is_doc, key in zip(*(batch.column(c).to_pylist() for c in ("size", "is_doc", "key")), strict=True):
            if not is_doc:
                open_gaps.append(key)
            elif open_gaps:
                docs.append((key, size, open_gaps.pop(), None))
            else:
                docs.append((key, size, None, lone))
                lone += 1
        if docs:
            rank, length, sequence, place = zip(*docs, strict=True)
            yield _matched(part, rank, length, sequence, place)
    if open_gaps:
        n = len(open_gaps)
        yield _matched(part, [None] * n, [None] * n, open_gaps, range(n))


def _matched(part: int, rank, length, sequence, place) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(rank), part, np.int32)), *(pa.array(c, pa.int64()) for c in (rank, length, sequence, place))]
    return pa.RecordBatch.from_arrays(columns, ["part", "rank", "length", "sequence", "place"])


def carried(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Which open gaps the lone documents of later ranges take, from each range's number, lone documents and open gaps.

    Runs of (range, first lone document, how many, range of the gaps, its last gap): document
    first + t takes gap last - t. There are fewer than two runs a range.
    """
    runs, waiting = [], []
    for part, lone, free in sorted(counts):
        first = 0
        while lone and waiting:
            held, last = waiting.pop()
            take = min(lone, last + 1)
            runs.append((part, first, take, held, last))
            first, lone = first + take, lone - take
            if take <= last:
                waiting.append((held, last - take))
        if free:
            waiting.append((part, free - 1))
    return runs


def sweep(docs: DataFrame, gaps: DataFrame, n: int) -> tuple[DataFrame, int, int, int, int]:
    """One successor sweep over ``docs`` (rank, length) and ``gaps`` (sequence, size; a row for each document that a gap may take).

    ``n`` is about the number of rows of both. Returns a written table of rank, length and sequence,
    which is null for documents that no gap was left for, the number of matched and of other
    documents, and the least and greatest length of the others. No gap row is used twice.
    """
    spark = docs.sparkSession
    both = docs.select(F.col("length").alias("size"), F.lit(True).alias("is_doc"), F.col("rank").alias("key"))
    both = both.union(gaps.select("size", F.lit(False).alias("is_doc"), F.col("sequence").alias("key"))).withColumn("_tie", F.monotonically_increasing_id())
    K.ship(spark)
    ranged = _sorted(both, n, F.desc("size"), F.asc("is_doc"), F.asc("key"), F.asc("_tie"))
    done = storage.written(ranged.mapInArrow(_match, "part int, rank long, length long, sequence long, place long"))
    is_lone, is_open = F.col("sequence").isNull(), F.col("rank").isNull()
    lone_length = F.when(is_lone, F.col("length"))
    counts = done.groupBy("part").agg(F.count_if(is_lone).alias("lone"), F.count_if(is_open).alias("free"), F.min(lone_length).alias("low"), F.max(lone_length).alias("top"), F.count_if(~is_lone & ~is_open).alias("matched")).collect()  # one a range
    runs = carried([(r["part"], r["lone"], r["free"]) for r in counts])
    local = done.where(~is_open).select("rank", "length", "sequence")
    if not runs:
        lows, tops = [r["low"] for r in counts if r["lone"]], [r["top"] for r in counts if r["lone"]]
        return local, sum(r["matched"] for r in counts), sum(r["lone"] for r in counts), min(lows, default=0), max(tops, default=0)
    table = F.broadcast(spark.createDataFrame(runs, "_part int, first long, many long, held int, last long"))  # under two rows a range
    here = (F.col("part") == F.col("_part")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("many"))
    asking = done.where(is_lone).select("part", "rank", "length", "place").join(table, here, "left")
    asking = asking.select("rank", "length", F.col("held").alias("part"), (F.col("last") - (F.col("place") - F.col("first"))).alias("place"))
    taken = asking.join(done.where(is_open).select("part", "place", "sequence"), ["part", "place"], "left").select("rank", "length", "sequence")
    whole = storage.written(local.where("sequence is not null").union(taken))
    n, low, top, many = whole.agg(F.count_if(is_lone), F.min(lone_length), F.max(lone_length), F.count("sequence")).first()
    return whole, many, n, low or 0, top or 0


def fill(docs: DataFrame, gaps: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Puts documents (rank, length) into gaps (sequence, size) by sweeps until no document fits.

    Documents come in bands of falling length. In a sweep of a band whose longest document has B, a
    gap of at least B may take as many as surely fit, and one of less takes one; then the gaps
    shrink, and the band is swept again until nothing of it fits. Returns the matches (rank, length,
    sequence, step) and the documents that fit nowhere (rank, length).
    """
    placed: list[DataFrame] = []
    left: list[DataFrame] = []
    bands = docs.groupBy(F.floor(F.log2("length") / F.log2(F.lit(BAND))).alias("b")).agg(F.count("*").alias("n"), F.max("length").alias("top"), F.min("length").alias("low")).orderBy(F.desc("b")).collect()  # one for each power of BAND
    for band in bands:
        n, top, low = band["n"], band["top"], band["low"]
        now = docs.where(F.col("length").between(low, top))
        while n:
            fitting, wide = gaps.where(F.col("size") >= low).agg(F.count("*"), F.count_if(F.col("size") >= top)).first()
            if not fitting:
                break
            most = 1 + n // max(1, wide)
            slots = F.greatest(F.lit(1), F.least(F.floor(F.col("size") / top), F.lit(most))).cast("int")
            offered = gaps.where(F.col("size") >= low).withColumn("_k", slots)
            offered = offered.select("sequence", F.floor(F.col("size") / F.col("_k")).alias("size"), F.explode(F.sequence(F.lit(1), F.col("_k"))).alias("_slot")).drop("_slot")
            found, many, n, low, top = sweep(now, offered, n + fitting + min(n, wide * most))
            now = found.where("sequence is null").select("rank", "length")
            if not many:
                break
            placed.append(found.where("sequence is not null").withColumn("step", F.lit(len(placed))))
            used = placed[-1].select("sequence", (-F.col("length")).alias("size"))
            gaps = storage.written(gaps.union(used).groupBy("sequence").agg(F.sum("size").alias("size")).where("size > 0"))
        if n:
            left.append(now)
    return placed, functools.reduce(DataFrame.union, left) if left else docs.limit(0)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces with columns doc_id, piece and length.

    Rounds: as many sequences are opened as the remaining pieces need for their tokens, or for those
    longer than half a sequence, by the longest pieces; then the others are matched with gaps by
    ``fill``; those that fit nowhere go into the next round. All sorting and matching is done by range
    partitions of pieces and gaps; the driver sees counts alone, one for each length, each range or
    each band. Lengths must be from 1 to ``capacity``. Repeated rows are placed one by one;
    no rows give none. Other columns come back, whatever their names. What the driver holds of a
    sweep, and what is broadcast, has a row or two for each of MOST_PARTS ranges at most.
    """
    spark = pieces.sparkSession
    # Columns travel under names of their own.
    taken = {c: f"c{i}" for i, c in enumerate(pieces.columns)}
    back = [F.col(name).alias(c) for c, name in taken.items()]
    pieces = pieces.select(*(F.col(f"`{c}`").alias(name) for c, name in taken.items()), "length")
    n = pieces.count()
    plain = [name for c, name in taken.items() if pieces.schema[name].dataType.typeName() not in ("map", "variant")]
    order = [F.desc("length"), F.xxhash64(taken["doc_id"], taken["piece"]), *plain, F.monotonically_increasing_id()]
    ranked = storage.written(numbered(pieces, n, order, "_rank"))
    left = ranked.select(F.col("_rank").alias("rank"), "length")
    placed: list[DataFrame] = []
    sequences = step = 0
    while True:
        counts = left.groupBy("length").agg(F.count("*").alias("n")).collect()  # one for each length, ``capacity`` at most
        n = sum(r["n"] for r in counts)
        if not n:
            break
        opening = max(-(-sum(r["length"] * r["n"] for r in counts) // capacity), sum(r["n"] for r in counts if 2 * r["length"] > capacity))
        opening = min(opening, n)
        by_rank = left if not step else storage.written(numbered(left, n, [F.asc("rank")], "number"))
        number = F.col("rank" if not step else "number")
        first = by_rank.where(number < opening).select("rank", "length", (number + sequences).alias("sequence"), F.lit(step).alias("step"))
        first = storage.written(first)
        gaps = first.where(F.col("length") < capacity).select("sequence", (F.lit(capacity) - F.col("length")).alias("size"))
        found, left = fill(by_rank.where(number >= opening).select("rank", "length"), gaps)
        placed += [first, *(f.withColumn("step", F.col("step") + step + 1) for f in found)]
        sequences, step = sequences + opening, step + 1 + len(found)
        left = storage.written(left)
    if not placed:
        return ranked.select(*back, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    whole = functools.reduce(DataFrame.union, placed).select(F.col("rank").alias("_rank"), F.col("sequence").alias("sequence_id"), "step")
    before = Window.partitionBy("sequence_id").orderBy("step", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.join(whole, "_rank").select(*back, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs every document into as few sequences of ``capacity`` tokens as it can.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset, a row for each piece. A
    null text counts as empty and is one end id. Repeated ids and texts are packed row by row. An
    empty table gives no rows. Columns other than doc_id and text are not read. The pieces are
    written once to the shared folder, without texts, so that no text is encoded twice.
    """
    return pack(storage.written(token_pieces(docs, path, capacity)), capacity)
