"""Product codes of vectors: one codebook for each part position, fitted over distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import kernels as K
from parley.llm import storage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Scaled components from which on doubles do not hold every whole number: an error.
LIMIT = 1 << 53
#: Scaled components, and the weight of a block, below which its weighted sums fit 64 bits.
_NARROW, _LIGHT = 1 << 26, 1 << 34
#: Parts that are compared with a codebook at once.
_BLOCK = 8192
_SUMS = "position int, entry int, place int, total decimal(38,0), parts decimal(38,0)"

Codebooks = list[list[list[int]]]


def whole_parts(vectors: DataFrame, parts: int, scale: int, carry: list[str]) -> tuple[DataFrame, int]:
    """A row number, ``carry`` and floor(scale x) of each sound vector, written; and the components of a part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.where(sound).select(*(F.col(f"`{c}`") for c in carry), F.transform(x, lambda c: c * scale).alias("_x"))
    largest, width = kept.agg(F.max(F.array_max(F.transform("_x", F.abs))), F.max(F.size("_x"))).first()
    if (largest or 0) >= LIMIT:
        raise ValueError(f"a component of {largest / scale:g} is too large: {scale} times it must be below 2^53")
    each = -(-(width or 0) // parts)
    filled = F.concat(F.transform("_x", lambda c: F.floor(c)), F.array_repeat(F.lit(0).cast("long"), F.lit(each * parts) - F.size("_x")))
    return storage.written(kept.select(F.monotonically_increasing_id().alias("_row"), *(F.col(f"`{c}`") for c in carry), filled.alias("_v"))), each


def _by_part(rows: DataFrame, parts: int, each: int) -> DataFrame:
    cut = F.array(*(F.struct(F.lit(k).alias("position"), F.slice("_v", k * each + 1, each).alias("part")) for k in range(parts)))
    return rows.select("_row", F.inline(cut))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the lowest of equals) and the squared distance, exact at any size."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if (2 * most) ** 2 * max(x.shape[1], 1) >= 1 << 63:
        x, book = x.astype(object), book.astype(object)
    best = np.zeros(len(x), np.int64)
    least = None
    for k, entry in enumerate(book):
        step = x - entry
        d = (step * step).sum(1) if x.shape[1] else np.zeros(len(x), np.int64)
        if least is None:
            least = d
            continue
        nearer = (d < least).astype(bool)
        best[nearer], least = k, np.where(nearer, d, least)
    return best, least


def _assigned(batches: Iterator[pa.RecordBatch], books: dict[int, np.ndarray], each: int) -> Iterator[tuple]:
    """Blocks of parts of one position: its number, the block, its parts, their entries and distances."""
    for batch in batches:
        for a in range(0, batch.num_rows, _BLOCK):
            block = batch.slice(a, _BLOCK)
            x, at = _matrix(block.column("part"), each), block.column("position").to_numpy()
            for p in np.unique(at).tolist():
                mine = np.flatnonzero(at == p)
                yield p, block.take(pa.array(mine)), x[mine], *nearest(x[mine], books[p])


def lloyd_round(distinct: DataFrame, books: Codebooks, each: int) -> Codebooks:
    """Codebooks after one round over weighted parts; a task sends one row for each entry and place."""
    arrays = {p: np.array(b, object).astype(np.int64).reshape(len(b), each) for p, b in enumerate(books)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list[int]] = {}
        count: dict[tuple[int, int], int] = {}
        for p, block, x, code, _ in _assigned(batches, arrays, each):
            weight = block.column("weight").to_numpy()
            exact = np.abs(x).max(initial=0) < _NARROW and int(weight.astype(object).sum()) < _LIGHT
            weighted = x * weight[:, None] if exact else x.astype(object) * weight.astype(object)[:, None]
            for k in np.unique(code).tolist():
                mine, key = code == k, (p, k)
                here = [int(v) for v in weighted[mine].sum(0)]
                total[key] = [a + b for a, b in zip(total.get(key, [0] * each), here, strict=True)]
                count[key] = count.get(key, 0) + int(weight[mine].astype(object).sum())
        rows = [(p, k, i, v, count[p, k]) for (p, k), values in total.items() for i, v in enumerate(values)]
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38), pa.decimal128(38))
            yield pa.RecordBatch.from_arrays([pa.array(_decimals(c) if i > 2 else list(c), kinds[i]) for i, c in enumerate(zip(*rows, strict=True))], ["position", "entry", "place", "total", "parts"])

    met = K.map_batches(distinct, sums, _SUMS).groupBy("position", "entry", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("parts").cast("decimal(38,0)").alias("parts"))
    new = [[list(entry) for entry in book] for book in books]
    for r in met.collect():  # a row for each component of the codebooks
        new[r["position"]][r["entry"]][r["place"]] = int(r["total"]) // int(r["parts"])
    return new


def _decimals(values) -> list[Decimal]:
    return [Decimal(int(v)) for v in values]


def code_distinct(distinct: DataFrame, books: Codebooks, each: int) -> DataFrame:
    """position, part, entry and squared distance of every distinct part."""
    arrays = {p: np.array(b, object).astype(np.int64).reshape(len(b), each) for p, b in enumerate(books)}

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, _, code, error in _assigned(batches, arrays, each):
            wide = pa.array(_decimals(error), pa.decimal128(38)) if error.dtype == object else pa.array(error).cast(pa.decimal128(38))
            yield pa.RecordBatch.from_arrays([block.column("position"), block.column("part"), pa.array(code, pa.int32()), wide], ["position", "part", "entry", "error"])

    return K.map_batches(distinct.select("position", "part"), codes, "position int, part array<long>, entry int, error decimal(38,0)")


def digest(books: Codebooks) -> str:
    """SHA-256 of all components by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, report: dict | None = None) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every sound vector.

    Each component x is floor(scale x). Equal parts of a position become one weighted row, and Lloyd's
    rounds run over these rows alone, so a vector that holds a third of the table is one row a
    position. Codebooks start as the parts of the first ``entries`` rows by vec_id. Codes and
    distances come back to the vectors by a join on the part, which Spark can split at a hot part.
    ``code`` has two hex digits a part; ``error`` is the sum of squared distances, ``label_error`` that of all vectors of
    the label. ``report`` gets the number of distinct parts and the codebooks.

    Vectors that are null or hold null or non-finite components are left out. Shorter vectors, and a
    length that the parts do not divide, are filled up with components 0; an empty vector is all 0.
    Rows with repeated vec_ids are coded each; equal ids start in order of their vectors; a null vec_id
    stays and comes last. Null labels are one label. Sums beyond 64 bits are null; scaled components
    from 2^53 on are an error. Fewer rows than ``entries`` give a codebook of so many entries. An empty
    table gives no rows. Other columns of the table are not read.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("there must be a part, and 1 to 256 entries")
    K.small_batches(vectors.sparkSession)
    rows, each = whole_parts(vectors.select("vec_id", "label", "embedding"), parts, scale, ["vec_id", "label"])
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()
    books = [[list(r["_v"][p * each : (p + 1) * each]) for r in first] for p in range(parts)]
    cut = _by_part(rows, parts, each)
    distinct = storage.written(cut.groupBy("position", "part").agg(F.count("*").alias("weight")))
    for _ in range(rounds if first else 0):
        books = lloyd_round(distinct, books, each)
    if report is not None:
        report.update(distinct=distinct.count(), books=books)
    coded = storage.written(code_distinct(distinct, books, each))
    back = cut.join(coded, ["position", "part"]).groupBy("_row").agg(*(F.max(F.when(F.col("position") == p, F.lower(F.lpad(F.hex("entry"), 2, "0")))).alias(f"_{p}") for p in range(parts)), F.sum("error").alias("_error"))
    found = storage.written(rows.drop("_v").join(back, "_row").select("vec_id", "label", F.concat(*(f"_{p}" for p in range(parts))).alias("code"), _wide("_error").alias("_error")))
    by_label = storage.written(found.groupBy("label").agg(_wide(F.sum("_error")).alias("_sum")).withColumnRenamed("label", "_label"))
    joined = found.join(storage.limited_broadcast(by_label), found["label"].eqNullSafe(by_label["_label"]))
    narrow = lambda c: F.col(c).try_cast("long")
    return joined.select("vec_id", "label", "code", narrow("_error").alias("error"), narrow("_sum").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))


def _wide(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(38,0)")
