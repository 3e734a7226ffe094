"""Vectorised text kernels for Arrow batches inside Spark tasks.

All of them take a bounded block of texts at a time, so that a task's memory follows the block
and its longest text, not the partition.
"""

from __future__ import annotations

import ctypes
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.shipping import ship

BLOCK_BYTES = 1 << 19
BATCH_ROWS = 512
#: Bytes of an Arrow batch, about: long texts make batches of fewer rows.
BATCH_BYTES = 4 << 20
#: Arrays of so many bytes go back to the system one by one.
MMAP_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(spark: SparkSession) -> None:
    """Rows and bytes of an Arrow batch, where the session still has Spark's defaults: texts are long."""
    for key, default, ours in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(name, None) == default:
            spark.conf.set(name, str(ours))


@functools.cache
def keep_lean() -> None:
    """Once a worker: large arrays go back to the system as they are freed, and Arrow takes its memory from the same place.

    By default the C library raises the size from which it does so as it sees larger arrays, and each
    thread and Arrow hold memory of their own; in workers that live on, these add up.
    """
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        for option, value in ((-3, MMAP_BYTES), (-1, MMAP_BYTES), (-8, 2)):  # mmap threshold, trim threshold, arenas
            libc.mallopt(option, value)
    pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Returns memory that a finished task has freed to the system: Python workers live on, and their arenas add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(function):
    """The same function over batches, with freed memory given back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_lean()
        yield from function(batches)
        give_back()

    return run


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with batches of few rows."""
    small_batches(df.sparkSession)
    ship(df.sparkSession)
    return df.mapInArrow(tidy(function), schema)


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds))


def fill(array: pa.Array) -> pa.Array:
    """Strings with null as the empty string."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return array.fill_null("") if array.null_count else array


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have ``most`` bytes in all, or one text."""
    lengths = np.diff(bounds(fill(batch.column(column))))
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > most:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def bounds(array: pa.Array) -> np.ndarray:
    """Byte offsets of a string array's values, one more than values."""
    width = np.int64 if pa.types.is_large_string(array.type) else np.int32
    raw = array.buffers()[1]
    if raw is None or not len(array):
        return np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(raw, width)[array.offset : array.offset + len(array) + 1].astype(np.int64)


class Texts:
    """A block of texts as one byte array; ``starts`` has each text's place, one more than texts."""

    def __init__(self, array: pa.Array) -> None:
        array = fill(array)
        offsets = bounds(array)
        raw = array.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and len(raw) else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.starts = offsets - offsets[0]
        self.n = len(array)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of one number a byte over each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of each run of flagged bytes; runs end with their text."""
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.starts] = True
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return start, end, np.searchsorted(self.starts, start, side="right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words: runs of bytes other than space and \\t to \\r."""
        return self.spans(~SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of the \\n-split lines; a text has one more than it has \\n."""
        cut = np.flatnonzero(self.data == 10)
        start = np.concatenate((self.starts[:-1], cut + 1))
        end = np.concatenate((self.starts[1:], cut))
        owner = np.concatenate((np.arange(self.n), np.searchsorted(self.starts, cut, side="right") - 1))
        order = np.lexsort((start, owner))
        owner, start = owner[order], start[order]
        return start, np.sort(end), owner


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        made = np.full(max(n, 1 << 16), base, np.uint64)
        made[0] = 1
        _powers[name] = np.cumprod(made, dtype=np.uint64)
    return _powers[name]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = BLOCK_BYTES) -> np.ndarray:
    """64-bit hash of each byte span; spans are in order of start. Works through ``most`` bytes at a time."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + most, side="right")))
        low, high = int(start[i]), int(end[i:j].max(initial=start[i]))
        n = high - low
        up, down = _power("up", _BASE, n + 1), _power("down", _INVERSE, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    if n_kept := len(_powers.get("up", ())):
        if n_kept > 4 * most:
            _powers.clear()
    return mix(out)


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words of one text, and the place of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[width - 1 :])
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        value = mix(value * np.uint64(3) + hashes[at + k] + np.uint64(k))
    return value, at


class IntTable:
    """Row number of each of many distinct 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        keys = np.asarray(keys, np.uint64)
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = left[free]
            self.keys[slot[free]] = keys[left[free]]
            lost = self.rows[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & self.mask
        self.keys[self.rows >= 0] = keys[self.rows[self.rows >= 0]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is absent."""
        slot = self._slot(keys)
        row = self.rows[slot]
        out = np.where((row >= 0) & (self.keys[slot] == keys), row, -1)
        left = np.flatnonzero((row >= 0) & (out < 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            row = self.rows[slot]
            hit = (row >= 0) & (self.keys[slot] == keys[left])
            out[left[hit]] = row[hit]
            more = (row >= 0) & ~hit
            left, slot = left[more], slot[more]
        return out


def crc(data: bytes) -> int:
    return zlib.crc32(data)
