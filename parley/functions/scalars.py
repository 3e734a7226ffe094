"""Small expressions over times, ids, bytes and JSON."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def overlap_ms(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Common time of two intervals, 0 if they only touch."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def gap_ms(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Time between two intervals, 0 if they meet."""
    return F.greatest(F.lit(0), a_start - b_end, b_start - a_end)


def duration_ms(start: Column, end: Column) -> Column:
    """Never negative; null while the end is."""
    return F.when(end.isNotNull(), F.greatest(end - start, F.lit(0)))


#: Fixed values of 64-bit FNV-1a.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: With fewer texts than this left in a batch their bytes are folded one by one.
SIDE_BY_SIDE = 8


@pandas_udf(StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    """FNV-1a of the UTF-8 bytes, 64 bits in 16 hex digits. Multiplication must wrap, which SQL in ANSI mode refuses.

    The texts of a batch are folded side by side, longest first, a byte of each at a time.
    """
    given = text[text.notna()]
    coded = sorted(((value.encode(), i) for i, value in given.items()), key=lambda c: -len(c[0]))
    size = np.array([len(c) for c, _ in coded], np.int64)
    data = np.frombuffer(b"".join(c for c, _ in coded), np.uint8)
    start = np.cumsum(size) - size
    state = np.full(len(coded), FNV_START, np.uint64)
    many = len(coded)
    at = 0
    while many >= SIDE_BY_SIDE and size[SIDE_BY_SIDE - 1] > at:
        while size[many - 1] <= at:
            many -= 1
        state[:many] = (state[:many] ^ data[start[:many] + at]) * np.uint64(FNV_PRIME)
        at += 1
    out = text.astype(object).where(text.notna(), None)
    for k, (raw, i) in enumerate(coded):
        value = int(state[k])
        for byte in raw[at:]:
            value = (value ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
        out[i] = f"{value:016x}"
    return out


def date_label(ms: Column) -> Column:
    """The UTC date of epoch milliseconds."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def markdown_name(ms: Column, meeting: Column, kind: Column, chars: int = 8) -> Column:
    """Date, shortened id and kind as a file name."""
    return F.concat(F.concat_ws("-", date_label(ms), F.substring(F.regexp_replace(meeting.cast("string"), "[^A-Za-z0-9]", ""), 1, chars), kind), F.lit(".md"))


def frame_of(ms: Column, rate: Column) -> Column:
    """Frame index of a time, whole division."""
    return F.floor(ms * rate / 1000).cast("long")


def ms_of(frames: Column, rate: Column) -> Column:
    """Time of a frame count, whole division."""
    return F.floor(frames * 1000 / rate).cast("long")


def ticks_to_ms(ticks: Column, numerator: int, denominator: int) -> Column:
    """Host clock ticks in milliseconds."""
    return F.floor(ticks * numerator / denominator / 1_000_000).cast("long")


def channel_speaker(meeting: Column, channel: Column) -> Column:
    """The id of a channel's own speaker."""
    return F.concat_ws(":", meeting.cast("string"), channel)


def cosine(a: Column, b: Column) -> Column:
    """Cosine within -1 and 1; -1 for vectors of other lengths, empty ones and those without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    sound = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(F.coalesce(sound, F.lit(False)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norm))).otherwise(-1.0)


def upper_median(values: Column) -> Column:
    """The element at half the sorted array, rounded down; null for an empty one."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def rms(samples: Column) -> Column:
    """Root mean square of an array; 0 if it is empty."""
    total = F.aggregate(samples, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return F.when(F.size(samples) > 0, F.sqrt(total / F.size(samples))).otherwise(0.0)


def mixed(mic: Column, system: Column) -> Column:
    """T4: sums of two frames within 16 bits, the shorter one filled up with silence."""
    total = F.zip_with(F.coalesce(mic, F.array()), F.coalesce(system, F.array()), lambda a, b: F.coalesce(a, F.lit(0)).cast("int") + F.coalesce(b, F.lit(0)).cast("int"))
    return F.transform(total, lambda v: F.greatest(F.lit(-32768), F.least(F.lit(32767), v)).cast("short"))


def pcm16(samples: Column) -> Column:
    """Samples of -1 to 1 as 16-bit numbers, clipped."""
    return F.transform(samples, lambda v: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round(v * 32767))).cast("short"))


def padded(samples: Column, n: Column) -> Column:
    """Samples after n zeros."""
    return F.concat(F.array_repeat(F.lit(0).cast("short"), n.cast("int")), samples)


def staleness(source: Column, latest: Column) -> Column:
    """an artifact is stale if its source version is known and is not the latest one, which is known too."""
    return F.coalesce(source != latest, F.lit(False))


def may_overwrite(current: Column, writer: str) -> Column:
    """a human's label is overwritten by a human alone."""
    return F.lit(writer == "human") | (F.coalesce(current, F.lit("none")) != "human")


def clock_verdict(unified: Column) -> Column:
    """whether two channels share a clock: yes, refused for a known no, refused for an unknown session."""
    return F.when(unified.isNull(), "no session").when(unified, "common").otherwise("separate")


def source_label(code: Column) -> Column:
    """Lenient parsing of a label source: what is unknown is none."""
    return F.when(code.isin("human", "voiceprint", "channel", "llm"), code).otherwise("none")
