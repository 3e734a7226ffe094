"""Frames of audio as arrays: tracks, ranges, windows and echo."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parley.functions import scalars
from parley.operators import folds
from parley.operators.ordered import running
from parley.sources.shared import written
from parley.sources.shipping import ship

MAX_RANGE_MS = 30_000


def whole_track(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of a track in order of seq; an error where a chunk's count is not that of its samples."""
    sound = F.assert_true(F.size("pcm") == F.col("frame_count"), F.lit("a chunk does not have the samples it claims"))
    checked = chunks.withColumn("_ok", sound).where("_ok is null")
    return checked.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", "pcm"))), lambda x: x["pcm"])).alias("pcm"))


def track_range(chunks: DataFrame, keys: list[str], start_ms: int, end_ms: int) -> DataFrame:
    """Samples of [start, end), at most 30 s; chunks outside are not read."""
    if not 0 <= end_ms - start_ms <= MAX_RANGE_MS:
        raise ValueError("a range has at most 30 seconds")
    ends = F.col("timestamp_ms") + F.floor(F.col("frame_count") * 1000 / F.col("sample_rate"))
    hit = chunks.where((F.col("timestamp_ms") < end_ms) & (ends > start_ms))
    skip = scalars.frame_of(F.greatest(F.lit(start_ms) - F.col("timestamp_ms"), F.lit(0)), F.col("sample_rate")).cast("int")
    stop = F.least(F.col("frame_count"), scalars.frame_of(F.lit(end_ms) - F.col("timestamp_ms"), F.col("sample_rate"))).cast("int")
    cut = F.slice("pcm", skip + 1, F.greatest(stop - skip, F.lit(0)))
    return hit.groupBy(*keys).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seq", cut.alias("pcm")))), lambda x: x["pcm"])).alias("pcm"))


def decoded(files: DataFrame) -> DataFrame:
    """Little-endian 16-bit samples of raw chunks (path, content)."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "pcm": [np.frombuffer(bytes(c)[: len(c) // 2 * 2], "<i2").tolist() for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, pcm array<int>")


def framed(tracks: DataFrame, keys: list[str], size: int = 1600) -> DataFrame:
    """A track's samples in frames of ``size``, the last one shorter."""
    cells = tracks.select(*keys, F.size("pcm").alias("n"), "pcm").where("n > 0").withColumn("frame", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))))
    return cells.select(*keys, "frame", F.slice("pcm", F.col("frame") * size + 1, F.lit(size)).alias("pcm"))


def loudest(starts: DataFrame, keys: list[str], width: int, most: int = 3) -> DataFrame:
    """Of windows (keys, at, rms) up to ``most`` a key, loudest first, none within ``width`` of a louder one; ``turn`` from 1.

    Each round takes every key's loudest (the first of equals) by an aggregate, and drops what it overlaps.
    """
    left, found = written(starts.select(*keys, "at", "rms")), None
    for turn in range(1, most + 1):
        best = left.groupBy(*keys).agg(F.max_by(F.struct("at", "rms"), F.struct("rms", (-F.col("at")).alias("first"))).alias("_b"))
        best = written(best.select(*keys, "_b.at", "_b.rms", F.lit(turn).alias("turn")))
        found = best if found is None else found.union(best)
        if turn < most:
            chosen = best.select(*keys, F.col("at").alias("_at"))
            # Without keys there is one row.
            met = left.join(chosen, keys) if keys else left.crossJoin(F.broadcast(chosen))
            left = written(met.where(F.abs(F.col("at") - F.col("_at")) >= width).drop("_at"))
    return found


def loudest_windows(levels: DataFrame, keys: list[str], width: int, most: int = 3) -> DataFrame:
    """Up to ``most`` windows of ``width`` places, stride a quarter, loudest first, none overlapping a louder one."""
    stride = max(1, width // 4)
    order = Window.partitionBy(*keys).orderBy("at").rangeBetween(0, width - 1)
    sums = levels.withColumn("power", F.sum(F.col("level") * F.col("level")).over(order)).withColumn("_n", F.count("*").over(order))
    starts = sums.where((F.col("_n") == width) & (F.col("at") % stride == 0)).select(*keys, "at", F.sqrt(F.col("power") / width).alias("rms"))
    return loudest(starts, keys, width, most).drop("turn")


@dataclass
class EchoRules:
    """Fixed values of the echo search, in milliseconds, samples (taps) and levels of 16-bit samples."""

    rate: int = 16_000
    window_ms: int = 300
    max_delay_ms: int = 250
    probe_ms: int = 4_000
    probes: int = 3
    least_correlation: float = 0.3
    guard_ms: int = 3
    taps: int = 1_024
    pace: float = 0.5
    least_rms: float = 120.0
    explained: float = 0.5

    def frames(self, ms: int) -> int:
        return ms * self.rate // 1000


def _numbers(column: pa.Array, i: int) -> np.ndarray:
    value = column[i]
    return np.asarray(value.values.to_numpy(zero_copy_only=False), float) if value.is_valid else np.zeros(0)


def _overlaps(first: int, n: int, width: int, stride: int) -> range:
    """Numbers of the windows of ``width``, one each ``stride``, that a stretch of n samples from ``first`` on touches."""
    return range(max(0, -(-(first - width + 1) // stride)), (first + n - 1) // stride + 1) if n else range(0)


def echo_delays(frames: DataFrame, keys: list[str], rules: EchoRules) -> DataFrame:
    """The lag at which the microphone is most like the system channel, and its correlation (not centred).

    It is looked for in the loudest stretches of the system channel alone; of equal correlations the louder
    stretch and then the smaller lag wins. Keys shorter than a stretch have no row.
    """
    probe, most = max(1, rules.frames(rules.probe_ms)), rules.frames(rules.max_delay_ms)
    stride = max(1, probe // 4)
    typed = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)

    def energies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, sums, counts = [], [], [], []
            for i, first in enumerate(batch.column("start").to_pylist()):
                x = _numbers(batch.column("system"), i)
                total = np.concatenate(([0.0], np.cumsum(x * x)))
                for k in _overlaps(first, len(x), probe, stride):
                    a, b = max(k * stride - first, 0), min(k * stride + probe - first, len(x))
                    rows.append(i)
                    starts.append(k * stride)
                    sums.append(total[b] - total[a])
                    counts.append(b - a)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pa.array(starts, pa.int64()), pa.array(sums, pa.float64()), pa.array(counts, pa.int64())], [*keys, "at", "power", "n"])

    parts = frames.select(*keys, "start", "system").mapInArrow(energies, ", ".join(x for x in (typed, "at long, power double, n long") if x))
    whole = parts.groupBy(*keys, "at").agg(F.sum("power").alias("power"), F.sum("n").alias("n")).where(F.col("n") == probe)
    places = loudest(whole.select(*keys, "at", F.sqrt(F.col("power") / probe).alias("rms")), keys, probe, rules.probes).select(*keys, F.col("at").alias("_probe"), "turn")
    met = frames.select(*keys, "start", F.greatest(F.size("mic"), F.size("system")).alias("_n"), "mic", "system")
    met = met.join(places, keys) if keys else met.crossJoin(F.broadcast(places))  # a few rows without keys
    met = met.where((F.col("start") < F.col("_probe") + probe + most) & (F.col("start") + F.col("_n") > F.col("_probe"))).drop("_n")
    names = [*keys, "turn", "lag", "correlation"]
    schema = to_arrow_schema(StructType.fromDDL(", ".join(x for x in (typed, "turn int, lag int, correlation double") if x)))

    def look(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("start").combine_chunks()
        start, turn = key[-2].as_py(), key[-1].as_py()
        mic, system, heard, played = np.zeros(probe + most), np.zeros(probe), 0, 0
        for i, first in enumerate(rows.column("start").to_pylist()):
            for side, track in (("mic", mic), ("system", system)):
                x = _numbers(rows.column(side).chunk(0) if isinstance(rows.column(side), pa.ChunkedArray) else rows.column(side), i)
                a, b = max(first - start, 0), min(first - start + len(x), len(track))
                if b > a:
                    track[a:b] = x[a - (first - start) : b - (first - start)]
                    heard, played = (max(heard, b), played) if side == "mic" else (heard, max(played, b))
        if heard <= most:
            return schema.empty_table()
        n = 1 << int(len(mic) + probe).bit_length()
        product = np.fft.irfft(np.conj(np.fft.rfft(system, n)) * np.fft.rfft(mic, n), n)[: most + 1]
        lags = np.arange(most + 1)
        length = np.minimum(heard - lags, probe)
        power = lambda x: np.concatenate(([0.0], np.cumsum(x * x)))
        heard_power, played_power = power(mic), power(system)
        scale = np.sqrt(np.maximum((heard_power[lags + np.maximum(length, 0)] - heard_power[lags]) * played_power[np.maximum(length, 0)], 0))
        value = np.where((scale > 1e-9) & (length > 0), product / np.where(scale > 1e-9, scale, 1.0), 0.0)
        value[(length <= 0) | (length > played)] = -2.0
        best = int(np.argmax(np.round(value, 9)))
        if value[best] < -1.5:
            return schema.empty_table()
        fixed = {k: pa.array([key[i].as_py()], schema.field(k).type) for i, k in enumerate(keys)}
        return pa.table({**fixed, "turn": pa.array([turn], pa.int32()), "lag": pa.array([best], pa.int32()), "correlation": pa.array([float(value[best])])}, schema=schema).select(names)

    found = met.groupBy(*keys, "_probe", "turn").applyInArrow(look, ", ".join(x for x in (typed, "turn int, lag int, correlation double") if x))
    order = F.struct(F.round("correlation", 9).alias("c"), (-F.col("turn")).alias("t"), (-F.col("lag")).alias("l"))
    return found.groupBy(*keys).agg(F.max_by("lag", order).alias("delay"), F.max("correlation").alias("correlation"))


class _Canceller:
    """A normalised least-mean-squares filter that follows the system channel; its state goes from row to row."""

    def __init__(self, rules: EchoRules) -> None:
        self.rules = rules
        self.weights = np.zeros(rules.taps)  # for the oldest sample of the stretch first
        self.tail = np.zeros(0)  # the system channel's last samples
        self.seen = 0  # samples of it so far

    def residual(self, first: int, mic: np.ndarray, system: np.ndarray, delay: int) -> tuple[np.ndarray, np.ndarray]:
        """What the filter leaves of the microphone's samples, and the system's samples that they are held against."""
        taps, weights = self.rules.taps, self.weights
        track = np.concatenate((self.tail, system))
        self.seen += len(system)
        begin = self.seen - len(track)  # the place of track[0]
        power = np.concatenate(([0.0], np.cumsum(track * track)))
        left, reference = mic.copy(), np.zeros(len(mic))
        for j in range(len(mic)):
            end = first + j - delay + 1 - begin
            if 0 < end <= len(track):
                reference[j] = track[end - 1]
            if taps <= end <= len(track) and first + j - delay + 1 >= taps:
                x = track[end - taps : end]
                left[j] -= weights @ x
                loud = power[end] - power[end - taps]
                if loud > 0:
                    weights += self.rules.pace * left[j] / (loud + 1.0) * x
        self.tail = track[max(0, len(track) - taps - delay) :]
        return left, reference


def echo_windows(frames: DataFrame, keys: list[str], rules: EchoRules | None = None) -> DataFrame:
    """How much of each window of the microphone the system channel explains, and whether it is an echo.

    ``frames`` has ``start`` (the place of a row's first sample) and ``mic`` and ``system`` (arrays of samples from there
    on, at most as long as a row; contiguous). The delay comes from ``echo_delays``; keys whose best correlation
    is under the least one have no windows. From a guard before the delay on an adaptive filter of ``taps``
    follows the system channel, sample by sample; what it removes of a window's energy is explained. Only whole
    windows count. A key's filter runs through its rows in order with the weights and a short tail in memory;
    keys run side by side. A window is an echo if both channels are loud and enough is explained.
    """
    rules = rules or EchoRules()
    ship(frames.sparkSession)
    window, guard = max(1, rules.frames(rules.window_ms)), rules.frames(rules.guard_ms)
    delays = written(echo_delays(frames, keys, rules)).where(F.col("correlation") >= rules.least_correlation)
    rows = frames.select(*keys, "start", "mic", "system")
    rows = rows.join(delays, keys) if keys else rows.crossJoin(F.broadcast(delays))  # one row without keys

    def step(state: _Canceller | None, batch: pa.RecordBatch) -> tuple[_Canceller, list[pa.Array]]:
        state = state or _Canceller(rules)
        out = []
        for i, (first, delay) in enumerate(zip(batch.column("start").to_pylist(), batch.column("delay").to_pylist(), strict=True)):
            mic = _numbers(batch.column("mic"), i)
            if state.seen == 0 and not len(state.tail):
                state.seen = first  # a key begins at its first row
            left, reference = state.residual(first, mic, _numbers(batch.column("system"), i), max(0, delay - guard))
            sums = []
            for k in range(first // window, (first + len(mic) - 1) // window + 1 if len(mic) else 0):
                a, b = max(k * window - first, 0), min((k + 1) * window - first, len(mic))
                sums.append({"k": k, "n": b - a, "mic": float((mic[a:b] ** 2).sum()), "left": float((left[a:b] ** 2).sum()), "system": float((reference[a:b] ** 2).sum())})
            out.append(sums)
        kind = pa.list_(pa.struct([("k", pa.int64()), ("n", pa.int64()), ("mic", pa.float64()), ("left", pa.float64()), ("system", pa.float64())]))
        return state, [pa.array(out, kind)]

    made = folds.scan(rows, keys, ["start"], step, "_sums array<struct<k:bigint,n:bigint,mic:double,left:double,system:double>>")
    sums = made.select(*keys, "delay", F.inline("_sums")).groupBy(*keys, "delay", "k").agg(*(F.sum(c).alias(c) for c in ("n", "mic", "left", "system"))).where(F.col("n") == window)
    level = lambda c: F.sqrt(F.col(c) / window)
    share = F.when(F.col("mic") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("left") / F.col("mic")))).otherwise(0.0)
    ms = lambda c: F.floor(c * 1000 / rules.rate)
    rows = sums.select(*keys, F.col("k").alias("window"), ms(F.col("k") * window).alias("start_ms"), ms((F.col("k") + 1) * window).alias("end_ms"), ms(F.col("delay")).alias("delay_ms"), share.alias("explained"), level("mic").alias("mic_rms"), level("system").alias("system_rms"))
    return rows.withColumn("echo", (F.col("mic_rms") >= rules.least_rms) & (F.col("system_rms") >= rules.least_rms) & (F.col("explained") >= rules.explained))


def resampling_weight(distance: Column, up: int, down: int, reach: int) -> Column:
    """The weight of a sample that lies ``distance`` samples from the wanted place: a sinc under a raised cosine of ``reach``."""
    cut = min(1.0, up / down)
    x = F.lit(math.pi * cut) * distance
    sinc = F.when(F.abs(distance) < 1e-12, F.lit(cut)).otherwise(F.lit(cut) * F.sin(x) / x)
    return F.when(F.abs(distance) >= reach, 0.0).otherwise(sinc * (0.5 + 0.5 * F.cos(F.lit(math.pi) * distance / reach)))


def kernel(distance: np.ndarray, up: int, down: int, reach: int) -> np.ndarray:
    """``resampling_weight`` of an array."""
    cut = min(1.0, up / down)
    return np.where(np.abs(distance) >= reach, 0.0, cut * np.sinc(cut * distance) * (0.5 + 0.5 * np.cos(np.pi * distance / reach)))


def resampled(chunks: DataFrame, keys: list[str], rate: int, to: int = 16_000, channels: int = 1, reach: int = 16) -> DataFrame:
    """Chunks (seq, samples interleaved by channel) mixed down to one channel and brought to another rate, chunk by chunk.

    Output sample n stands at n * rate / to input samples and is a weighted sum of the input within ``reach`` of it (of
    the lower rate's samples), so each of the to / gcd phases has one set of weights. The last samples of a chunk
    go with the next one: outputs are those of the whole track, whatever the chunks' bounds, and outside the track is
    silence. Returns keys, seq, ``first`` (the place of the chunk's first output) and ``pcm``. A chunk gives the outputs
    whose whole reach has come; the last one gives the rest.
    """
    ship(chunks.sparkSession)
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    reach = reach * max(1, -(-down // up))
    sized = chunks.select(*keys, "seq", F.col("samples").cast("array<double>").alias("samples"), F.floor(F.size("samples") / channels).alias("_n"))
    placed = running(sized, keys, ["seq"], {"_until": F.col("_n")})
    whole = placed.groupBy(*keys).agg(F.max("_until").alias("_whole"))
    placed = placed.join(whole, keys) if keys else placed.crossJoin(F.broadcast(whole))  # one row without keys
    # Weights of each phase, from the first sample in reach on.
    offsets = np.arange(-reach, reach + 1)
    table = np.stack([kernel(offsets - phase / up, up, down, reach) for phase in range(up)])

    def ready(until: int, whole: int) -> int:
        """Outputs whose reach lies before ``until``, or all of them at the end."""
        return -(-whole * up // down) if until >= whole else max(0, -(-(until - reach) * up // down))

    def step(state: tuple | None, batch: pa.RecordBatch) -> tuple[tuple, list[pa.Array]]:
        tail = np.zeros(0) if state is None else state[0]
        firsts, out = [], []
        for i, (n, until, total) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_n", "_until", "_whole")), strict=True)):
            mixed = _numbers(batch.column("samples"), i)[: n * channels].reshape(n, channels).mean(1) if n else np.zeros(0)
            track = np.concatenate((tail, mixed))
            begin = until - len(track)
            low, high = min(ready(until - n, total), ready(until, total)) if until - n > 0 else 0, ready(until, total)
            at = np.arange(low, high)
            centre, phase = at * down // up, at * down % up
            padded = np.concatenate((np.zeros(2 * reach + 1), track, np.zeros(2 * reach + 1)))
            index = centre[:, None] + offsets[None, :] - begin + 2 * reach + 1
            out.append((padded[np.clip(index, 0, len(padded) - 1)] * table[phase]).sum(1) if len(at) else np.zeros(0))
            firsts.append(low)
            tail = track[max(0, len(track) - 3 * reach - 2) :]
        return (tail,), [pa.array(firsts, pa.int64()), pa.array(out, pa.list_(pa.float64()))]

    made = folds.scan(placed, keys, ["seq"], step, "first long, pcm array<double>")
    return made.select(*keys, "seq", "first", "pcm")
