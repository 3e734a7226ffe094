"""Series over frames: islands, correlation, gates and hypotheses in batch form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from parley.operators import folds, ordered
from parley.sources.shipping import ship

SPEECH_MARGIN, ABSOLUTE_FLOOR, RISE, FALL = 3.0, 120.0, 0.02, 0.25
HYSTERESIS = 1.5
MAX_PENDING = 24


def listed_once(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks (ts_ms, duration_ms, rate and seq) without copies of the same chunk, found side by side in ``chunk_islands``' order."""
    order = _chunk_order(keys)
    same = F.row_number().over(order) > 1
    for column in ("ts_ms", "seq", "duration_ms", "rate"):
        same &= F.lag(column).over(order).eqNullSafe(F.col(column))
    return chunks.withColumn("_same", same).where(~F.col("_same")).drop("_same")


def _chunk_order(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("ts_ms", "seq", "duration_ms", "rate")


def chunk_islands(chunks: DataFrame, keys: list[str], target_ms: int = 2000) -> DataFrame:
    """Contiguous chunks of one rate joined to chunks of about ``target_ms``.

    ``chunks`` has ts_ms, duration_ms, rate and seq. An island ends at a gap or a change of rate;
    inside, a new piece begins with each ``target_ms``. A piece is a run in the order of time, so all
    is read off running totals: one sort, and no table of pieces in memory.
    """
    order = _chunk_order(keys)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = lambda c: F.lag(c).over(order)
    breaks = before("ts_ms").isNull() | (before("ts_ms") + before("duration_ms") != F.col("ts_ms")) | (before("rate") != F.col("rate"))
    rows = chunks.withColumn("_b", breaks).withColumns({"island": F.sum(F.col("_b").cast("int")).over(so_far) - 1, "_start": F.last(F.when(F.col("_b"), F.col("ts_ms")), ignorenulls=True).over(so_far)})
    rows = rows.withColumn("piece", F.floor((F.col("ts_ms") - F.col("_start")) / target_ms))
    rows = rows.withColumn("_new", F.coalesce((before("island") != F.col("island")) | (before("piece") != F.col("piece")), F.lit(True)))
    totals = {"_ms": F.sum("duration_ms"), "_known": F.count("duration_ms"), "_n": F.count("*"), "_first": F.last(F.when(F.col("_new"), F.struct("ts_ms", "rate")), ignorenulls=True)}
    rows = rows.withColumns({name: total.over(so_far) for name, total in totals.items()} | {"_last": F.coalesce(F.lead("_new").over(order), F.lit(True))})
    # Among the last rows of the pieces, the row before has the totals up to the piece.
    since = lambda c: F.col(c) - F.coalesce(before(c), F.lit(0))
    ends = rows.where("_last").withColumns({"_k": since("_known"), "_d": since("_ms"), "chunks": since("_n")})
    return ends.select(*keys, "island", "piece", "_first.ts_ms", F.when(F.col("_k") > 0, F.col("_d")).alias("duration_ms"), "_first.rate", "chunks")


def speech_islands(frames: DataFrame, keys: list[str], frame_ms: int = 100, level: float = 200.0, close_after: int = 3) -> DataFrame:
    """Spans of loud frames; a span closes with the third silent frame, at that frame's start; an open one at the track's end."""
    order = Window.partitionBy(*keys).orderBy("ts_ms")
    last = F.max(F.col("ts_ms") + frame_ms).over(Window.partitionBy(*keys))
    loud = frames.withColumn("_end", last).where(F.col("level") >= level)
    new = F.lag("ts_ms").over(order).isNull() | (F.col("ts_ms") - F.lag("ts_ms").over(order) > close_after * frame_ms)
    spans = loud.withColumn("_n", new.cast("int")).withColumn("span", F.sum("_n").over(order) - 1)
    ends = F.max("ts_ms") + close_after * frame_ms
    return spans.groupBy(*keys, "span").agg(F.min("ts_ms").alias("start_ms"), F.least(ends, F.max("_end")).alias("end_ms"))


def dominant_channel(slots: DataFrame, keys: list[str]) -> DataFrame:
    """The louder channel by half as much again, else the one before; mic at first."""
    order = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    decided = F.when(F.col("system") > F.col("mic") * HYSTERESIS, "system").when(F.col("mic") > F.col("system") * HYSTERESIS, "mic")
    return slots.withColumn("dominant", F.coalesce(F.last(decided, ignorenulls=True).over(order), F.lit("mic")))


def smoothed(frames: DataFrame, keys: list[str], order: list[str], column: str, start: float = 1.0, share: float = 0.25) -> DataFrame:
    """``gain``, exponential smoothing of a column from ``start``: each value moves by ``share`` of its distance."""

    def step(now: float | None, rows: pa.RecordBatch) -> tuple[float, list[pa.Array]]:
        now, out = start if now is None else now, []
        for x in rows.column(column).to_pylist():
            now += (x - now) * share
            out.append(now)
        return now, [pa.array(out, pa.float64())]

    return folds.scan(frames, keys, order, step, "gain double")


def gate_rows(floor: float | None, levels: list[float]) -> tuple[float | None, list[bool], list[float]]:
    """T5: levels through the adaptive noise gate: the floor after them, and for each whether it is speech and its floor.

    The floor begins at the first level. A level over three floors and over 120 is speech. In
    speech the floor only falls; else it moves 0.25 of the way down or 0.02 up.
    """
    accepted, floors = [], []
    for level in levels:
        if floor is None:
            floor = level
        speech = level > max(floor * SPEECH_MARGIN, ABSOLUTE_FLOOR)
        if speech:
            floor = min(floor, level)
        else:
            floor += (level - floor) * (FALL if level < floor else RISE)
        accepted.append(speech)
        floors.append(floor)
    return floor, accepted, floors


def gated(frames: DataFrame, keys: list[str], order: list[str] | None = None, parts: int | None = None, report: list[int] | None = None) -> DataFrame:
    """Frames (ts_ms, level) with the gate's decision ``accepted`` and its ``floor``, each session in order of time and level.

    Sessions are folded in linear time, a long one in several ranges. Levels are not null.
    """

    def step(floor: float | None, rows: pa.RecordBatch) -> tuple[float | None, list[pa.Array]]:
        floor, accepted, floors = gate_rows(floor, rows.column("level").cast(pa.float64()).to_pylist())
        return floor, [pa.array(accepted, pa.bool_()), pa.array(floors, pa.float64())]

    return folds.scan(frames, keys, order or ["ts_ms", "level"], step, "accepted boolean, floor double", parts, report)


def agree_words(before: list[tuple[str, int]], words: list[tuple[str, int]], most: int = MAX_PENDING) -> tuple[int, list[tuple[str, int]]]:
    """How many words of a hypothesis (text, end_ms) are committed after the pending words of the one before, and those left.

    The words that both begin with are committed; so are words beyond the last ``most``. An empty
    hypothesis clears what was pending.
    """
    bare = lambda w: "".join(ch if ch.isalnum() else " " for ch in w).strip().lower()
    n = 0
    for (a, _), (b, _) in zip(before, words, strict=False):
        if not bare(a) or bare(a) != bare(b):
            break
        n += 1
    n = min(len(words), max(n, len(words) - most))
    return n, words[n:]


def agreed(hypotheses: DataFrame, keys: list[str], order: list[str], report: list[int] | None = None) -> DataFrame:
    """Hypotheses (``words``, an array of text and end_ms) with what each commits, what it leaves pending and the end of the last committed word."""

    def step(before: list | None, rows: pa.RecordBatch) -> tuple[list, list[pa.Array]]:
        before, made = before or [], []
        for words in rows.column("words").to_pylist():
            each = [(w["text"], w["end_ms"]) for w in words or []]
            n, before = agree_words(before, each)
            made.append((" ".join(t for t, _ in each[:n]), " ".join(t for t, _ in before), each[n - 1][1] if n else None))
        return before, [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.int64())]

    return folds.scan(hypotheses, keys, order, step, "committed string, pending string, until_ms long", report=report)


def _corr() -> Column:
    """Pearson correlation of v and w, null without variance (the built-in one divides by it)."""
    return F.try_divide(F.covar_pop("v", "w"), F.stddev_pop("v") * F.stddev_pop("w"))


def _block_sums(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], start: int, size: int, most: int) -> np.ndarray:
    """Of one block of ``a`` and the stretch of ``b`` around it, for each lag the pairs and the sums of v, w, vv, ww and vw.

    Places may be empty or hold several values. All six are correlations of one pair of series, so the
    two sides are transformed three times each and six products are transformed back.
    """
    width = size + 2 * most
    n = 1 << int(width + size).bit_length()

    def sides(at: np.ndarray, values: np.ndarray, first: int, length: int) -> list[np.ndarray]:
        return [np.fft.rfft(np.bincount(at - first, weights, length), n) for weights in (np.ones(len(at)), values, values * values)]

    one, v, vv = sides(*a, start, size)
    many, w, ww = sides(*b, start - most, width)
    correlate = lambda x, y: np.fft.irfft(np.conj(x) * y, n)[: 2 * most + 1]
    pairs = np.rint(correlate(one, many))
    return np.stack([pairs, *(correlate(x, y) for x, y in ((v, many), (one, w), (vv, many), (one, ww), (v, w)))])


def lag_correlation(a: DataFrame, b: DataFrame, keys: list[str], most: int, block: int = 8192) -> DataFrame:
    """Pearson correlation of two envelopes (at, v) at each lag; 0 for under two pairs or no variance.

    The best lag of each key has ``best``; only a correlation over 0 can be best. Places are cut into
    blocks, so a long key is many small tasks: a block of ``a`` meets the places of ``b`` within
    ``most`` of it, and answers with six sums a lag by fast Fourier transforms, which are added up.
    Values are taken from their key's mean first, as the sums cancel. Empty places and repeated ones
    count as the pairs that they make; rows with a null v or place make none.
    """
    size = max(block, 2 * most)
    sound = lambda df: df.where(F.col("at").isNotNull() & F.col("v").isNotNull()).select(*(F.col(k).alias(k) for k in keys), F.col("at").cast("long").alias("at"), F.col("v").cast("double").alias("v"))

    def centred(df: DataFrame) -> DataFrame:
        means = df.groupBy(*keys).agg(F.avg("v").alias("_m"))
        both = df.join(means, keys) if keys else df.crossJoin(F.broadcast(means))  # one row without keys
        return both.withColumn("v", F.col("v") - F.col("_m")).drop("_m")

    x, y = centred(sound(a)), centred(sound(b))
    place = lambda at: F.floor(at / size)
    x = x.withColumn("_block", place(F.col("at")))
    # A place near a bound belongs to two blocks.
    y = y.withColumn("_block", F.explode(F.array_distinct(F.array(place(F.col("at") - most), place(F.col("at") + most)))))
    by = [*keys, "_block"]
    kinds = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    sums = ["pairs", "sv", "sw", "svv", "sww", "svw"]
    names = [*keys, "lag", *sums]

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: [] for n in names}, schema=schema)
        side = lambda t: (t.column("at").to_numpy(), t.column("v").to_numpy())
        found = _block_sums(side(left), side(right), key[-1].as_py() * size, size, most)
        lags = np.flatnonzero(found[0] > 0)
        fixed = {k: pa.array([key[i].as_py()] * len(lags), schema.field(k).type) for i, k in enumerate(keys)}
        return pa.table({**fixed, "lag": pa.array(lags - most, pa.int32()), **{s: pa.array(found[i, lags]) for i, s in enumerate(sums)}}, schema=schema)

    ddl = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "lag int", *(f"{s} double" for s in sums)])
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    ship(a.sparkSession)
    blocks = x.groupBy(*by).cogroup(y.groupBy(*by)).applyInArrow(meet, ddl)
    total = blocks.groupBy(*keys, "lag").agg(*(F.sum(s).alias(s) for s in sums))
    n = F.col("pairs")
    spread = lambda square, plain: F.col(square) / n - F.col(plain) / n * F.col(plain) / n
    flat = lambda square, plain: spread(square, plain) <= F.col(square) / n * 1e-11 + 1e-300
    value = (F.col("svw") / n - F.col("sv") / n * F.col("sw") / n) / F.sqrt(spread("svv", "sv") * spread("sww", "sw"))
    corr = F.when((n < 2) | flat("svv", "sv") | flat("sww", "sw"), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value)))
    found = total.select(*keys, "lag", n.cast("long").alias("pairs"), corr.alias("corr"))
    # One row a key: the lags of a key are few, and the best is an aggregate.
    best = found.groupBy(*keys).agg(F.min_by("lag", F.struct((-F.round("corr", 9)).alias("c"), "lag")).alias("_best"), F.max(F.round("corr", 9)).alias("_top"))
    joined = found.join(best, keys) if keys else found.crossJoin(F.broadcast(best))  # one row without keys
    return joined.select(*keys, "lag", "pairs", "corr", ((F.col("lag") == F.col("_best")) & (F.col("_top") > 0)).alias("best"))


def plain_correlation(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of products over the root of the products of squares, not centred; 0 without energy."""
    power = F.sum(F.col("v") * F.col("v")) * F.sum(F.col("w") * F.col("w"))
    return pairs.groupBy(*keys).agg(F.when(power > 0, F.sum(F.col("v") * F.col("w")) / F.sqrt(power)).otherwise(0.0).alias("corr"))


def drift(lags: DataFrame, keys: list[str], limit: int = 100) -> DataFrame:
    """Whether lags range over more than ``limit`` and half of the steps or more go one way."""
    order = Window.partitionBy(*keys).orderBy("at")
    step = F.col("lag") - F.lag("lag").over(order)
    rows = lags.withColumn("_step", step)
    one_way = F.greatest(F.count_if(F.col("_step") >= 0), F.count_if(F.col("_step") <= 0))
    wide = F.max("lag") - F.min("lag") > limit
    return rows.groupBy(*keys).agg((wide & (2 * one_way >= F.count("*"))).alias("drifts"))


def sub_words(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces to words: a leading space begins a word; a word ends with its last piece."""
    order = Window.partitionBy(*keys).orderBy("at")
    starts = F.col("piece").rlike("^\\s") | (F.row_number().over(order) == 1)
    rows = tokens.where(F.trim("piece") != "").withColumn("_s", starts.cast("int")).withColumn("word", F.sum("_s").over(order) - 1)
    made = rows.groupBy(*keys, "word").agg(F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]), "")).alias("text"), F.max_by("end_ms", "at").alias("end_ms"))
    return made.where("text <> ''")


def minute_match(a: DataFrame, b: DataFrame, keys: list[str], size: int = 60) -> DataFrame:
    """Correlation of two envelopes (at, v) in each tumbling window of ``size`` places that both fill."""
    both = a.join(b.select(*keys, "at", F.col("v").alias("w")), [*keys, "at"])
    flat = (F.stddev_pop("v") == 0) | (F.stddev_pop("w") == 0)
    made = both.groupBy(*keys, F.floor(F.col("at") / size).alias("window")).agg(F.count("*").alias("n"), F.round(F.when(flat, 0.0).otherwise(_corr()), 9).alias("corr"))
    return made.where(F.col("n") == size).drop("n")


def gate_report(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Of gated frames the median and peak of the floor, its median in the last third, and acceptance by the gate and by a fixed 450.

    Frames are numbered and medians found without a session being gathered.
    """
    rows = ordered.numbered(frames.select(*keys, "ts_ms", "level", "accepted", "floor"), keys, ["ts_ms", "level"], "_n")
    whole = rows.groupBy(*keys).agg(F.count("*").alias("_total"), F.max("floor").alias("peak_floor"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("level") > 450).alias("accepted_fixed"))
    tail = rows.select(*keys, "_n", "floor").join(whole.select(*keys, "_total"), keys).where("3 * (_n - 1) >= 2 * _total")
    middle = ordered.upper_median(rows, keys, "floor").withColumnRenamed("median", "median_floor")
    late = ordered.upper_median(tail, keys, "floor").withColumnRenamed("median", "tail_floor")
    return whole.drop("_total").join(middle, keys).join(late, keys, "left").select(*keys, "median_floor", "tail_floor", "peak_floor", "accepted", "accepted_fixed")


def paced_inferences(frames: DataFrame, keys: list[str], base: int = 10, idle_rounds: int = 2, most: int = 3) -> DataFrame:
    """Inferences that a session costs: one for each ``base`` accepted frames, less often after idle rounds.

    After ``idle_rounds`` rounds without speech the pace slows by one more ``base`` up to ``most``;
    speech brings it back. ``frames`` is gated; the fold runs over a session's frames in order.
    """

    def step(state: tuple | None, rows: pa.RecordBatch) -> tuple[tuple, list[pa.Array]]:
        waited, idle, pace, heard = state or (0, 0, 1, False)
        ran = []
        for accepted in rows.column("accepted").to_pylist():
            heard, waited = heard or accepted, waited + 1
            full = waited >= pace * base
            ran.append(full)
            if full:
                idle = 0 if heard else idle + 1
                pace = 1 if heard else min(pace + 1, most) if idle >= idle_rounds else pace
                waited, heard = 0, False
        return (waited, idle, pace, heard), [pa.array(ran, pa.bool_())]

    order = [c for c in ("ts_ms", "level") if c in frames.columns]
    return folds.scan(frames, keys, order, step, "_ran boolean").groupBy(*keys).agg(F.count_if("_ran").cast("int").alias("inferences"))


def buffer_starts(rounds: DataFrame, keys: list[str], order: str, guard_ms: int = 200, most_ms: int = 30_000) -> DataFrame:
    """Where a session's audio buffer begins after each round.

    ``rounds`` has now_ms and until_ms, the end of what the round committed, or null. Audio before
    ``guard_ms`` short of a committed end goes, and so does what is older than ``most_ms``; a start never moves back.
    """
    over = Window.partitionBy(*keys).orderBy("now_ms", order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    floor = F.greatest(F.coalesce(F.col("until_ms") - guard_ms, F.lit(0)), F.col("now_ms") - most_ms)
    return rounds.withColumn("start_ms", F.greatest(F.lit(0), F.max(floor).over(over)))


def bounded(rows: DataFrame, keys: list[str], order: str, most: int = 256) -> DataFrame:
    """The first ``most`` diagnostics of each buffer; the rest is dropped, as the bound is the feature."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def due(script: DataFrame, column: str, after_ms: int, until_ms: int) -> DataFrame:
    """Rows of a script whose time has come since the last look."""
    return script.where((F.col(column) > after_ms) & (F.col(column) <= until_ms))
