"""Streams of audio frames: slot alignment of two channels, the noise gate and hypothesis agreement.

The exact rules need state that Spark's windows don't keep (a slot closes as soon as it is complete,
a late frame is late against what was emitted), so they run as stateful operators keyed by session.
Each has a batch twin over the same step functions. ``windowed`` is the native approximation.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from parley.operators import folds, signal
from parley.sources.shared import new_path, written
from parley.sources.shipping import ship

SLOT_MS, TOLERANCE = 100, 2
HYSTERESIS = 1.5
#: Fixed values of the gain: levels that are left alone, the level aimed at, its bound and its pace.
QUIET_FLOOR, QUIET_CEILING, TARGET, MAX_GAIN, PACE = 150.0, 700.0, 1200.0, 5.0, 0.25

MIXED = "session_id string, slot long, ts_ms long, dominant string, pcm array<int>, late long"
GATED = "session_id string, ts_ms long, level double, accepted boolean, floor double"
AGREED = "session_id string, iteration long, committed string, pending string, until_ms long"

#: Silence after which a session is over.
IDLE_MS = 30 * 60_000
#: Event time runs so far ahead of ts_ms: the watermark begins at 0, and rows at or below it count as late.
AHEAD_MS = 10 * 86_400_000
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Step = Callable[[dict, dict], list[dict]]
Flush = Callable[[dict], list[dict]]


def _rms(samples: list[int]) -> float:
    return math.sqrt(sum(x * x for x in samples) / len(samples)) if samples else 0.0


def _emit(state: dict, slot: int) -> dict:
    """One mixed slot: channels with their gains summed within 16 bits, and the dominant channel."""
    parts = state["slots"].pop(str(slot))
    level = {c: _rms(parts.get(c) or []) for c in ("mic", "system")}
    for c in level:
        aim = min(MAX_GAIN, max(1.0, TARGET / level[c])) if QUIET_FLOOR <= level[c] < QUIET_CEILING else 1.0
        state["gain"][c] += (aim - state["gain"][c]) * PACE
    for a, b in (("system", "mic"), ("mic", "system")):
        if level[a] > level[b] * HYSTERESIS:
            state["dominant"] = a
    mic, system = parts.get("mic") or [], parts.get("system") or []
    size = max(len(mic), len(system))
    at = lambda side, i: side[i] if i < len(side) else 0
    pcm = [int(max(-32768, min(32767, at(mic, i) * state["gain"]["mic"] + at(system, i) * state["gain"]["system"]))) for i in range(size)]
    state["next"] = slot + 1
    return {"slot": slot, "ts_ms": slot * SLOT_MS, "dominant": state["dominant"], "pcm": pcm, "late": state["late"]}


def mix_step(state: dict, row: dict) -> list[dict]:
    """Takes one frame; emits the slots that are complete or TOLERANCE slots behind, oldest first.

    A frame of a slot before the next one to emit is late: it is dropped and counted.
    """
    if not state:
        state.update({"slots": {}, "next": 0, "high": -1, "late": 0, "dominant": "mic", "gain": {"mic": 1.0, "system": 1.0}})
    slot = int(row["ts_ms"]) // SLOT_MS
    if slot < state["next"]:
        state["late"] += 1
        return []
    state["slots"].setdefault(str(slot), {}).setdefault(row["channel"], []).extend(int(x) for x in row["pcm"])
    state["high"] = max(state["high"], slot)
    out = []
    while state["slots"]:
        first = min(map(int, state["slots"]))
        if {"mic", "system"} <= state["slots"][str(first)].keys() or first + TOLERANCE <= state["high"]:
            out.append(_emit(state, first))
        else:
            break
    return out


def mix_flush(state: dict) -> list[dict]:
    """What is still held, oldest first."""
    return [_emit(state, slot) for slot in sorted(map(int, state.get("slots", {})))]


def gate_step(state: dict, row: dict) -> list[dict]:
    """T5: one level through the adaptive noise gate; the batch form is ``operators.signal.gated``."""
    level = float(row["level"])
    state["floor"], (speech,), (floor,) = signal.gate_rows(state.get("floor"), [level])
    return [{"ts_ms": int(row["ts_ms"]), "level": level, "accepted": speech, "floor": floor}]


def agree_step(state: dict, row: dict, most: int = signal.MAX_PENDING) -> list[dict]:
    """One hypothesis, a list of (text, end_ms); the batch form is ``operators.signal.agreed``."""
    words = [(w["text"], int(w["end_ms"])) for w in row["words"]]
    n, state["before"] = signal.agree_words(state.get("before", []), words, most)
    join = lambda part: " ".join(t for t, _ in part)
    return [{"iteration": int(row["iteration"]), "committed": join(words[:n]), "pending": join(words[n:]), "until_ms": words[n - 1][1] if n else None}]


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def advance(state: dict, rows: list[dict], step: Step, flush: Flush | None, idle_ms: int | None) -> list[dict]:
    """Rows of a session through ``step``; a pause of more than ``idle_ms`` flushes what is held and starts afresh.

    ``state`` is empty at first; it keeps the rule's own state and the latest ts_ms.
    """
    out = []
    for row in rows:
        at = int(row["ts_ms"]) if idle_ms is not None else 0
        if state and idle_ms is not None and at > state["last"] + idle_ms:
            out += flush(state["held"]) if flush else []
            state.clear()
        held = state.setdefault("held", {})
        out += step(held, row)
        state["last"] = max(state.get("last", at), at)
    return out


def _table(key: tuple, out: list[dict], schema: str) -> pd.DataFrame:
    """Made rows with their session; numbers that may be missing keep their kind."""
    names = _names(schema)
    return pd.DataFrame({n: pd.Series([key[0] if n == "session_id" else row[n] for row in out], dtype=object) for n in names}, columns=names)


class TimedRule(StatefulProcessor):
    """A rule keyed by session, whose state a timer flushes and removes once the watermark is ``idle_ms`` past its last row."""

    def __init__(self, step: Step, flush: Flush | None, schema: str, order: list[str], idle_ms: int) -> None:
        self.step, self.flush, self.schema, self.order, self.idle_ms = step, flush, schema, order, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        whole = pd.concat(list(rows)).sort_values(self.order, kind="stable").to_dict("records")
        out = advance(state, whole, self.step, self.flush, self.idle_ms)
        self.state.update((json.dumps(state),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(state["last"] + self.idle_ms + AHEAD_MS)
        yield _table(key, out, self.schema)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        self.state.clear()
        yield _table(key, self.flush(state["held"]) if state and self.flush else [], self.schema)

    def close(self) -> None:
        pass


def stateful(frames: DataFrame, step: Step, schema: str, order: list[str], flush: Flush | None = None, idle_ms: int = IDLE_MS, delay: str = "10 seconds") -> DataFrame:
    """A stream with ts_ms through ``step``, keyed by session_id; rows of a trigger go by ``order``.

    The state is a small JSON text for each session: a few open slots, a level or a few words. A
    session that is silent for ``idle_ms`` is over: a timer of the event time emits what is held
    (T13) and removes its state, so the state follows the sessions that are live. Frames that are
    late by less than ``delay`` reach the rule, which counts them; later ones are dropped by the watermark.
    The state is kept by the RocksDB store, which the session is set to if it has Spark's default.
    """
    spark = frames.sparkSession
    ship(spark)
    if "RocksDB" not in spark.conf.get(STORE, ""):
        spark.conf.set(STORE, ROCKS)
    timed = frames.withColumn("_ts", F.timestamp_millis(F.col("ts_ms") + AHEAD_MS)).withWatermark("_ts", delay)
    return timed.groupBy("session_id").transformWithStateInPandas(TimedRule(step, flush, schema, order, idle_ms), schema, "append", "eventTime")


def batch(frames: DataFrame, step: Step, schema: str, order: list[str], flush: Flush | None = None, idle_ms: int | None = None) -> DataFrame:
    """The batch twin of ``stateful``; with ``flush`` the held rest is emitted at the end, and at each pause of ``idle_ms``.

    Rows are dealt over ranges and sorted; a task reads a session's rows as they come, with the state
    alone in memory, and a session that crosses ranges carries it on (see ``operators.folds``).
    """
    names = [n for n in _names(schema) if n != "session_id"]
    rows_of = f"array<struct<{', '.join(f'`{f.name}`: {f.dataType.simpleString()}' for f in StructType.fromDDL(schema).fields if f.name in names)}>>"
    kind = to_arrow_type(StructType.fromDDL(f"x {rows_of}")["x"].dataType)
    cells = lambda many: pa.array([[{n: r[n] for n in names} for r in out] for out in many], kind)

    def rule(state: dict | None, rows: pa.RecordBatch) -> tuple[dict, list[pa.Array]]:
        state = state or {}
        made = [advance(state, [row], step, flush, idle_ms) for row in rows.to_pylist()]
        # What would be left if the session ended here; only that of its last row counts.
        rest = [[]] * (rows.num_rows - 1) + [flush(json.loads(json.dumps(state["held"]))) if flush else []]
        return state, [cells(made), cells(rest)]

    folded = written(folds.scan(frames, ["session_id"], order, rule, f"_out {rows_of}, _rest {rows_of}").select("session_id", *order, "_out", "_rest"))
    last = folded.groupBy("session_id").agg(F.max_by("_rest", F.struct(*order)).alias("_rest"))
    return folded.select("session_id", F.inline("_out")).union(last.select("session_id", F.inline("_rest"))).select(*_names(schema))


def windowed(frames: DataFrame, delay: str = "200 milliseconds") -> DataFrame:
    """T1, T2 natively: samples and loudest frame of each channel in tumbling slots under a watermark.

    It closes slots by the watermark alone, so a slot is not closed early for being complete.
    ``frames`` has session_id, ts (timestamp), channel and pcm.
    """
    loud = F.sqrt(F.aggregate("pcm", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.greatest(F.size("pcm"), F.lit(1)))
    slots = frames.withWatermark("ts", delay).withColumn("_level", loud).groupBy("session_id", F.window("ts", f"{SLOT_MS} milliseconds").alias("slot"))
    of = lambda c: F.coalesce(F.max(F.when(F.col("channel") == c, F.col("_level"))), F.lit(0.0)).alias(c)
    return slots.agg(of("mic"), of("system"), F.sum(F.size("pcm")).alias("samples")).select("session_id", F.col("slot.start").alias("start"), "mic", "system", "samples")


def sessions(levels: DataFrame, gap: str = "300 milliseconds", delay: str = "1 second") -> DataFrame:
    """T6, T19 approximately: spans of accepted frames that lie within ``gap`` of each other; levels has session_id, ts, level."""
    loud = levels.withWatermark("ts", delay).where("level >= 200")
    spans = loud.groupBy("session_id", F.session_window("ts", gap).alias("span")).agg(F.count("*").alias("frames"), F.max("level").alias("peak"))
    return spans.select("session_id", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "frames", "peak")


def correlated(requests: DataFrame, answers: DataFrame, within: str = "30 seconds") -> DataFrame:
    """Answers with the phase and channel of their request, by id, if they come in time. Both have id and ts."""
    a = requests.withWatermark("ts", within).select(F.col("id").alias("_id"), F.col("ts").alias("_ts"), "phase", "channel")
    b = answers.withWatermark("ts", within)
    return b.join(a, F.expr(f"id = _id AND ts >= _ts AND ts <= _ts + INTERVAL {within}")).drop("_id", "_ts")


def drained(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """What a stream gives for all that its sources hold now, as a table in the shared folder.

    The query's checkpoint lies beside the table, and its rows are committed once, also after a restart.
    """
    spark = stream.sparkSession
    path = new_path(spark, folder)
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def persist(captions: DataFrame, path: str, checkpoint: str):
    """A stream of captions appended to a Parquet table, batch by batch, without blank texts."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.where(F.trim("text") != "").withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(path)

    return captions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hold_step(state: dict, row: dict) -> list[dict]:
    """Final texts one by one; one that may begin a hallucination (``hold``) waits and is joined with the next.

    ``row`` has id, text, hold and drop: the flags of ``functions.text``. A text that is dropped
    takes the held one with it.
    """
    held = state.pop("held", None)
    text = row["text"] if held is None else f"{held} {row['text']}"
    if row["drop"]:
        return []
    if row["hold"] and held is None:
        state["held"] = text
        return []
    return [{"id": int(row["id"]), "text": text}]


def attribute_step(state: dict, row: dict) -> list[dict]:
    """The channel of an event by majority of frames since the last final; mic wins ties.

    ``row`` is a frame (kind 'frame', channel) or an event (kind 'partial' or 'final', id).
    """
    if row["kind"] == "frame":
        state[row["channel"]] = state.get(row["channel"], 0) + 1
        return []
    channel = "system" if state.get("system", 0) > state.get("mic", 0) else "mic"
    if row["kind"] == "final":
        state.clear()
    return [{"id": int(row["id"]), "channel": channel}]
