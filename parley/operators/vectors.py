"""Voice prints: centroids, matching and evaluation."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from parley.operators.ordered import numbered
from parley.sources.shared import written
from parley.sources.shipping import ship

ACCEPT, MARGIN = 0.4, 0.05
#: Bytes of prints that a task compares trials with at once.
BLOCK_BYTES = 24 << 20


def centroids(vectors: DataFrame, key: str = "speaker_id") -> DataFrame:
    """Mean of the unit vectors of each key, of length 1 again.

    Vectors without length don't count; a key with vectors of several sizes has none.
    """
    x = vectors.withColumn("_x", F.transform("vector", lambda v: v.cast("double"))).withColumn("_norm", F.sqrt(F.aggregate("_x", F.lit(0.0), lambda s, v: s + v * v))).where("_norm > 0")
    cells = x.select(key, F.size("_x").alias("_size"), "_norm", F.posexplode("_x").alias("at", "v"))
    sums = cells.groupBy(key, "at").agg(F.sum(F.col("v") / F.col("_norm")).alias("v"), F.min("_size").alias("low"), F.max("_size").alias("high"))
    whole = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"), F.min("low").alias("low"), F.max("high").alias("high"), F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("v"))
    good = whole.where((F.col("low") == F.col("high")) & (F.col("norm") > 0))
    return good.select(key, F.transform("v", lambda c: c / F.col("norm")).alias("vector"))


def _prints_in_blocks(prints: DataFrame, names: list[str], rows: int) -> Iterator[list[Row]]:
    """The prints in parts of at most ``rows``, one part at a time, in order of their names."""
    kept = numbered(prints, [], names, "_at")
    kept = written(kept.withColumn("_block", F.floor((F.col("_at") - 1) / rows)))
    for k in range((kept.agg(F.max("_block")).first()[0] or 0) + 1):
        yield kept.where(F.col("_block") == k).orderBy("_at").collect()


def _unit(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1, and whether a vector has that width and a length at all."""
    out, sound = np.zeros((len(vectors), width)), np.zeros(len(vectors), bool)
    fit = [i for i, v in enumerate(vectors) if width and v is not None and len(v) == width and None not in v]
    if fit:
        x = np.array([vectors[i] for i in fit], float)
        norm = np.sqrt((x * x).sum(1))
        sound[fit] = norm > 0
        out[fit] = x / np.where(norm > 0, norm, 1.0)[:, None]
    return out, sound


def _two_of_block(block: list[Row], by: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of trials (id, vector and ``by``) the two best prints of a block, a row each.

    Candidates come from one matrix product; those near the second best are compared again in one fixed
    way, so that equal prints score alike and names break ties.
    """
    widths = {len(r["vector"]) for r in block if r["vector"] is not None}
    sides = {w: (*_unit([r["vector"] for r in block], w),) for w in widths}
    names = [r["best"] for r in block]
    groups = {}
    for i, r in enumerate(block):
        groups.setdefault(r[by] if by else None, []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            vectors = batch.column("vector").to_pylist()
            asked = batch.column(by).to_pylist() if by else [None] * len(vectors)
            matrices = {}
            for w, (known, sound) in sides.items():
                mine, fit = _unit(vectors, w)
                matrices[w] = (mine, known, fit, sound)
            for g in set(asked):
                if g is None and by:
                    continue  # a trial without a group meets no print
                columns = np.array(groups.get(g, []), int)
                if not len(columns):
                    continue
                rows = np.array([i for i, x in enumerate(asked) if x == g], int)
                score = np.full((len(rows), len(columns)), -1.0)
                for mine, known, fit, sound in matrices.values():
                    product = np.clip(mine[rows] @ known[columns].T, -1.0, 1.0)
                    score = np.where(fit[rows][:, None] & sound[columns][None, :], product, score)
                second = np.partition(score, -2, axis=1)[:, -2] if len(columns) > 1 else score[:, 0]
                for i, row in enumerate(rows):
                    near = np.flatnonzero(score[i] >= second[i] - 1e-9)
                    exact = []
                    for c in near:
                        value = -1.0
                        w = len(vectors[row]) if vectors[row] is not None else -1
                        if w in matrices and matrices[w][2][row] and matrices[w][3][columns[c]]:
                            value = float(np.clip((matrices[w][0][row] * matrices[w][1][columns[c]]).sum(), -1.0, 1.0))
                        exact.append((-value, names[columns[c]]))
                    out += [(row, -v, name) for v, name in heapq.nsmallest(2, exact)]
            ids = batch.column("id")
            at = pa.array([int(o[0]) for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(at), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.string())], ["id", "similarity", "best"])

    return run


def nearest_two(trials: DataFrame, prints: DataFrame, by: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id, best, similarity and runner_up (-1 for none) of each trial that has a print of its group to be compared with.

    ``trials`` has id and vector, ``prints`` best and vector, both the column ``by`` if there are groups.
    Prints go to the tasks in blocks of ``block_bytes`` at most, as a matrix; a task answers with two
    rows a trial and block, and only these are shuffled, where there are several blocks. Vectors of another
    width, without length or with nulls score -1. Ties go to the first name.
    """
    spark = trials.sparkSession
    ship(spark)
    kept = prints.select(F.col("best").cast("string").alias("best"), F.col("vector").cast("array<double>").alias("vector"), *([by] if by else []))
    kept = written(kept)
    widest = kept.agg(F.max(F.size("vector"))).first()[0] or 1
    rows = max(1, block_bytes // (8 * max(1, widest) + 64))
    asked = written(trials.select("id", F.col("vector").cast("array<double>").alias("vector"), *([by] if by else [])))
    schema = f"id {trials.schema['id'].dataType.simpleString()}, similarity double, best string"
    found = None
    for block in _prints_in_blocks(kept, ["best"], rows):
        part = asked.mapInArrow(_two_of_block(block, by), schema)
        found = part if found is None else found.union(part)
    place = Window.partitionBy("id").orderBy(F.desc("similarity"), "best")
    top = found.withColumns({"_n": F.row_number().over(place), "_next": F.lead("similarity").over(place)}).where("_n = 1")
    return top.select("id", "best", "similarity", F.coalesce("_next", F.lit(-1.0)).alias("runner_up"))


def matched(trials: DataFrame, prints: DataFrame, accept: float = ACCEPT, margin: float = MARGIN) -> DataFrame:
    """Each trial's best print, if it is similar enough and far enough from the runner-up.

    ``prints`` (speaker_id, vector) are one row a known voice. Returns the trials with best,
    similarity, runner_up and speaker (null if refused).
    """
    won = nearest_two(trials, prints.withColumnRenamed("speaker_id", "best"))
    ok = (F.col("similarity") >= accept) & (F.col("similarity") - F.col("runner_up") >= margin)
    return trials.join(won, "id").withColumn("speaker", F.when(ok, F.col("best")))


def enrolment(rows: DataFrame, accept: float = ACCEPT, margin: float = MARGIN) -> DataFrame:
    """New labels of a meeting's segments from the prints of those that a human labelled.

    Human rows keep their label. For the rest a match gives a label of source voiceprint; without a
    match a channel's own label stays and a former voiceprint label is cleared.
    """
    human = F.col("source") == "human"
    prints = centroids(rows.where(human))
    rest = matched(rows.where(~human & F.col("vector").isNotNull()), prints, accept, margin).select("id", "speaker")
    both = rows.join(rest, "id", "left")
    label = F.when(human, F.col("speaker_id")).when(F.col("speaker").isNotNull(), F.col("speaker")).when(F.col("source") == "voiceprint", F.lit(None)).otherwise(F.col("speaker_id"))
    source = F.when(human, "human").when(F.col("speaker").isNotNull(), "voiceprint").when(F.col("source") == "voiceprint", "none").otherwise(F.col("source"))
    return both.select("id", label.alias("speaker_id"), source.alias("source"))


def split_by_position(rows: DataFrame, key: str, order: str, rule: str = "even") -> DataFrame:
    """Training flag by place inside each key: every other row, or the first third."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    total = F.count("*").over(Window.partitionBy(key))
    return rows.withColumn("train", (place % 2 == 0) if rule == "even" else (place * 3 < total))


def held_out(rows: DataFrame, accepts: list[float], margin: float = MARGIN) -> DataFrame:
    """For each accept threshold the time named rightly, named wrongly and left unknown, on held-out rows.

    ``rows`` has id, speaker_id, vector, ms and train.
    """
    prints = centroids(rows.where("train"))
    tried = matched(rows.where("not train"), prints, -1.0, -2.0)
    levels = rows.sparkSession.createDataFrame([(a,) for a in accepts], "accept double")
    named = (F.col("similarity") >= F.col("accept")) & (F.col("similarity") - F.col("runner_up") >= margin)
    right = F.col("best") == F.col("speaker_id")
    ms = F.col("ms")
    both = tried.crossJoin(F.broadcast(levels))
    return both.groupBy("accept").agg(F.sum(F.when(named & right, ms).otherwise(0)).alias("named_ms"), F.sum(F.when(named & ~right, ms).otherwise(0)).alias("wrong_ms"), F.sum(F.when(~named, ms).otherwise(0)).alias("unknown_ms"))


def remembered(rows: DataFrame, voices: DataFrame, accept: float = ACCEPT, margin: float = MARGIN) -> DataFrame:
    """Rows without a label, with a vector, named by remembered voices of the same model.

    ``rows`` has id, source, vector and model_id; ``voices`` has speaker_id, vector and model_id.
    """
    open_rows = rows.where((F.col("source") == "none") & F.col("vector").isNotNull())
    won = nearest_two(open_rows, voices.withColumnRenamed("speaker_id", "best"), "model_id")
    ok = (F.col("similarity") >= accept) & (F.col("similarity") - F.col("runner_up") >= margin)
    return won.where(ok).select("id", F.col("best").alias("speaker_id"), "similarity")


def human_labels(segments: DataFrame, names: DataFrame) -> DataFrame:
    """segments that a human gave a speaker, with the speaker's name, or '' if it has none."""
    rows = segments.where((F.col("source") == "human") & (F.coalesce(F.col("speaker_id"), F.lit("")) != ""))
    return rows.join(names.select("speaker_id", "display_name"), "speaker_id", "left").withColumn("display_name", F.coalesce("display_name", F.lit("")))


def label_counts(segments: DataFrame, keys: list[str]) -> DataFrame:
    """segments without a speaker, and those that a human labelled."""
    return segments.groupBy(*keys).agg(F.count_if(F.coalesce(F.col("speaker_id"), F.lit("")) == "").alias("unidentified"), F.count_if(F.col("source") == "human").alias("human_labelled"))
