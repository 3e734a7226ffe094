"""Short texts built from a transcript's body: briefs, follow-ups and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import text as T

SUMMARY_CHARS = 280


def brief(finals: DataFrame, cues: list[str]) -> DataFrame:
    """Of each body (meeting_id, body) the first paragraph, cut to 280 characters, and the paragraphs with a cue as bullets."""
    parts = finals.withColumn("_p", T.paragraphs(F.col("body")))
    marked = F.filter("_p", lambda p: T.has_cue(p, cues))
    return parts.select("meeting_id", F.coalesce(T.shortened(F.get("_p", F.lit(0)), SUMMARY_CHARS), F.lit("")).alias("summary"), T.bullets(marked).alias("actions"))


def collapse_note(report: DataFrame, language: str = "en") -> Column:
    """What a collapse did, in one of three languages; empty if it dropped nothing."""
    words = {"en": ("repeats dropped: ", ", short ones kept: "), "de": ("Wiederholungen entfernt: ", ", kurze behalten: "), "fr": ("répétitions retirées : ", ", courtes gardées : ")}
    head, tail = words[language]
    short = F.when(report["kept_short"] > 0, F.concat(F.lit(tail), report["kept_short"].cast("string"))).otherwise("")
    return F.when(report["collapsed"] > 0, F.concat(F.lit(head), report["collapsed"].cast("string"), short)).otherwise("")


def rebuild_note(source: Column, version: Column) -> Column:
    """Where a rebuilt text comes from."""
    return F.when(source == "audio", F.concat(F.lit("rebuilt from audio, version "), version.cast("string"))).otherwise(F.concat(F.lit("rebuilt from captions, version "), version.cast("string")))


def changed_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rendered bodies (meeting_id, version, body) that differ from the stored ones."""
    before = old.select("meeting_id", "version", F.col("body").alias("_old"))
    return new.join(before, ["meeting_id", "version"], "left").where(~F.col("body").eqNullSafe(F.col("_old"))).drop("_old")


def translated(rows: DataFrame, dictionary: DataFrame, source: str, target: str) -> DataFrame:
    """Texts by a dictionary of whole texts; a text in the target language or without an entry stays."""
    known = dictionary.where((F.col("source") == source) & (F.col("target") == target)).select(F.lower("text").alias("_key"), "translation")
    both = rows.withColumn("_key", F.lower(F.trim("text"))).join(known, "_key", "left")
    return both.withColumn("translation", F.when(F.col("language") == target, F.col("text")).otherwise(F.coalesce("translation", "text"))).drop("_key")


def step_breakdown(steps: DataFrame) -> DataFrame:
    """Sums of each step of a start, its share of the parent, and whether it takes a quarter or more.

    ``steps`` has session_id, parent, step and ms; the parent's own time is the row whose step is null.
    """
    whole = steps.where("step is null").groupBy("session_id", "parent").agg(F.sum("ms").alias("whole"))
    parts = steps.where("step is not null").groupBy("session_id", "parent", "step").agg(F.sum("ms").alias("ms"))
    both = parts.join(whole, ["session_id", "parent"])
    return both.withColumn("heavy", 4 * F.col("ms") >= F.col("whole"))
