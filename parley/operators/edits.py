"""Edits over segments: which one wins, how it is laid over, how it moves to a new version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import intervals

_PLACE = ["meeting_id", "channel", "start_ms", "end_ms"]


def winners(edits: DataFrame) -> DataFrame:
    """The last edit of each place by (created_at_ms, id)."""
    last = F.max_by(F.struct("id", "edited_text", "original_text", "origin", "created_at_ms"), F.struct("created_at_ms", "id"))
    return edits.groupBy(*_PLACE).agg(last.alias("e")).select(*_PLACE, "e.*")


def overlaid(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Segments with the winning edit of their place laid over."""
    won = winners(edits).select(*_PLACE, F.col("edited_text").alias("_edited"))
    both = segments.join(won, _PLACE, "left")
    return both.withColumns({"text_edited": F.col("_edited").isNotNull(), "original_text": F.col("text"), "text": F.coalesce("_edited", "text")}).drop("_edited")


def reattached(edits: DataFrame, segments: DataFrame) -> DataFrame:
    """Edits with the segment of a new version that they go to, null for those without one.

    A segment of the same channel is a home if it overlaps the edit in time and contains its
    original text; a blank original has none. The home with most overlap is taken, ties to the
    smallest index. One edit stays at each segment, the last by (created_at_ms, id).
    """
    target = segments.select("meeting_id", "channel", "idx", "start_ms", "end_ms", "text")
    moving = edits.where(F.trim("original_text") != "").select("id", "meeting_id", "channel", "start_ms", "end_ms", "original_text", "created_at_ms")
    homes = intervals.overlap_join(moving, target, ["meeting_id", "channel"]).where(F.contains(F.col("r_text"), F.col("original_text")))
    first = homes.groupBy("id", "meeting_id", "created_at_ms").agg(F.max_by("r_idx", F.struct("overlap", (-F.col("r_idx")).alias("before"))).alias("target_idx"))
    placed = first.groupBy("meeting_id", "target_idx").agg(F.max_by("id", F.struct("created_at_ms", "id")).alias("id")).select("id", "target_idx")
    return edits.join(placed, "id", "left")


def promotable(edits: DataFrame, terms: DataFrame) -> DataFrame:
    """Hint terms, visible in the edit's meeting, whose surface is the edit's original text in any case."""
    hints = terms.where("kind <> 1").select(F.lower("surface").alias("_key"), "canonical", F.col("id").alias("term_id"), "language", "scope", F.col("meeting_id").alias("_meeting"))
    both = edits.withColumn("_key", F.lower("original_text")).join(hints, "_key")
    return both.where((F.col("scope") == "global") | (F.col("_meeting") == F.col("meeting_id"))).drop("_key", "_meeting")


def bulk_edits(segments: DataFrame, edits: DataFrame, surface: str, canonical: str) -> DataFrame:
    """Edits that replace a promoted term wherever it stands as a word; a human's edits are left alone."""
    boundary = "[A-Za-z\\u0400-\\u052f\\u2de0-\\u2dff\\ua640-\\ua69f]"
    import re

    pattern = f"(?i)(?<!{boundary}){re.escape(surface)}(?!{boundary})"
    changed = segments.withColumn("edited_text", F.regexp_replace("text", pattern, canonical.replace("\\", "\\\\").replace("$", "\\$"))).where("edited_text <> text")
    human = winners(edits).where("origin = 'human'").select(*_PLACE)
    return changed.join(human, _PLACE, "left_anti").select(*_PLACE, F.col("text").alias("original_text"), "edited_text")
