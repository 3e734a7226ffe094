"""Ordering, clipping and rendering of transcript segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import intervals

COLLAPSE_MIN_WORDS = 4


def merged(segments: DataFrame) -> DataFrame:
    """Both channels in one order by start, mic first, then end, with a number from 0."""
    rank = F.when(F.col("channel") == "mic", 0).otherwise(1)
    order = Window.partitionBy("meeting_id").orderBy("start_ms", rank, "end_ms", "idx")
    return segments.withColumn("position", (F.row_number().over(order) - 1).cast("long"))


def clipped(segments: DataFrame) -> DataFrame:
    """No segment begins before the latest end so far; blank texts are left out first."""
    rows = segments.where(F.trim("text") != "")
    before = Window.partitionBy("meeting_id", "channel").orderBy("start_ms", "idx").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.greatest("start_ms", "end_ms")).over(before)
    start = F.greatest(F.col("start_ms"), F.coalesce(latest, F.col("start_ms")))
    return rows.withColumns({"start_ms": start, "end_ms": F.greatest(F.col("end_ms"), start)})


def monotone_ends(words: DataFrame, fallback: Column, keys: list[str], order: str) -> DataFrame:
    """An end of 0 takes the fallback; ends never fall."""
    over = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.when(F.col("end_ms") == 0, fallback).otherwise(F.col("end_ms"))
    return words.withColumn("end_ms", F.max(filled).over(over))


def paragraphs(segments: DataFrame) -> DataFrame:
    """Paragraph number of each non-blank segment in merged order.

    A paragraph begins where the speaker or the channel changes, or after the end of a sentence.
    """
    rows = merged(segments).where(F.trim("text") != "")
    order = Window.partitionBy("meeting_id").orderBy("position")
    before = lambda c: F.lag(c).over(order)
    starts = before("speaker_id").isNull() | (before("speaker_id") != F.col("speaker_id")) | (before("channel") != F.col("channel")) | T.ends_sentence(before("text"))
    return rows.withColumn("_new", starts.cast("int")).withColumn("paragraph", F.sum("_new").over(order) - 1).drop("_new")


def rendered(segments: DataFrame) -> DataFrame:
    """One Markdown text a meeting: a paragraph is its speaker in bold and its texts."""
    whole = paragraphs(segments).groupBy("meeting_id", "paragraph").agg(F.first("speaker_id").alias("speaker_id"), F.sort_array(F.collect_list(F.struct("position", F.trim("text").alias("text")))).alias("lines"))
    body = F.concat(F.lit("**"), F.col("speaker_id"), F.lit(":** "), F.array_join(F.transform("lines", lambda x: x["text"]), " "))
    lines = whole.select("meeting_id", F.struct("paragraph", body.alias("body")).alias("p"))
    return lines.groupBy("meeting_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["body"]), "\n\n").alias("body"))


def assembled(captions: DataFrame) -> DataFrame:
    """Final captions of a session in one text, a blank line after the end of a sentence, else a space."""
    rows = captions.where((F.col("phase") == "final") & (F.trim("text") != "")).select("session_id", "created_at_ms", "id", F.trim("text").alias("text"))
    parts = rows.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("created_at_ms", "id", "text"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(""), lambda s, x: F.when(s == "", x["text"]).when(T.ends_sentence(s), F.concat(s, F.lit("\n\n"), x["text"])).otherwise(F.concat(s, F.lit(" "), x["text"])))
    return parts.select("session_id", joined.alias("body"))


def live_lines(captions: DataFrame) -> DataFrame:
    """A partial caption stays only while nothing follows it."""
    order = Window.partitionBy("session_id").orderBy("created_at_ms", "id")
    return captions.withColumn("_next", F.lead("id").over(order)).where((F.col("phase") == "final") | F.col("_next").isNull()).drop("_next")


def twins(segments: DataFrame) -> DataFrame:
    """Each mic segment's best overlapping system segment, with its similarity and the words of the shorter side."""
    rows = segments.withColumn("words", T.words(F.col("text"))).drop("text")
    mic, system = rows.where("channel = 'mic'"), rows.where("channel = 'system'").select("meeting_id", "idx", "start_ms", "end_ms", "words")
    pairs = intervals.overlap_join(mic, system, ["meeting_id"]).withColumns({"similarity": T.word_similarity(F.col("words"), F.col("r_words")), "shorter": F.least(F.size("words"), F.size("r_words"))})
    return intervals.best_pair(pairs.drop("words", "r_words"), ["meeting_id", "idx"], "overlap", "r_idx")


def collapsed(segments: DataFrame, threshold: float, touched: Column | None = None) -> DataFrame:
    """G1: segments without the mic copies of what the system channel has.

    A mic segment goes if its best twin is at least ``threshold`` similar, the shorter side has four
    words or more and no hand touched it. The threshold is over 0 and at most 1.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and at most 1")
    hand = touched if touched is not None else F.lit(False)
    gone = twins(segments.withColumn("_hand", hand)).where((F.col("similarity") >= threshold) & (F.col("shorter") >= COLLAPSE_MIN_WORDS) & ~F.col("_hand"))
    return segments.join(gone.select("meeting_id", "idx"), ["meeting_id", "idx"], "left_anti")


def collapse_report(segments: DataFrame, threshold: float) -> DataFrame:
    """Of each meeting the segments, the paired and lonely mic ones, and those collapsed or kept for shortness."""
    found = twins(segments)
    alike = F.col("similarity") >= threshold
    pairs = found.groupBy("meeting_id").agg(F.count("*").alias("paired"), F.count_if(alike & (F.col("shorter") >= COLLAPSE_MIN_WORDS)).alias("collapsed"), F.count_if(alike & (F.col("shorter") < COLLAPSE_MIN_WORDS)).alias("kept_short"))
    totals = segments.groupBy("meeting_id").agg(F.count("*").alias("segments"), F.count_if(F.col("channel") == "mic").alias("mic_total"), F.count_if(F.col("channel") == "system").alias("system_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    both = totals.join(pairs, "meeting_id", "left").select("meeting_id", "segments", "mic_total", "system_total", zero("paired"), zero("collapsed"), zero("kept_short"))
    return both.withColumns({"lonely_mic": F.col("mic_total") - F.col("paired"), "kept": F.col("segments") - F.col("collapsed")})
