"""Flows over several operators: planned edits, rebuilds and promotions, as one plan each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators import briefs, transcripts, vectors
from parley.operators import edits as E
from parley.sources.shared import written
from parley.sources.stored import StoredTable

_PLACE = ["meeting_id", "channel", "start_ms", "end_ms"]


def planned_edits(edits: DataFrame, segments: DataFrame) -> DataFrame:
    """What becomes of each edit: ``keep`` the last of its place, ``delete`` one that says what was recognised, ``obsolete`` the earlier ones.

    An edit without a segment at its place is ``homeless``.
    """
    order = Window.partitionBy(*_PLACE).orderBy(F.desc("created_at_ms"), F.desc("id"))
    texts = segments.select(*_PLACE, F.col("text").alias("_text")).dropDuplicates(_PLACE)
    rows = edits.withColumn("_n", F.row_number().over(order)).join(texts, _PLACE, "left")
    action = F.when(F.col("_text").isNull(), "homeless").when(F.col("_n") > 1, "obsolete").when(F.col("edited_text") == F.col("_text"), "delete").otherwise("keep")
    return rows.withColumn("action", action).drop("_n", "_text")


def promoted_hints(terms: DataFrame, uses: DataFrame) -> DataFrame:
    """Terms after their uses (term_id, meeting_id): a hint that two meetings or more used is global."""
    many = uses.groupBy(F.col("term_id").alias("id")).agg(F.count_distinct("meeting_id").alias("_m")).where("_m > 1")
    wide = (F.col("kind") != 1) & F.col("_m").isNotNull()
    both = terms.join(many, "id", "left")
    return both.withColumns({"scope": F.when(wide, "global").otherwise(F.col("scope")), "meeting_id": F.when(~wide, F.col("meeting_id"))}).drop("_m")


def stored_finals(bodies: DataFrame, versions: DataFrame) -> DataFrame:
    """Assembled bodies (meeting_id, body) as the next version of their meetings; 1 where there is none."""
    last = versions.groupBy("meeting_id").agg(F.max("version").alias("_v"))
    return bodies.join(last, "meeting_id", "left").select("meeting_id", (F.coalesce("_v", F.lit(0)) + 1).cast("long").alias("version"), "body")


def named_segments(segments: DataFrame, edits: DataFrame, names: DataFrame) -> DataFrame:
    """Segments with their winning edit laid over and their speaker's name (speaker_id, name), '' without one."""
    return E.overlaid(segments, edits).join(names, "speaker_id", "left").withColumn("name", F.coalesce("name", F.lit("")))


def rebuilt(segments: DataFrame, edits: DataFrame, threshold: float) -> DataFrame:
    """A rebuilt transcript's body of each meeting.

    Segments are clipped, their doubles collapsed, the edits moved to the segments that they fit and
    laid over, and the whole rendered.
    """
    fresh = transcripts.collapsed(transcripts.clipped(segments), threshold)
    homes = E.reattached(edits.select("id", "meeting_id", "channel", "start_ms", "end_ms", "original_text", "edited_text", "created_at_ms"), fresh).where("target_idx is not null")
    moved = homes.select("meeting_id", F.col("target_idx").alias("idx"), F.col("edited_text").alias("_edited"))
    return transcripts.rendered(fresh.join(moved, ["meeting_id", "idx"], "left").withColumn("text", F.coalesce("_edited", "text")).drop("_edited"))


def promoted(segments: DataFrame, edits: DataFrame, surface: str, canonical: str) -> DataFrame:
    """Bodies of the meetings that a promoted term changes, rendered with its bulk edits."""
    made = E.bulk_edits(segments, edits, surface, canonical).select(*_PLACE, F.col("edited_text").alias("_edited"))
    touched = segments.join(made.select("meeting_id").distinct(), "meeting_id", "left_semi")
    return transcripts.rendered(touched.join(made, _PLACE, "left").withColumn("text", F.coalesce("_edited", "text")).drop("_edited"))


@dataclass
class VoicePass:
    """What a voice pass finds: labels of all segments (id, meeting_id, speaker_id, source), prints, and counts of each meeting."""

    labels: DataFrame
    prints: DataFrame
    report: DataFrame


def voice_pass(segments: DataFrame, voices: DataFrame, accept: float = vectors.ACCEPT, margin: float = vectors.MARGIN) -> VoicePass:
    """Names for the segments of all meetings, first by the voices that humans named there, then by remembered ones.

    ``segments`` has id, meeting_id, speaker_id ('' for none), source, vector (null or empty for none) and ms;
    ``voices`` has speaker_id and vector. Prints are made of each meeting's human rows and compared within
    the meeting alone. A human label stays. Without a match a channel's label stays and any other goes;
    without a vector a former voiceprint goes. Rows that then have no name are held against the
    remembered voices, and named ``meeting:voice:name``.
    """
    rows = segments.withColumn("vector", F.when(F.size("vector") > 0, F.col("vector")))
    rows = written(rows.select("id", "meeting_id", F.coalesce("speaker_id", F.lit("")).alias("speaker_id"), F.coalesce("source", F.lit("none")).alias("source"), "vector", "ms"))
    human = rows.where("source = 'human' AND speaker_id <> '' AND vector IS NOT NULL").withColumn("_who", F.struct("meeting_id", "speaker_id"))
    size = human.groupBy("meeting_id", "speaker_id").agg(F.count("*").alias("samples"), F.sum("ms").alias("ms"))
    prints = written(vectors.centroids(human, "_who").select("_who.meeting_id", "_who.speaker_id", "vector").join(size, ["meeting_id", "speaker_id"]))
    ok = (F.col("similarity") >= accept) & (F.col("similarity") - F.col("runner_up") >= margin)
    match = lambda asked, known, by=None: vectors.nearest_two(asked, known.withColumnRenamed("speaker_id", "best"), by).where(ok).select("id", "best")
    own = match(rows.where("source <> 'human' AND vector IS NOT NULL"), prints.select("meeting_id", "speaker_id", "vector"), "meeting_id")
    free, heard, was = F.col("source") != "human", F.col("vector").isNotNull(), F.col("source")
    label = (
        F.when(~free | (~heard & (was != "voiceprint")), F.col("speaker_id"))
        .when(heard & F.col("best").isNotNull(), F.col("best"))
        .when(heard & (was == "channel"), F.col("speaker_id"))
        .otherwise("")
    )
    first = rows.join(own, "id", "left").withColumns({"_label": label, "_unknown": free & heard & F.col("best").isNull()}).drop("best")
    first = written(first.withColumn("_changed", free & (F.col("_label") != F.col("speaker_id"))))
    remembered = match(first.where(free & heard & (F.col("_label") == "")).select("id", "vector"), voices.select("speaker_id", "vector"))
    both = first.withColumn("heard", heard).drop("vector").join(remembered, "id", "left")
    known = F.col("best").isNotNull()
    final = F.when(known, F.concat_ws(":voice:", F.col("meeting_id").cast("string"), "best")).otherwise(F.col("_label"))
    source = F.when(known | (F.col("_changed") & (F.col("_label") != "")), "voiceprint").when(F.col("_changed"), "none").otherwise(was)
    made = written(both.withColumns({"_final": final, "_source": source, "_known": known}))
    count = lambda c, name: F.count_if(c).alias(name)
    of_prints = prints.groupBy("meeting_id").agg(F.count("*").alias("prints"))
    report = made.groupBy("meeting_id").agg(
        count(F.col("_changed") & (F.col("_label") != ""), "signed"),
        count(F.col("_changed") & (F.col("_label") == ""), "cleared"),
        count(F.col("_unknown"), "unknown"),
        count(free & ~F.col("heard"), "without_vector"),
        count(F.col("_known"), "signed_from_memory"),
    )
    report = report.join(of_prints, "meeting_id", "left").withColumn("prints", F.coalesce("prints", F.lit(0)))
    labels = made.select("id", "meeting_id", F.col("_final").alias("speaker_id"), F.col("_source").alias("source"))
    return VoicePass(labels, prints, report)


def apply_voice_pass(made: VoicePass, segments: DataFrame, prints: StoredTable, finals: StoredTable) -> None:
    """Writes a pass: prints of the meetings at hand are replaced whole, bodies that changed are rendered again.

    ``prints`` and ``finals`` are dealt by meeting_id; ``finals`` has meeting_id, version and body, and the latest version of a
    meeting is the one that is rendered. Made again, it changes nothing.
    """
    meetings = made.report.select("meeting_id")
    prints.delete(meetings.join(made.prints.select("meeting_id").distinct(), "meeting_id", "left_anti"), ["meeting_id"])
    prints.replace(made.prints, ["meeting_id"])
    stored = finals.rows().join(meetings, "meeting_id", "left_semi")
    last = stored.groupBy("meeting_id").agg(F.max("version").alias("version"))
    bodies = transcripts.rendered(segments.drop("speaker_id", "source").join(made.labels.select("id", "speaker_id", "source"), "id")).join(last, "meeting_id")
    finals.upsert(written(briefs.changed_only(stored, bodies).select("meeting_id", "version", "body")), ["meeting_id", "version"])
