"""Statistics per speaker of a meeting."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def speaker_stats(segments: DataFrame) -> DataFrame:
    """A1: replies, speaking time, share of the attributed time and first channel of each speaker.

    Segments with a blank or null speaker don't count, nor does their time. ``position`` numbers a
    meeting's speakers from 0 by speaking time, longest first, ties by name. A meeting whose
    attributed time is 0 has shares of 0.
    """
    per = (
        segments.where(F.col("speaker_id") != "")
        .groupBy("meeting_id", "speaker_id")
        .agg(
            F.count("*").alias("replies"),
            F.sum(F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))).alias("speaking_ms"),
            F.min_by("channel", "idx").alias("channel"),
        )
    )
    whole = F.sum("speaking_ms").over(Window.partitionBy("meeting_id"))
    order = Window.partitionBy("meeting_id").orderBy(F.desc("speaking_ms"), "speaker_id")
    return per.select(
        "*",
        F.when(whole == 0, 0.0).otherwise(F.col("speaking_ms").cast("double") / whole.cast("double")).alias("share"),
        (F.row_number().over(order) - 1).cast("long").alias("position"),
    )


def with_silent(stats: DataFrame, speakers: DataFrame) -> DataFrame:
    """The statistics, then the meeting's speakers without a reply in list order, with nothing said.

    ``speakers`` has meeting_id, speaker_id and sort_index.
    """
    silent = speakers.join(stats, ["meeting_id", "speaker_id"], "left_anti").select("meeting_id", "speaker_id", F.lit(0).cast("long").alias("replies"), F.lit(0).cast("long").alias("speaking_ms"), F.lit(None).cast("string").alias("channel"), F.lit(0.0).alias("share"), (F.lit(1_000_000) + F.col("sort_index")).cast("long").alias("position"))
    both = stats.unionByName(silent)
    order = Window.partitionBy("meeting_id").orderBy("position", "speaker_id")
    return both.withColumn("position", (F.row_number().over(order) - 1).cast("long"))
