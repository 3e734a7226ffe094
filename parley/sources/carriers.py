"""Projections of the test tables onto the shapes that the operators take.

Each projection has a DuckDB twin, so that a query and its SQL start from the same rows.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.sources.tables import table

SEGMENTS_SQL = """
  SELECT conv_id AS meeting_id, turn AS idx, turn * 2000 AS start_ms, turn * 2000 + 500 + 10 * length(text) AS end_ms,
         CASE WHEN role = 'assistant' THEN 'system' ELSE 'mic' END AS channel,
         CASE WHEN role = 'system' THEN '' ELSE role END AS speaker_id, text
  FROM conversations"""
CAPTIONS_SQL = """
  SELECT turn AS id, conv_id AS session_id, text, CASE WHEN turn % 2 = 1 THEN 'final' ELSE 'partial' END AS phase,
         turn * 1000 AS created_at_ms FROM conversations"""
VERSIONS_SQL = """
  SELECT o_custkey AS meeting_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version,
         o_orderpriority AS body, o_orderkey AS created_at_ms FROM orders"""
ARTIFACTS_SQL = """
  SELECT o_orderkey AS id, o_custkey AS meeting_id, o_orderstatus AS kind,
         CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END AS source_version FROM orders"""
EDITS_SQL = """
  SELECT conv_id * 1000 + turn * 10 + k AS id, conv_id AS meeting_id, CASE WHEN role = 'assistant' THEN 'system' ELSE 'mic' END AS channel,
         turn * 2000 AS start_ms, turn * 2000 + 500 + 10 * length(text) AS end_ms, text AS original_text,
         concat('edit ', k, ' ', conv_id) AS edited_text, 100 - k % 2 AS created_at_ms, CASE WHEN k = 1 THEN 'human' ELSE 'bulk' END AS origin
  FROM conversations, (VALUES (0), (1), (2)) AS n(k)"""
TERMS_SQL = """
  SELECT p_partkey AS id, p_name AS surface, upper(p_name) AS canonical, CASE WHEN p_size % 2 = 0 THEN 'en' ELSE 'de' END AS language,
         CASE WHEN p_size % 3 = 0 THEN 'global' ELSE 'meeting' END AS scope, CASE WHEN p_size % 3 <> 0 THEN p_size % 7 END AS meeting_id, p_size % 2 AS kind
  FROM part"""
CHUNKS_SQL = """
  SELECT l_orderkey AS session_id, CASE WHEN l_returnflag = 'R' THEN 'mic' ELSE 'system' END AS channel, l_linenumber AS seq,
         l_linenumber * 500 AS ts_ms, CASE WHEN l_quantity < 25 THEN 400 ELSE 500 END AS duration_ms, 16000 AS rate FROM lineitem"""
LEVELS_SQL = """
  SELECT user_id AS session_id, epoch_us(ts) // 1000 AS ts_ms, event_id, event_type AS kind, value * 20 AS level FROM events"""
PRINTS_SQL = """
  SELECT vec_id AS id, concat('s', label) AS speaker_id, embedding AS vector, CASE WHEN vec_id % 5 = 0 THEN 'human' WHEN vec_id % 5 = 1 THEN 'voiceprint' ELSE 'channel' END AS source,
         1000 + vec_id % 7 * 100 AS ms FROM embeddings"""
VOICED_SQL = """
  SELECT vec_id AS id, vec_id // 40 AS meeting_id, vec_id % 40 AS idx, vec_id % 40 * 2000 AS start_ms, vec_id % 40 * 2000 + 1500 AS end_ms, CASE WHEN vec_id % 2 = 0 THEN 'mic' ELSE 'system' END AS channel,
         CASE vec_id % 5 WHEN 0 THEN concat('s', label) WHEN 1 THEN concat('s', label) WHEN 2 THEN 'channel' ELSE '' END AS speaker_id,
         CASE vec_id % 5 WHEN 0 THEN 'human' WHEN 1 THEN 'voiceprint' WHEN 2 THEN 'channel' ELSE 'none' END AS source,
         CASE WHEN vec_id % 11 <> 3 THEN embedding END AS vector, 1000 + vec_id % 7 * 100 AS ms, concat('line ', vec_id, CASE WHEN vec_id % 3 = 0 THEN '.' ELSE '' END) AS text FROM embeddings"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as transcript segments: a turn starts every two seconds and lasts with its text."""
    start = F.col("turn") * 2000
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("meeting_id"),
        F.col("turn").alias("idx"),
        start.alias("start_ms"),
        (start + 500 + 10 * F.length("text")).cast("long").alias("end_ms"),
        F.when(F.col("role") == "assistant", "system").otherwise("mic").alias("channel"),
        F.when(F.col("role") == "system", "").otherwise(F.col("role")).alias("speaker_id"),
        "text",
    )


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as captions: every other turn is final."""
    return table(spark, sf_dir, "conversations").select(F.col("turn").alias("id"), F.col("conv_id").alias("session_id"), "text", F.when(F.col("turn") % 2 == 1, "final").otherwise("partial").alias("phase"), (F.col("turn") * 1000).alias("created_at_ms"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as transcript versions of a customer's meeting."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("meeting_id"), F.row_number().over(order).cast("long").alias("version"), F.col("o_orderpriority").alias("body"), F.col("o_orderkey").alias("created_at_ms"))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as an artifact, some with a source version."""
    part = F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("meeting_id"), F.col("o_orderstatus").alias("kind"), F.when(part > 0, part).alias("source_version"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits on every segment."""
    rows = segments(spark, sf_dir).withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    return rows.select(
        (F.col("meeting_id") * 1000 + F.col("idx") * 10 + F.col("k")).alias("id"),
        "meeting_id",
        "channel",
        "start_ms",
        "end_ms",
        F.col("text").alias("original_text"),
        F.concat(F.lit("edit "), F.col("k"), F.lit(" "), F.col("meeting_id")).alias("edited_text"),
        (100 - F.col("k") % 2).alias("created_at_ms"),
        F.when(F.col("k") == 1, "human").otherwise("bulk").alias("origin"),
    )


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as glossary terms."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("surface"), F.upper("p_name").alias("canonical"), F.when(size % 2 == 0, "en").otherwise("de").alias("language"), F.when(size % 3 == 0, "global").otherwise("meeting").alias("scope"), F.when(size % 3 != 0, size % 7).alias("meeting_id"), (size % 2).alias("kind"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a manifest of audio chunks."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.when(F.col("l_returnflag") == "R", "mic").otherwise("system").alias("channel"), F.col("l_linenumber").alias("seq"), (F.col("l_linenumber") * 500).alias("ts_ms"), F.when(F.col("l_quantity") < 25, 400).otherwise(500).alias("duration_ms"), F.lit(16000).alias("rate"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as audio levels of a user's session."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "event_id", F.col("event_type").alias("kind"), (F.col("value") * 20).alias("level"))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as voice vectors; every fifth has a human label."""
    part = F.col("vec_id") % 5
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("s"), F.col("label")).alias("speaker_id"), F.col("embedding").alias("vector"), F.when(part == 0, "human").when(part == 1, "voiceprint").otherwise("channel").alias("source"), (1000 + F.col("vec_id") % 7 * 100).alias("ms"))


def voiced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as the segments of meetings of forty, with voice vectors and labels of four sources."""
    part, id_, place = F.col("vec_id") % 5, F.col("vec_id"), F.col("vec_id") % 40
    return table(spark, sf_dir, "embeddings").select(
        id_.alias("id"),
        F.floor(id_ / 40).alias("meeting_id"),
        place.alias("idx"),
        (place * 2000).alias("start_ms"),
        (place * 2000 + 1500).alias("end_ms"),
        F.when(id_ % 2 == 0, "mic").otherwise("system").alias("channel"),
        F.when(part < 2, F.concat(F.lit("s"), F.col("label"))).when(part == 2, "channel").otherwise("").alias("speaker_id"),
        F.when(part == 0, "human").when(part == 1, "voiceprint").when(part == 2, "channel").otherwise("none").alias("source"),
        F.when(id_ % 11 != 3, F.col("embedding")).alias("vector"),
        (1000 + id_ % 7 * 100).alias("ms"),
        F.concat(F.lit("line "), id_, F.when(id_ % 3 == 0, ".").otherwise("")).alias("text"),
    )
