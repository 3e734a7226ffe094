"""Changes of stored tables as pure transforms: old rows in, new rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], keep_old: bool = False) -> DataFrame:
    """Rows of both by key; the new one wins, or the old one for DO NOTHING."""
    if keep_old:
        return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def replace_partition(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows of the new rows' keys go, then the new rows come."""
    return upserted(old, new, keys)


def delete_matching(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not among those deleted."""
    return old.join(gone.select(*keys).distinct(), keys, "left_anti").select(*old.columns)


def write_terms(old: DataFrame, new: DataFrame) -> DataFrame:
    """Glossary terms with new ones in place of those of the same id or of the same surface, language, scope and meeting."""
    place = ["surface", "language", "scope"]
    same = old.withColumn("_m", F.coalesce(F.col("meeting_id").cast("string"), F.lit("")))
    fresh = new.withColumn("_m", F.coalesce(F.col("meeting_id").cast("string"), F.lit("")))
    left = same.join(fresh.select("id").distinct(), "id", "left_anti").join(fresh.select(*place, "_m").distinct(), [*place, "_m"], "left_anti")
    return left.select(*old.columns).unionByName(new.select(*old.columns))


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str = "meeting_id") -> dict[str, DataFrame]:
    """Every table without the rows of the deleted meetings."""
    return {name: delete_matching(df, gone, [key]) for name, df in tables.items()}


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """New values where the condition holds; null counts as not holding."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in values.items()})


def update_one(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """As ``update_where``; an error if no row matches."""
    if df.where(condition).isEmpty():
        raise LookupError("no row matches")
    return update_where(df, condition, values)


def setting(settings: DataFrame, key: str, default: str) -> DataFrame:
    """One row with the value of a key, or the default."""
    return settings.where(F.col("key") == key).agg(F.coalesce(F.max("value"), F.lit(default)).alias("value"))


def sweep_preview(meetings: DataFrame, sizes: DataFrame, before_ms: int) -> DataFrame:
    """Meetings that began before a time and still have audio with bytes, and those bytes."""
    old = meetings.where((F.col("started_at_ms") < before_ms) & F.col("audio_deleted_at_ms").isNull())
    return old.join(sizes.where("bytes > 0"), "meeting_id").agg(F.count("*").alias("meetings"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def summaries(meetings: DataFrame, finals: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Of each meeting whether it has a final, and how many artifacts."""
    has = finals.select("meeting_id").distinct().withColumn("_f", F.lit(True))
    many = artifacts.groupBy("meeting_id").agg(F.count("*").alias("_n"))
    both = meetings.join(has, "meeting_id", "left").join(many, "meeting_id", "left")
    return both.withColumns({"has_final": F.coalesce("_f", F.lit(False)), "artifact_count": F.coalesce("_n", F.lit(0))}).drop("_f", "_n")


def next_version(versions: DataFrame) -> DataFrame:
    """A4: one more than the latest version of each meeting."""
    return versions.groupBy("meeting_id").agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("next_version"))


def latest(versions: DataFrame) -> DataFrame:
    """The row of the latest version of each meeting."""
    best = versions.groupBy("meeting_id").agg(F.max_by(F.struct(*[c for c in versions.columns if c != "meeting_id"]), "version").alias("v"))
    return best.select("meeting_id", "v.*")


def stale(artifacts: DataFrame, versions: DataFrame) -> DataFrame:
    """artifacts with whether a later version than theirs exists."""
    now = versions.groupBy("meeting_id").agg(F.max("version").alias("_latest"))
    return artifacts.join(now, "meeting_id", "left").withColumn("stale", F.coalesce(F.col("source_version") != F.col("_latest"), F.lit(False))).drop("_latest")


def latest_spans(segments: DataFrame, channel: str) -> DataFrame:
    """Spans of one channel in the latest version of each meeting."""
    now = segments.groupBy("meeting_id").agg(F.max("version").alias("version"))
    return segments.where(F.col("channel") == channel).join(now, ["meeting_id", "version"], "left_semi").select("meeting_id", "idx", "start_ms", "end_ms")


def preferred(files: DataFrame, priority: list[str]) -> DataFrame:
    """The file (name) that comes first in a list of names, else the first by name."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col("name"))
    return files.agg(F.min_by("name", F.struct(F.when(place == 0, len(priority) + 1).otherwise(place).alias("place"), "name")).alias("name"))
