"""File sources and sinks: glossary CSV, JSON-lines diagnostics, Markdown and directory sizes."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GLOSSARY = "surface string, canonical string, language string, scope string, meeting_id string, _corrupt string"
DIAGNOSTIC = "ts_ms long, kind string, buffer_ms long, text string"
TAIL_LINES = 2000


def glossary_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good terms, and one row with the number of bad ones.

    The header begins with surface, canonical, language, scope; quotes inside quoted fields are
    doubled. A row is bad if it has no surface or canonical form, an unknown scope, or the scope
    meeting without a meeting.
    """
    head = spark.read.text(path).first()
    if head is None or not head[0].lower().replace(" ", "").startswith("surface,canonical,language,scope"):
        raise ValueError("the header must begin with surface,canonical,language,scope")
    rows = spark.read.schema(GLOSSARY).option("header", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("enforceSchema", True).csv(path).cache()
    trimmed = rows.select(*(F.trim(c).alias(c) for c in ("surface", "canonical", "language", "scope", "meeting_id")))
    named = (F.coalesce(F.col("surface"), F.lit("")) != "") & (F.coalesce(F.col("canonical"), F.lit("")) != "")
    good = named & ((F.col("scope") == "global") | ((F.col("scope") == "meeting") & (F.coalesce(F.col("meeting_id"), F.lit("")) != "")))
    good = F.coalesce(good, F.lit(False))
    return trimmed.where(good), trimmed.agg(F.count_if(~good).alias("skipped"))


def diagnostics(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """JSON lines without malformed ones, of the wanted kinds."""
    rows = spark.read.schema(DIAGNOSTIC).option("mode", "DROPMALFORMED").json(path)
    return rows if kinds is None else rows.where(F.col("kind").isin(kinds))


def append_diagnostics(rows: DataFrame, path: str) -> None:
    """Appends JSON lines."""
    rows.select("ts_ms", "kind", "buffer_ms", "text").write.mode("append").json(path)


def rotated(rows: DataFrame, lines: int = TAIL_LINES) -> DataFrame:
    """The latest ``lines`` rows; the limit is the feature."""
    return rows.orderBy(F.desc("ts_ms")).limit(lines).orderBy("ts_ms")


def after_last_marker(rows: DataFrame, marker: str = "session_open", keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows from the last marker on, for each key."""
    last = rows.where(F.col("kind") == marker).groupBy(*keys).agg(F.max("ts_ms").alias("_from"))
    both = rows.join(last, list(keys)) if keys else rows.crossJoin(F.broadcast(last))
    return both.where(F.col("ts_ms") >= F.col("_from")).drop("_from")


def write_markdown(texts: DataFrame, path: str) -> None:
    """One text file under a partition of its name; ``texts`` has name and body."""
    texts.select("name", F.col("body").alias("value")).write.partitionBy("name").mode("overwrite").text(path)


def folder_bytes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder whose names fit, and their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def tree_bytes(files: DataFrame) -> DataFrame:
    """Files and bytes below every folder of a listing (path, bytes), the root as the empty folder.

    Files are summed by their own folder first, so that few rows are listed under the folders above it.
    A null path is no file, null bytes are none.
    """
    own = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    direct = files.where("path is not null").groupBy(own.alias("own")).agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("size"))
    parts = F.filter(F.split("own", "/"), lambda x: x != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return direct.select(F.explode(above).alias("folder"), "n", "size").groupBy("folder").agg(F.sum("n").alias("files"), F.sum("size").cast("long").alias("bytes"))


def write_glossary(terms: DataFrame, path: str) -> None:
    """Terms as CSV with the header that ``glossary_csv`` asks for; quotes inside fields are doubled."""
    names = ("surface", "canonical", "language", "scope", "meeting_id")
    terms.select(*names).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def power_log(spark: SparkSession, path: str, field: int) -> DataFrame:
    """mean of a numeric field of a text table's rows; rows that don't begin with a number are no data."""
    rows = spark.read.text(path).where(F.col("value").rlike("^\\s*[0-9]"))
    parts = F.filter(F.split("value", "\\s+"), lambda x: x != "")
    return rows.agg(F.avg(F.get(parts, F.lit(field)).try_cast("double")).alias("mean"), F.count("*").alias("rows"))


def wav(spark: SparkSession, path: str, pattern: str = "*.wav") -> DataFrame:
    """Path, sample rate, channels and interleaved 16-bit samples of WAV files; a file of another format has null samples."""

    def one(content: bytes) -> tuple[int | None, int | None, list[int] | None]:
        try:
            with wave.open(io.BytesIO(content)) as sound:
                if sound.getsampwidth() != 2:
                    return sound.getframerate(), sound.getnchannels(), None
                return sound.getframerate(), sound.getnchannels(), np.frombuffer(sound.readframes(sound.getnframes()), "<i2").tolist()
        except (wave.Error, EOFError):
            return None, None, None

    def run(batches):
        for batch in batches:
            made = [one(bytes(c)) for c in batch["content"]]
            kinds = {"rate": "Int32", "channels": "Int32"}
            yield pd.DataFrame({"path": batch["path"], **{k: pd.Series([m[i] for m in made], dtype=kinds.get(k, object)) for i, k in enumerate(("rate", "channels", "pcm"))}})

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, rate int, channels int, pcm array<int>")
