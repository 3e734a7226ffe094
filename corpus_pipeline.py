"""A training-text pipeline: language ID, line dedup, near-dedup, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result to the
shared folder and reads it again as the next stage's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import langid, linededup, neardup, packing, secretscan, storage

#: Five-word shingles at a similarity of 80 per cent.
WIDTH, PERCENT = 5, 80
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of docs, with n_chars of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: a null or empty text, or one without a letter.

    The others get the predicted language as ``lang``, whatever their length. Statistics are learned
    from the rows that have a text and a language; if there are none, the others keep their ``lang``.
    Ties go to the first language in order. Repeated rows and ids are judged row by row, and nulls
    in other columns play no part. An empty table gives no rows. Columns of docs under other names,
    lang_pred and score among them, come back as they are.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(F.col("text").isNotNull() & F.col("text").rlike("\\p{L}"))
    # The other columns travel under names of their own, so that none is taken for a result.
    others = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in ("text", "lang")}
    found = langid.identify(docs.select("text", *(F.col(f"`{c}`").alias(name) for c, name in others.items())), model)
    back = {**{c: F.col(name).alias(c) for c, name in others.items()}, "text": F.col("text"), "lang": F.col("lang_pred").alias("lang")}
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select(*(back[c] for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring lines and passages out of the texts, and documents that consisted of them alone.

    A line stays in the document of the smallest id that has it. Null and empty texts, texts that
    lose nothing and texts that were blank before stay as they are. Repeated rows count as one
    document, lose the same lines and stay as often as they were. Rows without an id lose every
    recurring line. An empty table gives no rows. ``n_chars`` follows the text, null for a null one;
    other columns come back as they are.
    """
    # The operator's counts must not take the place of columns of docs.
    taken = {c: c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)}
    left = linededup.drop_recurring_lines(docs.select(*(F.col(f"`{c}`").alias(name) for c, name in taken.items())))
    left = left.where((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", "[\\t-\\r]", " ")) != ""))
    return _counted(left.select(*(F.col(name).alias(c) for c, name in taken.items())), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each near-duplicate group.

    Documents without a word (null, empty or blank texts) are linked with nothing and stay, and so do
    rows without an id. Texts of any length are compared whole. Of rows that repeat an id that stays,
    each different text stays once, with the least of its other columns by their JSON; none is lost by chance. An
    empty table gives no rows. Columns come back as they are.
    """
    kept = neardup.near_duplicates(docs.select("doc_id", "text"), WIDTH, PERCENT).where("kept").groupBy("doc_id").agg(F.count("*").alias("_rows"))
    kept = storage.written(kept)
    left = docs.join(storage.broadcast_if_small(kept.select("doc_id")), "doc_id", "left_semi")
    again = kept.where("_rows > 1").select("doc_id")
    if not again.isEmpty():
        # The other columns travel as one value under names of their own; as JSON they have an order, maps too.
        others = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
        held = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(name) for c, name in others.items()))
        several = left.join(storage.broadcast_if_small(again), "doc_id", "left_semi").select("doc_id", "text", held.alias("x"))
        several = several.groupBy("doc_id", "text").agg(F.min_by("x", F.to_json("x", {"ignoreNullFields": "false"})).alias("x"))
        several = several.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"x.{others[c]}").alias(c) for c in docs.columns))
        left = left.join(storage.broadcast_if_small(again), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)).union(several)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return left.select(*names).union(docs.where("doc_id is null").select(*names))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret of every whole text; all documents stay.

    Null and empty texts, and texts without a secret, stay as they are. Secrets that overlap are
    replaced as one. Repeated rows are treated alike; a null ``source`` is an empty path. An empty
    table gives no rows. ``n_chars`` follows the text; other columns come back as they are.
    """
    return _counted(secretscan.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens; a row for each piece.

    A null or empty text is one end id. Only texts longer than a sequence are cut. Repeated rows and
    ids are packed row by row; a row without an id keeps its null. An empty table gives no rows.
    Columns of docs other than doc_id and text are not read.
    """
    return packing.pack_documents(docs.select("doc_id", "text"), WORD_BPE)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("pack", pack),
]

#: The models and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns what the last one returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
