"""Term mining and glossary replacement."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as T

MIN_TOKEN, MIN_REPEATED, EXAMPLES = 2, 4, 2
#: Fixed ranges: only these letters make a word for the glossary.
LETTERS = "A-Za-zЀ-ԯⷠ-ⷿꙀ-ꚟ"
#: Different glossary surfaces that go to every task at most.
MOST_TERMS = 100_000

_LETTER = re.compile(f"[{LETTERS}]")


def token_counts(replies: DataFrame, keys: list[str], examples: bool = True) -> DataFrame:
    """Each token of two characters or more by its lower-case form.

    ``replies`` has keys, start_ms, idx and text. Returns occurrences, the commonest spelling (ties
    to the smallest) and, where ``examples`` are asked for, the first two of distinct start in the
    order of the replies. Counting needs no text: only examples carry it, two for a token.
    """
    rows = replies.select(*keys, F.explode(T.tokens(F.col("text"))).alias("token")).where(F.length("token") >= MIN_TOKEN)
    spellings = rows.groupBy(*keys, "token").agg(F.count("*").alias("n")).withColumn("key", F.lower("token"))
    counts = spellings.groupBy(*keys, "key").agg(F.sum("n").alias("occurrences"), F.min_by("token", F.struct((-F.col("n")).alias("n"), "token")).alias("surface"))
    return _with_examples(counts, replies, keys) if examples else counts


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by equal keys where null equals null; without the right side's keys."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in keys})
    return left.join(named, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys)), how).drop(*(f"_r_{c}" for c in keys))


def _with_examples(counts: DataFrame, replies: DataFrame, keys: list[str]) -> DataFrame:
    """``counts`` (keys, key) with the first two ``examples``, chosen by place; their texts are joined at the end."""
    lowered = F.array_distinct(F.transform(F.filter(T.tokens(F.col("text")), lambda t: F.length(t) >= MIN_TOKEN), F.lower))
    places = replies.select(*keys, "start_ms", "idx", F.explode(lowered).alias("key"))
    firsts = places.groupBy(*keys, "key", "start_ms").agg(F.min("idx").alias("idx"))
    order = Window.partitionBy(*keys, "key").orderBy("idx", "start_ms")
    kept = firsts.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= EXAMPLES)
    texts = replies.select(*keys, "start_ms", "idx", "text", lowered.alias("_keys"))
    named = _joined(kept, texts, [*keys, "start_ms", "idx"]).where(F.array_contains("_keys", F.col("key"))).groupBy(*keys, "key", "_n", "start_ms").agg(F.min("text").alias("text"))
    found = named.groupBy(*keys, "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "start_ms", "text"))), lambda x: F.struct(x["start_ms"], x["text"])).alias("examples"))
    return _joined(counts, found, [*keys, "key"], "left")


def frequent_head(counts: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The ``size`` commonest tokens by count, then key, before any exclusion."""
    return counts.withColumn("_n", _rank(keys)).where(F.col("_n") <= size).select(*keys, "key")


def _rank(keys: list[str]) -> Column:
    """Place of a token among its keys' ones, by count, then key."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("occurrences"), "key"))


def mined(replies: DataFrame, known: DataFrame, keys: list[str], min_occurrences: int = 3, head: int = 50, examples: bool = True) -> DataFrame:
    """Term candidates with their rule, without known ones (``known`` has a column key, lower case).

    A candidate is Latin, an acronym, or repeated: often enough, of four characters or more and not
    among the commonest tokens. ``position`` numbers them by occurrences, then surface. Candidates
    of null keys have no commonest tokens. ``examples`` are those of ``token_counts``.
    """
    counts = token_counts(replies, keys, examples=False).withColumn("_rank", _rank(keys))
    rows = counts.join(known.select("key").distinct(), "key", "left_anti")
    in_head = (F.col("_rank") <= head) & reduce(and_, (F.col(c).isNotNull() for c in keys))
    repeated = (F.col("occurrences") >= min_occurrences) & ~in_head & (F.length("key") >= MIN_REPEATED)
    rule = F.when(T.is_latin(F.col("surface")), "latin").when(T.is_acronym(F.col("surface")), "acronym").when(repeated, "repeated")
    order = Window.partitionBy(*keys).orderBy(F.desc("occurrences"), "surface")
    found = rows.withColumn("rule", rule).where("rule is not null").drop("_rank").withColumn("position", (F.row_number().over(order) - 1).cast("long"))
    return (_with_examples(found, replies, keys) if examples else found).drop("key")


def active_terms(terms: DataFrame, meeting_id: int | str) -> DataFrame:
    """terms that are global or the meeting's own."""
    return terms.where((F.col("scope") == "global") | (F.col("meeting_id") == F.lit(meeting_id)))


def matching_terms(terms: DataFrame, query: str = "", language: str | None = None, meeting_id: int | str | None = None) -> DataFrame:
    """F8: terms by language, meeting and a substring of either form; a blank query matches all."""
    rows = terms
    if language is not None:
        rows = rows.where(F.col("language") == language)
    if meeting_id is not None:
        rows = rows.where(F.col("meeting_id") == F.lit(meeting_id))
    wanted = query.strip().lower()
    if wanted:
        rows = rows.where(F.contains(F.lower("surface"), F.lit(wanted)) | F.contains(F.lower("canonical"), F.lit(wanted)))
    return rows


def prompt_words(terms: DataFrame, language: str, most: int) -> DataFrame:
    """Distinct canonical forms, own language first, then by surface; joined by commas, cut to ``most`` characters."""
    rank = F.when(F.col("language") == language, 0).otherwise(1)
    first = terms.groupBy("canonical").agg(F.min(F.struct(rank.alias("rank"), "surface")).alias("at"))
    return first.agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "canonical"))), lambda x: x["canonical"]), ", "), 1, most).alias("prompt"))


def _named(terms: DataFrame, kind: int) -> DataFrame:
    """One row for each lower-case surface and its length ``n``: ties go to the smallest surface, then canonical form."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            surfaces = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.lower() for s in surfaces], pa.string()), pa.array([len(s) for s in surfaces], pa.int64())], ["surface", "canonical", "key", "n"])

    rows = terms.where((F.col("kind") == kind) & (F.col("surface") != "")).select("surface", "canonical").distinct()
    rows = rows.mapInArrow(keyed, "surface string, canonical string, key string, n long")
    return rows.groupBy("n", "key").agg(F.min(F.struct("surface", "canonical"))["canonical"].alias("canonical"))


def _places(text: str, head: re.Pattern, lengths: dict[str, list[int]]) -> Iterator[tuple[int, int, str]]:
    """Start, length and lower-case form of what a surface could match, from left to right, the longest first."""
    for m in head.finditer(text):
        i = m.start()
        for n in lengths.get(m.group().lower()[:1], ()):
            if i + n <= len(text) and not (i + n < len(text) and _LETTER.match(text, i + n)):
                yield i, n, text[i : i + n].lower()


def _rewritten(text: str, hits: Iterator[tuple[int, int, str]]) -> str:
    """The text with canonical forms at the hits (start, length, canonical; in order) that begin after the one before."""
    out, end = [], 0
    for i, n, name in hits:
        if i >= end:
            out += [text[end:i], name]
            end = i + n
    return "".join([*out, text[end:]]) if out else text


def replaced(texts: DataFrame, terms: DataFrame, kind: int = 1, most: int = MOST_TERMS) -> DataFrame:
    """Texts with glossary surfaces replaced, in one pass from left to right.

    The longest surface that matches at a place wins; matches ignore case and stand between
    characters that are no letters of ``LETTERS``; what was put in is not read again. All of
    ``terms`` counts: up to ``most`` different surfaces go to the tasks as a table; more are joined
    with the places of the texts where one of them could stand.
    """
    named = _named(terms, kind)
    rows = named.limit(most + 1).collect()
    small = len(rows) <= most
    pairs = {(r["key"][:1], r["n"]) for r in rows} if small else {(r["head"], r["n"]) for r in named.select(F.substring("key", 1, 1).alias("head"), "n").distinct().collect()}
    lengths: dict[str, list[int]] = {}
    for first, n in sorted(pairs, key=lambda p: -p[1]):
        lengths.setdefault(first, []).append(n)
    if not lengths:
        return texts
    head, columns = re.compile(f"(?<![{LETTERS}])[{re.escape(''.join(lengths))}]", re.IGNORECASE), texts.columns
    if small:
        canonical = texts.sparkSession.sparkContext.broadcast({(r["n"], r["key"]): r["canonical"] for r in rows})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = canonical.value
            for batch in batches:
                batch["text"] = [None if t is None else _rewritten(t, ((i, n, names[n, k] or "") for i, n, k in _places(t, head, lengths) if (n, k) in names)) for t in batch["text"]]
                yield batch

        return texts.mapInPandas(run, texts.schema)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(_places(text, head, lengths))
                start, n, key = ([f[k] for f in found] for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array([mark] * len(n), pa.string()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(key, pa.string())], ["_text", "start", "n", "key"])

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [t if hits is None else _rewritten(t, sorted(((h["start"], h["n"], h["canonical"] or "") for h in hits), key=lambda h: (h[0], -h[1]))) for t, hits in zip(batch["text"], batch["_hits"], strict=True)]
            yield batch[columns]

    marked = texts.withColumn("_text", F.sha2("text", 256))
    each = marked.where("text is not null").select("_text", "text").dropDuplicates(["_text"])
    hits = each.mapInArrow(places, "_text string, start long, n long, key string").join(named, ["n", "key"])
    hits = hits.groupBy("_text").agg(F.collect_list(F.struct("start", "n", "canonical")).alias("_hits"))
    return marked.join(hits, "_text", "left").select(*texts.columns, "_hits").mapInPandas(put, texts.schema)
