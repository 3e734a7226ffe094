"""Language identification by prediction by partial matching."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import kernels as K
from parley.llm import storage

ORDER = 3
#: Expected bound on the texts of a language that the statistics are learned from.
TEXTS_PER_LANGUAGE = 1500
UNDETERMINED = "und"


def grams(texts: K.Texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the ``order`` bytes before it, as one number, and its text.

    Bytes before a text's first are 0.
    """
    data = texts.data.astype(np.uint64)
    place = np.arange(len(data)) - np.repeat(texts.starts[:-1], np.diff(texts.starts))
    value = data.copy()
    for k in range(1, order + 1):
        before = np.zeros_like(data)
        before[k:] = data[:-k] if k < len(data) + 1 else 0
        before[place < k] = 0
        value |= before << np.uint64(8 * k)
    return value, np.repeat(np.arange(texts.n), np.diff(texts.starts))


@dataclass
class Model:
    """Frozen context trees of all languages, with the exact code length of every byte they can meet.

    For each order: contexts seen in any language with each language's escape bits, and context
    and byte seen in any language with each language's bits, escapes to shorter contexts included.
    """

    languages: list[str]
    order: int
    base: np.ndarray
    tables: list[tuple[K.IntTable, np.ndarray, K.IntTable, np.ndarray]]

    def bits(self, value: np.ndarray) -> np.ndarray:
        """Bits of each byte in its context under each language."""
        out = np.zeros((len(value), len(self.languages)), np.float32)
        left = np.arange(len(value))
        for d in range(self.order, 0, -1):
            seen, bits, contexts, escapes = self.tables[d - 1]
            key = value[left] & np.uint64((1 << (8 * (d + 1))) - 1)
            row = seen.find(key)
            hit = row >= 0
            out[left[hit]] += bits[row[hit]]
            left, key = left[~hit], key[~hit]
            row = contexts.find(key >> np.uint64(8))
            known = row >= 0
            out[left[known]] += escapes[row[known]]
        out[left] += self.base[(value[left] & np.uint64(255)).astype(np.int64)]
        return out

    def score(self, array: pa.Array) -> np.ndarray:
        """Code length of each text under each language, in bits."""
        texts = K.Texts(array)
        value, owner = grams(texts, self.order)
        bits = self.bits(value)
        return np.stack([np.bincount(owner, weights=bits[:, k], minlength=texts.n) for k in range(len(self.languages))], axis=1)


def compile_model(languages: list[str], which: np.ndarray, key: np.ndarray, count: np.ndarray, order: int) -> Model:
    """Code lengths from counts of full-order contexts with their byte, for each language.

    A byte seen c times in a context with n occurrences of q distinct bytes has probability
    c / (n + q); escape has q / (n + q), then the context without its oldest byte decides; below
    the empty context all 256 bytes are alike. A context that a language never saw costs nothing
    to leave. Nothing is excluded after an escape.
    """
    n_lang = len(languages)
    key = key.astype(np.uint64)
    base = np.full((256, n_lang), np.float32(8))
    tables: list[tuple[K.IntTable, np.ndarray, K.IntTable, np.ndarray]] = []
    lower: np.ndarray | None = None
    lower_table: K.IntTable | None = None
    for d in range(order + 1):
        mask = np.uint64((1 << (8 * (d + 1))) - 1)
        union, place = np.unique(key & mask, return_inverse=True)
        seen = np.zeros((len(union), n_lang))
        np.add.at(seen, (place, which), count)
        contexts, of = np.unique(union >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(contexts), n_lang)), np.zeros((len(contexts), n_lang))
        np.add.at(total, of, seen)
        np.add.at(kinds, of, seen > 0)
        known = total > 0
        escape = np.where(known, kinds / np.maximum(total + kinds, 1), 1.0)
        if lower is None:
            below = np.full((len(union), n_lang), 1 / 256)
        else:
            below = lower[lower_table.find(union & np.uint64((1 << (8 * d)) - 1))]
        chance = np.where(seen > 0, seen / np.maximum(total + kinds, 1)[of], escape[of] * below)
        if d == 0:
            whole = escape[0] / 256 if len(contexts) else np.full(n_lang, 1 / 256)
            flat = np.tile(whole, (256, 1))
            flat[union.astype(np.int64)] = chance
            base = (-np.log2(flat)).astype(np.float32)
        else:
            tables.append((K.IntTable(union), (-np.log2(chance)).astype(np.float32), K.IntTable(contexts), (-np.log2(escape)).astype(np.float32)))
        lower, lower_table = chance, K.IntTable(union)
    return Model(languages, order, base, tables)


def fit(labelled: DataFrame, order: int = ORDER, texts_per_language: int = TEXTS_PER_LANGUAGE) -> Model | None:
    """Model from rows with text and lang; of each language about ``texts_per_language`` whole texts.

    Which texts, a hash of their id decides. Only counts of contexts in that sample reach the
    driver. None if there is nothing to learn from.
    """
    rows = labelled.where("text is not null and lang is not null").select(F.col("doc_id"), "text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(texts_per_language)) / F.col("n"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    part = rows.join(storage.broadcast_if_small(counts.select("lang", share.alias("share"))), "lang").where(draw < F.col("share"))

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch):
                value, owner = grams(K.Texts(block.column(0)), order)
                names = np.array(block.column(1).to_pylist(), object)
                for name in sorted(set(names.tolist())):
                    found, many = np.unique(value[(names == name)[owner]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(many)], ["lang", "gram", "n"])

    made = K.map_batches(part.select("text", "lang"), count_grams, "lang string, gram long, n long")
    got = made.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not got.num_rows:
        return None
    lang = got.column("lang").combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist()
    rank = np.argsort(np.argsort(names))
    which = rank[lang.indices.to_numpy()]
    return compile_model(sorted(names), which, got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy(), order)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of docs with lang_pred and score of every whole text.

    lang_pred is the language under which the text's code is shortest, ties to the first by name;
    score is its share of the probability of all languages. A text that is null or has no letter,
    and any text without a model, is ``und`` with score 0. Columns that docs has already under the
    names lang_pred or score are replaced. Repeated ids give a row each; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for block in K.blocks(batch):
                texts = block.column("text")
                lettered = np.array([any(map(str.isalpha, text)) for text in K.fill(texts).to_pylist()], bool)
                guess, score = np.full(block.num_rows, UNDETERMINED, object), np.zeros(block.num_rows)
                if known is not None:
                    bits = known.score(texts)
                    best = bits.argmin(1)
                    guess[lettered] = np.array(known.languages, object)[best[lettered]]
                    gap = np.minimum(bits - bits.min(1, keepdims=True), 1000)
                    score[lettered] = (1 / np.exp2(-gap).sum(1))[lettered]
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(guess, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return K.map_batches(docs, run, f"{schema}, lang_pred string, score double")
