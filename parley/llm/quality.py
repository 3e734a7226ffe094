"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import kernels as K

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS = 2000
#: Counts that every text gets.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Bytes that are symbols: # * $ % & | < >
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


class Measures:
    """Counts over a block of texts, each made when a rule first asks for it."""

    def __init__(self, array: pa.Array, rows: np.ndarray | None = None, made: dict[str, np.ndarray] | None = None) -> None:
        self.whole, self.rows = K.fill(array), rows
        self._made: dict[str, np.ndarray] = made or {}

    @functools.cached_property
    def texts(self) -> K.Texts:
        return K.Texts(self.whole if self.rows is None else self.whole.take(pa.array(self.rows)))

    def take(self, keep: np.ndarray) -> Measures:
        """The same for some of the texts, with the counts that are made already; texts are copied only for others."""
        rows = keep if self.rows is None else self.rows[keep]
        return Measures(self.whole, rows, {name: count[keep] for name, count in self._made.items() if name != "spans"})

    def get(self, name: str) -> np.ndarray:
        if name not in self._made:
            self._made[name] = getattr(self, f"_{name}")()
        return self._made[name]

    def word_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if "spans" not in self._made:
            self._made["spans"] = self.texts.words()
        return self._made["spans"]

    def _n_words(self) -> np.ndarray:
        return np.bincount(self.word_spans()[2], minlength=self.texts.n)

    def _word_chars(self) -> np.ndarray:
        data = self.texts.data
        return self.texts.per_text(~K.SPACE[data] & ((data & 0xC0) != 0x80))

    def _n_symbols(self) -> np.ndarray:
        return self.texts.per_text(SYMBOLS[self.texts.data])

    def _n_upper(self) -> np.ndarray:
        return self.texts.per_text((self.texts.data >= 65) & (self.texts.data <= 90))

    def _n_letters(self) -> np.ndarray:
        low = self.texts.data | 32
        return self.texts.per_text(((low >= 97) & (low <= 122)) | (self.texts.data >= 0xC0))

    def _n_digits(self) -> np.ndarray:
        return self.texts.per_text((self.texts.data >= 48) & (self.texts.data <= 57))

    def _n_lines(self) -> np.ndarray:
        return self.texts.per_text(self.texts.data == 10) + 1

    def _n_dup_lines(self) -> np.ndarray:
        start, end, owner = self.texts.lines()
        has = np.concatenate(([0], np.cumsum(~K.SPACE[self.texts.data], dtype=np.int64)))
        full = has[end] > has[start]
        start, end, owner = start[full], end[full], owner[full]
        key = K.mix(K.span_hashes(self.texts.data, start, end) + owner.astype(np.uint64))
        first = np.unique(key, return_index=True)[1]
        return np.bincount(owner, minlength=self.texts.n) - np.bincount(owner[first], minlength=self.texts.n)

    def _n_repeat_words(self) -> np.ndarray:
        start, end, owner = self.word_spans()
        value, at = K.windows(K.span_hashes(self.texts.data, start, end), owner, 3)
        key = K.mix(value + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        twin = key[order][1:] == key[order][:-1]
        again = np.zeros(len(key), bool)
        again[order[1:][twin]] = True
        again[order[:-1][twin]] = True
        covered = np.zeros(len(owner), bool)
        for k in range(3):
            covered[at[again] + k] = True
        return np.bincount(owner[covered], minlength=self.texts.n)


@dataclass(frozen=True)
class Rule:
    """``rejects`` flags the texts of a block that fail."""

    name: str
    rejects: Callable[[Measures], np.ndarray]


#: A text must pass all of them; every threshold is a ratio of whole-text counts.
RULES = (
    Rule("symbols", lambda m: 10 * m.get("n_symbols") > m.get("n_words")),
    Rule("duplicate_lines", lambda m: 2 * m.get("n_dup_lines") > m.get("n_lines")),
    Rule("word_length", lambda m: (m.get("word_chars") < 2 * m.get("n_words")) | (m.get("word_chars") > 15 * m.get("n_words"))),
    Rule("shouting", lambda m: 2 * m.get("n_upper") > m.get("word_chars")),
    Rule("letters", lambda m: 2 * m.get("n_letters") < m.get("word_chars")),
    Rule("digits", lambda m: 4 * m.get("n_digits") > m.get("word_chars")),
)


def sample_rejections(docs: DataFrame, rules: tuple[Rule, ...], rows: int) -> list[tuple[int, int, list[float]]]:
    """Of about ``rows`` texts: each pattern of failed rules, its count, and each rule's seconds."""
    total = docs.count()
    part = docs.select("text") if total <= rows else docs.select("text").sample(rows / total, seed=7)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch):
                bits, cost = np.zeros(block.num_rows, np.int64), []
                m = Measures(block.column(0))
                for name in BASE:
                    m.get(name)  # the base rule has made these before any other is asked
                for i, rule in enumerate(rules):
                    own = m.take(np.arange(block.num_rows))
                    began = time.perf_counter()
                    bits |= rule.rejects(own).astype(np.int64) << i
                    cost.append(time.perf_counter() - began)
                found, count = np.unique(bits, return_counts=True)
                share = [[c * n / block.num_rows for c in cost] for n in count]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count), pa.array(share, pa.list_(pa.float64()))], ["pattern", "n", "cost"])

    made = K.map_batches(part, measure, "pattern long, n long, cost array<double>")
    sums = [F.sum(F.col("cost")[i]).alias(f"c{i}") for i in range(len(rules))]
    got = made.groupBy("pattern").agg(F.sum("n").alias("n"), *sums).collect()  # at most two to the number of rules
    return [(r["pattern"], r["n"], [r[f"c{i}"] for i in range(len(rules))]) for r in got]


def rule_order(sample: list[tuple[int, int, list[float]]], n_rules: int) -> list[int]:
    """Greedy order: next comes the rule with most still kept texts rejected per second."""
    cost = [max(1e-9, sum(c[i] for _, _, c in sample)) for i in range(n_rules)]
    left, order = list(range(n_rules)), []
    alive = [(p, n) for p, n, _ in sample]
    while left:
        best = max(left, key=lambda i: (sum(n for p, n in alive if p >> i & 1) / cost[i], -cost[i], -i))
        order.append(best)
        left.remove(best)
        alive = [(p, n) for p, n in alive if not p >> best & 1]
    return order


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base counts of every text and the verdict of the cascade.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept
    and failed_rule: the rule that rejected the text, ``base`` for the base rule, else null. Texts
    that the base rule rejects enter no rule, and a rule sees only what the rules before it kept, with
    all counts made so far.
    The sample of about ``sample_rows`` texts sets the order alone: ``kept`` does not depend on it.

    A null or empty text has no words and fails the base rule. Repeated ids give a row each. An
    empty table gives no rows. Columns other than doc_id and text are not read.
    """
    docs = docs.select("doc_id", "text")
    order = rule_order(sample_rejections(docs, rules, sample_rows), len(rules))
    ranked = [rules[i] for i in order]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch):
                m = Measures(block.column(1))
                counts = [m.get(name).astype(np.int64) for name in BASE]
                failed = (counts[0] < MIN_WORDS) | (100 * counts[4] > MAX_REPEAT_PERCENT * counts[0])
                why = np.full(block.num_rows, None, object)
                why[failed] = "base"
                alive = np.flatnonzero(~failed)
                m = m.take(alive)
                for rule in ranked:
                    if not len(alive):
                        break
                    bad = rule.rejects(m)
                    why[alive[bad]] = rule.name
                    if bad.any():
                        alive, m = alive[~bad], m.take(np.flatnonzero(~bad))
                kept = np.zeros(block.num_rows, bool)
                kept[alive] = True
                yield pa.RecordBatch.from_arrays([block.column(0), *map(pa.array, counts), pa.array(failed), pa.array(kept), pa.array(why, pa.string())], ["doc_id", *BASE, "base_failed", "kept", "failed_rule"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string"
    return K.map_batches(docs.withColumn("doc_id", F.col("doc_id").cast("long")), judge, schema)
