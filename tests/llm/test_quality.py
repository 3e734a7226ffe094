import re
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from parley.llm import quality, queries

SMALL = "/root/testdata/sf0.01"

SCHEMA = "doc_id long, text string, kept string, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    many = Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) if many[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered)


PROSE = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}ord" for k in range(120))
ROWS = [(1, None), (2, ""), (3, "a b c a b c a b"), (4, PROSE), (4, PROSE), (5, PROSE.replace(" ", " ### ")), (6, PROSE.upper()), (7, f"{PROSE}\n" * 3), (8, "é日 " * 60_000), (9, "one\n\none\n one\r\none\n" + PROSE), (None, " ".join(f"{k}" for k in range(90)))]


def test_counts_and_verdicts(spark):
    got = quality.quality_cascade(spark.createDataFrame([(i, t, "x", "y") for i, t in ROWS], SCHEMA)).collect()
    assert len(got) == len(ROWS)
    for (i, text), r in zip(ROWS, got, strict=True):
        counts = brute(text)
        assert (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (i, *counts)
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
    assert [r.kept for r in got] == [False, False, False, True, True, False, False, False, False, True, False]
    assert [r.failed_rule for r in got][5:7] == ["symbols", "shouting"]
    assert quality.quality_cascade(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_verdict_does_not_depend_on_the_order(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in ROWS], SCHEMA)
    a = quality.quality_cascade(docs, quality.RULES)
    b = quality.quality_cascade(docs, tuple(reversed(quality.RULES)))
    assert [r.kept for r in a.collect()] == [r.kept for r in b.collect()]


def test_rules_come_by_new_rejections_per_second():
    sample = [(0b011, 10, [1.0, 1.0, 0.1]), (0b001, 2, [1.0, 1.0, 0.1]), (0b100, 3, [0.0, 0.0, 0.1]), (0, 50, [0.0, 0.0, 0.0])]
    assert quality.rule_order(sample, 3) == [2, 0, 1]


def verdict(text, counts):
    """Whether a text passes the base rule and every other one, by plain counts of its own."""
    text = text or ""
    words, chars, symbols, twice, repeated = counts
    lines = text.split("\n")
    upper, digits = len(re.findall("[A-Z]", text)), len(re.findall("[0-9]", text))
    letters = sum(c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" or ord(c) > 127 for c in text)
    bad = [words < 50 or 100 * repeated > 50 * words, 10 * symbols > words, 2 * twice > len(lines), not 2 * words <= chars <= 15 * words, 2 * upper > chars, 2 * letters < chars, 4 * digits > chars]
    return bad[0], not any(bad)


@pytest.mark.skipif(not Path(SMALL).exists(), reason="needs the given tables")
def test_query_against_plain_rules(spark):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got = queries.op7_quality_cascade(spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        counts = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert (r.base_failed, r.kept) == verdict(docs[r.doc_id], counts), r.doc_id
    assert {r.kept for r in got} == {True, False}
