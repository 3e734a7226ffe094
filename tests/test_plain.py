"""Queries that SQL cannot express, whole results against plain loops over the same rows."""

import re

import pytest

from parley.operators import diff, reports
from parley.plans import registry
from parley.sources import carriers as C
from parley.sources.tables import table

SF_DIR = "/root/testdata/sf0.001"


def same(a, b):
    bare = lambda w: re.sub(r"^\W+|\W+$|^_+|_+$", "", w).lower()
    return bare(a) == bare(b) != ""


def plain_diff(left, right):
    """Spans of the word diff: equal ends first, then a table of the longest common subsequences of what is between."""
    a, b = (left or "").split(), (right or "").split()
    head, tail = [], []
    while a and b and same(a[0], b[0]):
        head, a, b = [*head, b[0]], a[1:], b[1:]
    while a and b and same(a[-1], b[-1]):
        tail, a, b = [b[-1], *tail], a[:-1], b[:-1]
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            longest[i][j] = longest[i + 1][j + 1] + 1 if same(a[i], b[j]) else max(longest[i + 1][j], longest[i][j + 1])
    steps, i, j = [("equal", w) for w in head], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and same(a[i], b[j]):
            steps, i, j = [*steps, ("equal", b[j])], i + 1, j + 1
        elif i < len(a) and (j == len(b) or longest[i + 1][j] >= longest[i][j + 1]):
            steps, i = [*steps, ("removed", a[i])], i + 1
        else:
            steps, j = [*steps, ("added", b[j])], j + 1
    spans = []
    for op, word in [*steps, *(("equal", w) for w in tail)]:
        if spans and spans[-1][0] == op:
            spans[-1] = (op, f"{spans[-1][1]} {word}")
        else:
            spans.append((op, word))
    return spans


def test_word_diffs_and_terms(spark):
    edits = {r.id: (r.original_text, r.edited_text) for r in C.edits(spark, SF_DIR).collect()}
    want = {i: plain_diff(*pair) for i, pair in edits.items()}
    got = {r.id: [(s.op, s.text) for s in r.spans] for r in registry.queries()["g2_word_diffs"](spark, SF_DIR).collect()}
    assert got == want and len(want) > 50
    for r in registry.queries()["g5_terms_from_edits"](spark, SF_DIR).collect():
        spans = want[r.id]
        removed, added = ([k for k, s in enumerate(spans) if s[0] == op] for op in ("removed", "added"))
        sound = len(removed) == len(added) == 1 and added[0] == removed[0] + 1 and all(len(spans[k][1].split()) <= 3 for k in (*removed, *added))
        assert (r.found, r.surface, r.canonical) == ((True, spans[removed[0]][1], spans[added[0]][1]) if sound else (False, None, None))


@pytest.mark.parametrize("pair", [("a b c d e", "x a y c e"), ("A, b -- c", "a b c"), ("", "a b"), (None, "a"), ("-- --", "--"), ("q " * 50 + "a b", "b a"), ("a b a b a", "b a b"), ("_x_ y", "X, y")])
def test_diffs_of_odd_pairs(pair):
    assert [(s["op"], s["text"]) for s in diff.spans_of(*pair)] == plain_diff(*pair)
    assert [(s["op"], s["text"]) for s in diff.spans_of(*pair[::-1])] == plain_diff(*pair[::-1])


def plain_replaced(text, terms):
    """One pass from left to right: at each place the longest surface between characters that are no letters."""
    letter = re.compile("[A-Za-zЀ-ԯⷠ-ⷿꙀ-ꚟ]")
    sizes, out, i = sorted({len(k) for k in terms}, reverse=True), [], 0
    while i < len(text):
        for n in sizes:
            word = text[i : i + n].lower()
            if word in terms and len(text[i : i + n]) == n and not (i and letter.match(text[i - 1])) and not letter.match(text[i + n : i + n + 1]):
                out, i = [*out, terms[word]], i + n
                break
        else:
            out, i = [*out, text[i]], i + 1
    return "".join(out)


def test_replaced_texts(spark):
    from parley.operators import glossary

    texts = [(r.doc_id, r.text) for r in table(spark, SF_DIR, "documents").select("doc_id", "text").collect()]
    names = sorted({r.surface.lower() for r in C.terms(spark, SF_DIR).where("kind = 1").collect()})
    want = {i: None if t is None else plain_replaced(t, {n: n.upper() for n in names}) for i, t in texts}
    assert {r.doc_id: r.text for r in registry.queries()["g3_replaced"](spark, SF_DIR).collect()} == want
    # Words of the texts themselves as terms, so that much is replaced.
    words = sorted({w for _, t in texts for w in (t or "").split()[5:9]})
    terms = spark.createDataFrame([(w, f"<{w}>", 1) for w in words], "surface string, canonical string, kind int")
    chosen = {}
    for w in words:  # of surfaces that differ in case alone the smallest counts
        chosen.setdefault(w.lower(), f"<{w}>")
    got = {r.doc_id: r.text for r in glossary.replaced(table(spark, SF_DIR, "documents").select("doc_id", "text"), terms).collect()}
    assert got == {i: None if t is None else plain_replaced(t, chosen) for i, t in texts}
    assert sum(got[i] != t for i, t in texts) > len(texts) / 2


def test_greedy_assignment_in_a_stream(spark):
    """Many groups a task, ties, one large group, and sorted batches of a few rows."""
    rows = [(g, f"s{s}", c, (g * 7 + s * 5 + c * 3) % 11) for g in range(40) for s in range(1 + g % 5) for c in range(1 + g % 4)]
    rows += [(99, f"s{s:03}", c, (s * 31 + c * 17) % 1000) for s in range(60) for c in range(60)] + [(None, "a", 1, 5), (None, "b", 1, 5)]
    want = set()
    for g in {r[0] for r in rows}:
        people, clusters = set(), set()
        for _, who, which, ms in sorted((r for r in rows if r[0] == g and r[3] > 0), key=lambda r: (-r[3], r[1], r[2])):
            if who not in people and which not in clusters:
                people.add(who)
                clusters.add(which)
                want.add((g, who, which, ms))
    cells = spark.createDataFrame(rows, "meeting_id long, speaker_id string, cluster long, ms long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = [tuple(r) for r in reports.greedy_assignment(cells, ["meeting_id"]).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and set(got) == want
