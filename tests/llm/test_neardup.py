import random
import re

import numpy as np

from parley.llm import components, neardup

SCHEMA = "doc_id long, text string, kept string"


def brute(rows, width, percent):
    """Components over all pairs of whole sets."""
    sets, parent = {}, {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        one = frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()
        sets.setdefault(i, []).append(one)
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in sets}


def made_rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = [word() if rng.random() < rng.choice((0, 0.01, 0.03, 0.06)) else w for w in base]
            rows.append((len(rows), " ".join(copy)))
    return rows


def check(spark, rows, width, percent):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = neardup.near_duplicates(docs, width, percent).collect()
    wanted = brute(rows, width, percent)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == wanted[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    return {r.doc_id: r for r in got}


def test_against_all_pairs(spark):
    check(spark, made_rows(), 3, 85)


def test_a_text_of_four_fifths_of_another(spark):
    base = [f"w{k}" for k in range(204)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:165])), (3, " ".join(base[:160]))]
    got = check(spark, rows, 5, 80)
    assert got[2].component_id == 1
    check(spark, made_rows(), 5, 80)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, None), (9, "One"), (3, "one"), (10, "one two"), (11, "ONE  two"), (20, long), (21, long + " x"), (22, "a b c d"), (22, "one"), (30, "a b c d")]
    got = check(spark, rows, 3, 85)
    assert got[5].n_shingles == 0 and got[9].n_shingles == 1 and got[21].component_id == 20 and got[22].component_id == 3
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_long_posting_list_is_dealt_over_cells(spark, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    monkeypatch.setattr(neardup, "PART_ROWS", 40)
    monkeypatch.setattr(neardup, "HUB_ROWS", 30)
    rng = random.Random(2)
    rows = [(i, " ".join([*base[: i % 60], f"x{i}", *base[i % 60 :]])) for i in range(200)]
    for i in range(200, 500):  # near each other, but most of them not linked
        rows.append((i, " ".join(w if rng.random() > 0.06 else f"y{i}" for w in base)))
    check(spark, rows, 3, 85)


def test_pairs_compared_in_a_hot_group_grow_with_its_size(spark, monkeypatch):
    """Near copies of one text are linked with their hub; no cell is left to compare."""
    base = [f"w{k}" for k in range(150)]
    docs = spark.createDataFrame([(i, " ".join([*base, f"x{i}"])) for i in range(3000)], "doc_id long, text string")
    made = []
    cells = neardup.cells
    monkeypatch.setattr(neardup, "cells", lambda p: made.append(cells(p)) or made[-1])
    got = neardup.near_duplicates(docs, 5, 80).collect()
    assert {r.component_id for r in got} == {0} and made[0].count() == 0


def test_every_link_of_the_tables_is_found(spark):
    """Against all pairs that share a shingle, at both thresholds in use."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((3, 85), (5, 80)):
        sets, holders = {}, {}
        for i, text in rows:
            words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
            sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
            for x in sets[i]:
                holders.setdefault(x, []).append(i)
        pairs = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :]}
        label = {i: i for i in sets}

        def root(i, label=label):
            while label[i] != i:
                i = label[i]
            return i

        for a, b in pairs:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, width, percent).collect()}
        assert got == {i: root(i) for i in sets}


def test_threshold_misses_few():
    """The binomial bound, and collisions of real signatures of sets of a known similarity."""
    assert (neardup.match_threshold(85), neardup.match_threshold(80)) == (39, 34)
    import pyarrow as pa

    least = 64
    for k in range(300):  # one set is 0.85 of the other
        words = [f"{k}_{i}" for i in range(200)]
        value, ends = neardup.shingle_sets(pa.array([" ".join(words), " ".join(words[:170])]), 1)
        a, b = ((value[s:e, None] * neardup._MULTIPLIERS).min(0) for s, e in zip(ends, ends[1:]))
        least = min(least, int((a == b).sum()))
    assert least >= 42  # far from the threshold of 39


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_counts_by_matrix_equal_counts_by_pair():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.int64) for _ in range(12)]
    value, size = np.concatenate(sets), np.array([len(s) for s in sets])
    a, b = np.triu_indices(12, 1)
    wanted = [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)]
    assert neardup.shared_counts(value, size, a, b).tolist() == wanted
    assert neardup.shared_counts(value, size, a[:5], b[:5]).tolist() == wanted[:5]
