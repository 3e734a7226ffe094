"""Term counts, their examples and candidates against plain loops."""

import random
import re
from collections import Counter, defaultdict

from parley.operators import glossary

WORDS = ["Alpha", "alpha", "ALPHA", "beta", "x", "Gamma", "gamma", "NATO", "слово", "Слово", "delta"]


def counted(rows):
    """(meeting, key): occurrences, surface and examples."""
    spellings, places = defaultdict(Counter), defaultdict(dict)
    for meeting, idx, start, text in rows:
        for token in re.findall(r"\w+", text):
            if len(token) >= 2:
                spellings[meeting, token.lower()][token] += 1
                first = places[meeting, token.lower()]
                first[start] = min(first.get(start, (idx, text)), (idx, text))
    out = {}
    for k, names in spellings.items():
        firsts = sorted((idx, start, text) for start, (idx, text) in places[k].items())[:2]
        out[k] = (sum(names.values()), min(names, key=lambda n: (-names[n], n)), [(start, text) for _, start, text in firsts])
    return out


def replies(spark):
    rng = random.Random(5)
    rows = [(m, rng.randrange(12), 1000 * rng.randrange(9), " ".join(rng.choice(WORDS) for _ in range(rng.randrange(9)))) for m in (1, 2, None) for _ in range(40)]
    return rows, spark.createDataFrame(rows, "meeting_id long, idx long, start_ms long, text string")


def test_counts_and_examples_with_tied_places_and_without_a_meeting(spark):
    rows, df = replies(spark)
    found = {(r.meeting_id, r.key): (r.occurrences, r.surface, [tuple(e) for e in r.examples]) for r in glossary.token_counts(df, ["meeting_id"]).collect()}
    assert found == counted(rows)
    bare = glossary.token_counts(df, ["meeting_id"], examples=False)
    assert {(r.meeting_id, r.key): (r.occurrences, r.surface) for r in bare.collect()} == {k: v[:2] for k, v in counted(rows).items()}


def test_candidates_after_the_commonest_are_named(spark):
    rows, df = replies(spark)
    known = spark.createDataFrame([("delta",)], "key string")
    found = glossary.mined(df, known, ["meeting_id"], 3, 2)
    wanted = set()
    for meeting in (1, 2, None):
        mine = {key: v for (m, key), v in counted(rows).items() if m == meeting}
        head = sorted(mine, key=lambda key: (-mine[key][0], key))[: 2 if meeting else 0]
        ruled = [(-n, surface, "latin" if surface.isascii() else "repeated", examples) for key, (n, surface, examples) in mine.items() if key != "delta" and (surface.isascii() or (n >= 3 and key not in head))]
        wanted |= {(meeting, surface, -n, rule, place, tuple(examples)) for place, (n, surface, rule, examples) in enumerate(sorted(ruled))}
    assert {(r.meeting_id, r.surface, r.occurrences, r.rule, r.position, tuple(tuple(e) for e in r.examples)) for r in found.collect()} == wanted


def test_counting_and_mining_move_no_texts(spark):
    _, df = replies(spark)
    counts = glossary.token_counts(df, ["meeting_id"], examples=False)
    known = spark.createDataFrame([("delta",)], "key string")
    for query, shuffles in ((counts, 2), (glossary.frequent_head(counts, ["meeting_id"], 5), 3), (glossary.mined(df, known, ["meeting_id"], 3, 2, examples=False), 4)):  # the last with one more, after the join with known ones
        plan = query._jdf.queryExecution().executedPlan().toString()
        texts = set(re.findall(r"text#\d+", plan))
        moved = [line for line in plan.splitlines() if "partial_" in line or "Exchange" in line]
        assert texts and not any(t in line for t in texts for line in moved)
        assert plan.count("Exchange hashpartitioning(meeting_id") == shuffles
