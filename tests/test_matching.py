"""Voice matching in blocks and far partners by shared words, against all pairs in plain Python."""

import math
import random

import duckdb
from parley.functions import text as T
from parley.operators import intervals, vectors
from parley.plans import registry
from pyspark.sql import functions as F


def cosine(a, b):
    if a is None or b is None or len(a) != len(b) or not a or None in a or None in b:
        return -1.0
    norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return max(-1.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True)) / norm)) if norm else -1.0


def two(trial, prints):
    ranked = sorted((-round(cosine(trial, v), 9), name) for name, v in prints)
    return ranked[0][1], -ranked[0][0], -ranked[1][0] if len(ranked) > 1 else -1.0


def test_two_nearest_prints_in_blocks_with_ties_and_odd_vectors(spark):
    rng = random.Random(1)
    vector = lambda n=5: [rng.gauss(0, 1) for _ in range(n)]
    same = vector()
    prints = [(f"p{i:03}", vector()) for i in range(60)] + [("twin b", same), ("twin a", same), ("short", vector(4)), ("zero", [0.0] * 5), ("null", None)]
    trials = [(i, same if i == 0 else vector()) for i in range(80)] + [(100, [0.0] * 5), (101, None), (102, vector(4)), (103, [None] * 5), (104, [2 * x for x in same])]
    a = spark.createDataFrame(trials, "id long, vector array<double>")
    b = spark.createDataFrame(prints, "best string, vector array<double>")
    for block in (1 << 20, 7 * 104):  # one block, and blocks of seven prints
        got = {r.id: (r.best, round(r.similarity, 9), round(r.runner_up, 9)) for r in vectors.nearest_two(a, b, block_bytes=block).collect()}
        assert got == {i: two(v, prints) for i, v in trials}
    assert got[0][0] == "twin a" and got[104][0] == "twin a"
    assert vectors.nearest_two(a, b.limit(0)).count() == 0
    one = vectors.nearest_two(a.where("id = 5"), b.where("best = 'p001'")).first()
    assert one.best == "p001" and one.runner_up == -1.0


def test_prints_of_a_group_alone_are_compared(spark):
    rng = random.Random(2)
    vector = lambda: [rng.gauss(0, 1) for _ in range(4)]
    prints = [(f"p{i}", vector(), i % 3) for i in range(20)]
    trials = [(i, vector(), i % 4 if i % 9 else None) for i in range(40)]
    a = spark.createDataFrame(trials, "id long, vector array<double>, model_id int")
    b = spark.createDataFrame(prints, "best string, vector array<double>, model_id int")
    got = {r.id: (r.best, round(r.similarity, 9), round(r.runner_up, 9)) for r in vectors.nearest_two(a, b, "model_id", 400).collect()}
    assert got == {i: two(v, [(n, x) for n, x, g in prints if g == m]) for i, v, m in trials if m in (0, 1, 2)}


def test_no_plan_makes_all_pairs(spark):
    a = spark.createDataFrame([(1, [1.0])], "id long, vector array<double>")
    plan = vectors.nearest_two(a, a.selectExpr("'x' AS best", "vector"))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "MapInArrow" in plan


def similarity(a, b):
    a, b = a[:400], b[:400]
    if not set(a) & set(b):
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return round(1 - row[-1] / max(len(a), len(b)), 9)


def test_far_partners_against_all_pairs(spark):
    rng = random.Random(3)
    texts = lambda: " ".join(rng.choice("abcdefghijklmnop") * rng.choice((1, 1, 2)) for _ in range(rng.randrange(0, 14)))
    rows = []
    for m in (1, 2, None):
        for i in range(60):
            start = rng.randrange(0, 60_000)
            rows.append((m, i, start, start + rng.randrange(0, 4000), rng.choice(("mic", "system")), "hot word" if i % 4 == 0 else texts()))
    df = spark.createDataFrame(rows, "meeting_id long, idx long, start_ms long, end_ms long, channel string, text string").withColumn("words", T.words(F.col("text")))
    report = []
    got = intervals.far_twin(df.where("channel = 'mic'"), df.where("channel = 'system'"), ["meeting_id"], ["idx"], "idx", 20_000, report)
    wanted = []
    for m, i, s, e, channel, text in rows:
        if channel != "mic" or m is None:
            continue
        pairs = []
        for m2, i2, s2, e2, c2, t2 in rows:
            gap = max(s, s2) - min(e, e2)
            if c2 == "system" and m2 == m and gap >= 20_000:
                pairs.append((-similarity(text.split(), t2.split()), -gap, i2))
        if pairs:
            best = min(pairs)
            wanted.append((m, i, best[2], -best[1], -best[0]))
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
    assert any(w[4] == 0 for w in wanted) and any(w[4] >= 0.5 for w in wanted)
    assert len(report) == 4


def test_far_partners_of_small_meetings_take_no_round(spark):
    rng = random.Random(4)
    rows = []
    for m, n in ((1, 6), (2, 20), (3, 40), (None, 6)):
        for i in range(n):
            start = rng.randrange(0, 30_000)
            rows.append((m, i, start, start + rng.randrange(0, 3000), "mic" if i % 2 else "system", " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 7)))))
    df = spark.createDataFrame(rows, "meeting_id long, idx long, start_ms long, end_ms long, channel string, text string").withColumn("words", T.words(F.col("text")))
    wanted = []
    for m, i, s, e, channel, text in rows:
        pairs = [(-similarity(text.split(), t.split()), -(max(s, s2) - min(e, e2)), j) for k, j, s2, e2, c, t in rows if channel == "mic" and c == "system" and k == m is not None and max(s, s2) - min(e, e2) >= 5000]
        if pairs:
            wanted.append((m, i, min(pairs)[2], -min(pairs)[1], -min(pairs)[0]))
    compared = {}
    for few in (0, 10, 20):
        report = []
        got = intervals.far_twin(df.where("channel = 'mic'"), df.where("channel = 'system'"), ["meeting_id"], ["idx"], "idx", 5000, report, few)
        assert sorted(map(tuple, got.collect())) == sorted(wanted)
        compared[few] = sum(report)
    assert compared[0] > compared[10] > compared[20] == 0
    assert any(w[4] == 0 for w in wanted)


def whole_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return round(1 - row[-1] / max(len(a), len(b)), 9) if set(a) & set(b) else 0.0


def test_words_beyond_the_first_400_count(spark):
    rng = random.Random(5)
    fresh = lambda name, n: [f"{name}{i}" for i in range(n)]
    body, noise = fresh("w", 900), fresh("n", 450)
    pairs = [
        (body[:450] + fresh("x", 300), body[:450] + fresh("y", 300)),  # the beginnings are equal
        (fresh("x", 450) + body[:300], fresh("y", 450) + body[:300]),  # the ends are
        (body, body[:500] + ["new"] + body[503:]),
        (body, rng.sample(body, 900)),
        (body[:401], body[:402]),
        ([rng.choice(noise) for _ in range(700)], [rng.choice(noise) for _ in range(450)]),
        ([rng.choice("abcdefgh") for _ in range(600)], [rng.choice("abcdefgh") for _ in range(500)]),
        (fresh("x", 500), fresh("y", 500)),
        (body, []),
    ]
    pairs += [(b, a) for a, b in pairs]
    got = spark.createDataFrame(pairs, "a array<string>, b array<string>").select(F.round(T.word_similarity(F.col("a"), F.col("b"), None), 9).alias("all"), F.round(T.word_similarity(F.col("a"), F.col("b")), 9).alias("first")).collect()
    assert [r["all"] for r in got] == [whole_similarity(a, b) for a, b in pairs]
    assert [r["first"] for r in got] == [similarity(a, b) for a, b in pairs]  # the other comparisons keep the survey's bound
    assert got[0]["first"] == 1 and got[0]["all"] == 0.6 and got[1]["first"] == 0 and got[1]["all"] == 0.4


def test_shared_words_are_coded_past_the_surrogates(spark, monkeypatch):
    monkeypatch.setattr(T, "_LISTS", 60_000)  # so many numbers, which 450 words are spread over
    rng = random.Random(7)
    a = [f"w{i}" for i in range(450)]
    b = rng.sample(a, 100) + a[100:]
    got = spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(F.round(T.word_similarity(F.col("a"), F.col("b"), None), 9)).first()[0]
    assert got == whole_similarity(a, b)


def test_far_partners_by_whole_long_texts(spark, tmp_path):
    rng = random.Random(6)
    common = [f"w{i}" for i in range(520)]
    ends = {0: [f"p{i}" for i in range(260)], 1: [f"q{i}" for i in range(260)]}

    def text(kind):
        if kind == "short":
            return [rng.choice(common) for _ in range(rng.randrange(0, 9))]
        head = common[:400] if kind == "same head" else rng.sample(common, 420)
        tail = ends[rng.randrange(2)]
        return head + tail[: rng.randrange(100, 260)]

    rows = []
    for m, n in ((1, 7), (2, 18)):
        for i in range(n):
            rows.append((m, i, "assistant" if i % 2 else "user", " ".join(text(rng.choice(("short", "same head", "other head"))))))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    segments = [(m, i, 2000 * i, 2000 * i + 500 + 10 * len(t), role, t.split()) for m, i, role, t in rows]
    wanted, cut = [], []
    for m, i, s, e, role, words in segments:
        near = [(max(s, s2) - min(e, e2), j, w) for k, j, s2, e2, r, w in segments if role == "user" and r == "assistant" and k == m and max(s, s2) - min(e, e2) >= 3000]
        for out, alike in ((wanted, whole_similarity), (cut, similarity)):
            ranked = sorted((-alike(words, w), -gap, j) for gap, j, w in near)
            out.extend((m, i, j, -gap, -like) for like, gap, j in ranked[:1])
    assert sorted(wanted) != sorted(cut) and {w[2] for w in wanted} != {w[2] for w in cut}
    segment = spark.createDataFrame(segments, "meeting_id long, idx long, start_ms long, end_ms long, role string, words array<string>")
    for few in (0, 16):
        got = intervals.far_twin(segment.where("role = 'user'"), segment.where("role = 'assistant'"), ["meeting_id"], ["idx"], "idx", 3000, few=few)
        assert sorted(map(tuple, got.collect())) == sorted(wanted)
    query = registry.queries()["j2_far_twin"](spark, str(tmp_path))
    assert sorted(map(tuple, query.collect())) == sorted(wanted)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(connection.sql(registry.oracle_sql()["j2_far_twin"]).fetchall()) == sorted(wanted)
