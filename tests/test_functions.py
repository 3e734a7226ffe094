"""Fixtures worked out by hand for rules that the tables at hand don't reach."""

import pytest
from pyspark.sql import functions as F

from parley.functions import scalars as S
from parley.functions import text as T
from parley.operators import glossary, maintenance, reports, search, signal, transcripts, vectors


def one(spark, expression, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expression.alias("x")).first().x


def test_words_and_similarity(spark):
    rows = [("Как-то, Ёлка!", "как то елка", 0.0), ("обсудили билинг и сроки", "обсудили биллинг и сроки", 0.75), ("", "a", 0.0), ("a b c", "a b c", 1.0), ("a a b", "a b", 2 / 3)]
    df = spark.createDataFrame(rows, "a string, b string, s double")
    for r in df.select("s", T.word_similarity(T.words(F.col("a")), T.words(F.col("b"))).alias("x"), T.words(F.col("a")).alias("w")).collect()[1:]:
        assert r.x == pytest.approx(r.s)
    assert df.select(T.words(F.col("a")).alias("w")).first().w == ["както", "елка"]
    assert df.select(T.tokens(F.col("a")).alias("w")).first().w == ["Как", "то", "Ёлка"]
    assert one(spark, T.word_overlap(T.words(F.col("a")), T.words(F.col("b"))), a="a a b c", b="a a a c") == pytest.approx(0.75)


def test_hallucinations(spark):
    df = spark.createDataFrame([("Субтитры подогнал Игорь",), ("добавили субтитры в проект",), ("Thanks for watching!",), ("",), (None,), ("обычная речь",), ("субтитры",)], "t string")
    assert [r.x for r in df.select(T.is_hallucination(F.col("t")).alias("x")).collect()] == [True, False, True, True, True, False, False]
    assert [r.x for r in df.select(T.may_become_hallucination(F.col("t")).alias("x")).collect()] == [False, False, False, False, False, False, True]


def test_scalars(spark):
    for ms, label in ((0, "1970-01-01"), (1785628800000, "2026-08-02"), (1709164800000, "2024-02-29")):
        assert one(spark, S.date_label(F.lit(ms))) == label
    assert one(spark, S.fingerprint(F.col("a")), a="") == "cbf29ce484222325"
    assert one(spark, S.fingerprint(F.col("a")), a="a") == "af63dc4c8601ec8c"
    assert one(spark, S.upper_median(F.array(*map(F.lit, (4, 1, 3, 2))))) == 3
    assert one(spark, S.mixed(F.array(F.lit(30000), F.lit(1)), F.array(F.lit(30000)))) == [32767, 1]
    assert one(spark, S.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == -1
    assert one(spark, T.parse_numbered(F.lit("2. b\n1. a"), F.lit(2))) == ["a", "b"]
    assert one(spark, T.parse_numbered(F.lit("1. a\n1. b"), F.lit(2))) is None


def test_short_pairs_stay_and_doubled_replies_go(spark):
    schema = "meeting_id long, idx long, start_ms long, end_ms long, channel string, speaker_id string, text string"
    rows = [(1, 0, 1000, 5000, "mic", "a", "мы обсудили сроки и бюджет"), (1, 1, 1200, 5100, "system", "b", "мы обсудили сроки и бюджеты"), (1, 2, 6000, 7000, "mic", "a", "Да"), (1, 3, 6000, 7000, "system", "b", "Да.")]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.idx for r in transcripts.collapsed(df, 0.5).collect()) == [1, 2, 3]
    report = transcripts.collapse_report(df, 0.5).first()
    assert (report.paired, report.collapsed, report.kept_short) == (2, 1, 1)
    with pytest.raises(ValueError):
        transcripts.collapsed(df, 0)


def test_glossary_replacement(spark):
    texts = spark.createDataFrame([(1, "Pay pal, paypal! xpaypal paypal2 payments"), (2, None)], "id long, text string")
    terms = spark.createDataFrame([("paypal", "PayPal", 1), ("pay pal", "PayPal", 1), ("pay", "PAY", 1), ("payments", "hint", 0)], "surface string, canonical string, kind int")
    got = {r.id: r.text for r in glossary.replaced(texts, terms).collect()}
    assert got == {1: "PayPal, PayPal! xpaypal PayPal2 payments", 2: None}


def test_glossary_replacement_reads_every_term(spark):
    texts = spark.createDataFrame([(1, "a Tin cup, TIN and a long brass horn; tins"), (1, "a Tin cup, TIN and a long brass horn; tins"), (2, None), (3, "")], "id long, text string")
    many = spark.range(20_001).select(F.lit("long brass horn").alias("surface"), F.lit("HORN").alias("canonical"), F.lit(1).alias("kind"))
    terms = many.union(spark.createDataFrame([("tin", "Sn", 1), ("Tin cup", "mug", 1), ("tin cup", "other", 1), ("cup", "CUP", 1)], "surface string, canonical string, kind int"))
    wanted = [(1, "a mug, Sn and a long brass horn; tins".replace("long brass horn", "HORN"))] * 2 + [(2, None), (3, "")]
    for most in (100_000, 0):  # as a table in the tasks, and by a join
        got = sorted(map(tuple, glossary.replaced(texts, terms, most=most).collect()), key=lambda r: r[0])
        assert got == wanted
    assert glossary.replaced(texts, terms.limit(0)).where("id = 1").first().text == texts.first().text


def test_search(spark):
    docs = spark.createDataFrame([("a", "обсудили биллинга срок"), ("b", "ничего"), ("c", "Élan vital élan")], "ref_id string, body string")
    assert [r.ref_id for r in search.search(docs, "биллин").collect()] == ["a"]
    assert [r.ref_id for r in search.search(docs, "elan").collect()] == ["c"]
    for query in ('"', "*", "(", "", "NEAR("):
        assert search.search(docs, query).count() == 0
    assert docs.where("ref_id = 'a'").select(search.snippet(F.col("body"), "биллин").alias("s")).first().s == "…[биллинга] срок"


def test_voices(spark):
    rows = [(0, "a", "human", [1.0, 0.0]), (1, "b", "human", [0.0, 1.0]), (2, None, "none", [0.9, 0.1]), (3, "x", "voiceprint", [0.7, 0.7]), (4, "mic", "channel", [0.7, 0.7]), (5, "mic", "channel", None)]
    df = spark.createDataFrame(rows, "id long, speaker_id string, source string, vector array<double>")
    got = {r.id: (r.speaker_id, r.source) for r in vectors.enrolment(df).collect()}
    assert got == {0: ("a", "human"), 1: ("b", "human"), 2: ("a", "voiceprint"), 3: (None, "none"), 4: ("mic", "channel"), 5: ("mic", "channel")}


def test_maintenance(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, maintenance.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, maintenance.upserted(old, new, ["k"], keep_old=True).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    assert maintenance.setting(old.select(F.col("v").alias("key"), F.col("v").alias("value")), "z", "no").first().value == "no"
    with pytest.raises(LookupError):
        maintenance.update_one(old, F.col("k") == 9, {"v": F.lit("x")})


def test_reports(spark):
    sweep = spark.createDataFrame([(0.2, 10, 3), (0.4, 8, 0), (0.6, 5, 0)], "threshold double, pairs long, control long")
    assert tuple(reports.lowest_threshold(sweep).first()) == (0.4, 0.4)
    cells = spark.createDataFrame([(1, "a", 0, 50), (1, "b", 0, 40), (1, "b", 1, 30)], "meeting_id long, speaker_id string, cluster int, ms long")
    assert sorted((r.speaker_id, r.cluster) for r in reports.greedy_assignment(cells, ["meeting_id"]).collect()) == [("a", 0), ("b", 1)]
    assert reports.agreement(cells, ["meeting_id"]).first().accuracy == pytest.approx(80 / 120)


def test_correlation_and_smoothing(spark):
    a = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate([0, 1, 5, 2, 0, 0, 3])], "k string, at int, v double")
    b = a.withColumn("at", F.col("at") + 2)
    best = signal.lag_correlation(a, b, ["k"], 2).where("best").first()
    assert best.lag == 2 and best.corr == pytest.approx(1.0)
    rows = spark.createDataFrame([(1, 2.0), (2, 2.0)], "at long, v double")
    assert [r.gain for r in signal.smoothed(rows, [], ["at"], "v").orderBy("at").collect()] == [1.25, 1.4375]


def test_twins_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(m, i, s := rng.randrange(0, 90_000), s + rng.randrange(0, 9000), rng.choice(("mic", "system")), "a", " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 9)))) for m in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "meeting_id long, idx long, start_ms long, end_ms long, channel string, speaker_id string, text string")

    def distance(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, line[0] = line[0], i
            for j, y in enumerate(b, 1):
                last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
        return line[-1]

    def likeness(a, b):
        x, y = a.split(), b.split()
        return 1 - distance(x, y) / max(len(x), len(y)) if x and y else 0.0

    wanted = {}
    for m, i, s, e, c, _, t in rows:
        if c == "mic":
            far = [(-likeness(t, r[6]), -(min(e, r[3]) - max(s, r[2])), r[1]) for r in rows if r[0] == m and r[4] == "system" and min(e, r[3]) > max(s, r[2])]
            if far:
                wanted[m, i] = min(far)
    got = {(r.meeting_id, r.idx): r for r in transcripts.twins(df).collect()}
    assert got.keys() == wanted.keys()
    for k, (similarity, overlap, other) in wanted.items():
        assert got[k].r_idx == other and got[k].overlap == -overlap and got[k].similarity == pytest.approx(-similarity)


def test_pace_slows_when_idle(spark):
    frames = spark.createDataFrame([("a", i, i < 4) for i in range(24)], "k string, ts_ms int, accepted boolean")
    # rounds of 2 frames: two with speech, two idle ones, then rounds of 4, then of 6
    assert signal.paced_inferences(frames, ["k"], base=2).first().inferences == 4 + 1 + 2


def test_remembered_voices(spark):
    rows = spark.createDataFrame([(1, "none", [1.0, 0.1], "m"), (2, "none", [1.0, 0.1], "other"), (3, "human", [1.0, 0.1], "m"), (4, "none", None, "m")], "id int, source string, vector array<double>, model_id string")
    voices = spark.createDataFrame([("ann", [1.0, 0.0], "m"), ("bob", [0.0, 1.0], "m")], "speaker_id string, vector array<double>, model_id string")
    assert [(r.id, r.speaker_id) for r in vectors.remembered(rows, voices).collect()] == [(1, "ann")]


def test_fingerprints_side_by_side_equal_those_byte_by_byte(spark):
    def plain(value):
        state = 0xCBF29CE484222325
        for byte in value.encode():
            state = (state ^ byte) * 0x100000001B3 % (1 << 64)
        return f"{state:016x}"

    texts = ["é" * n + "x" * (n % 7) for n in range(40)] + ["", "a" * 5000, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.fingerprint("t").alias("f")).collect()
    assert all(r.f == (None if r.t is None else plain(r.t)) for r in rows)


def test_similarity_against_a_plain_edit_distance(spark):
    import random

    def plain(a, b):
        if not a or not b:
            return 0.0
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, before = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(row[j] + 1, before[j + 1] + 1, before[j] + (x != y)))
        return 1 - row[-1] / max(len(a), len(b))

    rng = random.Random(3)
    pick = lambda: [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 12))]
    pairs = [(pick(), pick()) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", T.word_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert all(abs(r.s - plain(r.a, r.b)) < 1e-12 for r in rows)
