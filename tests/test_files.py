import struct
import wave

import pytest
from pyspark.sql import functions as F

from parley.operators import audio, briefs, diff
from parley.sources import files


def test_glossary_csv(spark, tmp_path):
    path = tmp_path / "terms.csv"
    path.write_text('surface,canonical,language,scope,meeting_id\npay pal,PayPal,en,global,\n"say ""hi""","Hi, you",en,meeting,m1\n,x,en,global,\na,b,en,meeting,\na,b,en,other,\n', encoding="utf-8")
    good, bad = files.glossary_csv(spark, str(path))
    assert sorted((r.surface, r.canonical, r.meeting_id) for r in good.collect()) == [("pay pal", "PayPal", None), ('say "hi"', "Hi, you", "m1")]
    assert bad.first().skipped == 3
    (tmp_path / "wrong.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.glossary_csv(spark, str(tmp_path / "wrong.csv"))


def test_diagnostics(spark, tmp_path):
    rows = spark.createDataFrame([(i, "session_open" if i in (2, 5) else "partial", i * 10, f'te"xt {i}') for i in range(8)], files.DIAGNOSTIC)
    files.append_diagnostics(rows, str(tmp_path / "log"))
    files.append_diagnostics(rows.limit(1), str(tmp_path / "log"))
    (tmp_path / "log" / "broken.json").write_text("{not json\n")
    back = files.diagnostics(spark, str(tmp_path / "log"))
    assert back.where("ts_ms is not null").count() == 9
    assert files.diagnostics(spark, str(tmp_path / "log"), ["session_open"]).count() == 2
    assert [r.ts_ms for r in files.after_last_marker(rows).orderBy("ts_ms").collect()] == [5, 6, 7]
    assert [r.ts_ms for r in files.rotated(rows, 3).collect()] == [5, 6, 7]
    size = files.folder_bytes(spark, str(tmp_path / "log"), "*.json").first()
    assert size.files >= 2 and size.bytes > 100


def test_power_log(spark, tmp_path):
    (tmp_path / "p.txt").write_text("time power\n1 2.5 x\n2 3.5 x\nnone\n3 - x\n")
    row = files.power_log(spark, str(tmp_path / "p.txt"), 1).first()
    assert row["mean"] == pytest.approx(3.0) and row["rows"] == 3


def test_tracks(spark):
    chunks = spark.createDataFrame([("a", 1, 100, 1000, 3, [4, 5, 6]), ("a", 0, 0, 1000, 3, [1, 2, 3])], "session_id string, seq int, timestamp_ms long, sample_rate int, frame_count int, pcm array<int>")
    assert audio.whole_track(chunks, ["session_id"]).first().pcm == [1, 2, 3, 4, 5, 6]
    assert audio.track_range(chunks, ["session_id"], 1, 102).first().pcm == [2, 3, 4, 5]
    with pytest.raises(ValueError):
        audio.track_range(chunks, ["session_id"], 0, 40_000)
    frames = audio.framed(audio.whole_track(chunks, ["session_id"]), ["session_id"], 4).orderBy("frame").collect()
    assert [r.pcm for r in frames] == [[1, 2, 3, 4], [5, 6]]
    with pytest.raises(Exception, match="samples"):
        audio.whole_track(chunks.withColumn("frame_count", F.lit(9)), ["session_id"]).collect()
    raw = spark.createDataFrame([("p", bytearray(b"\x01\x00\xff\xff\x07"))], "path string, content binary")
    assert audio.decoded(raw).first().pcm == [1, -1]


def test_loudest_windows(spark):
    levels = spark.createDataFrame([("a", i, 10.0 if 40 <= i < 48 else 5.0 if 8 <= i < 16 else 1.0) for i in range(64)], "k string, at int, level double")
    got = audio.loudest_windows(levels, ["k"], 8, 2).orderBy("at").collect()
    assert [r.at for r in got] == [8, 40]


def test_diffs(spark):
    rows = spark.createDataFrame([("обсудили билинг и сроки", "обсудили биллинг и сроки"), ("a b", "a b"), (None, "x y"), ("one two three four", "q"), ("Да", "да.")], "a string, b string")
    spans = rows.select(diff.word_diff("a", "b").alias("s"))
    got = [[(x.op, x.text) for x in r.s] for r in spans.collect()]
    assert got[0] == [("equal", "обсудили"), ("removed", "билинг"), ("added", "биллинг"), ("equal", "и сроки")]
    assert got[1] == [("equal", "a b")] and got[2] == [("added", "x y")] and got[4] == [("equal", "да.")]
    terms = [r.t for r in spans.select(diff.term_from_spans(F.col("s")).alias("t")).collect()]
    assert tuple(terms[0]) == ("билинг", "биллинг") and terms[1] is None and terms[3] is None


def test_briefs(spark):
    finals = spark.createDataFrame([(1, "First part here.\n\nWe will call them.\n\nNothing."), (2, "")], "meeting_id long, body string")
    got = {r.meeting_id: (r.summary, r.actions) for r in briefs.brief(finals, ["will"]).collect()}
    assert got == {1: ("First part here.", "- We will call them."), 2: ("", "")}


def test_wav_files(spark, tmp_path):
    for name, width in (("a", 2), ("b", 1)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as out:
            out.setnchannels(1)
            out.setsampwidth(width)
            out.setframerate(16000)
            out.writeframes(struct.pack("<3h", 1, -2, 300) if width == 2 else bytes(3))
    (tmp_path / "c.wav").write_bytes(b"no sound")
    got = {r.path[-5]: r for r in files.wav(spark, str(tmp_path)).collect()}
    assert (got["a"].rate, got["a"].channels, got["a"].pcm) == (16000, 1, [1, -2, 300])
    assert got["b"].rate == 16000 and got["b"].pcm is None and got["c"].rate is None and got["c"].pcm is None


def test_bytes_below_every_folder(spark):
    rows = [("a/b/c.raw", 5), ("a/b/d.raw", None), ("a/e.raw", 7), ("f.raw", 1), (None, 9), ("a/b/c.raw", 5), ("/x//y.raw", 2)]
    got = {r.folder: (r.files, r.bytes) for r in files.tree_bytes(spark.createDataFrame(rows, "path string, bytes long")).collect()}
    assert got == {"": (6, 20), "a": (4, 17), "a/b": (3, 10), "x": (1, 2)}
    assert files.tree_bytes(spark.createDataFrame([], "path string, bytes long")).count() == 0
