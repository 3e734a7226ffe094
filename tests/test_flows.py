from parley.operators import flows, signal

SEGMENTS = "meeting_id long, idx int, channel string, start_ms long, end_ms long, speaker_id string, text string"
EDITS = "id long, meeting_id long, channel string, start_ms long, end_ms long, original_text string, edited_text string, created_at_ms long, origin string"


def rows(spark):
    segments = [(1, 0, "mic", 0, 1000, "a", "we ship the small ring today"), (1, 1, "system", 50, 1050, "b", "we ship the small ring today"), (1, 2, "mic", 2000, 2500, "a", "Fine."), (2, 0, "mic", 0, 500, "a", "nothing here")]
    made = [(1, 1, "mic", 2000, 2500, "Fine", "Good.", 5, "human"), (2, 1, "mic", 2000, 2500, "Fine", "Great.", 4, "bulk"), (3, 2, "mic", 0, 500, "nothing here", "nothing here", 1, "human"), (4, 2, "mic", 7, 9, "x", "y", 1, "human")]
    return spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(made, EDITS)


def test_edits_are_kept_deleted_obsolete_or_homeless(spark):
    segments, edits = rows(spark)
    assert {r.id: r.action for r in flows.planned_edits(edits, segments).collect()} == {1: "keep", 2: "obsolete", 3: "delete", 4: "homeless"}


def test_a_rebuild_drops_doubles_and_moves_edits(spark):
    segments, edits = rows(spark)
    got = {r.meeting_id: r.body for r in flows.rebuilt(segments, edits, 0.9).collect()}
    assert got[1] == "**b:** we ship the small ring today\n\n**a:** Good." and got[2] == "**a:** nothing here"


def test_a_promoted_term_renders_the_meetings_that_it_changes(spark):
    segments, edits = rows(spark)
    got = flows.promoted(segments, edits, "small ring", "SmallRing").collect()
    assert [r.meeting_id for r in got] == [1] and got[0].body.count("SmallRing") == 2


def test_a_hint_that_two_meetings_used_is_global(spark):
    terms = spark.createDataFrame([(1, "a", 0, "meeting", 5), (2, "b", 1, "meeting", 5), (3, "c", 0, "meeting", 5)], "id long, surface string, kind int, scope string, meeting_id long")
    uses = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6), (3, 5), (3, 5)], "term_id long, meeting_id long")
    assert {r.id: (r.scope, r.meeting_id) for r in flows.promoted_hints(terms, uses).collect()} == {1: ("global", None), 2: ("meeting", 5), 3: ("meeting", 5)}


def test_buffers_never_start_earlier(spark):
    rounds = spark.createDataFrame([("a", 1, 1000, 900), ("a", 2, 2000, None), ("a", 3, 40_000, 800)], "session_id string, id int, now_ms long, until_ms long")
    got = signal.buffer_starts(rounds, ["session_id"], "id").orderBy("id").collect()
    assert [r.start_ms for r in got] == [700, 700, 10_000]


VOICED = "id long, meeting_id long, idx int, channel string, start_ms long, end_ms long, speaker_id string, source string, vector array<double>, ms long, text string"


def test_a_voice_pass_names_clears_and_remembers_and_writes_only_what_changed(spark, tmp_path):
    from parley.operators import transcripts
    from parley.sources.stored import StoredTable
    from pyspark.sql import functions as F

    def row(i, meeting, speaker, source, vector):
        return (i, meeting, i, "mic", 1000 * i, 1000 * i + 900, speaker, source, vector, 900, f"line {i}.")

    segments = spark.createDataFrame(
        [
            row(0, 1, "anna", "human", [1.0, 0.0, 0.0]),
            row(1, 1, "peter", "human", [0.0, 1.0, 0.0]),
            row(2, 1, "", "none", [0.96, 0.28, 0.0]),  # anna
            row(3, 1, "anna", "voiceprint", [0.28, 0.96, 0.0]),  # peter now
            row(4, 1, "peter", "voiceprint", None),  # cleared: no vector
            row(5, 1, "channel", "channel", [0.7, 0.7, 0.0]),  # undecided, stays
            row(6, 1, "peter", "voiceprint", [0.0, 0.0, 1.0]),  # cleared, then remembered
            row(7, 1, None, None, []),
            row(8, 2, "", "none", [0.0, 0.1, 1.0]),  # a meeting without prints: remembered
            row(9, 3, "anna", "human", [1.0, 0.0, 0.0]),
        ],
        VOICED,
    )
    voices = spark.createDataFrame([("maria", [0.0, 0.0, 1.0])], "speaker_id string, vector array<double>")
    made = flows.voice_pass(segments, voices)
    labels = {r.id: (r.speaker_id, r.source) for r in made.labels.collect()}
    assert labels == {
        0: ("anna", "human"), 1: ("peter", "human"), 2: ("anna", "voiceprint"), 3: ("peter", "voiceprint"), 4: ("", "none"), 5: ("channel", "channel"),
        6: ("1:voice:maria", "voiceprint"), 7: ("", "none"), 8: ("2:voice:maria", "voiceprint"), 9: ("anna", "human"),
    }
    report = {r.meeting_id: (r.prints, r.signed, r.cleared, r.unknown, r.without_vector, r.signed_from_memory) for r in made.report.collect()}
    assert report == {1: (2, 2, 2, 2, 2, 1), 2: (0, 0, 0, 1, 0, 1), 3: (1, 0, 0, 0, 0, 0)}
    before = transcripts.rendered(segments.fillna("", ["speaker_id"])).withColumn("version", F.lit(4)).select("meeting_id", "version", "body")
    finals = StoredTable.create(before, f"file://{tmp_path}/finals", ["meeting_id"], 8)
    old = spark.createDataFrame([(2, "gone", [1.0], 1, 5), (77, "other", [1.0], 1, 5)], made.prints.schema)
    prints = StoredTable.create(old, f"file://{tmp_path}/prints", ["meeting_id"], 8)
    for _ in range(2):
        flows.apply_voice_pass(made, segments, prints, finals)
        assert sorted((r.meeting_id, r.speaker_id) for r in prints.rows().collect()) == [(1, "anna"), (1, "peter"), (3, "anna"), (77, "other")]
        bodies = {r.meeting_id: r.body for r in finals.rows().collect()}
        assert "**1:voice:maria:** line 6." in bodies[1] and bodies[2] == "**2:voice:maria:** line 8." and bodies[3] == "**anna:** line 9."
