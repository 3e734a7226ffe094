"""Further queries of scans, scalar functions, reports and flows, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import scalars as S
from parley.functions import text as T
from parley.operators import audio, briefs, diff, edits, flows, glossary, intervals, maintenance, ordered, reports, search, signal, transcripts, vectors
from parley.plans.register import CENTROID, SQL, TOKENS, WORDS, agreement_sql, query, report_sql, twins_sql
from parley.sources import carriers as C
from parley.sources.shared import new_path
from parley.sources.stored import StoredTable
from parley.sources.tables import stream, table
from parley.streaming import slots


def _position(keys: list[str], *order) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long").alias("position")


def _values(spark: SparkSession, name: str, values: list[float]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


# -- Scans ------------------------------------------------------------------------------------------


@query("s4_versions_listed", f"SELECT meeting_id, version, row_number() OVER (PARTITION BY meeting_id ORDER BY version DESC) AS position FROM ({C.VERSIONS_SQL})")
def _s4(spark, sf_dir):
    return C.versions(spark, sf_dir).select("meeting_id", "version", _position(["meeting_id"], F.desc("version")))


@query("s5_version_lookup", f"SELECT meeting_id, version, body FROM ({C.VERSIONS_SQL}) WHERE meeting_id = 4 AND version = 2")
def _s5(spark, sf_dir):
    return C.versions(spark, sf_dir).where("meeting_id = 4 AND version = 2").select("meeting_id", "version", "body")


@query("s6_artifacts_listed", f"SELECT meeting_id, id, kind, row_number() OVER (PARTITION BY meeting_id ORDER BY id) AS position FROM ({C.ARTIFACTS_SQL})")
def _s6(spark, sf_dir):
    return C.artifacts(spark, sf_dir).select("meeting_id", "id", "kind", _position(["meeting_id"], "id"))


@query("s9_speakers_listed", "SELECT s_nationkey AS meeting_id, s_suppkey AS id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 5, s_suppkey) AS position FROM supplier")
def _s9(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("meeting_id"), F.col("s_suppkey").alias("id"))
    return rows.select("meeting_id", "id", _position(["meeting_id"], F.col("id") % 5, "id"))


@query("s11_known_voices", f"SELECT id, speaker_id, len(vector)::INTEGER AS size FROM ({C.PRINTS_SQL}) WHERE source = 'human'")
def _s11(spark, sf_dir):
    return C.prints(spark, sf_dir).where("source = 'human'").select("id", "speaker_id", F.size("vector").alias("size"))


@query("s12_dismissed_listed", f"SELECT meeting_id, id, surface, row_number() OVER (PARTITION BY meeting_id ORDER BY surface, id) AS position FROM ({C.TERMS_SQL}) WHERE kind = 0 AND meeting_id IS NOT NULL")
def _s12(spark, sf_dir):
    return C.terms(spark, sf_dir).where("kind = 0 AND meeting_id IS NOT NULL").select("meeting_id", "id", "surface", _position(["meeting_id"], "surface", "id"))


def _tracks(spark: SparkSession, sf_dir: str, samples: int) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    pcm = F.array(*(q + i for i in range(samples)))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("seq"), pcm.alias("pcm"))
    return rows.withColumns({"frame_count": F.size("pcm"), "timestamp_ms": F.col("seq") * 500, "sample_rate": F.lit(samples * 2)})


def _shown(array: str | Column) -> Column:
    return F.array_join(F.transform(array, lambda v: v.cast("string")), " ")


_TRACK_SQL = "SELECT l_orderkey AS session_id, flatten(list([l_quantity::INTEGER, l_quantity::INTEGER + 1] ORDER BY l_linenumber, l_quantity)) AS pcm FROM lineitem GROUP BY 1"


@query("s13_whole_track", f"SELECT session_id, array_to_string(pcm, ' ') AS pcm FROM ({_TRACK_SQL})")
def _s13(spark, sf_dir):
    return audio.whole_track(_tracks(spark, sf_dir, 2), ["session_id"]).select("session_id", _shown("pcm").alias("pcm"))


@query("s14_track_range", """
    WITH c AS (SELECT l_orderkey AS session_id, l_linenumber AS seq, l_quantity::INTEGER AS q, l_linenumber * 500 AS ts, row_number() OVER () AS r FROM lineitem WHERE l_linenumber * 500 < 2300 AND l_linenumber * 500 + 500 > 700),
         s AS (SELECT session_id, seq, q, r, i FROM c, (VALUES (0), (1), (2), (3)) AS n(i) WHERE i >= floor(greatest(700 - ts, 0) * 8 / 1000) AND i < floor((2300 - ts) * 8 / 1000))
    SELECT session_id, string_agg((q + i)::VARCHAR, ' ' ORDER BY seq, q, r, i) AS pcm FROM s GROUP BY 1""")
def _s14(spark, sf_dir):
    # Chunks of one number may repeat, so they are put in the order of their first sample too.
    rows = _tracks(spark, sf_dir, 4).withColumn("seq", F.struct("seq", F.col("pcm")[0].alias("q")))
    return audio.track_range(rows, ["session_id"], 700, 2300).select("session_id", _shown("pcm").alias("pcm")).where("pcm <> ''")


@query("s28_folder_bytes")
def _s28(spark, sf_dir):
    from parley.sources import files

    return files.folder_bytes(spark, sf_dir, "*.parquet")


@query("s28_audio_bytes", f"""
    WITH c AS (SELECT session_id::VARCHAR AS s, concat(session_id, '/', channel) AS f, duration_ms * rate // 1000 * 2 AS bytes FROM ({C.CHUNKS_SQL}))
    SELECT coalesce(f, s, '') AS folder, count(*) AS files, sum(bytes)::BIGINT AS bytes FROM c GROUP BY GROUPING SETS ((), (s), (s, f))""")
def _audio_bytes(spark, sf_dir):
    """Bytes below every folder of the chunks' raw files: all, a session's, a channel's."""
    from parley.sources import files

    rows = C.chunks(spark, sf_dir).select(F.concat_ws("/", "session_id", "channel", F.concat("seq", F.lit(".raw"))).alias("path"), F.expr("duration_ms * rate div 1000 * 2").alias("bytes"))
    return files.tree_bytes(rows)


@query("s19_glossary_csv", f"""
    WITH t AS (SELECT CASE WHEN id % 5 = 0 THEN concat('a "', surface, '", b') WHEN id % 11 = 0 THEN '' ELSE surface END AS surface, canonical, language, scope,
                      CASE WHEN id % 7 <> 0 THEN meeting_id END::VARCHAR AS meeting_id FROM ({C.TERMS_SQL})),
         g AS (SELECT *, surface <> '' AND (scope = 'global' OR meeting_id IS NOT NULL) AS good FROM t)
    SELECT surface, canonical, language, scope, meeting_id, NULL::BIGINT AS skipped FROM g WHERE good
    UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, count(*) FROM g WHERE NOT good""")
def _glossary_csv(spark, sf_dir):
    """Terms with quotes and commas, and bad ones, written as CSV and read back: the good ones, and the number of bad ones."""
    from parley.sources import files

    number = F.col("id")
    surface = F.when(number % 5 == 0, F.concat(F.lit('a "'), "surface", F.lit('", b'))).when(number % 11 == 0, "").otherwise(F.col("surface"))
    path = new_path(spark)
    files.write_glossary(C.terms(spark, sf_dir).withColumns({"surface": surface, "meeting_id": F.when(number % 7 != 0, F.col("meeting_id"))}), path)
    good, skipped = files.glossary_csv(spark, path)
    return good.withColumn("skipped", F.lit(None).cast("long")).unionByName(skipped, allowMissingColumns=True)


@query("s22_diagnostics", f"""
    SELECT ts_ms, kind, event_id % 1000 AS buffer_ms, concat('a "', kind, '"', chr(10), '{{b}} ', event_id) AS text FROM ({C.LEVELS_SQL}) WHERE kind IN ('click', 'purchase')""")
def _diagnostics(spark, sf_dir):
    """Events appended as JSON lines in two goes, broken lines between them, and read back by kind."""
    from parley.sources import files

    rows, path = C.levels(spark, sf_dir), new_path(spark)
    made = rows.select("ts_ms", "kind", (F.col("event_id") % 1000).alias("buffer_ms"), F.concat(F.lit('a "'), "kind", F.lit('"\n{b} '), "event_id").alias("text"), "event_id")
    files.append_diagnostics(made.where("event_id % 3 = 0"), path)
    rows.where("event_id % 50 = 0").select(F.concat(F.lit('{"ts_ms": '), "event_id", F.lit(', "kind": "click')).alias("value")).write.mode("append").text(path)
    files.append_diagnostics(made.where("event_id % 3 <> 0"), path)
    return files.diagnostics(spark, path, ["click", "purchase"])


@query("f13_power_log", f"""
    SELECT round(avg(level), 6) AS mean, count(*) AS rows FROM ({C.LEVELS_SQL}) WHERE event_id % 10 <> 0""")
def _power_log(spark, sf_dir):
    """Levels as a text table, with a header line for every tenth event, and the mean of its second field."""
    from parley.sources import files

    path = new_path(spark)
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("# sample "), "event_id")).otherwise(F.concat(F.lit("  "), "event_id", F.lit("   "), F.col("level").cast("string"), F.lit("  mW")))
    C.levels(spark, sf_dir).select(line.alias("value")).write.text(path)
    return files.power_log(spark, path, 1).select(F.round("mean", 6).alias("mean"), "rows")


@query("s30_replaced_partition", f"""
    WITH v AS ({C.VERSIONS_SQL}) SELECT meeting_id, version, body FROM v WHERE meeting_id % 2 = 1
    UNION ALL SELECT meeting_id, version, 'redone' FROM v WHERE meeting_id % 2 = 0 AND version = 1""")
def _s30(spark, sf_dir):
    old = C.versions(spark, sf_dir).select("meeting_id", "version", "body")
    new = old.where("meeting_id % 2 = 0 AND version = 1").withColumn("body", F.lit("redone"))
    stored = StoredTable.create(old, new_path(spark), ["meeting_id"])
    stored.replace(new, ["meeting_id"])
    return stored.rows()


@query("s34_point_update", f"SELECT id, CASE WHEN id = 1 THEN 'renamed' ELSE canonical END AS canonical FROM ({C.TERMS_SQL})")
def _s34(spark, sf_dir):
    stored = StoredTable.create(C.terms(spark, sf_dir), new_path(spark), ["id"])
    stored.update_one(F.col("id") == 1, {"canonical": F.lit("renamed")})
    return stored.rows().select("id", "canonical")


@query("s37_index_maintained", f"""
    WITH v AS ({C.VERSIONS_SQL}) SELECT meeting_id, version::VARCHAR AS ref_id, CASE WHEN version = 1 THEN 'new body' ELSE body END AS body FROM v""")
def _s37(spark, sf_dir):
    old = C.versions(spark, sf_dir).select("meeting_id", F.col("version").cast("string").alias("ref_id"), "body")
    return maintenance.upserted(old, old.where("ref_id = '1'").withColumn("body", F.lit("new body")), ["meeting_id", "ref_id"])


@query("s39_setting", "SELECT coalesce(max(n_regionkey::VARCHAR) FILTER (n_name = 'NATION_3'), 'none') AS value FROM nation")
def _s39(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return maintenance.setting(rows, "NATION_3", "none")


@query("s41_replayed_frames", f"""
    WITH t AS ({_TRACK_SQL}) SELECT session_id, frame::INTEGER AS frame, array_to_string(pcm[frame * 4 + 1 : frame * 4 + 4], ' ') AS pcm
    FROM t, generate_series(0, 200) AS g(frame) WHERE frame * 4 < len(pcm)""")
def _s41(spark, sf_dir):
    return audio.framed(audio.whole_track(_tracks(spark, sf_dir, 2), ["session_id"]), ["session_id"], 4).select("session_id", "frame", _shown("pcm").alias("pcm"))


# -- Filters and predicates -------------------------------------------------------------------------


@query("f1_final_captions", f"SELECT session_id, id, trim(text) AS text FROM ({C.CAPTIONS_SQL}) WHERE phase = 'final' AND trim(text) <> ''")
def _f1(spark, sf_dir):
    return C.captions(spark, sf_dir).where((F.col("phase") == "final") & (F.trim("text") != "")).select("session_id", "id", F.trim("text").alias("text"))


@query("f2_one_channel", f"SELECT meeting_id, idx FROM ({C.SEGMENTS_SQL}) WHERE channel = 'mic'")
def _f2(spark, sf_dir):
    return C.segments(spark, sf_dir).where("channel = 'mic'").select("meeting_id", "idx")


@query("f4_may_overwrite", f"SELECT id, source <> 'human' AS allowed FROM ({C.PRINTS_SQL})")
def _f4(spark, sf_dir):
    return C.prints(spark, sf_dir).select("id", S.may_overwrite(F.col("source"), "voiceprint").alias("allowed"))


@query("f14_clock_verdicts", "SELECT o_orderkey AS session_id, CASE o_orderkey % 3 WHEN 0 THEN 'common' WHEN 1 THEN 'separate' ELSE 'no session' END AS verdict FROM orders")
def _f14(spark, sf_dir):
    part = F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), S.clock_verdict(F.when(part < 2, part == 0)).alias("verdict"))


@query("j3_winning_edits", f"SELECT meeting_id, channel, start_ms, end_ms, id FROM ({C.EDITS_SQL}) QUALIFY row_number() OVER (PARTITION BY meeting_id, channel, start_ms, end_ms ORDER BY created_at_ms DESC, id DESC) = 1")
def _j3(spark, sf_dir):
    return edits.winners(C.edits(spark, sf_dir)).select("meeting_id", "channel", "start_ms", "end_ms", "id")


# -- Aggregations and reports -----------------------------------------------------------------------


@query("a3_channel_start", f"SELECT session_id, min(ts_ms) FILTER (channel = 'mic') AS mic_start FROM ({C.CHUNKS_SQL}) GROUP BY 1")
def _a3(spark, sf_dir):
    return C.chunks(spark, sf_dir).groupBy("session_id").agg(F.min(F.when(F.col("channel") == "mic", F.col("ts_ms"))).alias("mic_start"))


@query("a7_frequent_head", f"""
    WITH t AS (SELECT meeting_id, lower(unnest({TOKENS.format('text')})) AS key FROM ({C.SEGMENTS_SQL})), n AS (SELECT meeting_id, key, count(*) AS n FROM t WHERE length(key) >= 2 GROUP BY ALL)
    SELECT meeting_id, key FROM n QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY n DESC, key) <= 5""")
def _a7(spark, sf_dir):
    return glossary.frequent_head(glossary.token_counts(C.segments(spark, sf_dir), ["meeting_id"], examples=False), ["meeting_id"], 5)


_THRESHOLDS = [0.0, 0.05, 0.1, 0.2, 0.3]
_SWEEP_SQL = """SELECT threshold::DOUBLE AS threshold, count(*) FILTER (embedding[1]::DOUBLE >= threshold) AS pairs, count(*) FILTER (embedding[2]::DOUBLE >= threshold AND vec_id % 10 = 0) AS control
    FROM embeddings, (VALUES (0.0::DOUBLE), (0.05), (0.1), (0.2), (0.3)) AS t(threshold) GROUP BY 1"""


@query("a14_lowest_threshold", f"""
    WITH s AS ({_SWEEP_SQL}) SELECT CASE WHEN max(control) > 0 THEN min(threshold) FILTER (100 * control <= 5 * pairs) END AS few, CASE WHEN max(control) > 0 THEN min(threshold) FILTER (control = 0) END AS "none" FROM s""")
def _a14(spark, sf_dir):
    x = lambda i: F.col("embedding")[i].cast("double")
    rows = table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(_values(spark, "threshold", _THRESHOLDS)))
    sweep = rows.groupBy("threshold").agg(F.count_if(x(0) >= F.col("threshold")).alias("pairs"), F.count_if((x(1) >= F.col("threshold")) & (F.col("vec_id") % 10 == 0)).alias("control"))
    return reports.lowest_threshold(sweep)


@query("a17_rms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms FROM embeddings")
def _a17(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.rms(F.col("embedding")), 6).alias("rms"))


@query("a22_plateau", """
    WITH s AS (SELECT (event_id % 8)::DOUBLE / 10 AS threshold, round(avg(value) / 100, 4) AS accuracy FROM events GROUP BY 1),
         b AS (SELECT max(accuracy) AS best, min(threshold) AS low, max(threshold) AS high, count(*) AS n FROM s),
         k AS (SELECT best, low, high, n, list_sort(list(threshold))[(count(*) // 2 + 1)::INTEGER] AS middle, count(*) AS near FROM s, b WHERE accuracy >= best - 0.005 GROUP BY ALL)
    SELECT best, middle, CASE WHEN n < 3 THEN 'too short' WHEN near = n THEN 'stuck' WHEN middle IN (low, high) THEN 'at edge' ELSE 'plateau' END AS verdict FROM k""")
def _a22(spark, sf_dir):
    sweep = table(spark, sf_dir, "events").groupBy(((F.col("event_id") % 8).cast("double") / 10).alias("threshold")).agg(F.round(F.avg("value") / 100, 4).alias("accuracy"))
    return reports.plateau(sweep)


@query("a26_distinct_labels", f"SELECT meeting_id, count(DISTINCT speaker_id) AS labels, string_agg(DISTINCT speaker_id, ' ' ORDER BY speaker_id) AS names FROM ({C.SEGMENTS_SQL}) GROUP BY 1")
def _a26(spark, sf_dir):
    per = C.segments(spark, sf_dir).groupBy("meeting_id")
    return per.agg(F.count_distinct("speaker_id").alias("labels"), F.array_join(F.sort_array(F.collect_set("speaker_id")), " ").alias("names"))


@query("a32_gap_verdict", """
    WITH m AS (SELECT conv_id AS k, list_sort(list(length(text)) FILTER (turn % 2 = 0))  AS a, list_sort(list(length(text)) FILTER (turn % 2 = 1)) AS b FROM conversations GROUP BY 1),
         v AS (SELECT k, a[(len(a) // 2 + 1)::INTEGER] AS a, b[(len(b) // 2 + 1)::INTEGER] AS b FROM m)
    SELECT k AS conv_id, CASE WHEN a IS NULL OR b IS NULL THEN 'nothing' WHEN a / 1000::DOUBLE - b / 1000::DOUBLE < 0.15::DOUBLE THEN 'blurred' ELSE 'clear' END AS verdict FROM v""")
def _a32(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") / 1000).alias("similarity"))
    return reports.gap_verdict(rows.where("turn % 2 = 0"), rows.where("turn % 2 = 1"), ["conv_id"]).select("conv_id", "verdict")


@query("a33_two_sided_errors", f"""
    WITH w AS (SELECT CASE WHEN kind = 'click' THEN 'owner' ELSE 'others' END AS kind, (event_id % 100)::DOUBLE / 100 AS explained, level FROM ({C.LEVELS_SQL}) WHERE level >= 120)
    SELECT threshold, round(coalesce(avg(CASE WHEN kind = 'owner' THEN (explained >= threshold)::INTEGER END), 0), 9) AS owner_eaten, round(coalesce(avg(CASE WHEN kind = 'others' THEN (explained < threshold)::INTEGER END), 0), 9) AS others_missed
    FROM w, (VALUES (0.2::DOUBLE), (0.4), (0.6), (0.8)) AS t(threshold) GROUP BY 1""")
def _a33(spark, sf_dir):
    kind = F.when(F.col("kind") == "click", "owner").otherwise("others").alias("kind")
    windows = C.levels(spark, sf_dir).select(kind, ((F.col("event_id") % 100).cast("double") / 100).alias("explained"), F.col("level").alias("reference_rms"))
    return reports.two_sided_errors(windows, [0.2, 0.4, 0.6, 0.8]).select("threshold", F.round("owner_eaten", 9).alias("owner_eaten"), F.round("others_missed", 9).alias("others_missed"))


@query("a35_cluster_sweep", agreement_sql(f"""
    SELECT a.meeting_id, parts, a.speaker_id, b.idx % parts AS cluster, sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms))::BIGINT AS ms
    FROM ({C.SEGMENTS_SQL}) a JOIN ({C.SEGMENTS_SQL}) b ON a.meeting_id = b.meeting_id AND a.speaker_id <> '' AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms, (VALUES (2), (3), (4)) AS v(parts) GROUP BY ALL""", "meeting_id, parts"))
def _a35(spark, sf_dir):
    rows = C.segments(spark, sf_dir).withColumn("parts", F.explode(F.array(*map(F.lit, (2, 3, 4)))))
    cells = intervals.overlap_matrix(rows.where("speaker_id <> ''"), rows.withColumn("cluster", F.col("idx") % F.col("parts")), ["meeting_id", "parts"])
    return reports.agreement(cells, ["meeting_id", "parts"])


# -- Windows and order ------------------------------------------------------------------------------


@query("w8_smoothed", f"""
    WITH o AS (SELECT session_id, level, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) AS i, count(*) OVER (PARTITION BY session_id) AS n FROM ({C.LEVELS_SQL}))
    SELECT session_id, round(sum(0.25 * pow(0.75, n - i) * level) + pow(0.75, max(n)), 4) AS gain FROM o GROUP BY 1""")
def _w8(spark, sf_dir):
    rows = signal.smoothed(C.levels(spark, sf_dir).select("session_id", "ts_ms", "event_id", "level"), ["session_id"], ["ts_ms", "event_id"], "level")
    return rows.groupBy("session_id").agg(F.round(F.max_by("gain", F.struct("ts_ms", "event_id")), 4).alias("gain"))


_PLACED_SQL = f"SELECT session_id % 3 AS session_id, row_number() OVER (PARTITION BY session_id % 3 ORDER BY ts_ms, event_id) - 1 AS i, floor(level)::DOUBLE AS level, event_id FROM ({C.LEVELS_SQL}) WHERE level IS NOT NULL"


def _placed(spark, sf_dir):
    """Events as three long tracks of one sample each."""
    rows = C.levels(spark, sf_dir).where("level is not null").select((F.col("session_id") % 3).alias("session_id"), "ts_ms", "event_id", F.floor("level").cast("double").alias("level"))
    return ordered.numbered(rows, ["session_id"], ["ts_ms", "event_id"], "_n").select("session_id", (F.col("_n") - 1).alias("i"), "level", "event_id")


def _in_chunks(rows, size, **columns):
    """Samples in rows of ``size``, with their number as seq and first place as start."""
    inside = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("i", c.alias("x")))), lambda s: s["x"])  # noqa: E731  of ``size`` samples
    return rows.groupBy("session_id", F.floor(F.col("i") / size).alias("seq")).agg(F.min("i").alias("start"), *(inside(c).alias(n) for n, c in columns.items()))


@query("s35_resampled", f"""
    WITH t AS ({_PLACED_SQL}), o AS (SELECT session_id, unnest(generate_series(0, (count(*) * 2 + 2) // 3 - 1)) AS n FROM t GROUP BY 1),
         w AS (SELECT o.session_id, n, level, i - n * 1.5::DOUBLE AS d FROM o JOIN t ON t.session_id = o.session_id AND i BETWEEN n * 3 // 2 - 8 AND n * 3 // 2 + 9)
    SELECT session_id, n, round(coalesce(sum(CASE WHEN abs(d) >= 8 THEN 0 ELSE level * CASE WHEN abs(d) < 1e-12 THEN 2::DOUBLE / 3 ELSE sin(pi() * 2 / 3 * d) / (pi() * d) END * (0.5::DOUBLE + 0.5::DOUBLE * cos(pi() * d / 8)) END), 0), 5) AS sample FROM w GROUP BY ALL""")
def _s35(spark, sf_dir):
    chunks = _in_chunks(_placed(spark, sf_dir), 50, samples=F.col("level"))
    made = audio.resampled(chunks, ["session_id"], 3, 2, 1, 4)
    return made.select("session_id", "first", F.posexplode("pcm").alias("at", "x")).select("session_id", (F.col("first") + F.col("at")).alias("n"), F.round("x", 5).alias("sample"))


@query("g14_echo_windows")
def _g14(spark, sf_dir):
    """A microphone that hears half of the system channel seven samples later, and a voice of its own in every other stretch of 200."""
    rows = _placed(spark, sf_dir).withColumn("system", F.col("level") - 1000)
    late = rows.select("session_id", (F.col("i") + 7).alias("i"), (F.col("system") / 2).alias("_late"))
    voice = F.when(F.floor(F.col("i") / 200) % 2 == 1, (F.col("event_id") * 7919 % 1009 - 504) * 2.0).otherwise(0.0)
    both = rows.join(late, ["session_id", "i"], "left").withColumn("mic", F.coalesce("_late", F.lit(0.0)) + voice)
    frames = _in_chunks(both, 100, mic=F.col("mic"), system=F.col("system"))
    rules = audio.EchoRules(rate=1000, window_ms=50, max_delay_ms=40, probe_ms=160, guard_ms=3, taps=24)
    return audio.echo_windows(frames, ["session_id"], rules)


@query("w11_loudest_windows", f"""
    WITH l AS (SELECT session_id, level, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, event_id) - 1 AS pos FROM ({C.LEVELS_SQL})),
         s AS (SELECT session_id, pos, sqrt(sum(level * level) OVER w / 4) AS rms, count(*) OVER w AS n FROM l WINDOW w AS (PARTITION BY session_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 3 FOLLOWING)),
         c AS (SELECT session_id, pos, rms FROM s WHERE n = 4),
         a1 AS (SELECT session_id, first(pos ORDER BY rms DESC, pos) AS pos FROM c GROUP BY 1), c1 AS (SELECT c.* FROM c JOIN a1 ON a1.session_id = c.session_id AND abs(c.pos - a1.pos) >= 4),
         a2 AS (SELECT session_id, first(pos ORDER BY rms DESC, pos) AS pos FROM c1 GROUP BY 1), c2 AS (SELECT c1.* FROM c1 JOIN a2 ON a2.session_id = c1.session_id AND abs(c1.pos - a2.pos) >= 4),
         a3 AS (SELECT session_id, first(pos ORDER BY rms DESC, pos) AS pos FROM c2 GROUP BY 1)
    SELECT session_id, pos::INTEGER AS "at", round(rms, 6) AS rms FROM c JOIN (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3) USING (session_id, pos)""")
def _w11(spark, sf_dir):
    place = (F.row_number().over(Window.partitionBy("session_id").orderBy("ts_ms", "event_id")) - 1).cast("int").alias("at")
    return audio.loudest_windows(C.levels(spark, sf_dir).select("session_id", place, "level"), ["session_id"], 4).select("session_id", "at", F.round("rms", 6).alias("rms"))


@query("t9_buffer_starts", f"""
    SELECT session_id, id, greatest(0, max(greatest(CASE WHEN phase = 'final' THEN created_at_ms - 200 ELSE 0 END, created_at_ms - 3000)) OVER (PARTITION BY session_id ORDER BY created_at_ms, id ROWS UNBOUNDED PRECEDING)) AS start_ms FROM ({C.CAPTIONS_SQL})""")
def _t9(spark, sf_dir):
    rows = C.captions(spark, sf_dir).select("session_id", "id", F.col("created_at_ms").alias("now_ms"), F.when(F.col("phase") == "final", F.col("created_at_ms")).alias("until_ms"))
    return signal.buffer_starts(rows, ["session_id"], "id", 200, 3000).select("session_id", "id", "start_ms")


@query("o4_newest_first", "SELECT c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 7 DESC, c_custkey) AS position FROM customer")
def _o4(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _position(["c_nationkey"], F.desc(F.col("c_custkey") % 7), "c_custkey"))


@query("o6_longest_first", f"SELECT language, id, row_number() OVER (PARTITION BY language ORDER BY length(surface) DESC, surface, id) AS position FROM ({C.TERMS_SQL})")
def _o6(spark, sf_dir):
    return C.terms(spark, sf_dir).select("language", "id", _position(["language"], F.desc(F.length("surface")), "surface", "id"))


@query("o8_both_channels", f"SELECT meeting_id, idx FROM ({C.SEGMENTS_SQL}) WHERE channel = 'mic' UNION ALL SELECT meeting_id, idx FROM ({C.SEGMENTS_SQL}) WHERE channel = 'system'")
def _o8(spark, sf_dir):
    rows = C.segments(spark, sf_dir)
    return rows.where("channel = 'mic'").unionByName(rows.where("channel = 'system'")).select("meeting_id", "idx")


# -- Scalar functions -------------------------------------------------------------------------------


@query("x2_tokens", f"SELECT conv_id, turn, array_to_string({TOKENS.format('text')}, ' ') AS tokens FROM conversations")
def _x2(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query("x3_bare_words", r"""
    WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM conversations)
    SELECT conv_id, turn, array_to_string(list_transform(w, lambda x: lower(regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))), ' ') AS bare FROM w""")
def _x3(spark, sf_dir):
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(words, T.bare), " ").alias("bare"))


@query("x4_word_similarity", f"""
    WITH w AS (SELECT conv_id, turn, ({WORDS})[1:400] AS w FROM conversations),
         p AS (SELECT a.conv_id, a.turn, a.w AS a, b.w AS b, list_intersect(a.w, b.w) AS k FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
         c AS (SELECT *, array_to_string(list_transform(a, lambda x: chr((CASE WHEN coalesce(list_position(k, x), 0) = 0 THEN 33 ELSE 34 + list_position(k, x) END)::INTEGER)), '') AS ca,
                      array_to_string(list_transform(b, lambda x: chr((CASE WHEN coalesce(list_position(k, x), 0) = 0 THEN 34 ELSE 34 + list_position(k, x) END)::INTEGER)), '') AS cb FROM p)
    SELECT conv_id, turn, round(CASE WHEN len(k) = 0 THEN 0.0::DOUBLE ELSE 1 - levenshtein(ca, cb)::DOUBLE / greatest(len(a), len(b)) END, 9) AS similarity FROM c""")
def _x4(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("a"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.word_similarity(F.col("a"), F.col("b")), 9).alias("similarity"))


@query("x5_plain", r"SELECT conv_id, turn, trim(regexp_replace(lower(regexp_replace(text, '[^\p{L}\p{N}\s]', ' ', 'g')), '\s+', ' ', 'g')) AS plain FROM conversations")
def _x5(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.plain(F.col("text")).alias("plain"))


@query("x7_gaps", f"SELECT a.meeting_id, a.idx, greatest(0, a.start_ms - b.end_ms, b.start_ms - a.end_ms)::BIGINT AS gap FROM ({C.SEGMENTS_SQL}) a JOIN ({C.SEGMENTS_SQL}) b ON a.meeting_id = b.meeting_id AND b.idx = a.idx + 1")
def _x7(spark, sf_dir):
    rows = C.segments(spark, sf_dir).select("meeting_id", "idx", "start_ms", "end_ms")
    after = rows.select("meeting_id", (F.col("idx") - 1).alias("idx"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    return rows.join(after, ["meeting_id", "idx"]).select("meeting_id", "idx", S.gap_ms(F.col("start_ms"), F.col("end_ms"), F.col("s"), F.col("e")).alias("gap"))


@query("x8_durations", f"SELECT meeting_id, idx, CASE WHEN idx % 3 > 0 THEN greatest(end_ms - start_ms, 0) END AS ms FROM ({C.SEGMENTS_SQL})")
def _x8(spark, sf_dir):
    return C.segments(spark, sf_dir).select("meeting_id", "idx", S.duration_ms(F.col("start_ms"), F.when(F.col("idx") % 3 > 0, F.col("end_ms"))).alias("ms"))


@query("x11_sentence_ends", r"SELECT conv_id, turn, regexp_matches(text, '[.!?…]\s*$') AS ends FROM conversations")
def _x11(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.ends_sentence(F.col("text")).alias("ends"))


@query("x12_token_kinds", f"""
    WITH t AS (SELECT DISTINCT unnest({TOKENS.format('text')}) AS token FROM documents)
    SELECT token, regexp_matches(token, '[A-Za-z]') AND NOT regexp_matches(regexp_replace(token, '[A-Za-z]', '', 'g'), '\\p{{L}}') AS latin,
           length(regexp_replace(token, '[^\\p{{L}}]', '', 'g')) >= 2 AND regexp_full_match(regexp_replace(token, '[^\\p{{L}}]', '', 'g'), '\\p{{Lu}}+') AS acronym FROM t""")
def _x12(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", T.is_latin(F.col("token")).alias("latin"), T.is_acronym(F.col("token")).alias("acronym"))


@query("x14_shortened", "SELECT conv_id, turn, substr(text, 1, 20) AS short FROM conversations")
def _x14(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.shortened(F.col("text"), 20).alias("short"))


@query("x15_paragraphs", r"""
    WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents)
    SELECT doc_id, len(p)::INTEGER AS paragraphs, len(list_filter(p, lambda x: contains(lower(x), 'license')))::INTEGER AS cued FROM p WHERE p IS NOT NULL""")
def _x15(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.paragraphs(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("paragraphs"), F.size(F.filter("p", lambda x: T.has_cue(x, ["license"]))).alias("cued"))


@query("x16_numbered_lines", f"""
    WITH w AS (SELECT conv_id, turn, ({WORDS}) AS w FROM conversations)
    SELECT conv_id, turn, array_to_string(list_transform(w, lambda x, i: concat(i, '. ', x)), chr(10)) AS batch, array_to_string(w, ' ') AS parsed FROM w WHERE len(w) > 0""")
def _x16(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("batch", T.numbered(F.col("w")))
    return rows.select("conv_id", "turn", "batch", F.array_join(T.parse_numbered(F.col("batch"), F.size("w")), " ").alias("parsed"))


@query("x17_json_objects", """SELECT conv_id, turn, concat('{"conv_id":', conv_id, ',"role":"', role, '"}') AS json FROM conversations""")
def _x17(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("conv_id", "role")).alias("json"))


@query("x18_json_fields", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _x18(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("x20_pcm", "SELECT vec_id, list_sum(list_transform(embedding, lambda v: greatest(-32768, least(32767, round(v::DOUBLE * 32767)))))::BIGINT AS total FROM embeddings")
def _x20(spark, sf_dir):
    pcm = S.pcm16(F.transform("embedding", lambda v: v.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(pcm, F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))


@query("x22_frames", f"SELECT session_id, seq, channel, duration_ms, floor(ts_ms * 16000 / 1000)::BIGINT AS frame, floor(seq * 1000 / 7)::BIGINT AS ms FROM ({C.CHUNKS_SQL})")
def _x22(spark, sf_dir):
    return C.chunks(spark, sf_dir).select("session_id", "seq", "channel", "duration_ms", S.frame_of(F.col("ts_ms"), F.lit(16000)).alias("frame"), S.ms_of(F.col("seq"), F.lit(7)).alias("ms"))


@query("x23_ticks", "SELECT o_orderkey AS id, floor((o_orderkey * 1000003) * 125 / 3 / 1000000)::BIGINT AS ms FROM orders")
def _x23(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.ticks_to_ms(F.col("o_orderkey") * 1000003, 125, 3).alias("ms"))


@query("x24_channel_ids", f"SELECT meeting_id, idx, concat(meeting_id, ':', channel) AS speaker FROM ({C.SEGMENTS_SQL})")
def _x24(spark, sf_dir):
    return C.segments(spark, sf_dir).select("meeting_id", "idx", S.channel_speaker(F.col("meeting_id"), F.col("channel")).alias("speaker"))


@query("x25_folded", "SELECT p_partkey AS id, lower(trim(p_type)) AS folded, coalesce(CASE WHEN p_size > 25 THEN p_brand END, '') AS brand FROM part")
def _x25(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(F.trim("p_type")).alias("folded"), F.coalesce(F.when(F.col("p_size") > 25, F.col("p_brand")), F.lit("")).alias("brand"))


_HIT = f"(starts_with(regexp_replace(translate(lower(x), '{search.MARKED}', '{search.PLAIN}'), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 'the') OR starts_with(regexp_replace(translate(lower(x), '{search.MARKED}', '{search.PLAIN}'), '[^\\p{{L}}\\p{{N}}]', '', 'g'), 'tion'))"


@query("x27_snippets", f"""
    WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM conversations),
         f AS (SELECT *, greatest(coalesce(list_position(list_transform(w, lambda x: {_HIT}), true), 0), 1) AS first FROM w)
    SELECT conv_id, turn, concat(CASE WHEN first > 1 THEN '…' ELSE '' END, array_to_string(list_transform(w[first:first + 11], lambda x: CASE WHEN {_HIT} THEN concat('[', x, ']') ELSE x END), ' '), CASE WHEN len(w) > first + 11 THEN '…' ELSE '' END) AS snippet FROM f""")
def _x27(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", search.snippet(F.col("text"), "the tion").alias("snippet"))


@query("x29_sub_words", """
    WITH p AS (SELECT conv_id, turn AS pos, CASE WHEN turn % 2 = 0 THEN ' ' || lower(substr(role, 1, 3)) ELSE lower(substr(role, 3, 2)) END AS piece, turn * 100 AS end_ms FROM conversations),
         s AS (SELECT *, sum(CASE WHEN piece LIKE ' %' OR n = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS word FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS n FROM p WHERE trim(piece) <> ''))
    SELECT conv_id, word::BIGINT AS word, trim(string_agg(piece, '' ORDER BY pos)) AS text, arg_max(end_ms, pos) AS end_ms FROM s GROUP BY ALL""")
def _x29(spark, sf_dir):
    piece = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), F.lower(F.substring("role", 1, 3)))).otherwise(F.lower(F.substring("role", 3, 2)))
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("at"), piece.alias("piece"), (F.col("turn") * 100).alias("end_ms"))
    return signal.sub_words(rows, ["conv_id"])


@query("x30_padded", "SELECT conv_id, turn, concat(repeat('0 ', (turn % 4)::INTEGER), turn) AS pcm FROM conversations")
def _x30(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", _shown(S.padded(F.array(F.col("turn").cast("short")), F.col("turn") % 4)).alias("pcm"))


@query("x31_collapse_notes", f"""
    WITH {twins_sql(C.SEGMENTS_SQL)}, {report_sql(C.SEGMENTS_SQL, 0.02)}
    SELECT meeting_id, CASE WHEN collapsed > 0 THEN concat('Wiederholungen entfernt: ', collapsed, CASE WHEN kept_short > 0 THEN concat(', kurze behalten: ', kept_short) ELSE '' END) ELSE '' END AS note FROM report""")
def _x31(spark, sf_dir):
    report = transcripts.collapse_report(C.segments(spark, sf_dir), 0.02)
    return report.select("meeting_id", briefs.collapse_note(report, "de").alias("note"))


@query("x32_rebuild_notes", f"SELECT meeting_id, version, concat('rebuilt from ', CASE WHEN version % 2 = 0 THEN 'audio' ELSE 'captions' END, ', version ', version) AS note FROM ({C.VERSIONS_SQL})")
def _x32(spark, sf_dir):
    source = F.when(F.col("version") % 2 == 0, "audio").otherwise("captions")
    return C.versions(spark, sf_dir).select("meeting_id", "version", briefs.rebuild_note(source, F.col("version")).alias("note"))


# -- Compound operators and flows -------------------------------------------------------------------


SQL["g10_assembled"] = rf"""
    WITH c AS (SELECT session_id, id, created_at_ms, trim(text) AS text FROM ({C.CAPTIONS_SQL}) WHERE phase = 'final' AND trim(text) <> ''),
         n AS (SELECT *, lead(id) OVER (PARTITION BY session_id ORDER BY created_at_ms, id) AS next FROM c)
    SELECT session_id, string_agg(text || CASE WHEN next IS NULL THEN '' WHEN regexp_matches(text, '[.!?…]\s*$') THEN chr(10) || chr(10) ELSE ' ' END, '' ORDER BY created_at_ms, id) AS body FROM n GROUP BY 1"""


@query("g7_planned_edits", f"""
    WITH e AS (SELECT * REPLACE (CASE WHEN k.t IS NOT NULL AND e.id % 5 = 0 THEN k.t ELSE edited_text END AS edited_text), k.t FROM ({C.EDITS_SQL}) e LEFT JOIN (SELECT meeting_id AS m, channel AS c, start_ms AS s, end_ms AS x, text AS t FROM ({C.SEGMENTS_SQL})) k ON m = meeting_id AND c = channel AND s = start_ms AND x = end_ms)
    SELECT id, CASE WHEN t IS NULL THEN 'homeless' WHEN row_number() OVER (PARTITION BY meeting_id, channel, start_ms, end_ms ORDER BY created_at_ms DESC, id DESC) > 1 THEN 'obsolete' WHEN edited_text = t THEN 'delete' ELSE 'keep' END AS action FROM e""")
def _g7(spark, sf_dir):
    place = ["meeting_id", "channel", "start_ms", "end_ms"]
    rows = C.segments(spark, sf_dir)
    changed = C.edits(spark, sf_dir).join(rows.select(*place, "text"), place, "left").withColumn("edited_text", F.when((F.col("id") % 5 == 0) & F.col("text").isNotNull(), F.col("text")).otherwise(F.col("edited_text"))).drop("text")
    return flows.planned_edits(changed, rows).select("id", "action")


@query("g7_promoted_hints", f"""
    WITH t AS ({C.TERMS_SQL}), u AS (SELECT p_partkey AS term_id, count(DISTINCT l_orderkey % 3) AS m FROM part JOIN lineitem ON l_partkey = p_partkey AND l_linenumber = 1 GROUP BY 1)
    SELECT id, CASE WHEN kind <> 1 AND m > 1 THEN 'global' ELSE scope END AS scope FROM t LEFT JOIN u ON term_id = id""")
def _g7_hints(spark, sf_dir):
    uses = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("term_id"), (F.col("l_orderkey") % 3).alias("meeting_id"))
    return flows.promoted_hints(C.terms(spark, sf_dir), uses).select("id", "scope")


@query("g13_remembered_voices", f"""
    WITH {CENTROID}, s AS (SELECT e.vec_id AS id, p.speaker_id, list_cosine_similarity(e.embedding::DOUBLE[], p.v) AS similarity FROM embeddings e, p WHERE e.vec_id % 5 = 1 AND e.vec_id % 2 = substr(p.speaker_id, 2)::INTEGER % 2),
         r AS (SELECT *, lead(similarity) OVER (PARTITION BY id ORDER BY similarity DESC, speaker_id) AS following, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, speaker_id) AS n FROM s)
    SELECT id, speaker_id, round(similarity, 6) AS similarity FROM r WHERE n = 1 AND similarity >= 0.1 AND similarity - coalesce(following, -1) >= 0.01""")
def _g13(spark, sf_dir):
    rows = C.prints(spark, sf_dir)
    voices = vectors.centroids(rows.where("source = 'human'")).withColumn("model_id", F.substring("speaker_id", 2, 9).cast("long") % 2)
    trials = rows.withColumns({"source": F.when(F.col("source") == "voiceprint", "none").otherwise(F.col("source")), "model_id": F.col("id") % 2})
    return vectors.remembered(trials, voices, 0.1, 0.01).select("id", "speaker_id", F.round("similarity", 6).alias("similarity"))


@query("g19_step_breakdown", """
    WITH l AS (SELECT l_orderkey AS session_id, l_returnflag AS parent, CASE WHEN l_linenumber > 1 THEN concat('step ', l_linenumber) END AS step, l_quantity::BIGINT AS ms FROM lineitem),
         w AS (SELECT session_id, parent, sum(ms)::BIGINT AS whole FROM l WHERE step IS NULL GROUP BY ALL), p AS (SELECT session_id, parent, step, sum(ms)::BIGINT AS ms FROM l WHERE step IS NOT NULL GROUP BY ALL)
    SELECT session_id, parent, step, ms, whole, 4 * ms >= whole AS heavy FROM p JOIN w USING (session_id, parent)""")
def _g19(spark, sf_dir):
    step = F.when(F.col("l_linenumber") > 1, F.concat(F.lit("step "), F.col("l_linenumber")))
    return briefs.step_breakdown(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("parent"), step.alias("step"), F.col("l_quantity").cast("long").alias("ms")))


@query("g21_translated", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN n_name WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS translation FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def _g21(spark, sf_dir):
    names = table(spark, sf_dir, "nation")
    known = names.where("n_nationkey % 2 = 0").select(F.lit("en").alias("source"), F.lit("de").alias("target"), F.col("n_name").alias("text"), F.lower("n_name").alias("translation"))
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(names), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("text"), F.when(F.col("s_suppkey") % 4 == 0, "de").otherwise("en").alias("language"))
    return briefs.translated(rows, known, "en", "de").select("id", "translation")


@query("g22_changed_bodies", f"SELECT meeting_id, version, 'changed' AS body FROM ({C.VERSIONS_SQL}) WHERE meeting_id % 4 = 0")
def _g22(spark, sf_dir):
    old = C.versions(spark, sf_dir).select("meeting_id", "version", "body")
    return briefs.changed_only(old, old.withColumn("body", F.when(F.col("meeting_id") % 4 == 0, "changed").otherwise(F.col("body"))))


@query("g25_live_against_final")
def _g25(spark, sf_dir):
    rows = C.captions(spark, sf_dir)
    return diff.live_against_final(rows, transcripts.assembled(rows.where("id % 4 = 1")))


@query("g27_stored_finals", f"SELECT session_id AS meeting_id, coalesce(v, 0) + 1 AS version, body FROM ({SQL['g10_assembled']}) LEFT JOIN (SELECT meeting_id, max(version) AS v FROM ({C.VERSIONS_SQL}) GROUP BY 1) ON meeting_id = session_id")
def _g27(spark, sf_dir):
    return flows.stored_finals(transcripts.assembled(C.captions(spark, sf_dir)).withColumnRenamed("session_id", "meeting_id"), C.versions(spark, sf_dir))


@query("g29_named_segments", f"""
    WITH e AS ({C.EDITS_SQL}), w AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY meeting_id, channel, start_ms, end_ms ORDER BY created_at_ms DESC, id DESC) = 1)
    SELECT s.meeting_id, s.idx, coalesce(w.edited_text, s.text) AS text, CASE s.speaker_id WHEN 'user' THEN 'You' WHEN 'assistant' THEN 'Helper' ELSE '' END AS name
    FROM ({C.SEGMENTS_SQL}) s LEFT JOIN w USING (meeting_id, channel, start_ms, end_ms)""")
def _g29(spark, sf_dir):
    names = spark.createDataFrame([("user", "You"), ("assistant", "Helper")], "speaker_id string, name string")
    return flows.named_segments(C.segments(spark, sf_dir), C.edits(spark, sf_dir), F.broadcast(names)).select("meeting_id", "idx", "text", "name")


# -- Batch twins of the streams ---------------------------------------------------------------------


@query("t1_slot_levels", f"""
    SELECT session_id, (ts_ms // 100 * 100)::BIGINT AS start_ms, max(CASE WHEN kind = 'click' THEN floor(level) ELSE 0 END)::DOUBLE AS mic, max(CASE WHEN kind <> 'click' THEN floor(level) ELSE 0 END)::DOUBLE AS system, count(*) AS samples FROM ({C.LEVELS_SQL}) GROUP BY ALL""")
def _t1(spark, sf_dir):
    rows = C.levels(spark, sf_dir).select("session_id", F.timestamp_millis("ts_ms").alias("ts"), F.when(F.col("kind") == "click", "mic").otherwise("system").alias("channel"), F.array(F.floor("level").cast("int")).alias("pcm"))
    return slots.windowed(rows).select("session_id", F.unix_millis("start").alias("start_ms"), "mic", "system", "samples")


@query("t6_speech_sessions", f"""
    WITH l AS (SELECT session_id, ts_ms, level, lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms) AS p FROM ({C.LEVELS_SQL}) WHERE level >= 200),
         i AS (SELECT *, sum(CASE WHEN p IS NULL OR ts_ms - p > 7200000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms) AS k FROM l)
    SELECT session_id, min(ts_ms) AS start_ms, max(ts_ms) + 7200000 AS end_ms, count(*) AS frames, max(level) AS peak FROM i GROUP BY session_id, k""")
def _t6(spark, sf_dir):
    rows = C.levels(spark, sf_dir).withColumn("ts", F.timestamp_millis("ts_ms"))
    return slots.sessions(rows, "2 hours").select("session_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("end").alias("end_ms"), "frames", "peak")


@query("t15_correlated_answers", "SELECT event_id AS id, event_type AS phase, concat('c', user_id % 2) AS channel FROM events WHERE event_id % 60 <= 30")
def _t15(spark, sf_dir):
    rows = C.levels(spark, sf_dir).select(F.col("event_id").alias("id"), F.timestamp_millis("ts_ms").alias("ts"), F.col("kind").alias("phase"), F.concat(F.lit("c"), F.col("session_id") % 2).alias("channel"))
    answers = rows.select("id", F.timestamp_millis(F.unix_millis("ts") + F.col("id") % 60 * 1000).alias("ts"))
    return slots.correlated(rows, answers).select("id", "phase", "channel")


_ISLANDS = f"""
    i AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts_ms, level, event_id ROWS UNBOUNDED PRECEDING) AS part FROM (
            SELECT *, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms, level, event_id) > 7200000 THEN 1 ELSE 0 END AS new FROM ({C.LEVELS_SQL}) WHERE level IS NOT NULL)),
    f AS (SELECT *, row_number() OVER (PARTITION BY session_id, part ORDER BY ts_ms, level, event_id) AS n FROM i)"""


@query("t5_streamed_gate", f"""
    WITH RECURSIVE {_ISLANDS},
    g AS (SELECT session_id, part, n, ts_ms, level, level > greatest(level * 3, 120) AS accepted, level AS floor FROM f WHERE n = 1
          UNION ALL SELECT f.session_id, f.part, f.n, f.ts_ms, f.level, f.level > greatest(g.floor * 3, 120),
                           CASE WHEN f.level > greatest(g.floor * 3, 120) THEN least(g.floor, f.level) ELSE g.floor + (f.level - g.floor) * CASE WHEN f.level < g.floor THEN 0.25::DOUBLE ELSE 0.02::DOUBLE END END
          FROM g JOIN f ON f.session_id = g.session_id AND f.part = g.part AND f.n = g.n + 1)
    SELECT session_id::VARCHAR AS session_id, ts_ms, level, accepted, floor FROM g""")
def _t5_stream(spark, sf_dir):
    """The table of events as a stream: the gate's state begins anew after two silent hours."""
    rows = stream(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), "event_id", (F.col("value") * 20).alias("level")).where("level is not null")
    return slots.drained(slots.stateful(rows, slots.gate_step, slots.GATED, ["ts_ms", "level", "event_id"], None, 7_200_000, "30 days"))


@query("t3_mixed_slots")
def _t3(spark, sf_dir):
    channel = F.when(F.col("kind") == "click", "mic").otherwise("system").alias("channel")
    frames = C.levels(spark, sf_dir).where("level is not null").select(F.col("session_id").cast("string").alias("session_id"), F.col("event_id").alias("seq"), channel, (F.col("event_id") % 977 * 10).alias("ts_ms"), F.array(F.floor("level").cast("int")).alias("pcm"))
    return slots.batch(frames, slots.mix_step, slots.MIXED, ["seq"], slots.mix_flush)


@query("t8_agreed_words")
def _t8(spark, sf_dir):
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("text"), ((i + 1) * 100).cast("long").alias("end_ms")))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("iteration"), words.alias("words"))
    return signal.agreed(rows, ["session_id"], ["iteration"]).select("session_id", "iteration", "committed", "pending", "until_ms")


@query("t10_held_texts")
def _t10(spark, sf_dir):
    text = F.col("text")
    rows = C.captions(spark, sf_dir).select(F.col("session_id").cast("string").alias("session_id"), "id", "text", T.may_become_hallucination(text).alias("hold"), T.is_hallucination(text).alias("drop"))
    return slots.batch(rows, slots.hold_step, "session_id string, id long, text string", ["id"])


@query("t11_attributed_events", f"""
    WITH r AS (SELECT session_id::VARCHAR AS session_id, event_id AS id, kind = 'click' AS final, event_id % 3 = 0 AS mic FROM ({C.LEVELS_SQL})),
         g AS (SELECT *, coalesce(sum(final::INTEGER) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM r),
         n AS (SELECT *, count(*) FILTER (NOT final AND mic) OVER (PARTITION BY session_id, part) AS mics, count(*) FILTER (NOT final AND NOT mic) OVER (PARTITION BY session_id, part) AS systems FROM g)
    SELECT session_id, id, CASE WHEN systems > mics THEN 'system' ELSE 'mic' END AS channel FROM n WHERE final""")
def _t11(spark, sf_dir):
    kind = F.when(F.col("kind") == "click", "final").otherwise("frame").alias("kind")
    rows = C.levels(spark, sf_dir).select(F.col("session_id").cast("string").alias("session_id"), F.col("event_id").alias("id"), kind, F.when(F.col("event_id") % 3 == 0, "mic").otherwise("system").alias("channel"))
    return slots.batch(rows, slots.attribute_step, "session_id string, id long, channel string", ["id"])


@query("t16_bounded_diagnostics", f"SELECT session_id, event_id FROM ({C.LEVELS_SQL}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY event_id) <= 4")
def _t16(spark, sf_dir):
    return signal.bounded(C.levels(spark, sf_dir), ["session_id"], "event_id", 4).select("session_id", "event_id")


@query("t17_due_captions", f"SELECT session_id, id FROM ({C.CAPTIONS_SQL}) WHERE created_at_ms > 1000 AND created_at_ms <= 4000")
def _t17(spark, sf_dir):
    return signal.due(C.captions(spark, sf_dir), "created_at_ms", 1000, 4000).select("session_id", "id")
