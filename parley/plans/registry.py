"""All queries over the operators of this library, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions import scalars as S
from parley.functions import text as T
from parley.operators import briefs, diff, edits, flows, glossary, intervals, maintenance, ordered, reports, search, signal, speakers, transcripts, vectors
from parley.plans import further  # noqa: F401  registers its queries
from parley.plans.register import CENTROID as _CENTROID
from parley.plans.register import QUERIES as _QUERIES
from parley.plans.register import SQL as _SQL
from parley.plans.register import TOKENS as _TOKENS
from parley.plans.register import WORDS as _WORDS
from parley.plans.register import Query, agreement_sql, greedy_sql
from parley.plans.register import query as _query
from parley.plans.register import report_sql as _report_sql
from parley.plans.register import twins_sql as _twins_sql
from parley.plans.register import whole_twins_sql as _whole_twins_sql
from parley.sources import carriers as C
from parley.sources import files
from parley.sources.shared import new_path
from parley.sources.stored import StoredTable
from parley.sources.tables import table

# -- Scans, projections and filters -------------------------------------------------------------


@_query("s2_list_chunks", f"SELECT session_id, channel, seq, ts_ms, row_number() OVER (PARTITION BY session_id ORDER BY channel, seq, ts_ms, duration_ms) AS position FROM ({C.CHUNKS_SQL})")
def _list_chunks(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy("channel", "seq", "ts_ms", "duration_ms")
    return C.chunks(spark, sf_dir).select("session_id", "channel", "seq", "ts_ms", F.row_number().over(order).cast("long").alias("position"))


@_query("s3_captions", f"SELECT session_id, id, phase, row_number() OVER (PARTITION BY session_id ORDER BY created_at_ms, id) AS position FROM ({C.CAPTIONS_SQL})")
def _captions(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy("created_at_ms", "id")
    return C.captions(spark, sf_dir).select("session_id", "id", "phase", F.row_number().over(order).cast("long").alias("position"))


@_query("s7_segments_with_edits", f"""
    WITH e AS ({C.EDITS_SQL}), w AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY meeting_id, channel, start_ms, end_ms ORDER BY created_at_ms DESC, id DESC) = 1)
    SELECT s.meeting_id, s.idx, coalesce(w.edited_text, s.text) AS text, s.text AS original_text, w.id IS NOT NULL AS text_edited
    FROM ({C.SEGMENTS_SQL}) s LEFT JOIN w USING (meeting_id, channel, start_ms, end_ms)""")
def _overlaid(spark, sf_dir):
    return edits.overlaid(C.segments(spark, sf_dir), C.edits(spark, sf_dir)).select("meeting_id", "idx", "text", "original_text", "text_edited")


@_query("f3_active_terms", f"SELECT id, surface, scope FROM ({C.TERMS_SQL}) WHERE scope = 'global' OR meeting_id = 4")
def _active_terms(spark, sf_dir):
    return glossary.active_terms(C.terms(spark, sf_dir), 4).select("id", "surface", "scope")


@_query("f8_matching_terms", f"SELECT id, surface FROM ({C.TERMS_SQL}) WHERE language = 'en' AND (contains(lower(surface), 'ring') OR contains(lower(canonical), 'ring'))")
def _matching_terms(spark, sf_dir):
    return glossary.matching_terms(C.terms(spark, sf_dir), " Ring ", language="en").select("id", "surface")


@_query("f9_audio_range", f"SELECT session_id, channel, seq, duration_ms FROM ({C.CHUNKS_SQL}) WHERE ts_ms < 2100 AND ts_ms + duration_ms > 900")
def _audio_range(spark, sf_dir):
    return C.chunks(spark, sf_dir).where((F.col("ts_ms") < 2100) & (F.col("ts_ms") + F.col("duration_ms") > 900)).select("session_id", "channel", "seq", "duration_ms")


@_query("f12_stale_artifacts", f"""
    SELECT a.id, a.meeting_id, coalesce(a.source_version <> v.latest, false) AS stale FROM ({C.ARTIFACTS_SQL}) a
    LEFT JOIN (SELECT meeting_id, max(version) AS latest FROM ({C.VERSIONS_SQL}) GROUP BY 1) v USING (meeting_id)""")
def _stale(spark, sf_dir):
    return maintenance.stale(C.artifacts(spark, sf_dir), C.versions(spark, sf_dir)).select("id", "meeting_id", "stale")


# -- Joins -----------------------------------------------------------------------------------------

_TWINS = _twins_sql(C.SEGMENTS_SQL)


@_query("j1_best_twin", f"WITH {_TWINS} SELECT meeting_id, idx, r_idx, measure AS overlap, round(similarity, 9) AS similarity, shorter::INTEGER AS shorter FROM twin")
def _best_twin(spark, sf_dir):
    return transcripts.twins(C.segments(spark, sf_dir)).select("meeting_id", "idx", "r_idx", "overlap", F.round("similarity", 9).alias("similarity"), "shorter")


@_query("j9_total_overlap", f"""
    SELECT m.meeting_id, sum(least(m.end_ms, s.end_ms) - greatest(m.start_ms, s.start_ms))::BIGINT AS overlap_ms
    FROM ({C.SEGMENTS_SQL}) m JOIN ({C.SEGMENTS_SQL}) s ON m.meeting_id = s.meeting_id AND m.channel = 'mic' AND s.channel = 'system' AND m.start_ms < s.end_ms AND s.start_ms < m.end_ms GROUP BY 1""")
def _total_overlap(spark, sf_dir):
    rows = C.segments(spark, sf_dir)
    return intervals.total_overlap(rows.where("channel = 'mic'"), rows.where("channel = 'system'"), ["meeting_id"])


_MATRIX = f"""
    SELECT a.meeting_id, a.speaker_id, b.idx % 3 AS cluster, sum(least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms))::BIGINT AS ms
    FROM ({C.SEGMENTS_SQL}) a JOIN ({C.SEGMENTS_SQL}) b ON a.meeting_id = b.meeting_id AND a.speaker_id <> '' AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms GROUP BY ALL"""


def _matrix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.segments(spark, sf_dir)
    return intervals.overlap_matrix(rows.where("speaker_id <> ''"), rows.withColumn("cluster", F.col("idx") % 3), ["meeting_id"])


@_query("j10_overlap_matrix", _MATRIX)
def _matrix(spark, sf_dir):
    return _matrix_rows(spark, sf_dir)


@_query("j11_greedy_assignment", f"{greedy_sql(_MATRIX, 'meeting_id')} SELECT meeting_id, speaker_id, cluster, ms FROM g WHERE taken")
def _greedy(spark, sf_dir):
    return reports.greedy_assignment(_matrix_rows(spark, sf_dir), ["meeting_id"])


@_query("a12_agreement", agreement_sql(_MATRIX, "meeting_id"))
def _agreement(spark, sf_dir):
    return reports.agreement(_matrix_rows(spark, sf_dir), ["meeting_id"])


@_query("j4_reattached_edits", f"""
    WITH e AS ({C.EDITS_SQL}),
         h AS (SELECT e.id, e.meeting_id, e.created_at_ms, s.idx AS target_idx, least(e.end_ms, s.end_ms + 100) - greatest(e.start_ms, s.start_ms + 100) AS overlap
               FROM e JOIN ({C.SEGMENTS_SQL}) s ON e.meeting_id = s.meeting_id AND e.channel = s.channel AND trim(e.original_text) <> '' AND contains(s.text, e.original_text)
               WHERE least(e.end_ms, s.end_ms + 100) > greatest(e.start_ms, s.start_ms + 100)),
         f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY id ORDER BY overlap DESC, target_idx) = 1),
         p AS (SELECT id, target_idx FROM f QUALIFY row_number() OVER (PARTITION BY meeting_id, target_idx ORDER BY created_at_ms DESC, id DESC) = 1)
    SELECT e.id, p.target_idx FROM e LEFT JOIN p USING (id)""")
def _reattached(spark, sf_dir):
    moved = C.segments(spark, sf_dir).withColumns({"start_ms": F.col("start_ms") + 100, "end_ms": F.col("end_ms") + 100})
    return edits.reattached(C.edits(spark, sf_dir), moved).select("id", "target_idx")


@_query("j7_meeting_summaries", f"""
    SELECT c_custkey AS meeting_id, EXISTS (SELECT 1 FROM ({C.VERSIONS_SQL}) v WHERE v.meeting_id = c_custkey) AS has_final,
           (SELECT count(*) FROM ({C.ARTIFACTS_SQL}) a WHERE a.meeting_id = c_custkey) AS artifact_count FROM customer""")
def _summaries(spark, sf_dir):
    meetings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("meeting_id"))
    return maintenance.summaries(meetings, C.versions(spark, sf_dir), C.artifacts(spark, sf_dir))


@_query("j5_speaker_names", "SELECT s_suppkey AS id, coalesce(n_name, '') AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def _names(spark, sf_dir):
    names = table(spark, sf_dir, "nation")
    both = table(spark, sf_dir, "supplier").join(F.broadcast(names), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return both.select(F.col("s_suppkey").alias("id"), F.coalesce("n_name", F.lit("")).alias("name"))


@_query("j13_unknown_tokens", f"""
    WITH t AS (SELECT DISTINCT lower(unnest({_TOKENS.format('text')})) AS key FROM conversations), k AS (SELECT DISTINCT lower(unnest({_TOKENS.format('text')})) AS key FROM benchmark)
    SELECT key FROM t WHERE key NOT IN (SELECT key FROM k)""")
def _unknown_tokens(spark, sf_dir):
    tokens = lambda name: table(spark, sf_dir, name).select(F.explode(F.transform(T.tokens(F.col("text")), F.lower)).alias("key")).distinct()
    return tokens("conversations").join(tokens("benchmark"), "key", "left_anti")


# -- Aggregations and reports -------------------------------------------------------------------


@_query("a1_speaker_stats", f"""
    WITH seg AS ({C.SEGMENTS_SQL}), per AS (
      SELECT meeting_id, speaker_id, count(*) AS replies, sum(greatest(end_ms - start_ms, 0))::BIGINT AS speaking_ms, arg_min(channel, idx) AS channel
      FROM seg WHERE speaker_id <> '' GROUP BY ALL)
    SELECT *, CASE WHEN sum(speaking_ms) OVER w = 0 THEN 0.0 ELSE speaking_ms::DOUBLE / (sum(speaking_ms) OVER w)::DOUBLE END AS share,
           row_number() OVER (PARTITION BY meeting_id ORDER BY speaking_ms DESC, speaker_id) - 1 AS position
    FROM per WINDOW w AS (PARTITION BY meeting_id)""")
def _speaker_stats(spark, sf_dir):
    return speakers.speaker_stats(C.segments(spark, sf_dir))


@_query("a4_next_version", f"SELECT meeting_id, coalesce(max(version), 0) + 1 AS next_version FROM ({C.VERSIONS_SQL}) GROUP BY 1")
def _next_version(spark, sf_dir):
    return maintenance.next_version(C.versions(spark, sf_dir))


@_query("a11_collapse_report", f"WITH {_TWINS}, {_report_sql(C.SEGMENTS_SQL, 0.02)} SELECT * FROM report")
def _collapse_report(spark, sf_dir):
    return transcripts.collapse_report(C.segments(spark, sf_dir), 0.02)


@_query("a13_threshold_sweep", f"""
    WITH {_TWINS} SELECT threshold::DOUBLE AS threshold, count(*) FILTER (similarity >= threshold) AS pairs, coalesce(sum(shorter) FILTER (similarity >= threshold), 0)::BIGINT AS words
    FROM twin, (VALUES (0.01::DOUBLE), (0.03::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.4::DOUBLE)) AS t(threshold) GROUP BY 1""")
def _sweep(spark, sf_dir):
    return reports.threshold_sweep(transcripts.twins(C.segments(spark, sf_dir)), [0.01, 0.03, 0.05, 0.1, 0.2, 0.4])


@_query("a15_histogram", "SELECT label, least(floor((embedding[1] + 1) / 2 * 10), 9)::INTEGER AS bucket, count(*) AS n FROM embeddings GROUP BY ALL")
def _histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", ((F.col("embedding")[0].cast("double") + 1) / 2).alias("v"))
    return reports.histogram(rows, "v", ["label"])


@_query("a16_upper_median", "SELECT event_type, list_sort(list(value))[(count(*) // 2 + 1)::INTEGER] AS median FROM events GROUP BY 1")
def _median(spark, sf_dir):
    return ordered.upper_median(table(spark, sf_dir, "events"), ["event_type"], "value")


@_query("a24_bucket_levels", f"""
    SELECT session_id, (ts_ms // 10000)::BIGINT AS bucket, list_sort(list(level))[(count(*) // 2 + 1)::INTEGER] AS median_level, count(*) FILTER (level > 450) AS accepted, count(*) AS frames
    FROM ({C.LEVELS_SQL}) GROUP BY ALL""")
def _bucket_levels(spark, sf_dir):
    return reports.bucket_levels(C.levels(spark, sf_dir), ["session_id"])


_COUNTS = f"""
    tok AS (SELECT meeting_id, unnest({_TOKENS.format('text')}) AS token FROM ({C.SEGMENTS_SQL})), t2 AS (SELECT *, lower(token) AS key FROM tok WHERE length(token) >= 2),
    sp AS (SELECT meeting_id, key, token, count(*) AS n FROM t2 GROUP BY ALL),
    cnt AS (SELECT meeting_id, key, sum(n)::BIGINT AS occurrences, first(token ORDER BY n DESC, token) AS surface FROM sp GROUP BY ALL)"""


@_query("a5_token_counts", f"WITH {_COUNTS} SELECT meeting_id, key, occurrences, surface FROM cnt")
def _token_counts(spark, sf_dir):
    return glossary.token_counts(C.segments(spark, sf_dir), ["meeting_id"], examples=False).select("meeting_id", "key", "occurrences", "surface")


_MINED = f"""
    WITH {_COUNTS}, head AS (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY occurrences DESC, key) <= 20),
         known AS (SELECT DISTINCT lower(unnest({_TOKENS.format('text')})) AS key FROM benchmark),
         ruled AS (SELECT c.*, CASE WHEN regexp_matches(c.surface, '[A-Za-z]') AND NOT regexp_matches(regexp_replace(c.surface, '[A-Za-z]', '', 'g'), '\\p{{L}}') THEN 'latin'
                                    WHEN length(regexp_replace(c.surface, '[^\\p{{L}}]', '', 'g')) >= 2 AND regexp_full_match(regexp_replace(c.surface, '[^\\p{{L}}]', '', 'g'), '\\p{{Lu}}+') THEN 'acronym'
                                    WHEN c.occurrences >= 3 AND h.key IS NULL AND length(c.key) >= 4 THEN 'repeated' END AS rule
                   FROM cnt c LEFT JOIN head h USING (meeting_id, key) WHERE c.key NOT IN (SELECT key FROM known))"""


@_query("g4_mined_terms", f"{_MINED} SELECT meeting_id, surface, occurrences, rule, row_number() OVER (PARTITION BY meeting_id ORDER BY occurrences DESC, surface) - 1 AS position FROM ruled WHERE rule IS NOT NULL")
def _mined(spark, sf_dir):
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.transform(T.tokens(F.col("text")), F.lower)).alias("key"))
    return glossary.mined(C.segments(spark, sf_dir), known, ["meeting_id"], 3, 20, examples=False).select("meeting_id", "surface", "occurrences", "rule", "position")


@_query("a23_rule_totals", f"{_MINED} SELECT rule, count(*) AS candidates, sum(occurrences)::BIGINT AS occurrences FROM ruled WHERE rule IS NOT NULL GROUP BY 1")
def _rule_totals(spark, sf_dir):
    return reports.rule_totals(_mined(spark, sf_dir))


# -- Order, windows and rendering -----------------------------------------------------------------


@_query("o1_merged", f"SELECT meeting_id, idx, channel, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, CASE WHEN channel = 'mic' THEN 0 ELSE 1 END, end_ms, idx) - 1 AS position FROM ({C.SEGMENTS_SQL})")
def _merged(spark, sf_dir):
    return transcripts.merged(C.segments(spark, sf_dir)).select("meeting_id", "idx", "channel", "position")


def _para(source: str) -> str:
    """Common table expression ``p``: paragraphs of the segments that ``source`` selects."""
    return f"""
         o AS (SELECT *, row_number() OVER (PARTITION BY meeting_id ORDER BY start_ms, CASE WHEN channel = 'mic' THEN 0 ELSE 1 END, end_ms, idx) - 1 AS position FROM ({source})),
         n AS (SELECT *, lag(speaker_id) OVER w AS ps, lag(channel) OVER w AS pc, lag(text) OVER w AS pt FROM o WHERE trim(text) <> '' WINDOW w AS (PARTITION BY meeting_id ORDER BY position)),
         p AS (SELECT *, sum(CASE WHEN ps IS NULL OR ps <> speaker_id OR pc <> channel OR regexp_matches(pt, '[.!?…]\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY meeting_id ORDER BY position) - 1 AS paragraph FROM n),
         q AS (SELECT meeting_id, paragraph, concat('**', any_value(speaker_id), ':** ', string_agg(trim(text), ' ' ORDER BY position)) AS body FROM p GROUP BY ALL)"""


_PARA = f"WITH {_para(C.SEGMENTS_SQL)}"


@_query("w2_paragraphs", f"{_PARA} SELECT meeting_id, idx, position, paragraph::BIGINT AS paragraph FROM p")
def _paragraphs(spark, sf_dir):
    return transcripts.paragraphs(C.segments(spark, sf_dir)).select("meeting_id", "idx", "position", "paragraph")


@_query("g9_rendered", f"""{_PARA}
    SELECT meeting_id, string_agg(body, chr(10) || chr(10) ORDER BY paragraph) AS body FROM q GROUP BY 1""")
def _rendered(spark, sf_dir):
    return transcripts.rendered(C.segments(spark, sf_dir))


@_query("w3_clipped", f"""
    WITH r AS (SELECT *, max(greatest(start_ms, end_ms)) OVER (PARTITION BY meeting_id, channel ORDER BY start_ms, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM ({C.SEGMENTS_SQL}) WHERE trim(text) <> '')
    SELECT meeting_id, idx, greatest(start_ms, coalesce(latest, start_ms)) AS start_ms, greatest(end_ms, greatest(start_ms, coalesce(latest, start_ms))) AS end_ms FROM r""")
def _clipped(spark, sf_dir):
    return transcripts.clipped(C.segments(spark, sf_dir)).select("meeting_id", "idx", "start_ms", "end_ms")


@_query("w6_chunk_islands", f"""
    WITH c AS (SELECT DISTINCT * FROM ({C.CHUNKS_SQL})), b AS (SELECT *, lag(ts_ms) OVER w AS pt, lag(duration_ms) OVER w AS pd, lag(rate) OVER w AS pr FROM c WINDOW w AS (PARTITION BY session_id, channel ORDER BY ts_ms, seq, duration_ms)),
         i AS (SELECT *, sum(CASE WHEN pt IS NULL OR pt + pd <> ts_ms OR pr <> rate THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, channel ORDER BY ts_ms, seq, duration_ms ROWS UNBOUNDED PRECEDING) - 1 AS island FROM b),
         p AS (SELECT *, (ts_ms - min(ts_ms) OVER (PARTITION BY session_id, channel, island)) // 2000 AS piece FROM i)
    SELECT session_id, channel, island::BIGINT AS island, min(ts_ms)::INTEGER AS ts_ms, sum(duration_ms)::BIGINT AS duration_ms, count(*) AS chunks FROM p GROUP BY session_id, channel, island, piece""")
def _chunk_islands(spark, sf_dir):
    rows = signal.listed_once(C.chunks(spark, sf_dir), ["session_id", "channel"])
    return signal.chunk_islands(rows, ["session_id", "channel"]).select("session_id", "channel", "island", "ts_ms", "duration_ms", "chunks")


@_query("w7_dominant_channel", f"""
    WITH s AS (SELECT session_id, (ts_ms // 60000)::BIGINT AS slot, coalesce(max(level) FILTER (kind = 'click'), 0) AS mic, coalesce(max(level) FILTER (kind <> 'click'), 0) AS system FROM ({C.LEVELS_SQL}) GROUP BY ALL)
    SELECT session_id, slot, mic, system, coalesce(last_value(CASE WHEN system > mic * 1.5 THEN 'system' WHEN mic > system * 1.5 THEN 'mic' END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY slot ROWS UNBOUNDED PRECEDING), 'mic') AS dominant FROM s""")
def _dominant(spark, sf_dir):
    slot = F.floor(F.col("ts_ms") / 60000).alias("slot")
    most = lambda hit: F.coalesce(F.max(F.when(hit, F.col("level"))), F.lit(0.0))
    slots = C.levels(spark, sf_dir).groupBy("session_id", slot).agg(most(F.col("kind") == "click").alias("mic"), most(F.col("kind") != "click").alias("system"))
    return signal.dominant_channel(slots, ["session_id"])


@_query("w5_speech_islands", f"""
    WITH f AS (SELECT session_id, (ts_ms // 60000 * 60000)::BIGINT AS ts_ms, max(level) AS level FROM ({C.LEVELS_SQL}) GROUP BY ALL), e AS (SELECT *, max(ts_ms + 60000) OVER (PARTITION BY session_id) AS track FROM f),
         l AS (SELECT *, lag(ts_ms) OVER (PARTITION BY session_id ORDER BY ts_ms) AS p FROM e WHERE level >= 200),
         s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts_ms - p > 180000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts_ms) - 1 AS span FROM l)
    SELECT session_id, span::BIGINT AS span, min(ts_ms) AS start_ms, least(max(ts_ms) + 180000, max(track)) AS end_ms FROM s GROUP BY ALL""")
def _speech(spark, sf_dir):
    frames = C.levels(spark, sf_dir).groupBy("session_id", (F.floor(F.col("ts_ms") / 60000) * 60000).alias("ts_ms")).agg(F.max("level").alias("level"))
    return signal.speech_islands(frames, ["session_id"], 60000)


@_query("w14_live_lines", f"SELECT session_id, id, phase FROM ({C.CAPTIONS_SQL}) QUALIFY phase = 'final' OR lead(id) OVER (PARTITION BY session_id ORDER BY created_at_ms, id) IS NULL")
def _live(spark, sf_dir):
    return transcripts.live_lines(C.captions(spark, sf_dir)).select("session_id", "id", "phase")


@_query("o2_latest_version", f"SELECT meeting_id, version, body FROM ({C.VERSIONS_SQL}) QUALIFY row_number() OVER (PARTITION BY meeting_id ORDER BY version DESC) = 1")
def _latest(spark, sf_dir):
    return maintenance.latest(C.versions(spark, sf_dir)).select("meeting_id", "version", "body")


@_query("o9_prompt_words", f"""
    WITH f AS (SELECT canonical, min(struct_pack(r := CASE WHEN language = 'en' THEN 0 ELSE 1 END, s := surface)) AS best FROM ({C.TERMS_SQL}) GROUP BY 1)
    SELECT substr(string_agg(canonical, ', ' ORDER BY best.r, best.s, canonical), 1, 200) AS prompt FROM f""")
def _prompt(spark, sf_dir):
    return glossary.prompt_words(C.terms(spark, sf_dir), "en", 200)


# -- Scalar functions -------------------------------------------------------------------------------


@_query("x1_words", f"SELECT conv_id, turn, array_to_string({_WORDS}, ' ') AS words FROM conversations")
def _x1(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.words(F.col("text")), " ").alias("words"))


@_query("x6_likeness", f"""
    WITH w AS (SELECT conv_id, turn, list_distinct({_WORDS}) AS w FROM conversations)
    SELECT a.conv_id, a.turn, round(CASE WHEN greatest(len(a.w), len(b.w)) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w))::DOUBLE / greatest(len(a.w), len(b.w)) END, 9) AS likeness
    FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def _x6(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("w"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.likeness(F.col("w"), F.col("v")), 9).alias("likeness"))


@_query("x10_date_labels", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS label FROM events")
def _x10(spark, sf_dir):
    return C.levels(spark, sf_dir).select("event_id", S.date_label(F.col("ts_ms")).alias("label"))


@_query("x21_cosine", """
    SELECT a.vec_id, round(greatest(-1, least(1, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def _x21(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@_query("x9_fingerprints", """
    WITH h AS (SELECT conv_id, turn, hex(text) AS h FROM conversations),
         f AS (SELECT conv_id, turn, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(generate_series(1, len(h) - 1, 2), lambda i: ('0x' || h[i:i + 1])::HUGEINT)),
                                                 lambda s, b: (xor(s, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT AS f FROM h)
    SELECT conv_id, turn, lower(lpad(hex(f), 16, '0')) AS fingerprint FROM f""")
def _x9(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.fingerprint("text").alias("fingerprint"))


def _hallucination_sql() -> str:
    """F5 and F6 from the same fixed values as the expressions."""
    quoted = ", ".join(f"'{m}'" for m in T.MARKERS)
    single = "|".join(v for v in T.CREDIT_VERBS if " " not in v)
    between = f"{T.CREDIT_STEM}\\S*(?: \\S+){{0,{T.CREDIT_WORDS - 1}}}? (?:{single})(?: |$)|{T.CREDIT_STEM}\\S*(?: \\S+){{0,{T.CREDIT_WORDS - 2}}}? и перевод(?: |$)"
    return f"""
    WITH p AS (SELECT conv_id, turn, trim(regexp_replace(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g')), '\\s+', ' ', 'g')) AS low FROM conversations),
         c AS (SELECT *, regexp_matches(low, '{between}') AS credits, [{quoted}] AS markers FROM p)
    SELECT conv_id, turn, length(low) < 2 OR credits OR len(list_filter(markers, lambda m: contains(low, m))) > 0 AS drop,
           length(low) >= {T.MIN_PREFIX} AND (starts_with(low, '{T.CREDIT_STEM}') AND len(string_split(low, ' ')) <= {T.CREDIT_PREFIX_WORDS} AND NOT credits
             OR len(list_filter(markers, lambda m: strlen(low) < strlen(m) AND starts_with(m, low))) > 0) AS hold FROM c"""


@_query("f5_hallucinations", _hallucination_sql())
def _f5(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_hallucination(F.col("text")).alias("drop"), T.may_become_hallucination(F.col("text")).alias("hold"))


# -- Compound operators -------------------------------------------------------------------------


@_query("g1_collapsed", f"WITH {_TWINS} SELECT meeting_id, idx FROM ({C.SEGMENTS_SQL}) s WHERE NOT EXISTS (SELECT 1 FROM twin t WHERE t.meeting_id = s.meeting_id AND t.idx = s.idx AND similarity >= 0.02 AND shorter >= 4)")
def _collapsed(spark, sf_dir):
    return transcripts.collapsed(C.segments(spark, sf_dir), 0.02).select("meeting_id", "idx")


@_query("g10_assembled")
def _assembled(spark, sf_dir):
    return transcripts.assembled(C.captions(spark, sf_dir))


@_query("g3_replaced")
def _replaced(spark, sf_dir):
    return glossary.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), C.terms(spark, sf_dir))


def _search_sql(docs: str) -> str:
    """The best 50 for the words the and tion, by bm25, of a table (ref_id, body)."""
    return f"""
    WITH d AS (SELECT ref_id, list_filter(string_split_regex(translate(lower(body), '{search.MARKED}', '{search.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM ({docs})),
         n AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM d), t AS (SELECT ref_id, len(w) AS length, unnest(w) AS term FROM d),
         h AS (SELECT ref_id, length, word, count(*) AS tf FROM t JOIN (VALUES (0, 'the'), (1, 'tion')) AS q(word, prefix) ON starts_with(term, prefix) GROUP BY ALL),
         f AS (SELECT word, count(*) AS df FROM h GROUP BY 1),
         s AS (SELECT ref_id, round(sum(greatest(0.000001::DOUBLE, ln((docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))) * tf * {search.K1 + 1}::DOUBLE / (tf + {search.K1}::DOUBLE * ({1 - search.B}::DOUBLE + {search.B}::DOUBLE * length / mean))), 9) AS score, count(*) AS words
               FROM h JOIN f USING (word), n GROUP BY 1)
    SELECT ref_id, score, row_number() OVER (ORDER BY score DESC, ref_id)::INTEGER AS rank FROM s WHERE words = 2 ORDER BY score DESC, ref_id LIMIT 50"""


@_query("g17_search", _search_sql("SELECT concat(conv_id, '-', turn) AS ref_id, text AS body FROM conversations"))
def _search(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("ref_id"), F.col("text").alias("body"))
    return search.search(docs, "the tion", 50)


@_query("g17_maintained_search", _search_sql("SELECT concat(conv_id, '-', turn) AS ref_id, CASE WHEN turn % 3 = 1 THEN concat('the nation, ', role) ELSE text END AS body FROM conversations WHERE conv_id % 5 <> 2"))
def _maintained_search(spark, sf_dir):
    """A stored index of all turns, then one change: new bodies for some turns, and conversations that go."""
    rows = table(spark, sf_dir, "conversations").withColumn("ref_id", F.concat_ws("-", "conv_id", "turn"))
    index = search.SearchIndex(spark, new_path(spark))
    index.change(rows.select("ref_id", F.col("text").alias("body")))
    changed = rows.where("turn % 3 = 1 AND conv_id % 5 <> 2").select("ref_id", F.concat(F.lit("the nation, "), F.col("role")).alias("body"))
    index.change(changed, rows.where("conv_id % 5 = 2").select("ref_id"))
    return index.search("the tion", 50)


@_query("j12_matched_voices")
def _matched(spark, sf_dir):
    rows = C.prints(spark, sf_dir)
    return vectors.matched(rows.where("source <> 'human'"), vectors.centroids(rows.where("source = 'human'"))).select("id", "best", F.round("similarity", 6).alias("similarity"), F.round("runner_up", 6).alias("runner_up"), "speaker")


@_query("g12_enrolment")
def _enrolment(spark, sf_dir):
    return vectors.enrolment(C.prints(spark, sf_dir))


@_query("a21_held_out", """
    WITH h AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 2 = 0 AS train FROM embeddings),
         u AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS v FROM h WHERE train),
         m AS (SELECT label, pos, sum(v) AS v FROM u GROUP BY ALL), p AS (SELECT concat('s', label) AS best, list(v ORDER BY pos) AS v FROM m GROUP BY label),
         s AS (SELECT vec_id, label, best, list_cosine_similarity(embedding::DOUBLE[], p.v) AS similarity FROM h, p WHERE NOT train),
         r AS (SELECT *, lead(similarity) OVER (PARTITION BY vec_id ORDER BY similarity DESC, best) AS following, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, best) AS n FROM s),
         k AS (SELECT accept, similarity >= accept AND similarity - coalesce(following, -1) >= 0.05 AS named, best = concat('s', label) AS right_one, 1000 + vec_id % 7 * 100 AS ms
               FROM r, (VALUES (0.3::DOUBLE), (0.35), (0.4), (0.45), (0.5)) AS t(accept) WHERE n = 1)
    SELECT accept, coalesce(sum(ms) FILTER (named AND right_one), 0)::BIGINT AS named_ms, coalesce(sum(ms) FILTER (named AND NOT right_one), 0)::BIGINT AS wrong_ms, coalesce(sum(ms) FILTER (NOT named), 0)::BIGINT AS unknown_ms FROM k GROUP BY 1""")
def _held_out(spark, sf_dir):
    rows = vectors.split_by_position(C.prints(spark, sf_dir), "speaker_id", "id")
    return vectors.held_out(rows, [0.3, 0.35, 0.4, 0.45, 0.5])


#: The gate, frame by frame of each session.
_GATE = f"""
    WITH RECURSIVE f AS (SELECT session_id, ts_ms, level, row_number() OVER (PARTITION BY session_id ORDER BY ts_ms, level) AS n FROM ({C.LEVELS_SQL}) WHERE level IS NOT NULL),
    g AS (SELECT session_id, ts_ms, level, n, level > greatest(level * 3, 120) AS accepted, level AS floor FROM f WHERE n = 1
          UNION ALL SELECT f.session_id, f.ts_ms, f.level, f.n, f.level > greatest(g.floor * 3, 120),
                           CASE WHEN f.level > greatest(g.floor * 3, 120) THEN least(g.floor, f.level) ELSE g.floor + (f.level - g.floor) * CASE WHEN f.level < g.floor THEN 0.25::DOUBLE ELSE 0.02::DOUBLE END END
          FROM g JOIN f ON f.session_id = g.session_id AND f.n = g.n + 1)"""


@_query("t5_noise_gate", f"{_GATE} SELECT session_id, ts_ms, level, accepted, floor FROM g")
def _gate(spark, sf_dir):
    rows = C.levels(spark, sf_dir).where("level is not null").select("session_id", "ts_ms", "level")
    return signal.gated(rows, ["session_id"])


# -- Maintenance --------------------------------------------------------------------------------


@_query("s29_upserted", f"SELECT meeting_id, version, body FROM ({C.VERSIONS_SQL}) WHERE version > 2 UNION ALL SELECT meeting_id, version, 'new' FROM ({C.VERSIONS_SQL}) WHERE version <= 2")
def _upserted(spark, sf_dir):
    old = C.versions(spark, sf_dir).select("meeting_id", "version", "body")
    stored = StoredTable.create(old, new_path(spark), ["meeting_id"])
    stored.upsert(old.where("version <= 2").withColumn("body", F.lit("new")), ["meeting_id", "version"])
    return stored.rows()


@_query("s31_written_terms", f"""
    WITH t AS ({C.TERMS_SQL}), n AS (SELECT id + 1000000 AS id, surface, 'new' AS canonical, language, scope, meeting_id, kind FROM t WHERE id % 100 = 0)
    SELECT id, surface, canonical FROM t WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = t.id OR (n.surface = t.surface AND n.language = t.language AND n.scope = t.scope AND n.meeting_id IS NOT DISTINCT FROM t.meeting_id))
    UNION ALL SELECT id, surface, canonical FROM n""")
def _written_terms(spark, sf_dir):
    old = C.terms(spark, sf_dir)
    new = old.where("id % 100 = 0").withColumns({"id": F.col("id") + 1_000_000, "canonical": F.lit("new")})
    stored = StoredTable.create(old, new_path(spark), ["surface"])
    stored.write_terms(new)
    return stored.rows().select("id", "surface", "canonical")


@_query("s32_cascaded", f"SELECT meeting_id, version FROM ({C.VERSIONS_SQL}) WHERE meeting_id % 3 <> 0")
def _cascaded(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("meeting_id"))
    stored = StoredTable.create(C.versions(spark, sf_dir), new_path(spark), ["meeting_id"])
    stored.delete(gone, ["meeting_id"])
    return stored.rows().select("meeting_id", "version")


@_query("s36_sweep_preview", "SELECT count(*) AS meetings, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM (SELECT c_custkey AS meeting_id FROM customer WHERE c_custkey < 500) JOIN (SELECT o_custkey AS meeting_id, count(*) * 100 AS bytes FROM orders GROUP BY 1) USING (meeting_id)")
def _preview(spark, sf_dir):
    meetings = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("meeting_id"), F.col("c_custkey").alias("started_at_ms"), F.lit(None).cast("long").alias("audio_deleted_at_ms"))
    sizes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("meeting_id")).agg((F.count("*") * 100).alias("bytes"))
    return maintenance.sweep_preview(meetings, sizes, 500)


# -- Further scans, filters and aggregates ------------------------------------------------------


@_query("s8_unapplied_edits", f"SELECT id, meeting_id FROM ({C.EDITS_SQL}) WHERE CASE WHEN id % 2 = 0 THEN id END IS NULL")
def _unapplied(spark, sf_dir):
    rows = C.edits(spark, sf_dir).withColumn("applied_version", F.when(F.col("id") % 2 == 0, F.col("id")))
    return rows.where(F.col("applied_version").isNull()).select("id", "meeting_id")


@_query("s10_glossary_order", f"SELECT id, row_number() OVER (ORDER BY surface, language, scope, coalesce(meeting_id::VARCHAR, ''), id) AS position FROM ({C.TERMS_SQL}) WHERE scope = 'global'")
def _glossary_order(spark, sf_dir):
    rows = C.terms(spark, sf_dir).where("scope = 'global'")
    order = ["surface", "language", "scope", F.coalesce(F.col("meeting_id").cast("string"), F.lit("")), "id"]
    return ordered.numbered(rows, [], order).select("id", "position")


@_query("s33_conditional_update", f"SELECT id, CASE WHEN origin <> 'human' THEN 'cleared' ELSE edited_text END AS edited_text FROM ({C.EDITS_SQL})")
def _conditional(spark, sf_dir):
    stored = StoredTable.create(C.edits(spark, sf_dir), new_path(spark), ["meeting_id"])
    stored.update(F.col("origin") != "human", {"edited_text": F.lit("cleared")})
    return stored.rows().select("id", "edited_text")


@_query("s38_keyed_delete", f"SELECT id, surface FROM ({C.TERMS_SQL}) WHERE id % 7 <> 0")
def _keyed_delete(spark, sf_dir):
    rows = C.terms(spark, sf_dir)
    stored = StoredTable.create(rows, new_path(spark), ["id"])
    stored.delete(rows.where("id % 7 = 0"), ["id"])
    return stored.rows().select("id", "surface")


@_query("f7_calendar", "SELECT event_id, CASE WHEN ts::DATE = DATE '2024-01-10' THEN 'today' WHEN date_trunc('week', ts) = DATE '2024-01-08' THEN 'this week' WHEN ts < TIMESTAMP '2024-01-08' THEN 'older' ELSE 'later' END AS kind FROM events")
def _calendar(spark, sf_dir):
    day = F.to_date(F.timestamp_millis("ts_ms"))
    now = F.lit("2024-01-10").cast("date")
    week = F.date_trunc("week", F.timestamp_millis("ts_ms")) == F.date_trunc("week", now)
    kind = F.when(day == now, "today").when(week, "this week").when(day < now, "older").otherwise("later")
    return C.levels(spark, sf_dir).select("event_id", kind.alias("kind"))


@_query("f15_long_pairs", f"WITH {_TWINS} SELECT meeting_id, idx FROM twin WHERE shorter >= 20")
def _long_pairs(spark, sf_dir):
    return transcripts.twins(C.segments(spark, sf_dir)).where("shorter >= 20").select("meeting_id", "idx")


@_query("a2_counts", f"SELECT session_id, channel, count(*) AS chunks, sum(duration_ms)::BIGINT AS ms, min(ts_ms)::INTEGER AS start_ms, count(DISTINCT rate) = 1 AS one_rate FROM ({C.CHUNKS_SQL}) GROUP BY ALL")
def _counts(spark, sf_dir):
    return C.chunks(spark, sf_dir).groupBy("session_id", "channel").agg(F.count("*").alias("chunks"), F.sum("duration_ms").alias("ms"), F.min("ts_ms").alias("start_ms"), (F.count_distinct("rate") == 1).alias("one_rate"))


@_query("a8_majority_vote", "WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, first(event_type ORDER BY n DESC, event_type) AS winner FROM n GROUP BY 1")
def _majority(spark, sf_dir):
    votes = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return votes.groupBy("user_id").agg(F.min_by("event_type", F.struct((-F.col("n")).alias("n"), "event_type")).alias("winner"))


@_query("a10_word_overlap", f"""
    WITH w AS (SELECT conv_id, turn, unnest({_WORDS}) AS w FROM conversations), c AS (SELECT conv_id, turn, w, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT conv_id, turn, sum(n) AS n FROM c GROUP BY ALL),
         s AS (SELECT a.conv_id, a.turn, sum(least(a.n, b.n)) AS common FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.w = b.w GROUP BY ALL)
    SELECT t.conv_id, t.turn, round(2 * coalesce(common, 0)::DOUBLE / (t.n + u.n), 9) AS dice FROM t JOIN t u ON u.conv_id = t.conv_id AND u.turn = t.turn + 1 LEFT JOIN s ON s.conv_id = t.conv_id AND s.turn = t.turn""")
def _dice(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(T.word_overlap(F.col("w"), F.col("v")), 9).alias("dice"))


@_query("a20_centroids", f"WITH {_CENTROID} SELECT speaker_id, round(v[1], 6) AS first, round(v[64], 6) AS last FROM p")
def _centroids(spark, sf_dir):
    made = vectors.centroids(C.prints(spark, sf_dir).where("source = 'human'"))
    return made.select("speaker_id", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[63], 6).alias("last"))


_MATCHED = f"""
    WITH {_CENTROID}, s AS (SELECT e.vec_id AS id, p.speaker_id AS best, list_cosine_similarity(e.embedding::DOUBLE[], p.v) AS similarity FROM embeddings e, p WHERE e.vec_id % 5 <> 0),
         r AS (SELECT *, lead(similarity) OVER (PARTITION BY id ORDER BY similarity DESC, best) AS runner_up, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, best) AS n FROM s)"""
_SQL["j12_matched_voices"] = f"{_MATCHED} SELECT id, best, round(similarity, 6) AS similarity, round(coalesce(runner_up, -1), 6) AS runner_up, CASE WHEN similarity >= 0.4 AND similarity - coalesce(runner_up, -1) >= 0.05 THEN best END AS speaker FROM r WHERE n = 1"
_SQL["g12_enrolment"] = f"""{_MATCHED}, k AS (SELECT id, best FROM r WHERE n = 1 AND similarity >= 0.4 AND similarity - coalesce(runner_up, -1) >= 0.05)
    SELECT e.vec_id AS id, CASE WHEN e.vec_id % 5 = 0 THEN concat('s', label) WHEN k.best IS NOT NULL THEN k.best WHEN e.vec_id % 5 = 1 THEN NULL ELSE concat('s', label) END AS speaker_id,
           CASE WHEN e.vec_id % 5 = 0 THEN 'human' WHEN k.best IS NOT NULL THEN 'voiceprint' WHEN e.vec_id % 5 = 1 THEN 'none' ELSE 'channel' END AS source
    FROM embeddings e LEFT JOIN k ON k.id = e.vec_id"""


@_query("a31_labelled_time", f"{_MATCHED} SELECT best AS speaker, sum(1000 + id % 7 * 100)::BIGINT AS ms FROM r WHERE n = 1 AND similarity >= 0.4 AND similarity - coalesce(runner_up, -1) >= 0.05 GROUP BY 1")
def _labelled_time(spark, sf_dir):
    rows = C.prints(spark, sf_dir)
    named = vectors.matched(rows.where("source <> 'human'"), vectors.centroids(rows.where("source = 'human'")))
    return named.where("speaker is not null").groupBy("speaker").agg(F.sum("ms").alias("ms"))


@_query("a25_evidence", f"""
    WITH s AS (SELECT meeting_id, sum(CASE WHEN channel = 'mic' THEN end_ms - start_ms ELSE 0 END)::BIGINT AS a_ms, sum(CASE WHEN channel = 'system' THEN end_ms - start_ms ELSE 0 END)::BIGINT AS b_ms, (max(end_ms) - min(start_ms))::BIGINT AS wall_ms FROM ({C.SEGMENTS_SQL}) GROUP BY 1),
         o AS (SELECT m.meeting_id, sum(least(m.end_ms, s.end_ms) - greatest(m.start_ms, s.start_ms))::BIGINT AS shared_ms FROM ({C.SEGMENTS_SQL}) m JOIN ({C.SEGMENTS_SQL}) s ON m.meeting_id = s.meeting_id AND m.channel = 'mic' AND s.channel = 'system' AND m.start_ms < s.end_ms AND s.start_ms < m.end_ms GROUP BY 1),
         e AS (SELECT s.*, coalesce(shared_ms, 0) AS shared_ms, CASE WHEN wall_ms > 0 THEN floor(a_ms * b_ms / wall_ms)::BIGINT ELSE 0 END AS expected_ms FROM s LEFT JOIN o USING (meeting_id))
    SELECT meeting_id, shared_ms, expected_ms, shared_ms > expected_ms + expected_ms // 5 AS same FROM e""")
def _evidence(spark, sf_dir):
    rows = C.segments(spark, sf_dir)
    long = F.col("end_ms") - F.col("start_ms")
    sums = rows.groupBy("meeting_id").agg(F.sum(F.when(F.col("channel") == "mic", long).otherwise(0)).alias("a_ms"), F.sum(F.when(F.col("channel") == "system", long).otherwise(0)).alias("b_ms"), (F.max("end_ms") - F.min("start_ms")).alias("wall_ms"))
    both = sums.join(_total_overlap(spark, sf_dir).withColumnRenamed("overlap_ms", "shared_ms"), "meeting_id", "left").fillna(0, ["shared_ms"])
    return reports.evidence(both).select("meeting_id", "shared_ms", "expected_ms", "same")


@_query("a18_lag_correlation", f"""
    WITH e AS (SELECT session_id, (ts_ms // 3600000)::BIGINT AS pos, sum(CASE WHEN kind = 'click' THEN level ELSE 0 END) AS v, sum(CASE WHEN kind <> 'click' THEN level ELSE 0 END) AS w FROM ({C.LEVELS_SQL}) GROUP BY ALL),
         l AS (SELECT a.session_id, lag, a.v, b.w FROM e a, generate_series(-2, 2) AS g(lag), e b WHERE a.session_id = b.session_id AND b.pos = a.pos + lag)
    SELECT session_id, lag::INTEGER AS lag, count(*) AS pairs, round(CASE WHEN count(*) < 2 OR stddev_pop(v) = 0 OR stddev_pop(w) = 0 THEN 0 ELSE greatest(-1, least(1, corr(v, w))) END, 6) AS corr FROM l GROUP BY ALL""")
def _lags(spark, sf_dir):
    part = lambda hit: F.sum(F.when(hit, F.col("level")).otherwise(0.0)).alias("v")
    rows = C.levels(spark, sf_dir).groupBy("session_id", F.floor(F.col("ts_ms") / 3_600_000).alias("at"))
    a, b = rows.agg(part(F.col("kind") == "click")), rows.agg(part(F.col("kind") != "click"))
    return signal.lag_correlation(a, b, ["session_id"], 2).select("session_id", "lag", "pairs", F.round("corr", 6).alias("corr"))


@_query("w12_split", f"SELECT id, speaker_id, (row_number() OVER (PARTITION BY speaker_id ORDER BY id) - 1) % 2 = 0 AS train FROM ({C.PRINTS_SQL})")
def _split(spark, sf_dir):
    return vectors.split_by_position(C.prints(spark, sf_dir), "speaker_id", "id").select("id", "speaker_id", "train")


@_query("w4_monotone_ends", f"SELECT session_id, event_id, max(CASE WHEN event_id % 3 = 0 THEN 7 ELSE event_id END) OVER (PARTITION BY session_id ORDER BY event_id) AS end_ms FROM ({C.LEVELS_SQL})")
def _monotone(spark, sf_dir):
    rows = C.levels(spark, sf_dir).select("session_id", "event_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id")).alias("end_ms"))
    return transcripts.monotone_ends(rows, F.lit(7), ["session_id"], "event_id")


@_query("o7_recent_lines", f"SELECT session_id, id FROM ({C.CAPTIONS_SQL}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at_ms DESC, id DESC) <= 3")
def _recent(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("session_id").orderBy(F.desc("created_at_ms"), F.desc("id"))
    return C.captions(spark, sf_dir).withColumn("_n", F.row_number().over(order)).where("_n <= 3").select("session_id", "id")


@_query("o12_index_rows", f"""
    SELECT meeting_id, 'final' AS kind, version::VARCHAR AS ref_id, body FROM ({C.VERSIONS_SQL})
    UNION ALL SELECT session_id, 'caption', id::VARCHAR, text FROM ({C.CAPTIONS_SQL}) WHERE phase = 'final'
    UNION ALL SELECT meeting_id, 'artifact', id::VARCHAR, kind FROM ({C.ARTIFACTS_SQL})""")
def _index_rows(spark, sf_dir):
    finals = C.versions(spark, sf_dir).withColumn("ref_id", F.col("version"))
    captions = C.captions(spark, sf_dir).withColumnsRenamed({"session_id": "meeting_id", "id": "ref_id", "text": "body"})
    return search.index_sources(finals, captions, C.artifacts(spark, sf_dir).withColumnsRenamed({"id": "ref_id", "kind": "body"}))


@_query("j17_slot_join", f"""
    WITH s AS (SELECT session_id, (ts_ms // 60000)::BIGINT AS slot, kind, level FROM ({C.LEVELS_SQL})), m AS (SELECT session_id, slot, max(level) AS mic FROM s WHERE kind = 'click' GROUP BY ALL), y AS (SELECT session_id, slot, max(level) AS system FROM s WHERE kind = 'view' GROUP BY ALL)
    SELECT session_id, slot, mic, system FROM m FULL JOIN y USING (session_id, slot)""")
def _slot_join(spark, sf_dir):
    rows = C.levels(spark, sf_dir).withColumn("slot", F.floor(F.col("ts_ms") / 60000))
    side = lambda kind, name: rows.where(F.col("kind") == kind).groupBy("session_id", "slot").agg(F.max("level").alias(name))
    return side("click", "mic").join(side("view", "system"), ["session_id", "slot"], "full")


@_query("j16_owner_names", f"SELECT DISTINCT meeting_id, speaker_id FROM ({C.SEGMENTS_SQL}) WHERE channel = 'mic' AND speaker_id <> '' AND (meeting_id, speaker_id) NOT IN (SELECT (meeting_id, speaker_id) FROM ({C.SEGMENTS_SQL}) WHERE channel = 'system')")
def _owner_names(spark, sf_dir):
    rows = C.segments(spark, sf_dir)
    names = lambda channel: rows.where((F.col("channel") == channel) & (F.col("speaker_id") != "")).select("meeting_id", "speaker_id").distinct()
    return names("mic").join(names("system"), ["meeting_id", "speaker_id"], "left_anti")


@_query("g2_word_diffs")
def _diffs(spark, sf_dir):
    rows = C.edits(spark, sf_dir)
    return rows.select("id", diff.word_diff("original_text", "edited_text").alias("spans"))


@_query("g5_terms_from_edits")
def _terms_from_edits(spark, sf_dir):
    rows = _diffs(spark, sf_dir).select("id", diff.term_from_spans(F.col("spans")).alias("t"))
    return rows.select("id", F.col("t").isNotNull().alias("found"), "t.surface", "t.canonical")


@_query("j15_owner_windows", f"""
    WITH s AS ({C.SEGMENTS_SQL}), w AS (SELECT meeting_id, idx, start_ms, start_ms + 300 AS end_ms FROM s)
    SELECT meeting_id, idx, CASE WHEN o AND t THEN 'both' WHEN o THEN 'owner' WHEN t THEN 'others' ELSE 'neither' END AS kind FROM (
      SELECT w.*, EXISTS (SELECT 1 FROM s WHERE s.meeting_id = w.meeting_id AND s.channel = 'mic' AND s.start_ms < w.end_ms AND w.start_ms < s.end_ms) AS o,
             EXISTS (SELECT 1 FROM s WHERE s.meeting_id = w.meeting_id AND s.channel = 'system' AND s.start_ms < w.end_ms AND w.start_ms < s.end_ms) AS t FROM w)""")
def _owner_windows(spark, sf_dir):
    rows = C.segments(spark, sf_dir)
    spans = rows.select("meeting_id", "idx", "start_ms", (F.col("start_ms") + 300).alias("end_ms"))
    return intervals.owner_class(spans, rows.where("channel = 'mic'"), rows.where("channel = 'system'"), ["meeting_id"], ["idx"]).select("meeting_id", "idx", "kind")


# -- Further joins and reports ------------------------------------------------------------------


_FAR = _whole_twins_sql(C.SEGMENTS_SQL, "greatest(m.start_ms, s.start_ms) - least(m.end_ms, s.end_ms) >= 3000", "greatest(m.start_ms, s.start_ms) - least(m.end_ms, s.end_ms)")


@_query("j2_far_twin", f"WITH RECURSIVE {_FAR} SELECT meeting_id, idx, r_idx, measure AS gap, round(similarity, 9) AS similarity FROM twin")
def _far_twin(spark, sf_dir):
    rows = C.segments(spark, sf_dir).withColumn("words", T.words(F.col("text")))
    return intervals.far_twin(rows.where("channel = 'mic'"), rows.where("channel = 'system'"), ["meeting_id"], ["idx"], "idx", 3000).select("meeting_id", "idx", "r_idx", "gap", "similarity")


@_query("j8_doubled_text", f"""
    WITH seg AS (SELECT *, list_distinct({_WORDS}) AS w FROM ({C.SEGMENTS_SQL}))
    SELECT m.meeting_id, m.idx FROM seg m WHERE m.channel = 'mic' AND EXISTS (SELECT 1 FROM seg s WHERE s.meeting_id = m.meeting_id AND s.channel = 'system' AND m.start_ms < s.end_ms AND s.start_ms < m.end_ms
      AND CASE WHEN greatest(len(m.w), len(s.w)) = 0 THEN 0 ELSE len(list_intersect(m.w, s.w))::DOUBLE / greatest(len(m.w), len(s.w)) END >= 0.1)""")
def _doubled(spark, sf_dir):
    rows = C.segments(spark, sf_dir).withColumn("words", T.words(F.col("text")))
    likeness = T.likeness(F.col("words"), F.col("r_words"))
    return intervals.doubled(rows.where("channel = 'mic'"), rows.where("channel = 'system'"), likeness, ["meeting_id"], ["idx"], 0.1).select("meeting_id", "idx")


@_query("j6_silent_speakers", f"""
    WITH s AS (SELECT meeting_id, speaker_id, count(*) AS replies, sum(greatest(end_ms - start_ms, 0))::BIGINT AS ms FROM ({C.SEGMENTS_SQL}) WHERE speaker_id <> '' GROUP BY ALL),
         l AS (SELECT DISTINCT conv_id AS meeting_id, n.name AS speaker_id, n.i FROM conversations, (VALUES ('user', 0), ('guest', 1), ('assistant', 2), ('a guest', 3)) AS n(name, i))
    SELECT meeting_id, speaker_id, coalesce(replies, 0) AS replies, row_number() OVER (PARTITION BY meeting_id ORDER BY CASE WHEN ms IS NULL THEN 1 ELSE 0 END, ms DESC, CASE WHEN ms IS NULL THEN i END, speaker_id) - 1 AS position FROM l FULL JOIN s USING (meeting_id, speaker_id)""")
def _silent(spark, sf_dir):
    names = spark.createDataFrame([("user", 0), ("guest", 1), ("assistant", 2), ("a guest", 3)], "speaker_id string, sort_index int")
    people = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id")).distinct().crossJoin(F.broadcast(names))
    return speakers.with_silent(_speaker_stats(spark, sf_dir), people).select("meeting_id", "speaker_id", "replies", "position")


@_query("a19_plain_correlation", f"""
    WITH e AS (SELECT session_id, (ts_ms // 3600000)::BIGINT AS pos, sum(CASE WHEN kind = 'click' THEN level ELSE 0 END) AS v, sum(CASE WHEN kind <> 'click' THEN level ELSE 0 END) AS w FROM ({C.LEVELS_SQL}) GROUP BY ALL)
    SELECT session_id, round(CASE WHEN sum(v * v) * sum(w * w) > 0 THEN sum(v * w) / sqrt(sum(v * v) * sum(w * w)) ELSE 0 END, 6) AS corr FROM e GROUP BY 1""")
def _plain_correlation(spark, sf_dir):
    part = lambda hit, name: F.sum(F.when(hit, F.col("level")).otherwise(0.0)).alias(name)
    rows = C.levels(spark, sf_dir).groupBy("session_id", F.floor(F.col("ts_ms") / 3_600_000).alias("at")).agg(part(F.col("kind") == "click", "v"), part(F.col("kind") != "click", "w"))
    return signal.plain_correlation(rows, ["session_id"]).select("session_id", F.round("corr", 6).alias("corr"))


@_query("a28_spans", f"SELECT meeting_id, sum(end_ms - start_ms)::BIGINT AS total_ms, (max(end_ms) - min(start_ms))::BIGINT AS wall_ms, count(DISTINCT speaker_id) AS labels FROM ({C.SEGMENTS_SQL}) GROUP BY 1")
def _spans(spark, sf_dir):
    rows = C.segments(spark, sf_dir)
    return rows.groupBy("meeting_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("total_ms"), (F.max("end_ms") - F.min("start_ms")).alias("wall_ms"), F.count_distinct("speaker_id").alias("labels"))


@_query("w9_drift", f"""
    WITH l AS (SELECT session_id, event_id AS pos, floor(level / 10)::BIGINT AS lag FROM ({C.LEVELS_SQL})), d AS (SELECT *, lag - lag(lag) OVER (PARTITION BY session_id ORDER BY pos) AS step FROM l)
    SELECT session_id, max(lag) - min(lag) > 100 AND 2 * greatest(count(*) FILTER (step >= 0), count(*) FILTER (step <= 0)) >= count(*) AS drifts FROM d GROUP BY 1""")
def _drift(spark, sf_dir):
    rows = C.levels(spark, sf_dir).select("session_id", F.col("event_id").alias("at"), F.floor(F.col("level") / 10).alias("lag"))
    return signal.drift(rows, ["session_id"])


@_query("w13_after_last_marker", f"""
    WITH l AS ({C.LEVELS_SQL}), m AS (SELECT session_id, max(ts_ms) AS from_ms FROM l WHERE kind = 'error' GROUP BY 1) SELECT session_id, event_id FROM l JOIN m USING (session_id) WHERE ts_ms >= from_ms""")
def _after_marker(spark, sf_dir):
    return files.after_last_marker(C.levels(spark, sf_dir), "error", ("session_id",)).select("session_id", "event_id")


@_query("s21_rotated", f"SELECT event_id FROM ({C.LEVELS_SQL}) ORDER BY ts_ms DESC LIMIT 200")
def _rotated(spark, sf_dir):
    return files.rotated(C.levels(spark, sf_dir), 200).select("event_id")


@_query("s24_markdown_names", f"SELECT event_id, concat(strftime(ts, '%Y-%m-%d'), '-', substr(user_id::VARCHAR, 1, 8), '-', event_type, '.md') AS name FROM events")
def _markdown(spark, sf_dir):
    return C.levels(spark, sf_dir).select("event_id", S.markdown_name(F.col("ts_ms"), F.col("session_id"), F.col("kind")).alias("name"))


@_query("g6_promotable_terms", f"""
    WITH e AS (SELECT conv_id AS meeting_id, turn, CASE WHEN turn % 2 = 0 THEN 'Small Ring' ELSE 'red bolt' END AS original_text FROM conversations), t AS ({C.TERMS_SQL})
    SELECT e.meeting_id, turn, t.id AS term_id FROM e JOIN t ON lower(t.surface) = lower(original_text) AND t.kind <> 1 AND (t.scope = 'global' OR t.meeting_id = e.meeting_id)""")
def _promotable(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("meeting_id"), "turn", F.when(F.col("turn") % 2 == 0, "Small Ring").otherwise("red bolt").alias("original_text"))
    return edits.promotable(rows, C.terms(spark, sf_dir)).select("meeting_id", "turn", "term_id")


_LETTER = r"A-Za-z\x{0400}-\x{052f}\x{2de0}-\x{2dff}\x{a640}-\x{a69f}"


def _worded(text: str, surface: str, canonical: str) -> str:
    """A word replaced wherever no letter is next to it; twice, as neighbours share the character between them."""
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|[^{_LETTER}]){surface}([^{_LETTER}]|$)', '\\1' || chr(1) || '\\2', 'gi')"
    return f"replace({text}, chr(1), '{canonical}')"


_BULK = f"""
    e AS ({C.EDITS_SQL}), w AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY meeting_id, channel, start_ms, end_ms ORDER BY created_at_ms DESC, id DESC) = 1),
    put AS (SELECT *, {_worded('text', 'the', 'THE')} AS edited_text FROM ({C.SEGMENTS_SQL})),
    bulk AS (SELECT meeting_id, channel, start_ms, end_ms, edited_text FROM put WHERE edited_text <> text
      AND NOT EXISTS (SELECT 1 FROM w WHERE w.meeting_id = put.meeting_id AND w.channel = put.channel AND w.start_ms = put.start_ms AND w.end_ms = put.end_ms AND w.origin = 'human'))"""


@_query("g8_bulk_edits", f"WITH {_BULK} SELECT meeting_id, channel, start_ms, edited_text FROM bulk")
def _bulk(spark, sf_dir):
    return edits.bulk_edits(C.segments(spark, sf_dir), C.edits(spark, sf_dir), "the", "THE").select("meeting_id", "channel", "start_ms", "edited_text")


_PROMOTED = f"SELECT s.* REPLACE (coalesce(edited_text, text) AS text) FROM ({C.SEGMENTS_SQL}) s LEFT JOIN bulk USING (meeting_id, channel, start_ms, end_ms) WHERE s.meeting_id IN (SELECT meeting_id FROM bulk)"


@_query("g26_promoted_bodies", f"WITH {_BULK}, {_para(_PROMOTED)} SELECT meeting_id, string_agg(body, chr(10) || chr(10) ORDER BY paragraph) AS body FROM q GROUP BY 1")
def _promoted_bodies(spark, sf_dir):
    return flows.promoted(C.segments(spark, sf_dir), C.edits(spark, sf_dir), "the", "THE")


@_query("g11_briefs", f"""{_PARA}, b AS (SELECT meeting_id, string_agg(body, chr(10) || chr(10) ORDER BY paragraph) AS body FROM q GROUP BY 1),
    c AS (SELECT meeting_id, list_filter(list_transform(string_split_regex(body, '\\n\\s*\\n'), lambda x: trim(x)), lambda x: x <> '') AS p FROM b)
    SELECT meeting_id, coalesce(p[1][1:280], '') AS summary, array_to_string(list_transform(list_filter(p, lambda x: contains(lower(x), 'the') OR contains(lower(x), 'que')), lambda x: concat('- ', x)), chr(10)) AS actions FROM c""")
def _briefs(spark, sf_dir):
    return briefs.brief(_rendered(spark, sf_dir), ["the", "que"])


@_query("f11_label_counts", f"SELECT speaker_id AS meeting_id, count(*) FILTER (id % 9 = 0) AS unidentified, count(*) FILTER (source = 'human') AS human_labelled FROM ({C.PRINTS_SQL}) GROUP BY 1")
def _label_counts(spark, sf_dir):
    rows = C.prints(spark, sf_dir).withColumn("meeting_id", F.col("speaker_id")).withColumn("speaker_id", F.when(F.col("id") % 9 != 0, F.col("speaker_id")))
    return vectors.label_counts(rows, ["meeting_id"])


@_query("f10_human_labels", f"SELECT p.id, p.speaker_id, coalesce(n_name, '') AS display_name FROM ({C.PRINTS_SQL}) p LEFT JOIN nation ON concat('s', n_nationkey) = p.speaker_id WHERE p.source = 'human'")
def _human_labels(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey")).alias("speaker_id"), F.col("n_name").alias("display_name"))
    return vectors.human_labels(C.prints(spark, sf_dir), names).select("id", "speaker_id", "display_name")


@_query("w10_window_match", f"""
    WITH e AS (SELECT session_id, event_id % 1000 AS pos, sum(CASE WHEN kind = 'click' THEN level ELSE 0 END) AS v, sum(level) AS w FROM (SELECT session_id % 3 AS session_id, event_id, kind, level FROM ({C.LEVELS_SQL})) GROUP BY ALL)
    SELECT session_id, (pos // 10)::BIGINT AS "window", round(CASE WHEN stddev_pop(v) = 0 OR stddev_pop(w) = 0 THEN 0 ELSE corr(v, w) END, 6) AS corr FROM e GROUP BY ALL HAVING count(*) = 10""")
def _window_match(spark, sf_dir):
    rows = C.levels(spark, sf_dir).groupBy((F.col("session_id") % 3).alias("session_id"), (F.col("event_id") % 1000).alias("at"))
    a = rows.agg(F.sum(F.when(F.col("kind") == "click", F.col("level")).otherwise(0.0)).alias("v"))
    return signal.minute_match(a, rows.agg(F.sum("level").alias("v")), ["session_id"], 10).select("session_id", "window", F.round("corr", 6).alias("corr"))


@_query("s40_latest_spans", f"""
    WITH s AS (SELECT *, idx % 2 AS version FROM ({C.SEGMENTS_SQL})) SELECT meeting_id, idx, start_ms, end_ms FROM s WHERE channel = 'mic' AND version = (SELECT max(version) FROM s t WHERE t.meeting_id = s.meeting_id)""")
def _latest_spans(spark, sf_dir):
    return maintenance.latest_spans(C.segments(spark, sf_dir).withColumn("version", F.col("idx") % 2), "mic")


@_query("o13_preferred_file", "SELECT first(p_name ORDER BY CASE p_name WHEN 'none' THEN 1 WHEN 'small ring' THEN 2 ELSE 3 END, p_name) AS name FROM part")
def _preferred(spark, sf_dir):
    return maintenance.preferred(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), ["none", "small ring"])


@_query("a30_gate_report", f"""{_GATE}, w AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS total FROM g),
    s AS (SELECT session_id, list_sort(list(floor)) AS a, list_sort(list(floor) FILTER (3 * (n - 1) >= 2 * total)) AS b, max(floor) AS peak_floor, count(*) FILTER (accepted) AS accepted, count(*) FILTER (level > 450) AS accepted_fixed FROM w GROUP BY 1)
    SELECT session_id, a[(len(a) // 2 + 1)::INTEGER] AS median_floor, b[(len(b) // 2 + 1)::INTEGER] AS tail_floor, peak_floor, accepted, accepted_fixed FROM s""")
def _gate_report(spark, sf_dir):
    return signal.gate_report(_gate(spark, sf_dir), ["session_id"])


@_query("g20_paced_inferences", f"""{_GATE},
    p AS (SELECT session_id, n, 1 AS waited, 0 AS idle, 1 AS pace, accepted AS heard, 0 AS runs FROM g WHERE n = 1
          UNION ALL SELECT session_id, n, CASE WHEN done THEN 0 ELSE waited END, CASE WHEN NOT done THEN idle WHEN heard THEN 0 ELSE idle + 1 END,
                           CASE WHEN NOT done THEN pace WHEN heard THEN 1 WHEN idle + 1 >= 2 THEN least(pace + 1, 3) ELSE pace END, heard AND NOT done, runs + done::INTEGER
          FROM (SELECT p.session_id, g.n, p.waited + 1 AS waited, idle, pace, heard OR g.accepted AS heard, runs, p.waited + 1 >= pace * 10 AS done FROM p JOIN g ON g.session_id = p.session_id AND g.n = p.n + 1))
    SELECT session_id, max(runs) AS inferences FROM p GROUP BY 1""")
def _paced(spark, sf_dir):
    return signal.paced_inferences(_gate(spark, sf_dir), ["session_id"])


_UNDOUBLED = f"SELECT * FROM ({C.SEGMENTS_SQL}) s WHERE NOT EXISTS (SELECT 1 FROM twin t WHERE t.meeting_id = s.meeting_id AND t.idx = s.idx AND similarity >= 0.5 AND shorter >= 4)"


_REBUILT = f"""
    clip AS (SELECT * EXCLUDE (latest) REPLACE (greatest(start_ms, coalesce(latest, start_ms)) AS start_ms, greatest(end_ms, start_ms, coalesce(latest, start_ms)) AS end_ms)
             FROM (SELECT *, max(greatest(start_ms, end_ms)) OVER (PARTITION BY meeting_id, channel ORDER BY start_ms, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM ({C.SEGMENTS_SQL}) WHERE trim(text) <> '')),
    {_twins_sql("SELECT * FROM clip")},
    fresh AS (SELECT * FROM clip s WHERE NOT EXISTS (SELECT 1 FROM twin t WHERE t.meeting_id = s.meeting_id AND t.idx = s.idx AND similarity >= 0.5 AND shorter >= 4)),
    home AS (SELECT ed.id, ed.meeting_id, ed.created_at_ms, ed.edited_text, s.idx AS target_idx, least(ed.end_ms, s.end_ms) - greatest(ed.start_ms, s.start_ms) AS overlap
             FROM ({C.EDITS_SQL}) ed JOIN fresh s ON ed.meeting_id = s.meeting_id AND ed.channel = s.channel AND trim(ed.original_text) <> '' AND contains(s.text, ed.original_text) AND least(ed.end_ms, s.end_ms) > greatest(ed.start_ms, s.start_ms)
             QUALIFY row_number() OVER (PARTITION BY ed.id ORDER BY overlap DESC, target_idx) = 1),
    placed AS (SELECT * FROM home QUALIFY row_number() OVER (PARTITION BY meeting_id, target_idx ORDER BY created_at_ms DESC, id DESC) = 1),
    laid AS (SELECT s.* REPLACE (coalesce(placed.edited_text, s.text) AS text) FROM fresh s LEFT JOIN placed ON placed.meeting_id = s.meeting_id AND placed.target_idx = s.idx)"""


@_query("g28_rebuilt_bodies", f"WITH {_REBUILT}, {_para('SELECT * FROM laid')} SELECT meeting_id, string_agg(body, chr(10) || chr(10) ORDER BY paragraph) AS body FROM q GROUP BY 1")
def _rebuilt_bodies(spark, sf_dir):
    return flows.rebuilt(C.segments(spark, sf_dir), C.edits(spark, sf_dir), 0.5)


@_query("g18_collapsed_text", f"WITH {_TWINS}, {_para(_UNDOUBLED)} SELECT meeting_id, string_agg(body, chr(10) || chr(10) ORDER BY paragraph) AS body FROM q GROUP BY 1")
def _collapsed_text(spark, sf_dir):
    return transcripts.rendered(transcripts.collapsed(C.segments(spark, sf_dir), 0.5))


_UNIT = "generate_subscripts(vector, 1) AS pos, unnest(vector)::DOUBLE / sqrt(list_inner_product(vector::DOUBLE[], vector::DOUBLE[])) AS x"
_TOP = "lead(similarity) OVER (PARTITION BY id ORDER BY similarity DESC, best) AS following, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, best) AS n"
#: Labels after a voice pass: by the voices of each meeting, then by remembered ones.
_VOICED = f"""
    v AS ({C.VOICED_SQL}),
    pm AS (SELECT meeting_id, speaker_id, pos, sum(x) AS x FROM (SELECT meeting_id, speaker_id, {_UNIT} FROM v WHERE source = 'human' AND vector IS NOT NULL) GROUP BY ALL),
    print AS (SELECT meeting_id, speaker_id, list(x ORDER BY pos) AS x FROM pm GROUP BY ALL),
    own AS (SELECT id, best FROM (SELECT *, {_TOP} FROM (SELECT v.id, print.speaker_id AS best, list_cosine_similarity(v.vector::DOUBLE[], print.x) AS similarity FROM v JOIN print USING (meeting_id) WHERE source <> 'human' AND vector IS NOT NULL))
            WHERE n = 1 AND similarity >= 0.3 AND similarity - coalesce(following, -1) >= 0.02),
    f AS (SELECT v.*, source <> 'human' AND vector IS NOT NULL AND own.best IS NULL AS unsure,
                 CASE WHEN source = 'human' OR (vector IS NULL AND source <> 'voiceprint') THEN v.speaker_id WHEN vector IS NOT NULL AND own.best IS NOT NULL THEN own.best WHEN vector IS NOT NULL AND source = 'channel' THEN v.speaker_id ELSE '' END AS label
          FROM v LEFT JOIN own USING (id)),
    km AS (SELECT label, pos, sum(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x FROM embeddings WHERE vec_id % 7 = 0) GROUP BY ALL),
    known AS (SELECT concat('v', label) AS best, list(x ORDER BY pos) AS x FROM km GROUP BY label),
    mem AS (SELECT id, best FROM (SELECT *, {_TOP} FROM (SELECT f.id, known.best, list_cosine_similarity(f.vector::DOUBLE[], known.x) AS similarity FROM f, known WHERE f.source <> 'human' AND f.vector IS NOT NULL AND f.label = ''))
            WHERE n = 1 AND similarity >= 0.3 AND similarity - coalesce(following, -1) >= 0.02),
    made AS (SELECT f.* EXCLUDE (speaker_id), f.source <> 'human' AND f.label <> f.speaker_id AS changed, mem.best, CASE WHEN mem.best IS NOT NULL THEN concat(meeting_id, ':voice:', mem.best) ELSE f.label END AS speaker_id FROM f LEFT JOIN mem USING (id))"""


def _voice_pass(spark, sf_dir):
    rows = C.voiced(spark, sf_dir)
    voices = vectors.centroids(table(spark, sf_dir, "embeddings").where("vec_id % 7 = 0").select(F.concat(F.lit("v"), F.col("label")).alias("speaker_id"), F.col("embedding").alias("vector")))
    return rows, flows.voice_pass(rows, voices, 0.3, 0.02)


@_query("g24_voice_pass", f"""
    WITH {_VOICED} SELECT meeting_id, (SELECT count(*) FROM print p WHERE p.meeting_id = made.meeting_id) AS prints, count(*) FILTER (changed AND label <> '') AS signed, count(*) FILTER (changed AND label = '') AS cleared,
           count(*) FILTER (unsure) AS unknown, count(*) FILTER (source <> 'human' AND vector IS NULL) AS without_vector, count(*) FILTER (best IS NOT NULL) AS signed_from_memory FROM made GROUP BY meeting_id""")
def _voice_report(spark, sf_dir):
    return _voice_pass(spark, sf_dir)[1].report


@_query("g24_voice_bodies", f"""
    WITH {_VOICED}, {_para("SELECT meeting_id, idx, start_ms, end_ms, channel, speaker_id, text FROM made")}
    SELECT meeting_id, 1 AS version, string_agg(body, chr(10) || chr(10) ORDER BY paragraph) AS body, (SELECT count(*) FROM print p WHERE p.meeting_id = q.meeting_id) AS prints FROM q GROUP BY meeting_id""")
def _voice_bodies(spark, sf_dir):
    """Finals and prints are stored, the pass is written, and both are read back."""
    rows, made = _voice_pass(spark, sf_dir)
    before = transcripts.rendered(rows).withColumn("version", F.lit(1)).select("meeting_id", "version", "body")
    finals = StoredTable.create(before, new_path(spark), ["meeting_id"])
    prints = StoredTable.create(made.prints.withColumn("samples", F.lit(0).cast("long")), new_path(spark), ["meeting_id"])
    flows.apply_voice_pass(made, rows, prints, finals)
    many = prints.rows().groupBy("meeting_id").agg(F.count_if(F.col("samples") > 0).alias("prints"))
    return finals.rows().join(many, "meeting_id", "left").withColumn("prints", F.coalesce("prints", F.lit(0)))


def queries() -> dict[str, Query]:
    """Every query by name."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that have it."""
    return dict(_SQL)
