"""Names of queries, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with its DuckDB twin if it has one."""

    def keep(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return keep


#: Words of a text as the comparison takes them (X1); DuckDB and Spark agree on texts without combining marks.
WORDS = r"list_filter(list_transform(string_split_regex(text, '\s+'), lambda w: replace(lower(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')), 'ё', 'е')), lambda w: w <> '')"
TOKENS = r"list_filter(string_split_regex({0}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"

#: Voice prints of the labels, from the rows that a human labelled.
CENTROID = """
    u AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS v FROM embeddings WHERE vec_id % 5 = 0),
    m AS (SELECT label, pos, sum(v) AS v FROM u GROUP BY ALL), c AS (SELECT label, list(v ORDER BY pos) AS v FROM m GROUP BY 1),
    p AS (SELECT concat('s', label) AS speaker_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM c)"""


def twins_sql(segments: str, condition: str = "m.start_ms < s.end_ms AND s.start_ms < m.end_ms", measure: str = "least(m.end_ms, s.end_ms) - greatest(m.start_ms, s.start_ms)") -> str:
    """Common table expression ``twin``: each mic segment's best system segment, by similarity, then ``measure``.

    Shared words get a character each; the edit distance counts bytes, so there may be 90 of them.
    """
    place = "coalesce(list_position(k, x), 0)"
    return f"""
    seg AS (SELECT *, {WORDS} AS w FROM ({segments})),
    pair AS (SELECT m.meeting_id, m.idx, s.idx AS r_idx, {measure} AS measure, m.w[1:400] AS a, s.w[1:400] AS b, list_intersect(m.w[1:400], s.w[1:400]) AS k, least(len(m.w), len(s.w)) AS shorter
             FROM seg m JOIN seg s ON m.meeting_id = s.meeting_id AND m.channel = 'mic' AND s.channel = 'system' AND {condition}),
    coded AS (SELECT *, array_to_string(list_transform(a, lambda x: chr((CASE WHEN {place} = 0 THEN 33 ELSE 34 + {place} END)::INTEGER)), '') AS ca,
                     array_to_string(list_transform(b, lambda x: chr((CASE WHEN {place} = 0 THEN 34 ELSE 34 + {place} END)::INTEGER)), '') AS cb FROM pair),
    alike AS (SELECT meeting_id, idx, r_idx, measure, shorter, CASE WHEN len(k) = 0 THEN 0.0::DOUBLE ELSE 1 - levenshtein(ca, cb)::DOUBLE / greatest(len(a), len(b)) END AS similarity FROM coded),
    twin AS (SELECT * FROM alike QUALIFY row_number() OVER (PARTITION BY meeting_id, idx ORDER BY similarity DESC, measure DESC, r_idx) = 1)"""


def whole_twins_sql(segments: str, condition: str, measure: str) -> str:
    """Common table expression ``twin`` as above, over all words of the segments; it needs WITH RECURSIVE.

    Up to 90 shared words get a character each. Pairs with more fill the table of the edit distance by its
    diagonals: element i + 1 of ``last`` is the distance of i words of a to the other step - 1 - i of b.
    What lies outside of a list is null, and ``least`` passes it over.
    """
    chars = "array_to_string(list_transform({0}, lambda x: chr((34 + x)::INTEGER)), '')"
    return f"""
    seg AS (SELECT *, {WORDS} AS w FROM ({segments})),
    pair AS (SELECT m.meeting_id, m.idx, s.idx AS r_idx, {measure} AS measure, m.w AS a, s.w AS b, list_intersect(m.w, s.w) AS k
             FROM seg m JOIN seg s ON m.meeting_id = s.meeting_id AND m.channel = 'mic' AND s.channel = 'system' AND {condition}),
    coded AS (SELECT meeting_id, idx, r_idx, measure, len(k) AS shared, list_transform(a, lambda x: coalesce(list_position(k, x), 0)::BIGINT) AS a, list_transform(b, lambda x: coalesce(list_position(k, x), -1)::BIGINT) AS b FROM pair),
    diagonal USING KEY (a, b) AS (
             SELECT DISTINCT a, b, 1::BIGINT AS step, [0::BIGINT] AS last, []::BIGINT[] AS before FROM coded WHERE shared > 90
             UNION SELECT a, b, step + 1, list_transform(range(0, least(len(a), step) + 1), lambda i: least(least(last[i], last[i + 1]) + 1, before[i] + (a[i] <> b[step - i])::BIGINT)), last
             FROM diagonal WHERE step <= len(a) + len(b)),
    measured AS (SELECT c.*, CASE WHEN shared <= 90 THEN levenshtein({chars.format("c.a")}, {chars.format("c.b")}) ELSE last[len(c.a) + 1] END AS distance FROM coded c LEFT JOIN diagonal d ON d.a = c.a AND d.b = c.b),
    alike AS (SELECT meeting_id, idx, r_idx, measure, CASE WHEN shared = 0 THEN 0.0::DOUBLE ELSE 1 - distance::DOUBLE / greatest(len(a), len(b)) END AS similarity FROM measured),
    twin AS (SELECT * FROM alike QUALIFY row_number() OVER (PARTITION BY meeting_id, idx ORDER BY similarity DESC, measure DESC, r_idx) = 1)"""


def report_sql(segments: str, threshold: float) -> str:
    """Common table expression ``report`` over ``twin``: what a collapse at the threshold would do to each meeting."""
    return f"""
    found AS (SELECT meeting_id, count(*) AS paired, count(*) FILTER (similarity >= {threshold} AND shorter >= 4) AS collapsed, count(*) FILTER (similarity >= {threshold} AND shorter < 4) AS kept_short FROM twin GROUP BY 1),
    whole AS (SELECT meeting_id, count(*) AS segments, count(*) FILTER (channel = 'mic') AS mic_total, count(*) FILTER (channel = 'system') AS system_total FROM ({segments}) GROUP BY 1),
    report AS (SELECT meeting_id, segments, mic_total, system_total, coalesce(paired, 0) AS paired, coalesce(collapsed, 0) AS collapsed, coalesce(kept_short, 0) AS kept_short,
                      mic_total - coalesce(paired, 0) AS lonely_mic, segments - coalesce(collapsed, 0) AS kept FROM whole LEFT JOIN found USING (meeting_id))"""


def greedy_sql(cells: str, keys: str) -> str:
    """CTEs c (the cells), o (them in order) and g (a step a cell, with what is taken so far) of the greedy assignment."""
    free = "NOT list_contains(g.people, o.speaker_id) AND NOT list_contains(g.clusters, o.cluster)"
    return f"""
    WITH RECURSIVE c AS ({cells}),
         o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ms DESC, speaker_id, cluster) AS i FROM c WHERE ms > 0),
         g AS (SELECT DISTINCT ON ({keys}) {keys}, speaker_id, cluster, ms, 0::BIGINT AS i, false AS taken, [speaker_id][:0] AS people, [cluster][:0] AS clusters FROM o
               UNION ALL
               SELECT {keys}, o.speaker_id, o.cluster, o.ms, o.i, {free}, CASE WHEN {free} THEN list_append(g.people, o.speaker_id) ELSE g.people END,
                      CASE WHEN {free} THEN list_append(g.clusters, o.cluster) ELSE g.clusters END
               FROM g JOIN o USING ({keys}) WHERE o.i = g.i + 1)"""


def agreement_sql(cells: str, keys: str) -> str:
    """Accuracy, wholeness and purity of the cells."""
    return f"""{greedy_sql(cells, keys)},
         p AS (SELECT {keys}, sum(ms) AS paired FROM g WHERE taken GROUP BY ALL), t AS (SELECT {keys}, sum(ms) AS ms FROM c GROUP BY ALL),
         s AS (SELECT {keys}, sum(best) AS whole FROM (SELECT {keys}, speaker_id, max(ms) AS best FROM c GROUP BY ALL) GROUP BY ALL),
         u AS (SELECT {keys}, sum(best) AS pure FROM (SELECT {keys}, cluster, max(ms) AS best FROM c GROUP BY ALL) GROUP BY ALL)
    SELECT {keys}, CASE WHEN ms > 0 THEN coalesce(paired, 0)::DOUBLE / ms::DOUBLE ELSE 0 END AS accuracy, CASE WHEN ms > 0 THEN whole::DOUBLE / ms::DOUBLE ELSE 0 END AS wholeness,
           CASE WHEN ms > 0 THEN pure::DOUBLE / ms::DOUBLE ELSE 0 END AS purity
    FROM t JOIN s USING ({keys}) JOIN u USING ({keys}) LEFT JOIN p USING ({keys})"""
