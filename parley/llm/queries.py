"""One query for each numbered operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from parley.llm import bpe, codebooks, htmltext, langid, linededup, mtree, neardup, packing, prefixtrie, quality, secretscan, sharding, toxicity
from parley.llm.kernels import crc_fold

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned where crc32 of the id is not 2 modulo 4."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(crc_fold("doc_id", 4) != 2))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate string of every document with the verdict on it."""
    return secretscan.scan(_table(spark, sf_dir, "documents"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the lines whose template recurs across documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_recurring_lines(docs)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 85 per cent of three-word shingles."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned where crc32 of the id is not 0 modulo 5."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    learned = crc_fold("doc_id", 5) != 0
    model = toxicity.fit(docs.where(learned), _table(spark, sf_dir, "labels").where(learned))
    return toxicity.score_toxicity(docs, model).select("doc_id", (crc_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their place in sequences of 4096 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE)


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the quality rules and the verdict of the cascade on every document."""
    return quality.quality_cascade(_table(spark, sf_dir, "documents")).drop("failed_rule")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    return bpe.digests(_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten rows of highest inner product for every hundredth vector."""
    return mtree.top_k(_table(spark, sf_dir, "embeddings"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefixtrie.trie(_table(spark, sf_dir, "conversations"))


def op12_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every whole vector under eight codebooks."""
    return codebooks.compress(_table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shards are near equal in bytes."""
    made = sharding.shard(_table(spark, sf_dir, "documents"), 8, ["doc_id"])
    return made.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_secret_scan, op3_line_templates, op4_near_duplicates, op5_toxicity, op6_best_fit_packing, op7_quality_cascade, op8_byte_bpe, op9_exact_top_k, op10_html_text, op11_prefix_trie, op12_code_compression, op13_sharding)}


OP9_SQL = """
  WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
       s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
             FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
  SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""


def _level_sql(k: int) -> str:
    """One level of the template tree: shapes of the nodes, lines that agree with them, and the lines that go deeper."""
    return f"""
       tok{k} AS (SELECT node, masked, docs, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM mem{k}),
       votes{k} AS (SELECT node, pos, token, sum(docs) AS n FROM tok{k} GROUP BY ALL),
       common{k} AS (SELECT node, pos, token FROM votes{k} QUALIFY row_number() OVER (PARTITION BY node, pos ORDER BY n DESC, token) = 1),
       shape{k} AS (SELECT node, list(token ORDER BY pos) AS shape FROM common{k} GROUP BY ALL),
       near{k} AS (SELECT m.* FROM mem{k} m JOIN shape{k} USING (node) WHERE 10 * len(list_filter(list_zip(t, shape), lambda x: x[1] = x[2])) >= 7 * size),
       total{k} AS (SELECT node, min(doc_id) AS first_doc FROM near{k} JOIN holder USING (masked) GROUP BY node HAVING count(DISTINCT doc_id) >= 10),
       done{k} AS (SELECT masked, total{k}.first_doc FROM near{k} JOIN total{k} USING (node)),
       rest{k} AS (SELECT * FROM mem{k} WHERE masked NOT IN (SELECT masked FROM done{k})),
       left{k} AS (SELECT node, masked, docs, generate_subscripts(t, 1) AS pos, unnest(t) AS token FROM rest{k}),
       weight{k} AS (SELECT node, pos, token, sum(docs) AS n FROM left{k} GROUP BY ALL),
       whole{k} AS (SELECT node, sum(docs) AS whole FROM rest{k} GROUP BY node),
       best{k} AS (SELECT masked, pos, token FROM left{k} JOIN weight{k} USING (node, pos, token) JOIN whole{k} USING (node) WHERE n < whole
                   QUALIFY row_number() OVER (PARTITION BY masked ORDER BY n DESC, pos) = 1),
       mem{k + 1} AS (SELECT r.* REPLACE (r.node || chr(1) || pos || chr(1) || token AS node) FROM rest{k} r JOIN best{k} USING (masked)
                      QUALIFY sum(docs) OVER (PARTITION BY r.node, pos, token) >= 10 AND count(*) OVER (PARTITION BY r.node, pos, token) > 1),"""


OP3_SQL = (
    r"""
  WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
       line AS (SELECT doc_id, generate_subscripts(l, 1) AS place, unnest(l) AS line FROM raw),
       tok AS (SELECT doc_id, place, line, string_split(trim(regexp_replace(regexp_replace(line, '[0-9]+', '<*>', 'g'), '[ \t-\r]+', ' ', 'g')), ' ') AS t FROM line),
       m AS (SELECT doc_id, place, line, array_to_string(t, ' ') AS masked, CASE WHEN array_to_string(t, ' ') = '' THEN 0 ELSE len(t) END AS size, t FROM tok),
       e AS (SELECT masked, any_value(size) AS size, any_value(t) AS t, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM m WHERE masked <> '' GROUP BY masked),
       holder AS (SELECT DISTINCT masked, doc_id FROM m),
       mem0 AS (SELECT size || chr(1) || t[1] || chr(1) || t[2] || chr(1) || t[3] AS node, masked, size, t, docs FROM e WHERE size > 3
                QUALIFY sum(docs) OVER (PARTITION BY size, t[1], t[2], t[3]) >= 10 AND count(*) OVER (PARTITION BY size, t[1], t[2], t[3]) > 1),"""
    + "".join(_level_sql(k) for k in range(linededup.LEVELS))
    + r"""
       rec AS (SELECT masked, min(first_doc) AS first_doc FROM (SELECT masked, first_doc FROM e WHERE docs >= 10"""
    + "".join(f" UNION ALL SELECT masked, first_doc FROM done{k}" for k in range(linededup.LEVELS))
    + r""") GROUP BY masked),
       own AS (SELECT m.doc_id, m.place, m.size, e.first_doc FROM m JOIN e USING (masked) WHERE e.docs >= 2),
       total AS (SELECT doc_id, sum(size) AS total FROM m GROUP BY doc_id),
       copied AS (SELECT doc_id, first_doc FROM own JOIN total USING (doc_id) GROUP BY doc_id, first_doc, total HAVING 2 * sum(size) > total),
       gone AS (SELECT m.doc_id, m.place FROM m JOIN rec USING (masked) WHERE m.doc_id > rec.first_doc
                UNION SELECT o.doc_id, o.place FROM own o WHERE o.size > 50 AND o.doc_id > o.first_doc
                  AND NOT EXISTS (SELECT 1 FROM copied c WHERE c.doc_id = o.doc_id AND c.first_doc = o.first_doc))
  SELECT m.doc_id, coalesce(string_agg(CASE WHEN g.doc_id IS NULL THEN line END, chr(10) ORDER BY m.place), '') AS text,
         count(*)::INTEGER AS n_lines, count(g.doc_id)::INTEGER AS n_dropped
  FROM m LEFT JOIN gone g ON g.doc_id = m.doc_id AND g.place = m.place GROUP BY m.doc_id"""
)


#: crc32 of the decimal id, bit by bit with the usual polynomial.
CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
              lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))))"""
OP11_SQL = f"""
  WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
             FROM conversations WHERE conv_id IS NOT NULL),
       c AS (SELECT conv_id, max(pos) AS own, conv_id - conv_id % 100 AS donor, {CRC32_SQL} % 6 AS h FROM t GROUP BY conv_id),
       k AS (SELECT c.*, least(c.h, coalesce(g.own, 0)) AS kept FROM c LEFT JOIN c g ON g.conv_id = c.donor),
       r AS (SELECT k.conv_id, t.pos AS depth, role, text FROM k JOIN t ON t.conv_id = k.donor AND t.pos <= k.kept
             UNION ALL SELECT conv_id, t.pos - k.h + k.kept, role, text FROM k JOIN t USING (conv_id) WHERE t.pos > k.h),
       p AS (SELECT conv_id, depth, length(text) AS n, sha256(string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM r
             UNION ALL SELECT conv_id, 0, 0, '' FROM k),
       up AS (SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
       node AS (SELECT key, depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(n) AS n, count(*) FILTER (last) AS n_ends,
                       string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last) AS ends FROM up GROUP BY ALL),
       kids AS (SELECT parent AS key, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY 1),
       own AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (key)),
       under AS (SELECT p.key, count(*) FILTER (y.n_children = 0) AS n_leaves, sum((y.n_convs - 1) * y.n) AS saved_tokens
                 FROM own y JOIN p ON p.conv_id = y.conv_id AND p.depth <= y.depth GROUP BY 1)
  SELECT own.conv_id, own.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, own.n_convs, own.n_children::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(own.ends, '')) AS ends_sha256
  FROM own JOIN under USING (key) LEFT JOIN node above ON above.key = own.parent"""

_DISTANCE = "list_sum(list_transform(list_zip(d.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_NEAREST = f"SELECT d.*, b.e, {_DISTANCE} AS error FROM d JOIN b{{k}} b USING (pos) QUALIFY row_number() OVER (PARTITION BY d.pos, d.part ORDER BY error, e) = 1"
OP12_SQL = (
    f"""
  WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor({codebooks.SCALE} * x::DOUBLE)::BIGINT) AS v
             FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
       p AS MATERIALIZED (SELECT r, pos, v[pos * len(v) // {codebooks.PARTS} + 1:(pos + 1) * len(v) // {codebooks.PARTS}] AS part FROM v, range({codebooks.PARTS}) g(pos)),
       d AS MATERIALIZED (SELECT pos, part, count(*) AS n FROM p GROUP BY ALL),
       b0 AS (SELECT pos, r AS e, part FROM p WHERE r < {codebooks.ENTRIES})"""
    + "".join(
        f""",
       near{k} AS MATERIALIZED ({_NEAREST.format(k=k)}),
       sums{k} AS (SELECT pos, e, i, sum(n * part[i])::BIGINT AS s, sum(n)::BIGINT AS m FROM near{k}, range(1, 1 + (SELECT max(len(part)) FROM d)) g(i) GROUP BY ALL),
       new{k} AS (SELECT pos, e, list((s - ((s % m) + m) % m) // m ORDER BY i) AS part FROM sums{k} GROUP BY ALL),
       b{k + 1} AS MATERIALIZED (SELECT pos, e, coalesce(new{k}.part, b{k}.part) AS part FROM b{k} LEFT JOIN new{k} USING (pos, e))"""
        for k in range(codebooks.ROUNDS)
    )
    + f""",
       code AS MATERIALIZED ({_NEAREST.format(k=codebooks.ROUNDS)}),
       back AS (SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY pos) AS code, sum(error)::BIGINT AS error FROM p JOIN code USING (pos, part) GROUP BY r),
       flat AS (SELECT pos, e, i, part[i] AS x FROM b{codebooks.ROUNDS}, range(1, 1 + (SELECT max(len(part)) FROM d)) g(i))
  SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY pos, e, i)) FROM flat) AS codebooks_sha256
  FROM v JOIN back USING (r)"""
)


def oracle_sql() -> dict[str, str]:
    return {"op3_line_templates": OP3_SQL, "op9_exact_top_k": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op12_code_compression": OP12_SQL}
