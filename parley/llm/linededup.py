"""Removal of lines whose template recurs across documents, by a tree of log templates.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm import storage

#: Documents that a template must occur in, and leading tokens that a leaf is reached by. Lines of
#: no more tokens than that are told apart by all of them.
MIN_DOCS, DEPTH = 10, 3
#: Tokens of a generalised template that must agree (in tenths), and levels of the tree below the
#: leading tokens: lines that fit no template of their group go one level deeper.
AGREE_TENTHS, LEVELS = 7, 3
#: A line of more tokens than this is a passage, and recurs if this many documents have it.
PASSAGE_TOKENS, PASSAGE_DOCS = 50, 2
VARIABLE = "<*>"


def _masked(line: Column) -> Column:
    """The line with its runs of digits as variable fields and its white space as single spaces."""
    masked = F.regexp_replace(F.trim(F.regexp_replace(line, "[ \\t-\\r]+", " ")), "[0-9]+", VARIABLE)
    return F.when(line.rlike("[0-9\\t-\\r]|  "), masked).otherwise(F.trim(line))  # most lines need one scan alone


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def line_table(docs: DataFrame) -> DataFrame:
    """Every line with a token, without its text: row key, doc_id, place, number of tokens, template and leaf.

    It is written once; all counts are made from it, so the texts are cut and masked only once.
    """
    rows = docs.select(_row().alias("row"), "doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    rows = rows.select("row", "doc_id", "place", _masked(F.col("line")).alias("masked"))
    size = F.when(F.col("masked") == "", 0).otherwise(F.length("masked") - F.length(F.replace("masked", F.lit(" "))) + 1)
    made = rows.select("row", "doc_id", "place", size.alias("size"), F.xxhash64("masked").alias("template"), F.xxhash64(size, F.substring_index("masked", " ", DEPTH)).alias("leaf"))
    return storage.written(made).where("size > 0")


def _texts(docs: DataFrame, lines: DataFrame, wide: DataFrame) -> DataFrame:
    """Template, leaf and tokens of the lines of wide leaves, read from one line of each template."""
    chosen = lines.join(storage.broadcast_if_small(wide), "leaf", "left_semi").groupBy("template", "leaf").agg(F.min(F.struct("row", "place")).alias("at"))
    chosen = storage.written(chosen.groupBy("at.row").agg(F.collect_list(F.struct("at.place", "template", "leaf")).alias("wanted")))
    sources = docs.select(_row().alias("row"), "text").join(storage.limited_broadcast(chosen), "row").select("row", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    masked = _masked(F.get(F.col("lines"), F.col("w.place")))
    return sources.dropDuplicates(["w"]).select("w.template", "w.leaf", F.split(masked, " ").alias("tokens"))


def recurring_lines(docs: DataFrame, lines: DataFrame, exact: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Masked lines (by hash, as ``template``) of recurring templates, with the first document of each.

    The tree has a level for the number of tokens and one for each leading token. In a leaf, lines
    that are equal after masking digits are one template. Leaves that enough documents reach with
    different lines are generalised: each place takes its commonest token, ties to the smallest,
    and the lines that agree with it in enough places become one template with variable fields at
    the others, if enough documents hold them. The remaining lines of a leaf go to its children,
    each by the token that most of them share and not all have, and are generalised there again,
    for LEVELS levels in all. ``exact`` has the documents and the first one of every template.
    """
    wide = exact.where(F.col("size") > DEPTH).groupBy("leaf").agg(F.sum("docs").alias("n"), F.min("template").alias("low"), F.max("template").alias("high"))
    wide = storage.written(wide.where((F.col("n") >= min_docs) & (F.col("low") < F.col("high"))).select("leaf"))
    texts = storage.written(_texts(docs, lines, wide))
    now = storage.written(texts.join(exact, ["template", "leaf"]).withColumnRenamed("leaf", "node"))
    holders = storage.written(lines.join(storage.limited_broadcast(wide), "leaf", "left_semi").select("template", "doc_id").distinct())
    found = exact.where(F.col("docs") >= min_docs).select("template", "first_doc")
    for level in range(LEVELS):
        tokens = now.select("node", "template", "docs", F.posexplode("tokens").alias("at", "token"))
        votes = tokens.groupBy("node", "at", "token").agg(F.sum("docs").alias("n"))
        common = votes.groupBy("node", "at").agg(F.min_by("token", F.struct((-F.col("n")).alias("n"), "token")).alias("token"))
        shape = common.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("shape"))
        same = F.aggregate(F.zip_with("tokens", "shape", lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
        near = storage.written(now.join(storage.written(shape), "node").where(10 * same >= AGREE_TENTHS * F.col("size")).select("node", "template"))
        total = near.join(holders, "template").groupBy("node", "doc_id").agg(F.lit(1).alias("one"))
        total = total.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= min_docs)
        done = storage.written(near.join(total, "node").select("template", "first_doc"))
        found = found.union(done)
        if level + 1 == LEVELS:
            break
        rest = storage.written(now.join(done.select("template"), "template", "left_anti"))
        tokens = rest.select("node", "template", "docs", F.posexplode("tokens").alias("at", "token"))
        votes = tokens.groupBy("node", "at", "token").agg(F.sum("docs").alias("n"))
        whole = rest.groupBy("node").agg(F.sum("docs").alias("whole"))
        votes = votes.join(whole, "node").where(F.col("n") < F.col("whole"))
        best = tokens.join(votes, ["node", "at", "token"]).groupBy("template").agg(F.max_by(F.struct("at", "token"), F.struct("n", (-F.col("at")).alias("before"))).alias("by"))
        deeper = rest.join(best, "template").withColumn("node", F.xxhash64("node", "by.at", "by.token")).drop("by")
        wide = deeper.groupBy("node").agg(F.sum("docs").alias("n"), F.count("*").alias("many")).where((F.col("n") >= min_docs) & (F.col("many") > 1)).select("node")
        now = storage.written(deeper.join(wide, "node", "left_semi"))
        if now.isEmpty():
            break
    return found.groupBy("template").agg(F.min("first_doc").alias("first_doc"))


def passages(lines: DataFrame, exact: DataFrame) -> DataFrame:
    """Row and place of lines over PASSAGE_TOKENS that an earlier document has too, unless the row is a copy of that document.

    A row most of whose tokens stand in lines that it shares with that document is a copy; taking
    its passages would only hide it from the search for near-duplicates.
    """
    shared = exact.where(F.col("docs") >= PASSAGE_DOCS).select("template", "first_doc")
    long = lines.where(F.col("size") > PASSAGE_TOKENS).join(shared, "template").where("doc_id > first_doc").select("row", "place", "first_doc")
    long = storage.written(long)
    rows = storage.broadcast_if_small(long.select("row").distinct())
    own = lines.join(rows, "row", "left_semi")
    total = own.groupBy("row").agg(F.sum("size").alias("total"))
    common = own.join(shared, "template").groupBy("row", "first_doc").agg(F.sum("size").alias("common"))
    copied = common.join(total, "row").where(2 * F.col("common") > F.col("total")).select("row", "first_doc")
    return long.join(copied, ["row", "first_doc"], "left_anti").select("row", "place")


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of docs with ``text`` without recurring lines, and n_lines and n_dropped.

    A line whose template occurs in ``min_docs`` documents or more stays in the document of the
    smallest doc_id that has it and goes from the others. So does a passage of more than
    PASSAGE_TOKENS tokens that PASSAGE_DOCS documents have, unless the document is a copy. Lines
    without a token stay. The text of a document that loses nothing is unchanged; one that loses all
    its lines becomes empty. A null text stays null with n_lines 0, an empty one has one line.
    Repeated rows count as one document and lose the same lines. Rows without an id count as one
    document, which is never the first: they lose all lines whose template recurs, and no passages.
    An empty table gives no rows. Columns that docs has already under the names n_lines or n_dropped
    are replaced, columns of any other name come back. Lines, leaves and rows are told apart by 64-bit hashes.
    """
    # The other columns travel under names of their own, so that none is taken for one of ours.
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    taken = {c: c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(kept)}
    docs = docs.select(*(F.col(f"`{c}`").alias(name) for c, name in taken.items()))
    lines = line_table(docs)
    each = lines.groupBy("template", "leaf", "size", "doc_id").agg(F.lit(1).alias("one"))
    exact = storage.written(each.groupBy("template", "leaf", "size").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")))
    recurring = storage.broadcast_if_small(recurring_lines(docs, lines, exact, min_docs))
    hits = lines.select("row", "doc_id", "place", "template").join(recurring, "template")
    hits = hits.where(F.coalesce(F.col("doc_id") > F.col("first_doc"), F.lit(True))).select("row", "place")
    drops = hits.union(passages(lines, exact)).groupBy(F.col("row").alias("_row")).agg(F.collect_set("place").alias("_drops"))
    lost = docs.withColumns({"_row": _row(), "_lines": F.split("text", "\n")}).join(storage.limited_broadcast(storage.written(drops)), "_row", "left")
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drops"))
    left = F.array_join(F.transform(places, lambda i: F.get(F.col("_lines"), i)), "\n")
    changed = {
        "text": F.when(F.col("_drops").isNull(), F.col("text")).otherwise(left),
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")),
        "n_dropped": F.when(F.col("_drops").isNull(), 0).otherwise(F.size("_drops")),
    }
    return lost.withColumns(changed).select(*(F.col(name).alias(c) for c, name in taken.items()), "n_lines", "n_dropped")
