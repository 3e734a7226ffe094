"""Full-text search over an inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.functions import text as T

K1, B = 1.2, 0.75
#: Letters with marks and their plain forms, for the languages at hand.
MARKED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
SNIPPET = 12


def folded(text: Column) -> Column:
    """Lower case without the marks of MARKED."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def postings(docs: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Terms of each document (ref_id, body, and the columns ``also``) with their count, and the document's length."""
    keys = ["ref_id", *(also or [])]
    words = docs.select(*keys, T.tokens(folded(F.col("body"))).alias("w"))
    each = words.select(*keys, F.size("w").alias("length"), F.explode("w").alias("term"))
    return each.groupBy(*keys, "length", "term").agg(F.count("*").alias("tf"))


def _prefixes(spark: SparkSession, query: str) -> tuple[list[str], DataFrame | None]:
    """The words of a query, and a table of their folded forms; none for a query without a word."""
    wanted = T.prefix_query(query)
    if not wanted:
        return [], None
    terms = spark.createDataFrame([(i, w) for i, w in enumerate(wanted)], "word int, prefix string").select("word", folded(F.col("prefix")).alias("prefix"))
    return wanted, terms


def _ranked(hits: DataFrame, lengths: DataFrame, words: int, limit: int) -> DataFrame:
    """ref_id, score and rank of the documents that every one of ``words`` hits (ref_id, length, word, tf); ``lengths`` has ``length`` of all."""
    whole = lengths.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    often = hits.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.greatest(F.lit(1e-6), F.ln((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    # ``often`` has a row for each word of the query, ``whole`` one.
    scored = hits.join(F.broadcast(often), "word").join(F.broadcast(whole)).groupBy("ref_id").agg(F.round(F.sum(part), 9).alias("score"), F.count("*").alias("words"))
    best = scored.where(F.col("words") == words).orderBy(F.desc("score"), "ref_id").limit(limit)
    return best.select("ref_id", "score", F.row_number().over(Window.orderBy(F.desc("score"), "ref_id")).alias("rank"))


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "ref_id string, score double, rank int")


def search(docs: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """The best documents in which every word of the query begins some word, by bm25.

    Odd queries are only words here and never fail; one without a word finds nothing. Returns
    ref_id, score and rank from 1, ties by ref_id. ``limit`` is the feature: the top of the list.
    The postings are made for this query alone; ``SearchIndex`` keeps them.
    """
    wanted, terms = _prefixes(docs.sparkSession, query)
    if not wanted:
        return _nothing(docs.sparkSession)
    hits = postings(docs).join(F.broadcast(terms), F.startswith(F.col("term"), F.col("prefix"))).groupBy("ref_id", "length", "word").agg(F.sum("tf").alias("tf"))
    lengths = docs.select(F.size(T.tokens(folded(F.col("body")))).alias("length"))
    return _ranked(hits, lengths, len(wanted), limit)


class SearchIndex:
    """An inverted index in a folder, changed by document and read by prefix.

    ``postings`` (batch, head, term, ref_id, length, tf) is partitioned by batch and by the term's first HEAD
    characters, so that a search reads the partitions of its words alone. Each change is a batch: the
    postings of changed documents, and a row in ``documents`` (ref_id, length, gone) for each. A document is what
    its latest batch says; earlier postings of it no longer count. A batch counts once its number
    is in ``commits``, which is written last, so a change that fails midway, or is read meanwhile, is not
    there. One writer at a time. ``compact`` writes the live rows as one batch of a new folder.
    """

    HEAD = 2

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def batches(self) -> list[int]:
        """Numbers of the committed batches; none before the first change."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return sorted(r["batch"] for r in self._read("commits", "batch int").collect())

    def change(self, docs: DataFrame, gone: DataFrame | None = None) -> int:
        """Adds or replaces documents (ref_id, body; each ref_id once), and removes those of ``gone`` (ref_id); the new batch's number.

        The same change made again leaves the same index.
        """
        done = self.batches()
        number = done[-1] + 1 if done else 0
        made = docs.select(F.col("ref_id").cast("string").alias("ref_id"), "body")
        terms = postings(made).withColumn("head", F.substring("term", 1, self.HEAD))
        # A rebalance splits a head that a common term fills.
        terms.hint("rebalance", F.col("head")).write.mode("overwrite").partitionBy("head").parquet(f"{self.folder}/postings/batch={number}")
        rows = made.select("ref_id", F.size(T.tokens(folded(F.col("body")))).alias("length"), F.lit(False).alias("gone"))
        if gone is not None:
            rows = rows.union(gone.select(F.col("ref_id").cast("string"), F.lit(0), F.lit(True)).distinct().join(made.select("ref_id"), "ref_id", "left_anti"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/documents/batch={number}")
        self.spark.range(1).select(F.lit(number).alias("batch")).coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return number

    def documents(self) -> DataFrame:
        """ref_id, length and batch of each live document."""
        rows = self._read("documents", "ref_id string, length int, gone boolean, batch int").where(F.col("batch").isin(self.batches()))
        last = rows.groupBy("ref_id").agg(F.max_by(F.struct("length", "gone", "batch"), "batch").alias("d"))
        return last.select("ref_id", "d.*").where("not gone").drop("gone")

    def hits(self, words: list[str]) -> DataFrame:
        """Postings of terms that begin with a folded word, as ``word`` (its place), from the partitions of these words."""
        rows = self._read("postings", "term string, ref_id string, length int, tf long, head string, batch int").where(F.col("batch").isin(self.batches()))
        within = F.lit(False)
        for w in words:
            within = within | (F.col("head") == w[: self.HEAD] if len(w) >= self.HEAD else F.startswith(F.col("head"), F.lit(w)))
        places = F.filter(F.array(*(F.when(F.startswith(F.col("term"), F.lit(w)), i) for i, w in enumerate(words))), lambda i: i.isNotNull())
        return rows.where(within).select("ref_id", "batch", "length", "tf", F.explode(places).alias("word"))

    def search(self, query: str, limit: int = 50) -> DataFrame:
        """As ``search`` of this module, over the live documents."""
        wanted, terms = _prefixes(self.spark, query)
        if not wanted or not self.batches():
            return _nothing(self.spark)
        words = [r["prefix"] for r in terms.orderBy("word").collect()]  # the query's own words
        live = self.documents()
        found = self.hits(words).join(live.select("ref_id", "batch"), ["ref_id", "batch"], "left_semi")
        return _ranked(found.groupBy("ref_id", "length", "word").agg(F.sum("tf").alias("tf")), live, len(words), limit)

    def compact(self, folder: str) -> SearchIndex:
        """The live rows as the only batch of an index in another folder, which must be new."""
        other, live = SearchIndex(self.spark, folder), self.documents()
        rows = self._read("postings", "term string, ref_id string, length int, tf long, head string, batch int").where(F.col("batch").isin(self.batches()))
        kept = rows.join(live.select("ref_id", "batch"), ["ref_id", "batch"], "left_semi").drop("batch")
        kept.hint("rebalance", F.col("head")).write.partitionBy("head").parquet(f"{other.folder}/postings/batch=0")
        live.select("ref_id", "length", F.lit(False).alias("gone")).write.parquet(f"{other.folder}/documents/batch=0")
        self.spark.range(1).select(F.lit(0).alias("batch")).coalesce(1).write.parquet(f"{other.folder}/commits")
        return other


def snippet(body: Column, query: str, size: int = SNIPPET) -> Column:
    """``size`` words from the first hit on, hits in brackets, with dots where text is left out."""
    wanted = T.prefix_query(query)
    words = F.filter(F.split(body, "\\s+"), lambda w: w != "")

    def hit(word: Column) -> Column:
        found = F.lit(False)
        for w in wanted:
            found = found | F.startswith(F.regexp_replace(folded(word), T.NOT_ALNUM, ""), folded(F.lit(w)))
        return found

    flags = F.transform(words, hit)
    first = F.greatest(F.array_position(flags, F.lit(True)), F.lit(1)).cast("int")
    part = F.slice(words, first, size)
    marked = F.array_join(F.transform(part, lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")
    return F.concat(F.when(first > 1, "…").otherwise(""), marked, F.when(F.size(words) > first + size - 1, "…").otherwise(""))


def index_sources(finals: DataFrame, captions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Rows of the search index from three tables with meeting_id, ref_id and body; of captions the final ones."""
    kinds = (("final", finals), ("caption", captions.where("phase = 'final'")), ("artifact", artifacts))
    parts = [df.select("meeting_id", F.lit(kind).alias("kind"), F.col("ref_id").cast("string").alias("ref_id"), "body") for kind, df in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
