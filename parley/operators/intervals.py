"""Joins of intervals by overlap, through time buckets.

An overlap join is an equi-join here: each interval is listed under every bucket that it touches,
and a pair counts in the first bucket that both touch. A hot meeting is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import scalars
from parley.functions import text as T
from parley.sources.shared import written

BUCKET_MS = 60_000


def bucketed(df: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Each interval [start_ms, end_ms) under every bucket that it touches."""
    first = F.floor(F.col("start_ms") / bucket_ms)
    last = F.floor(F.greatest(F.col("start_ms"), F.col("end_ms") - 1) / bucket_ms)
    return df.withColumn("_first", first).withColumn("_bucket", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of intervals with equal keys and more than 0 ms in common.

    Columns of the right side other than keys get the prefix ``r_``; ``overlap`` is the common time.
    Intervals without length overlap nothing.
    """
    a, b = bucketed(left, bucket_ms), bucketed(right, bucket_ms)
    renamed = b.select(*keys, "_bucket", F.col("_first").alias("r__first"), *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys))
    common = scalars.overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("r_start_ms"), F.col("r_end_ms"))
    pairs = a.join(renamed, [*keys, "_bucket"]).where(F.col("_bucket") == F.greatest("_first", "r__first"))
    return pairs.withColumn("overlap", common).where("overlap > 0").drop("_bucket", "_first", "r__first")


def best_twin(left: DataFrame, right: DataFrame, similarity: Column, keys: list[str], row: list[str], tie: str) -> DataFrame:
    """The best overlapping partner of each left row, by similarity, then overlap, then smallest ``tie``.

    Only left rows with a partner are returned; the caller's threshold comes after the choice.
    """
    pairs = overlap_join(left, right, keys).withColumn("similarity", similarity)
    return best_pair(pairs, [*keys, *row], "overlap", tie)


def best_pair(pairs: DataFrame, by: list[str], then: str, tie: str) -> DataFrame:
    """The pair of each left row that is greatest by similarity, then by ``then``, then least by ``tie``; an aggregate with a partial step."""
    kept = [c for c in pairs.columns if c not in by]
    best = pairs.groupBy(*by).agg(F.max_by(F.struct(*kept), F.struct("similarity", then, (-F.col(tie)).alias("tie"))).alias("best"))
    return best.select(*by, "best.*")


#: Similarities, in per cent, down to which far partners are looked for round by round.
FAR_PERCENTS = (50, 25, 10, 0)
#: Partners up to which all pairs of a meeting are compared at once: so many pairs of a row at most.
FEW_PARTNERS = 16


def _ranked_tokens(rows: DataFrame, frequency: DataFrame, keys: list[str], row: list[str]) -> DataFrame:
    """Words of each row, told apart by their occurrence, with their place from the rarest on and their number."""
    words = rows.select(*keys, *row, F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))
    turn = F.row_number().over(Window.partitionBy(*keys, *row, "word").orderBy("at"))
    tokens = words.withColumn("turn", turn).join(frequency, [*keys, "word", "turn"])
    place = F.row_number().over(Window.partitionBy(*keys, *row).orderBy("many", "word", "turn"))
    return written(tokens.select(*keys, *row, "n", "word", "turn", place.alias("place")))


def far_twin(left: DataFrame, right: DataFrame, keys: list[str], row: list[str], tie: str, gap_ms: int = 30_000, report: list[int] | None = None, few: int = FEW_PARTNERS) -> DataFrame:
    """The best partner at least ``gap_ms`` away, within the keys: a control group for J1.

    Best is greatest by similarity of the whole arrays ``words`` (returned with nine places), then by gap,
    then least by ``tie``. Keys with up to ``few`` right rows have all their pairs compared, which needs no
    words apart. Elsewhere, two rows of similarity s have s of the longer one's words in common, so they share one
    of the rarest words of each, and all but that share of words may be left out of the join. The search begins at half,
    and goes down for rows that have found nothing so good; a row whose partners all have similarity
    0 gets the farthest, which is at an end of its meeting. No pair without a common word is made there.
    ``report`` gets the number of pairs that each round compared.
    """
    gap = scalars.gap_ms(F.col("start_ms"), F.col("end_ms"), F.col("r_start_ms"), F.col("r_end_ms"))
    similarity = T.word_similarity(F.col("words"), F.col("r_words"), None)
    partners = lambda df: df.select(*keys, *(F.col(c).alias(f"r_{c}") for c in (tie, "start_ms", "end_ms", "words")))
    side = lambda df, cols: written(df.select(*keys, *cols, "start_ms", "end_ms", "words"))
    mine, theirs = side(left, row), side(right, [tie])
    large = written(theirs.groupBy(*keys).count().where(F.col("count") > few).select(*keys))
    pairs = mine.join(large, keys, "left_anti").join(partners(theirs.join(large, keys, "left_anti")), keys).withColumn("gap", gap).where(F.col("gap") >= gap_ms)
    at_once = best_pair(pairs.select(*keys, *row, f"r_{tie}", "gap", similarity.alias("similarity")), [*keys, *row], "gap", f"r_{tie}").select(*keys, *row, f"r_{tie}", "gap", "similarity")
    # From here on, the keys with more.
    mine, theirs = written(mine.join(large, keys, "left_semi")), written(theirs.join(large, keys, "left_semi"))
    each = lambda df, cols: df.select(*keys, *cols, F.explode("words").alias("word")).groupBy(*keys, *cols, "word").agg(F.count("*").alias("_n"))
    counts = each(mine, row).select(*keys, "word", "_n").union(each(theirs, [tie]).select(*keys, "word", "_n"))
    # How many rows have a word at least so often.
    frequency = counts.select(*keys, "word", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("turn")).groupBy(*keys, "word", "turn").agg(F.count("*").alias("many"))
    frequency = written(frequency)
    a, b = _ranked_tokens(mine, frequency, keys, row), _ranked_tokens(theirs, frequency, keys, [tie])
    other, open_rows, found = partners(theirs), mine, at_once
    for percent in FAR_PERCENTS:
        needed = F.greatest(F.ceil(F.col("n") * percent / 100), F.lit(1))
        rare = lambda df: df.where(F.col("place") <= F.col("n") - needed + 1)  # noqa: B023, E731
        asked = rare(a.join(open_rows.select(*keys, *row), [*keys, *row], "left_semi")).withColumnRenamed("n", "_n")
        met = asked.drop("place").join(rare(b).drop("place").withColumnRenamed(tie, f"r_{tie}"), [*keys, "word", "turn"])
        met = met.where(100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")).select(*keys, *row, f"r_{tie}").distinct()
        # Few bytes but long work: bare pairs are dealt to all tasks, which fetch their words.
        met = met.repartition(int(mine.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        pairs = met.join(mine, [*keys, *row]).join(other, [*keys, f"r_{tie}"]).withColumn("gap", gap).where(F.col("gap") >= gap_ms)
        pairs = pairs.select(*keys, *row, f"r_{tie}", "gap", similarity.alias("similarity"))
        if report is not None:
            report.append(pairs.count())
        best = best_pair(pairs, [*keys, *row], "gap", f"r_{tie}")
        best = written(best.where((F.col("similarity") > 0) & (100 * F.round("similarity", 9) >= percent)).select(*keys, *row, f"r_{tie}", "gap", "similarity"))
        found = found.union(best)
        open_rows = written(open_rows.join(best, [*keys, *row], "left_anti"))
    return found.union(_farthest(open_rows, theirs, keys, row, tie, gap_ms)).withColumn("similarity", F.round("similarity", 9))


def _farthest(rows: DataFrame, others: DataFrame, keys: list[str], row: list[str], tie: str, gap_ms: int) -> DataFrame:
    """Of each row the other one with the widest gap, from the ends of each key's intervals, as pairs of similarity 0."""
    least = F.col(tie)
    long = F.col("start_ms") - F.col("end_ms")
    ends = others.groupBy(*keys).agg(
        F.min(F.struct((-F.col("start_ms")).alias("v"), least.alias("t"))).alias("_late"),
        F.min(F.struct(F.col("end_ms").alias("v"), least.alias("t"))).alias("_early"),
        F.min(F.struct((-long).alias("v"), least.alias("t"))).alias("_back"),
        F.min(least).alias("_any"),
    )
    both = rows.join(ends, keys)
    ways = [(-F.col("_late.v") - F.col("end_ms"), F.col("_late.t")), (F.col("start_ms") - F.col("_early.v"), F.col("_early.t")), (-F.col("_back.v"), F.col("_back.t")), (F.col("start_ms") - F.col("end_ms"), F.col("_any"))]
    widest = F.greatest(*(g for g, _ in ways))
    who = F.least(*(F.when(g == widest, t) for g, t in ways))
    return both.where(widest >= gap_ms).select(*keys, *row, who.alias(f"r_{tie}"), widest.alias("gap"), F.lit(0.0).alias("similarity"))


def total_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Summed overlap over all pairs, for each key."""
    return overlap_join(left, right, keys).groupBy(*keys).agg(F.sum("overlap").alias("overlap_ms"))


def overlap_matrix(labels: DataFrame, turns: DataFrame, keys: list[str]) -> DataFrame:
    """Common time of each speaker with each cluster."""
    return overlap_join(labels, turns, keys).groupBy(*keys, "speaker_id", F.col("r_cluster").alias("cluster")).agg(F.sum("overlap").alias("ms"))


def doubled(left: DataFrame, right: DataFrame, similarity: Column, keys: list[str], row: list[str], threshold: float) -> DataFrame:
    """Left rows that some overlapping right row resembles at least so much."""
    hits = overlap_join(left, right, keys).where(similarity >= threshold).select(*keys, *row).distinct()
    return left.join(hits, [*keys, *row], "left_semi")


def owner_class(windows: DataFrame, owner: DataFrame, others: DataFrame, keys: list[str], row: list[str]) -> DataFrame:
    """Whether a window overlaps the owner's spans, the others', both or neither."""
    mine = overlap_join(windows, owner, keys).select(*keys, *row).distinct().withColumn("_mine", F.lit(True))
    theirs = overlap_join(windows, others, keys).select(*keys, *row).distinct().withColumn("_theirs", F.lit(True))
    both = windows.join(mine, [*keys, *row], "left").join(theirs, [*keys, *row], "left")
    kind = F.when(F.col("_mine") & F.col("_theirs"), "both").when(F.col("_mine"), "owner").when(F.col("_theirs"), "others").otherwise("neither")
    return both.withColumn("kind", kind).drop("_mine", "_theirs")
