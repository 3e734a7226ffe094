"""Exact top-k inner product search with a metric tree of pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import kernels as K
from parley.llm import storage

SCALE = 1024
#: Rows of a page; children of a node at most; expected rows that a node's routing objects are chosen from.
PAGE_ROWS, FANOUT, SAMPLE = 1024, 64, 512
#: Splits one below the other at most; a page that is still too large is then dealt over parts.
LEVELS = 9
#: Rows that a task routes, and queries that a task leads through a page, about.
ROUTED_ROWS, QUERY_ROWS = 16384, 512
#: Pages that a query visits in a round: one until it has k rows, then this many times more each round.
GROWTH = 8
#: Unit roundoff of doubles; scores themselves are whole numbers.
ROUNDOFF = 2.0**-53
#: Least and greatest score: one beyond is given as the nearer of them.
LEAST, GREATEST = -(1 << 63) + 1, (1 << 63) - 1
ROOT = 1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column, shorter ones filled up with 0."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), width))
    rows = np.repeat(np.arange(len(size)), size)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def whole_vectors(table: DataFrame) -> DataFrame:
    """vec_id and floor(1024 x) of each component; rows with null or non-finite components are left out."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)  # noqa: E731; larger doubles are whole
    return table.where(sound).select(F.col("vec_id").cast("long"), F.transform(x, lambda c: whole(c * SCALE)).alias("v"))


class Space:
    """Points lifted to one norm, so that a larger inner product with a query is a smaller distance to it.

    d(q, x)^2 = |q|^2 + norm^2 - 2 <q, x>, where x has a further component that brings it to ``norm``
    and q has a 0 there. Distances between points use the same further component. ``code`` is the
    number type that whole vectors are stored in.
    """

    def __init__(self, norm: float, width: int, code: str) -> None:
        self.norm, self.width, self.code = norm, width, code

    def pack(self, x: np.ndarray) -> list[bytes]:
        return [row.tobytes() for row in x.astype(self.code)]

    def unpack(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), self.code).reshape(len(column), self.width).astype(float)

    def points(self, column: pa.Array) -> np.ndarray:
        """Routing objects, which are stored lifted."""
        return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), self.width + 1)

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))))

    def flat(self, q: np.ndarray) -> np.ndarray:
        return np.column_stack((q, np.zeros(len(q))))

    def reach(self, squares: Column, kth: Column) -> Column:
        """Distance from a query of that sum of squares within which all points of at least that score lie; infinite without one.

        A squared distance, and what the further component adds to it, are wrong by at most
        (4 width + 32) roundoffs of the squares that it is made of, and a root by no more than the root of
        that. A bound is made of four such distances at most (to a router, its parent distance, its radius,
        and this one), so five of those errors are added.
        """
        whole = squares + self.norm**2
        error = F.sqrt((4 * self.width + 32) * ROUNDOFF * whole)
        return F.when(kth.isNull(), float("inf")).otherwise(F.sqrt(F.greatest(whole - 2 * kth, F.lit(0.0))) + 5 * error + 1e-6)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return np.sqrt(np.maximum(squared, 0))


def scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, exact: in whole numbers of any size where doubles would round."""
    if np.abs(rows).max(initial=0) * np.abs(query).sum() < 2**53:
        return (rows @ query).astype(np.int64)
    q = [int(x) for x in query]
    whole = (sum(int(a) * b for a, b in zip(row, q, strict=True)) for row in rows)
    return np.array([min(max(x, LEAST), GREATEST) for x in whole], np.int64)


def choose_routers(points: np.ndarray, most: int) -> np.ndarray:
    """Places of different points: every other one is the farthest from those before, the rest are as they come."""
    chosen, near, at = [0], distances(points, points[:1])[:, 0], 1
    while len(chosen) < most and near.max() > 1e-6:
        if len(chosen) % 2:
            pick = int(near.argmax())
        else:
            while near[at] <= 1e-6:
                at += 1
            pick = at
        chosen.append(pick)
        near = np.minimum(near, distances(points, points[pick : pick + 1])[:, 0])
    return np.array(chosen)


_ROW = "node long, part int, block int, asks boolean, id long, key long, v binary, d double, r double, kth long"
_KEY = ["node", "part", "block"]


def _row(**columns: Column | str) -> list[Column]:
    """The columns of _ROW; those that are not given are null, 0 or false."""
    kinds = dict(c.split(" ") for c in _ROW.split(", "))
    empty = {"part": F.lit(0), "block": F.lit(0), "asks": F.lit(False)}
    made = {name: columns.get(name, empty.get(name, F.lit(None))) for name in kinds}
    return [(F.col(c) if isinstance(c, str) else c).cast(kinds[name]).alias(name) for name, c in made.items()]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.RecordBatch]]:
    """Each page with the rows that ask it, in batches sorted by page, in which a page's own rows come first."""
    key, parts, page = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in _KEY] + [batch.column("asks").to_numpy(zero_copy_only=False).astype(np.int64)])
        edge = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edge, edge[1:], strict=False):
            here, asks = tuple(keys[:3, a].tolist()), bool(keys[3, a])
            if here != key:
                key, parts, page = here, [], None
            if not asks:
                parts.append(batch.slice(a, b - a))
                continue
            if page is None:
                page = pa.Table.from_batches(parts, batch.schema).combine_chunks()
            yield page, batch.slice(a, b - a)


def _meet(pages: DataFrame, asking: DataFrame) -> DataFrame:
    """Pages and the rows that ask them (both as _ROW), together and in order; a page's rows by their parent distance."""
    return pages.union(asking).repartition(*_KEY).sortWithinPartitions(*_KEY, "asks", "d")


def build(rows: DataFrame, space: Space) -> tuple[DataFrame, DataFrame, int]:
    """Grows the tree by distributed splits.

    ``rows`` has id, v and d, the distance from the root. A node of more than PAGE_ROWS rows is
    split: routing objects are chosen from a sample of its rows, and every row goes to the nearest,
    which gives its parent distance; the greatest of those is the child's covering radius. All
    nodes of a level are split at once, and a node's rows over several tasks. Returns the children
    of inner nodes (node, id, v, d, r) and the rows of leaves (node, id, v, d), where d is the
    distance from the node's own routing object, and the number of levels.
    """
    spark = rows.sparkSession
    rows = rows.select(F.lit(ROOT).cast("long").alias("node"), "id", "v", "d")
    inner = spark.createDataFrame([], "node long, id long, v binary, d double, r double")
    K.ship(spark)

    def choose(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("draw").to_numpy())
        table = table.take(pa.array(order))
        points = space.lift(space.unpack(table.column("v").combine_chunks()))
        at = choose_routers(points, min(FANOUT, max(2, 2 * table.column("n")[0].as_py() // PAGE_ROWS)))
        node = table.column("node")[0].as_py()
        ids = node * FANOUT + np.arange(len(at)) if len(at) > 1 else np.zeros(0, np.int64)
        at = at[: len(ids)]
        columns = [pa.array(np.full(len(ids), node)), pa.array(ids), pa.array([p.tobytes() for p in points[at]], pa.binary()), table.column("d").combine_chunks().take(pa.array(at))]
        return pa.Table.from_arrays(columns, ["node", "id", "v", "d"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page, asks in _meetings(batches):
            d = distances(space.lift(space.unpack(asks.column("v"))), space.points(page.column("v").chunk(0)))
            ids = page.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[d.argmin(1)]), asks.column("id"), asks.column("v"), pa.array(d.min(1))], ["node", "id", "v", "d"])

    for level in range(LEVELS):
        big = storage.written(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > PAGE_ROWS))
        if big.isEmpty():
            return inner, rows, level
        large = rows.join(storage.limited_broadcast(big), "node")
        draw = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 40)) / F.lit(float(1 << 40))
        sample = large.withColumn("draw", draw).where(F.col("draw") * F.col("n") < SAMPLE)
        routers = storage.written(sample.groupBy("node").applyInArrow(choose, "node long, id long, v binary, d double"))
        split = storage.limited_broadcast(storage.written(routers.select("node").distinct().join(big, "node").withColumn("blocks", F.ceil(F.col("n") / ROUTED_ROWS).cast("int"))))
        copies = routers.join(split, "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*_row(node="node", block="block", id="id", v="v", d="d"))
        moving = rows.join(split, "node").select(*_row(node="node", block=F.pmod(F.xxhash64("id"), F.col("blocks")), asks=F.lit(True), id="id", v="v", d="d"))
        moved = _meet(copies, moving).mapInArrow(nearest, "node long, id long, v binary, d double")
        rows = storage.written(moved.union(rows.join(split, "node", "left_anti")))
        radii = rows.groupBy(F.col("node").alias("id")).agg(F.max("d").alias("r"))
        inner = inner.union(storage.written(routers.join(radii, "id").select("node", "id", "v", "d", "r")))
    return inner, rows, LEVELS


def top_k(table: DataFrame, k: int = 10, every: int = 100, report: list[dict] | None = None) -> DataFrame:
    """The k rows of highest inner product with each query row; exact.

    Takes vec_id and embedding; queries are the rows whose vec_id is divisible by ``every``, and all
    rows but those of the query's own id are candidates. Components become floor(1024 x) and the
    score is the integer inner product, exact; one beyond 64 bits is given, and ranked, as the nearest
    64-bit number. Returns query_id, rank from 1,
    vec_id and score, ties to the smaller vec_id; fewer rows where there are fewer candidates.
    Vectors that are null or hold null or non-finite components take no part; a shorter vector counts
    as filled up with 0. Repeated candidate rows count each; a repeated query row counts once. An
    empty table gives no rows; other columns are not read.

    Of equal vectors only the rows that can be among a query's first k stay: those of the k + 1
    smallest ids, k of each id. The others are indexed by ``build``, and each query searches the tree
    best first, in rounds: its queue holds nodes by their least possible distance; in a round it
    visits the first few of them. From an inner node it gets the children that its reach, the distance
    that the k-th best row so far allows, can meet; from a leaf, better rows. Children and rows whose
    stored parent distance already rules them out are passed over without a computation. It ends
    when no node in the queue is within reach. ``report``, if given, gets the nodes and pages
    visited and the distances computed and passed over in each round.
    """
    spark = table.sparkSession
    vectors = whole_vectors(table)
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)
    vectors = storage.written(vectors.withColumn("squares", squares))
    most = vectors.agg(F.max("squares").alias("m"), F.max(F.size("v")).alias("w"), F.max(F.array_max(F.transform("v", F.abs))).alias("a")).first()
    width, top = int(most["w"] or 0), most["a"] or 0.0
    space = Space(float(np.sqrt(most["m"] or 0.0)), width, "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = space.pack(_matrix(batch.column("v"), width)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(v, pa.binary()), batch.column("squares")], ["id", "v", "squares"])

    packed = storage.written(K.map_batches(vectors, pack, "id long, v binary, squares double").withColumn("key", F.xxhash64("v")))
    asking = storage.written(packed.where(F.col("id") % every == 0).dropDuplicates(["id", "v"]).withColumn("key", F.xxhash64("id", "v")))
    of_id = F.row_number().over(Window.partitionBy("key", "v", "id").orderBy("id"))
    of_vector = F.dense_rank().over(Window.partitionBy("key", "v").orderBy("id"))
    few = packed.withColumn("_n", of_id).where(F.col("_n") <= k).withColumn("_n", of_vector).where(F.col("_n") <= k + 1)
    last = F.sqrt(F.greatest(F.lit(space.norm**2) - F.col("squares"), F.lit(0.0))) - space.norm
    inner, leaves, levels = build(storage.written(few.select("id", "v", F.sqrt(F.col("squares") + last * last).alias("d"))), space)

    large = leaves.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > 2 * PAGE_ROWS)
    large = storage.written(large.select("node", F.ceil(F.col("n") / PAGE_ROWS).cast("int").alias("parts")))
    dealt = leaves.join(storage.limited_broadcast(large), "node", "left")
    pages = dealt.select(*_row(node="node", part=F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)), id="id", v="v", d="d"))
    pages = storage.written(pages.union(inner.select(*_row(node="node", id="id", v="v", d="d", r="r"))))

    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    queue = asking.select("key", F.lit(ROOT).cast("long").alias("node"), F.sqrt(F.col("squares") + space.norm**2).alias("d"), F.lit(0.0).alias("bound"))
    best = storage.written(spark.createDataFrame([], "key long, vec_id long, score long, rank int"))
    turn, many = 0, 1
    while True:
        # Below the least score there may be others that count as equal.
        kth = best.where((F.col("rank") == k) & (F.col("score") > LEAST)).select("key", F.col("score").alias("kth"))
        known = asking.join(kth, "key", "left").withColumn("reach", space.reach(F.col("squares"), F.col("kth")))
        live = queue.join(known.select("key", "reach"), "key").where(F.col("bound") <= F.col("reach")).drop("reach")
        place = F.row_number().over(Window.partitionBy("key").orderBy("bound", "d", "node"))
        ranked = storage.written(live.withColumn("place", place))
        chosen = ranked.where(F.col("place") <= many)
        at = storage.written(chosen.groupBy("node").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"), F.count("*").alias("n")))
        visits = at.agg(F.sum("n"), F.count("*")).first()
        if not visits[0]:
            break
        here = storage.limited_broadcast(at)
        sent = chosen.join(here, "node").join(storage.limited_broadcast(large), "node", "left").join(known.drop("d"), "key")
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
        sent = sent.select(*_row(node="node", part="part", block=F.pmod(F.xxhash64("key"), F.col("blocks")), asks=F.lit(True), id="id", key="key", v="v", d="d", r="reach", kth="kth"))
        met = pages.drop("block").join(here, "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.select(*_row(**{c: c for c in ("node", "part", "block", "id", "v", "d", "r")}))
        found = storage.written(_meet(met, sent).mapInArrow(_visit(space, k), "key long, node long, d double, bound double, vec_id long, score long, computed long, passed long"))
        if report is not None:
            done = found.agg(F.sum("computed"), F.sum("passed")).first()
            report.append({"visits": visits[0], "pages": visits[1], "computed": done[0], "passed": done[1]})
        queue = ranked.where(F.col("place") > many).drop("place").union(found.where("node is not null").select("key", "node", "d", "bound"))
        rows = best.drop("rank").union(found.where("vec_id is not null").select("key", "vec_id", "score"))
        best = storage.written(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        turn += 1
        many = 1 if turn <= levels else many * GROWTH
    return best.join(asking.select("key", F.col("id").alias("query_id")), "key").select("query_id", "rank", "vec_id", "score")


def _visit(space: Space, k: int):
    """Leads queries through pages: children and rows within reach, without computing those that their parent distance rules out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = points = None
        for page, asks in _meetings(batches):
            if not page.num_rows:
                continue
            v = page.column("v").chunk(0)
            ids, parent, radius = (page.column(c).to_numpy() for c in ("id", "d", "r"))
            leaf = page.column("r").null_count > 0
            if held is not page:
                held, points = page, space.unpack(v) if leaf else space.points(v)
            q = space.unpack(asks.column("v"))
            own, key = asks.column("id").to_numpy(), asks.column("key").to_numpy()
            d, reach = asks.column("d").to_numpy(), asks.column("r").to_numpy()
            kth = asks.column("kth").to_numpy(zero_copy_only=False).astype(float)
            out: list[tuple] = []
            if leaf:
                low, high = np.searchsorted(parent, d - reach, side="left"), np.searchsorted(parent, d + reach, side="right")
                for i in range(len(q)):
                    a, b = low[i], high[i]
                    score, row = scores(points[a:b], q[i]), ids[a:b]
                    keep = row != own[i]
                    if not np.isnan(kth[i]):
                        keep &= score >= kth[i]
                    score, row = score[keep], row[keep]
                    if len(score) > k:
                        rows = np.lexsort((row, -score))[:k]
                        score, row = score[rows], row[rows]
                    out.append((key[i], b - a, len(parent) - (b - a), row, score))
                yield _found(out, leaf=True)
            else:
                flat = space.flat(q)
                near = np.abs(d[:, None] - parent) - radius <= reach[:, None]
                for i in range(len(q)):
                    at = np.flatnonzero(near[i])
                    far = distances(flat[i : i + 1], points[at])[0]
                    bound = np.maximum(far - radius[at], 0)
                    keep = bound <= reach[i]
                    out.append((key[i], len(at), len(parent) - len(at), ids[at][keep], far[keep], bound[keep]))
                yield _found(out, leaf=False)

    return run


def _found(out: list[tuple], leaf: bool) -> pa.RecordBatch:
    """Rows or children found for each query, and a row with what was computed and passed over."""
    n = sum(len(o[3]) for o in out)
    keys = np.repeat([o[0] for o in out], [len(o[3]) for o in out]).astype(np.int64)
    first, second = (np.concatenate([o[j] for o in out]) for j in (3, 4))
    third = None if leaf else np.concatenate([o[5] for o in out])
    none = lambda kind, m=n: pa.nulls(m, kind)
    node, d, bound = (none(pa.int64()), none(pa.float64()), none(pa.float64())) if leaf else (pa.array(first), pa.array(second), pa.array(third))
    vec_id, score = (pa.array(first), pa.array(second)) if leaf else (none(pa.int64()), none(pa.int64()))
    columns = [pa.array(keys), node, d, bound, vec_id, score]
    totals = [sum(int(o[j]) for o in out) for j in (1, 2)]
    last = [pa.nulls(1, c.type) for c in columns]
    whole = [pa.concat_arrays([c, e]) for c, e in zip(columns, last, strict=True)]
    counts = [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([t], pa.int64())]) for t in totals]
    return pa.RecordBatch.from_arrays([*whole, *counts], ["key", "node", "d", "bound", "vec_id", "score", "computed", "passed"])
