"""Near-duplicate documents by an inverted join over MinHash signature coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import components, storage
from parley.llm import kernels as K

#: Coordinates of a signature; all of them are posted.
COORDINATES = 64
#: Probability that a pair at the asked similarity has too few collisions, at most.
MISSED = 1e-6
#: Members of a posting list, or of one of its parts, that are compared within a task, and their shingles, about.
PART_ROWS, PART_SHINGLES = 1500, 1_000_000
#: Members that a task compares with one hub, about.
HUB_ROWS = 2000
#: Coordinates that are compared before pairs without a chance are skipped.
SKIP_AFTER = 16
COLUMNS_AT_ONCE = 4096
_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGNED = "doc_id long, n_shingles long, print1 long, print2 long, posted array<long>"
_NODE = ["doc_id", "print1"]


def match_threshold(percent: int, missed: float = MISSED) -> int:
    """Most collisions that a pair of that similarity has with a probability of 1 - ``missed`` or more, by the binomial distribution."""
    share, total, t = percent / 100, 0.0, 0
    while t < COORDINATES:
        total += math.comb(COORDINATES, t) * share**t * (1 - share) ** (COORDINATES - t)
        if total > missed:
            break
        t += 1
    return t


def shingle_sets(array: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, in one array with its bounds.

    A text of fewer than ``width`` words has one shingle: all its words.
    """
    texts = K.Texts(array)
    data = K.LOWER[texts.data]
    start, end, owner = texts.words()
    hashes = K.span_hashes(data, start, end)
    value, at = K.windows(hashes, owner, width)
    whose = owner[at]
    n_words = np.bincount(owner, minlength=texts.n)
    for w in range(1, width):
        short = n_words[owner] == w
        if short.any():
            v, a = K.windows(hashes[short], owner[short], w)
            value, whose = np.concatenate((value, v)), np.concatenate((whose, owner[short][a]))
    order = np.lexsort((value, whose))
    value, whose = value[order], whose[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (whose[1:] != whose[:-1])
    value, whose = value[keep], whose[keep]
    return value, np.concatenate(([0], np.cumsum(np.bincount(whose, minlength=texts.n))))


def fingerprints(value: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, in two numbers."""
    full = np.flatnonzero(np.diff(ends))
    out = np.zeros((2, len(ends) - 1), np.uint64)
    if len(full):
        for row, salt in zip(out, (1, 2), strict=True):
            row[full] = np.add.reduceat(K.mix(value + np.uint64(salt)), ends[full])
    return out[0].view(np.int64), out[1].view(np.int64)


def signed(docs: DataFrame, width: int) -> DataFrame:
    """Set size, set fingerprint and signature of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch):
                value, ends = shingle_sets(block.column(1), width)
                size = np.diff(ends)
                full = np.flatnonzero(size)
                least = np.zeros((block.num_rows, COORDINATES), np.uint64)
                if len(full):
                    for k in range(COORDINATES):
                        least[full, k] = np.minimum.reduceat(value * _MULTIPLIERS[k], ends[full])
                place = np.arange(COORDINATES, dtype=np.uint64)
                keys = K.mix(least + place * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(COORDINATES - 1) | place  # the coordinate in the low bits
                posted = pa.ListArray.from_arrays(pa.array(np.arange(block.num_rows + 1) * COORDINATES, pa.int32()), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(size), *map(pa.array, fingerprints(value, ends)), posted], ["doc_id", "n_shingles", "print1", "print2", "posted"])

    return K.map_batches(docs, run, _SIGNED)


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, print1 and the whole shingle set of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch):
                value, ends = shingle_sets(block.column(1), width)
                sets = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(fingerprints(value, ends)[0]), sets], ["doc_id", "print1", "shingles"])

    return K.map_batches(docs, run, "doc_id long, print1 long, shingles array<long>")


def posting_lists(nodes: DataFrame, need: int) -> DataFrame:
    """Prefix postings of nodes under coordinate-value pairs: node, n_shingles, key, c and the mask of the node's prefix.

    Each node is posted under all its coordinates, by its number alone. Values that no other node has can't collide, and a
    node with fewer than ``need`` others has no partner. Of the rest two partners share one of their
    prefixes, which leave out the ``need`` - 1 most frequent values of each, by a global order.
    """
    post = nodes.select("node", F.explode("posted").alias("key"))
    often = storage.broadcast_if_small(post.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    shared = post.join(often, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("all"))
    prefix = shared.where(F.size("all") >= need).select("node", F.slice("all", F.lit(1), F.size("all") - need + 1).alias("prefix"))
    c = lambda key: key.bitwiseAND(F.lit(COORDINATES - 1)).cast("int")
    bit = F.aggregate("prefix", F.lit(0).cast("long"), lambda whole, x: whole.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c(x["key"]))))
    named = nodes.select("node", *_NODE, "n_shingles").join(storage.written(prefix.select("node", bit.alias("mask"), "prefix")), "node")
    return named.select(*_NODE, "n_shingles", "mask", F.explode("prefix.key").alias("key")).withColumn("c", c(F.col("key")))


def collisions(a: np.ndarray, b: np.ndarray, need: int) -> np.ndarray:
    """Which pairs of signature rows agree in ``need`` coordinates; pairs that can't any more are skipped."""
    alive, count = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k in range(0, COORDINATES, SKIP_AFTER):
        count = count + (a[alive, k : k + SKIP_AFTER] == b[alive, k : k + SKIP_AFTER]).sum(1)
        chance = count + max(0, COORDINATES - k - SKIP_AFTER) >= need
        alive, count = alive[chance], count[chance]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _with_signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posted keys as 32 bits of each, in one binary value."""
    for batch in batches:
        if batch.num_rows:
            keys = batch.column("posted").flatten().to_numpy().view(np.uint64).reshape(-1, COORDINATES)
            short = (keys >> np.uint64(32)).astype("<u4")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*_NODE, "n_shingles")), pa.array([row.tobytes() for row in short], pa.binary())], [*_NODE, "n_shingles", "signature"])


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def hub_links(postings: DataFrame, held: DataFrame, sets: DataFrame, percent: int, need: int) -> DataFrame:
    """Links of nodes with the hubs of their lists: doc_id, print1, hub_id, hub_print.

    A list's hub is its least node by a global order, so that a group of near copies has the same hub
    in most of its lists. A list of n members costs n comparisons. Pairs are counted once, whatever
    the number of their lists, and confirmed on whole sets.
    """
    hubs = postings.groupBy("key").agg(F.min(F.struct("print1", "doc_id")).alias("hub"))
    pairs = postings.join(hubs, "key").select(*_NODE, F.col("hub.doc_id").alias("hub_id"), F.col("hub.print1").alias("hub_print"))
    pairs = pairs.where((F.col("print1") != F.col("hub_print")) | ~F.col("doc_id").eqNullSafe(F.col("hub_id"))).distinct()
    other = held.select(F.col("doc_id").alias("hub_id"), F.col("print1").alias("hub_print"), F.col("n_shingles").alias("hub_n"), F.col("signature").alias("hub_signature"))
    alike = 100 * F.least("n_shingles", "hub_n") >= percent * F.greatest("n_shingles", "hub_n")
    both = pairs.join(other, ["hub_id", "hub_print"]).join(held, _NODE).where(alike)
    names = [*_NODE, "hub_id", "hub_print"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = collisions(_signatures(batch.column("signature")), _signatures(batch.column("hub_signature")), need)
                yield batch.select(names).filter(pa.array(ok))

    near = storage.written(K.map_batches(both.select(*names, "signature", "hub_signature"), counted, ", ".join(f"{c} long" for c in names)))
    blocks = storage.written(near.groupBy("hub_id", "hub_print").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("print1"), F.col("blocks")).cast("int")
    asking = near.join(blocks, ["hub_id", "hub_print"]).join(sets, _NODE).select("hub_id", "hub_print", block.alias("block"), F.lit(True).alias("asks"), *_NODE, "shingles")
    of_hub = blocks.join(sets, (F.col("hub_id") == F.col("doc_id")) & (F.col("hub_print") == F.col("print1")))
    of_hub = of_hub.select("hub_id", "hub_print", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"), *_NODE, "shingles")
    key = ["hub_id", "hub_print", "block"]

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for batch in batches:
            asks, lists = batch.column("asks").to_pylist(), batch.column("shingles")
            ends, value = lists.offsets.to_numpy(), lists.values.to_numpy()
            ok = np.zeros(batch.num_rows, bool)
            for i, asking in enumerate(asks):
                own = value[ends[i] : ends[i + 1]]
                if not asking:
                    hub = own.copy()  # a hub comes before those that ask for it
                else:
                    same = len(np.intersect1d(own, hub, assume_unique=True))
                    ok[i] = 100 * same >= percent * (len(own) + len(hub) - same)
            yield batch.select(names).filter(pa.array(ok))

    return of_hub.union(asking).repartition(*key).sortWithinPartitions(*key, "asks").mapInArrow(K.tidy(confirmed), ", ".join(f"{c} long" for c in names))


def cells(postings: DataFrame) -> DataFrame:
    """Lists whose members have several labels, cut into cells: a long list is dealt over parts, and each pair of its parts is a cell."""
    mixed = postings.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("n_shingles").alias("s")).where("low < high")
    parts = F.greatest(F.ceil(F.col("n") / PART_ROWS), F.ceil(F.col("s") / PART_SHINGLES)).cast("int")
    part = F.pmod(F.xxhash64(*_NODE), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = postings.join(mixed.select("key", parts.alias("parts")), "key").withColumn("part", part).select("*", other)
    return dealt.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).drop("parts", "other")


_CELL = ["key", "i", "j"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of one cell in batches sorted by cell."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(name).to_numpy() for name in _CELL])
        edge = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edge, edge[1:], strict=False):
            piece = batch.slice(a, b - a)
            if waiting and any(waiting[0].column(name)[0] != piece.column(name)[0] for name in _CELL):
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(piece)
    if waiting:
        yield pa.Table.from_batches(waiting)


def _passing(cell: pa.Table, percent: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a cell's rows above the match threshold whose first shared prefix value is this list's.

    Skips at once pairs of one label and pairs whose set sizes can't meet the similarity.
    """
    c, i, j = (cell.column(name)[0].as_py() for name in ("c", "i", "j"))
    part, size, label = (cell.column(name).to_numpy() for name in ("part", "n_shingles", "label"))
    mask = cell.column("mask").to_numpy()
    signature = _signatures(cell.column("signature"))
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    bits = np.int64(1) << np.arange(COORDINATES, dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at, a in enumerate(left):
        b = right[at + 1 :] if i == j else right
        b = b[(label[b] != label[a]) & (100 * np.minimum(size[b], size[a]) >= percent * np.maximum(size[b], size[a]))]
        b = b[collisions(signature[b], np.broadcast_to(signature[a], (len(b), COORDINATES)), need)]
        if len(b):
            common = np.where(signature[b] == signature[a], bits, 0).sum(1) & mask[b] & mask[a]
            b = b[(common & -common) == bits[c]]
            found.append((np.full(len(b), a), b))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _live_cells(percent: int, need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches):
            a, b = _passing(cell, percent, need)
            if len(a):
                yield from cell.take(pa.array(np.unique(np.concatenate((a, b))))).to_batches()

    return run


def _links(percent: int, need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _groups(batches):
            a, b = _passing(cell, percent, need)
            if not len(a):
                continue
            column = cell.column("shingles").combine_chunks()
            size = np.diff(column.offsets.to_numpy())
            same = shared_counts(column.flatten().to_numpy(), size, a, b)
            ok = 100 * same >= percent * (size[a] + size[b] - same)
            a, b = forest(a[ok], b[ok], len(size))
            ids = cell.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return run


def shared_counts(value: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Size of the intersection of the sets of each pair of rows."""
    owner = np.repeat(np.arange(len(size)), size)
    if len(a) < 4 * len(size):
        ends = np.concatenate(([0], np.cumsum(size)))
        sets = [value[ends[k] : ends[k + 1]] for k in range(len(size))]
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b, strict=True)], np.int64)
    _, place, count = np.unique(value, return_inverse=True, return_counts=True)
    often = count[place] > 1
    place, owner = place[often], owner[often]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    column = np.cumsum(np.concatenate(([False], place[1:] != place[:-1])))
    total = np.zeros((len(size), len(size)), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, last, COLUMNS_AT_ONCE):
        s, e = np.searchsorted(column, (low, low + COLUMNS_AT_ONCE))
        grid = np.zeros((len(size), COLUMNS_AT_ONCE), np.float32)
        grid[owner[s:e], column[s:e] - low] = 1
        total += grid @ grid.T
    return total[a, b].astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the given edges connect, fewer than nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new[label] if (new[label] != label).any() else new
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Component of every document under links of ``percent`` per cent Jaccard similarity or more.

    Takes docs with doc_id and text; returns doc_id, n_shingles, component_id and kept. A document's
    set is its distinct ``width``-word shingles after lower-casing A-Z; words are runs of characters
    other than space and \\t to \\r; a shorter text has one shingle, all its words. Null and empty
    texts, and texts without a word, are linked with nothing. Rows with the same id are one
    document. A row without an id has the component of
    equal sets, if any, and a null ``kept``. An empty table gives no rows; other columns are not read.

    Equal sets become one node. Nodes are posted under all coordinates of their signatures; those of
    a list are first compared with its hub, and nodes linked with one hub get one label. Only lists
    with several labels are then compared pair by pair, in cells of two parts each, which pass over
    pairs of one label and emit a forest of links, never all pairs. Pairs that collide in
    ``match_threshold`` coordinates are confirmed on whole sets.
    """
    if percent < 80:
        raise ValueError("the match thresholds hold for a similarity of 80 per cent or more")
    need = match_threshold(percent)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    K.ship(docs.sparkSession)
    rows = storage.written(signed(docs, width))
    prints = ["n_shingles", "print1", "print2"]
    nodes = rows.where("n_shingles > 0").groupBy(*prints).agg(F.min("doc_id").alias("doc_id"), F.first("posted").alias("posted"))
    nodes = storage.written(nodes.withColumn("node", F.monotonically_increasing_id()))
    postings = storage.written(posting_lists(nodes, need))
    posted = storage.written(postings.select(*_NODE).distinct())
    held = nodes.join(storage.limited_broadcast(posted), _NODE, "left_semi").select(*_NODE, "n_shingles", "posted")
    held = storage.written(K.map_batches(held, _with_signature, "doc_id long, print1 long, n_shingles long, signature binary"))
    wanted = storage.broadcast_if_small(posted.select("doc_id").distinct())
    sets = storage.written(sets_of(docs.join(wanted, "doc_id", "left_semi"), width).dropDuplicates(_NODE))
    to_hubs = storage.written(hub_links(postings, held, sets, percent, need))
    own = F.xxhash64(*_NODE)
    labels = to_hubs.groupBy(*_NODE).agg(F.min(F.xxhash64("hub_id", "hub_print")).alias("hub_label"))
    labelled = postings.join(labels, _NODE, "left").withColumn("label", F.coalesce("hub_label", own)).drop("hub_label")
    hubs = to_hubs.select(F.col("hub_id").alias("doc_id"), F.col("hub_print").alias("print1")).distinct().withColumn("_hub", F.lit(True))
    labelled = storage.written(labelled.join(hubs, _NODE, "left").withColumn("label", F.when(F.col("_hub"), own).otherwise(F.col("label"))).drop("_hub"))
    dealt = cells(labelled).join(held.select(*_NODE, "signature"), _NODE)
    sort = dealt.repartition(*_CELL).sortWithinPartitions(*_CELL)
    live = storage.written(sort.mapInArrow(K.tidy(_live_cells(percent, need)), sort.schema))
    full = live.join(sets, _NODE).repartition(*_CELL).sortWithinPartitions(*_CELL)
    links = full.mapInArrow(K.tidy(_links(percent, need)), "a long, b long").union(to_hubs.select(F.col("doc_id").alias("a"), F.col("hub_id").alias("b")))
    # Rows of one id are one document: a node is linked with the ids of other rows of its documents.
    again = rows.where("n_shingles > 0").join(rows.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1"), "doc_id", "left_semi")
    again = again.join(nodes.select(*prints, F.col("doc_id").alias("_node")), prints).select(F.col("doc_id").alias("a"), F.col("_node").alias("b"))
    found = storage.written(components.connected_components(links.union(again)))
    of_set = storage.written(nodes.select(*prints, F.col("doc_id").alias("_node")).join(found, F.col("_node") == F.col("node"), "left").select(*prints, F.coalesce("component", "_node").alias("_component")))
    out = rows.select("doc_id", *prints).join(of_set, prints, "left")
    component = F.least("doc_id", F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
