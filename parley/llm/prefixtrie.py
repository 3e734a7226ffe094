"""The trie of conversations that share their first turns, from owned chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import kernels as K
from parley.llm import storage
from parley.operators.ordered import numbered, running

#: A conversation borrows the first turns, under SHARED of them, of the one whose id is the last multiple of FAMILY.
FAMILY, SHARED = 100, 6
#: Ids that are joined to one piece of a digest's input.
PIECE_IDS = 4096
_LANES = ("_s0", "_s1", "_s2", "_s3")
NODE = ["d0", "d1"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 1), a fingerprint (x0, x1) of role and text, and the code points n of the text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", F.xxhash64(role, text).alias("x0"), F.xxhash64(F.lit(1), text, role).alias("x1"), F.char_length(text).cast("long").alias("n"))
    return storage.written(numbered(slim, ["conv_id"], [F.col("turn").asc_nulls_first(), "x0", "x1"]))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (conv_id, depth, x0, x1, n) of the rebuilt conversations, and every conv_id with its length."""
    donor = F.col("conv_id") - F.col("conv_id") % FAMILY
    asked = (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("long")
    convs = storage.written(rows.groupBy("conv_id").agg(F.max("position").alias("own")).withColumns({"donor": donor, "h": asked}))
    has = convs.where("conv_id = donor").select(F.col("conv_id").alias("donor"), F.col("own").alias("given"))
    convs = storage.written(convs.join(has, "donor", "left").withColumn("kept", F.least("h", F.coalesce("given", F.lit(0)))).drop("given"))
    first = rows.where((F.col("conv_id") % FAMILY == 0) & (F.col("position") < SHARED)).withColumnRenamed("conv_id", "donor")
    lent = convs.select("conv_id", "donor", "kept").join(first, "donor").where("position <= kept").select("conv_id", F.col("position").alias("depth"), "x0", "x1", "n")
    own = rows.join(convs.select("conv_id", "h", "kept"), "conv_id").where("position > h")
    own = own.select("conv_id", (F.col("position") - F.col("h") + F.col("kept")).alias("depth"), "x0", "x1", "n")
    length = F.col("kept") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return lent.union(own), convs.select("conv_id", length.alias("length"))


def prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, digest (d0, d1) of the first ``depth`` turns, and n of the last; depth 0 included.

    The digest is of running sums of 32-bit lanes of a hash of (depth, turn), 128 bits in all, so that a
    long conversation can be summed in several ranges.
    """
    hashes = [F.xxhash64("depth", "x0", "x1"), F.xxhash64("x1", "depth", "x0")]
    low = [h.bitwiseAND(F.lit(0xFFFFFFFF)) for h in hashes]
    high = [F.shiftrightunsigned(h, 32) for h in hashes]
    summed = running(rows.select("conv_id", "depth", "n", *(x.alias(f"_h{i}") for i, x in enumerate(low + high))), ["conv_id"], ["depth"], {s: F.col(f"_h{i}") for i, s in enumerate(_LANES)})
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n"), *(F.lit(0).cast("long").alias(s) for s in _LANES))
    both = summed.select("conv_id", "depth", "n", *_LANES).union(root)
    return storage.written(both.select("conv_id", "depth", "n", F.xxhash64("depth", *_LANES).alias("d0"), F.xxhash64(*reversed(_LANES), "depth").alias("d1")))


def first_owned(paths: DataFrame, minima: DataFrame, convs: DataFrame, report: list[int] | None = None) -> DataFrame:
    """conv_id, length and the smallest depth whose prefix no smaller conv_id has (length + 1 if there is none).

    If a conversation owns a prefix, it owns the longer ones, so the depth is found by halving. A
    round joins the middle prefixes of all open conversations to the minima by conv_id and digest: a
    prefix that many share asks under many ids, so no key is hot.
    """
    owners = minima.select(F.col("owner").alias("conv_id"), "depth", *NODE, F.lit(True).alias("owned"))
    state = storage.written(convs.withColumns({"low": F.lit(0).cast("long"), "high": F.col("length") + 1}))
    done = [state.where("low = high")]
    state = state.where("low < high")
    while not state.isEmpty():
        if report is not None:
            report.append(state.count())
        asked = state.withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2)).join(paths.select("conv_id", "depth", *NODE), ["conv_id", "depth"])
        told = asked.join(owners, ["conv_id", "depth", *NODE], "left")
        state = storage.written(told.select("conv_id", "length", F.when(F.col("owned"), F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(F.col("owned"), F.col("depth")).otherwise(F.col("high")).alias("high")))
        done.append(state.where("low = high"))
        state = state.where("low < high")
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return storage.written(found.select("conv_id", "length", F.col("low").alias("first")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (d0, d1, conv_id) to joined ids, PIECE_IDS at most in a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in NODE])
        edge = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        cuts = [(c, min(c + PIECE_IDS, b)) for a, b in zip(edge, edge[1:], strict=False) for c in range(a, b, PIECE_IDS)]
        ids = batch.column("conv_id").to_pylist()
        at = [a for a, _ in cuts]
        yield pa.RecordBatch.from_arrays([pa.array(keys[0, at]), pa.array(keys[1, at]), pa.array([ids[a] for a in at], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in cuts])], [*NODE, "conv_id", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to the SHA-256 of each node's ids; a node is read piece by piece."""
    key, state, done = None, None, []
    for batch in batches:
        for *here, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"]), strict=True):
            if here != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = here, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*NODE, "ends_sha256"])
            done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], [*NODE, "ends_sha256"])


def ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """d0, d1 and the digest of the sorted ids of the conversations that end there.

    The ids of a node are dealt over ranges and joined to pieces there; the pieces alone meet, and are
    read as a stream, since one digest is one sequence.
    """
    last = paths.join(convs.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select(*NODE, "conv_id")
    parts = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = last.repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = K.map_batches(dealt, _pieces, "d0 long, d1 long, conv_id long, ids string")
    met = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    return K.map_batches(met, _digests, "d0 long, d1 long, ends_sha256 string")


def chain_totals(chains: DataFrame, values: list[str], report: list[int] | None = None) -> DataFrame:
    """Chains (conv_id, up, values) with each value summed over all chains below and the chain itself.

    Distances double: after round k a chain has the sum over chains less than 2^k below it, and ``up``
    leads 2^k chains up. A round adds what stands exactly that far below.
    """
    state = storage.written(chains)
    while not state.where("up IS NOT NULL").isEmpty():
        if report is not None:
            report.append(1)
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(*(F.sum(v).alias(f"_{v}") for v in values))
        further = state.select(F.col("conv_id").alias("up"), F.col("up").alias("_up"))
        state = storage.written(
            state.join(below, "conv_id", "left").join(further, "up", "left").select("conv_id", F.col("_up").alias("up"), *((F.col(v) + F.coalesce(F.col(f"_{v}"), F.lit(0))).alias(v) for v in values))
        )
    return state.drop("up")


def trie(conversations: DataFrame, report: dict[str, list[int]] | None = None) -> DataFrame:
    """Every node of the trie of rebuilt conversations, as a row.

    Turns are ordered by ``turn``, null first; null roles and texts are empty. The first h turns of a
    conversation c are those of conversation c - c % 100 (all if it has fewer, none if there is no
    such), h the crc32 of c modulo 6; its own follow from turn h on. A node is a sequence of first
    turns, the root none; its conv_id is the smallest of its members.

    Each conversation finds its first owned depth by halving against the minima of prefix digests; what
    it owns from there is a chain, which hangs on a node of another chain. Sums go up from chain to
    chain by doubling, and along a chain by running sums. Columns: conv_id, depth, parent_conv_id (root:
    null), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Rows without a conv_id are left out. Rows that repeat a turn all count, in order of a fingerprint of
    role and text; so do equal rows. Texts of any length count whole. An empty table gives no rows. Other
    columns are not read. Turns and prefixes are compared by 128-bit hashes.
    """
    K.small_batches(conversations.sparkSession)
    logs = report if report is not None else {}
    rows, convs = rebuilt(turns(conversations))
    convs = storage.written(convs)
    paths = prefixes(rows, convs)
    minima = storage.written(paths.groupBy(*NODE).agg(F.min("conv_id").alias("owner"), F.min("depth").alias("depth"), F.min("n").alias("n"), F.count("*").alias("n_convs")))
    own = first_owned(paths, minima, convs, logs.setdefault("searches", []))
    # A chain hangs on the node before its first.
    chains = own.where("first <= length")
    tops = chains.withColumn("depth", F.col("first") - 1).join(paths.select("conv_id", "depth", *NODE), ["conv_id", "depth"])
    tops = tops.join(minima.select(*NODE, F.col("owner").alias("up")), NODE).select("conv_id", "up")
    chains = storage.written(chains.join(tops, "conv_id", "left"))
    hung = chains.where("up IS NOT NULL").groupBy(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    nodes = minima.join(chains.select(F.col("conv_id").alias("owner"), "length", "first", "up"), "owner").join(hung, ["owner", "depth"], "left")
    children = F.when(F.col("depth") < F.col("length"), 1).otherwise(0) + F.coalesce(F.col("hung"), F.lit(0))
    nodes = nodes.withColumn("n_children", children)
    nodes = storage.written(nodes.withColumns({"leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n")}))
    own_sums = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.max("up").alias("up"), F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    totals = chain_totals(own_sums, ["leaf", "saved"], logs.setdefault("rounds", []))
    below = totals.join(chains.where("up IS NOT NULL").select("conv_id", "up", "first"), "conv_id")
    below = below.groupBy(F.col("up").alias("owner"), (F.col("first") - 1).alias("depth")).agg(F.sum("leaf").alias("_leaf"), F.sum("saved").alias("_saved"))
    added = lambda c: F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))
    summed = running(nodes.join(below, ["owner", "depth"], "left").withColumns({"leaf": added("leaf"), "saved": added("saved")}), ["owner"], [F.col("depth").desc()], {"n_leaves": F.col("leaf"), "saved_tokens": F.col("saved")})
    none = hashlib.sha256(b"").hexdigest()
    parent = F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("up"))
    return summed.join(ends(paths, convs), NODE, "left").select(
        F.col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
