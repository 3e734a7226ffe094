"""Byte-level BPE with segment trees over byte positions."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import kernels as K

NONE = np.int32(2**31 - 1)
CACHED_PIECES = 300_000
#: Pieces times padded bytes merged side by side.
GROUP_CELLS = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary of lines with a token in base 64 and its rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Encoder:
    """Encodes pieces under ``ranks``; keeps a bounded number of results."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = CACHED_PIECES) -> None:
        self.ranks, self.find, self.cached = ranks, regex.compile(pattern).findall, cached
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.byte_rank = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair_table = K.IntTable(np.fromiter(pairs.keys(), np.uint64, len(pairs)))
        self.pair_rank = np.fromiter(pairs.values(), np.int32, len(pairs))
        self.known: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        row = self.pair_table.find(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))
        return np.where(row >= 0, self.pair_rank[row], NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of two bytes or more, by repeated merging of the leftmost lowest pair.

        Each piece has a segment tree whose leaves are byte positions: a leaf holds the rank of the
        pair that begins there, a node the least of its leaves. A merge descends to the leftmost
        least leaf and updates the three leaves whose pairs changed and the nodes above them.
        Pieces of like length are merged side by side.
        """
        out = [b""] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            groups.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for size, members in groups.items():
            step = max(1, GROUP_CELLS // size)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._merge_group([pieces[i] for i in part], size), strict=True):
                    out[i] = ids
        return out

    def _merge_group(self, pieces: list[bytes], size: int) -> list[bytes]:
        n, length = len(pieces), np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        token = np.full((n, size + 1), -1, np.int32)
        token[:, :size] = self.byte_rank[raw]
        live = np.arange(size) < length[:, None]
        after = np.broadcast_to(np.arange(1, size + 2, dtype=np.int32), (n, size + 1)).copy()
        before = after - 2
        tree = np.full((n, 2 * size), NONE, np.int32)
        rows, at = np.nonzero(live[:, 1:])
        tree[rows, size + at] = self.rank(token[rows, at], token[rows, at + 1])
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        rows = np.arange(n)
        depth = size.bit_length() - 1
        while True:
            best = tree[rows, 1]
            rows, best = rows[best < NONE], best[best < NONE]
            if not len(rows):
                break
            node = np.ones(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node + (tree[rows, 2 * node] != best)
            at = node - size
            gone = after[rows, at].astype(np.int64)
            right = after[rows, gone].astype(np.int64)
            left = before[rows, at].astype(np.int64)
            token[rows, at] = best
            live[rows, gone] = False
            after[rows, at] = right
            before[rows, np.minimum(right, size)] = at
            here = np.full(len(rows), NONE, np.int32)
            has = right < length[rows]
            here[has] = self.rank(best[has], token[rows[has], right[has]])
            self._update(tree, rows, at + size, here, depth)
            self._update(tree, rows, gone + size, np.full(len(rows), NONE, np.int32), depth)
            has = left >= 0
            self._update(tree, rows[has], left[has] + size, self.rank(token[rows[has], left[has]], best[has]), depth)
        flat = token[:, :size][live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, node: np.ndarray, value: np.ndarray, depth: int) -> None:
        tree[rows, node] = value
        for _ in range(depth):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pack(self, pieces: list[str]) -> dict[str, bytes]:
        """Little-endian 32-bit ids of each piece."""
        raw = [piece.encode() for piece in pieces]
        out = {p: self.ranks[r].to_bytes(4, "little") for p, r in zip(pieces, raw) if r in self.ranks}
        hard = [(p, r) for p, r in zip(pieces, raw) if r not in self.ranks]
        out.update(zip([p for p, _ in hard], self.merge([r for _, r in hard])))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.find(text) for text in texts]
        new = list(set().union(*split) - self.known.keys())
        made = self.pack(new)
        look = self.known
        if len(look) + len(made) <= self.cached:
            look.update(made)
        else:
            room = max(0, self.cached - len(look))
            look.update(dict(list(made.items())[:room]))
            look = _Both(look, made)
        return [b"".join(map(look.__getitem__, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Both(dict):
    """The kept results, then those of this block alone."""

    def __init__(self, kept: dict[str, bytes], made: dict[str, bytes]) -> None:
        super().__init__(made)
        self.kept = kept

    def __missing__(self, piece: str) -> bytes:
        return self.kept[piece]


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Token ids of every whole text by byte-level BPE, and the bytes that they decode to.

    Returns doc_id, n_tokens, ids (array of int) and decoded (binary). A null or empty text has no
    ids and no bytes. Repeated ids give a row each; an empty table gives no rows. The vocabulary is
    read on the executors from ``path``, which every machine has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch):
                made = encoder(path, pattern).encode(K.fill(block.column(1)).to_pylist())
                flat = pa.array(np.frombuffer(b"".join(made), "<u4").astype(np.int32))
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) // 4 for x in made]))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array([len(x) // 4 for x in made], pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.array(map(encoder(path, pattern).decode, made), pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return K.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per text the number of ids and the SHA-256 of its ids and of its decoded bytes.

    The same encoder and decoder as ``encode_decode``; ids and bytes stay inside the task. A null text
    counts as empty: no ids, and the hash of nothing. Long texts are encoded whole; of pairs of equal
    rank the leftmost merges first. Repeated rows and ids give a row each, a null id keeps its null;
    an empty table gives no rows, and columns other than doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch):
                made = encoder(path, pattern).encode(K.fill(block.column(1)).to_pylist())
                decoded = map(encoder(path, pattern).decode, made)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array([len(x) // 4 for x in made], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in made]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return K.map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
