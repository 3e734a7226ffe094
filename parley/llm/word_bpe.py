"""Word-level BPE ids of whole blocks of texts, merged side by side.

The ids are those of the ``tokenizers`` library. Texts of plain characters (ASCII and the letters
of Latin-1) are cut and merged here in arrays; any other text goes through the library itself.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from parley.llm import kernels as K

KEPT_WORDS = 200_000
NONE = np.int32(2**31 - 1)
GROUP_CELLS = 1 << 18
#: Fixed values of the vocabulary's pattern: contractions that are tokens of their own.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")

GAP, LETTER, DIGIT, SYMBOL, ODD = range(5)
CLASS = np.full(256, ODD, np.uint8)
CLASS[33:127] = SYMBOL
CLASS[[32, 9, 10, 11, 12, 13]] = GAP
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[0x80:0xC0] = CLASS[0xC3] = LETTER  # second and first byte of a Latin-1 letter


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class WordEncoder:
    """Ids of the words of a block, with a bounded table of words seen before."""

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        self.library, self.kept = Tokenizer.from_file(path), kept
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + end] for c in letters], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        self.pair_table = K.IntTable(pairs[:, 0] << 32 | pairs[:, 1])
        self.pair_rank, self.made_id = np.arange(len(pairs), dtype=np.int32), pairs[:, 2].astype(np.int32)
        self.table, self.keys = K.IntTable(np.zeros(0, np.uint64)), np.zeros(0, np.uint64)
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pair_table.find(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64))

    def merge(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (in one array) and number of ids of padded words: the lowest ranked pair, the leftmost of them, merges first."""
        n, width = words.shape
        token = np.where(np.arange(width) == length[:, None] - 1, self.final[words], self.inner[words])
        live = np.arange(width) < length[:, None]
        rank = np.full((n, width), NONE, np.int32)
        rows, at = np.nonzero(live[:, 1:])
        found = self.rank(token[rows, at], token[rows, at + 1])
        rank[rows, at] = np.where(found >= 0, found, NONE)
        after = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy()
        before = after - 2
        rows = np.arange(n)
        while len(rows):
            at = rank[rows].argmin(1)
            best = rank[rows, at]
            rows, at, best = rows[best < NONE], at[best < NONE], best[best < NONE]
            if not len(rows):
                break
            gone = after[rows, at]
            right = after[rows, gone]
            token[rows, at] = self.made_id[best]
            live[rows, gone] = False
            rank[rows, gone] = NONE
            after[rows, at] = right
            has = right < length[rows]
            before[rows[has], right[has]] = at[has]
            rank[rows[~has], at[~has]] = NONE
            left = before[rows, at]
            had = left >= 0
            both_rows = np.concatenate((rows[has], rows[had]))
            both_at = np.concatenate((at[has], left[had]))
            found = self.rank(token[both_rows, both_at], token[both_rows, after[both_rows, both_at]])
            rank[both_rows, both_at] = np.where(found >= 0, found, NONE)
        return token[live], live.sum(1)

    def encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of byte spans, in one array with each span's end in it."""
        length = end - start
        size = np.zeros(len(start), np.int64)
        width = 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for w in np.unique(width):
            members = np.flatnonzero(width == w)
            step = max(1, GROUP_CELLS // int(w))
            for k in range(0, len(members), step):
                part = members[k : k + step]
                grid = np.minimum(start[part, None] + np.arange(w), len(data) - 1)
                ids, size[part] = self.merge(data[grid], length[part])
                parts.append((part, ids))
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = np.zeros(int(ends[-1]), np.int32)
        for part, ids in parts:
            flat[spread(ends[part], size[part])] = ids
        return flat, ends

    def learn(self, keys: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> None:
        """Keeps new words for later blocks, up to the bound."""
        if len(self.keys) >= self.kept:
            return
        self.waiting.append((keys, flat, np.diff(ends)))
        self.n_waiting += len(keys)
        if self.n_waiting < max(20_000, len(self.keys) // 4):
            return
        keys = np.concatenate([self.keys, *(w[0] for w in self.waiting)])
        sizes = np.concatenate([np.diff(self.ends), *(w[2] for w in self.waiting)])
        flat = np.concatenate([self.flat, *(w[1] for w in self.waiting)])
        ends = np.concatenate(([0], np.cumsum(sizes)))
        first = np.sort(np.unique(keys, return_index=True)[1])[: self.kept]
        self.flat = flat[spread(ends[first], sizes[first])]
        self.keys, self.ends = keys[first], np.concatenate(([0], np.cumsum(sizes[first])))
        self.table, self.waiting, self.n_waiting = K.IntTable(self.keys), [], 0

    def encode(self, array: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        texts = K.Texts(array)
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * texts.n
        plain = plain_texts(texts)
        if not plain.all():
            odd = np.flatnonzero(~plain)
            for i, text in zip(odd.tolist(), K.fill(array).take(pa.array(odd)).to_pylist(), strict=True):
                out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
            kept = np.flatnonzero(plain)
            if len(kept):
                for i, ids in zip(kept.tolist(), self.encode(K.fill(array).take(pa.array(kept))), strict=True):
                    out[i] = ids
            return out
        data, start, end, owner = cut(texts)
        if not len(start):
            return out
        keys = K.span_hashes(data, start, end)
        row = self.table.find(keys)
        lost = np.flatnonzero(row < 0)
        flat, ends = self.flat, self.ends
        if len(lost):
            new, first, place = np.unique(keys[lost], return_index=True, return_inverse=True)
            made, made_ends = self.encode_words(data, start[lost[first]], end[lost[first]])
            row[lost] = place + len(self.keys)
            flat, ends = np.concatenate((flat, made)), np.concatenate((ends, made_ends[1:] + ends[-1]))
            self.learn(new, made, made_ends)
        size = ends[row + 1] - ends[row]
        ids = flat[spread(ends[row], size)]
        per = np.bincount(owner, weights=size, minlength=texts.n).astype(np.int64)
        return np.split(ids, np.cumsum(per)[:-1])


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 and so on, ``size`` of them, one after another."""
    total = np.cumsum(size)
    return np.repeat(start - total + size, size) + np.arange(total[-1] if len(total) else 0)


def plain_texts(texts: K.Texts) -> np.ndarray:
    """Texts of ASCII and Latin-1 letters alone, without the opening of a special token."""
    data = texts.data
    bad = CLASS[data] == ODD
    if (data >= 0x80).any():
        first = data == 0xC3
        second = (data >= 0x80) & (data < 0xC0)
        bad[1:] |= second[1:] & ~first[:-1]
        bad[1:] |= first[:-1] & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    bad[1:] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
    return texts.per_text(bad) == 0


def cut(texts: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes, and start, end and text of each word: letters, one digit, symbols or a contraction."""
    data = K.LOWER[texts.data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F)) + 1
    data[upper] += 32
    kind = CLASS[data]
    start = kind != GAP
    start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    heads = texts.starts[:-1][texts.starts[:-1] < len(data)]
    start[heads] = kind[heads] != GAP
    quote = np.flatnonzero((data == ord("'")) & start)
    if len(quote):
        limit = texts.starts[np.searchsorted(texts.starts, quote, side="right")]
        taken = np.zeros(len(quote), np.int64)
        for word in CONTRACTIONS:
            ok = (taken == 0) & (quote + len(word) < limit)
            for k, letter in enumerate(word):
                ok[ok] = data[quote[ok] + 1 + k] == letter
            taken[ok] = len(word)
        quote, limit, taken = quote[taken > 0], limit[taken > 0], taken[taken > 0]
        start[quote + 1] = False
        rest = quote + 1 + taken
        rest = rest[rest < limit]
        start[rest[kind[rest] == LETTER]] = True
    at = np.flatnonzero(start)
    owner = np.searchsorted(texts.starts, at, side="right") - 1
    gap = np.flatnonzero(np.concatenate((kind == GAP, [True])))
    stop = gap[np.searchsorted(gap, at)]
    end = np.minimum(stop, texts.starts[owner + 1])
    end[:-1] = np.minimum(end[:-1], at[1:])
    return data, at, end, owner


@functools.cache
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
