import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from parley.llm import kernels, packing, word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, offset string"


def test_ids_equal_the_library():
    library, own = Tokenizer.from_file(PATH), word_bpe.WordEncoder(PATH)
    rng = random.Random(3)
    texts = [None, "", "  ", "don't I'LL '''s 's' rock'n'roll", "x" * 5000, "<|endoftext|> a", "日本 é", "ÀÉÎß×÷ é12a3", "a\x1fb\x0bc"]
    texts += ["".join(rng.choice("abstmdrvelÉé' .!1'\n") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    texts += ["".join(rng.choice("abé日 ²ª½ ́'x.\t\x1f") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for _ in range(2):
        for text, ids in zip(texts, own.encode(pa.array(texts)), strict=True):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def sequential(lengths, capacity):
    """Sequences that best fit decreasing uses, one piece after another."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_every_piece_has_one_place_and_few_sequences_are_used(spark):
    rng = random.Random(6)
    pieces = [(i, 0, rng.choice((1, 7, 30, 50, 64, 64, 64, rng.randint(1, 64)))) for i in range(1500)]
    frame = spark.createDataFrame(pieces, "doc_id long, piece int, length long")
    rows = packing.pack(frame, 64).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in rows) == sorted(pieces)
    assert check_layout(rows, 64) <= sequential([p[2] for p in pieces], 64) + 2


def successors(docs, gaps):
    """Each document in falling order takes the smallest gap that holds it and is still free."""
    free, out = sorted(gaps), {}
    for length, rank in sorted(((n, r) for r, n in docs), key=lambda d: (-d[0], d[1])):
        fits = [g for g in free if g[0] >= length]
        if fits:
            free.remove(fits[0])
            out[rank] = fits[0][0]
    return out


def test_a_sweep_against_one_document_after_another(spark, monkeypatch):
    rng = random.Random(8)
    for rows, most in ((10_000, 9), (7, 9), (7, 300)):  # one range, and ranges that carry gaps over their bounds
        monkeypatch.setattr(packing, "TASK_ROWS", rows)
        docs = [(r, rng.randint(1, most)) for r in range(60)]
        gaps = [(rng.randint(1, most), s) for s in range(50)]
        found, many, n, low, top = packing.sweep(spark.createDataFrame(docs, "rank long, length long"), spark.createDataFrame(gaps, "size long, sequence long"), 110)
        got = {r.rank: r.sequence for r in found.collect()}
        size, wanted = dict((s, g) for g, s in gaps), successors(docs, gaps)
        assert len(got) == 60 and {r: size[s] for r, s in got.items() if s is not None} == wanted
        taken = [s for s in got.values() if s is not None]
        assert len(set(taken)) == len(taken) == many and n == 60 - many
        lone = [dict(docs)[r] for r, s in got.items() if s is None]
        assert (low, top) == (min(lone, default=0), max(lone, default=0))


def test_hot_lengths_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ROWS", 50)
    for lengths, wanted in (([1] * 400, 7), ([33] * 90, 90), ([64] * 5, 5), ([64, 1] * 20, 21), ([], 0)):
        frame = spark.createDataFrame([(1, 0, n, "x") for n in lengths], "doc_id long, piece int, length long, sequence string")
        rows = packing.pack(frame, 64).collect()
        assert sorted(r.length for r in rows) == sorted(lengths) and check_layout(rows, 64) == wanted


def test_documents(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "hello world"), (4, "hello world"), (5, "x" * 200_000)]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA)
    got = packing.pack_documents(docs, PATH).collect()
    check_layout(got, packing.CAPACITY)
    library = Tokenizer.from_file(PATH)
    wanted = []
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), packing.CAPACITY):
            part = ids[k : k + packing.CAPACITY]
            wanted.append((i, k // packing.CAPACITY, k, len(part), kernels.crc(part.tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(wanted)
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_ranges_are_bounded_and_columns_of_any_name_come_back(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ROWS", 3)
    monkeypatch.setattr(packing, "MOST_PARTS", 5)
    seen = []
    before = packing.carried
    monkeypatch.setattr(packing, "carried", lambda counts: seen.append(len(counts)) or before(counts))
    rng = random.Random(4)
    rows = [(i, 0, rng.randrange(1, 101), {"m": i}, i, "b", 7, 8, 9) for i in range(300)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, tags map<string,int>, _part long, _place string, _base int, _rank int, c0 int")
    got = packing.pack(pieces, 100).collect()
    assert max(seen) <= 5  # what the driver holds of a sweep
    assert sorted((r.doc_id, r.length, r.tags["m"], r["_part"], r["_place"], r["_base"], r["_rank"], r.c0) for r in got) == sorted((i, n, t["m"], p, *rest) for i, _, n, t, p, *rest in rows)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= 100
