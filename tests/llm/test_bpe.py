import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from parley.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def samples():
    rng = random.Random(7)
    texts = ["", " ", "a", "hello  world\n\n x", " é́😀 don't 12345", "x" * 5000, "ab" * 3000, "aaaaaaaaaaaaaaaaaaab", "\n\n\n", "\t tab"]
    return texts + ["".join(rng.choice("abcdeé 日本1.\n\t'st") for _ in range(rng.randint(1, 400))) for _ in range(150)]


def test_ids_equal_the_library_and_decode_to_the_text():
    own = bpe.encoder(PATH, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    for text, ids in zip(samples(), own.encode(samples()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_a_small_cache_changes_nothing():
    ranks = bpe.read_ranks(PATH)
    small = bpe.Encoder(ranks, public_tokenizers.PATTERN, cached=3)
    whole = bpe.encoder(PATH, public_tokenizers.PATTERN)
    for text in samples()[:40]:
        assert small.encode([text]) == whole.encode([text])
    assert len(small.known) <= 3


def test_queries(spark):
    rows = [(1, None), (2, ""), (3, "hello world " * 5000), (4, "é"), (4, "é")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")
    got = bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()
    full = bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).collect()
    for (i, text), d, f in zip(rows, got, full, strict=True):
        assert d.doc_id == f.doc_id == i and d.n_tokens == f.n_tokens == len(f.ids)
        assert bytes(f.decoded) == (text or "").encode()
        assert d.decoded_sha256 == hashlib.sha256(f.decoded).hexdigest()
        assert d.ids_sha256 == hashlib.sha256(np.array(f.ids, "<u4").tobytes()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
