"""Sampled pieces of long texts and long words."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tessera.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
KEYS = np.array([1, 2**63 + 5], np.uint64)


@pytest.mark.parametrize("word", ["q", "thener" * 900, "é😀▁x y" * 700, "x" * 1023, "x" * 1024, "ab" * 512 + "é", " " * 3000, "".join(random.Random(3).choice("abcdefghij") for _ in range(5000))])
def test_stretches_draw_as_lattices_do(word):
    m = pieces.model(PATH)
    for key in KEYS:
        one, _ = pieces.sample(m, pa.array([word]), np.zeros(1, np.int64), np.array([key]))
        assert pieces.long_word(m, word, key).tolist() == one.tolist()


def test_groups_of_words_and_draws_change_nothing(monkeypatch):
    m, r = pieces.model(PATH), random.Random(4)
    texts = [" ".join("".join(r.choice("abcé ") for _ in range(r.randrange(30))) for _ in range(r.randrange(60))) for _ in range(20)] + ["", None, " ", "same " * 50]
    keys, text = pa.array(range(len(texts))), pa.array(texts, pa.string())
    want = [x.tolist() for x in pieces.encode_block(m, keys, text, 7)]
    for name, n in (("LATTICE_CHARS", 40), ("DRAWS", 5), ("LONG", 12), ("WINDOW", 3)):
        monkeypatch.setattr(pieces, name, n)
        assert [x.tolist() for x in pieces.encode_block(m, keys, text, 7)] == want


def test_a_text_of_many_words_and_one_without_a_space(spark):
    r = random.Random(5)
    words = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(400_000))
    docs = spark.createDataFrame([(1, words), (2, "".join(r.choice("abcdef0123456789+/") for _ in range(2_000_000))), (3, " " * 100_000)], "doc_id long, text string")
    got = {x.doc_id: x for x in pieces.round_trip(docs, PATH).collect()}
    assert all(x.lossless for x in got.values()) and got[2].n_pieces > 500_000
