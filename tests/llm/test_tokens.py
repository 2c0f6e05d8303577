"""Token files and packing against the tokenizers library, text by text."""

import functools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing, queries, tokenfile

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\r\x0b\x0c'.,á "))))
def test_cutting_into_chunks_changes_no_ids(text):
    for kind, path in ((tokenfile.Encoder, BYTE), (tokenfile.WordEncoder, WORD)):
        got = tokenfile.encoder(kind, path, "<u4").encode([text])[0]
        assert np.frombuffer(got, "<u4").tolist() == library(path)(text)


#: What pre-tokenizers, normal forms and special tokens treat in ways of their own.
PARTS = ["the", "ERTH", "it's", "I'LL", "don't,", "a", " ", "  ", "\n", "\r\n", ",", ".", "...", "$", "&&", "--", "'", '"', "é", "É", "ç,", "e\u0301", "T\u0308", "H\u0331", "I\u0307,", "\u212a", "A\u0338,", "1", "4,5", "x1", "a_b",
         "日本", "語。", "😀,", "\xa0", "\u3000", "\x1c", "\0", "\u200b", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "µ.", "÷,", "ﬁ,", "Σ", "ΑΣ,", "٣,", "²,", "foo)", "[bar]", "m/n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=30).map("".join))
def test_ids_are_those_of_the_library_as_it_comes(text):
    for kind, path in ((tokenfile.Encoder, BYTE), (tokenfile.WordEncoder, WORD)):
        for spell in (False, True):
            t = untouched(path, spell)
            got = tokenfile.encoder(kind, path, "<u4", spell).encode([text])[0]
            assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


@functools.cache
def untouched(path, spell):
    t = Tokenizer.from_file(path)
    if spell:
        t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("table", ["awkward", "small"])
def test_queries_follow_the_library_as_it_comes(request, table, tmp_path):
    """op3 and op8 as registered, over a whole table, against an unmodified tokenizer."""
    docs = request.getfixturevalue(table)
    spark = docs.sparkSession
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = docs.collect()
    files = sorted(queries.op3_token_files(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    want = sorted((str(r.doc_id), n, crc(ids)) for r in rows for ids in [[*untouched(BYTE, False).encode(r.text or "", add_special_tokens=False).ids, 2]] for n in [len(ids)])
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in files) == want
    assert [r.start for r in files] == np.cumsum([0, *(r.n_tokens for r in files)])[:-1].tolist()
    pieces = queries.op8_best_fit_packing(spark, str(tmp_path)).collect()
    want = []
    for r in rows:
        ids = [*untouched(WORD, False).encode(r.text or "", add_special_tokens=False).ids, 0]
        want += [(str(r.doc_id), i, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for i, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == sorted(want)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


@pytest.mark.parametrize("table", ["awkward", "small", "nothing", "clashing"])
def test_files_equal_the_library(request, table, tmp_path):
    docs = request.getfixturevalue(table)
    folder, manifest = tokenfile.token_files(docs, BYTE, 2, folder=str(tmp_path))
    encode = library(BYTE)
    want = [(r.doc_id, [*encode(r.text), 2]) for r in docs.collect()]
    want.sort(key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(tokenfile.read(docs.sparkSession, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [x[0] for x in want]
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(a), b) for a, b in want)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), crc(r.ids))
        at += len(r.ids)
    assert manifest["tokens"] == at and manifest["docs"] == len(want)


def test_files_elsewhere_are_read_by_ranges(small, tmp_path):
    folder, manifest = tokenfile.token_files(small, BYTE, 2, folder=str(tmp_path), parts=3)
    local = sorted(map(str, tokenfile.read(small.sparkSession, folder, with_ids=True).collect()))
    name = f"part-{manifest['parts'][1]['part']:06d}"
    with open(tmp_path / f"{name}.ids", "rb") as f:
        far = tokenfile.Ranged(tokenfile.pa.PythonFile(f), "<u2")
        near = tokenfile.opened(f"file://{tmp_path}", f"{name}.ids", "<u2")
        assert len(far) == len(near) > 100
        for a, z in ((0, 0), (3, 50), (90, 10**9), (0, len(far))):
            assert far[a:z].tolist() == near[a:z].tolist()
    assert len(local) == small.count() and len(manifest["parts"]) == 3


def test_the_type_of_ids_follows_the_vocabulary():
    assert tokenfile.smallest(BYTE, 2) == "<u2" and tokenfile.smallest(BYTE, 1 << 16) == "<u4"


def test_local_files_are_memory_mapped(small, tmp_path):
    _, manifest = tokenfile.token_files(small, BYTE, 2, folder=str(tmp_path))
    name = f"part-{manifest['parts'][0]['part']:06d}.ids"
    assert isinstance(tokenfile.opened(f"file://{tmp_path}", name, "<u2"), np.memmap)
    assert not list(tmp_path.glob(".part*"))


def packed_well(rows, capacity=2048):
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= capacity
    return len(seqs)


@pytest.mark.parametrize("table", ["awkward", "small", "nothing", "clashing"])
def test_packing(request, table):
    docs = request.getfixturevalue(table)
    rows = packing.pack(docs, WORD).collect()
    n = packed_well(rows)
    encode, want, sizes = library(WORD), [], {}
    for r in docs.collect():
        ids = [*encode(r.text), 0]
        for i, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want.append((str(r.doc_id), i, at, len(own), crc(own)))
            sizes[len(own)] = sizes.get(len(own), 0) + 1
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert packing.lower_bound(sizes, 2048) <= n <= packing.lower_bound(sizes, 2048) * 1.02 + 1


def optimum(items, capacity):
    """By search over all packings of a few items."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in {x: k for k, x in enumerate(bins)}.values():
            if bins[b] + items[i] <= capacity:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        bins.append(items[i])
        go(i + 1, bins)
        bins.pop()

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9), st.integers(20, 24))
def test_reduction_keeps_the_optimum(items, capacity):
    counts = {s: items.count(s) for s in items}
    p = packing.Packer(counts, capacity)
    p.reduce()
    left = [s for s in range(capacity + 1) for _ in range(int(p.left[s]))]
    assert p.n_seq + optimum(left, capacity) == optimum(items, capacity)
    assert packing.lower_bound(counts, capacity) <= optimum(items, capacity)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=30), st.integers(60, 90))
def test_runs_place_every_item_once(counts, capacity):
    p = packing.Packer(counts, capacity)
    seqs, seen = {}, {s: set() for s in counts}
    for r in p.solve():
        for j in range(r.n):
            seqs.setdefault(r.seq + j // r.each, []).append((r.offset + j % r.each * r.size, r.size))
            seen[r.size].add(r.first + j)
    assert {s: len(x) for s, x in seen.items()} == counts
    for own in seqs.values():
        at = 0
        for off, n in sorted(own):
            assert off == at
            at += n
        assert at <= capacity
