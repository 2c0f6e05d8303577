"""Each stage of the pipeline on what the one before kept, against plain versions."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_neardup import components
from test_secrets import brute
from test_tokens import untouched

import corpus_pipeline as P
from tessera.llm import secrets, toxicity
from tessera.llm.queries import WORD_BPE, toxicity_chain

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The stages' inputs and outputs by name."""
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), {}
    word = lambda i, j: f"plainly{(i * 97 + j * 31) % 5000}"
    texts = [(10_000 + i, " ".join(word(i, j) for j in range(60)) + f' token = "{"0123456789abcdef"[i:] * 2}x" ' + word(i, 99)) for i in range(4)]
    seen = docs.unionByName(spark.createDataFrame([(i, t, "en", "planted", len(t)) for i, t in texts], docs.schema))
    for name, stage in P.STAGES:
        at = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, seen, D).write.parquet(at)
        out[name] = seen, spark.read.parquet(at)
        seen = out[name][1]
    return out


def test_rows_called_toxic_go(spark, stages):
    docs, kept = stages["toxicity"]
    toxic = {r.doc_id: r.toxic for r in toxicity.scores(docs, toxicity_chain(spark, D, docs)).collect()}
    assert {r.doc_id for r in kept.collect()} == {k for k, t in toxic.items() if not t}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    assert sum(toxic[k] != bool(v) for k, v in labels.items()) <= 0.1 * len(labels) and not any(toxic[10_000 + i] for i in range(4))


def test_one_row_of_each_text_stays(stages):
    docs, kept = stages["exact dedup"]
    best = defaultdict(int)
    for r in docs.collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text)
        best[low] = max(best[low], r.doc_id)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(best.values())


def test_one_row_of_each_component_stays(stages):
    docs, kept = stages["near dedup"]
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    roots = components([r.text for r in rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[i].doc_id for i in roots})
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in rows}


def test_every_span_is_replaced_and_nothing_else(stages):
    docs, kept = stages["secret scan"]
    net = secrets.fit(docs)
    spans = {r.doc_id: [(x.start, secrets.KINDS.index(x.kind), x.end) for x in r.spans] for r in secrets.scan(docs, net).collect()}
    got, replaced = {r.doc_id: r for r in kept.collect()}, 0
    for r in docs.collect():
        own = sorted(spans[r.doc_id])
        assert set(brute(r.text)) <= set(own)
        parts, at = [], 0
        merged = []
        for a, k, z in own:
            if merged and a <= merged[-1][2]:
                merged[-1][2] = max(z, merged[-1][2])
            else:
                merged.append([a, k, z])
        for a, k, z in merged:
            parts += [r.text[at:a], f"[{secrets.KINDS[k]}]"]
            at = z
        text = "".join(parts) + r.text[at:]
        replaced += text != r.text
        assert got[r.doc_id].text == text and got[r.doc_id].n_chars == len(text)
        assert (got[r.doc_id].lang, got[r.doc_id].source) == (r.lang, r.source)
    assert replaced >= 4 and len(got) == docs.count()


def test_pieces_are_the_librarys_ids_without_gaps(stages):
    docs, packed = stages["best-fit packing"]
    tokenizer = untouched(P.public_tokenizers.path(WORD_BPE), False)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packed.collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0]
        own = sorted(by_doc[r.doc_id], key=lambda p: p.piece)
        assert [p.piece for p in own] == list(range(len(own))) and sum(p.length for p in own) == len(ids)
        assert len(own) == -(-len(ids) // 2048)
        for i, p in enumerate(own):
            part = ids[2048 * i : 2048 * (i + 1)]
            assert p.start == 2048 * i and p.length == len(part) and p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))] and sum(p.length for p in own) <= 2048
    assert len(by_sequence) <= 1.02 * packed.agg({"length": "sum"}).first()[0] / 2048 + 1
