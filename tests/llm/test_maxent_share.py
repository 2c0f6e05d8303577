"""Which blocks enter the updates of the maximum-entropy model."""

import pytest

from tessera.llm import maxent

DOCS = "/root/testdata/sf0.001/documents.parquet"


def scores(docs, **shape):
    return {r.doc_id: r.score for r in maxent.score(docs, maxent.Shape(**shape)).collect()}


def test_every_block_enters_the_first_update(spark):
    docs = spark.read.parquet(DOCS)
    one, many = scores(docs, updates=1), scores(docs.repartition(4), updates=1, block_bytes=5000, share=0.01, least=0)
    assert one.keys() == many.keys() and all(many[k] == pytest.approx(v, rel=2e-3) for k, v in one.items())


def test_later_updates_take_a_share_of_blocks(spark):
    """A half of the blocks moves the weights, and about as all of them do."""
    docs = spark.read.parquet(DOCS)
    first, half, whole = (scores(docs, block_bytes=5000, **kw) for kw in ({"updates": 1}, {"share": 0.5, "least": 0}, {"share": 1.0}))
    held = [r.doc_id for r in maxent.score(docs).where("held_out").collect()]
    total = lambda x: sum(x[k] for k in held)
    assert total(half) != total(first) and total(half) != total(whole)
    assert abs(total(half) - total(whole)) < 0.02 * abs(total(whole))


def test_without_training_texts_each_word_is_unseen(spark):
    ids = [i for i in range(300) if maxent.held_out(i, maxent.Shape())]
    docs = spark.createDataFrame([(i, "some words here") for i in ids], "doc_id long, text string")
    rows = maxent.score(docs).collect()
    assert len(rows) == len(ids) and all(r.held_out and (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (4, 0, 0, 0) and r.score < 0 for r in rows)


def test_every_block_enters_every_update_by_default(spark):
    """Before, the second update read a hashed sixth of the blocks; ``least`` hid that on small tables."""
    docs = spark.read.parquet(DOCS)
    got, whole = scores(docs, block_bytes=5000, least=0), scores(docs, block_bytes=5000, share=1.0)
    assert all(got[k] == pytest.approx(v, rel=2e-3) for k, v in whole.items())
    assert maxent.Shape().share == 1
