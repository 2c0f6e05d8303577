"""Updates of op9 work out a history once for all tokens of some blocks that have it, with the sums that tokens one by one give."""

import numpy as np
import pytest

from tessera.llm import maxent


def made(words, texts):
    """A block's words, codes and ends of texts."""
    known = [*words, maxent.END]
    full = [[*(known.index(w) for w in t), len(known) - 1] for t in texts]
    return maxent.kinds(known), np.concatenate(full).astype(np.int32), np.cumsum([0, *map(len, full)])


def test_contexts_add_up_to_what_tokens_do(monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{i}{e}" for i in range(60) for e in ("ing", "er", "s")]
    texts = [[words[min(int(x), 179)] for x in rng.exponential(12, n)] for n in rng.integers(0, 400, 60)] + [["w0ing"] * 5000, []] + [["w1s", "w2er"]] * 300
    own, codes, ends = made(words, texts)
    on, bits = np.repeat(rng.random(len(texts)) < 0.8, np.diff(ends)), 12
    table = rng.normal(0, 0.5, (maxent.Shape().rows(bits), maxent.WIDTH)).astype(np.float32)
    prior = maxent.Priors.of(rng.integers(0, 50, (maxent.WIDTH, maxent.WIDTH)))
    want, got = np.zeros((len(table), maxent.WIDTH)), np.zeros_like(table)
    rows, cls, _ = maxent.features(own, codes, ends, bits)
    rows, cls = rows[:, on], cls[on]
    for layer in (0, 1):
        z = table[rows[4 * layer : 4 * layer + 4]].sum(axis=0) + (prior.columns[cls] if layer else prior.classes)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        for r in rows[4 * layer : 4 * layer + 4]:
            np.add.at(want, r, p)
    cut = len(ends) // 2  # two blocks, each with the whole dictionary in an order of its own
    back = np.roll(np.arange(own.shape[1] - 1), 7)
    other = np.append(np.argsort(back), len(back)).astype(np.int32)
    blocks = [(own, codes[: ends[cut]], ends[: cut + 1], on[: ends[cut]]), (own[:, [*back, len(back)]], other[codes[ends[cut] :]], ends[cut:] - ends[cut], on[ends[cut] :])]
    monkeypatch.setattr(maxent, "CONTEXTS", 1000)
    found = list(maxent.contexts(blocks, bits))
    n = sum(len(seen) for _, _, seen in found)
    assert sum(seen.sum() for _, _, seen in found) == on.sum() and n < on.sum() / 2 and max(seen.max() for _, _, seen in found) <= maxent.MOST_SEEN
    for rows, cls, seen in found:
        maxent.expectations(table, prior, rows, cls, got, seen)
    assert got == pytest.approx(want, rel=1e-3, abs=0.02)


@pytest.mark.parametrize("size", [1, 31, 32, 33, 8192, 8193, 20000])
def test_sums_of_rows_at_the_edges_of_slices(size):
    rng = np.random.default_rng(size)
    table, prior = np.zeros((40, maxent.WIDTH), np.float32), maxent.Priors.of(np.ones((maxent.WIDTH, maxent.WIDTH), np.int64))
    rows, cls, got = rng.integers(0, 40, (8, size)).astype(np.int32), rng.integers(0, 63, size), np.zeros((40, maxent.WIDTH), np.float32)
    maxent.expectations(table, prior, rows, cls, got)
    assert got.sum(axis=1) == pytest.approx(np.bincount(rows.ravel(), minlength=40), rel=1e-3)
