"""Vectors of texts from a table of token vectors (masked mean pooling), and late interaction of query and document tokens, in Arrow batches.

The table is a matrix of a checked size that is sent once to each executor and read once by each worker; tokens are rows of it by number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import terms

#: Bytes of a table of token vectors, at most; rows of tokens that a task pads at once.
TABLE_BYTES, PADDED = 256 << 20, 1 << 18


def sent(spark: SparkSession, table: np.ndarray) -> Broadcast:
    if table.nbytes > TABLE_BYTES:
        raise ValueError(f"a table of token vectors has {TABLE_BYTES} bytes at most")
    return spark.sparkContext.broadcast(table)


def token_numbers(text: Column, n: int) -> Column:
    """A number below ``n`` for each term of a text: by its length, its first and its last character."""
    return F.transform(terms(text), lambda t: ((F.length(t) * 31 + F.ascii(t) * 7 + F.ascii(F.substring(t, -1, 1))) % n).cast("int"))


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(col.flatten()), np.asarray(pc.fill_null(pc.list_value_length(col), 0)).astype(np.int64)


def pooled(docs: DataFrame, key: str, tokens: Column, table: Broadcast) -> DataFrame:
    """(key, vector): the mean of each text's token vectors, of length 1; a text without tokens has the zero vector. Texts of like length are padded
    together, so that little is; a text longer than a block is added up in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.vstack([table.value, np.zeros((1, table.value.shape[1]))])  # the last row stands for padding
        pad = len(weights) - 1
        for b in batches:
            flat, size = _lists(b["tokens"])
            heads, out = np.cumsum(size) - size, np.zeros((b.num_rows, weights.shape[1]))
            order, at = np.argsort(size, kind="stable"), 0
            while at < len(order):
                end = at + 1
                while end < len(order) and (end + 1 - at) * size[order[end]] <= PADDED:
                    end += 1
                rows = order[at:end]
                longest = int(size[rows].max())
                for start in range(0, longest, PADDED):
                    place = np.arange(start, min(longest, start + PADDED))
                    inside = place[None] < size[rows][:, None]
                    ids = np.where(inside, flat[np.minimum(heads[rows][:, None] + place[None], max(0, len(flat) - 1))] if len(flat) else pad, pad)
                    for part in range(0, len(place), 512):
                        out[rows] += weights[ids[:, part : part + 512]].sum(axis=1)
                at = end
            out /= np.maximum(size, 1)[:, None]
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            out /= np.where(norm > 0, norm, 1)
            yield pa.record_batch({key: b["k"], "vector": pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * out.shape[1], pa.int32()), pa.array(out.ravel()))})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), tokens.alias("tokens")).mapInArrow(run, f"{key} {kind}, vector array<double>")


def late_interaction(pairs: DataFrame, query: str, key: str, table: Broadcast, asked: str = "asked", tokens: str = "tokens") -> DataFrame:
    """(query, key, score): for each pair of a query and a candidate, with their distinct tokens, the sum over the query's tokens of the largest
    product with one of the candidate's; 0 if it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = table.value
        for b in batches:
            (q, nq), (d, nd) = _lists(b["a"]), _lists(b["t"])
            hq, hd, out = np.cumsum(nq) - nq, np.cumsum(nd) - nd, np.zeros(b.num_rows)
            for i in np.flatnonzero((nq > 0) & (nd > 0)):
                best = np.full(nq[i], -np.inf)
                for at in range(hd[i], hd[i] + nd[i], 4096):
                    best = np.maximum(best, (weights[q[hq[i] : hq[i] + nq[i]]] @ weights[d[at : min(at + 4096, hd[i] + nd[i])]].T).max(axis=1))
                out[i] = best.sum()
            yield pa.record_batch({query: b["q"], key: b["k"], "score": out})

    kinds = [pairs.schema[c].dataType.simpleString() for c in (query, key)]
    return pairs.select(F.col(query).alias("q"), F.col(key).alias("k"), F.col(asked).alias("a"), F.col(tokens).alias("t")).mapInArrow(run, f"{query} {kinds[0]}, {key} {kinds[1]}, score double")
