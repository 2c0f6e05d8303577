"""Table functions for SQL: ``register(spark)``, then e.g.

    SELECT d.doc_id, w.* FROM documents d, LATERAL code_windows(d.text, 300, 30, 20) w
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import code, fixed
from .text import porter


class CodeWindows:
    """The overlapping windows of a text's lines, by tokens: shard_index, start_line, end_line, text."""

    def eval(self, text: str, most: int = fixed.MAX_CHUNK_TOKENS, overlap: int = fixed.OVERLAP_TOKENS, least: int = fixed.MIN_CHUNK_TOKENS) -> Iterator[tuple]:
        from ..operators.chunks import windows

        lines = (text or "").split("\n")
        for i, (a, z) in enumerate(windows(lines, most, overlap, least) if text else []):
            yield i, a + 1, z, "\n".join(lines[a:z])


class CodeDeclarations:
    """The declarations of a source text: is_import, start_line, end_line, text."""

    def eval(self, text: str) -> Iterator[tuple]:
        text = text or ""
        for is_import, a, z in code.declarations(text):
            yield is_import, text.count("\n", 0, a) + 1, text.count("\n", 0, z) + 1, text[a:z]


def register(spark: SparkSession) -> None:
    """code_windows and code_declarations as table functions, porter_stem as a scalar one."""
    spark.udtf.register("code_windows", F.udtf(CodeWindows, returnType="shard_index int, start_line int, end_line int, text string", useArrow=True))
    spark.udtf.register("code_declarations", F.udtf(CodeDeclarations, returnType="is_import boolean, start_line int, end_line int, text string", useArrow=True))

    @F.arrow_udf("string")
    def stem(words):
        import pyarrow as pa

        coded = words.dictionary_encode()
        return pa.array([None if w is None else porter(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    spark.udf.register("porter_stem", stem)
