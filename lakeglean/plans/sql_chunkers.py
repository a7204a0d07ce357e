"""Chunkers as table functions for SQL: chunk(text, n) to be joined laterally, and pack_rows over a partitioned table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..functions.text import BLANKS
from ..operators.chunking import DELIMITERS, groups


def n_words(text: str) -> int:
    """Tokens as functions.text.n_tokens counts them: words, and each character of a script without blanks."""
    import regex

    unspaced = regex.compile(r"([\p{Han}\p{Hiragana}\p{Katakana}ー\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])")
    return len(regex.findall(r"[\p{L}\p{M}\p{N}]+", unspaced.sub(r" \1 ", text)))


def runs(ids: list[int]) -> Iterator[tuple[int, slice]]:
    """Each group number with the places that have it."""
    start = 0
    for g, own in groupby(ids):
        end = start + sum(1 for _ in own)
        yield g, slice(start, end)
        start = end


class Chunk:
    """Rows (seq, text, n_tokens) of a text, as chunk_merge makes them; a null text has none."""

    def eval(self, text: str, n: int) -> Iterator[tuple]:
        parts: list[str] = []
        for line in (text or "").split("\n"):
            if line.strip(BLANKS):
                parts += [p for p in re.split(f"[{re.escape(DELIMITERS)}]", line) if p.strip(BLANKS)] if n_words(line) >= n else [line]
        sizes = [n_words(p) for p in parts]
        for g, own in runs(groups(sizes, n, over=True)):
            if (whole := "\n".join(parts[own])).strip(BLANKS):
                yield g, whole, sum(sizes[own])


class PackRows:
    """Rows (key, seq, text, n_tokens) of a table (key, text, ...) partitioned by its key: its texts in turn, packed to fewer than n tokens."""

    def __init__(self) -> None:
        self.key, self.texts, self.n = None, [], 0

    def eval(self, row: Row, n: int) -> None:
        self.key, self.n = row[0], n
        self.texts.append(row[1] or "")

    def terminate(self) -> Iterator[tuple]:
        sizes = [n_words(x) for x in self.texts]
        for g, own in runs(groups(sizes, self.n - 1, over=False)):
            yield self.key, g, "\n".join(self.texts[own]), sum(sizes[own])


def register_chunkers(spark: SparkSession) -> None:
    """chunk and pack_rows for SQL."""
    spark.udtf.register("chunk", udtf(Chunk, returnType="seq int, text string, n_tokens long"))
    spark.udtf.register("pack_rows", udtf(PackRows, returnType="key long, seq int, text string, n_tokens long"))
