"""Extension points: models as functions, chunkers by name, linear pipelines from a specification."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BEYOND_PLAIN, NARROW, UNSPACED_PAIR, UNSPACED_RUN, WIDE, WORD_BREAK
from ..operators.catalog import with_cache
from ..operators.chunking import CHUNKERS, chunk_merge
from ..operators.embed import embed
from ..operators.extract import extract_keywords, extract_summary

Chat = Callable[[Column], Column]


def relevance_udf(similarity: Callable[[list[str], list[str]], list[float]]):
    """A (query, text) -> double function from one over lists."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            yield pd.Series(similarity(q.tolist(), t.tolist()), dtype="float64")

    return run


def answered(df: DataFrame, prompt: Column, chat: Chat, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df with `value`, the model's answer to the prompt; equal prompts are asked once and known ones not at all."""
    return with_cache(df.withColumn("prompt", prompt), cache, F.md5(prompt), chat(F.col("prompt")))


STEPS: dict[str, Callable[..., DataFrame]] = {
    "chunk": lambda df, method="naive", **kw: CHUNKERS[method](df, **kw),
    "embed": lambda df, **kw: embed(df, kw.pop("text", "text"), **kw),
    "keywords": extract_keywords,
    "summary": extract_summary,
    "where": lambda df, condition: df.where(condition),
    "select": lambda df, columns: df.select(*columns),
}


def pipeline(df: DataFrame, spec: list[dict]) -> DataFrame:
    """Steps such as {"step": "chunk", "method": "naive", "n": 128} in turn; an unknown step or parameter is an error."""
    for s in spec:
        args = {k: v for k, v in s.items() if k != "step"}
        df = df.transform(STEPS[s["step"]], **args)
    return df


def for_each(df: DataFrame, key: str, items: str, flow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, items): a flow over (key, pos, item) rows of an array, collected again by position."""
    rows = flow(df.select(key, F.posexplode(items).alias("pos", "item")))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias(items))


def register_sql(spark) -> None:
    """text_tokens, token_match and vector_cosine for SQL; text_tokens are those of functions.text.tokens."""

    def literal(x: str) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def words(t: str) -> str:
        return f"filter(split(lower({t}), {literal(WORD_BREAK)}), x -> x <> '')"

    half = f"translate(t, {literal(WIDE)}, {literal(NARROW)})"
    apart = f"regexp_replace({half}, {literal(UNSPACED_RUN)}, ' $1 ')"
    pairs = f"regexp_replace({apart}, {literal(UNSPACED_PAIR)}, '$1$2 ')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_tokens(t STRING) RETURNS ARRAY<STRING> RETURN CASE WHEN t rlike {literal(BEYOND_PLAIN)} THEN {words(pairs)} ELSE {words("coalesce(t, '')")} END")
    asked = "array_distinct(text_tokens(q))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION token_match(t STRING, q STRING, f DOUBLE) RETURNS BOOLEAN RETURN size(array_intersect(text_tokens(t), {asked})) >= greatest(floor(size({asked}) * f), 1)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION vector_cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + double(x) * double(x)) * aggregate(b, 0D, (s, x) -> s + double(x) * double(x)))")


__all__ = ["CHUNKERS", "answered", "chunk_merge", "for_each", "pipeline", "register_sql", "relevance_udf"]
