"""Extraction jobs: pattern entities, keywords, summaries, structured items, model fields. Expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import without_blanks

# Entity patterns (matched without regard to case) and English stop words.
PATTERNS = {
    "PERSON": r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
    "ORG": r"\b[A-Z][A-Za-z\s&]+(?:Inc|Corp|LLC|Ltd|Company|Corporation)\b",
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE": r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b",
    "DATE": r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b",
    "MONEY": r"\$[\d,]+(?:\.\d{2})?|\b\d+(?:\.\d{2})?\s*(?:dollars?|USD|EUR|GBP)\b",
}
STOP_WORDS = (
    "the a an and or but in on at to for of with by is are was were be been being have has had do does did will would could should may might must can "
    "this that these those i you he she it we they me him her us them my your his its our their from up down out off over under again further then once "
    "here there when where why how all both each few more most other some such no nor not only own same so than too very"
).split()


def extract_entities(docs: DataFrame, types: tuple = ("PERSON", "ORG", "EMAIL", "PHONE", "DATE"), least: int = 2, most: int = 50) -> DataFrame:
    """(doc_id, type, entity): the distinct matches of each pattern, of a fitting length."""
    found = F.array(*(F.struct(F.lit(t).alias("type"), F.array_distinct(F.regexp_extract_all("text", F.lit(f"(?i){PATTERNS[t]}"), F.lit(0))).alias("found")) for t in types))
    own = docs.select("doc_id", F.explode(found).alias("x")).select("doc_id", "x.type", F.explode("x.found").alias("entity"))
    return own.where(F.length("entity").between(least, most))


def extract_keywords(docs: DataFrame, k: int = 20, least: int = 3) -> DataFrame:
    """(doc_id, keyword, n, score): the most frequent words of ASCII letters, long enough and no stop words; equals by the word."""
    w = F.filter(F.split(F.lower("text"), "[^a-z0-9_à-öø-ÿ]+"), lambda x: (F.length(x) >= least) & x.rlike("^[a-z]+$") & ~x.isin(STOP_WORDS))
    counts = docs.select("doc_id", F.explode(w).alias("keyword")).groupBy("doc_id", "keyword").agg(F.count("*").alias("n"))
    by = Window.partitionBy("doc_id")
    top = counts.withColumns({"total": F.sum("n").over(by), "r": F.row_number().over(by.orderBy(F.col("n").desc(), "keyword"))}).where(F.col("r") <= k)
    return top.select("doc_id", "keyword", "n", (F.col("n") / F.col("total")).alias("score"))


def extract_summary(docs: DataFrame, sentences: int = 3, most: int = 200) -> DataFrame:
    """(doc_id, summary, ratio): all of at most `sentences` sentences, else the first and the last, cut with '...'; null of a null text."""
    s = F.filter(F.transform(F.split("text", "[.!?]+"), without_blanks), lambda x: x != "")
    own = docs.select("doc_id", F.length("text").alias("n"), s.alias("s"))
    kept = F.when(F.size("s") <= sentences, F.col("s")).otherwise(F.array(F.get("s", 0), F.element_at("s", -1)))
    full = F.when(F.col("s").isNotNull(), F.concat(F.array_join(kept, ". "), F.lit(".")))
    cut = F.when(F.length(full) > most, F.concat(F.substring(full, 1, most), F.lit("..."))).otherwise(full)
    return own.select("doc_id", cut.alias("summary"), F.when(F.col("n") > 0, F.length(cut) / F.col("n")).when(F.col("n") == 0, 0.0).alias("ratio"))


ITEMS = "array<struct<extraction_class string, extraction_text string, attributes map<string,string>>>"


def extractions(responses: DataFrame, text: str = "response") -> DataFrame:
    """(doc_id, seq, class, text, attributes) of JSON lists of items."""
    own = responses.select("doc_id", F.posexplode(F.from_json(text, ITEMS)).alias("seq", "x"))
    return own.select("doc_id", "seq", F.col("x.extraction_class").alias("class"), F.col("x.extraction_text").alias("text"), "x.attributes")


def merge_extractions(items: DataFrame) -> DataFrame:
    """One row for each (doc_id, class, text); of an attribute the latest value stays."""
    attr = items.select("doc_id", "class", "text", "seq", F.explode_outer("attributes").alias("k", "v"))
    last = attr.groupBy("doc_id", "class", "text", "k").agg(F.max_by("v", "seq").alias("v"))
    return last.groupBy("doc_id", "class", "text").agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v"))))).alias("attributes"))


def apply_auto_fields(chunks: DataFrame, responses: DataFrame) -> DataFrame:
    """Chunks with keyword and question arrays from a model's response (chunk_id, keywords, questions)."""
    parts = lambda c, by: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), lambda x: F.trim(x)), lambda x: x != "")
    return chunks.join(responses, "chunk_id", "left").withColumns({"important_kwd": parts(F.col("keywords"), ","), "question_kwd": parts(F.col("questions"), "\n")}).drop("keywords", "questions")
