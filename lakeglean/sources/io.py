"""Sources and sinks: corpora, delimited files, JSON, binary files, JDBC, scans of many tables, scoped SQL, reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import union_all


def scan_chunks(spark: SparkSession, paths: list[str], kb_ids: list | None = None, columns: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """All tables that are there as one, missing columns null, pruned to datasets and columns, in a global order if one is given."""
    found = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            df = spark.read.parquet(path)
            found.append(df.where(F.col("kb_id").isin(kb_ids)) if kb_ids is not None and "kb_id" in df.columns else df)
    out = union_all(found) if found else spark.createDataFrame([], "id string")
    out = out.orderBy(*order) if order else out
    return out.select(*columns) if columns else out


def load_passages(df: DataFrame, query: str, lists: dict[str, str]) -> DataFrame:
    """A row for each element of the parallel arrays: (query, pos, names of lists)."""
    zipped = F.arrays_zip(*(F.col(c).alias(n) for n, c in lists.items()))
    return df.select(F.col(query).alias("query"), F.posexplode(zipped).alias("pos", "x")).select("query", "pos", *(f"x.{n}" for n in lists))


def load_jsonl(spark: SparkSession, path: str, schema: str = "docid string, text string") -> DataFrame:
    return spark.read.schema(schema).json(path)


def load_topics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id string, text string").csv(path, sep="\t")


def load_qrels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("query_id string, q0 string, chunk_id string, rel int").csv(path, sep="\t").drop("q0")


def read_delimited(lines: DataFrame, sep: str = "\t", text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(rows, bad): lines (path, n, value), the first of each path its header, parted without quoting.

    rows: (path, n, cells map); bad: lines whose number of cells differs. A header with repeated names is an error.
    """
    own = lines.withColumn("cells", F.split(text, re.escape(sep), -1))
    head = own.where("n = 0").select("path", F.col("cells").alias("names"))
    if not head.where(F.size(F.array_distinct("names")) < F.size("names")).isEmpty():
        raise ValueError("a header repeats a name")
    body = own.where("n > 0").join(head, "path")
    good = F.size("cells") == F.size("names")
    return body.where(good).select("path", "n", F.map_from_arrays("names", "cells").alias("cells")), body.where(~good).select("path", "n", text)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, value) of whole files, read as such so that lines keep their numbers."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "value")).where((F.col("n") == 0) | (F.col("value") != ""))


def read_json_any(files: DataFrame, text: str = "text") -> DataFrame:
    """(path, seq, v variant): JSON lines if at least 80 % of the first ten lines are JSON, else one document; bad lines go."""
    own = files.withColumn("l", F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""))
    head = F.slice("l", 1, 10)
    share = F.size(F.filter(head, lambda x: F.try_parse_json(x).isNotNull())) / F.size(head)
    own = own.withColumn("parts", F.when((share >= 0.8) & (F.size("l") > 1), F.col("l")).otherwise(F.array(text)))
    return own.select("path", F.posexplode("parts").alias("seq", "p")).select("path", "seq", F.try_parse_json("p").alias("v")).where("v is not null")


def read_binary(spark: SparkSession, glob: str, most: int = 128 << 20) -> DataFrame:
    """Files up to `most` bytes: (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").load(glob).where(F.col("length") <= most)


def statements(sql: str, params: dict[str, str] | None = None) -> list[str]:
    """Statements of a script: [ID:n] marks out, ${name} filled in, parted at ;."""
    sql = re.sub(r"\[ID:\d+\]", "", sql)
    for k, v in (params or {}).items():
        sql = sql.replace("${%s}" % k, str(v))
    return [s.strip() for s in sql.split(";") if s.strip()]


def plain_types(df: DataFrame) -> DataFrame:
    """Decimals as doubles, timestamps as yyyy-MM-dd."""
    out = {}
    for name, kind in df.dtypes:
        if kind.startswith("decimal"):
            out[name] = F.col(name).cast("double")
        elif kind.startswith("timestamp"):
            out[name] = F.date_format(name, "yyyy-MM-dd")
    return df.withColumns(out)


def sql_script(spark: SparkSession, sql: str, params: dict[str, str] | None = None, max_records: int = 1024) -> list[DataFrame]:
    """Results of the statements over the session's views, each of at most max_records rows."""
    return [plain_types(spark.sql(s)).limit(max_records) for s in statements(sql, params)]


def jdbc_query(spark: SparkSession, options: dict[str, str], sql: str, params: dict[str, str] | None = None, max_records: int = 1024) -> list[DataFrame]:
    """The same against a database by JDBC (options: url, user, driver ...)."""
    return [plain_types(spark.read.format("jdbc").options(**options).option("query", s).load()).limit(max_records) for s in statements(sql, params)]


def jdbc_table(spark: SparkSession, options: dict[str, str], table: str, column: str, partitions: int) -> DataFrame:
    """A table (or a subquery with a name) of a database, read in partitions of a numeric column between its ends.

    The ends are asked for first, one row; filters and columns of what follows go to the database with each partition.
    """
    reader = spark.read.format("jdbc").options(**options)
    ends = reader.option("query", f"SELECT min({column}) AS LO, max({column}) AS HI FROM {table}").load().head()
    whole = spark.read.format("jdbc").options(**options, dbtable=table)
    if ends is None or ends[0] is None:
        return whole.load()
    return whole.options(partitionColumn=column, lowerBound=str(ends[0]), upperBound=str(ends[1] + 1), numPartitions=str(partitions)).load()


def token_match(column: str, query: str, share: float = 0.3) -> Column:
    """Whether a text has at least a share of the query's tokens."""
    from ..functions.text import tokens

    q = F.array_distinct(tokens(F.lit(query)))
    return F.size(F.array_intersect(tokens(F.col(column)), q)) >= F.greatest(F.floor(F.size(q) * share), F.lit(1))


def sql_over_fields(spark: SparkSession, table: DataFrame, view: str, sql: str, kb_ids: list | None = None, kb_col: str = "kb_id") -> DataFrame:
    """SQL over a view of one table that holds the datasets in scope alone."""
    (table.where(F.col(kb_col).isin(kb_ids)) if kb_ids is not None else table).createOrReplaceTempView(view)
    return spark.sql(sql)


def render_table(df: DataFrame, labels: dict[str, str], source: str) -> DataFrame:
    """(line) of each row that is not blank: cells by |, times of day cut, the source last."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"(\d{4}-\d\d-\d\d)[T ]\d\d:\d\d:\d\d(\.\d+)?", "$1") for c in labels]
    return df.select(F.concat(F.lit("|"), F.concat_ws("|", *cells, F.col(source).cast("string")), F.lit("|")).alias("line"), F.concat(*cells).alias("all")).where(F.trim("all") != "").drop("all")


def field_map(maps: DataFrame) -> DataFrame:
    """(name, label) of (seq, fields map): the label of the latest dataset."""
    return maps.select("seq", F.explode("fields").alias("name", "label")).groupBy("name").agg(F.max_by("label", "seq").alias("label"))


def write_run(hits: DataFrame, path: str, name: str) -> None:
    """Ranked hits (query_id, rank, chunk_id, score) as lines of a run file: query, Q0, chunk, rank, score, name."""
    cells = [F.col(c).cast("string") for c in ("query_id", "chunk_id", "rank", "score")]
    hits.select(F.concat_ws(" ", cells[0], F.lit("Q0"), *cells[1:], F.lit(name)).alias("value")).write.mode("overwrite").text(path)


def write_qrels(qrels: DataFrame, path: str) -> None:
    """Judgements (query_id, chunk_id, rel) as tab-separated lines that load_qrels reads."""
    qrels.select("query_id", F.lit("0").alias("q0"), "chunk_id", "rel").write.mode("overwrite").csv(path, sep="\t")


def write_eval_report(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
