"""Readers and writers of the text formats around the crawl, the graph, the runs and the judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from seamark.functions.text import term_counts


def _lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Lines with a number that keeps their order within a file."""
    rows = spark.read.option("encoding", encoding).option("lineSep", "\n").csv(path, schema="value string", sep="\u0001", quote="\u0002") if encoding != "UTF-8" else spark.read.text(path)
    return rows.withColumn("line", F.monotonically_increasing_id())


def _last(rows: DataFrame, *key: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("line")))
    return rows.withColumn("__n", rank).where("__n = 1").drop("__n", "line")


def read_qrels(spark: SparkSession, path: str, glued: bool = False) -> DataFrame:
    """(query_id, assessor_id, doc_id, grade) of lines with four fields; others are dropped, the last of repeated ones wins.

    With ``glued``, lines with more fields are read by their first four, the digits of the fourth as the grade.
    """
    f = F.split("value", " ")
    fields = F.size(f) >= 4 if glued else F.size(f) == 4
    rows = _lines(spark, path).where(fields).select("line", f[0].alias("query_id"), f[1].alias("assessor_id"), f[2].alias("doc_id"), f[3].try_cast("int").alias("grade"))
    return _last(rows.where("grade IS NOT NULL"), "query_id", "assessor_id", "doc_id")


def read_run(spark: SparkSession, path: str, doc_col: int = 1, score_col: int = 3) -> DataFrame:
    """(query_id, doc_id, score) of a run, by the columns of document and score: 1 and 3 with four columns, 2 and 4 with five."""
    f = F.split("value", " ")
    rows = _lines(spark, path).where(F.size(f) > max(doc_col, score_col)).select("line", f[0].alias("query_id"), f[doc_col].alias("doc_id"), f[score_col].try_cast("double").alias("score"))
    return _last(rows.where("score IS NOT NULL"), "query_id", "doc_id")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of lines ``no.   text``."""
    f = F.split("value", r"\.   ", 2)
    return spark.read.text(path).where(F.size(f) == 2).select(f[0].alias("query_id"), F.trim(f[1]).alias("text"))


def read_adjacency(spark: SparkSession, path: str, blank_node: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes and distinct edges (page, neighbour) of lines ``page n1 n2 ...``.

    A page's last line without neighbours forgets its lines before, as a reader of a map does.  Blank lines are
    left out; ``blank_node`` keeps the empty page they stand for.
    """
    f = F.split(F.rtrim("value"), " +")
    rows = _lines(spark, path).select("line", f[0].alias("src"), F.filter(F.slice(f, 2, 1 << 30), lambda x: x != "").alias("links"))
    rows = rows if blank_node else rows.where("src <> ''")
    reset = F.max(F.when(F.size("links") == 0, F.col("line"))).over(W.partitionBy("src"))
    edges = rows.withColumn("reset", F.coalesce(reset, F.lit(-1))).where("line > reset").select("src", F.explode("links").alias("dst")).distinct()
    return rows.select(F.col("src").alias("id")).distinct(), edges


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id): distinct trimmed lines without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def read_crawl_log(spark: SparkSession, path: str, plain_http: bool = False) -> DataFrame:
    """(id): first field of each line; ``plain_http`` turns https into http, as for foreign histories."""
    first = F.split("value", " ")[0]
    return spark.read.text(path).select((F.replace(first, F.lit("https"), F.lit("http")) if plain_http else first).alias("id")).where("id <> ''").distinct()


def read_words(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", stop: list[str] | None = None, stem: bool = False) -> DataFrame:
    """(word): a list with one word per line; with ``stop`` and ``stem`` analysed as keywords are, stop words first, then stems."""
    words = _lines(spark, path, encoding).select(F.trim("value").alias("word")).where("word <> ''").distinct()
    if not stop and not stem:
        return words
    rows = words.select(F.col("word").alias("doc_id"), F.array(F.lower("word")).alias("words"))
    return term_counts(rows, stop, stem, stop_first=True).select(F.col("term").alias("word")).distinct()


def read_partitions(spark: SparkSession, path: str) -> DataFrame:
    """Crawl partitions as one table; unreadable files are skipped."""
    return spark.read.option("ignoreCorruptFiles", "true").parquet(path)


def adjacency_lines(adjacency: DataFrame) -> DataFrame:
    """Lines ``page n1 n2 ...`` of (id, links)."""
    return adjacency.select(F.concat_ws(" ", "id", "links").alias("value"))


def run_lines(run: DataFrame, user: str | None = None) -> DataFrame:
    """Lines of a ranked run (query_id, doc_id, rank, score): four columns, or five with a user."""
    middle = [F.lit(user)] if user else []
    return run.select(F.concat_ws(" ", "query_id", *middle, "doc_id", F.col("rank").cast("string"), F.col("score").cast("string")).alias("value"))


def qrel_lines(qrels: DataFrame, keep_query: bool = True) -> DataFrame:
    """Lines ``query doc grade``, or ``doc grade``."""
    return qrels.select(F.concat_ws(" ", *(["query_id"] if keep_query else []), "doc_id", F.col("grade").cast("string")).alias("value"))


def score_lines(top: DataFrame, with_degrees: bool = False) -> DataFrame:
    """Tab-separated lines of a top list, with both degrees if wanted."""
    more = [F.concat(F.lit("inlinks "), "n_in"), F.concat(F.lit("outlinks "), "n_out")] if with_degrees else []
    return top.select(F.concat_ws("\t", "id", F.col("score").cast("string"), *more).alias("value"))


def trec_documents(docs: DataFrame, key: str, head: str, text: str, wave: str) -> DataFrame:
    """(wave, value): each document in TREC form, the text on lines of its own, with a line end behind the document."""
    c = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(""))
    value = F.concat(F.lit("<DOC>\n<DOCNO>"), c(key), F.lit("</DOCNO>\n<HEAD>"), c(head), F.lit("</HEAD>\n<TEXT>\n"), c(text), F.lit("\n</TEXT>\n</DOC>\n"))
    return docs.select(F.col(wave).alias("wave"), value.alias("value"))


def write_trec(records: DataFrame, path: str) -> None:
    """Append TREC records to one folder per wave; the writer adds each record's last line end."""
    lines = records.withColumn("value", F.regexp_replace("value", r"\n$", ""))
    lines.write.mode("append").partitionBy("wave").text(path)


def write_text(lines: DataFrame, path: str, by: str | None = None) -> None:
    """Write lines; with ``by`` in one folder per value."""
    writer = lines.write.partitionBy(by) if by else lines.write
    writer.text(path)
