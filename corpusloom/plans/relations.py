"""The relations that the queries read, built from the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.session import table

METHODS = 7


def observations(spark: SparkSession, base: str) -> DataFrame:
    """Benchmark observations: order lines as timed runs, the line number as method (1 is the reference), the priority as dataset."""
    lines = table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_shipdate", "l_partkey", "l_suppkey")
    orders = table(spark, base, "orders").select("o_orderkey", "o_orderpriority")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        F.col("o_orderpriority").alias("dataset"),
        F.col("l_orderkey").alias("sample_id"),
        F.col("l_linenumber").cast("int").alias("method"),
        F.when(F.col("l_linestatus") == "F", "success").otherwise("failed").alias("status"),
        F.col("l_returnflag").alias("run"),
        F.col("l_extendedprice").alias("e2e_ms"),
        F.when(F.col("l_tax") > 0, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("decode_ms"),
        F.col("l_quantity").cast("long").alias("output_tokens"),
        F.col("l_shipdate").alias("ended"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supplier"),
    )


#: The same in SQL.
OBS = """
obs AS (SELECT o_orderpriority AS dataset, l_orderkey AS sample_id, CAST(l_linenumber AS INT) AS method,
  CASE WHEN l_linestatus = 'F' THEN 'success' ELSE 'failed' END AS status, l_returnflag AS run,
  l_extendedprice AS e2e_ms, CASE WHEN l_tax > 0 THEN l_extendedprice * (1 - l_discount) END AS decode_ms,
  CAST(l_quantity AS BIGINT) AS output_tokens, l_shipdate AS ended, l_partkey AS part, l_suppkey AS supplier
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def documents(spark: SparkSession, base: str) -> DataFrame:
    """Documents with their word count."""
    d = table(spark, base, "documents").select("doc_id", "text", "lang", "source", "n_chars", "dataset", "title")
    return d.withColumn("words", X.word_count(F.col("text")))


def words_sql(x: str) -> str:
    """The words of a text in SQL."""
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{X.SPACE}+'), lambda w: w <> '')"


#: Documents with their word count in SQL.
DOCS = f"docs AS (SELECT doc_id, text, lang, source, n_chars, dataset, title, CAST(len({words_sql('text')}) AS INT) AS words FROM documents)"


def teacher(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "teacher_records")


def corpus(spark: SparkSession, base: str) -> DataFrame:
    """Corpus records with a measured length, as delivered."""
    return table(spark, base, "corpus_records").where(F.col("document_words") > 0)
