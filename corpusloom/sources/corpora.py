"""Corpus readers: each layout becomes the canonical record, and what can't be read becomes a skip record with its reason.

A record has id, dataset, source_split, source_index, source_id, task_type, document, reference, num_source_docs, title
and reason; reason is null for a good one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.sources.jsonl import lines, objects

COLUMNS = ["id", "dataset", "source_split", "source_index", "source_id", "task_type", "document", "reference", "num_source_docs", "title", "reason"]


def _record(df: DataFrame, dataset: str, split: str, task: str = "summarization") -> DataFrame:
    good = F.when(F.coalesce(F.col("document"), F.lit("")) == "", "empty_document").when(F.coalesce(F.col("reference"), F.lit("")) == "", "empty_reference")
    reason = F.coalesce(F.col("reason"), good) if "reason" in df.columns else good
    out = df.withColumn("reason", reason).withColumn("dataset", F.lit(dataset)).withColumn("source_split", F.lit(split)).withColumn("task_type", F.lit(task))
    out = out.withColumn("id", F.concat_ws("-", "dataset", "source_split", F.lpad(F.col("source_id").cast("string"), 10, "0")))
    for c, kind in (("num_source_docs", "int"), ("title", "string"), ("source_index", "int")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(1 if c == "num_source_docs" else None).cast(kind))
    return out.select(*COLUMNS)


def _objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON with their place; a record without an id goes by its place in its file, from 0."""
    rows = objects(lines(spark, path)).where(F.col("keys").isNotNull())
    return rows.select("file", "line", F.from_json("value", schema).alias("r")).select("file", "line", "r.*")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9.]+)?$", 1)


def segmented(spark: SparkSession, path: str, dataset: str = "vietnews", split: str = "test") -> DataFrame:
    """Files of blocks between blank lines: title, summary, then the document; joined syllables are set apart."""
    f = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt*", recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    b = X.blocks(F.col("value"))
    few = F.when(F.size(b) < 3, "fewer_than_three_blocks")
    part = lambda c: X.nfc(X.unsegment(c))
    rows = f.select(stem(F.col("path")).alias("source_id"), few.alias("reason"), F.try_element_at(b, F.lit(1)).alias("t"), F.try_element_at(b, F.lit(2)).alias("r"), F.array_join(F.slice(b, F.lit(3), F.greatest(F.size(b) - 2, F.lit(0))), "\n").alias("d"))
    return _record(rows.select("source_id", "reason", part(F.col("t")).alias("title"), part(F.col("r")).alias("reference"), part(F.col("d")).alias("document")), dataset, split)


def sentence_arrays(spark: SparkSession, path: str, dataset: str = "wikilingua", split: str = "test") -> DataFrame:
    """Lines with arrays `src` and `tgt` of sentences: stripped, without empty ones, joined by spaces."""
    rows = _objects(spark, path, "id string, src array<string>, tgt array<string>")
    joined = lambda c: F.array_join(F.filter(F.transform(c, X.strip), lambda s: s != ""), " ")
    made = rows.select(F.coalesce("id", (F.col("line") - 1).cast("string")).alias("source_id"), joined("src").alias("d"), joined("tgt").alias("r"))
    return _record(made.select("source_id", X.nfc(F.col("d")).alias("document"), X.nfc(F.col("r")).alias("reference")), dataset, split, "summarization")


def article(value: Column) -> Column:
    """(title, content) of an article with `Title:` .. `Content:` headers; without them the whole text is content."""
    title = X.strip(F.regexp_extract(value, r"(?s)Title:[ \t]*(.*?)(?:\n|$)", 1))
    content = X.strip(F.regexp_extract(value, r"(?s)Content:[ \t]*\n?(.*)$", 1))
    return F.struct(title.alias("title"), F.when(content != "", content).otherwise(X.strip(value)).alias("content"))


def clusters(spark: SparkSession, root: str, dataset: str = "vims", split: str = "test") -> DataFrame:
    """Folders `<cluster>/original/*.txt` and `<cluster>/summary/*.txt`: the articles in their order, and the first summary.

    A cluster is a few files; the articles of one are gathered, clusters are spread.
    """
    f = spark.read.text(root, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = f.select(F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("source_id"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("kind"), stem(F.col("path")).alias("name"), "value")
    number = F.coalesce(F.regexp_extract("name", r"(\d+)", 1).try_cast("int"), F.lit(-1))
    a = parts.where("kind = 'original'").withColumn("a", article(F.col("value")))
    texts = a.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct(number.alias("k"), "name", F.col("a.content").alias("c")))).alias("all"))
    gold = parts.where("kind <> 'original'").groupBy("source_id").agg(F.min_by(X.strip(F.col("value")), F.struct(number, "name")).alias("reference"), F.count("*").alias("num_gold"))
    rows = texts.join(gold, "source_id", "full_outer").select("source_id", F.array_join(F.transform("all", lambda x: x["c"]), "\n\n").alias("document"), F.size("all").alias("num_source_docs"), F.coalesce("reference", F.lit("")).alias("reference"))
    return _record(rows, dataset, split, "multi_document_summarization")


def nested(spark: SparkSession, path: str, dataset: str = "vlsp", split: str = "test") -> DataFrame:
    """Lines with an array of documents (title, raw_text): one text with numbered headings."""
    rows = _objects(spark, path, "id string, summary string, single_documents array<struct<title:string,raw_text:string>>")
    part = lambda d, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(d["title"], F.lit("")), F.lit("\n"), X.strip(F.coalesce(d["raw_text"], F.lit(""))))
    made = rows.select(F.coalesce("id", (F.col("line") - 1).cast("string")).alias("source_id"), F.array_join(F.transform("single_documents", part), "\n\n").alias("document"), X.strip(F.col("summary")).alias("reference"), F.size("single_documents").alias("num_source_docs"))
    return _record(made, dataset, split, "multi_document_summarization")


def split_pool(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good records with word counts, skip records: dataset, source_id, reason)."""
    good = records.where("reason IS NULL").drop("reason").withColumn("document_words", X.word_count(F.col("document"))).withColumn("reference_words", X.word_count(F.col("reference")))
    return good, records.where("reason IS NOT NULL").select("dataset", "source_id", "reason")


def pools(*records: DataFrame) -> DataFrame:
    """The union of all pools."""
    out, *rest = records
    for r in rest:
        out = out.unionByName(r, allowMissingColumns=True)
    return out
