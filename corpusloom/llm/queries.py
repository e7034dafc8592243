"""The pN_ queries: each operator over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import lookalike, mojibake, overlap, packing, pairs, pii, quantiles, raking, tokens
from corpusloom.session import table

#: The settings table of context windows is fixed; a longer one is refused.
MOST_WINDOWS = 100


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    found = overlap.record_pairs(*overlap.overlaps(table(spark, base, "summary_records")))
    return found.select(F.least("train_row", "eval_row").alias("row_id_a"), F.greatest("train_row", "eval_row").alias("row_id_b"))


def p1_classes(spark: SparkSession, base: str) -> DataFrame:
    """The overlaps without a pair of rows each: class pairs with their overlaps and how many rows each class has on its side."""
    members, pairs_ = overlap.overlaps(table(spark, base, "summary_records"))
    training = F.col("split") == overlap.TRAINING
    rows = members.groupBy("text_id").agg(F.count_if(training).alias("train"), F.count_if(~training).alias("other"))
    left = rows.select(F.col("text_id").alias("a"), F.col("train").alias("train_rows"))
    right = rows.select(F.col("text_id").alias("b"), F.col("other").alias("eval_rows"))
    return pairs_.join(left, "a").join(right, "b").select("a", "b", "overlap_a", "overlap_b", "train_rows", "eval_rows")


def p1_members(spark: SparkSession, base: str) -> DataFrame:
    """The class of every row that has one: row_id, split, source, text_id."""
    return overlap.overlaps(table(spark, base, "summary_records"))[0]


def p1_report(spark: SparkSession, base: str) -> DataFrame:
    return overlap.report(*overlap.overlaps(table(spark, base, "summary_records")))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.restore(table(spark, base, "summary_records")).select("row_id", "field")


def p2_restored(spark: SparkSession, base: str) -> DataFrame:
    return mojibake.restore(table(spark, base, "summary_records"))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    records = table(spark, base, "summary_records")
    changed = lookalike.canonical(records).select("row_id", "field")
    return changed.join(mojibake.restore(records).select("row_id", "field"), ["row_id", "field"], "left_anti")


def p3_canonical(spark: SparkSession, base: str) -> DataFrame:
    return lookalike.canonical(table(spark, base, "summary_records"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return pairs.defects(table(spark, base, "teacher_records"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return raking.unmet(table(spark, base, "corpus_records"), table(spark, base, "sampling_targets"), table(spark, base, "manifest_config"))


def p5_sample(spark: SparkSession, base: str) -> DataFrame:
    return raking.sample(table(spark, base, "corpus_records"), table(spark, base, "sampling_targets"), table(spark, base, "manifest_config"))[0]


def p5_report(spark: SparkSession, base: str) -> DataFrame:
    return raking.sample(table(spark, base, "corpus_records"), table(spark, base, "sampling_targets"), table(spark, base, "manifest_config"))[1]


def p6_percentiles(spark: SparkSession, base: str) -> DataFrame:
    days = quantiles.by_day(table(spark, base, "corpus_records"))
    return quantiles.answers(quantiles.by_dataset(days), ["dataset"])


def p6_day_percentiles(spark: SparkSession, base: str) -> DataFrame:
    return quantiles.answers(quantiles.by_day(table(spark, base, "corpus_records")), ["dataset", "batch_day"])


def p7_ids(spark: SparkSession, base: str) -> DataFrame:
    return tokens.encode(table(spark, base, "documents"))


def _containers(spark: SparkSession, base: str) -> DataFrame:
    windows = table(spark, base, "context_windows").select("window_id", "capacity_tokens").limit(MOST_WINDOWS + 1).collect()
    if len(windows) > MOST_WINDOWS:
        raise ValueError(f"more than {MOST_WINDOWS} context windows")
    documents = table(spark, base, "documents")
    lengths = tokens.encode(documents, ids=False)
    return packing.fill(lengths, [(w.window_id, w.capacity_tokens) for w in windows], rows=documents.count())


def p8_containers(spark: SparkSession, base: str) -> DataFrame:
    return _containers(spark, base)


def p8_report(spark: SparkSession, base: str) -> DataFrame:
    return packing.report(_containers(spark, base))


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return pii.items(table(spark, base, "documents")).select("doc_id", "pii_type", "nth")


def p9_redacted(spark: SparkSession, base: str) -> DataFrame:
    return pii.redacted(table(spark, base, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p1_members": p1_members,
    "p1_report": p1_report,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p3_canonical": p3_canonical,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_sample": p5_sample,
    "p5_report": p5_report,
    "p6_percentiles": p6_percentiles,
    "p6_day_percentiles": p6_day_percentiles,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}

ORACLE: dict[str, str] = {
    "p5_found": """
WITH ids AS (SELECT DISTINCT id, dataset, document_words FROM corpus_records WHERE document_words >= 0)
SELECT t.config_id, t.dataset, t.length_bin
FROM sampling_targets t JOIN manifest_config c USING (config_id)
LEFT JOIN ids i ON i.dataset = t.dataset AND i.document_words >= t.low_words AND i.document_words < t.high_words
GROUP BY t.config_id, t.dataset, t.length_bin, t.target_share, c.config
HAVING count(DISTINCT i.id) < greatest(c.config.min_per_bin, CAST(round_even(t.target_share * c.config.samples_per_dataset, 0) AS BIGINT))
""",
}
