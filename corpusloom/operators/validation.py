"""Row and table checks: every check names its problem, the first or all of them, and no row is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def problems(*checks: tuple[str, Column]) -> Column:
    """The names of the failing checks in their order; a null check does not fail."""
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in checks]))


def first_problem(*checks: tuple[str, Column]) -> Column:
    """The name of the first failing check, null if none fails."""
    chain = F.when(F.lit(False), "")
    for name, bad in checks:
        chain = chain.when(F.coalesce(bad, F.lit(False)), name)
    return chain


def blank(x: Column) -> Column:
    return x.isNull() | (X.strip(x) == "")


def task_reason(document_words: Column, reference_words: Column, least: int = 100) -> Column:
    """too_short below `least` words (0: no bound), reference_not_shorter otherwise if it isn't; null for a valid row."""
    return F.when((F.lit(least) > 0) & (document_words < least), "document_too_short").when(reference_words >= document_words, "reference_not_shorter")


def record_problems(required: list[str], extra: list[tuple[str, Column]]) -> Column:
    """missing:<field> for each absent field; only if none is absent the further checks."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(f"missing:{c}")) for c in required]))
    return F.when(F.size(missing) > 0, missing).otherwise(problems(*extra))


def occurrences(df: DataFrame, keys: list[str], name: str = "occurrences") -> DataFrame:
    """`df` with how often its key occurs: counts are pre-aggregated and joined back, no group is gathered."""
    return df.join(df.groupBy(*keys).agg(F.count("*").alias(name)), keys)


def missing_keys(json: Column, keys: list[str]) -> Column:
    """Keys that a JSON object text lacks; a null value is not lacking."""
    return F.array_except(F.array(*[F.lit(k) for k in keys]), F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")))


def keeps(text: Column, keywords: Column) -> Column:
    """Whether a text holds every keyword."""
    return F.forall(keywords, lambda k: F.contains(text, k))


def same_size(df: DataFrame, keys: list[str]) -> DataFrame:
    """groups, least, most, equal: whether all groups have the same number of rows."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.max("n").alias("most"), (F.min("n") == F.max("n")).alias("equal"))


def anomalies(summary: Column, document: Column, reference: Column, least_words: int = 5, most_ratio: float = 1.0, most_3: float = 0.35, most_4: float = 0.25, mojibake: bool = True, zero_overlap: bool = True) -> Column:
    """Reasons why a teacher's summary is anomalous; the 4-gram loop only where the 3-gram one does not hold.

    Words are lower-cased and split at white space; a null text is an empty one.
    """
    s, d, r = (X.split(F.lower(F.coalesce(c, F.lit("")))) for c in (summary, document, reference))
    n, m = F.size(s), F.size(d)
    grams = X.ngram_profile(s)
    loop3 = (n >= 10) & (grams["repetition_3"] > most_3)
    loop4 = (n >= 10) & ~loop3 & (grams["repetition_4"] > most_4)
    return problems(
        ("empty_summary", blank(summary)),
        ("empty_document", blank(document)),
        ("too_short", (n > 0) & (n < least_words)),
        ("too_long", (m > 0) & (n > most_ratio * m)),
        ("repetition_loop_3gram", loop3),
        ("repetition_loop_4gram", loop4),
        ("mojibake_detected", F.lit(mojibake) & (X.mojibake_by_parts(F.coalesce(summary, F.lit(""))) | X.mojibake_by_parts(F.coalesce(document, F.lit(""))))),
        ("zero_rouge1_with_reference", F.lit(zero_overlap) & (n > 0) & (F.size(r) > 0) & (F.size(F.array_intersect(s, r)) == 0)),
    )
