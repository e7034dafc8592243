"""Ranks without putting a group into one task, duplicate handling by rank, and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut


def numbered(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank", total: str = "total") -> DataFrame:
    """`df` with its 1-based rank in the group `keys` by `order`, and the group's size.

    `order` must be total. Rows are range-partitioned by group and order and cut off from their lineage sorted, so a
    row's place in its partition is known without another shuffle; counts and first places per partition and group, a
    few rows a partition, give the offsets. A group of any size is spread over many tasks.
    """
    by = [*[F.col(k) for k in keys], *order]
    ordered = cut(df.repartitionByRange(*by).sortWithinPartitions(*by))
    place = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))
    local = ordered.select("*", F.spark_partition_id().alias("_part"), place.alias("_at"))
    counts = local.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    names = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    offsets = counts.select(F.col("_part").alias("_of"), *names, "_first", before.alias("_before"), F.sum("_n").over(w).alias(total))
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return local.join(offsets, same).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(rank), total)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each group the first row by `order`: a top-1 that is pruned in every partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, keys, [F.col(c).desc() for c in order])


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group with their rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def unique_only(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once: the keys that do are counted first and joined back."""
    once = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    return df.join(once, keys, "left_semi")


def top_or_other(df: DataFrame, keys: list[str], value: str, k: int, other: str = "other") -> DataFrame:
    """keys, value, n: counts of the k most frequent values per group (ties by value), the rest folded into one."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc_nulls_last(value))
    named = counts.withColumn(value, F.when(F.row_number().over(w) <= k, F.coalesce(F.col(value).cast("string"), F.lit("(null)"))).otherwise(F.lit(other)))
    return named.groupBy(*keys, value).agg(F.sum("n").alias("n"))


def natural_key(x: Column) -> list[Column]:
    """Sort keys of file names: the first number in it, then the name."""
    digits = F.regexp_extract(x, r"(\d+)", 1)
    return [F.coalesce(digits.try_cast("long"), F.lit(-1)), x]


def keep_last_counted(df: DataFrame, keys: list[str], order: list[str], repeats: str = "repeats") -> DataFrame:
    """Of each group the last row by `order`, with how many rows before it were dropped; one pre-aggregated maximum."""
    others = [c for c in df.columns if c not in keys and c not in order]
    g = df.groupBy(*keys).agg(F.max(F.struct(*order, *others)).alias("_r"), (F.count("*") - 1).alias(repeats))
    return g.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in (*order, *others)], repeats)
