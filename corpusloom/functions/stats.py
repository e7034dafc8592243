"""Statistics with the three percentile conventions kept apart, and guarded arithmetic. All are Column functions.

linear: interpolated between neighbours; nearest rank: the element at ceil(p n); upper median: the element at n // 2
of the sorted values. Nulls and NaN never count; an empty group gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def number(x: Column) -> Column:
    """x as a double; NaN is null."""
    d = x.cast("double")
    return F.when(~F.isnan(d), d)


def finite_positive(x: Column) -> Column:
    """x where it is a finite number above 0, else null; a truth value is no number."""
    d = F.when(F.typeof(x) != "boolean", x).try_cast("double")
    return F.when((d > 0) & (d < float("inf")) & ~F.isnan(d), d)


def counter(x: Column) -> Column:
    """x as a long where it is a whole finite number of at least 0, else null; a truth value is no number."""
    d = F.when(F.typeof(x) != "boolean", x).try_cast("double")
    return F.when((d >= 0) & (d < 9.2e18) & (d == F.floor(d)), d.cast("long"))


def percentiles(df: DataFrame, keys: list[str], value: str, linear: dict[str, float], nearest: dict[str, float] | None = None) -> DataFrame:
    """keys, the named percentiles of a column (linear, or nearest-rank), and mean, min, max, count of it.

    Exact, from the counts of distinct values: these are pre-aggregated, and a group's ranks are running sums over its
    distinct values, which spill; no state holds a group. Nulls and NaN do not count; a group without numbers is not there.
    """
    # nulls are counted as nothing afterwards: a filter before would evaluate the column twice
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    counts = df.groupBy(*keys, x.alias("_v")).agg(F.count("*").alias("_n")).withColumn("_n", F.when(F.col("_v").isNull(), 0).otherwise(F.col("_n")))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("_upto", F.sum("_n").over(w.orderBy("_v"))).withColumn("_total", F.sum("_n").over(w))
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    made, parts = [], []
    for name, p in linear.items():
        place = (F.col("_total") - 1) * F.lit(p)
        parts += [at(F.floor(place) + 1).alias(f"_lo_{name}"), at(F.ceil(place) + 1).alias(f"_hi_{name}")]
        h = (F.col("count") - 1) * F.lit(p)
        made.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (h - F.floor(h))).alias(name))
    for name, p in (nearest or {}).items():
        parts.append(at(F.greatest(F.ceil(F.col("_total") * F.lit(p) - 1e-9), F.lit(1))).alias(name))
        made.append(F.col(name))
    n, v = F.col("_n"), F.col("_v")
    mean = F.try_divide(F.sum(v * n), F.sum("_n"))
    g = ranked.groupBy(*keys).agg(F.sum("_n").alias("count"), F.min("_v").alias("min"), F.max("_v").alias("max"), mean.alias("mean"), *parts)
    return g.where(F.col("count") > 0).select(*keys, "count", "min", "max", "mean", *made)


def summary(df: DataFrame, keys: list[str], names: list[str], digits: int = 4) -> DataFrame:
    """keys and mean, median, nearest-rank p90 and population deviation of each column, rounded; names carry the column's.

    A column without numbers in a group has nulls.
    """
    out = df.groupBy(*keys).agg(*[F.round(F.stddev_pop(number(F.col(name))), digits).alias(f"{name}_std") for name in names])
    for name in names:
        p = percentiles(df, keys, name, {"median": 0.5}, {"p90": 0.9})
        p = p.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.round(c, digits).alias(f"{name}_{c}") for c in ("mean", "median", "p90")])
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        out = out.join(p, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return out


def profile(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys, count, min, linear percentiles, mean, max of a column."""
    p = percentiles(df, keys, name, PROFILE)
    return p.select(*keys, "count", "min", *[F.round(k, 4).alias(k) for k in PROFILE], F.round("mean", 4).alias("mean"), "max")


def quartiles(df: DataFrame, keys: list[str], name: str, digits: int = 2) -> DataFrame:
    """keys, min, p10, p25, median, mean, p75, p90, max, rounded: the profile of teacher reports."""
    marks = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    p = percentiles(df, keys, name, marks)
    return p.select(*keys, *[F.round(c, digits).alias(c) for c in ("min", *marks, "mean", "max")])


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, count, min, upper_median, mean, max: the element at n // 2, found from the counts of distinct values.

    The values are pre-aggregated, so that no task holds a whole group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("upto", F.sum("n").over(w.orderBy(value))).withColumn("total", F.sum("n").over(w))
    hit = F.col("upto") > F.floor(F.col("total") / 2)
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("count"),
        F.min(value).alias("min"),
        F.min(F.when(hit, F.col(value))).alias("upper_median"),
        F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 4).alias("mean"),
        F.max(value).alias("max"),
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_of_sums(a: Column, b: Column) -> Column:
    return ratio(F.sum(a), F.sum(b))


def f1(p: Column, r: Column) -> Column:
    """Harmonic mean, 0 where both are 0."""
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def geomean(x: Column) -> Column:
    return F.exp(F.avg(F.ln(x)))


def mean_itl(first_ms: Column, last_ms: Column, tokens: Column) -> Column:
    """Mean time between tokens; null with one token or none."""
    return F.when(tokens > 1, (last_ms - first_ms) / (tokens - 1))


def throughput(tokens: Column, ms: Column) -> Column:
    """Tokens a second, rounded to 4; null without a positive time."""
    return F.when(ms > 0, F.round(tokens / ms * 1000.0, 4))


def schedule_factor(step: Column, total: int, warmup: int) -> Column:
    """Linear warm-up to 1, then a half cosine down to 0 at `total`."""
    after = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / max(1, total - warmup)))
    return F.when(step < warmup, (step + 1) / max(1, warmup)).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * after)))


def complete_steps(samples: Column, batch: int, epochs: int) -> Column:
    """Whole steps of `batch` samples in all epochs; at least one where there is any sample."""
    return F.when(samples > 0, F.greatest(F.lit(1), F.floor(samples / batch)) * epochs).otherwise(0)


def larger_counts(a: Column, b: Column) -> Column:
    """Two maps of counters merged by the larger value per key."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def mean_rate(ms: Column, tokens: Column) -> Column:
    """Tokens a second as the inverse of the mean time per token; rows without positive numbers do not count."""
    per = F.avg(F.when((ms > 0) & (tokens > 0), ms / tokens))
    return F.try_divide(F.lit(1000.0), per)
