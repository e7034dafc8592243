"""Percentiles of large numeric columns from mergeable rank-interval summaries (problem 6).

A summary is a list of tuples (value, rmin, rmax): the value is one of the data, and its rank lies in [rmin, rmax].
Merging adds the ranks that the other summary allows, and keeps the largest gap (rmax of a tuple - rmin of the one
before) within the same share of the ranks. Compressing deletes a tuple only while the gap that this leaves is at most
2 x epsilon x n, so an answer is off by at most epsilon x n ranks. The permitted epsilon grows from level to level
(partition, day, month, dataset) up to what was asked for, which leaves each level the room to delete. A tuple between
two of its own value goes too: whatever lies there is that value. The bound that is reached is measured as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Permitted rank error of the last level, as a share of all ranks: a summary has about levels / (2 x EPSILON) tuples.
EPSILON = 0.0005
RUN = 1_000_000
FAN_IN = 64
#: Fixed: the percentiles of the distribution report.
PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
Summary = tuple[np.ndarray, np.ndarray, np.ndarray]
TUPLES = "value double, rmin long, rmax long, total double, run long"


def summarise(values: np.ndarray, epsilon: float) -> Summary:
    """The summary of unsorted values, with at most epsilon x n ranks of uncertainty."""
    v = np.sort(values)
    rank = np.arange(1, len(v) + 1)
    return compress((v, rank, rank), epsilon)


def compress(s: Summary, epsilon: float) -> Summary:
    """As few tuples as the permitted gap of 2 x epsilon x n allows, the first and the last among them."""
    v, lo, hi = s
    if len(v) < 3:
        return s
    ends = np.flatnonzero(np.append(v[1:] != v[:-1], True))  # last tuple of each run of equal values
    permitted = 2 * epsilon * hi[-1]
    if permitted < 2:  # no tuple between two others can go
        inside = np.concatenate([[False], (v[1:-1] == v[:-2]) & (v[1:-1] == v[2:]), [False]])
        return v[~inside], lo[~inside], hi[~inside]
    last = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
    reach = np.searchsorted(hi, lo + permitted, side="right") - 1
    to = np.maximum(np.maximum(reach, last), np.arange(1, len(v) + 1)).tolist()
    kept, i = [], 0
    while i < len(v) - 1:
        kept.append(i)
        i = to[i]
    kept = np.array([*kept, len(v) - 1])
    return v[kept], lo[kept], hi[kept]


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of both sets of data; of equal values those of `a` come first."""
    (va, la, ha), (vb, lb, hb) = a, b
    if not len(va) or not len(vb):
        return b if not len(va) else a

    def shifted(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, other: Summary, side: str) -> tuple[np.ndarray, np.ndarray]:
        _, ol, oh = other
        at = np.searchsorted(other[0], v, side=side)
        return lo + np.where(at > 0, ol[np.maximum(at - 1, 0)], 0), hi + np.where(at < len(ol), oh[np.minimum(at, len(oh) - 1)] - 1, oh[-1])

    la, ha = shifted(va, la, ha, b, "left")
    lb, hb = shifted(vb, lb, hb, a, "right")
    v = np.concatenate([va, vb])
    order = np.argsort(v, kind="stable")
    return v[order], np.concatenate([la, lb])[order], np.concatenate([ha, hb])[order]


def error(s: Summary) -> float:
    """The most ranks by which an answer can be off: half the largest gap between tuples of different values."""
    v, lo, hi = s
    gap = np.where(v[1:] == v[:-1], 0, hi[1:] - lo[:-1])
    sure = (lo == hi)[1:] & (lo == hi)[:-1]
    return float(np.max(np.where(sure, gap // 2, gap / 2), initial=0))


def at_rank(s: Summary, rank: np.ndarray) -> np.ndarray:
    """For each rank the value whose rank interval is nearest to it."""
    v, lo, hi = s
    after = np.clip(np.searchsorted(lo, rank, side="right") - 1, 0, len(v) - 1)
    then = np.minimum(after + 1, len(v) - 1)
    off = lambda i: np.maximum(rank - lo[i], hi[i] - rank)
    return np.where(off(after) <= off(then), v[after], v[then])


def quantile(s: Summary, p: float) -> float:
    """The percentile with linear interpolation between the two neighbouring ranks."""
    h = (s[2][-1] - 1) * p + 1
    low, high = at_rank(s, np.array([np.floor(h), np.ceil(h)]))
    return float(low + (high - low) * (h - np.floor(h)))


def _frame(s: Summary, total: float, run: int, **keys: object) -> pd.DataFrame:
    v, lo, hi = s
    return pd.DataFrame({**keys, "value": v, "rmin": lo.astype(np.int64), "rmax": hi.astype(np.int64), "total": total, "run": np.int64(run)})


def partials(df: DataFrame, keys: list[str], value: str, epsilon: float, run: int = RUN) -> DataFrame:
    """Summaries per key of each partition (per `run` rows of it); nothing is shuffled."""
    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, nth = TaskContext.get().partitionId(), 0
        held: list[pd.DataFrame] = []

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal nth, held
            if held:
                for k, g in pd.concat(held).groupby(keys, dropna=False, sort=False):
                    x = g[value].to_numpy(np.float64)
                    yield _frame(summarise(x, epsilon), x.sum(), part * 100_000 + nth, **dict(zip(keys, k, strict=True)))
                nth, held = nth + 1, []

        for f in frames:
            held.append(f)
            if sum(map(len, held)) >= run:
                yield from flush()
        yield from flush()

    return df.select(*keys, value).mapInPandas(of, f"{types}, {TUPLES}")


def combine(summaries: DataFrame, keys: list[str], epsilon: float, bucket: int | None = None) -> DataFrame:
    """Merge the summaries of each key and compress to `epsilon`, which is to be more than theirs.

    With `bucket`, only those are merged whose run falls in the same of so many runs.
    """
    types = ", ".join(f"`{k}` {summaries.schema[k].dataType.simpleString()}" for k in keys)
    run = F.floor(F.col("run") / bucket) if bucket else F.lit(0)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [g for _, g in pdf.groupby("_source", sort=True)]
        queue = [tuple(g.sort_values(["rmin", "rmax"])[c].to_numpy() for c in ("value", "rmin", "rmax")) for g in parts]
        total = sum(float(g["total"].iloc[0]) for g in parts)
        while len(queue) > 1:  # pairwise, so that each tuple goes through few merges
            queue = [merge(*queue[i : i + 2]) if i + 1 < len(queue) else queue[i] for i in range(0, len(queue), 2)]
        return _frame(compress(queue[0], epsilon), total, int(pdf["_run"].iloc[0]), **{k: pdf[k].iloc[0] for k in keys})

    others = [c for c in summaries.columns if c not in {*keys, "value", "rmin", "rmax", "total", "run"}]
    source = F.concat_ws("|", "run", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in others])
    return (
        summaries.select(*keys, "value", "rmin", "rmax", "total", run.alias("_run"), source.alias("_source"))
        .groupBy(*keys, "_run")
        .applyInPandas(of, f"{types}, {TUPLES}")
    )


def answers(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: records, min, percentiles, mean, max and the bound of the rank error."""
    types = ", ".join(f"`{k}` {summaries.schema[k].dataType.simpleString()}" for k in keys)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        s = tuple(pdf.sort_values(["rmin", "rmax"])[c].to_numpy() for c in ("value", "rmin", "rmax"))
        n = int(s[2][-1])
        row = {k: pdf[k].iloc[0] for k in keys} | {"records": n, "min": s[0][0], "mean": pdf["total"].iloc[0] / n, "max": s[0][-1]}
        return pd.DataFrame([row | {k: quantile(s, p) for k, p in PERCENTILES.items()} | {"rank_error": error(s)}])

    measures = ", ".join(f"{k} double" for k in PERCENTILES)
    return summaries.groupBy(*keys).applyInPandas(of, f"{types}, records long, min double, mean double, max double, {measures}, rank_error double")


def counted(df: DataFrame, value: str = "document_words") -> DataFrame:
    """One row per `id`, the first delivered, with a measured length: null and negative ones do not count."""
    first = F.min(F.struct("ingested_at", "batch_day", "dataset", value)).alias("r")
    return df.where(F.col(value) >= 0).groupBy("id").agg(first).select("r.dataset", "r.batch_day", F.col(f"r.{value}").cast("double").alias(value))


def _levels(df: DataFrame) -> int:
    """How often the partitions' summaries are merged in groups of FAN_IN before those of a day are."""
    buckets, levels = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 0
    while FAN_IN ** (levels + 1) < buckets:
        levels += 1
    return levels


def by_day(df: DataFrame, value: str = "document_words", epsilon: float = EPSILON) -> DataFrame:
    """Summaries per dataset and batch_day, which can be kept and combined with those of other days or files.

    Their rank error is at most epsilon x (levels below / all levels) of their rows, so that months and datasets made
    of them stay within epsilon. A null dataset or batch_day is a group of its own; an empty table gives no rows;
    other columns are not read.
    """
    levels = _levels(df)
    step = epsilon / (levels + 4)
    days = partials(counted(df, value), ["dataset", "batch_day"], value, step)
    for nth in range(levels):
        days = combine(days, ["dataset", "batch_day"], (nth + 2) * step, FAN_IN * 100_000)
        days = days.withColumn("run", F.col("run") * 100_000)
    return combine(days, ["dataset", "batch_day"], (levels + 2) * step)


def by_dataset(days: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """Merge the days' summaries into months, and these into one summary per dataset, off by at most epsilon x n ranks."""
    step = epsilon / (_levels(days) + 4)
    months = combine(days.withColumn("month", F.date_format("batch_day", "yyyy-MM")), ["dataset", "month"], epsilon - step)
    return combine(months, ["dataset"], epsilon)
