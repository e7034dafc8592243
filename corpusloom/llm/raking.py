"""Sampling to target proportions (problem 5).

Per run and dataset, the cells length bin x category of the corpus are raked by iterative proportional fitting: the
bin margin to the target shares, the category margin to the corpus' own shares. The factors of the bins are few and lie
at the driver; those of the categories follow from them and stay with the categories, of which there may be any number:
each round sums their cells, on the driver while they are few, else on the workers. Records are drawn by weighted
exponential keys -ln(u)/w, smallest first, within each bin's quota; within a bin the weight is the category's factor.
Quotas are the targets by largest remainder, raised to the minimum of small bins and lowered to what the corpus has;
what cannot be met is reported.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

MOST_TARGETS = 20_000
#: Rows of run, dataset and category up to which the rounds are summed at the driver; beyond, on the workers.
LOCAL_ROWS = 50_000
#: Weights are counted for the keys' thresholds in this many steps a doubling.
STEPS = 8
Key = tuple[int, str]


def counted(corpus: DataFrame) -> DataFrame:
    """Each `id` once, as first delivered, with a measured length (null and negative ones are in no bin)."""
    first = F.min(F.struct("ingested_at", "dataset", "document_words", "category")).alias("r")
    return corpus.where(F.col("document_words") >= 0).groupBy("id").agg(first).select("id", "r.dataset", "r.document_words", "r.category")


def plan(targets: DataFrame, configs: DataFrame) -> pd.DataFrame:
    """The target bins with their run's settings, at the driver: a fixed table of settings, refused above a bound."""
    joined = targets.join(configs.select("config_id", "config.min_per_bin", "config.samples_per_dataset", "config.seed"), "config_id")
    rows = joined.limit(MOST_TARGETS + 1).toPandas()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target bins")
    rows["needed"] = [int(needs([s], n, m)[0]) for m, s, n in zip(rows.min_per_bin, rows.target_share, rows.samples_per_dataset, strict=True)]
    rows = rows.sort_values(["config_id", "dataset", "length_bin"], ignore_index=True)
    return rows.assign(at=rows.groupby(["config_id", "dataset"]).cumcount())


def histogram(records: DataFrame) -> DataFrame:
    """Number of records per dataset, length and category."""
    return records.groupBy("dataset", "document_words", "category").agg(F.count("*").alias("n"))


def vectors(counts: DataFrame, bins: pd.DataFrame) -> DataFrame:
    """(config_id, dataset, category, n): how many records each category has in the run's bins, in the bins' order.

    A null category is a category. The vectors are as long as a run has bins.
    """
    spark = counts.sparkSession
    small = spark.createDataFrame(bins[["config_id", "dataset", "at", "low_words", "high_words"]], "config_id int, dataset string, at int, low_words int, high_words int")
    inside = (F.col("document_words") >= F.col("low_words")) & (F.col("document_words") < F.col("high_words"))
    joined = counts.join(F.broadcast(small), "dataset").where(inside)
    cells = joined.groupBy("config_id", "dataset", "category", "at").agg(F.sum("n").cast("long").alias("n"))
    packed = cells.groupBy("config_id", "dataset", "category").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"))
    width = spark.createDataFrame(bins.groupby(["config_id", "dataset"], as_index=False)["at"].max(), "config_id int, dataset string, last int")
    filled = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return packed.join(F.broadcast(width), ["config_id", "dataset"]).select("config_id", "dataset", "category", filled.alias("n"))


def factors(n: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The factor of each category (row of `n`) that fits its margin, its own share, given those of the bins."""
    return _ratio(n.sum(axis=1), n @ r)


def _sums(frame: pd.DataFrame, r: dict[Key, np.ndarray] | None) -> dict[Key, np.ndarray]:
    """The bins' sums over the categories of a frame of `vectors`, scaled by their factors (unscaled without `r`)."""
    out = {}
    for key, g in frame.groupby(["config_id", "dataset"], sort=False):
        n = np.stack(g["n"].to_list()).astype(float)
        out[key] = n.sum(axis=0) if r is None else (n * factors(n, r[key])[:, None]).sum(axis=0)
    return out


class Rounds:
    """The sums of a table of vectors, by whichever way its size asks for."""

    def __init__(self, table: DataFrame, local_rows: int = LOCAL_ROWS):
        self.table = table
        few = table.limit(local_rows + 1).toPandas()
        self.held = few if len(few) <= local_rows else None

    def __call__(self, r: dict[Key, np.ndarray] | None) -> dict[Key, np.ndarray]:
        if self.held is not None:
            return _sums(self.held, r)

        def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for (config, dataset), sums in _sums(f, r).items():
                    yield pd.DataFrame({"config_id": config, "dataset": dataset, "at": np.arange(len(sums)), "x": sums})

        rows = self.table.mapInPandas(of, "config_id int, dataset string, at int, x double").groupBy("config_id", "dataset", "at").agg(F.sum("x").alias("x")).toPandas()
        return {k: g.sort_values("at").x.to_numpy() for k, g in rows.groupby(["config_id", "dataset"])}


def fit(sums: Rounds, shares: dict[Key, np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> tuple[dict[Key, np.ndarray], dict[Key, np.ndarray]]:
    """(population of the bins, factors of the bins) after iterative proportional fitting of both margins.

    Empty cells stay empty, margins of empty bins are given up.
    """
    population = sums(None)
    wanted = {}
    for key, n in population.items():
        w = np.where(n > 0, shares[key], 0)
        wanted[key] = w / max(w.sum(), 1e-300)
    r = {k: _ratio(wanted[k] * n.sum(), n) for k, n in population.items()}
    for _ in range(rounds if r else 0):
        made = sums(r)
        off = max(np.abs(r[k] * made[k] - wanted[k] * population[k].sum()).max() / max(population[k].sum(), 1) for k in r)
        if off < tolerance:
            break
        r = {k: _ratio(wanted[k] * population[k].sum(), made[k]) for k in r}
    return population, r


def rake(population: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The fitted table of bins x categories, as shares: the row margin to `rows`, the column margin to its own."""
    frame = pd.DataFrame({"config_id": 0, "dataset": "", "n": list(population.T)})
    _, r = fit(lambda r: _sums(frame, r), {(0, ""): rows})
    n = population.T.astype(float)
    return (n * r[0, ""] * factors(n, r[0, ""])[:, None]).T / max(population.sum(), 1)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a, dtype=float), where=b > 0)


def quotas(share: np.ndarray, population: np.ndarray, samples: int, least: int) -> np.ndarray:
    """Whole numbers per bin: largest remainder of the targets, at least `least`, at most the population.

    A bin that the corpus cannot fill gives all it has. What small bins get above their target, and what bins lack,
    comes from or goes to the other bins by their shares.
    """
    want = share / max(share.sum(), 1e-300) * samples
    short = population < needs(share, samples, least)
    floor = np.where(short, population, np.minimum(least, population))
    quota = np.clip(want, floor, population)
    for _ in range(100):
        gap = samples - quota.sum()
        free = (quota < population) if gap > 0 else (quota > floor)
        if abs(gap) < 1e-9 or not (free & (want > 0)).any():
            break
        quota = np.clip(quota + gap * np.where(free, want, 0) / np.where(free, want, 0).sum(), floor, population)
    whole = np.floor(quota + 1e-9).astype(np.int64)
    order = np.lexsort((np.arange(len(quota)), -(quota - whole)))
    missing = int(round(quota.sum())) - int(whole.sum())
    for i in order[: max(missing, 0)]:
        whole[i] += whole[i] < population[i]
    return whole


def needs(share: np.ndarray, samples: int, least: int) -> np.ndarray:
    """What each bin is to have: its part of the samples, rounded, or the minimum."""
    return np.array([max(int(least), round(float(s) * int(samples))) for s in share])


def design(bins: pd.DataFrame, table: DataFrame, local_rows: int = LOCAL_ROWS) -> tuple[pd.DataFrame, dict[Key, np.ndarray]]:
    """Population, quota and key threshold per bin, and the bins' factors per run and dataset."""
    groups = {k: g.sort_values("at") for k, g in bins.groupby(["config_id", "dataset"], sort=True)}
    population, r = fit(Rounds(table, local_rows), {k: g.target_share.to_numpy(float) for k, g in groups.items()})

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (config, dataset), g in f.groupby(["config_id", "dataset"], sort=False):
                n = np.stack(g["n"].to_list())
                w = factors(n.astype(float), r[config, dataset])
                step = np.floor(np.log2(np.where(w > 0, w, 1)) * STEPS).astype(int)
                category, at = np.nonzero(n * (w > 0)[:, None])
                yield pd.DataFrame({"config_id": config, "dataset": dataset, "at": at, "step": step[category], "n": n[category, at]})

    weighed = table.mapInPandas(spread, "config_id int, dataset string, at int, step int, n long").groupBy("config_id", "dataset", "at", "step").agg(F.sum("n").alias("n")).toPandas()
    by = {k: g for k, g in weighed.groupby(["config_id", "dataset", "at"])}
    out = []
    for key, g in groups.items():
        n = population.get(key, np.zeros(len(g))).astype(np.int64)
        quota = quotas(g.target_share.to_numpy(float), n, int(g.samples_per_dataset.iloc[0]), int(g.min_per_bin.iloc[0]))
        limit = []
        for i, q in enumerate(quota.tolist()):
            w = by.get((*key, i))
            limit.append(math.inf if w is None or q >= n[i] else threshold(w.n.to_numpy(float), 2.0 ** (w.step.to_numpy(float) / STEPS), q))
        out.append(g.assign(population=n, quota=quota, threshold=limit))
    return pd.concat(out, ignore_index=True) if out else bins.assign(population=0, quota=0, threshold=math.inf), r


def threshold(n: np.ndarray, w: np.ndarray, quota: int, slack: float = 8.0) -> float:
    """A key below which at least `quota` records lie, as good as surely; infinite where all may be needed.

    `w` may be lower bounds of the weights.
    """
    need = quota + slack * math.sqrt(quota) + 64
    if n.sum() <= need:
        return math.inf
    expected = lambda t: float((n * -np.expm1(-w * t)).sum())
    low, high = 0.0, 1 / w.max()
    while expected(high) < need and high < 1e300:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if expected(middle) < need else (low, middle)
    return high if expected(high) >= need else math.inf


def scaled(records: DataFrame, table: DataFrame, r: dict[Key, np.ndarray]) -> DataFrame:
    """`records` with f, a map of each run's factor of their category; those in no run's bins are left out.

    One row per dataset and category is joined; adaptive execution broadcasts it while it is small, and splits the
    categories that very many records have.
    """

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (config, dataset), g in f.groupby(["config_id", "dataset"], sort=False):
                w = factors(np.stack(g["n"].to_list()).astype(float), r[config, dataset])
                yield pd.DataFrame({"config_id": config, "dataset": dataset, "category": g["category"], "f": w})

    each = table.mapInPandas(of, "config_id int, dataset string, category string, f double")
    maps = each.groupBy(F.col("dataset").alias("_d"), F.col("category").alias("_c")).agg(F.map_from_entries(F.collect_list(F.struct("config_id", "f"))).alias("f"))
    same = (F.col("dataset") == F.col("_d")) & F.col("category").eqNullSafe(F.col("_c"))
    return records.join(maps, same).drop("_d", "_c")


def keyed(records: DataFrame, bins: pd.DataFrame) -> DataFrame:
    """Per record, run and bin its exponential key, kept only up to the bin's threshold; made without a shuffle."""
    groups: dict[str, list[tuple]] = {}
    for (config, dataset), b in bins.groupby(["config_id", "dataset"]):
        groups.setdefault(dataset, []).append((int(config), int(b.seed.iloc[0]), b.length_bin.to_numpy(), b.low_words.to_numpy(), b.high_words.to_numpy(), b.threshold.to_numpy()))
    shared = records.sparkSession.sparkContext.broadcast(groups)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for dataset, g in f.groupby("dataset", sort=False):
                words = g.document_words.to_numpy(np.int64)
                code, kinds = pd.factorize(g.category, use_na_sentinel=False)
                first = g.iloc[pd.Series(code).drop_duplicates().index]
                base = g.h.to_numpy(np.int64).view(np.uint64)
                for config, seed, number, low, high, limit in shared.value.get(dataset, ()):
                    factor = np.array([dict(m).get(config, 0.0) for m in first.f])[code] if len(kinds) else np.zeros(0)
                    u = (_mix(base ^ np.uint64((seed * 0x9E3779B97F4A7C15 + config) % 2**64)) >> np.uint64(11)).astype(float) / 2.0**53
                    with np.errstate(divide="ignore"):
                        keys = -np.log(np.maximum(u, 2.0**-54)) / factor
                    for b, lo, hi, most in zip(number, low, high, limit, strict=True):
                        at = np.flatnonzero((words >= lo) & (words < hi) & (keys <= most))
                        if len(at):
                            yield pd.DataFrame({"config_id": np.int32(config), "dataset": dataset, "length_bin": np.int32(b), "key": np.minimum(keys[at], 1e300), "id": g.id.to_numpy()[at], "document_words": words[at], "category": g.category.to_numpy()[at]})

    schema = "config_id int, dataset string, length_bin int, key double, id string, document_words int, category string"
    return records.select("id", "dataset", "document_words", "category", "f", F.xxhash64("id").alias("h")).mapInPandas(of, schema)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sample(corpus: DataFrame, targets: DataFrame, configs: DataFrame, local_rows: int = LOCAL_ROWS) -> tuple[DataFrame, DataFrame]:
    """The sampled records, and a report with one row per target bin.

    Sample: config_id, dataset, length_bin, id, document_words, category, nth (1.. in its bin, by key). Report:
    config_id, dataset, length_bin, population, needed, quota, sampled, gap (what is lacking of `needed` where all
    records of the bin were taken).
    Ids delivered twice count once; null or negative lengths are in no bin; a bin or dataset without records has
    sampled 0 and its whole need as gap; a null category is a category; runs without settings are left out. The keys
    depend only on the run's seed and the id, so repeated runs and any partitioning give the same sample.
    """
    spark = corpus.sparkSession
    bins = plan(targets, configs)
    records = cut(counted(corpus))
    table = cut(vectors(histogram(records), bins))
    bins, r = design(bins, table, local_rows)
    records = scaled(records, table, r)
    wide = int(bins.quota.max()) if len(bins) else 0
    order = Window.partitionBy("config_id", "dataset", "length_bin").orderBy("key", "id")
    quota = spark.createDataFrame(bins[["config_id", "dataset", "length_bin", "quota"]].astype({"config_id": "int32", "length_bin": "int32"}), "config_id int, dataset string, length_bin int, quota long")
    while True:
        ranked = keyed(records, bins).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= wide)
        taken = cut(ranked.join(F.broadcast(quota), ["config_id", "dataset", "length_bin"]).where("nth <= quota").drop("quota", "key"))
        got = taken.groupBy("config_id", "dataset", "length_bin").count().toPandas()
        rows = bins.merge(got, "left", ["config_id", "dataset", "length_bin"]).fillna({"count": 0})
        short = (rows["count"] < rows["quota"]).to_numpy()
        if not (short & np.isfinite(bins.threshold.to_numpy())).any():
            break
        bins.loc[short, "threshold"] = math.inf  # the threshold was too low there: look at all
    rows["sampled"] = rows["count"].astype("int64")
    rows["gap"] = (rows.needed - rows.sampled).where(rows.sampled == rows.population, 0).clip(lower=0)
    table = rows[["config_id", "dataset", "length_bin", "population", "needed", "quota", "sampled", "gap"]]
    schema = "config_id int, dataset string, length_bin int, population long, needed long, quota long, sampled long, gap long"
    return taken, spark.createDataFrame(table, schema)


def unmet(corpus: DataFrame, targets: DataFrame, configs: DataFrame) -> DataFrame:
    """config_id, dataset, length_bin of the bins of which the sampler took all records and still lacks some."""
    return sample(corpus, targets, configs)[1].where("gap > 0").select("config_id", "dataset", "length_bin")
