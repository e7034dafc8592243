"""Deterministic binning, allocation, sampling, splitting and sharding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.stats import percentiles
from corpusloom.functions.text import hash_score
from corpusloom.operators.ranking import numbered, top
from corpusloom.session import cut

#: Fixed: half-open token-length bins, and right-closed length labels.
TOKEN_BINS = [("0-1k", 0, 1000), ("1k-2k", 1000, 2000), ("2k-4k", 2000, 4000), ("4k-6k", 4000, 6000), ("6k-12k", 6000, 12000)]
LENGTH_LABELS = [(512, "1-512"), (1024, "513-1024"), (2048, "1025-2048"), (4096, "2049-4096"), (8192, "4097-8192")]


def token_bin(x: Column) -> Column:
    """The half-open bin a length falls in, null outside all."""
    c = F.when(F.lit(False), "")
    for name, low, high in TOKEN_BINS:
        c = c.when((x >= low) & (x < high), name)
    return c


def length_label(x: Column) -> Column:
    """The right-closed label of a length; anything longer than the last bound is one label."""
    c = F.when(x.isNull(), "unknown")
    for high, name in LENGTH_LABELS:
        c = c.when(x <= high, name)
    return c.otherwise("8193+")


def clipped(df: DataFrame, keys: list[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows whose value lies between two linear percentiles of their group, bounds included. The bounds, one row a group, are joined."""
    bounds = percentiles(df, keys, value, {"_low": low, "_high": high}).select(*keys, "_low", "_high")
    return df.join(bounds, keys).where(F.col(value).between(F.col("_low"), F.col("_high"))).drop("_low", "_high")


def edges(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """keys, edges: the bins - 1 inner quantile edges of each group."""
    marks = {f"_e{i}": i / bins for i in range(1, bins)}
    if not marks:
        return df.select(*keys, F.array().cast("array<double>").alias("edges")).distinct()
    return percentiles(df, keys, value, marks).select(*keys, F.array(*marks).alias("edges"))


def quantile_bin(df: DataFrame, keys: list[str], value: str, bins: int, name: str = "bin") -> DataFrame:
    """Right-closed bins: how many leading edges are below the value."""
    joined = df.join(edges(df, keys, value, bins), keys)
    return joined.withColumn(name, F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")


def ntile(df: DataFrame, keys: list[str], order: list[Column], bins: int, name: str = "bin") -> DataFrame:
    """Equal consecutive groups by order, the first ones larger by one where they can't all be equal; from 1."""
    r = numbered(df, keys, order, "_rank", "_total")
    small = F.floor(F.col("_total") / bins)
    large = F.col("_total") % bins
    at = F.col("_rank") - 1
    within = F.when(at < large * (small + 1), F.floor(at / (small + 1))).otherwise(large + F.floor((at - large * (small + 1)) / F.greatest(small, F.lit(1))))
    return r.withColumn(name, (within + 1).cast("int")).drop("_rank", "_total")


def allocate(groups: DataFrame, keys: list[str], group: str, weight: str, total: int, floor: int = 0) -> DataFrame:
    """keys, group, weight, slots: `total` slots by largest remainder over a floor per group; ties to the lower group.

    `groups` has one row per group, as many as there are groups of each key.
    """
    w = Window.partitionBy(*keys)
    n, mass = F.count("*").over(w), F.sum(weight).over(w)
    least = F.least(F.lit(floor), F.floor(F.lit(total) / n))
    exact = (F.lit(total) - least * n) * F.col(weight) / mass
    sized = groups.withColumn("_exact", exact).withColumn("_base", F.floor("_exact")).withColumn("_least", least)
    left = F.lit(total) - F.sum(F.col("_least") + F.col("_base")).over(w)
    nth = F.row_number().over(w.orderBy((F.col("_exact") - F.col("_base")).desc(), group))
    slots = F.when(mass > 0, F.col("_least") + F.col("_base") + (nth <= left).cast("int")).otherwise(0)
    return sized.select(*keys, group, weight, slots.cast("long").alias("slots"))


def evenly_spaced(df: DataFrame, keys: list[str], order: list[Column], picks: Column | int, single: str = "upper") -> DataFrame:
    """`picks` rows of each group at even distances by order, ends included; one pick takes the middle row.

    Positions are round-half-even of i (n - 1) / (k - 1); with one pick n // 2 (`upper`) or (n - 1) // 2 (`lower`);
    with as many picks as rows or more all are taken.
    """
    r = numbered(df, keys, order, "_rank", "_total").withColumn("_k", F.lit(picks) if isinstance(picks, int) else picks)
    middle = F.floor(F.col("_total") / 2) if single == "upper" else F.floor((F.col("_total") - 1) / 2)
    at = F.col("_rank") - 1
    near = F.bround(at * (F.col("_k") - 1) / F.greatest(F.col("_total") - 1, F.lit(1)))
    # a position p is picked if some i rounds to it: only the two i next to p (k - 1) / (n - 1) can
    step = (F.col("_total") - 1) / F.greatest(F.col("_k") - 1, F.lit(1))
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        i = near + shift
        hit = hit | ((i >= 0) & (i <= F.col("_k") - 1) & (F.bround(i * step) == at))
    taken = F.when(F.col("_k") <= 0, False).when(F.col("_k") >= F.col("_total"), True).when(F.col("_k") == 1, at == middle).otherwise(hit)
    return r.where(taken).drop("_rank", "_total", "_k")


def stratified(df: DataFrame, keys: list[str], value: str, order: list[Column], samples: int, bins: int = 5, clip: tuple[float, float] = (0.01, 0.99), least: int = 10, name: str = "length_bin") -> DataFrame:
    """`samples` rows of each group whose lengths stand for it: clip, bin, allocate, pick.

    Rows outside the two linear percentiles of `clip` are left out; the rest is cut into quantile bins (as many as
    there are samples, if these are fewer); slots go to the bins, empty ones included, by largest remainder of their
    sizes over `least` each; a bin gives rows at even distances by `order` (length first, then what tells rows apart),
    all it has if its slots are more.
    """
    bins = max(1, min(bins, samples))
    binned = quantile_bin(clipped(df, keys, value, *clip), keys, value, bins, name)
    counts = binned.groupBy(*keys, name).agg(F.count("*").alias("_n"))
    every = counts.select(*keys).distinct().withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    weights = every.join(counts, [*keys, name], "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    slots = allocate(weights, keys, name, "_n", samples, least).select(*keys, name, F.least("slots", "_n").alias("_slots"))
    return evenly_spaced(binned.join(slots, [*keys, name]), [*keys, name], order, F.col("_slots")).drop("_slots")


def at_quantiles(df: DataFrame, keys: list[str], order: list[Column], quantiles: list[float], name: str = "quantile") -> DataFrame:
    """The rows at index round-half-even(q (n - 1)) of each group, one per different position."""
    r = numbered(df, keys, order, "_rank", "_total")
    c = F.when(F.lit(False), 0.0)
    for q in quantiles:
        c = c.when(F.col("_rank") == F.bround(q * (F.col("_total") - 1)) + 1, F.lit(q))
    return r.withColumn(name, c).where(F.col(name).isNotNull()).drop("_rank", "_total")


def anchors(df: DataFrame, keys: list[str], order: list[Column], name: str = "anchor") -> DataFrame:
    """The short, median (n // 2) and long row of each group, each row once."""
    r = numbered(df, keys, order, "_rank", "_total")
    c = F.when(F.col("_rank") == 1, "short").when(F.col("_rank") == F.col("_total"), "long").when(F.col("_rank") == F.floor(F.col("_total") / 2) + 1, "median")
    return r.withColumn(name, c).where(F.col(name).isNotNull()).drop("_rank", "_total")


def hash_top(df: DataFrame, keys: list[str], identity: str, seed: int, k: int) -> DataFrame:
    """A reservoir of k rows per group: the lowest SHA-256 of seed, keys and id. Pruned in each partition before the shuffle."""
    score = hash_score(F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys], F.col(identity).cast("string"))
    return top(df.withColumn("score", score), keys, [F.col("score"), F.col(identity)], k)


def round_robin(df: DataFrame, keys: list[str], deal: str, order: list[Column], n: int) -> DataFrame:
    """n rows of each key, dealt one by one from the groups of `deal` in turn; `df` holds few candidates of each group."""
    per = df.withColumn("turn", F.row_number().over(Window.partitionBy(*keys, deal).orderBy(*order))).where(F.col("turn") <= n)
    w = Window.partitionBy(*keys).orderBy("turn", deal)
    return per.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def split_of(document: Column, seed: int, ratio: float) -> Column:
    """'eval' or 'train' by the hash of seed and document alone: equal documents stay together, runs are alike."""
    bound = f"{int(ratio * (1 << 256)):064x}"
    return F.when(hash_score(F.lit(str(seed)), document) < F.lit(bound), "eval").otherwise("train")


def non_empty_split(df: DataFrame, document: str, order: list[str], split: str = "split") -> DataFrame:
    """If a split came out empty, the whole group of the first other document is moved to it; one pass over counts decides."""
    counts = {r[split]: r["n"] for r in df.groupBy(split).agg(F.count("*").alias("n")).collect()}
    out = df
    for want, other in (("eval", "train"), ("train", "eval")):
        if not counts.get(want) and counts.get(other, 0) > 1:
            first = df.orderBy(*order).limit(1).select(F.col(document).alias("_first"))
            out = df.join(F.broadcast(first), df[document] == F.col("_first"), "left").withColumn(split, F.when(F.col("_first").isNotNull(), want).otherwise(F.col(split))).drop("_first")
            break
    return out


def disambiguated(df: DataFrame, identity: str, file: str, line: str, name: str = "record_id", order: list[str] | None = None) -> DataFrame:
    """Ids made unique in the order of file and line (and `order`, which tells rows of one line apart).

    A row whose id an earlier row has gets `::file:line`, and while an earlier row has that too, `:2`, `:3` and so on; a
    later literal id gives way to an earlier made one. Every round, of the rows with one name the first keeps it and
    the others go on to their next; two or three rounds do unless ids imitate made ones. The first row of a name is
    found by a pre-aggregated minimum, so no id's rows are gathered. A null id is the empty one.
    """
    by = F.struct(*[F.col(c) for c in (file, line, *(order or []))])
    base, first = F.coalesce(F.col(identity).cast("string"), F.lit("")), F.col("_k") == 0
    made = F.concat(base, F.lit("::"), F.coalesce(F.col(file).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(line).cast("string"), F.lit("")))
    named = F.when(first, base).otherwise(F.concat(made, F.when(F.col("_k") > 1, F.concat(F.lit(":"), F.col("_k").cast("string"))).otherwise(F.lit(""))))
    rows = df.withColumn("_k", F.lit(0)).withColumn(name, base)
    while True:
        holders = rows.groupBy(F.col(name).alias("_n")).agg(F.min(by).alias("_first"))
        moved = rows.join(holders, rows[name] == F.col("_n")).withColumn("_moves", by != F.col("_first"))
        rows = cut(moved.withColumn("_k", F.col("_k") + F.col("_moves").cast("int")).withColumn(name, named).drop("_n", "_first"))
        if rows.where("_moves").isEmpty():
            return rows.drop("_k", "_moves")
        rows = rows.drop("_moves")


def shard(position: Column, shards: int) -> Column:
    return F.pmod(position, F.lit(shards)).cast("int")


def consecutive(position: Column, size: int, total: Column) -> Column:
    """The number of the group of `size` consecutive positions of `total`; a total that leaves a rest fails."""
    whole = F.when(total % size == 0, F.floor(position / size)).otherwise(F.raise_error(F.concat(total.cast("string"), F.lit(f" is no multiple of {size}"))).cast("bigint"))
    return whole.cast("int")


def balanced_shards(df: DataFrame, keys: list[str], index: str, weight: str, shards: int) -> DataFrame:
    """keys, index, weight, shard: longest first to the lightest shard (lowest number on a tie).

    Sequential by nature: one key's items are placed in one task, so each key must be a batch of work, not a corpus.
    """
    import heapq

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in [*keys, index])

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([weight, index], ascending=[False, True], kind="stable")
        load = [(0.0, s) for s in range(shards)]
        heapq.heapify(load)
        to = []
        for w in pdf[weight]:
            had, s = heapq.heappop(load)
            to.append(s)
            heapq.heappush(load, (had + float(w), s))
        return pdf.assign(shard=pd.array(to, "int32"))[[*keys, index, weight, "shard"]]

    return df.select(*keys, index, weight).groupBy(*keys).applyInPandas(of, f"{types}, `{weight}` {df.schema[weight].dataType.simpleString()}, shard int")


def batches(df: DataFrame, position: str, length: str, size: int, budget: int, window: int) -> DataFrame:
    """position, length, window, batch: windows of consecutive positions, sorted by length, cut greedily.

    A batch holds at most `size` rows, and (longest x rows) at most `budget` padded tokens, but at least one row.
    Windows are independent, so the work is spread over them.
    """
    types = f"`{position}` {df.schema[position].dataType.simpleString()}, `{length}` {df.schema[length].dataType.simpleString()}, window long, batch int"

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, position], kind="stable")
        to, nth, rows = [], 0, 0
        for n in pdf[length]:
            if rows and (rows == size or (rows + 1) * n > budget):
                nth, rows = nth + 1, 0
            rows += 1
            to.append(nth)
        return pdf.assign(batch=pd.array(to, "int32"))[[position, length, "window", "batch"]]

    cut_ = df.select(position, length, F.floor(F.col(position) / window).alias("window"))
    return cut_.groupBy("window").applyInPandas(of, types)


def slots(df: DataFrame, requested: str, fits: str) -> DataFrame:
    """One row per slot, as many as are requested and fit."""
    n = F.least(requested, fits)
    return df.where(n > 0).withColumn("slot", F.explode(F.sequence(F.lit(1), n)))
