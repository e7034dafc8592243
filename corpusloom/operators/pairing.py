"""Joining observations of a method with those of the reference method, with a reason for every row left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.stats import finite_positive, ratio, ratio_of_sums

#: Fixed: what identifies a run, in the order in which a difference is named.
REQUIRED = ["dataset", "prompt_token_sha256", "generation_config_sha256", "target_revision", "tokenizer_revision", "hardware_fingerprint", "gpu_count", "tp_size", "batch_size", "concurrency", "cache_policy"]
CONFIG = ["pairing_config_sha256", "generation_config_sha256", "target_checkpoint_sha256", "target_revision", "tokenizer_revision"]
MOST_METHODS, MOST_CELLS = 1000, 100_000
RESOURCES = ["hardware_fingerprint", "gpu_count", "tp_size", "batch_size", "concurrency", "cache_policy"]


def counted(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, row: each key once, with its number of rows and one row as a struct.

    Pre-aggregated in every partition, so a key of any size costs one row a partition.
    """
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*others)).alias("row"))


def identity_issue(columns: list[str], scope: str = "common") -> Column:
    """The first difference between the structs `ref` and `met` that forbids pairing them, in one ordered chain.

    Columns that the observations lack are null on both sides.
    """
    r = lambda c: F.col(f"ref.{c}") if c in columns else F.lit(None)
    m = lambda c: F.col(f"met.{c}") if c in columns else F.lit(None)
    differ = lambda c: F.coalesce(r(c) != m(c), F.lit(False))
    none = lambda c: r(c).isNull() | m(c).isNull()
    anyof = lambda f, cs: F.array_max(F.array(*[f(c) for c in cs]))
    native = ["runtime_config_sha256", "native_timing_scope"]
    chain = F.when(~F.coalesce((r("contract_version") == 2) & (m("contract_version") == 2), F.lit(False)), "contract_version_mismatch")
    chain = chain.when(anyof(none, REQUIRED), "missing_identity")
    if scope == "native":
        chain = chain.when(none(native[0]) | r(native[1]).isNull(), "missing_identity")
    chain = chain.when(differ("run_id"), "config_mismatch").when(none("actual_input_tokens"), "missing_identity")
    chain = chain.when(differ("actual_input_tokens"), "prompt_mismatch").when(differ("dataset"), "config_mismatch")
    chain = chain.when(differ("prompt_token_sha256"), "prompt_mismatch").when(anyof(differ, CONFIG), "config_mismatch")
    if scope == "native":
        chain = chain.when(differ(native[0]), "config_mismatch")
    chain = chain.when(anyof(differ, RESOURCES), "unequal_resource")
    return chain.when(differ(native[1]), "config_mismatch") if scope == "native" else chain


def paired(reference: DataFrame, methods: DataFrame, keys: list[str], method: str = "method", issue: Column | None = None) -> DataFrame:
    """One row per method and key: ref, met (structs), reason (null for a pair), lost (rows it stands for).

    Keys that occur twice on either side are left out and counted by rows; then one-sided keys, rows that failed, and
    what `issue` names. The reference is repeated for each method; the list of methods is read first, and refused if it
    is longer than MOST_METHODS.
    """
    names = [r[0] for r in methods.select(method).where(F.col(method).isNotNull()).distinct().limit(MOST_METHODS + 1).collect()]
    if len(names) > MOST_METHODS:
        raise ValueError(f"more than {MOST_METHODS} methods")
    ref = counted(reference.drop(method), keys).select(*keys, F.col("n").alias("n_ref"), F.col("row").alias("ref"))
    met = counted(methods, [method, *keys]).select(method, *keys, F.col("n").alias("n_met"), F.col("row").alias("met"))
    kind = methods.schema[method].dataType
    every = ref.withColumn(method, F.explode(F.array(*[F.lit(n).cast(kind) for n in sorted(names)]).cast(f"array<{kind.simpleString()}>")))
    joined = every.join(met, [method, *keys], "full_outer")
    twice = (F.coalesce("n_ref", F.lit(0)) > 1) | (F.coalesce("n_met", F.lit(0)) > 1)
    failed = (F.coalesce(F.col("ref.status"), F.lit("success")) != "success") | (F.coalesce(F.col("met.status"), F.lit("success")) != "success")
    reason = F.when(twice, "duplicate_sample_id").when(F.col("n_ref").isNull(), "missing_reference").when(F.col("n_met").isNull(), "missing_method").when(failed, "failed_status")
    if issue is not None:
        reason = reason.otherwise(issue)
    over = lambda n: F.when(F.coalesce(n, F.lit(0)) > 1, F.col(n)).otherwise(0)
    lost = F.when(twice, over("n_ref") + over("n_met")).when(reason.isNotNull(), 1).otherwise(0)
    return joined.withColumn("reason", reason).withColumn("lost", lost.cast("long")).select(method, *keys, "ref", "met", "reason", "lost")


def time_issue(a: Column, b: Column) -> Column:
    """Why two times give no ratio: nonfinite, missing or nonpositive; null if they do."""
    odd = lambda x: F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return (
        F.when(finite_positive(a).isNotNull() & finite_positive(b).isNotNull(), None)
        .when(F.coalesce(odd(a), F.lit(False)) | F.coalesce(odd(b), F.lit(False)), "nonfinite_time")
        .when(a.isNull() | b.isNull(), "missing_time")
        .otherwise("nonpositive_time")
    )


def metric_reason(a_time: Column, b_time: Column, decode: bool = False, a_def: Column | None = None, b_def: Column | None = None, a_ok: Column | None = None, b_ok: Column | None = None, a_n: Column | None = None, b_n: Column | None = None) -> Column:
    """Why a pair is left out of one metric; the first failing check counts."""
    chain = F.when(F.lit(False), "")
    if decode:
        chain = chain.when(a_time.isNull() | b_time.isNull(), "missing_decode_evidence")
        if a_def is not None:
            chain = chain.when(~F.coalesce(a_ok & b_ok & (a_def == b_def), F.lit(False)), "phase_unverified")
    if a_n is not None:
        chain = chain.when(a_n.isNull() | b_n.isNull(), "missing_decode_tokens").when((a_n == 0) | (b_n == 0), "zero_decode_tokens")
    return chain.otherwise(time_issue(a_time, b_time))


def exclusions(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reason, n: rows left out, by reason."""
    return pairs.where(F.col("reason").isNotNull()).groupBy(*keys, "reason").agg(F.sum("lost").cast("long").alias("n"))


def ratios(pairs: DataFrame, keys: list[str], time: str = "e2e_ms", tokens: str = "output_tokens") -> DataFrame:
    """keys, pairs, time_ratio (sum over sum), rate_ratio (tokens a ms over tokens a ms) of the pairs with both times."""
    rt, mt = finite_positive(F.col(f"ref.{time}")), finite_positive(F.col(f"met.{time}"))
    rn, mn = F.col(f"ref.{tokens}").cast("double"), F.col(f"met.{tokens}").cast("double")
    good = pairs.where(F.col("reason").isNull()).where(rt.isNotNull() & mt.isNotNull())
    return good.groupBy(*keys).agg(
        F.count("*").alias("pairs"),
        F.round(ratio_of_sums(rt, mt), 4).alias("time_ratio"),
        F.round(ratio(ratio_of_sums(mn, mt), ratio_of_sums(rn, rt)), 4).alias("rate_ratio"),
    )


def spread_bootstrap(pairs: DataFrame, keys: list[str], a: str, b: str, identity: str, seed: int = 1, resamples: int = 200, confidence: float = 0.95) -> DataFrame:
    """keys, n, ratio, low, high for groups of any size: each pair draws a Poisson(1) weight per resample from its hash.

    Another stream of draws than `reports.interval`; sums are pre-aggregated, a group is never gathered.
    """
    u = (F.pmod(F.xxhash64(F.col(identity), F.col("r"), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)).cast("double")
    bounds = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    weight = F.when(u < bounds[0], 0)
    for k, x in enumerate(bounds[1:], 1):
        weight = weight.when(u < x, k)
    drawn = pairs.where((F.col(a) > 0) & (F.col(b) > 0)).select(*keys, a, b, identity, F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("r")).withColumn("_w", weight.otherwise(7))
    per = drawn.groupBy(*keys, "r").agg(ratio_of_sums(F.col(a) * F.col("_w"), F.col(b) * F.col("_w")).alias("_x"), ratio_of_sums(F.col(a), F.col(b)).alias("_all"), F.count("*").alias("_n"))
    tail = (1 - confidence) / 2
    return per.groupBy(*keys).agg(F.max("_n").alias("n"), F.max("_all").alias("ratio"), F.percentile("_x", F.lit(tail)).alias("low"), F.percentile("_x", F.lit(1 - tail)).alias("high"))


def shared(valid: DataFrame, group: list[str], identity: str, method: str, methods: int) -> DataFrame:
    """group, identity of the ids that are valid in every one of `methods` methods."""
    return valid.groupBy(*group, identity).agg(F.countDistinct(method).alias("_n")).where(F.col("_n") == methods).drop("_n")


def coverage(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side: those of one side only, both ways."""
    only = lambda x, y, s: x.select(*keys).distinct().join(y.select(*keys).distinct(), keys, "left_anti").withColumn("side", F.lit(s))
    return only(a, b, "left_only").unionByName(only(b, a, "right_only"))


def unresolved(expected: DataFrame, done: DataFrame, keys: list[str], status: str = "status", ids: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Expected rows without a success. With `ids`, rows of `done` may cover an array of ids; the last state of each counts."""
    from corpusloom.operators.ranking import keep_last

    rows = done
    if ids:
        covered = F.when(F.size(F.coalesce(F.col(ids), F.array().cast("array<string>"))) > 0, F.col(ids)).otherwise(F.array(F.col(keys[-1])))
        rows = done.withColumn(keys[-1], F.explode(covered))
    last = keep_last(rows, keys, order) if order else rows
    return expected.join(last.where(F.col(status) == "success").select(*keys).distinct(), keys, "left_anti")


def filled(expected: DataFrame, rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every expected row with its first success, else its first row, else status failed and error missing."""
    from corpusloom.operators.ranking import keep_first

    best = keep_first(rows, keys, [(F.col("status") != "success").cast("int"), *order])
    return expected.join(best, keys, "left").withColumn("status", F.coalesce("status", F.lit("failed"))).withColumn("error", F.when(F.col("_there").isNull(), "missing_output") if "_there" in rows.columns else F.lit(None).cast("string"))


def grid(*dimensions: DataFrame) -> DataFrame:
    """All combinations of small dimension tables: the size of the design, not of the data.

    Each dimension after the first is read first, refused above MOST_CELLS rows, and exploded.
    """
    out, *rest = dimensions
    for d in rest:
        rows = d.limit(MOST_CELLS + 1).collect()
        if len(rows) > MOST_CELLS:
            raise ValueError(f"a dimension of more than {MOST_CELLS} rows")
        cells = [F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in d.schema.fields]) for r in rows]
        kind = d.schema.simpleString()
        out = out.withColumn("_cell", F.explode(F.array(*cells).cast(f"array<{kind}>"))).select(*out.columns, "_cell.*")
    return out
