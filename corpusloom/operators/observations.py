"""Normalising raw benchmark records: aliases, units, derived measures, acceptance, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.operators import validation as V

#: Fixed: names a measure may go by, in order, with the factor to milliseconds or gigabytes.
ALIASES = {
    "e2e_ms": [("e2e_ms", 1.0), ("request_wall_ms", 1.0), ("total_ms", 1.0), ("latency_ms", 1.0), ("e2e_s", 1000.0), ("total_time", 1000.0), ("latency_s", 1000.0)],
    "prefill_ms": [("prefill_ms", 1.0), ("prefill_s", 1000.0), ("prefill_time", 1000.0)],
    "ttft_ms": [("ttft_ms", 1.0), ("time_to_first_token_ms", 1.0), ("ttft_s", 1000.0), ("ttft", 1000.0)],
    "decode_ms": [("decode_ms", 1.0), ("decode_s", 1000.0), ("decode_time", 1000.0), ("generation_time", 1000.0)],
    "peak_memory_gb": [("peak_memory_gb", 1.0), ("peak_memory_mb", 1 / 1024), ("max_memory_mb", 1 / 1024)],
    "input_tokens": [("input_tokens", 1.0), ("prompt_tokens", 1.0), ("actual_input_tokens", 1.0)],
    "output_tokens": [("output_tokens", 1.0), ("generated_tokens", 1.0), ("completion_tokens", 1.0), ("new_tokens", 1.0)],
}
MEASURES = ["model_load_ms", "e2e_ms", "prefill_ms", "ttft_ms", "decode_ms", "throughput_tok_s", "peak_memory_gb"]


def normalised(df: DataFrame) -> DataFrame:
    """`df` with the canonical measures: the first alias that has a number, in canonical units, else null.

    Columns that a table lacks count as null; pipeline_e2e_ms adds model load to the whole time where both are there.
    """
    have = set(df.columns)
    out = df
    for name, sources in ALIASES.items():
        found = [F.col(c).try_cast("double") * k for c, k in sources if c in have]
        out = out.withColumn(name, F.coalesce(*found) if found else F.lit(None).cast("double"))
    load = F.col("model_load_ms").try_cast("double") if "model_load_ms" in have else F.lit(None).cast("double")
    return out.withColumn("pipeline_e2e_ms", load + F.col("e2e_ms"))


def identity(df: DataFrame, names: tuple[str, ...] = ("doc_id", "sample_id", "question_id", "example_id", "id")) -> Column:
    """The first identifying column that is not null, as a string."""
    return F.coalesce(*[F.col(c).cast("string") for c in names if c in df.columns])


def derived(df: DataFrame) -> DataFrame:
    """`df` with throughput, decode throughput, time per output token and ratios; null where a part is missing or zero."""
    t, n = F.col("e2e_ms"), F.col("output_tokens")
    return (
        df.withColumn("throughput_tok_s", S.throughput(n, t))
        .withColumn("decode_tok_s", S.throughput(n, F.col("decode_ms")))
        .withColumn("tpot_ms", F.when(n > 0, F.col("decode_ms") / n))
        .withColumn("output_ratio", F.round(S.ratio(n, F.col("input_tokens")), 4))
        .withColumn("retained_ratio", F.round(S.ratio(F.col("retained_tokens"), F.col("input_tokens")), 4) if "retained_tokens" in df.columns else F.lit(None).cast("double"))
    )


def status_rows(df: DataFrame, keys: list[str], status: str, reason: str) -> DataFrame:
    """Rows for samples without a result: every measure null, with status and reason."""
    return df.select(*keys, F.lit(status).alias("status"), F.lit(reason).alias("reason"), *[F.lit(None).cast("double").alias(m) for m in MEASURES])


def timeline(queued: Column, scheduled: Column, first: Column, last: Column, tokens: Column) -> Column:
    """(queue_ms, prefill_ms, decode_ms, e2e_ms, itl_ms) of four times in seconds; never negative, null with a missing time."""
    span = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), (b - a) * 1000.0))
    decode = span(first, last)
    return F.struct(span(queued, scheduled).alias("queue_ms"), span(scheduled, first).alias("prefill_ms"), decode.alias("decode_ms"), span(queued, last).alias("e2e_ms"), F.when(tokens > 1, decode / (tokens - 1)).alias("itl_ms"))


def timing_cascade(request: Column, metrics: Column, batch_ms: Column, batch_size: Column) -> Column:
    """A request's own time, else the runner's, else its share of the batch's."""
    return F.coalesce(S.finite_positive(request), S.finite_positive(metrics), S.ratio(batch_ms, batch_size))


def acceptance(accepted: Column, proposed: Column, steps: Column, rate: Column | None = None, mean_length: Column | None = None) -> Column:
    """verification_steps, draft_tokens_accepted, draft_tokens_proposed, avg_accept_length, accepted_draft_tokens_per_step,
    acceptance_rate, acceptance_rate_percent, rejected_draft_ratio.

    Counters that are no whole numbers are null. The rate is accepted over proposed; where neither counter is there, it
    is the fallback `rate` if that lies in [0, 1]; else null. The mean length is 1 + accepted over steps, or without
    these the fallback `mean_length` if that is at least 1.
    """
    a, p, n = S.counter(accepted), S.counter(proposed), S.counter(steps)
    none = F.lit(None).cast("double")
    number = lambda c: none if c is None else S.number(c.try_cast("double"))
    other_rate, other_mean = number(rate), number(mean_length)
    raw = F.when((p > 0) & (a <= p), a / p).when(accepted.isNull() & proposed.isNull(), F.when(other_rate.between(0, 1), other_rate))
    per = F.when(n > 0, a / n)
    mean = F.coalesce(per + 1, F.when((other_mean >= 1) & (other_mean < float("inf")), other_mean))
    return F.struct(
        n.alias("verification_steps"), a.alias("draft_tokens_accepted"), p.alias("draft_tokens_proposed"), F.round(mean, 4).alias("avg_accept_length"), F.round(per, 4).alias("accepted_draft_tokens_per_step"),
        F.round(raw, 6).alias("acceptance_rate"), F.round(raw * 100, 4).alias("acceptance_rate_percent"), F.round(1 - raw, 6).alias("rejected_draft_ratio"),
    )


def acceptance_issues(lengths: Column, histogram: Column, accepted: Column, proposed: Column, steps: Column, mean: Column, tolerance: float = 1e-3) -> Column:
    """What contradicts what: the trace's mean and length, the histogram's sum, the counters."""
    total = F.aggregate(lengths, F.lit(0.0), lambda s, x: s + x)
    counted = F.aggregate(histogram, F.lit(0.0), lambda s, x: s + x)
    return V.problems(
        ("accepted_exceeds_proposed", accepted > proposed),
        ("negative_counter", (accepted < 0) | (proposed < 0) | (steps < 0)),
        ("trace_length_mismatch", F.size(lengths) != steps),
        ("trace_mean_mismatch", F.abs(S.ratio(total, F.size(lengths)) - mean) > tolerance),
        ("histogram_sum_mismatch", counted != steps),
        ("counter_mean_mismatch", F.abs(1 + S.ratio(accepted, steps) - mean) > tolerance),
    )


def audit(df: DataFrame, required: list[str], budget: int | None = None) -> DataFrame:
    """`df` with present, missing (arrays of names) and issues of each record."""
    present = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in required]))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    checks = [("failed_status", F.col("status") != "success"), ("missing_fields", F.size(missing) > 0), ("negative_time", F.array_min(F.array(*[F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in required if c.endswith("_ms")] or [F.lit(0.0)])) < 0)]
    if budget is not None:
        checks.append(("over_budget", F.col("input_tokens") + F.col("output_tokens") > budget))
    return df.withColumn("present", present).withColumn("missing", missing).withColumn("issues", V.problems(*checks))


def unpivot(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """keys, measure, value: one row per non-null measure."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
    return df.select(*keys, F.inline(pairs)).where("value IS NOT NULL")


def hypotheses(df: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """keys, prefix, hypothesis: one row per non-blank text column; `texts` maps columns to prefixes."""
    pairs = F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(c).alias("hypothesis")) for c, p in texts.items()])
    return df.select(*keys, F.inline(pairs)).where(~V.blank(F.col("hypothesis")))


def enriched(rows: DataFrame, reference: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """Rows with the reference's columns where they have none of their own; of several reference rows the last by order counts."""
    from corpusloom.operators.ranking import keep_last

    last = keep_last(reference, keys, order).select(*keys, *[F.col(c).alias(f"_ref_{c}") for c in columns])
    joined = rows.join(last, keys, "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(F.col(c), F.col(f"_ref_{c}")) if c in rows.columns else F.col(f"_ref_{c}")).drop(f"_ref_{c}")
    return joined


def components(df: DataFrame, reference: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Measures of nested or flat fields next to their difference from the reference row of the same input."""
    ref = reference.select(*keys, *[F.col(m).alias(f"_r{i}") for i, m in enumerate(measures)])
    joined = df.join(ref, keys, "left")
    made = [F.col(m).alias(m.replace(".", "_")) for m in measures] + [(F.col(m) - F.col(f"_r{i}")).alias(f"{m.replace('.', '_')}_delta") for i, m in enumerate(measures)]
    return joined.select(*keys, *made)


def within(a: Column, b: Column, tolerance: float = 0.0005) -> Column:
    """Whether a stored value agrees with a recomputed one, relatively."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(b), F.lit(1e-12))


#: Fixed: the timing and the speculative measures of the grouped statistics.
TIMING = ["model_load_ms", "queue_ms", "prefill_ms", "ttft_ms", "decode_ms", "e2e_ms", "pipeline_e2e_ms", "tpot_ms", "itl_ms", "mean_itl_ms", "draft_ms", "verify_ms", "compression_ms", "retrieval_ms", "tokenize_ms", "detokenize_ms", "throughput_tok_s", "decode_tok_s", "peak_memory_gb"]
SPECULATIVE = ["verification_steps", "draft_tokens_accepted", "draft_tokens_proposed", "avg_accept_length", "accepted_draft_tokens_per_step", "acceptance_rate", "acceptance_rate_percent", "rejected_draft_ratio"]


def statistics(df: DataFrame, keys: list[str], measures: list[str] = TIMING) -> DataFrame:
    """keys and mean, median, p90 and deviation of those of `measures` that `df` has, over its successful rows."""
    good = df.where(F.col("status") == "success") if "status" in df.columns else df
    return S.summary(good, keys, [m for m in measures if m in df.columns])


def generation_summary(df: DataFrame, keys: list[str], lengths: str = "accept_lengths", tokens: str = "output_tokens", ms: str = "e2e_ms") -> DataFrame:
    """keys, samples, tokens, tokens_per_s (all tokens over all time), mean_rate, steps, mean_accept_length over all steps of all rows.

    Acceptance lengths are summed in their rows before they are added up; nothing is exploded.
    """
    own = F.coalesce(F.col(lengths), F.array().cast("array<int>"))
    total = F.aggregate(own, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))
    n = F.sum(F.size(own))
    return df.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.sum(tokens).alias("tokens"), F.round(F.try_divide(F.sum(tokens) * 1000.0, F.sum(ms)), 4).alias("tokens_per_s"),
        F.round(S.mean_rate(F.col(ms), F.col(tokens)), 4).alias("mean_rate"), n.alias("steps"), F.round(F.try_divide(F.sum(total), n), 4).alias("mean_accept_length"),
    )


def stability(df: DataFrame, keys: list[str], group: list[str], output: str, time: str) -> DataFrame:
    """group, samples, repeated, stable, stable_rate, worst_spread over the repeats of each sample (`keys` with `group`).

    A sample is stable if all its successful repeats have one output; its spread is the longest time over the shortest.
    """
    good = df.where(F.col("status") == "success")
    per = good.groupBy(*group, *keys).agg(F.count("*").alias("n"), (F.min(output).eqNullSafe(F.max(output)) & (F.count(output).isin(0) | (F.count(output) == F.count("*")))).alias("same"), F.try_divide(F.max(time), F.min(time)).alias("spread"))
    twice = F.col("n") > 1
    stable = F.count_if(twice & F.col("same"))
    return per.groupBy(*group).agg(F.count("*").alias("samples"), F.count_if(twice).alias("repeated"), stable.alias("stable"), F.round(S.ratio(stable, F.count_if(twice)), 4).alias("stable_rate"), F.round(F.max(F.when(twice, F.col("spread"))), 4).alias("worst_spread"))


def response_metrics(metadata: Column) -> Column:
    """A map of numbers in milliseconds of a response's metadata map: names in `_s` or `_seconds` are scaled, `_ms` and others stay.

    What is no finite number is left out; the scaled name ends in `_ms`.
    """
    number = lambda v: F.when(F.abs(v.try_cast("double")) < float("inf"), v.try_cast("double"))
    kept = F.map_filter(F.transform_values(metadata, lambda k, v: number(v)), lambda k, v: v.isNotNull())
    seconds = lambda k: k.rlike("_(s|seconds)$")
    entry = lambda e: F.struct(F.when(seconds(e["key"]), F.regexp_replace(e["key"], "_(s|seconds)$", "_ms")).otherwise(e["key"]).alias("key"), F.when(seconds(e["key"]), e["value"] * 1000.0).otherwise(e["value"]).alias("value"))
    entries = F.transform(F.map_entries(kept), entry)
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(first)
