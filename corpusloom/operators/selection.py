"""Choosing methods, samples and sizes, gates between runs, and confidence of combined ratios."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as X


def chosen(text: str, known: Sequence[str]) -> list[str]:
    """The names of a comma-separated choice in the canonical order; `all` is every one, repeats count once, unknown ones fail."""
    asked = [x.strip() for x in text.split(",") if x.strip()]
    if not asked:
        raise ValueError("nothing is selected")
    if asked == ["all"]:
        return list(known)
    unknown = sorted(set(asked) - set(known))
    if unknown:
        raise ValueError(f"unknown: {', '.join(unknown)}")
    return [k for k in known if k in set(asked)]


def with_reference(methods: Sequence[str], reference: str) -> list[str]:
    """The methods, the reference first; it must be among them."""
    if reference not in methods:
        raise ValueError(f"the selection lacks the reference {reference}")
    return [reference, *(m for m in methods if m != reference)]


def method_order(method: Column, methods: Sequence[str], reference: str) -> list[Column]:
    """Sort keys: the reference, then the methods in their order, unknown ones last by name."""
    known = F.array(*[F.lit(m) for m in with_reference(methods, reference)])
    at = F.array_position(known, method)
    return [F.when(at > 0, at).otherwise(len(methods) + 1), method]


def sample_limit(mode: str) -> int | None:
    """Samples of a mode: smoke 2, representative 20, full all."""
    return {"smoke": 2, "representative": 20, "full": None}[mode]


def largest_fitting(fits: Callable[[int], bool], most: int) -> int:
    """The largest n up to `most` that fits, found by doubling and halving; 0 if not even 1 does."""
    if not fits(1):
        return 0
    low = 1
    while low < most and fits(min(low * 2, most)):
        low = min(low * 2, most)
    high = min(low * 2, most + 1)
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def budget_reason(prompt: Column, tokens: Column, budget: int) -> Column:
    """empty_prompt, input_limit or null: whether a sample can be run within a token budget."""
    blank = prompt.isNull() | (F.trim(prompt) == "")
    return F.when(blank, "empty_prompt").when(tokens > budget, "input_limit")


def integrity(text: Column, decoded: Column) -> Column:
    """Whether a text is what its tokens decode to, in compatibility form and with white space folded; null where either is unknown."""
    return F.when(text.isNull() | decoded.isNull(), F.lit(None).cast("boolean")).otherwise(X.decoded(text) == X.decoded(decoded))


def config_differences(a: DataFrame, b: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """key, a, b of the settings that differ or are on one side only; an empty result opens the gate."""
    joined = a.select(key, F.col(value).alias("a"), F.lit(True).alias("_a")).join(b.select(key, F.col(value).alias("b"), F.lit(True).alias("_b")), key, "full_outer")
    return joined.where(~F.col("a").eqNullSafe(F.col("b")) | F.col("_a").isNull() | F.col("_b").isNull()).select(key, "a", "b")


def complete_gate(df: DataFrame, keys: list[str], methods: int, samples: int) -> DataFrame:
    """keys, rows, complete, all_success: whether every method has every sample, and all went well."""
    g = df.groupBy(*keys).agg(F.count("*").alias("rows"), F.every(F.col("status") == "success").alias("all_success"))
    return g.select(*keys, "rows", (F.col("rows") == methods * samples).alias("complete"), "all_success")


def example(prefix: Column, document: Column, suffix: Column, summary: Column, budget: int) -> Column:
    """(ids, mask, kept): a training example of token arrays within `budget`.

    The document is cut so that prefix, suffix and summary fit; the mask is 1 on the summary, but 0 on the last
    position, which predicts nothing. kept is how many document tokens stayed; null if not even one fits.
    """
    room = F.lit(budget) - F.size(prefix) - F.size(suffix) - F.size(summary)
    kept = F.least(F.size(document), room)
    ids = F.concat(prefix, F.slice(document, F.lit(1), F.greatest(kept, F.lit(0))), suffix, summary)
    start = F.size(prefix) + F.greatest(kept, F.lit(0)) + F.size(suffix)
    n = F.size(ids)
    mask = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ((i >= start) & (i < n - 1)).cast("int"))
    return F.when(kept > 0, F.struct(ids.alias("ids"), mask.alias("mask"), kept.alias("kept")))
