"""Functions of token-id and number arrays, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def find(a: Column, needle: Column, start: int = 0) -> Column:
    """0-based place of the first occurrence of `needle` at or after `start`, -1 if there is none or it is empty."""
    n = F.size(needle)
    last = F.size(a) - n
    places = F.filter(F.sequence(F.lit(start), F.greatest(last, F.lit(start))), lambda i: F.slice(a, i + 1, n) == needle)
    return F.when((n == 0) | (last < start), -1).otherwise(F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(-1)))


def head_tail(a: Column, most: int, tail: int) -> Column:
    """The array cut to `most` elements: its head, and its last `tail` ones."""
    tail = min(tail, most)
    keep = F.concat(F.slice(a, 1, most - tail), F.slice(a, -tail, tail) if tail else F.slice(a, 1, 0))
    return F.when(F.size(a) <= most, a).otherwise(keep)


def until(a: Column, stop: Column) -> Column:
    """What stands before the first `stop`."""
    at = F.array_position(a, stop).cast("int")
    return F.when(at > 0, F.slice(a, F.lit(1), at - 1)).otherwise(a)


def span_mask(n: Column, start: Column, end: Column) -> Column:
    """n zeros with ones in [start, end)."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ((i >= start) & (i < end)).cast("int"))).otherwise(F.array().cast("array<int>"))


def pad(a: Column, n: Column, value: Column) -> Column:
    """Padded on the right to n elements."""
    return F.concat(a, F.array_repeat(value, F.greatest(n - F.size(a), F.lit(0))))


def adjacent_true(mask: Column) -> Column:
    """Whether two neighbours are both set."""
    return F.exists(F.zip_with(mask, F.slice(mask, F.lit(2), F.greatest(F.size(mask) - 1, F.lit(0))), lambda x, y: (x > 0) & (F.coalesce(y, F.lit(0)) > 0)), lambda b: b)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; two zero vectors are alike, one alone is unlike."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(F.try_divide(dot(a, b), na * nb))


def largest_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda p, q: F.abs(p.cast("double") - q.cast("double"))))


def relative_l2(a: Column, b: Column) -> Column:
    """Length of the difference over that of b."""
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.try_divide(norm(F.zip_with(a, b, lambda p, q: p.cast("double") - q.cast("double"))), norm(F.transform(b, lambda v: v.cast("double"))))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    at = F.array_position(same, F.lit(False)).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(same))


def first_mismatch(a: Column, b: Column) -> Column:
    """0-based place of the first difference, the shorter length if one is a prefix, null if equal."""
    return F.when(a == b, F.lit(None).cast("int")).otherwise(common_prefix(a, b))


def sequence_parity(a: Column, b: Column) -> Column:
    """(exact, prefix, mismatch): mismatch is null also where one is a prefix of the other."""
    prefix = common_prefix(a, b)
    ends = prefix >= F.least(F.size(a), F.size(b))
    return F.struct((a == b).alias("exact"), prefix.alias("prefix"), F.when(~ends, prefix).alias("mismatch"))


def accepted_prefix(draft: Column, target: Column) -> Column:
    """How many drafted tokens are accepted: those before the first one the target differs from."""
    return common_prefix(draft, target)


def trace_acceptance(lengths: Column, block: int) -> Column:
    """(proposed, accepted) of accepted lengths per step, each counting the token that is always right."""
    return F.struct((F.size(lengths) * (block - 1)).alias("proposed"), F.aggregate(lengths, F.lit(0), lambda s, x: s + F.greatest(x.cast("int") - 1, F.lit(0))).alias("accepted"))


def first_supported(*values: Column) -> Column:
    """The first value above 0."""
    return F.coalesce(*[F.when(v > 0, v) for v in values])


def spread_layers(layers: int, picked: int) -> list[int]:
    """`picked` layer numbers from the second to the third-last, evenly spread."""
    if picked == 1:
        return [layers // 2]
    first, last = 1, layers - 3
    return [round(first + i * (last - first) / (picked - 1)) for i in range(picked)]
