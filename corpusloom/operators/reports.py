"""The report on paired runs: ratios per metric with a reason for each pair left out, their quality, intervals, gates.

Pairs are rows of `pairing.paired`: structs `ref` and `met` with a reason, null for a pair.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.functions import text as X
from corpusloom.operators import pairing as J


@dataclass(frozen=True)
class Metric:
    """A paired metric: its time field, its token field for rates, and whether it asks for proof of a decode phase."""

    time: str
    tokens: str | None = None
    decode: bool = False
    missing_tokens: str = "missing_decode_tokens"


#: Fixed: the four metrics of both scopes' reports.
METRICS = {
    "esr": Metric("request_wall_ms"),
    "decode_time_ratio": Metric("decode_active_ms", decode=True),
    "decode_rate_ratio": Metric("decode_active_ms", "decode_token_count", True),
    "output_rate_ratio": Metric("request_wall_ms", "timed_generated_tokens", missing_tokens="missing_timed_tokens"),
}
#: Fixed: fields of a decode duration that was measured itself.
EVIDENCE = ["decode_active_ms", "decode_ms"]


def observed(pairs: DataFrame, m: Metric, columns: list[str]) -> DataFrame:
    """`pairs` without a reason, with rt, mt (times), rn, mn (tokens, null for times alone) and why, null where they count.

    The checks come in a fixed order: evidence and equal definition of the decode phase, its tokens, the times, the
    tokens that were timed.
    """
    r = lambda c: F.col(f"ref.{c}") if c in columns else F.lit(None)
    t = lambda c: F.col(f"met.{c}") if c in columns else F.lit(None)
    chain = F.when(F.lit(False), "")
    if m.decode:
        proof = lambda side: F.coalesce(*[S.finite_positive(side(c)) for c in EVIDENCE])
        alike = r("decode_phase_verified") & t("decode_phase_verified") & (r("decode_phase_definition") == t("decode_phase_definition"))
        chain = chain.when(proof(r).isNull() | proof(t).isNull(), "missing_decode_evidence").when(~F.coalesce(alike, F.lit(False)), "phase_unverified")
    rn, mn = (S.counter(side(m.tokens)) if m.tokens else F.lit(None).cast("long") for side in (r, t))
    if m.tokens and m.decode:
        chain = chain.when(rn.isNull() | mn.isNull(), m.missing_tokens).when((rn == 0) | (mn == 0), "zero_decode_tokens")
    times = J.time_issue(r(m.time), t(m.time))
    chain = chain.when(times.isNotNull(), times)
    if m.tokens and not m.decode:
        chain = chain.when(rn.isNull() | mn.isNull(), m.missing_tokens)
    good = pairs.where(F.col("reason").isNull())
    return good.withColumn("rt", S.finite_positive(r(m.time))).withColumn("mt", S.finite_positive(t(m.time))).withColumn("rn", rn).withColumn("mn", mn).withColumn("why", chain)


def estimate(rt: Column, mt: Column, rn: Column, mn: Column, rate: bool) -> Column:
    """Ratio of summed times, or of the token rates; null unless all sums are positive."""
    times = S.ratio_of_sums(rt, mt)
    if not rate:
        return times
    tokens = F.when((F.sum(rn) > 0) & (F.sum(mn) > 0), S.ratio_of_sums(mn, rn))
    return tokens * times


def metric_report(pairs: DataFrame, keys: list[str], columns: list[str], metrics: dict[str, Metric] = METRICS, digits: int = 8) -> DataFrame:
    """keys, metric, n, value: each metric from the pairs that count for it."""
    out = None
    for name, m in metrics.items():
        good = observed(pairs, m, columns).where("why IS NULL")
        value = estimate(F.col("rt"), F.col("mt"), F.col("rn"), F.col("mn"), m.tokens is not None)
        made = good.groupBy(*keys).agg(F.count("*").alias("n"), F.round(value, digits).alias("value")).select(*keys, F.lit(name).alias("metric"), "n", "value")
        out = made if out is None else out.unionByName(made)
    return out


def metric_exclusions(pairs: DataFrame, keys: list[str], columns: list[str], metrics: dict[str, Metric] = METRICS) -> DataFrame:
    """keys, metric, reason, n: what each metric leaves out, the joins' reasons among them."""
    joined = J.exclusions(pairs, keys)
    out = None
    for name, m in metrics.items():
        own = observed(pairs, m, columns).where("why IS NOT NULL").groupBy(*keys, F.col("why").alias("reason")).agg(F.count("*").alias("n"))
        made = own.unionByName(joined).select(*keys, F.lit(name).alias("metric"), "reason", "n")
        out = made if out is None else out.unionByName(made)
    return out


def quality(pairs: DataFrame, keys: list[str], text: str = "text", tokens: str = "visible_output_tokens", digits: int = 6) -> DataFrame:
    """keys and the agreement of the valid pairs' outputs: equal texts, token counts and their ratio, degenerate outputs.

    Texts are compared where both are there, tokens where both are whole numbers; a rate without a comparison is null.
    """
    r, m = F.col(f"ref.{text}"), F.col(f"met.{text}")
    rn, mn = S.counter(F.col(f"ref.{tokens}")), S.counter(F.col(f"met.{tokens}"))
    both, counted = r.isNotNull() & m.isNotNull(), rn.isNotNull() & mn.isNotNull()
    degenerate = lambda c: X.repetition(c)["degenerate"]
    good = pairs.where(F.col("reason").isNull())
    n, k = F.count_if(both), F.count_if(counted)
    rate = lambda x, of: F.round(S.ratio(x, of), digits)
    bad_m, bad_r = F.count_if(both & degenerate(m)), F.count_if(both & degenerate(r))
    return good.groupBy(*keys).agg(
        F.count("*").alias("valid_pair_count"), n.alias("text_comparison_count"), rate(F.count_if(both & (r == m)), n).alias("exact_text_match_rate"),
        k.alias("token_count_comparison_count"), rate(F.count_if(counted & (rn == mn)), k).alias("exact_token_count_match_rate"),
        F.round(F.avg(F.when(counted & (rn > 0), mn / rn)), digits).alias("mean_visible_token_ratio"),
        F.round(F.avg(F.when(counted, mn)), digits).alias("mean_method_visible_output_tokens"), F.round(F.avg(F.when(counted, rn)), digits).alias("mean_reference_visible_output_tokens"),
        bad_m.alias("method_degenerate_output_count"), rate(bad_m, n).alias("method_degenerate_output_rate"),
        bad_r.alias("reference_degenerate_output_count"), rate(bad_r, n).alias("reference_degenerate_output_rate"),
    )


class Draws:
    """The numbers below n that Python's generator draws one after another, many at once.

    A draw takes the high bits of the next 32-bit words of the same twister until they make a number below n.
    """

    def __init__(self, seed: int):
        state = random.Random(seed).getstate()[1]
        self.source = np.random.MT19937()
        self.source.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
        self.held = np.zeros(0, np.uint32)

    def __call__(self, n: int, count: int) -> np.ndarray:
        """The next `count` numbers."""
        shift, made, got = np.uint32(32 - n.bit_length()), [], 0
        while got < count:
            if not len(self.held):
                self.held = self.source.random_raw(1 << 16).astype(np.uint32)
            drawn = self.held >> shift
            fits = np.flatnonzero(drawn < n)[: count - got]
            made.append(drawn[fits])
            got += len(fits)
            self.held = self.held[(fits[-1] + 1 if got == count else len(self.held)) :]
        return np.concatenate(made).astype(np.int64) if made else np.zeros(0, np.int64)


def _estimates(columns: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The estimate of each resample (a row of indices): of two columns the ratio of sums, of four the ratio of rates."""
    sums = columns[:, rows].sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        return sums[0] / sums[1] if len(columns) == 2 else (sums[1] / sums[3]) / (sums[0] / sums[2])


def resampled(columns: np.ndarray, seed: int, resamples: int, block: int = 4_000_000) -> np.ndarray:
    """The estimates of all resamples of paired columns, in the order of their draws."""
    n, draws, out = columns.shape[1], Draws(seed), []
    step = max(1, block // max(n, 1))
    for start in range(0, resamples, step):
        k = min(step, resamples - start)
        out.append(_estimates(columns, draws(n, k * n).reshape(k, n)))
    return np.concatenate(out)


def interval(pairs: DataFrame, keys: list[str], columns: list[str], identity: str, seed: int = 20260928, resamples: int = 10_000, confidence: float = 0.95) -> DataFrame:
    """keys, n, value, low, high: percentile interval of a ratio, resampling pairs in the order of their id.

    Two `columns` (reference and method times) give the ratio of sums; four (reference and method tokens, reference and
    method times) the ratio of rates. The draws are those of Python's generator for `seed`, one after another, so a
    group is one task: for benchmark runs, whose groups are bounded; `pairing.spread_bootstrap` is for others. Pairs
    without finite positive numbers do not count; a group without any has nulls.
    """
    if not 0 < confidence < 1 or resamples <= 0:
        raise ValueError("confidence must be between 0 and 1 and resamples positive")
    types = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(identity)[columns].astype(float).to_numpy().T
        x = x[:, (np.isfinite(x) & (x > 0)).all(axis=0)]
        row = {k: pdf[k].iloc[0] for k in keys} | {"n": x.shape[1], "value": None, "low": None, "high": None}
        if x.shape[1]:
            made, tail = np.sort(resampled(x, seed, resamples)), (1 - confidence) / 2
            row["value"] = float(_estimates(x, np.arange(x.shape[1])[None])[0])
            row["low"] = float(made[max(0, min(resamples - 1, math.floor(tail * resamples)))])
            row["high"] = float(made[max(0, min(resamples - 1, math.ceil((1 - tail) * resamples) - 1))])
        return pd.DataFrame([row])

    return pairs.select(*keys, identity, *columns).groupBy(*keys).applyInPandas(of, f"{types}, n long, value double, low double, high double")


def complete_geomean(cells: DataFrame, keys: list[str], stratum: str, value: str, strata: Sequence[str], digits: int = 8) -> DataFrame:
    """keys, strata, value: geometric mean of the strata's ratios, null unless each of `strata` has a positive one."""
    good = F.col(stratum).isin(*strata) & (F.col(value) > 0)
    n = F.countDistinct(F.when(good, F.col(stratum)))
    mean = F.exp(F.avg(F.when(good, F.ln(F.col(value)))))
    return cells.groupBy(*keys).agg(n.alias("strata"), F.round(F.when(n == len(strata), mean), digits).alias("value"))


def stratified_interval(pairs: DataFrame, keys: list[str], stratum: str, columns: list[str], identity: str, strata: Sequence[str], seed: int = 20260928, resamples: int = 10_000) -> DataFrame:
    """keys, value, low, high: interval of the geometric mean of the strata's ratios, each stratum resampled in itself.

    Null unless every one of `strata` has pairs and a positive ratio. A resample with a ratio that is not positive is
    dropped. Draws follow one another, stratum by stratum in their order, so a key is one task, as in `interval`.
    """
    types = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {k: pdf[k].iloc[0] for k in keys} | {"value": None, "low": None, "high": None}
        groups = []
        for s in sorted(strata):
            x = pdf[pdf[stratum] == s].sort_values(identity)[columns].astype(float).to_numpy().T
            groups.append(x[:, (np.isfinite(x) & (x > 0)).all(axis=0)])
        if all(g.shape[1] for g in groups):
            draws, made = Draws(seed), []
            for _ in range(resamples):
                each = [float(_estimates(g, draws(g.shape[1], g.shape[1])[None])[0]) for g in groups]
                if all(v > 0 for v in each):
                    made.append(math.exp(sum(map(math.log, each)) / len(each)))
            whole = [float(_estimates(g, np.arange(g.shape[1])[None])[0]) for g in groups]
            row["value"] = math.exp(sum(map(math.log, whole)) / len(whole))
            if made:
                made.sort()
                row["low"], row["high"] = made[int(0.025 * (len(made) - 1))], made[int(0.975 * (len(made) - 1))]
        return pd.DataFrame([row])

    return pairs.select(*keys, stratum, identity, *columns).groupBy(*keys).applyInPandas(of, f"{types}, value double, low double, high double")


def gate(cells: DataFrame, shared: DataFrame, expected_cells: int, samples: int, least_coverage: float = 0.95, least_shared: float = 0.90) -> DataFrame:
    """One row: status, the checks and the reasons why a run does not qualify.

    `cells` (a row per dataset and method): success, expected, decode_pairs, count_mismatches. `shared` (a row per
    dataset and metric): n, the samples that all methods have. A check over no rows fails.
    """
    c = cells.agg(
        F.coalesce(F.every(F.col("decode_pairs") > 0), F.lit(False)).alias("strict_decode_all_cells"),
        F.coalesce(F.every(F.col("count_mismatches") == 0), F.lit(False)).alias("prompt_token_counts_match"),
        ((F.count("*") == expected_cells) & F.coalesce(F.every(F.coalesce(S.ratio(F.col("success"), F.col("expected")), F.lit(0.0)) >= least_coverage), F.lit(False))).alias("success_coverage"),
    )
    s = shared.agg((F.coalesce(F.min("n"), F.lit(0)) >= least_shared * samples).alias("shared_coverage"))
    both = c.withColumn("_one", F.lit(1)).join(s.withColumn("_one", F.lit(1)), "_one").drop("_one")
    checks = [("strict_decode_all_cells", "decode coverage is incomplete"), ("prompt_token_counts_match", "prompt token counts differ"), ("success_coverage", "success coverage is too low"), ("shared_coverage", "shared coverage is too low")]
    reasons = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(text)) for n, text in checks]))
    return both.select(F.when(F.size(reasons) == 0, "qualified").otherwise("not_qualified").alias("status"), *[n for n, _ in checks], F.array_join(reasons, "; ").alias("reason"))
