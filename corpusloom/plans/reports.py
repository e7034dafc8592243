"""Queries of the report on paired runs, of acceptance, parity and strict joins. Method 1 is the reference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.operators import contracts as C
from corpusloom.operators import observations as O
from corpusloom.operators import pairing as J
from corpusloom.operators import reports as P
from corpusloom.plans.registry import registrar
from corpusloom.plans.relations import METHODS, OBS, observations
from corpusloom.session import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
query = registrar(QUERIES, ORACLE)

KEYS = ["dataset", "sample_id"]
#: Runs under contract version 2 as expressions that Spark and DuckDB read alike; most rows of an order agree.
_FIELDS = {
    "contract_version": "CASE WHEN l_partkey % 31 = 0 THEN 1 ELSE 2 END",
    "prompt_token_sha256": "CASE WHEN l_partkey % 17 = 0 THEN 'other' ELSE CAST(l_orderkey AS STRING) END",
    "generation_config_sha256": "CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE 'g' END",
    "pairing_config_sha256": "CASE WHEN l_suppkey % 41 = 0 THEN 'p2' ELSE 'p' END",
    "target_revision": "'t'",
    "tokenizer_revision": "'k'",
    "hardware_fingerprint": "CASE WHEN l_suppkey % 37 = 0 THEN 'h2' ELSE 'h' END",
    "gpu_count": "CASE WHEN l_suppkey % 13 = 0 THEN 2 ELSE 1 END",
    "tp_size": "1",
    "batch_size": "1",
    "concurrency": "1",
    "cache_policy": "'off'",
    "actual_input_tokens": "CASE WHEN l_suppkey % 19 = 0 THEN 7 ELSE 5 END",
    "request_wall_ms": "CASE WHEN l_partkey % 43 = 0 THEN NULL ELSE l_extendedprice END",
    "decode_active_ms": "CASE WHEN l_tax > 0 THEN l_extendedprice * (1 - l_discount) END",
    "decode_phase_verified": "l_partkey % 23 <> 0",
    "decode_phase_definition": "'steady'",
    "decode_token_count": "CASE WHEN l_quantity <= 2 THEN NULL WHEN l_quantity <= 4 THEN 0 ELSE CAST(l_quantity AS BIGINT) END",
    "timed_generated_tokens": "CASE WHEN l_quantity <= 3 THEN NULL ELSE CAST(l_quantity AS BIGINT) END",
    "visible_output_tokens": "CAST(l_quantity AS BIGINT)",
    "text": "CASE WHEN l_partkey % 47 = 0 THEN NULL WHEN l_partkey % 11 = 0 THEN repeat('a b c ', 12) ELSE concat('t', CAST(l_partkey % 3 AS STRING)) END",
}
_BASE = {"dataset": "o_orderpriority", "sample_id": "l_orderkey", "method": "CAST(l_linenumber AS INT)", "status": "CASE WHEN l_linestatus = 'F' THEN 'success' ELSE 'failed' END"}


def runs(spark: SparkSession, base: str) -> DataFrame:
    """Benchmark runs with their identity: order lines as `relations.observations`, all lines of an order of one prompt."""
    lines, orders = table(spark, base, "lineitem"), table(spark, base, "orders").select("o_orderkey", "o_orderpriority")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr(*[f"{e} AS {c}" for c, e in (_BASE | _FIELDS).items()])


RUNS = "runs AS (SELECT " + ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {c}" for c, e in (_BASE | _FIELDS).items()) + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_SIDE = lambda s: ", ".join(f"{s}.{c} AS {s}_{c}" for c in ("status", *_FIELDS))
_DIFFER = lambda cs: " OR ".join(f"r_{c} <> k_{c}" for c in cs)
#: Pairs with the reason of each that is left out, the identity checks in their order.
PAIRS = f"""{RUNS}, n AS (SELECT *, count(*) OVER (PARTITION BY dataset, sample_id, method) AS n, row_number() OVER (PARTITION BY dataset, sample_id, method) AS i FROM runs),
r AS (SELECT n.*, m.method AS met FROM n, (SELECT DISTINCT method FROM runs WHERE method > 1) m WHERE n.method = 1 AND i = 1), k AS (SELECT * FROM n WHERE method > 1 AND i = 1),
j AS (SELECT coalesce(r.met, k.method) AS method, coalesce(r.dataset, k.dataset) AS dataset, coalesce(r.sample_id, k.sample_id) AS sample_id, r.n AS nr, k.n AS nk, {_SIDE('r')}, {_SIDE('k')}
  FROM r FULL JOIN k ON r.met = k.method AND r.dataset = k.dataset AND r.sample_id = k.sample_id),
p AS (SELECT *, CASE WHEN coalesce(nr, 0) > 1 OR coalesce(nk, 0) > 1 THEN 'duplicate_sample_id' WHEN nr IS NULL THEN 'missing_reference' WHEN nk IS NULL THEN 'missing_method' WHEN r_status <> 'success' OR k_status <> 'success' THEN 'failed_status'
  WHEN NOT (r_contract_version = 2 AND k_contract_version = 2) THEN 'contract_version_mismatch' WHEN {' OR '.join(f'r_{c} IS NULL OR k_{c} IS NULL' for c in J.REQUIRED if c != 'dataset')} THEN 'missing_identity'
  WHEN r_actual_input_tokens IS NULL OR k_actual_input_tokens IS NULL THEN 'missing_identity' WHEN r_actual_input_tokens <> k_actual_input_tokens THEN 'prompt_mismatch' WHEN r_prompt_token_sha256 <> k_prompt_token_sha256 THEN 'prompt_mismatch'
  WHEN {_DIFFER(['pairing_config_sha256', 'generation_config_sha256', 'target_revision', 'tokenizer_revision'])} THEN 'config_mismatch' WHEN {_DIFFER(J.RESOURCES)} THEN 'unequal_resource' END AS reason,
  CASE WHEN coalesce(nr, 0) > 1 OR coalesce(nk, 0) > 1 THEN CASE WHEN nr > 1 THEN nr ELSE 0 END + CASE WHEN nk > 1 THEN nk ELSE 0 END ELSE 1 END AS lost FROM j)"""
_PHASE = "WHEN coalesce(r_decode_active_ms, 0) <= 0 OR coalesce(k_decode_active_ms, 0) <= 0 THEN 'missing_decode_evidence' WHEN NOT (r_decode_phase_verified AND k_decode_phase_verified) THEN 'phase_unverified'"
_TIME = lambda c: f"WHEN r_{c} IS NULL OR k_{c} IS NULL THEN 'missing_time' WHEN r_{c} <= 0 OR k_{c} <= 0 THEN 'nonpositive_time'"
_WHY = {
    "esr": f"CASE {_TIME('request_wall_ms')} END",
    "decode_time_ratio": f"CASE {_PHASE} END",
    "decode_rate_ratio": f"CASE {_PHASE} WHEN r_decode_token_count IS NULL OR k_decode_token_count IS NULL THEN 'missing_decode_tokens' WHEN r_decode_token_count = 0 OR k_decode_token_count = 0 THEN 'zero_decode_tokens' END",
    "output_rate_ratio": f"CASE {_TIME('request_wall_ms')} WHEN r_timed_generated_tokens IS NULL OR k_timed_generated_tokens IS NULL THEN 'missing_timed_tokens' END",
}
_SUM = lambda c: f"sum(r_{c}) / sum(k_{c})"
_RATE = lambda c, t: f"(sum(k_{c}) / sum(k_{t})) / (sum(r_{c}) / sum(r_{t}))"
_VALUE = {"esr": _SUM("request_wall_ms"), "decode_time_ratio": _SUM("decode_active_ms"), "decode_rate_ratio": _RATE("decode_token_count", "decode_active_ms"), "output_rate_ratio": _RATE("timed_generated_tokens", "request_wall_ms")}


def pairs(spark: SparkSession, base: str) -> DataFrame:
    """Every pair with its reason; the dataset is part of the identity, so a sample alone is the key."""
    d = runs(spark, base)
    made = J.paired(d.where("method = 1"), d.where("method > 1"), ["sample_id"], issue=J.identity_issue([*_BASE, *_FIELDS]))
    return made.withColumn("dataset", F.coalesce("ref.dataset", "met.dataset"))


def _pairs(spark: SparkSession, base: str) -> DataFrame:
    """The pairs, computed once for the several passes of a report."""
    return cut(pairs(spark, base))


_COLUMNS = ["status", *_FIELDS]


@query(f"WITH {PAIRS} SELECT method, reason, CAST(sum(lost) AS BIGINT) AS n FROM p WHERE reason IS NOT NULL GROUP BY ALL")
def identity_reasons(spark, base):
    return J.exclusions(pairs(spark, base), ["method"])


@query(f"WITH {PAIRS} " + " UNION ALL ".join(f"SELECT dataset, method, '{m}' AS metric, count(*) AS n, round({_VALUE[m]}, 6) AS value FROM p WHERE reason IS NULL AND {w} IS NULL GROUP BY ALL" for m, w in _WHY.items()))
def paired_metrics(spark, base):
    return P.metric_report(_pairs(spark, base), ["dataset", "method"], _COLUMNS, digits=6)


@query(f"WITH {PAIRS} " + " UNION ALL ".join(f"SELECT method, '{m}' AS metric, coalesce(reason, {w}) AS reason, CAST(sum(lost) AS BIGINT) AS n FROM p WHERE reason IS NOT NULL OR {w} IS NOT NULL GROUP BY ALL" for m, w in _WHY.items()))
def metric_exclusions(spark, base):
    return P.metric_exclusions(_pairs(spark, base), ["method"], _COLUMNS)


_LOOPS = "{s}_text LIKE 'a b c %'"


@query(f"""WITH {PAIRS}, v AS (SELECT *, r_text IS NOT NULL AND k_text IS NOT NULL AS b FROM p WHERE reason IS NULL) SELECT method, count(*) AS valid_pair_count, count(*) FILTER (WHERE b) AS text_comparison_count,
round(count(*) FILTER (WHERE b AND r_text = k_text) / count(*) FILTER (WHERE b), 6) AS exact_text_match_rate, count(*) AS token_count_comparison_count, round(count(*) FILTER (WHERE r_visible_output_tokens = k_visible_output_tokens) / count(*), 6) AS exact_token_count_match_rate,
round(avg(k_visible_output_tokens / r_visible_output_tokens), 6) AS mean_visible_token_ratio, round(avg(k_visible_output_tokens), 6) AS mean_method_visible_output_tokens, round(avg(r_visible_output_tokens), 6) AS mean_reference_visible_output_tokens,
count(*) FILTER (WHERE b AND {_LOOPS.format(s='k')}) AS method_degenerate_output_count, round(count(*) FILTER (WHERE b AND {_LOOPS.format(s='k')}) / count(*) FILTER (WHERE b), 6) AS method_degenerate_output_rate,
count(*) FILTER (WHERE b AND {_LOOPS.format(s='r')}) AS reference_degenerate_output_count, round(count(*) FILTER (WHERE b AND {_LOOPS.format(s='r')}) / count(*) FILTER (WHERE b), 6) AS reference_degenerate_output_rate FROM v GROUP BY method""")
def pair_quality(spark, base):
    return P.quality(pairs(spark, base), ["method"])


_SHARED_IDS = f"""s AS (SELECT metric, dataset, sample_id FROM ({" UNION ALL ".join(f"SELECT '{m}' AS metric, dataset, sample_id, method FROM p WHERE reason IS NULL AND {w} IS NULL" for m, w in _WHY.items())}) GROUP BY ALL HAVING count(DISTINCT method) >= 2)"""


def _shared(spark: SparkSession, base: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(pairs, per metric the dataset and sample that at least `least` methods have valid)."""
    p = _pairs(spark, base)
    valid = None
    for name, m in P.METRICS.items():
        one = P.observed(p, m, _COLUMNS).where("why IS NULL").select(F.lit(name).alias("metric"), *KEYS, "method")
        valid = one if valid is None else valid.unionByName(one)
    return p, valid.groupBy("metric", *KEYS).agg(F.countDistinct("method").alias("k")).where(F.col("k") >= least).drop("k")


@query(f"""WITH {PAIRS}, c AS (SELECT metric, method, dataset, v FROM ({" UNION ALL ".join(f"SELECT '{m}' AS metric, method, dataset, {_VALUE[m]} AS v FROM p WHERE reason IS NULL AND {w} IS NULL GROUP BY ALL" for m, w in _WHY.items())})),
d AS (SELECT count(DISTINCT dataset) AS n FROM runs) SELECT metric, method, count(*) FILTER (WHERE v > 0) AS strata, CASE WHEN count(*) FILTER (WHERE v > 0) = any_value(n) THEN round(exp(avg(ln(v)) FILTER (WHERE v > 0)), 6) END AS value FROM c, d GROUP BY ALL""")
def complete_geomean(spark, base):
    p = _pairs(spark, base)
    datasets = sorted(r.dataset for r in runs(spark, base).select("dataset").distinct().limit(1000).collect())
    return P.complete_geomean(P.metric_report(p, ["dataset", "method"], _COLUMNS, digits=15), ["metric", "method"], "dataset", "value", datasets, 6)


@query(f"""WITH {PAIRS}, {_SHARED_IDS}, e AS (SELECT dataset, count(DISTINCT sample_id) AS expected FROM runs GROUP BY 1), h AS (SELECT dataset, method, count(DISTINCT sample_id) FILTER (WHERE status = 'success') AS success FROM runs WHERE method > 1 GROUP BY ALL),
q AS (SELECT dataset, method, count(*) FILTER (WHERE reason IS NULL AND {_WHY['decode_rate_ratio']} IS NULL) AS decode_pairs, count(*) FILTER (WHERE reason = 'prompt_mismatch') AS bad FROM p GROUP BY ALL),
c AS (SELECT * FROM h JOIN e USING (dataset) JOIN q USING (dataset, method)), m AS (SELECT metric, dataset, count(*) AS n FROM s GROUP BY ALL),
g AS (SELECT bool_and(decode_pairs > 0) AS a, bool_and(bad = 0) AS b, count(*) = (SELECT count(DISTINCT dataset) FROM runs) * {METHODS - 1} AND bool_and(success / expected >= 0.05) AS d, (SELECT min(n) FROM m) >= 0.9 * 10 AS f FROM c)
SELECT CASE WHEN a AND b AND d AND f THEN 'qualified' ELSE 'not_qualified' END AS status, a AS strict_decode_all_cells, b AS prompt_token_counts_match, d AS success_coverage, f AS shared_coverage,
array_to_string(list_filter([CASE WHEN NOT a THEN 'decode coverage is incomplete' END, CASE WHEN NOT b THEN 'prompt token counts differ' END, CASE WHEN NOT d THEN 'success coverage is too low' END, CASE WHEN NOT f THEN 'shared coverage is too low' END], lambda x: x IS NOT NULL), '; ') AS reason FROM g""")
def paper_gate(spark, base):
    d = runs(spark, base)
    p, shared = _shared(spark, base)
    datasets = d.select("dataset").distinct().count()
    expected = d.groupBy("dataset").agg(F.countDistinct("sample_id").alias("expected"))
    have = d.where("method > 1").groupBy("dataset", "method").agg(F.countDistinct(F.when(F.col("status") == "success", F.col("sample_id"))).alias("success"))
    decode = P.observed(p, P.METRICS["decode_rate_ratio"], _COLUMNS).where("why IS NULL").groupBy("dataset", "method").agg(F.count("*").alias("decode_pairs"))
    off = p.groupBy("dataset", "method").agg(F.count_if(F.col("reason") == "prompt_mismatch").alias("count_mismatches"))
    cells = have.join(expected, "dataset").join(off, ["dataset", "method"]).join(decode, ["dataset", "method"], "left").fillna(0, ["decode_pairs"])
    return P.gate(cells, shared.groupBy("metric", "dataset").agg(F.count("*").alias("n")), datasets * (METHODS - 1), 10, least_coverage=0.05)


def _rate_columns(spark: SparkSession, base: str) -> DataFrame:
    good = P.observed(pairs(spark, base), P.METRICS["output_rate_ratio"], _COLUMNS).where("why IS NULL")
    return good.select("method", *KEYS, "rn", "mn", "rt", "mt")


@query(f"WITH {PAIRS} SELECT dataset, method, count(*) AS n, round({_VALUE['output_rate_ratio']}, 6) AS value FROM p WHERE reason IS NULL AND {_WHY['output_rate_ratio']} IS NULL GROUP BY ALL")
def bootstrap_ratios(spark, base):
    """What the intervals are around: the exact bootstrap's own count and value."""
    return P.interval(_rate_columns(spark, base), ["dataset", "method"], ["rn", "mn", "rt", "mt"], "sample_id", resamples=10).select("dataset", "method", "n", F.round("value", 6).alias("value"))


@query()
def exact_bootstrap_ci(spark, base):
    good = P.observed(pairs(spark, base), P.METRICS["esr"], _COLUMNS).where("why IS NULL").select("method", *KEYS, "rt", "mt")
    return P.interval(good, ["dataset", "method"], ["rt", "mt"], "sample_id").select("dataset", "method", "n", *[F.round(c, 8).alias(c) for c in ("value", "low", "high")])


@query()
def rate_ratio_ci(spark, base):
    return P.interval(_rate_columns(spark, base), ["dataset", "method"], ["rn", "mn", "rt", "mt"], "sample_id", seed=20260931).select("dataset", "method", "n", *[F.round(c, 8).alias(c) for c in ("value", "low", "high")])


@query()
def stratified_ci(spark, base):
    good = P.observed(pairs(spark, base), P.METRICS["esr"], _COLUMNS).where("why IS NULL").select("method", *KEYS, "rt", "mt")
    datasets = sorted(r.dataset for r in runs(spark, base).select("dataset").distinct().limit(1000).collect())
    return P.stratified_interval(good, ["method"], "dataset", ["rt", "mt"], "sample_id", datasets, resamples=2000).select("method", *[F.round(c, 8).alias(c) for c in ("value", "low", "high")])


@query(f"""WITH {OBS}, x AS (SELECT sample_id, method, part, CASE WHEN part % 7 = 0 THEN NULL ELSE CAST(supplier AS DOUBLE) + 0.5 * (part % 2) END AS a, CASE WHEN part % 7 = 0 THEN NULL ELSE CAST(supplier + part % 3 * 10 AS DOUBLE) END AS p, CASE WHEN part % 5 = 0 THEN NULL ELSE CAST(output_tokens AS DOUBLE) END AS s, decode_ms / e2e_ms AS fr, 1 + decode_ms / e2e_ms AS fm FROM obs),
y AS (SELECT sample_id, method, part, a, p, s, CASE WHEN a = floor(a) THEN a END AS ai, CASE WHEN p = floor(p) THEN p END AS pi, CASE WHEN s = floor(s) THEN s END AS si, fr, fm FROM x),
z AS (SELECT *, CASE WHEN pi > 0 AND ai <= pi THEN ai / pi WHEN a IS NULL AND p IS NULL AND fr BETWEEN 0 AND 1 THEN fr END AS rate FROM y)
SELECT method, count(*) AS n, count(rate) AS with_rate, round(avg(round(rate, 6)), 4) AS acceptance_rate, round(avg(round(rate * 100, 4)), 4) AS acceptance_rate_percent, round(avg(round(coalesce(1 + ai / CASE WHEN si > 0 THEN si END, CASE WHEN fm >= 1 THEN fm END), 4)), 4) AS avg_accept_length FROM z GROUP BY method""")
def acceptance_rates(spark, base):
    o, part = observations(spark, base), F.col("part")
    a = F.when(part % 7 != 0, F.col("supplier").cast("double") + 0.5 * (part % 2))
    p = F.when(part % 7 != 0, (F.col("supplier") + part % 3 * 10).cast("double"))
    s = F.when(part % 5 != 0, F.col("output_tokens").cast("double"))
    share = F.col("decode_ms") / F.col("e2e_ms")
    made = o.select("method", O.acceptance(a, p, s, share, 1 + share).alias("x"))
    return made.groupBy("method").agg(F.count("*").alias("n"), F.count("x.acceptance_rate").alias("with_rate"), *[F.round(F.avg(f"x.{c}"), 4).alias(c) for c in ("acceptance_rate", "acceptance_rate_percent", "avg_accept_length")])


@query(f"""WITH {OBS}, c AS (SELECT dataset, sample_id, count(DISTINCT method) AS k FROM obs WHERE method <= 2 AND status = 'success' AND decode_ms > 0 AND e2e_ms > decode_ms GROUP BY ALL HAVING count(DISTINCT method) = 2),
u AS (SELECT method, dataset, sample_id, min(e2e_ms - decode_ms) AS p, min(decode_ms / output_tokens) AS i, min(output_tokens) AS t FROM obs JOIN c USING (dataset, sample_id) WHERE method <= 2 AND status = 'success' AND decode_ms > 0 AND e2e_ms > decode_ms GROUP BY ALL),
j AS (SELECT u.method, count(*) AS samples, avg(r.p) AS p, avg(r.i) AS a, avg(u.i) AS b, avg(least(u.t, r.t)) AS n FROM u JOIN u r USING (dataset, sample_id) WHERE r.method = 1 GROUP BY u.method)
SELECT CAST(method AS VARCHAR) AS method, samples, round(n, 4) AS mean_min_tokens, round(a / b, 4) AS dsr, round((p + a * n) / (p + b * n), 4) AS esr FROM j""")
def coextensive_speed(spark, base):
    o = observations(spark, base).where("method <= 2 AND status = 'success' AND decode_ms > 0 AND e2e_ms > decode_ms")
    both = o.groupBy(*KEYS).agg(F.countDistinct("method").alias("k")).where("k = 2").drop("k")
    u = o.join(both, KEYS).groupBy("method", *KEYS).agg(F.min(F.col("e2e_ms") - F.col("decode_ms")).alias("prefill_ms"), F.min(F.col("decode_ms") / F.col("output_tokens")).alias("mean_itl_ms"), F.min("output_tokens").alias("output_tokens"))
    u = u.select(F.col("method").cast("string").alias("method"), F.concat_ws("/", *KEYS).alias("sample"), F.lit("success").alias("status"), "prefill_ms", "mean_itl_ms", "output_tokens")
    return C.paired_speed(C.coextensive(u, "method", "sample", "1", ["prefill_ms", "mean_itl_ms", "output_tokens"]), "method")


@query(f"""WITH {OBS}, g AS (SELECT *, CAST(output_tokens AS INT) % 5 AS input_tokens FROM obs WHERE status = 'success'), r AS (SELECT dataset, sample_id, arg_max(input_tokens, e2e_ms) AS ri, max(e2e_ms) AS re FROM g WHERE method = 1 GROUP BY ALL),
s AS (SELECT g.method, CASE WHEN re IS NULL THEN 'unpaired' WHEN ri <> input_tokens THEN 'mismatched' ELSE 'paired' END AS s FROM g LEFT JOIN r USING (dataset, sample_id) WHERE method > 1)
SELECT method, count(*) FILTER (WHERE s = 'paired') AS paired, count(*) FILTER (WHERE s = 'unpaired') AS unpaired, count(*) FILTER (WHERE s = 'mismatched') AS mismatched, CAST(0 AS BIGINT) AS invalid_timing FROM s GROUP BY method""")
def guarded_counters(spark, base):
    o = observations(spark, base).withColumn("input_tokens", F.col("output_tokens").cast("int") % 5)
    return C.guarded(o, KEYS, "method", 1)[1]


@query(f"""WITH {OBS}, t AS (SELECT dataset, sample_id, method, min(part % 3) AS a FROM obs WHERE status = 'success' GROUP BY ALL), j AS (SELECT t.method, t.a = r.a AS same FROM t JOIN t r ON t.dataset = r.dataset AND t.sample_id = r.sample_id AND r.method = 1)
SELECT method, count(*) AS compared, count(*) FILTER (WHERE same) AS exact_matches, round(count(*) FILTER (WHERE same) / count(*), 6) AS exact_match_rate, round((count(*) + count(*) FILTER (WHERE same)) / (2.0::DOUBLE * count(*)), 6) AS token_lcs_overlap, round((count(*) + count(*) FILTER (WHERE same)) / (2.0::DOUBLE * count(*)), 6) AS pooled_lcs_overlap FROM j GROUP BY method""")
def greedy_parity(spark, base):
    t = observations(spark, base).where("status = 'success'").groupBy(*KEYS, "method").agg(F.min(F.col("part") % 3).alias("a"))
    t = t.select(*KEYS, F.lit(0).alias("repeat_index"), "method", F.lit("success").alias("status"), F.array(F.lit(9).cast("long"), F.col("a")).alias("output_token_ids"))
    return C.parity(C.annotated(t, [*KEYS, "repeat_index"], "method", 1).where(F.col("greedy_token_match").isNotNull()), ["method"])


@query(f"""WITH {OBS}, k AS (SELECT dataset, method, run, count(*) AS n, count(*) FILTER (WHERE status = 'success') AS ok, sum(output_tokens) AS tokens, count(DISTINCT part) AS parts, avg(e2e_ms / output_tokens) AS per FROM obs GROUP BY ALL)
SELECT dataset, method, run, n, round(ok / n, 4) AS success_rate, CAST(tokens AS BIGINT) AS tokens, parts, round(1000 / per, 4) AS tokens_per_s FROM k""")
def method_summary(spark, base):
    g = observations(spark, base).groupBy("dataset", "method", "run").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("ok"), F.sum("output_tokens").alias("tokens"), F.countDistinct("part").alias("parts"), F.avg(F.col("e2e_ms") / F.col("output_tokens")).alias("per"))
    return g.select("dataset", "method", "run", "n", F.round(F.col("ok") / F.col("n"), 4).alias("success_rate"), "tokens", "parts", F.round(S.ratio(F.lit(1000.0), F.col("per")), 4).alias("tokens_per_s"))


@query("""WITH c AS (SELECT id, count(*) AS n FROM corpus_records GROUP BY id), x AS (SELECT r.*, n, CASE WHEN coalesce(document_words, 0) BETWEEN 20 AND 5000 THEN 0 ELSE 1 END AS off FROM corpus_records r JOIN c USING (id))
SELECT problem, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n > 1 THEN 'duplicate_id' END, CASE WHEN off = 1 THEN 'out_of_bounds' END, CASE WHEN category IS NULL THEN 'missing_bin' END, CASE WHEN reference_words >= coalesce(document_words, 0) THEN 'reference_not_shorter' END], lambda p: p IS NOT NULL)) AS problem FROM x)
GROUP BY problem UNION ALL SELECT 'wrong_count', 1 FROM (SELECT count(*) AS n FROM corpus_records) WHERE n <> 400""")
def evaluation_set_problems(spark, base):
    r = table(spark, base, "corpus_records").select("id", "document_words", "reference_words", F.lit("x").alias("document"), F.lit("x").alias("reference"), F.array(F.lit("x")).alias("answers"), F.col("category").alias("length_bin"))
    return C.evaluation_set(r, 20, 5000, 400).groupBy("problem").agg(F.count("*").alias("n"))


_SPEC = ", ".join(f"round(avg({c}), 4) AS {c}_mean, round(quantile_cont({c}, 0.5), 4) AS {c}_median, round(quantile_disc({c}, 0.9), 4) AS {c}_p90, round(stddev_pop({c}), 4) AS {c}_std" for c in ("draft_tokens_accepted", "acceptance_rate"))


@query(f"WITH {OBS}, x AS (SELECT method, CAST(supplier AS DOUBLE) AS draft_tokens_accepted, round(CAST(supplier AS DOUBLE) / (supplier + part % 3 * 10), 6) AS acceptance_rate FROM obs WHERE status = 'success' AND supplier > 0) SELECT method, {_SPEC} FROM x GROUP BY method")
def speculative_stats(spark, base):
    o = observations(spark, base).where("status = 'success' AND supplier > 0")
    made = o.select("method", O.acceptance(F.col("supplier"), F.col("supplier") + F.col("part") % 3 * 10, F.lit(1)).alias("x")).select("method", "x.draft_tokens_accepted", "x.acceptance_rate")
    return O.statistics(made, ["method"], ["draft_tokens_accepted", "acceptance_rate"])


@query(f"""WITH {OBS}, x AS (SELECT method, output_tokens, e2e_ms, part % 4 AS k, supplier % 5 AS v FROM obs) SELECT method, count(*) AS samples, CAST(sum(output_tokens) AS BIGINT) AS tokens, round(sum(output_tokens) * 1000.0 / sum(e2e_ms), 4) AS tokens_per_s,
round(1000.0 / avg(e2e_ms / output_tokens), 4) AS mean_rate, CAST(sum(k) AS BIGINT) AS steps, round(CAST(sum(k * v) AS DOUBLE) / sum(k), 4) AS mean_accept_length FROM x GROUP BY method""")
def generation_summary(spark, base):
    o = observations(spark, base).withColumn("accept_lengths", F.array_repeat((F.col("supplier") % 5).cast("int"), (F.col("part") % 4).cast("int")))
    return O.generation_summary(o, ["method"])


@query(f"""WITH {OBS}, p AS (SELECT method, dataset, sample_id, count(*) AS n, min(part % 2) = max(part % 2) AS same, max(e2e_ms) / min(e2e_ms) AS spread FROM obs WHERE status = 'success' GROUP BY ALL)
SELECT method, count(*) AS samples, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE n > 1 AND same) AS stable, round(count(*) FILTER (WHERE n > 1 AND same) / CASE WHEN count(*) FILTER (WHERE n > 1) > 0 THEN count(*) FILTER (WHERE n > 1) END, 4) AS stable_rate, round(max(spread) FILTER (WHERE n > 1), 4) AS worst_spread FROM p GROUP BY method""")
def repeat_stability(spark, base):
    o = observations(spark, base).withColumn("output", F.col("part") % 2)
    return O.stability(o, KEYS, ["method"], "output", "e2e_ms")
