"""Queries of the benchmark layer: pairs, ratios, groups, completeness, audits. Method 1 is the reference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.operators import pairing as J
from corpusloom.operators import ranking as R
from corpusloom.operators import validation as V
from corpusloom.plans.registry import registrar
from corpusloom.plans.relations import METHODS, OBS, observations
from corpusloom.session import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
query = registrar(QUERIES, ORACLE)

_STATS = "round(avg({x}), 4) AS {x}_mean, round(quantile_cont({x}, 0.5), 4) AS {x}_median, round(quantile_disc({x}, 0.9), 4) AS {x}_p90, round(stddev_pop({x}), 4) AS {x}_std"


@query(f"WITH {OBS} SELECT method, dataset, {_STATS.format(x='e2e_ms')}, {_STATS.format(x='decode_ms')} FROM obs WHERE status = 'success' GROUP BY ALL")
def speed_stats(spark, base):
    return S.summary(observations(spark, base).where("status = 'success'"), ["method", "dataset"], ["e2e_ms", "decode_ms"])


@query(f"""WITH {OBS}, x AS (SELECT *, CASE WHEN output_tokens <= 10 THEN 'short' WHEN output_tokens <= 30 THEN 'middle' ELSE 'long' END AS bin FROM obs WHERE status = 'success')
SELECT method, dataset, bin, count(*) AS n, round(avg(e2e_ms), 4) AS mean_ms, sum(output_tokens) AS tokens FROM x GROUP BY GROUPING SETS ((method), (method, dataset), (method, bin))""")
def speed_grouping_sets(spark, base):
    t = F.col("output_tokens")
    x = observations(spark, base).where("status = 'success'").withColumn("bin", F.when(t <= 10, "short").when(t <= 30, "middle").otherwise("long"))
    sets = [["method"], ["method", "dataset"], ["method", "bin"]]
    g = x.groupingSets([[F.col(c) for c in s] for s in sets], "method", "dataset", "bin")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("e2e_ms"), 4).alias("mean_ms"), F.sum("output_tokens").alias("tokens"))


@query(f"WITH {OBS} SELECT coalesce(dataset, 'all') AS dataset, method, count(*) AS n, round(sum(output_tokens) / sum(e2e_ms) * 1000, 4) AS tokens_per_s FROM obs WHERE status = 'success' GROUP BY ROLLUP (method, dataset) HAVING method IS NOT NULL")
def datasets_and_all(spark, base):
    g = observations(spark, base).where("status = 'success'").rollup("method", "dataset")
    made = g.agg(F.count("*").alias("n"), F.round(F.sum("output_tokens") / F.sum("e2e_ms") * 1000, 4).alias("tokens_per_s")).where("method IS NOT NULL")
    return made.withColumn("dataset", F.coalesce("dataset", F.lit("all")))


def _pairs(spark, base) -> DataFrame:
    o = observations(spark, base).select("dataset", "sample_id", "method", "status", "e2e_ms", "decode_ms", "output_tokens")
    return J.paired(o.where("method = 1"), o.where("method > 1"), ["dataset", "sample_id"])


_PAIRED = f"""{OBS}, c AS (SELECT dataset, sample_id, method, count(*) AS n, any_value(status) AS status, any_value(e2e_ms) AS e2e, any_value(decode_ms) AS dec, any_value(output_tokens) AS tok FROM obs GROUP BY ALL),
m AS (SELECT DISTINCT method FROM c WHERE method > 1), r AS (SELECT c.*, m.method AS met FROM c, m WHERE c.method = 1), k AS (SELECT * FROM c WHERE method > 1),
j AS (SELECT coalesce(r.met, k.method) AS method, coalesce(r.dataset, k.dataset) AS dataset, coalesce(r.sample_id, k.sample_id) AS sample_id, r.n AS nr, k.n AS nm, r.status AS sr, k.status AS sm, r.e2e AS re, k.e2e AS me, r.dec AS rd, k.dec AS md, r.tok AS rt, k.tok AS mt
  FROM r FULL JOIN k ON r.met = k.method AND r.dataset = k.dataset AND r.sample_id = k.sample_id),
p AS (SELECT *, CASE WHEN coalesce(nr, 0) > 1 OR coalesce(nm, 0) > 1 THEN 'duplicate_sample_id' WHEN nr IS NULL THEN 'missing_reference' WHEN nm IS NULL THEN 'missing_method' WHEN sr <> 'success' OR sm <> 'success' THEN 'failed_status' END AS reason,
  CASE WHEN coalesce(nr, 0) > 1 OR coalesce(nm, 0) > 1 THEN CASE WHEN nr > 1 THEN nr ELSE 0 END + CASE WHEN nm > 1 THEN nm ELSE 0 END ELSE 1 END AS lost FROM j)"""


@query(f"WITH {_PAIRED} SELECT method, reason, CAST(sum(lost) AS BIGINT) AS n FROM p WHERE reason IS NOT NULL GROUP BY ALL")
def paired_reasons(spark, base):
    return J.exclusions(_pairs(spark, base), ["method"])


@query(f"""WITH {_PAIRED} SELECT dataset, method, count(*) AS pairs, round(sum(re) / sum(me), 4) AS time_ratio, round((sum(mt) / sum(me)) / (sum(rt) / sum(re)), 4) AS rate_ratio FROM p WHERE reason IS NULL AND re > 0 AND me > 0 GROUP BY ALL""")
def paired_ratio_of_sums(spark, base):
    return J.ratios(_pairs(spark, base), ["dataset", "method"])


@query(f"""WITH {_PAIRED}, x AS (SELECT method, CASE WHEN rd IS NULL OR md IS NULL THEN 'missing_decode_evidence' WHEN rt = 0 OR mt = 0 THEN 'zero_decode_tokens' WHEN rd <= 0 OR md <= 0 THEN 'nonpositive_time' END AS why, rd, md FROM p WHERE reason IS NULL)
SELECT method, coalesce(why, 'paired') AS why, count(*) AS n, round(sum(rd) / sum(md), 4) AS decode_ratio FROM x GROUP BY ALL""")
def decode_metric_reasons(spark, base):
    p = _pairs(spark, base).where("reason IS NULL")
    a, b = F.col("ref.decode_ms"), F.col("met.decode_ms")
    why = J.metric_reason(a, b, decode=True, a_n=F.col("ref.output_tokens"), b_n=F.col("met.output_tokens"))
    return p.groupBy("method", F.coalesce(why, F.lit("paired")).alias("why")).agg(F.count("*").alias("n"), F.round(S.ratio_of_sums(a, b), 4).alias("decode_ratio"))


@query(f"""WITH {OBS}, x AS (SELECT * FROM obs WHERE status = 'success'), b AS (SELECT dataset, avg(e2e_ms) AS e, avg(decode_ms) AS d FROM x WHERE method = 1 GROUP BY dataset)
SELECT x.dataset, method, round(any_value(e) / avg(e2e_ms), 4) AS e2e_speedup, round(any_value(d) / avg(decode_ms), 4) AS decode_speedup FROM x JOIN b USING (dataset) GROUP BY ALL""")
def legacy_speedup(spark, base):
    g = observations(spark, base).where("status = 'success'").groupBy("dataset", "method").agg(F.avg("e2e_ms").alias("e"), F.avg("decode_ms").alias("d"))
    ref = g.where("method = 1").select("dataset", F.col("e").alias("re"), F.col("d").alias("rd"))
    return g.join(ref, "dataset").select("dataset", "method", F.round(S.ratio(F.col("re"), F.col("e")), 4).alias("e2e_speedup"), F.round(S.ratio(F.col("rd"), F.col("d")), 4).alias("decode_speedup"))


_ONCE = f"""{OBS}, u AS (SELECT dataset, sample_id, method, any_value(e2e_ms) AS e, any_value(decode_ms) AS d, any_value(output_tokens) AS t FROM obs WHERE status = 'success' GROUP BY ALL HAVING count(*) = 1),
q AS (SELECT m.dataset, m.method, r.e - r.d AS prefill, r.d / r.t AS rp, m.d / m.t AS mp, least(r.t, m.t) AS t FROM u r JOIN u m USING (dataset, sample_id) WHERE r.method = 1 AND m.method > 1 AND r.d > 0 AND m.d > 0)"""


@query(f"""WITH {_ONCE}, g AS (SELECT dataset, method, count(*) AS pairs, avg(prefill) AS p, avg(rp) AS a, avg(mp) AS b, avg(t) AS n FROM q GROUP BY ALL)
SELECT dataset, method, pairs, round(n, 4) AS mean_min_tokens, round(a / b, 4) AS dsr, round((p + n * a) / (p + n * b), 4) AS esr FROM g""")
def user_speedup(spark, base):
    o = observations(spark, base).where("status = 'success'").select("dataset", "sample_id", "method", "e2e_ms", "decode_ms", "output_tokens")
    once = R.unique_only(o, ["dataset", "sample_id", "method"])
    ref = once.where("method = 1").select("dataset", "sample_id", *[F.col(c).alias(f"r_{c}") for c in ("e2e_ms", "decode_ms", "output_tokens")])
    p = once.where("method > 1").join(ref, ["dataset", "sample_id"]).where("decode_ms > 0 AND r_decode_ms > 0")
    g = p.groupBy("dataset", "method").agg(
        F.count("*").alias("pairs"),
        F.avg(F.col("r_e2e_ms") - F.col("r_decode_ms")).alias("p"),
        F.avg(F.col("r_decode_ms") / F.col("r_output_tokens")).alias("a"),
        F.avg(F.col("decode_ms") / F.col("output_tokens")).alias("b"),
        F.avg(F.least("output_tokens", "r_output_tokens")).alias("n"),
    )
    p_, a, b, n = (F.col(c) for c in "pabn")
    return g.select("dataset", "method", "pairs", F.round(n, 4).alias("mean_min_tokens"), F.round(a / b, 4).alias("dsr"), F.round((p_ + n * a) / (p_ + n * b), 4).alias("esr"))


@query(f"""WITH {_PAIRED}, v AS (SELECT * FROM p WHERE reason IS NULL), s AS (SELECT dataset, sample_id FROM v GROUP BY ALL HAVING count(DISTINCT method) = {METHODS - 1}),
d AS (SELECT method, dataset, sum(re) / sum(me) AS x, count(*) AS n FROM v SEMI JOIN s USING (dataset, sample_id) GROUP BY ALL)
SELECT method, count(*) AS datasets, CAST(sum(n) AS BIGINT) AS samples, round(exp(avg(ln(x))), 4) AS geomean FROM d GROUP BY method""")
def shared_set_geomean(spark, base):
    v = cut(_pairs(spark, base).where("reason IS NULL").select("method", "dataset", "sample_id", F.struct("ref.e2e_ms").alias("ref"), F.struct("met.e2e_ms").alias("met")))
    kept = v.join(J.shared(v, ["dataset"], "sample_id", "method", METHODS - 1), ["dataset", "sample_id"], "left_semi")
    d = kept.groupBy("method", "dataset").agg(S.ratio_of_sums(F.col("ref.e2e_ms"), F.col("met.e2e_ms")).alias("x"), F.count("*").alias("n"))
    return d.groupBy("method").agg(F.count("*").alias("datasets"), F.sum("n").alias("samples"), F.round(S.geomean(F.col("x")), 4).alias("geomean"))


@query(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, sample_id, method, run ORDER BY ended DESC, e2e_ms DESC, part DESC, supplier DESC) AS nth FROM obs) SELECT dataset, sample_id, method, run, status, e2e_ms FROM r WHERE nth = 1""")
def dedup_last_wins(spark, base):
    o = observations(spark, base)
    return R.keep_last(o, ["dataset", "sample_id", "method", "run"], ["ended", "e2e_ms", "part", "supplier"]).select("dataset", "sample_id", "method", "run", "status", "e2e_ms")


@query(f"""WITH {OBS}, e AS (SELECT DISTINCT dataset, sample_id, method FROM obs), l AS (SELECT *, row_number() OVER (PARTITION BY dataset, sample_id, method ORDER BY ended DESC, e2e_ms DESC, part DESC) AS nth FROM obs)
SELECT e.* FROM e ANTI JOIN (SELECT * FROM l WHERE nth = 1 AND status = 'success') USING (dataset, sample_id, method)""")
def resume_anti_join(spark, base):
    o = observations(spark, base)
    keys = ["dataset", "sample_id", "method"]
    return J.unresolved(o.select(*keys).distinct(), o, keys, order=["ended", "e2e_ms", "part"])


@query(f"""WITH {OBS}, a AS (SELECT DISTINCT dataset, sample_id FROM obs WHERE method = 1), b AS (SELECT DISTINCT dataset, sample_id FROM obs WHERE method = 2)
SELECT *, 'left_only' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'right_only' FROM (FROM b EXCEPT FROM a)""")
def coverage_diff(spark, base):
    o = observations(spark, base)
    return J.coverage(o.where("method = 1"), o.where("method = 2"), ["dataset", "sample_id"])


@query(f"""WITH {OBS}, s AS (SELECT DISTINCT dataset, sample_id FROM obs), g AS (SELECT * FROM s, (SELECT unnest(range(1, {METHODS + 1}))::INT AS method)), b AS (SELECT *, row_number() OVER (PARTITION BY dataset, sample_id, method ORDER BY status <> 'success', ended, e2e_ms, part) AS nth FROM obs)
SELECT g.dataset, g.sample_id, g.method, coalesce(b.status, 'failed') AS status, b.e2e_ms, CASE WHEN b.status IS NULL THEN 'missing_output' END AS error FROM g LEFT JOIN b ON g.dataset = b.dataset AND g.sample_id = b.sample_id AND g.method = b.method AND nth = 1""")
def fill_missing(spark, base):
    o = observations(spark, base)
    keys = ["dataset", "sample_id", "method"]
    expected = o.select("dataset", "sample_id").distinct().withColumn("method", F.explode(F.array(*[F.lit(m) for m in range(1, METHODS + 1)])))
    rows = o.select(*keys, "status", "e2e_ms", "ended", "part", F.lit(True).alias("_there"))
    return J.filled(expected, rows, keys, [F.col("ended"), F.col("e2e_ms"), F.col("part")]).select(*keys, "status", "e2e_ms", "error")


@query(f"""WITH {OBS}, c AS (SELECT dataset, sample_id, method, run, sum(e2e_ms) AS e FROM obs WHERE status = 'success' GROUP BY ALL), a AS (SELECT * FROM c WHERE run = 'A'), b AS (SELECT * FROM c WHERE run = 'R')
SELECT coalesce(a.dataset, b.dataset) AS dataset, count(*) FILTER (WHERE a.e IS NOT NULL AND b.e IS NOT NULL) AS matched, count(*) FILTER (WHERE b.e IS NULL) AS left_only, count(*) FILTER (WHERE a.e IS NULL) AS right_only,
round(sum(a.e) FILTER (WHERE b.e IS NOT NULL) / sum(b.e) FILTER (WHERE a.e IS NOT NULL), 4) AS ratio, count(*) FILTER (WHERE b.e < a.e) AS faster FROM a FULL JOIN b ON a.dataset = b.dataset AND a.sample_id = b.sample_id AND a.method = b.method GROUP BY ALL""")
def cross_run_compare(spark, base):
    keys = ["dataset", "sample_id", "method"]
    c = observations(spark, base).where("status = 'success'").groupBy(*keys, "run").agg(F.sum("e2e_ms").alias("e"))
    a, b = c.where("run = 'A'").drop("run").withColumnRenamed("e", "a"), c.where("run = 'R'").drop("run").withColumnRenamed("e", "b")
    x, y = F.col("a"), F.col("b")
    both = x.isNotNull() & y.isNotNull()
    return a.join(b, keys, "full_outer").groupBy("dataset").agg(
        F.count_if(both).alias("matched"), F.count_if(y.isNull()).alias("left_only"), F.count_if(x.isNull()).alias("right_only"), F.round(S.ratio(F.sum(F.when(both, x)), F.sum(F.when(both, y))), 4).alias("ratio"), F.count_if(y < x).alias("faster")
    )


@query(f"""WITH {OBS}, g AS (SELECT DISTINCT dataset, unnest(range(1, {METHODS + 1}))::INT AS method FROM obs), e AS (SELECT dataset, count(DISTINCT sample_id) AS expected FROM obs GROUP BY dataset), h AS (SELECT dataset, method, count(DISTINCT sample_id) AS have FROM obs WHERE status = 'success' GROUP BY ALL)
SELECT g.dataset, g.method, expected, coalesce(have, 0) AS have, coalesce(have, 0) = expected AS complete FROM g JOIN e USING (dataset) LEFT JOIN h USING (dataset, method)""")
def completeness_matrix(spark, base):
    o = observations(spark, base)
    e = o.groupBy("dataset").agg(F.countDistinct("sample_id").alias("expected"))
    h = o.where("status = 'success'").groupBy("dataset", "method").agg(F.countDistinct("sample_id").alias("have"))
    methods = spark.range(1, METHODS + 1).select(F.col("id").cast("int").alias("method"))
    g = J.grid(e, methods).join(h, ["dataset", "method"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return g.select("dataset", "method", "expected", "have", (F.col("have") == F.col("expected")).alias("complete"))


def _issues(o: DataFrame) -> DataFrame:
    return o.withColumn("issues", V.problems(("failed_status", F.col("status") != "success"), ("missing_decode", F.col("decode_ms").isNull()), ("few_tokens", F.col("output_tokens") < 4), ("slow", F.col("e2e_ms") > 50000)))


_ISSUES = f"""{OBS}, i AS (SELECT *, list_filter([CASE WHEN status <> 'success' THEN 'failed_status' END, CASE WHEN decode_ms IS NULL THEN 'missing_decode' END, CASE WHEN output_tokens < 4 THEN 'few_tokens' END, CASE WHEN e2e_ms > 50000 THEN 'slow' END], lambda x: x IS NOT NULL) AS issues FROM obs)"""


@query(f"WITH {_ISSUES} SELECT method, issue, count(*) AS n, min(sample_id) AS first_id FROM (SELECT method, sample_id, unnest(issues) AS issue FROM i) GROUP BY ALL")
def audit_issue_counts(spark, base):
    i = _issues(observations(spark, base)).select("method", "sample_id", F.explode("issues").alias("issue"))
    return i.groupBy("method", "issue").agg(F.count("*").alias("n"), F.min("sample_id").alias("first_id"))


@query(f"WITH {_ISSUES} SELECT dataset, method, count(*) AS n, count(decode_ms) AS with_decode, round(count(decode_ms) / count(*), 4) AS decode_coverage, count(*) FILTER (WHERE len(issues) = 0) AS clean, count(*) - count(DISTINCT sample_id) AS repeated FROM i GROUP BY ALL")
def field_coverage(spark, base):
    i = _issues(observations(spark, base))
    return i.groupBy("dataset", "method").agg(
        F.count("*").alias("n"), F.count("decode_ms").alias("with_decode"), F.round(F.count("decode_ms") / F.count("*"), 4).alias("decode_coverage"), F.count_if(F.size("issues") == 0).alias("clean"), (F.count("*") - F.countDistinct("sample_id")).alias("repeated")
    )


@query(f"""WITH {OBS}, r AS (SELECT DISTINCT dataset, sample_id, method FROM ({"SELECT dataset, sample_id, method, row_number() OVER (PARTITION BY dataset, method ORDER BY sample_id) AS k FROM (SELECT DISTINCT dataset, sample_id, method FROM obs WHERE status <> 'success')"}) WHERE k <= 20)
SELECT dataset, method, count(*) AS shown, min(sample_id) AS first_id, max(sample_id) AS last_id FROM r GROUP BY ALL""")
def first_failed_ids(spark, base):
    f = observations(spark, base).where("status <> 'success'").select("dataset", "sample_id", "method").distinct()
    return R.top(f, ["dataset", "method"], [F.col("sample_id")], 20).groupBy("dataset", "method").agg(F.count("*").alias("shown"), F.min("sample_id").alias("first_id"), F.max("sample_id").alias("last_id"))


_WIDE = ", ".join(f"round(avg(e2e_ms) FILTER (WHERE method = {m}), 4) AS m{m}_mean, count(*) FILTER (WHERE method = {m}) AS m{m}_n" for m in range(1, METHODS + 1))


@query(f"WITH {OBS} SELECT dataset, {_WIDE} FROM obs WHERE status = 'success' GROUP BY dataset")
def metric_pivot(spark, base):
    o = observations(spark, base).where("status = 'success'").withColumn("m", F.concat(F.lit("m"), F.col("method").cast("string")))
    wide = o.groupBy("dataset").pivot("m", [f"m{i}" for i in range(1, METHODS + 1)]).agg(F.round(F.avg("e2e_ms"), 4).alias("mean"), F.count("method").alias("n"))
    return wide.fillna(0, [c for c in wide.columns if c.endswith("_n")])


@query(f"""WITH {OBS}, c AS (SELECT run, map_from_entries(list((status, n))) AS m FROM (SELECT run, status, count(*) AS n FROM obs GROUP BY ALL) GROUP BY run)
SELECT CAST(greatest(max(m['success']), 0) AS BIGINT) AS success, CAST(max(m['failed']) AS BIGINT) AS failed FROM c""")
def counter_maximum(spark, base):
    c = observations(spark, base).groupBy("run", "status").agg(F.count("*").alias("n"))
    m = c.groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("m"))
    merged = m.agg(F.reduce(F.collect_list("m"), F.create_map().cast("map<string,bigint>"), S.larger_counts).alias("m"))
    return merged.select(F.col("m")["success"].alias("success"), F.col("m")["failed"].alias("failed"))


@query(f"""WITH {OBS}, g AS (SELECT method, count(*) AS rows, count(DISTINCT sample_id) AS samples, bool_and(status = 'success') AS all_success, count(*) FILTER (WHERE output_tokens >= 4) AS good FROM obs GROUP BY method)
SELECT method, rows, samples, all_success, rows = samples AS complete, round(good / rows, 4) AS quality_rate FROM g""")
def run_gates(spark, base):
    g = observations(spark, base).groupBy("method").agg(F.count("*").alias("rows"), F.countDistinct("sample_id").alias("samples"), F.every(F.col("status") == "success").alias("all_success"), F.count_if(F.col("output_tokens") >= 4).alias("good"))
    return g.select("method", "rows", "samples", "all_success", (F.col("rows") == F.col("samples")).alias("complete"), F.round(F.col("good") / F.col("rows"), 4).alias("quality_rate"))


@query(f"""WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, method ORDER BY sample_id, ended, e2e_ms, part) AS nth FROM obs WHERE status = 'success')
SELECT dataset, method, count(*) AS n, CAST(sum(output_tokens) AS BIGINT) AS tokens, round(sum(output_tokens) / sum(e2e_ms) * 1000, 4) AS throughput, round(avg(decode_ms), 4) AS decode_mean FROM r WHERE nth <= 200 GROUP BY ALL""")
def capped_serving_summary(spark, base):
    o = observations(spark, base).where("status = 'success'")
    few = R.top(o, ["dataset", "method"], [F.col("sample_id"), F.col("ended"), F.col("e2e_ms"), F.col("part")], 200)
    return few.groupBy("dataset", "method").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("tokens"), F.round(F.sum("output_tokens") / F.sum("e2e_ms") * 1000, 4).alias("throughput"), F.round(F.avg("decode_ms"), 4).alias("decode_mean"))


@query(f"""WITH {OBS}, d AS (SELECT dataset, method, count(output_tokens) AS n, round(avg(e2e_ms - coalesce(decode_ms, 0)), 4) AS prefill_mean, round(avg(CASE WHEN output_tokens > 1 THEN decode_ms / (output_tokens - 1) END), 4) AS itl_mean,
round(avg(CASE WHEN e2e_ms > 0 THEN round(output_tokens / e2e_ms * 1000.0, 4) END), 4) AS throughput_mean FROM obs GROUP BY ALL) SELECT * FROM d""")
def request_timeline(spark, base):
    o = observations(spark, base)
    prefill = F.greatest(F.lit(0.0), F.col("e2e_ms") - F.coalesce("decode_ms", F.lit(0)))
    return o.groupBy("dataset", "method").agg(
        F.count("output_tokens").alias("n"), F.round(F.avg(prefill), 4).alias("prefill_mean"), F.round(F.avg(S.mean_itl(F.lit(0.0), F.col("decode_ms"), F.col("output_tokens"))), 4).alias("itl_mean"), F.round(F.avg(S.throughput(F.col("output_tokens"), F.col("e2e_ms"))), 4).alias("throughput_mean")
    )


@query(f"""WITH {OBS}, u AS (SELECT sample_id, method, min(part % 5) AS out FROM obs WHERE status = 'success' GROUP BY ALL), p AS (SELECT m.method, m.out = r.out AS same FROM u m LEFT JOIN u r ON r.sample_id = m.sample_id AND r.method = 1 WHERE m.method > 1)
SELECT method, count(same) AS observed, count(*) FILTER (WHERE same) AS exact, count(*) - count(same) AS unknown, round(count(*) FILTER (WHERE same) / count(same), 4) AS rate FROM p GROUP BY method""")
def fidelity(spark, base):
    u = observations(spark, base).where("status = 'success'").groupBy("sample_id", "method").agg(F.min(F.col("part") % 5).alias("out"))
    r = u.where("method = 1").select("sample_id", F.col("out").alias("want"))
    p = u.where("method > 1").join(r, "sample_id", "left").withColumn("same", F.col("out") == F.col("want"))
    return p.groupBy("method").agg(F.count("same").alias("observed"), F.count_if("same").alias("exact"), (F.count("*") - F.count("same")).alias("unknown"), F.round(S.ratio(F.count_if("same"), F.count("same")), 4).alias("rate"))


@query(f"""WITH {OBS}, n AS (SELECT dataset, method, count(*) AS n FROM obs WHERE status = 'success' GROUP BY ALL) SELECT method, count(*) AS groups, min(n) AS least, max(n) AS most, min(n) = max(n) AS equal FROM n GROUP BY method""")
def equal_group_sizes(spark, base):
    n = observations(spark, base).where("status = 'success'").groupBy("dataset", "method").agg(F.count("*").alias("n"))
    return n.groupBy("method").agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.max("n").alias("most"), (F.min("n") == F.max("n")).alias("equal"))


@query(f"""WITH {OBS}, a AS (SELECT method, dataset, date_trunc('month', ended) AS month, avg(e2e_ms) AS e FROM obs WHERE status = 'success' GROUP BY ALL), s AS (SELECT method, dataset, arg_min(e, month) AS first, arg_max(e, month) AS last FROM a GROUP BY ALL)
SELECT method, dataset, round(abs(last - first) / first * 100, 4) AS drift_percent FROM s""")
def anchor_drift(spark, base):
    a = observations(spark, base).where("status = 'success'").groupBy("method", "dataset", F.date_trunc("month", "ended").alias("month")).agg(F.avg("e2e_ms").alias("e"))
    s = a.groupBy("method", "dataset").agg(F.min_by("e", "month").alias("first"), F.max_by("e", "month").alias("last"))
    return s.select("method", "dataset", F.round(F.abs(F.col("last") - F.col("first")) / F.col("first") * 100, 4).alias("drift_percent"))


@query()
def bootstrap_ci(spark, base):
    p = _pairs(spark, base).where("reason IS NULL").select("dataset", "method", "sample_id", F.col("ref.e2e_ms").alias("a"), F.col("met.e2e_ms").alias("b"))
    return J.spread_bootstrap(p, ["dataset", "method"], "a", "b", "sample_id", resamples=1000).select("dataset", "method", "n", *[F.round(c, 6).alias(c) for c in ("ratio", "low", "high")])
