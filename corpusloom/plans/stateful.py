"""Queries on events, folded answers, conversations and normalised records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import events as E
from corpusloom.operators import observations as O
from corpusloom.operators import ranking as R
from corpusloom.plans.registry import registrar
from corpusloom.plans.relations import OBS, observations
from corpusloom.session import table
from corpusloom.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
query = registrar(QUERIES, ORACLE)


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_windows(spark, base):
    return jobs.tumbling(table(spark, base, "events"), ["event_type"], "value")


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark, base):
    return jobs.sessions(table(spark, base, "events"), ["user_id"])


@query("""WITH s AS (SELECT user_id, sha256('42' || chr(0) || event_type || chr(0) || CAST(event_id AS VARCHAR)) AS score, event_type, event_id FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score, event_id) AS nth FROM s)
SELECT event_type, event_id, score FROM r WHERE nth <= 25""")
def event_reservoir(spark, base):
    return jobs.bottom_k(table(spark, base, "events").select("event_type", "event_id"), ["event_type"], "event_id", 42, 25)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, CAST(k // 16 AS BIGINT) AS number, count(*) AS held, min(event_id) AS first_id, max(event_id) AS last_id FROM r WHERE k < n // 16 * 16 GROUP BY ALL""")
def complete_windows(spark, base):
    r = R.numbered(table(spark, base, "events").select("user_id", "ts", "event_id"), ["user_id"], [F.col("ts"), F.col("event_id")])
    k = F.col("rank") - 1
    full = r.where(k < F.floor(F.col("total") / 16) * 16)
    return full.groupBy("user_id", F.floor(k / 16).alias("number")).agg(F.count("*").alias("held"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, list(event_id % 97 ORDER BY event_id) AS p, count(*) FILTER (WHERE event_type = 'purchase') > 0 AS complete FROM events GROUP BY ALL)
SELECT user_id, day, CASE WHEN len(list_distinct(p)) = 1 THEN 'cumulative' ELSE 'delta' END AS mode, CASE WHEN len(list_distinct(p)) = 1 THEN CAST(p[1] AS VARCHAR) ELSE array_to_string(p, ',') END AS output_ids, complete FROM e""")
def folded_answers(spark, base):
    e = table(spark, base, "events").withColumn("day", F.to_date("ts")).withColumn("i", F.array(F.col("event_id") % 97))
    e = e.withColumn("f", F.when(F.col("event_type") == "purchase", F.lit("stop")))
    out = E.folded(e, ["user_id", "day"], "event_id", "i", "event_type", "f", "ts")
    return out.select("user_id", "day", "mode", F.array_join("output_ids", ",").alias("output_ids"), "complete")


@query("""WITH t AS (SELECT user_id AS conv, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, CASE WHEN event_type IN ('click', 'view') THEN 'user' ELSE 'assistant' END AS role, CAST(event_id AS VARCHAR) AS said FROM events)
SELECT conv, turn, said, CAST(turn - 1 AS INT) AS before FROM t WHERE role = 'assistant'""")
def assistant_turns(spark, base):
    r = R.numbered(table(spark, base, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], [F.col("ts"), F.col("event_id")], "turn", "total")
    role = F.when(F.col("event_type").isin("click", "view"), "user").otherwise("assistant")
    t = r.select(F.col("user_id").alias("conv"), "turn", role.alias("role"), F.col("event_id").cast("string").alias("said"))
    return E.turns(t, "conv", "turn", "role", "said").select("conv", F.col("turn").cast("long").alias("turn"), "said", (F.col("turn") - 1).cast("int").alias("before"))


@query(f"""WITH {OBS} SELECT count(*) AS rows, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE s = 'error') AS error, count(*) FILTER (WHERE s = 'skipped') AS skipped, count(*) = count(*) FILTER (WHERE s IN ('success', 'error', 'skipped')) AS balanced
FROM (SELECT *, CASE WHEN status = 'success' THEN 'success' WHEN decode_ms IS NULL THEN 'skipped' ELSE 'error' END AS s FROM obs)""")
def outcome_accounting(spark, base):
    s = F.when(F.col("status") == "success", "success").when(F.col("decode_ms").isNull(), "skipped").otherwise("error")
    return E.accounting(observations(spark, base).withColumn("status", s))


@query(f"""WITH {OBS} SELECT method, measure, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT method, 'e2e_ms' AS measure, e2e_ms AS value FROM obs UNION ALL SELECT method, 'decode_ms', decode_ms FROM obs UNION ALL SELECT method, 'output_tokens', output_tokens FROM obs) WHERE value IS NOT NULL GROUP BY ALL""")
def unpivoted_measures(spark, base):
    o = O.normalised(observations(spark, base))
    return O.unpivot(o, ["method"], ["e2e_ms", "decode_ms", "output_tokens"]).groupBy("method", "measure").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query(f"""WITH {OBS}, a AS (SELECT *, list_filter([CASE WHEN decode_ms IS NULL THEN 'decode_ms' END, CASE WHEN e2e_ms IS NULL THEN 'e2e_ms' END], lambda x: x IS NOT NULL) AS missing FROM obs)
SELECT dataset, status, array_to_string(missing, ',') AS missing, count(*) AS n, count(*) FILTER (WHERE output_tokens + 20 > 60) AS over_budget FROM a GROUP BY ALL""")
def audited_fields(spark, base):
    o = observations(spark, base).withColumn("input_tokens", F.lit(20))
    a = O.audit(o, ["decode_ms", "e2e_ms"], budget=60)
    return a.groupBy("dataset", "status", F.array_join("missing", ",").alias("missing")).agg(F.count("*").alias("n"), F.count_if(F.array_contains("issues", "over_budget")).alias("over_budget"))


@query(f"""WITH {OBS}, d AS (SELECT dataset, sample_id, method, min(e2e_ms) AS e FROM obs GROUP BY ALL), r AS (SELECT dataset, sample_id, e AS r FROM d WHERE method = 1)
SELECT method, count(*) AS n, count(r) AS matched, round(avg(e - r), 4) AS mean_delta FROM d LEFT JOIN r USING (dataset, sample_id) GROUP BY method""")
def reference_deltas(spark, base):
    d = observations(spark, base).groupBy("dataset", "sample_id", "method").agg(F.min("e2e_ms").alias("e"))
    r = d.where("method = 1").select("dataset", "sample_id", "e")
    named = d.join(r.withColumnRenamed("e", "r"), ["dataset", "sample_id"], "left")
    return named.groupBy("method").agg(F.count("*").alias("n"), F.count("r").alias("matched"), F.round(F.avg(F.col("e") - F.col("r")), 4).alias("mean_delta"))
