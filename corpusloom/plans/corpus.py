"""Queries of the corpus layer: profiles, contracts, bins, samples, splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import stats as S
from corpusloom.functions import text as X
from corpusloom.operators import ranking as R
from corpusloom.operators import sampling as P
from corpusloom.operators import validation as V
from corpusloom.plans.relations import DOCS, corpus, documents
from corpusloom.plans.registry import registrar
from corpusloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
query = registrar(QUERIES, ORACLE)


_PROFILE = "count(w) AS count, CAST(min(w) AS DOUBLE) AS min, " + ", ".join(f"round(quantile_cont(w, {p}), 4) AS {k}" for k, p in S.PROFILE.items()) + ", round(avg(w), 4) AS mean, CAST(max(w) AS DOUBLE) AS max"


@query(f"WITH {DOCS}, x AS (SELECT dataset, CAST(words AS DOUBLE) AS w FROM docs) SELECT dataset, {_PROFILE} FROM x GROUP BY dataset")
def length_profile(spark, base):
    return S.profile(documents(spark, base), ["dataset"], "words")


@query(f"WITH x AS (SELECT dataset, source_split, CAST(document_words AS DOUBLE) AS w FROM corpus_records WHERE document_words > 0) SELECT dataset, source_split, {_PROFILE} FROM x GROUP BY ALL")
def corpus_length_profile(spark, base):
    return S.profile(corpus(spark, base), ["dataset", "source_split"], "document_words")


@query("""WITH x AS (SELECT dataset, document_words AS w, row_number() OVER (PARTITION BY dataset ORDER BY document_words) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM corpus_records WHERE document_words > 0)
SELECT dataset, count(*) AS count, min(w) AS min, min(CASE WHEN r = n // 2 + 1 THEN w END) AS upper_median, round(avg(w), 4) AS mean, max(w) AS max FROM x GROUP BY dataset""")
def upper_median_profile(spark, base):
    return S.upper_median(corpus(spark, base), ["dataset"], "document_words")


@query("""SELECT dataset, round(min(w), 2) AS min, round(quantile_cont(w, 0.1), 2) AS p10, round(quantile_cont(w, 0.25), 2) AS p25, round(quantile_cont(w, 0.5), 2) AS median, round(avg(w), 2) AS mean,
round(quantile_cont(w, 0.75), 2) AS p75, round(quantile_cont(w, 0.9), 2) AS p90, round(max(w), 2) AS max FROM (SELECT dataset, CAST(reference_words AS DOUBLE) AS w FROM corpus_records) GROUP BY dataset""")
def quartile_profile(spark, base):
    return S.quartiles(table(spark, base, "corpus_records"), ["dataset"], "reference_words")


@query(f"""WITH {DOCS} SELECT doc_id, array_to_string(list_filter([CASE WHEN text IS NULL THEN 'missing:text' END, CASE WHEN lang IS NULL THEN 'missing:lang' END], lambda p: p IS NOT NULL)
 || CASE WHEN text IS NULL OR lang IS NULL THEN [] ELSE list_filter([CASE WHEN words = 0 THEN 'empty_text' END, CASE WHEN words > 0 AND words < 20 THEN 'too_short' END,
 CASE WHEN n_chars <> length(text) THEN 'wrong_length' END, CASE WHEN n > 1 THEN 'duplicate_text' END], lambda p: p IS NOT NULL) END, '|') AS problems
FROM docs LEFT JOIN (SELECT text AS t, count(*) AS n FROM documents GROUP BY text) ON text = t""")
def corpus_contract(spark, base):
    d = documents(spark, base)
    copies = d.where(F.col("text").isNotNull()).groupBy(F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("k")).agg(F.count("*").alias("n")).select("k", "n")
    d = d.withColumn("k", F.sha2("text", 256)).join(copies, "k", "left")
    words = F.col("words")
    found = V.record_problems(["text", "lang"], [("empty_text", words == 0), ("too_short", (words > 0) & (words < 20)), ("wrong_length", F.col("n_chars") != F.length("text")), ("duplicate_text", F.col("n") > 1)])
    return d.select("doc_id", F.array_join(found, "|").alias("problems"))


@query("""SELECT dataset, coalesce(reason, 'valid') AS reason, count(*) AS n, sum(document_words) AS words FROM (SELECT dataset, document_words,
CASE WHEN document_words < 100 THEN 'document_too_short' WHEN reference_words >= document_words THEN 'reference_not_shorter' END AS reason FROM corpus_records WHERE document_words > 0) GROUP BY ALL""")
def task_valid_reasons(spark, base):
    reason = V.task_reason(F.col("document_words"), F.col("reference_words"))
    return corpus(spark, base).groupBy("dataset", F.coalesce(reason, F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"), F.sum("document_words").alias("words"))


@query("SELECT id, dataset, document_words, ingested_at FROM corpus_records WHERE document_words >= 100 AND reference_words < document_words")
def task_valid_filter(spark, base):
    return corpus(spark, base).where(V.task_reason(F.col("document_words"), F.col("reference_words")).isNull()).select("id", "dataset", "document_words", "ingested_at")


@query("""SELECT dataset, count(*) AS texts, sum(c) AS rows, sum(c - 1) AS duplicates, max(c) AS most FROM (SELECT dataset, text, count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY dataset, text) GROUP BY dataset""")
def duplicate_stats(spark, base):
    per = documents(spark, base).where("text IS NOT NULL").groupBy("dataset", F.sha2("text", 256).alias("k")).agg(F.count("*").alias("c"))
    return per.groupBy("dataset").agg(F.count("*").alias("texts"), F.sum("c").alias("rows"), F.sum(F.col("c") - 1).alias("duplicates"), F.max("c").alias("most"))


@query("""WITH c AS (SELECT dataset, category, count(*) AS n FROM corpus_records GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, category NULLS LAST) AS k FROM c)
SELECT dataset, CASE WHEN k <= 5 THEN coalesce(category, '(null)') ELSE 'other' END AS category, sum(n) AS n FROM r GROUP BY ALL""")
def topk_other(spark, base):
    return R.top_or_other(table(spark, base, "corpus_records"), ["dataset"], "category", 5)


@query("""WITH x AS (SELECT dataset, document_words AS w FROM corpus_records WHERE document_words > 0), b AS (SELECT dataset, min(w) AS lo, max(w) AS hi FROM x GROUP BY dataset)
SELECT dataset, CAST(least(floor((w - lo) / (greatest(hi - lo, 1) / 12.0)), 11) AS INT) AS bin, count(*) AS n FROM x JOIN b USING (dataset) GROUP BY ALL""")
def length_histogram(spark, base):
    x = corpus(spark, base).groupBy("dataset", "document_words").agg(F.count("*").alias("n"))
    b = x.groupBy("dataset").agg(F.min("document_words").alias("lo"), F.max("document_words").alias("hi"))
    step = F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) / 12.0
    bin_ = F.least(F.floor((F.col("document_words") - F.col("lo")) / step), F.lit(11)).cast("int")
    return x.join(b, "dataset").groupBy("dataset", bin_.alias("bin")).agg(F.sum("n").alias("n"))


@query("""WITH x AS (SELECT id, dataset, document_words, ingested_at FROM corpus_records WHERE document_words > 0), b AS (SELECT dataset, quantile_cont(document_words, 0.01) AS lo, quantile_cont(document_words, 0.99) AS hi FROM x GROUP BY dataset)
SELECT x.* FROM x JOIN b USING (dataset) WHERE document_words BETWEEN lo AND hi""")
def outlier_clip(spark, base):
    return P.clipped(corpus(spark, base).select("id", "dataset", "document_words", "ingested_at"), ["dataset"], "document_words")


@query("""WITH x AS (SELECT dataset, document_words AS w FROM corpus_records WHERE document_words > 0), e AS (SELECT dataset, quantile_cont(w, [0.2, 0.4, 0.6, 0.8]) AS e FROM x GROUP BY dataset)
SELECT dataset, CAST(len(list_filter(e, lambda v: v < w)) AS INT) AS bin, count(*) AS n, min(w) AS low, max(w) AS high FROM x JOIN e USING (dataset) GROUP BY ALL""")
def quantile_bins(spark, base):
    x = P.quantile_bin(corpus(spark, base), ["dataset"], "document_words", 5)
    return x.groupBy("dataset", "bin").agg(F.count("*").alias("n"), F.min("document_words").alias("low"), F.max("document_words").alias("high"))


@query(f"WITH {DOCS} SELECT doc_id, dataset, words, CAST(ntile(5) OVER (PARTITION BY dataset ORDER BY words, doc_id) AS INT) AS bin FROM docs")
def ntile_bins(spark, base):
    d = documents(spark, base).select("doc_id", "dataset", "words")
    return P.ntile(d, ["dataset"], [F.col("words"), F.col("doc_id")], 5)


@query("""WITH g AS (SELECT dataset, coalesce(category, '(null)') AS category, count(*) AS weight FROM corpus_records GROUP BY ALL),
w AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS k, sum(weight) OVER (PARTITION BY dataset) AS mass FROM g), f AS (SELECT *, least(3, 200 // k) AS lo FROM w),
x AS (SELECT *, (200 - lo * k) * CAST(weight AS DOUBLE) / mass AS exact FROM f), y AS (SELECT *, floor(exact) AS b FROM x),
z AS (SELECT *, 200 - sum(lo + b) OVER (PARTITION BY dataset) AS rest, row_number() OVER (PARTITION BY dataset ORDER BY exact - b DESC, category) AS nth FROM y)
SELECT dataset, category, weight, CAST(lo + b + CASE WHEN nth <= rest THEN 1 ELSE 0 END AS BIGINT) AS slots FROM z""")
def largest_remainder(spark, base):
    g = table(spark, base, "corpus_records").groupBy("dataset", F.coalesce("category", F.lit("(null)")).alias("category")).agg(F.count("*").alias("weight"))
    return P.allocate(g, ["dataset"], "category", "weight", 200, 3)


_SPACED = """WITH {docs}, r AS (SELECT doc_id, dataset, words, row_number() OVER (PARTITION BY dataset ORDER BY words, doc_id) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM docs)
SELECT doc_id, dataset, words FROM r WHERE n <= {k} OR list_contains(list_transform(range({k}), lambda i: round_even(CAST(i AS DOUBLE) * (n - 1) / ({k} - 1), 0)), r - 1)"""


@query(_SPACED.format(docs=DOCS, k=20))
def evenly_spaced_sample(spark, base):
    d = documents(spark, base).select("doc_id", "dataset", "words")
    return P.evenly_spaced(d, ["dataset"], [F.col("words"), F.col("doc_id")], 20)


@query(f"""WITH {DOCS}, r AS (SELECT doc_id, dataset, words, row_number() OVER (PARTITION BY dataset ORDER BY words, doc_id) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM docs)
SELECT doc_id, dataset, words, CASE WHEN r = 1 THEN 'short' WHEN r = n THEN 'long' ELSE 'median' END AS anchor FROM r WHERE r IN (1, n, n // 2 + 1)""")
def length_anchors(spark, base):
    d = documents(spark, base).select("doc_id", "dataset", "words")
    return P.anchors(d, ["dataset"], [F.col("words"), F.col("doc_id")])


@query(f"""WITH {DOCS}, r AS (SELECT doc_id, dataset, words, row_number() OVER (PARTITION BY dataset ORDER BY words, doc_id) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM docs)
SELECT doc_id, dataset, words, CASE WHEN r = round_even(0.25 * (n - 1), 0) + 1 THEN 0.25 WHEN r = round_even(0.5 * (n - 1), 0) + 1 THEN 0.5 ELSE 0.9 END AS quantile FROM r
WHERE r IN (round_even(0.25 * (n - 1), 0) + 1, round_even(0.5 * (n - 1), 0) + 1, round_even(0.9 * (n - 1), 0) + 1)""")
def quantile_picks(spark, base):
    d = documents(spark, base).select("doc_id", "dataset", "words")
    return P.at_quantiles(d, ["dataset"], [F.col("words"), F.col("doc_id")], [0.25, 0.5, 0.9])


_HASHED = """h AS (SELECT doc_id, dataset, bin, score, row_number() OVER (PARTITION BY bin, dataset ORDER BY score, doc_id) AS rank FROM (SELECT doc_id, dataset, bin,
sha256('42' || chr(0) || bin || chr(0) || dataset || chr(0) || CAST(doc_id AS VARCHAR)) AS score FROM (SELECT doc_id, dataset, CASE WHEN words < 100 THEN 'short' WHEN words < 300 THEN 'middle' ELSE 'long' END AS bin FROM docs)))"""


def _binned(spark, base):
    w = F.col("words")
    return documents(spark, base).select("doc_id", "dataset", F.when(w < 100, "short").when(w < 300, "middle").otherwise("long").alias("bin"))


@query(f"WITH {DOCS}, {_HASHED} SELECT doc_id, dataset, bin, score, rank FROM h WHERE rank <= 30")
def hash_topk_per_bin(spark, base):
    return P.hash_top(_binned(spark, base), ["bin", "dataset"], "doc_id", 42, 30)


@query(f"""WITH {DOCS}, {_HASHED}, t AS (SELECT doc_id, dataset, bin, score, rank AS turn, row_number() OVER (PARTITION BY bin ORDER BY rank, dataset) AS nth FROM h WHERE rank <= 50)
SELECT doc_id, dataset, bin, turn FROM t WHERE nth <= 50""")
def round_robin_select(spark, base):
    few = P.hash_top(_binned(spark, base), ["bin", "dataset"], "doc_id", 42, 50)
    return P.round_robin(few, ["bin"], "dataset", [F.col("score"), F.col("doc_id")], 50).select("doc_id", "dataset", "bin", "turn")


@query(f"""SELECT doc_id, CASE WHEN sha256('42' || chr(0) || coalesce(text, '')) < '{int(0.05 * (1 << 256)):064x}' THEN 'eval' ELSE 'train' END AS split FROM documents""")
def content_hash_split(spark, base):
    return documents(spark, base).select("doc_id", P.split_of(F.coalesce("text", F.lit("")), 42, 0.05).alias("split"))


@query("""WITH r AS (SELECT row_id, id, source_file, source_line, row_number() OVER (PARTITION BY id ORDER BY source_file, source_line, row_id) AS r FROM summary_records),
m AS (SELECT *, row_number() OVER (PARTITION BY id, source_file, source_line, r = 1 ORDER BY row_id) AS m FROM r)
SELECT row_id, CASE WHEN r = 1 THEN id ELSE id || '::' || source_file || ':' || source_line || CASE WHEN m > 1 THEN ':' || m ELSE '' END END AS record_id FROM m""")
def record_ids(spark, base):
    d = table(spark, base, "summary_records").select("row_id", "id", "source_file", "source_line")
    return P.disambiguated(d, "id", "source_file", "source_line", order=["row_id"]).select("row_id", "record_id")


@query("""WITH x AS (SELECT id, dataset, document_words AS w, ingested_at FROM corpus_records WHERE document_words > 0), b AS (SELECT dataset, quantile_cont(w, 0.01) AS lo, quantile_cont(w, 0.99) AS hi FROM x GROUP BY dataset),
c AS (SELECT x.* FROM x JOIN b USING (dataset) WHERE w BETWEEN lo AND hi), e AS (SELECT dataset, quantile_cont(w, [0.2, 0.4, 0.6, 0.8]) AS e FROM c GROUP BY dataset),
q AS (SELECT c.*, CAST(len(list_filter(e, lambda v: v < w)) AS INT) AS length_bin FROM c JOIN e USING (dataset)),
g AS (SELECT dataset, CAST(i AS INT) AS length_bin, (SELECT count(*) FROM q WHERE q.dataset = e.dataset AND q.length_bin = i) AS n FROM e, range(5) t(i)),
f AS (SELECT *, (100 - 50) * CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY dataset) AS exact FROM g), y AS (SELECT *, floor(exact) AS b FROM f),
z AS (SELECT *, 100 - sum(10 + b) OVER (PARTITION BY dataset) AS rest, row_number() OVER (PARTITION BY dataset ORDER BY exact - b DESC, length_bin) AS nth FROM y),
s AS (SELECT dataset, length_bin, n, least(CAST(10 + b + CASE WHEN nth <= rest THEN 1 ELSE 0 END AS BIGINT), n) AS k FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset, length_bin ORDER BY w, id, ingested_at) - 1 AS r FROM q)
SELECT r.dataset, r.length_bin, r.id, r.w AS document_words FROM r JOIN s USING (dataset, length_bin)
WHERE n <= k OR (k = 1 AND r = n // 2) OR (k > 1 AND list_contains(list_transform(range(k), lambda i: round_even(CAST(i AS DOUBLE) * (n - 1) / (k - 1), 0)), r))""")
def stratified_pipeline(spark, base):
    d = corpus(spark, base).select("id", "dataset", "document_words", "ingested_at")
    picked = P.stratified(d, ["dataset"], "document_words", [F.col("document_words"), F.col("id"), F.col("ingested_at")], 100)
    return picked.select("dataset", "length_bin", "id", "document_words")


@query("SELECT source, CAST(doc_id % 8 AS INT) AS shard, count(*) AS n FROM documents GROUP BY ALL")
def round_robin_shards(spark, base):
    return documents(spark, base).groupBy("source", P.shard(F.col("doc_id"), 8).alias("shard")).agg(F.count("*").alias("n"))


@query("""SELECT dataset, CASE WHEN w < 1000 THEN '0-1k' WHEN w < 2000 THEN '1k-2k' WHEN w < 4000 THEN '2k-4k' WHEN w < 6000 THEN '4k-6k' WHEN w < 12000 THEN '6k-12k' END AS token_bin,
CASE WHEN w <= 512 THEN '1-512' WHEN w <= 1024 THEN '513-1024' WHEN w <= 2048 THEN '1025-2048' WHEN w <= 4096 THEN '2049-4096' WHEN w <= 8192 THEN '4097-8192' ELSE '8193+' END AS label, count(*) AS n
FROM (SELECT dataset, document_words AS w FROM corpus_records WHERE document_words > 0) GROUP BY ALL""")
def length_labels(spark, base):
    w = F.col("document_words")
    return corpus(spark, base).groupBy("dataset", P.token_bin(w).alias("token_bin"), P.length_label(w).alias("label")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT source_file, count(*) AS n FROM corpus_records GROUP BY ALL)
SELECT source_file, n, row_number() OVER (ORDER BY coalesce(TRY_CAST(regexp_extract(source_file, '(\\d+)', 1) AS BIGINT), -1), source_file) AS place FROM f""")
def natural_file_order(spark, base):
    f = table(spark, base, "corpus_records").groupBy("source_file").agg(F.count("*").alias("n"))
    return R.numbered(f, [], R.natural_key(F.col("source_file")), "place", "files").drop("files")


@query("""SELECT source_split, count(*) AS n, count(DISTINCT id) AS ids, count(DISTINCT source_file) AS files, count(*) FILTER (WHERE category IS NULL) AS uncategorised FROM corpus_records GROUP BY ALL""")
def split_counts(spark, base):
    return table(spark, base, "corpus_records").groupBy("source_split").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("source_file").alias("files"), F.count_if(F.col("category").isNull()).alias("uncategorised")
    )


@query("""SELECT id, dataset, document_words, category, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS r FROM corpus_records) WHERE r = 1""")
def dedup_first_wins(spark, base):
    d = table(spark, base, "corpus_records").select("id", "dataset", "document_words", "category", "ingested_at")
    return R.keep_first(d, ["id"], [F.col("ingested_at")])


@query("""SELECT source, source_schema, count(*) AS n, count(*) FILTER (WHERE unicode_nfc_normalized) AS nfc, count(*) FILTER (WHERE suspected_mojibake) AS mojibake, count(suspected_mojibake) AS looked,
count(DISTINCT source_file) AS files FROM summary_records GROUP BY ALL""")
def ingest_counters(spark, base):
    d = table(spark, base, "summary_records")
    return d.groupBy("source", "source_schema").agg(
        F.count("*").alias("n"), F.count_if("unicode_nfc_normalized").alias("nfc"), F.count_if("suspected_mojibake").alias("mojibake"), F.count("suspected_mojibake").alias("looked"), F.countDistinct("source_file").alias("files")
    )


@query("""SELECT source, CAST(count(*) AS BIGINT) AS n, round(avg(round(s / d, 4)), 4) AS mean_compression, round(min(s / d), 4) AS least, round(max(s / d), 4) AS most FROM
(SELECT source, CAST(length(summary) AS DOUBLE) AS s, CAST(length(document) AS DOUBLE) AS d FROM summary_records WHERE length(document) > 0 AND summary IS NOT NULL) GROUP BY source""")
def compression_ratio(spark, base):
    d = table(spark, base, "summary_records").where((F.length("document") > 0) & F.col("summary").isNotNull())
    r = F.length("summary") / F.length("document")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.round(r, 4)), 4).alias("mean_compression"), F.round(F.min(r), 4).alias("least"), F.round(F.max(r), 4).alias("most"))


@query("""SELECT doc_id, CASE WHEN coalesce(text, '') = (SELECT coalesce(text, '') FROM documents ORDER BY doc_id LIMIT 1) THEN 'eval' ELSE 'train' END AS split FROM documents""")
def nonempty_split(spark, base):
    d = documents(spark, base).select("doc_id", "text").withColumn("split", P.split_of(F.coalesce("text", F.lit("")), 42, 0.0))
    return P.non_empty_split(d.withColumn("text", F.coalesce("text", F.lit(""))), "text", ["doc_id"]).select("doc_id", "split")


@query(f"""WITH RECURSIVE {DOCS}, o AS (SELECT doc_id, words, CAST(doc_id // 1000 AS BIGINT) AS batch, row_number() OVER (PARTITION BY doc_id // 1000 ORDER BY words DESC, doc_id) AS i FROM docs WHERE words > 0),
g AS (SELECT doc_id, words, batch, i, CAST(0 AS INT) AS shard, [words, 0, 0, 0]::BIGINT[] AS load FROM o WHERE i = 1 UNION ALL
SELECT o.doc_id, o.words, o.batch, o.i, CAST(list_position(load, list_min(load)) - 1 AS INT), list_transform(load, lambda x, k: CASE WHEN k = list_position(load, list_min(load)) THEN x + o.words ELSE x END) FROM g JOIN o ON o.batch = g.batch AND o.i = g.i + 1)
SELECT batch, doc_id, words, shard FROM g""")
def lpt_shards(spark, base):
    d = documents(spark, base).where("words > 0").select("source", "doc_id", "words")
    return P.balanced_shards(d.withColumn("batch", F.floor(F.col("doc_id") / 1000)), ["batch"], "doc_id", "words", 4)


@query(f"""WITH RECURSIVE {DOCS}, o AS (SELECT doc_id, words, CAST(doc_id // 256 AS BIGINT) AS "window", row_number() OVER (PARTITION BY doc_id // 256 ORDER BY words, doc_id) AS i FROM docs WHERE words > 0),
g AS (SELECT doc_id, words, "window", i, CAST(0 AS INT) AS batch, 1 AS held FROM o WHERE i = 1 UNION ALL
SELECT o.doc_id, o.words, o."window", o.i, CASE WHEN held = 16 OR (held + 1) * o.words > 4096 THEN batch + 1 ELSE batch END, CASE WHEN held = 16 OR (held + 1) * o.words > 4096 THEN 1 ELSE held + 1 END FROM g JOIN o ON o."window" = g."window" AND o.i = g.i + 1)
SELECT doc_id, words, "window", batch FROM g""")
def length_bucket_batches(spark, base):
    return P.batches(documents(spark, base).where("words > 0"), "doc_id", "words", 16, 4096, 256)


@query("""SELECT 'train' AS split, dataset, CAST(NULL AS VARCHAR) AS release, count(*) AS n FROM corpus_records WHERE source_split = 'train' GROUP BY dataset
UNION ALL SELECT pool_split, dataset, release, sum(records) FROM distribution_report GROUP BY ALL""")
def union_of_pools(spark, base):
    a = table(spark, base, "corpus_records").where("source_split = 'train'").groupBy(F.lit("train").alias("split"), "dataset").agg(F.count("*").alias("n"))
    b = table(spark, base, "distribution_report").groupBy(F.col("pool_split").alias("split"), "dataset", "release").agg(F.sum("records").alias("n"))
    return a.unionByName(b, allowMissingColumns=True)
