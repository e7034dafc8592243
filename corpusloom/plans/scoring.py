"""Queries that score texts, token sequences and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import stats as S
from corpusloom.functions import text as X
from corpusloom.operators import validation as V
from corpusloom.plans.registry import registrar
from corpusloom.plans.relations import DOCS, documents, teacher, words_sql
from corpusloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
query = registrar(QUERIES, ORACLE)

_GRAMS = "(CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i : i + {n} - 1], chr(1))) ELSE [] END)"


def grams(w: str, n: int) -> str:
    return _GRAMS.format(w=w, n=n)


_T = f"t AS (SELECT doc_id, {words_sql('text')} AS w, {words_sql('lower(text)')} AS lw FROM documents)"


@query(f"""WITH {_T}, g AS (SELECT doc_id, len(w) AS words, {grams('w', 1)} AS g1, {grams('w', 2)} AS g2, {grams('w', 3)} AS g3 FROM t)
SELECT doc_id, CAST(words AS INT) AS words, round(CASE WHEN len(g1) > 0 THEN len(list_distinct(g1)) / len(g1) ELSE 0 END, 4) AS distinct_1,
round(CASE WHEN len(g2) > 0 THEN len(list_distinct(g2)) / len(g2) ELSE 0 END, 4) AS distinct_2, round(CASE WHEN len(g3) > 0 THEN 1 - len(list_distinct(g3)) / len(g3) ELSE 0 END, 4) AS repetition_3 FROM g""")
def distinct_n(spark, base):
    d = table(spark, base, "documents").select("doc_id", X.ngram_profile(X.split(F.col("text"))).alias("g"))
    return d.select("doc_id", "g.words", *[F.round(F.col(f"g.{c}"), 4).alias(c) for c in ("distinct_1", "distinct_2", "repetition_3")])


@query(f"""WITH {_T}, g AS (SELECT doc_id, len(w) AS n, {grams('w', 3)} AS g, {grams('lw', 3)} AS lg FROM t),
m AS (SELECT doc_id, max(c) AS most FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(g) AS x FROM g) GROUP BY ALL) GROUP BY doc_id)
SELECT g.doc_id, n >= 32 AND coalesce(most, 0) >= 8 AS degenerate, n >= 32 AND (coalesce(most, 0) >= 8 OR (len(lg) > 0 AND 1 - len(list_distinct(lg)) / len(lg) >= 0.25)) AS repetition FROM g LEFT JOIN m ON g.doc_id = m.doc_id""")
def repetition_flags(spark, base):
    return table(spark, base, "documents").select("doc_id", X.repetition(F.col("text")).alias("r")).select("doc_id", "r.degenerate", "r.repetition")


_SHARED = """CAST(coalesce(list_sum(list_transform(list_intersect({h}, {r}), lambda g: least(len(list_filter({h}, lambda x: x = g)), len(list_filter({r}, lambda x: x = g))))), 0) AS DOUBLE)"""
_PAIRS = f"""p AS (SELECT row_id, source, {words_sql('lower(summary)')} AS h, {words_sql('lower(reference_summary)')} AS r FROM teacher_records)"""


def _pairs(spark, base):
    d = teacher(spark, base)
    return d.select("row_id", "source", X.split(F.lower("summary")).alias("h"), X.split(F.lower("reference_summary")).alias("r"))


def _rouge_sql(n: int) -> str:
    h, r = grams("h", n), grams("r", n)
    return f"(CASE WHEN len(h) >= {n} AND len(r) >= {n} THEN 2 * {_SHARED.format(h=h, r=r)} / (len(h) - {n - 1} + len(r) - {n - 1}) ELSE 0 END)"


@query(f"WITH {_PAIRS} SELECT row_id, round({_rouge_sql(1)}, 4) AS rouge1_f, round({_rouge_sql(2)}, 4) AS rouge2_f FROM p")
def rouge_n_pairs(spark, base):
    h, r = F.col("h"), F.col("r")
    p, s = _pairs(spark, base).withColumn("s", X.shared_ngrams(h, r)), F.col("s")
    return p.select("row_id", F.round(X.rouge_f(h, r, 1, s), 4).alias("rouge1_f"), F.round(X.rouge_f(h, r, 2, s), 4).alias("rouge2_f"))


_BLEU = ", ".join(f"ln(greatest(CASE WHEN len(h) >= {n} THEN {_SHARED.format(h=grams('h', n), r=grams('r', n))} / (len(h) - {n - 1}) ELSE 0 END, 1e-9)) AS p{n}" for n in (1, 2, 3, 4))


_BLEU_OF = ", ".join(f"CASE WHEN a > 0 AND b > 0 THEN round(CASE WHEN a < b THEN exp(1 - b / a) ELSE 1 END * exp(({' + '.join(f'p{i}' for i in range(1, n + 1))}) / {n}), 4) ELSE 0 END AS bleu{n}" for n in (1, 2, 3, 4))


@query(f"WITH {_PAIRS}, q AS (SELECT row_id, len(h) AS a, len(r) AS b, {_BLEU} FROM p) SELECT row_id, {_BLEU_OF} FROM q")
def bleu_pairs(spark, base):
    b = X.bleu(F.col("h"), F.col("r"), 4, F.col("s"))
    return _pairs(spark, base).withColumn("s", X.shared_ngrams(F.col("h"), F.col("r"))).select("row_id", *[b[f"bleu{n}"].alias(f"bleu{n}") for n in (1, 2, 3, 4)])


@query(f"""WITH {_PAIRS}, x AS (SELECT source, {_rouge_sql(1)} AS f1, {_rouge_sql(2)} AS f2, len(h) AS a, len(r) AS b FROM p WHERE len(h) > 0 AND len(r) > 0)
SELECT source, count(*) AS n, round(sum(CAST(round(f1 * 10000) AS BIGINT)) / (10000.0::DOUBLE * count(*)), 6) AS rouge1_f, round(sum(CAST(round(f2 * 10000) AS BIGINT)) / (10000.0::DOUBLE * count(*)), 6) AS rouge2_f, round(avg(a / b), 4) AS length_ratio FROM x GROUP BY source""")
def rouge_by_source(spark, base):
    h, r = F.col("h"), F.col("r")
    p, s = _pairs(spark, base).where((F.size("h") > 0) & (F.size("r") > 0)).withColumn("s", X.shared_ngrams(h, r)), F.col("s")
    return p.groupBy("source").agg(
        F.count("*").alias("n"), F.round(F.sum(F.round(X.rouge_f(h, r, 1, s) * 10000).cast("long")) / (F.lit(10000.0) * F.count("*")), 6).alias("rouge1_f"), F.round(F.sum(F.round(X.rouge_f(h, r, 2, s) * 10000).cast("long")) / (F.lit(10000.0) * F.count("*")), 6).alias("rouge2_f"), F.round(F.avg(F.size("h") / F.size("r")), 4).alias("length_ratio")
    )


def _lcs_sql(source: str, key: str) -> str:
    """Rows `l` of key, a, b (lengths) and n, the longest common subsequence of the lists h and r: its table row by row."""
    step = "list_reduce(range(1, len(r) + 1), lambda acc, j: list_append(acc, CASE WHEN h[i + 1] = r[j] THEN t[j] + 1 ELSE greatest(t[j + 1], acc[len(acc)]) END), [0::BIGINT])"
    return f"""{source}, d AS (SELECT {key}, h, r, CAST(0 AS BIGINT) AS i, list_transform(range(len(r) + 1), lambda x: 0::BIGINT) AS t FROM hr UNION ALL SELECT {key}, h, r, i + 1, {step} FROM d WHERE i < len(h)),
l AS (SELECT {key}, len(h) AS a, len(r) AS b, t[len(t)] AS n FROM d WHERE i = len(h))"""


@query(f"""WITH RECURSIVE {_lcs_sql(_PAIRS + ", hr AS (SELECT row_id, h, r FROM p)", "row_id")}
SELECT row_id, round(CASE WHEN a > 0 AND b > 0 THEN n / a ELSE 0 END, 4) AS rougeL_p, round(CASE WHEN a > 0 AND b > 0 THEN n / b ELSE 0 END, 4) AS rougeL_r, round(CASE WHEN n > 0 THEN 2 * (n / a) * (n / b) / (n / a + n / b) ELSE 0 END, 4) AS rougeL_f FROM l""")
def rouge_l_pairs(spark, base):
    s = X.overlap_scores(F.col("l"), F.size("h"), F.size("r"))
    return _pairs(spark, base).withColumn("l", X.lcs(F.col("h"), F.col("r"))).select("row_id", F.round(s["p"], 4).alias("rougeL_p"), F.round(s["r"], 4).alias("rougeL_r"), F.round(s["f"], 4).alias("rougeL_f"))


@query()
def semantic_scores(spark, base):
    d = teacher(spark, base).where(F.col("summary").isNotNull() & F.col("reference_summary").isNotNull())
    d = d.select("row_id", "summary", "reference_summary", X.nfkc(F.col("summary")).alias("h"), X.nfkc(F.col("reference_summary")).alias("r"))
    d = d.select("row_id", "summary", "reference_summary", X.split(F.lower("h")).alias("h"), X.split(F.lower("r")).alias("r"))
    d = d.withColumn("l", X.lcs(F.col("h"), F.col("r"))).withColumn("ls", X.lcs(X.sentences(F.col("summary")), X.sentences(F.col("reference_summary"))))
    return d.select("row_id", X.semantic(F.col("summary"), F.col("reference_summary"), F.col("h"), F.col("r"), F.col("l"), F.col("ls")).alias("s")).select("row_id", "s.*")


@query()
def output_similarity(spark, base):
    d = teacher(spark, base).where(F.col("summary").isNotNull() & F.col("reference_summary").isNotNull())
    clean = X.code_output(F.col("summary"))
    return d.select("row_id", (clean == F.col("reference_summary")).alias("exact"), F.round(X.similarity(clean, F.col("reference_summary")), 4).alias("similarity"))


_PARTS = " OR ".join(f"contains({{x}}, '{p}')" for p in ["�", *X.MOJIBAKE_PARTS])


@query(f"""SELECT row_id, coalesce(regexp_matches(document, '{X.MOJIBAKE_PATTERN}'), false) AS by_pattern, coalesce({_PARTS.format(x='document')}, false) AS by_parts FROM summary_records""")
def mojibake_flags(spark, base):
    d = table(spark, base, "summary_records")
    return d.select("row_id", X.mojibake_by_pattern(F.col("document")).alias("by_pattern"), X.mojibake_by_parts(F.col("document")).alias("by_parts"))


_ANOMALY = f"""a AS (SELECT row_id, source, summary, document, {words_sql('lower(summary)')} AS s, {words_sql('lower(document)')} AS d, {words_sql('lower(reference_summary)')} AS r FROM teacher_records),
b AS (SELECT *, CASE WHEN len(s) >= 3 THEN 1 - len(list_distinct({grams('s', 3)})) / len({grams('s', 3)}) ELSE 0 END AS r3, CASE WHEN len(s) >= 4 THEN 1 - len(list_distinct({grams('s', 4)})) / len({grams('s', 4)}) ELSE 0 END AS r4 FROM a),
c AS (SELECT row_id, source, list_filter([CASE WHEN len({words_sql('summary')}) = 0 THEN 'empty_summary' END, CASE WHEN len({words_sql('document')}) = 0 THEN 'empty_document' END, CASE WHEN len(s) > 0 AND len(s) < 5 THEN 'too_short' END,
CASE WHEN len(d) > 0 AND len(s) > len(d) THEN 'too_long' END, CASE WHEN len(s) >= 10 AND r3 > 0.35 THEN 'repetition_loop_3gram' END, CASE WHEN len(s) >= 10 AND r3 <= 0.35 AND r4 > 0.25 THEN 'repetition_loop_4gram' END,
CASE WHEN coalesce({_PARTS.format(x='summary')}, false) OR coalesce({_PARTS.format(x='document')}, false) THEN 'mojibake_detected' END,
CASE WHEN len(s) > 0 AND len(r) > 0 AND len(list_intersect(s, r)) = 0 THEN 'zero_rouge1_with_reference' END], lambda x: x IS NOT NULL) AS reasons FROM b)"""


def _reasons(spark, base):
    d = teacher(spark, base)
    return d.select("row_id", "source", V.anomalies(F.col("summary"), F.col("document"), F.col("reference_summary")).alias("reasons"))


@query(f"WITH {_ANOMALY} SELECT row_id, array_to_string(reasons, '|') AS reasons, len(reasons) = 0 AS is_valid FROM c")
def teacher_anomalies(spark, base):
    return _reasons(spark, base).select("row_id", F.array_join("reasons", "|").alias("reasons"), (F.size("reasons") == 0).alias("is_valid"))


@query(f"""WITH {_ANOMALY} SELECT source, coalesce(reason, 'valid') AS reason, count(*) AS n FROM (SELECT source, unnest(CASE WHEN len(reasons) > 0 THEN reasons ELSE ['valid'] END) AS reason FROM c) GROUP BY ALL""")
def teacher_report(spark, base):
    r = _reasons(spark, base).select("source", F.explode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("valid")))).alias("reason"))
    return r.groupBy("source", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {_ANOMALY}, t AS (SELECT c.source, count(*) AS total, count(*) FILTER (WHERE len(reasons) > 0) AS invalid FROM c GROUP BY 1)
SELECT source, total, invalid, round(invalid / total, 4) AS invalid_rate, invalid / total <= 0.10 AS passes FROM t""")
def teacher_gate(spark, base):
    g = _reasons(spark, base).groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.size("reasons") > 0).alias("invalid"))
    return g.select("*", F.round(F.col("invalid") / F.col("total"), 4).alias("invalid_rate"), (F.col("invalid") / F.col("total") <= 0.10).alias("passes"))


@query("""SELECT a.row_id, a.is_valid AS audited_valid, list_contains(coalesce(a.reasons, []), 'too_short') AS said_short, a.summary_words, a.document_words FROM record_audits a JOIN teacher_records t USING (row_id) WHERE t.attempt = 1""")
def audits_of_first_attempts(spark, base):
    a, t = table(spark, base, "record_audits"), teacher(spark, base).where("attempt = 1").select("row_id")
    said = F.array_contains(F.coalesce("reasons", F.array().cast("array<string>")), "too_short")
    return a.join(t, "row_id").select("row_id", F.col("is_valid").alias("audited_valid"), said.alias("said_short"), "summary_words", "document_words")


@query("""SELECT doc_id, nfc_normalize(text) <> text AS changed, length(nfc_normalize(text)) AS length FROM documents WHERE text IS NOT NULL""")
def nfc_flags(spark, base):
    d = table(spark, base, "documents").where("text IS NOT NULL").withColumn("n", X.nfc(F.col("text")))
    return d.select("doc_id", (F.col("n") != F.col("text")).alias("changed"), F.length("n").cast("long").alias("length"))


@query(f"""SELECT doc_id, CAST(len(list_filter(list_transform(string_split_regex(text, '{X.SENTENCE_END}'), lambda s: regexp_replace(s, '^{X.SPACE}+|{X.SPACE}+$', '', 'g')), lambda s: s <> '')) AS INT) AS sentences,
CASE WHEN length(replace(text, chr(10), '⏎')) <= 40 THEN replace(text, chr(10), '⏎') ELSE rtrim(substr(replace(text, chr(10), '⏎'), 1, 40)) || '...' END AS preview FROM documents WHERE text IS NOT NULL""")
def sentences_and_previews(spark, base):
    d = table(spark, base, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.size(X.sentences(F.col("text"))).alias("sentences"), X.preview(F.col("text"), 40).alias("preview"))


@query("""SELECT doc_id, regexp_replace(source, '[^A-Za-z0-9._-]+', '_', 'g') AS stem, 'Tóm tắt: ' || text || chr(10) || '---' AS prompt FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '<\\|im_start\\|>|<\\|start_header_id\\|>|\\[INST\\]')""")
def rendered_prompts(spark, base):
    d = table(spark, base, "documents").where("text IS NOT NULL").where(~F.col("text").rlike(r"<\|im_start\|>|<\|start_header_id\|>|\[INST\]"))
    return d.select("doc_id", X.file_stem(F.col("source")).alias("stem"), X.template("Tóm tắt: {document}\n---", F.col("text")).alias("prompt"))


def _sequences(spark, base):
    """Token sequences: order lines by line number, the parts as drafted, the suppliers as target tokens, both modulo 3."""
    from corpusloom.plans.relations import observations

    o = observations(spark, base).groupBy("sample_id", "method").agg(F.min(F.col("part") % 3).alias("a"), F.min(F.col("supplier") % 3).alias("b"))
    listed = o.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("method", "a", "b"))).alias("s"))
    return listed.select("sample_id", F.transform("s", lambda x: x["a"]).alias("a"), F.transform("s", lambda x: x["b"]).alias("b"))


_SEQ = """s AS (SELECT sample_id, list(a ORDER BY method) AS a, list(b ORDER BY method) AS b, bool_and(a = b) AS same FROM
(SELECT l_orderkey AS sample_id, CAST(l_linenumber AS INT) AS method, min(l_partkey % 3) AS a, min(l_suppkey % 3) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY sample_id),
f AS (SELECT *, list_position(list_transform(range(1, len(a) + 1), lambda i: a[i] = b[i]), false) AS p FROM s)"""


@query(f"""WITH {_SEQ} SELECT sample_id, CAST(CASE WHEN p > 0 THEN p - 1 ELSE len(a) END AS INT) AS accepted, CAST(CASE WHEN p > 0 THEN p - 1 END AS INT) AS mismatch, same AS exact FROM f""")
def accepted_prefix(spark, base):
    a, b = F.col("a"), F.col("b")
    return _sequences(spark, base).select("sample_id", A.accepted_prefix(a, b).alias("accepted"), A.first_mismatch(a, b).alias("mismatch"), (a == b).alias("exact"))


@query("""WITH o AS (SELECT l_orderkey AS sample_id, CAST(l_linenumber AS INT) AS method, min(l_discount) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT sample_id, method, round(exp(sum(ln(1 - d * 0.618034)) OVER w), 6) AS kept, round(sum(d) OVER r, 6) AS rest FROM o
WINDOW w AS (PARTITION BY sample_id ORDER BY method ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY sample_id ORDER BY method ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def prefix_weights(spark, base):
    lines = table(spark, base, "lineitem").join(table(spark, base, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    o = lines.groupBy(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").cast("int").alias("method")).agg(F.min("l_discount").alias("d"))
    w = Window.partitionBy("sample_id").orderBy("method")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    return o.select("sample_id", "method", F.round(F.exp(F.sum(F.ln(1 - F.col("d") * 0.618034)).over(before)), 6).alias("kept"), F.round(F.sum("d").over(after), 6).alias("rest"))


@query(f"""WITH {_SEQ} SELECT sample_id, array_to_string(CASE WHEN len(a) <= 4 THEN a ELSE list_concat(a[1:2], a[len(a) - 1 : len(a)]) END, ',') AS cut,
array_to_string(CASE WHEN list_position(a, 2) > 0 THEN a[1 : list_position(a, 2) - 1] ELSE a END, ',') AS until_stop FROM f""")
def truncated_sequences(spark, base):
    a = F.col("a")
    return _sequences(spark, base).select("sample_id", F.array_join(A.head_tail(a, 4, 2), ",").alias("cut"), F.array_join(A.until(a, F.lit(2).cast("long")), ",").alias("until_stop"))


@query(f"""WITH RECURSIVE {_lcs_sql(_SEQ + ", hr AS (SELECT sample_id, a AS h, b AS r FROM f)", "sample_id")} SELECT sample_id, CAST(n AS INT) AS lcs, round(n / b, 6) AS overlap FROM l""")
def token_lcs(spark, base):
    a, b = F.col("a"), F.col("b")
    d = _sequences(spark, base).withColumn("lcs", X.lcs(a, b))
    return d.select("sample_id", "lcs", F.round(S.ratio(F.col("lcs"), F.size(b)), 6).alias("overlap"))


@query("""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT a.vec_id, a.v AS x, b.v AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * y[i])) / (sqrt(list_sum(list_transform(x, lambda p: p * p))) * sqrt(list_sum(list_transform(y, lambda p: p * p)))), 4) AS cosine,
round(list_max(list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i]))), 4) AS largest FROM c""")
def vector_parity(spark, base):
    e = table(spark, base, "embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    a, b = F.col("embedding"), F.col("other")
    return e.join(after, "vec_id").select("vec_id", F.round(A.cosine(a, b), 4).alias("cosine"), F.round(A.largest_difference(a, b), 4).alias("largest"))


@query(f"""WITH {DOCS} SELECT dataset, bucket, CAST(sum(words) AS BIGINT) AS numerator, count(*) AS denominator, round(sum(words) / count(*), 4) AS mean FROM (SELECT dataset, CAST(doc_id % 4 AS INT) AS bucket, words FROM docs) GROUP BY GROUPING SETS ((dataset, bucket), (dataset))""")
def partial_and_final(spark, base):
    d = documents(spark, base).select("dataset", F.pmod("doc_id", F.lit(4)).cast("int").alias("bucket"), "words")
    return d.rollup("dataset", "bucket").agg(F.sum("words").alias("numerator"), F.count("*").alias("denominator"), F.round(F.sum("words") / F.count("*"), 4).alias("mean")).where("dataset IS NOT NULL")
