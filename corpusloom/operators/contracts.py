"""Strict joins and whole-table contracts: what must be complete fails with what is missing, and nothing is dropped silently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.functions import text as X
from corpusloom.operators import validation as V

#: Fixed: what a sidecar must share with the run it stands beside.
SIDECAR = ["prompt_token_sha256", "generation_config_sha256", "hardware_fingerprint", "runtime_config_sha256", "target_revision", "tokenizer_revision", "gpu_count", "tp_size", "batch_size", "concurrency", "cache_policy", "actual_input_tokens"]


def _fail(message: Column, kind: str = "string") -> Column:
    return F.raise_error(message).cast(kind)


def coextensive(rows: DataFrame, method: str, sample: str, reference: str, measures: Sequence[str]) -> DataFrame:
    """method, sample, and for each measure its own and the reference's (`ref_`): every method must cover the same samples.

    A repeated or failed row, a measure that is no finite positive number, and a sample that the reference or a method
    lacks fail the job with their place. Counts are pre-aggregated; nothing is gathered.
    """
    place = F.concat(F.col(method).cast("string"), F.lit("/"), F.col(sample).cast("string"))
    bad = F.when(F.col("_n") > 1, _fail(F.concat(F.lit("duplicate record: "), place))).when(F.coalesce(F.col("status"), F.lit("success")) != "success", _fail(F.concat(F.lit("failed output: "), place)))
    for m in measures:
        odd = ~F.coalesce((F.col(m) > 0) & (F.col(m).cast("double") < float("inf")), F.lit(False))
        bad = bad.when(odd, _fail(F.concat(F.lit(f"{m} is not positive: "), place)))
    once = rows.groupBy(method, sample).agg(F.count("*").alias("_n"), F.first("status").alias("status"), *[F.first(m).alias(m) for m in measures])
    checked = once.withColumn("_bad", bad).where(F.col("_bad").isNull()).drop("_n", "_bad", "status")
    ref = checked.where(F.col(method) == reference).select(sample, *[F.col(m).alias(f"ref_{m}") for m in measures])
    joined = checked.join(ref, sample, "left")
    extra = F.when(F.col(f"ref_{measures[0]}").isNull(), _fail(F.concat(F.lit("sample coverage mismatch: extra "), place)))
    known = joined.withColumn("_bad", extra).where(F.col("_bad").isNull()).drop("_bad")
    counts = checked.groupBy(method).agg(F.count("*").alias("_have"))
    asked = ref.agg(F.count("*").alias("_want"))
    lacking = counts.join(F.broadcast(asked)).withColumn("_bad", F.when(F.col("_have") != F.col("_want"), _fail(F.concat(F.lit("sample coverage mismatch: "), F.col(method).cast("string"), F.lit(" has "), F.col("_have").cast("string"), F.lit(" of "), F.col("_want").cast("string"))))).where(F.col("_bad").isNull())
    return known.join(F.broadcast(lacking.select(method)), method)


def paired_speed(joined: DataFrame, method: str, prefill: str = "prefill_ms", itl: str = "mean_itl_ms", tokens: str = "output_tokens") -> DataFrame:
    """method, samples, mean_min_tokens, dsr, esr of `coextensive` rows: the shared prefill, the mean time a token, the smaller length."""
    g = joined.groupBy(method).agg(F.count("*").alias("samples"), F.avg(f"ref_{prefill}").alias("p"), F.avg(f"ref_{itl}").alias("a"), F.avg(itl).alias("b"), F.avg(F.least(tokens, f"ref_{tokens}")).alias("n"))
    p, a, b, n = (F.col(c) for c in "pabn")
    return g.select(method, "samples", F.round(n, 4).alias("mean_min_tokens"), F.round(a / b, 4).alias("dsr"), F.round((p + a * n) / (p + b * n), 4).alias("esr"))


def annotated(rows: DataFrame, keys: Sequence[str], method: str, reference: str, ids: str = "output_token_ids") -> DataFrame:
    """Successful rows with greedy_token_match, token_lcs_overlap, first_mismatch_token and reference_tokens, null without a reference row.

    `keys` are dataset, sample and repeat; of several reference rows the last by `ids` counts. Failed rows stay
    without annotations.
    """
    ref = rows.where((F.col(method) == reference) & (F.col("status") == "success")).groupBy(*keys).agg(F.max(ids).alias("_ref"))
    joined = rows.join(ref, list(keys), "left")
    there = (F.col("status") == "success") & F.col("_ref").isNotNull()
    own = F.coalesce(F.col(ids), F.array().cast(rows.schema[ids].dataType))
    lcs = X.lcs(F.when(there, F.col("_ref")), F.when(there, own))
    made = joined.withColumn("_lcs", lcs).withColumn("reference_tokens", F.when(there, F.size("_ref")))
    return made.withColumn("greedy_token_match", F.when(there, F.col("_ref") == own)).withColumn("token_lcs_overlap", F.when(there & (F.size("_ref") > 0), F.col("_lcs") / F.size("_ref"))).withColumn("first_mismatch_token", F.when(there, A.first_mismatch(F.col("_ref"), own))).drop("_ref")


def parity(annotated_rows: DataFrame, keys: Sequence[str], digits: int = 6) -> DataFrame:
    """keys, compared, exact_matches, exact_match_rate, token_lcs_overlap (weighted by the references' lengths), pooled_lcs_overlap.

    The weighted overlap takes rows whose reference has tokens; the pooled one divides all common tokens by all
    reference tokens. Without any both are null.
    """
    n, exact = F.count("greedy_token_match"), F.count_if("greedy_token_match")
    weighted = F.sum(F.col("token_lcs_overlap") * F.col("reference_tokens"))
    base = F.sum(F.when(F.col("token_lcs_overlap").isNotNull(), F.col("reference_tokens")))
    pooled = F.try_divide(F.sum(F.when(F.col("reference_tokens").isNotNull(), F.col("_lcs"))).cast("double"), F.sum("reference_tokens"))
    return annotated_rows.groupBy(*keys).agg(n.alias("compared"), exact.alias("exact_matches"), F.round(F.try_divide(exact.cast("double"), n), digits).alias("exact_match_rate"), F.round(F.try_divide(weighted, base), digits).alias("token_lcs_overlap"), F.round(pooled, digits).alias("pooled_lcs_overlap"))


def guarded(rows: DataFrame, keys: Sequence[str], method: str, reference: str, time: str = "e2e_ms", match: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, counters): successful rows with the reference row of the same key as structs `ref` and `met`.

    A row goes to the first counter that holds: unpaired (no reference row), mismatched (`match`, by default equal
    input tokens and source tokens that are equal or unknown on both sides), invalid_timing (a time is no finite
    positive number). Of several reference rows the last by time counts.
    """
    good = rows.where(F.col("status") == "success")
    others = [c for c in rows.columns if c not in keys]
    ref = good.where(F.col(method) == reference).groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(time)).alias("ref"))
    met = good.where(F.col(method) != reference).select(*keys, F.col(method), F.struct(*others).alias("met"))
    if match is None:
        match = F.col("ref.input_tokens") == F.col("met.input_tokens")
        if "source_input_tokens" in rows.columns:
            match = match & F.col("ref.source_input_tokens").eqNullSafe(F.col("met.source_input_tokens"))
    positive = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    state = F.when(F.col("ref").isNull(), "unpaired").when(~F.coalesce(match, F.lit(False)), "mismatched").when(~(positive(f"ref.{time}") & positive(f"met.{time}")), "invalid_timing").otherwise("paired")
    told = met.join(ref, list(keys), "left").withColumn("state", state)
    counters = told.groupBy(method).agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("paired", "unpaired", "mismatched", "invalid_timing")])
    return told.where("state = 'paired'").drop("state"), counters


def sidecar(rows: DataFrame, expected: DataFrame, sample: str = "sample_id", identity: Sequence[str] = SIDECAR) -> DataFrame:
    """A sidecar's rows, one per expected sample; missing, extra and repeated samples, another contract, a failure or another identity fail.

    `expected` has a row per sample with what is known of its identity; null is not known. Extra columns stay.
    """
    have = rows.groupBy(sample).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in rows.columns if c != sample])).alias("_row"))
    known = [c for c in identity if c in expected.columns and c in rows.columns]
    want = expected.select(sample, F.struct(F.lit(1).alias("_there"), *known).alias("_want"))
    joined = have.join(want, sample, "full_outer")
    place = F.coalesce(F.col(sample).cast("string"), F.lit("(null)"))
    status = F.coalesce(F.col("_row.status"), F.lit("success")) if "status" in rows.columns else F.lit("success")
    bad = F.when(F.col(sample).isNull(), _fail(F.lit("a sidecar row has no sample id"))).when(F.col("_n") > 1, _fail(F.concat(F.lit("duplicate sample: "), place)))
    bad = bad.when(F.col("_n").isNull(), _fail(F.concat(F.lit("sample coverage mismatch: missing "), place))).when(F.col("_want").isNull(), _fail(F.concat(F.lit("sample coverage mismatch: extra "), place)))
    if "contract_version" in rows.columns:
        bad = bad.when(~F.col("_row.contract_version").eqNullSafe(2), _fail(F.concat(F.lit("not contract version 2: "), place)))
    bad = bad.when(status != "success", _fail(F.concat(F.lit("failed sample: "), place)))
    for c in known:
        bad = bad.when(F.col(f"_want.{c}").isNotNull() & ~F.col(f"_row.{c}").eqNullSafe(F.col(f"_want.{c}")), _fail(F.concat(F.lit(f"fingerprint mismatch of {c}: "), place)))
    return joined.withColumn("_bad", bad).where(F.col("_bad").isNull()).select(sample, "_row.*")


def nested_reference(rows: DataFrame, field: str, method: str, keep: Sequence[str] = ("sample_id", "dataset")) -> DataFrame:
    """The struct `field` of each row that has one as a row of its own, under the outer keys, with `method` and contract version 2.

    The outer run_id counts where it is there, else the struct's own.
    """
    inner = [c for c in rows.schema[field].dataType.names if c not in {*keep, "method", "contract_version", "run_id"}]
    own = F.col(f"{field}.run_id") if "run_id" in rows.schema[field].dataType.names else F.lit(None).cast("string")
    run = F.coalesce(F.col("run_id"), own) if "run_id" in rows.columns else own
    return rows.where(F.col(field).isNotNull()).select(*keep, *[F.col(f"{field}.{c}").alias(c) for c in inner], run.alias("run_id"), F.lit(method).alias("method"), F.lit(2).alias("contract_version"))


def pending(expected: DataFrame, files: DataFrame, index: str = "index", name: str = "name", pattern: str = r"(\d+)\.[A-Za-z0-9]+$") -> DataFrame:
    """Expected rows whose number is in no file's name; names without a number count for nothing."""
    done = files.select(F.regexp_extract(name, pattern, 1).try_cast("long").alias(index)).where(F.col(index).isNotNull()).distinct()
    return expected.join(done, expected[index].cast("long") == done[index], "left_anti")


def evaluation_set(records: DataFrame, low: float, high: float, selected: int) -> DataFrame:
    """problem, id: what is wrong with an evaluation set as a whole; an empty result is a valid set.

    missing_id, duplicate_id, empty_document, empty_reference, empty_answers, out_of_bounds, missing_bin,
    reference_not_shorter by record, and wrong_count (id null) once if it has not `selected` records.
    """
    n = records.groupBy("id").agg(F.count("*").alias("_n"))
    counted = records.join(n, records["id"].eqNullSafe(n["id"])).drop(n["id"])
    words, ref = F.coalesce("document_words", F.lit(0)), F.coalesce("reference_words", F.lit(0))
    found = F.when(V.blank(F.col("id")), F.array(F.lit("missing_id"))).otherwise(
        V.problems(
            ("duplicate_id", F.col("_n") > 1), ("empty_document", V.blank(F.col("document"))), ("empty_reference", V.blank(F.col("reference"))), ("empty_answers", F.coalesce(F.size("answers"), F.lit(0)) <= 0),
            ("out_of_bounds", ~words.between(low, high)), ("missing_bin", F.col("length_bin").isNull()), ("reference_not_shorter", ref >= words),
        )
    )
    rows = counted.select(F.explode(found).alias("problem"), "id")
    return rows.unionByName(records.agg(F.count("*").alias("n")).where(F.col("n") != selected).select(F.lit("wrong_count").alias("problem"), F.lit(None).cast("string").alias("id")))


def profile(records: DataFrame, datasets: Sequence[str], expected: int, digests: DataFrame | None = None) -> DataFrame:
    """dataset, rows, problem of a committed profile: unknown_dataset, wrong_count, checksum_mismatch, bad_record, or null.

    A record is bad without id, document, reference or answers, or if its reference is not shorter. `digests` has
    dataset, expected and observed.
    """
    bad = V.blank(F.col("id")) | V.blank(F.col("document")) | V.blank(F.col("reference")) | (F.col("reference_words") >= F.col("document_words"))
    have = records.groupBy("dataset").agg(F.count("*").alias("rows"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"))
    spark = records.sparkSession
    want = spark.createDataFrame([(d,) for d in datasets], "dataset string").withColumn("_known", F.lit(True))
    every = have.join(want, "dataset", "full_outer")
    every = every.join(digests.select("dataset", (F.col("expected").isNotNull() & (F.col("expected") != F.col("observed"))).alias("_off")), "dataset", "left") if digests is not None else every.withColumn("_off", F.lit(False))
    problem = V.first_problem(("unknown_dataset", F.col("_known").isNull()), ("wrong_count", F.coalesce("rows", F.lit(0)) != expected), ("checksum_mismatch", F.col("_off")), ("bad_record", F.col("bad") > 0))
    return every.select("dataset", F.coalesce("rows", F.lit(0)).alias("rows"), problem.alias("problem"))


def feature_problem(ids: Column, mask: Column, states: Column, length: int, width: int) -> Column:
    """The first thing wrong with a feature record: missing_field, empty_sequence, too_long, length_mismatch, width_mismatch, bad_mask, nothing_supervised."""
    n = F.size(ids)
    return V.first_problem(
        ("missing_field", ids.isNull() | mask.isNull() | states.isNull()), ("empty_sequence", n == 0), ("too_long", n > length), ("length_mismatch", (F.size(mask) != n) | (F.size(states) != n)),
        ("width_mismatch", F.exists(states, lambda s: F.coalesce(F.size(s) != width, F.lit(True)))), ("bad_mask", F.exists(mask, lambda m: ~F.coalesce(m.isin(0, 1), F.lit(False)))), ("nothing_supervised", ~A.adjacent_true(mask)),
    )


def enabled(rows: DataFrame, name: str, disabled: Sequence[str]) -> DataFrame:
    """Rows of baselines that are not disabled; one that is asked for by name and disabled fails where `rows` has it as `requested`."""
    off = F.col(name).isin(*disabled) if disabled else F.lit(False)
    if "requested" in rows.columns:
        bad = F.when(off & F.col("requested"), _fail(F.concat(F.lit("disabled: "), F.col(name).cast("string"))))
        return rows.withColumn("_bad", bad).where(F.col("_bad").isNull() & ~off).drop("_bad")
    return rows.where(~off)


def usable(rows: DataFrame, keys: Sequence[str], time: str = "request_wall_ms") -> DataFrame:
    """keys, usable: whether a reference has at least one successful row with a finite positive time."""
    timed = (F.coalesce(F.col("status"), F.lit("success")) == "success") & (F.col(time) > 0) & (F.col(time) < float("inf"))
    return rows.groupBy(*keys).agg(F.coalesce(F.some(timed), F.lit(False)).alias("usable"))


def stamped(rows: DataFrame, source: DataFrame, stamp: dict[str, Column], keys: Sequence[str], backfill: Sequence[str]) -> DataFrame:
    """A runner's output rows under canonical keys: `stamp` overwrites, and what is null or lacking comes from the source record."""
    out = rows
    for c, value in stamp.items():
        out = out.withColumn(c, value)
    known = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in backfill])
    joined = out.join(known, list(keys), "left")
    for c in backfill:
        joined = joined.withColumn(c, F.coalesce(F.col(c), F.col(f"_s_{c}")) if c in out.columns else F.col(f"_s_{c}")).drop(f"_s_{c}")
    return joined


def identified(rows: DataFrame, columns: dict[str, Column], prompt_ids: str | None = None, prefix: bytes = b"") -> DataFrame:
    """Rows with the identity columns of contract version 2; given ones stay, lacking ones come from `columns`, else null.

    With `prompt_ids` the prompt's hash and length are made of its token ids.
    """
    from corpusloom.operators.pairing import REQUIRED

    out = rows.withColumn("contract_version", F.lit(2))
    if prompt_ids:
        columns = {"prompt_token_sha256": X.token_ids_hash(F.col(prompt_ids), prefix), "actual_input_tokens": F.size(prompt_ids)} | columns
    for c in dict.fromkeys([*REQUIRED, *columns]):
        made = columns.get(c, F.lit(None).cast("string"))
        out = out.withColumn(c, F.coalesce(F.col(c), made.cast(out.schema[c].dataType)) if c in out.columns else made)
    return out


def extracted(rows: DataFrame, payload: str, paths: dict[str, dict[str, list[str]]], method: str = "method") -> DataFrame:
    """Rows with the fields that each method keeps elsewhere in its JSON payload: `paths` is method -> field -> JSON paths in order."""
    names = dict.fromkeys(f for fields in paths.values() for f in fields)
    out = rows
    for f in names:
        chain = F.when(F.lit(False), "")
        for m, fields in paths.items():
            if f in fields:
                chain = chain.when(F.col(method) == m, F.coalesce(*[F.get_json_object(payload, p) for p in fields[f]]))
        out = out.withColumn(f, chain)
    return out
