"""JSON-lines readers. Records are read as text, so that a key that is present but null differs from an absent one."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as X

#: Fixed: names a field may go by, the first that is present counts.
DOCUMENT = ["document", "text", "input", "article", "context", "src"]
SUMMARY = ["summary", "output", "target", "gold", "tgt", "reference"]
PROMPT = ["prompt", "input", "question", "instruction", "document", "text"]
ANSWER = ["answer", "output", "response", "summary", "reference"]
RECORD_ID = ["doc_id", "sample_id", "question_id", "example_id", "id"]
SUFFIXES = (".jsonl", ".ndjson", ".json", ".txt", ".jsonl.gz", ".ndjson.gz", ".json.gz", ".txt.gz")


def discover(root: str | Path, suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """All shards below a folder, by relative path; hidden files and folders are skipped; a single file is itself."""
    root = Path(root)
    if root.is_file():
        return [str(root)]
    found = [p for p in root.rglob("*") if p.is_file() and p.name.endswith(suffixes) and not any(part.startswith(".") for part in p.relative_to(root).parts)]
    if not found:
        raise FileNotFoundError(f"no shard below {root}")
    return [str(p) for p in sorted(found, key=lambda p: p.relative_to(root).as_posix())]


def resolve(path: str | Path) -> Path:
    """A path, or the one path that a small text file holds, relative to that file."""
    path = Path(path)
    if path.is_dir() or path.suffix not in ("", ".path", ".txt") or path.stat().st_size > 4096:
        return path
    lines = [line.strip() for line in path.read_text(encoding="utf-8").splitlines() if line.strip()]
    if len(lines) != 1 or lines[0].startswith("{"):
        return path
    target = Path(lines[0])
    return target if target.is_absolute() else (path.parent / target).resolve()


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, line (1-based, physical), value of every line, plain or gzipped.

    A plain file is read in blocks by many tasks: lines are counted within their block as they stream by, and the lines
    of the blocks before, one number a block, are added. A gzipped file can't be split, but is streamed as well.
    """
    f = spark.read.option("lineSep", "\n").text(paths)
    raw = f.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("value"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for b in batches:
            places = []
            for place in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at, n = (at, n + 1) if place == at else (place, 1)
                places.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64())], ["file", "block", "value", "nth"])

    own = raw.mapInArrow(count, "file string, block long, value string, nth long")
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return own.join(offsets, ["file", "block"]).select("file", (F.col("nth") + F.col("before")).alias("line"), "value")


def objects(rows: DataFrame) -> DataFrame:
    """`rows` without blank lines, with keys (of a JSON object, null for anything else) and whether the line is JSON at all."""
    full = rows.where(~X.strip(F.col("value")).eqNullSafe(""))
    return full.withColumn("keys", F.json_object_keys("value")).withColumn("valid", F.expr("try_parse_json(value) IS NOT NULL"))


def strict(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """file, line and the fields; a line that is no JSON object fails the job with its place."""
    rows = objects(lines(spark, paths))
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    checked = F.when(F.col("valid") & F.col("keys").isNotNull(), F.col("value")).otherwise(F.raise_error(F.concat(place, F.lit(": not a JSON object"))).cast("string"))
    return rows.select("file", "line", F.from_json(checked, schema).alias("r")).select("file", "line", "r.*")


def lenient(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """Blank lines and values that are no objects are skipped; a line that is no JSON still fails."""
    rows = objects(lines(spark, paths))
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    checked = F.when(F.col("valid"), F.col("value")).otherwise(F.raise_error(F.concat(place, F.lit(": not JSON"))).cast("string"))
    return rows.where(F.col("keys").isNotNull() | ~F.col("valid")).select("file", "line", F.from_json(checked, schema).alias("r")).select("file", "line", "r.*")


def torn_tail(spark: SparkSession, paths: str | list[str], schema: T.StructType | str) -> DataFrame:
    """The lines of each file before its first one that can't be decoded: what a crashed writer left whole."""
    rows = objects(lines(spark, paths))
    bad = rows.where(~F.col("valid") | F.col("keys").isNull()).groupBy("file").agg(F.min("line").alias("torn"))
    kept = rows.join(bad, "file", "left").where(F.col("torn").isNull() | (F.col("line") < F.col("torn")))
    return kept.select("file", "line", F.from_json("value", schema).alias("r")).select("file", "line", "r.*")


def aliased(names: list[str], value: str = "value", keys: str = "keys") -> Column:
    """The string under the first of `names` that the object has; one that is there but null stays null."""
    chain = F.when(F.lit(False), "")
    for n in names:
        chain = chain.when(F.array_contains(keys, n), F.get_json_object(value, f"$.{n}"))
    return chain


def summary_records(spark: SparkSession, paths: str | list[str], most: int | None = None) -> DataFrame:
    """id, document, summary, source_file, source_line, source_schema, unicode_nfc_normalized, suspected_mojibake.

    Three layouts (input/output, id/text/summary, id/document/summary) are told by their keys. Texts are stripped and
    composed; a missing, null or blank text fails with its place; a record without id is `sample-` and its line.
    `most` keeps the first lines of each file.
    """
    rows = objects(lines(spark, paths))
    rows = rows.where(F.col("line") <= most) if most is not None else rows
    has = lambda *ks: F.forall(F.array(*[F.lit(k) for k in ks]), lambda k: F.array_contains("keys", k))
    layout = F.when(has("input", "output"), "input_output").when(has("text", "summary"), "id_text_summary").when(has("document", "summary"), "id_document_summary").otherwise("aliases")
    place = F.concat_ws(":", "file", F.col("line").cast("string"))
    raw = rows.select("file", "line", layout.alias("source_schema"), aliased(["id"]).alias("id"), aliased(DOCUMENT).alias("d"), aliased(SUMMARY).alias("s"))
    text = raw.select("*", X.nfc(X.strip(F.col("d"))).alias("document"), X.nfc(X.strip(F.col("s"))).alias("summary"))
    need = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(F.raise_error(F.concat(place, F.lit(f": no {c}"))).cast("string"))
    changed = (F.col("document") != X.strip(F.col("d"))) | (F.col("summary") != X.strip(F.col("s")))
    odd = X.mojibake_by_pattern(F.col("document")) | X.mojibake_by_pattern(F.col("summary"))
    return text.select(
        F.coalesce("id", F.format_string("sample-%08d", F.col("line"))).alias("id"), need("document").alias("document"), need("summary").alias("summary"), F.col("file").alias("source_file"), F.col("line").alias("source_line"), "source_schema", changed.alias("unicode_nfc_normalized"), odd.alias("suspected_mojibake")
    )


def prompts(spark: SparkSession, paths: str | list[str], most: int | None = None) -> DataFrame:
    """id, prompt, answer, raw of the records with a prompt, the first non-blank alias of each; the order is file and line."""
    rows = objects(lines(spark, paths)).where(F.col("keys").isNotNull())
    first = lambda names: F.coalesce(*[F.nullif(X.strip(F.get_json_object("value", f"$.{n}")), F.lit("")) for n in names])
    made = rows.select("file", "line", first(RECORD_ID).alias("id"), first(PROMPT).alias("prompt"), first(ANSWER).alias("answer"), F.col("value").alias("raw")).where("prompt IS NOT NULL")
    return made.orderBy("file", "line").limit(most) if most is not None else made


def run_records(spark: SparkSession, root: str, schema: T.StructType | str, skip: str = r"/(inputs|logs|attempts)/") -> DataFrame:
    """file, line, baseline, dataset and fields of all result rows of a run folder; trailers (type = summary) are dropped."""
    rows = lenient(spark, discover(root, (".jsonl",)), schema).where(~F.col("file").rlike(skip))
    name = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    folder = F.regexp_extract("file", r"([^/]+)/[^/]+\.jsonl$", 1)
    kept = rows.where(~F.coalesce(F.col("type"), F.lit("")).eqNullSafe("summary")) if "type" in rows.columns else rows
    return kept.withColumn("baseline", folder).withColumn("file_dataset", name)


def method_and_dataset(name: Column, datasets: list[str]) -> Column:
    """(method, dataset) of a file name `<method>_<dataset>`, the longest dataset that fits; null if none does."""
    chain = F.when(F.lit(False), F.struct(F.lit("").alias("method"), F.lit("").alias("dataset")))
    for d in sorted(datasets, key=lambda d: (-len(d), d)):
        method = F.substr(name, F.lit(1), F.length(name) - F.lit(len(d) + 1))
        chain = chain.when(F.endswith(name, F.lit(f"_{d}")), F.struct(method.alias("method"), F.lit(d).alias("dataset")))
    return chain


def pins(spark: SparkSession, path: str) -> DataFrame:
    """package, version of a requirements file: exact pins and wheel addresses; two versions of a package are an error."""
    rows = lines(spark, path).select(F.regexp_replace("value", r"\s*(#.*)?$", "").alias("v")).where("v <> ''")
    pin = F.regexp_extract("v", r"^([A-Za-z0-9._-]+)(?:\[[^\]]*\])?==([^\s;]+)", 1)
    wheel = F.regexp_extract("v", r"/([A-Za-z0-9._]+)-([^-/]+)-[^/]*\.whl", 1)
    made = rows.select(
        F.lower(F.regexp_replace(F.when(pin != "", pin).otherwise(wheel), "[_.]", "-")).alias("package"),
        F.when(pin != "", F.regexp_extract("v", r"==([^\s;]+)", 1)).otherwise(F.regexp_extract("v", r"/[A-Za-z0-9._]+-([^-/]+)-[^/]*\.whl", 1)).alias("version"),
    ).where("package <> ''")
    versions = made.groupBy("package").agg(F.collect_set("version").alias("versions"))
    one = F.when(F.size("versions") == 1, F.element_at("versions", 1)).otherwise(F.raise_error(F.concat(F.lit("conflicting pins of "), F.col("package"))).cast("string"))
    return versions.select("package", one.alias("version"))


def telemetry(rows: DataFrame, value: str = "value") -> DataFrame:
    """The nine fields of device telemetry lines; lines with another number of fields are skipped."""
    names = ["index", "name", "uuid", "memory_total", "memory_used", "utilization", "temperature", "power", "clock"]
    parts = F.split(value, r"\s*,\s*")
    kept = rows.where(F.size(parts) == len(names))
    number = lambda c: F.regexp_extract(c, r"^-?[0-9.]+", 0).try_cast("double")
    return kept.select(*[(parts[i] if n in ("name", "uuid") else number(parts[i])).alias(n) for i, n in enumerate(names)])


def fingerprint(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, size, modified, sha256 of files."""
    f = spark.read.format("binaryFile").load(paths)
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def code_fingerprint(spark: SparkSession, root: str, names: list[str]) -> str:
    """SHA-256 over path, NUL and content of files in their given order; a missing one counts as a mark."""
    import hashlib

    h = hashlib.sha256()
    for n in names:
        p = Path(root, n)
        h.update(n.encode() + b"\0" + (p.read_bytes() if p.is_file() else b"<missing>"))
    return h.hexdigest()


def natural(paths: list[str]) -> list[str]:
    """By the first number in the file name, then by name."""
    return sorted(paths, key=lambda p: (int(m[0]) if (m := re.search(r"\d+", Path(p).name)) else -1, Path(p).name))


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """`df`, which must have a row."""
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def feature_files(spark: SparkSession, root: str, length: int, width: int) -> DataFrame:
    """path, n, problem of the `.npz` feature files below a folder: input_ids, loss_mask and hidden_states of one example each.

    A file is read when its row is asked for, in the task that has it; the problem is that of
    `contracts.feature_problem`, unreadable for a file that is none, null for a good one.
    """
    import io

    import numpy as np
    import pandas as pd

    from corpusloom.operators.contracts import feature_problem

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    with np.load(io.BytesIO(content), allow_pickle=False) as z:
                        got = [z[k].tolist() if k in z else None for k in ("input_ids", "loss_mask", "hidden_states")]
                    out.append((path, *got, False))
                except (ValueError, OSError):
                    out.append((path, None, None, None, True))
            yield pd.DataFrame(out, columns=["path", "ids", "mask", "states", "bad"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(root).select("path", "content")
    rows = files.mapInPandas(load, "path string, ids array<long>, mask array<long>, states array<array<double>>, bad boolean")
    problem = feature_problem(F.col("ids"), F.col("mask"), F.col("states"), length, width)
    return rows.select("path", F.size("ids").alias("n"), F.when(F.col("bad"), "unreadable").otherwise(problem).alias("problem"))
