"""Writers: data stays distributed and is committed by Spark; only small reports are put together at the driver."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """JSON lines with sorted keys; non-ASCII text stays as it is. `by` makes one folder per value."""
    ordered = df.select(*sorted(c for c in df.columns if c not in (by or [])), *(by or []))
    writer = ordered.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).json(path)


def digest(path: str) -> str:
    """SHA-256 over the bytes of a folder's data files in name order."""
    h = hashlib.sha256()
    for p in sorted(Path(path).rglob("part-*")):
        if not p.name.endswith(".crc"):
            h.update(p.read_bytes())
    return h.hexdigest()


def publish_json(path: str | Path, value: object) -> None:
    """A small JSON file, whole or not at all: written beside and renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(f".{path.name}.tmp")
    tmp.write_text(json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, default=str), encoding="utf-8")
    os.replace(tmp, path)


def publish_generation(df: DataFrame, root: str, name: str) -> str:
    """A new immutable generation, and then the pointer to it: readers see the old or the new one."""
    df.write.mode("errorifexists").parquet(os.path.join(root, name))
    publish_json(os.path.join(root, "CURRENT.json"), {"generation": name})
    return os.path.join(root, name)


def merge_ranked(shards: list[DataFrame], index: str = "_source_index") -> DataFrame:
    """Shards of one run in source order without their index; an index that occurs twice fails the job.

    The check is part of the plan: repeats are counted by key and the count is joined back.
    """
    every, *rest = shards
    for s in rest:
        every = every.unionByName(s, allowMissingColumns=True)
    counts = every.groupBy(index).agg(F.count("*").alias("_n"))
    once = F.when(F.col("_n") == 1, F.col(index)).otherwise(F.raise_error(F.concat(F.lit("index occurs twice: "), F.col(index).cast("string"))).cast(every.schema[index].dataType))
    checked = every.join(counts, index).withColumn(index, once)
    return checked.orderBy(index).drop(index, "_n")


def merge_feature_shards(manifests: DataFrame, shards: list[DataFrame]) -> DataFrame:
    """The union of shards whose manifests are all alike and whose names differ."""
    if manifests.drop("shard").distinct().count() != 1:
        raise ValueError("the shards' manifests differ")
    if "shard" in manifests.columns and manifests.select("shard").distinct().count() != manifests.count():
        raise ValueError("a shard's name occurs twice")
    out, *rest = shards
    for s in rest:
        out = out.unionByName(s)
    return out


def canonical_order(df: DataFrame, order: DataFrame, keys: list[str], position: str = "position") -> DataFrame:
    """`df` sorted by the position its key has in another table, unknown keys last."""
    return df.join(order.select(*keys, position), keys, "left").orderBy(F.col(position).asc_nulls_last(), *keys).drop(position)


def flat_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with nested columns as JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode(mode).csv(path, header=True)


def markdown(df: DataFrame, title: str, most: int = 500) -> str:
    """A small table as Markdown; more than `most` rows are refused, a report is a summary."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a report")
    shown = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *("| " + " | ".join(map(shown, r)) + " |" for r in rows), ""])


def bars(histogram: DataFrame, label: str, count: str, width: int = 40, most: int = 200) -> str:
    """A histogram of few bins as text; more than `most` are refused."""
    rows = histogram.orderBy(label).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} bins in a histogram")
    top = max((r[count] for r in rows), default=1) or 1
    return "\n".join(f"{r[label]!s:>12} {'#' * round(width * r[count] / top)} {r[count]}" for r in rows)


def baseline_shape(df: DataFrame, layout: str, prompt: str = "prompt", identity: str = "id") -> DataFrame:
    """Records as a runner wants them: `turns` (question_id, turns array), `text` (id, text) or `prompt` (id, prompt)."""
    shapes = {"turns": [F.col(identity).alias("question_id"), F.array(prompt).alias("turns")], "text": [F.col(identity), F.col(prompt).alias("text")], "prompt": [F.col(identity), F.col(prompt)]}
    return df.select(*shapes[layout])


def audited(df: DataFrame, issues: Column, name: str = "metric_audit") -> DataFrame:
    """`df` with its issues as a nested audit column."""
    return df.withColumn(name, F.struct(issues.alias("issues"), (F.size(issues) == 0).alias("valid")))


def json_safe(df: DataFrame) -> DataFrame:
    """`df` with NaN and infinite numbers as null, in columns and in arrays of numbers: JSON has no others."""
    fine = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        out.append((fine(c) if kind in ("double", "float") else F.transform(c, fine) if kind in ("array<double>", "array<float>") else c).alias(f.name))
    return df.select(*out)


def append_with_summary(df: DataFrame, path: str, summary: dict) -> None:
    """Append rows as JSON lines, and after them one row of type summary in a file of its own, written last."""
    jsonl(json_safe(df), path, "append")
    line = json.dumps({"type": "summary", **summary}, ensure_ascii=False, sort_keys=True, default=str, allow_nan=False)
    df.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(path)


def _files(df: DataFrame, path: str):
    """The Hadoop file system of a path and the path in its form: local, shared or an object store alike."""
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), p


def publish_staged(frames: dict[str, DataFrame], root: str, force: bool = False) -> list[str]:
    """Several Parquet outputs under `root`, all written aside first and then moved to their names.

    If one of the names is taken nothing is written, unless `force`, which replaces them. A failed write leaves the old
    outputs as they were and removes what was staged.
    """
    if not frames:
        return []
    first = next(iter(frames.values()))
    fs, _ = _files(first, root)
    path = lambda *parts: _files(first, os.path.join(root, *parts))[1]
    taken = [n for n in frames if fs.exists(path(n))]
    if taken and not force:
        raise FileExistsError(f"already published: {', '.join(taken)}")
    stage = f".staging-{uuid.uuid4().hex}"
    try:
        for name, df in frames.items():
            df.write.parquet(os.path.join(root, stage, name))
        for name in frames:
            fs.delete(path(name), True)
            fs.rename(path(stage, name), path(name))
    finally:
        fs.delete(path(stage), True)
    return [os.path.join(root, n) for n in frames]


def report(title: str, sections: dict[str, DataFrame | str], most: int = 500) -> str:
    """A Markdown report of several small tables or texts under their headings: run, diagnostics and comparison reports."""
    parts = [f"# {title}", ""]
    for name, content in sections.items():
        body = content if isinstance(content, str) else markdown(content, "", most).split("\n", 2)[2]
        parts += [f"## {name}", "", body.rstrip("\n"), ""]
    return "\n".join(parts)


def report_bundle(rows: DataFrame, audit: dict, folder: str, title: str, most: int = 500) -> None:
    """`audit.json`, `rows` as CSV with nested columns as JSON, and `report.md`, each whole or not at all."""
    flat_csv(rows, os.path.join(folder, "rows"), "overwrite")
    publish_json(os.path.join(folder, "audit.json"), audit)
    nested = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("struct", "array", "map")}
    text = report(title, {"Rows": rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns])}, most)
    target = Path(folder, "report.md")
    tmp = target.with_name(".report.md.tmp")
    tmp.write_text(text, encoding="utf-8")
    os.replace(tmp, target)


def merge_parallel(shards: dict[str, DataFrame], order: DataFrame, keys: list[str], counters: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of all shards in canonical order with their shard, totals): totals has rows and summed counters per shard and for all."""
    every = None
    for name, s in shards.items():
        one = s.withColumn("shard", F.lit(name))
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    sums = [F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in counters]]
    totals = every.groupBy("shard").agg(*sums).unionByName(every.agg(*sums).withColumn("shard", F.lit("all")))
    return canonical_order(every, order, keys), totals


def audit_beside(df: DataFrame, issues: Column, path: str, keys: list[str], mode: str = "errorifexists") -> None:
    """The rows with their audit inside, and beside them (`<path>.audit`) the keys and issues of the rows that have any."""
    made = audited(df, issues)
    jsonl(made, path, mode)
    jsonl(made.where(~F.col("metric_audit.valid")).select(*keys, F.col("metric_audit.issues").alias("issues")), f"{path}.audit", mode)
