"""Structured Streaming jobs: resumable scans, bounded reservoirs, complete windows, event-time aggregates."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.functions.text import hash_score


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def guard(checkpoint: str, config: dict) -> None:
    """Refuse to resume a checkpoint with another configuration; the first run leaves its fingerprint there."""
    mark = Path(checkpoint, "_config.json")
    if mark.exists():
        if json.loads(mark.read_text())["fingerprint"] != fingerprint(config):
            raise ValueError(f"{checkpoint} belongs to another configuration")
        return
    mark.parent.mkdir(parents=True, exist_ok=True)
    tmp = mark.with_suffix(".tmp")
    tmp.write_text(json.dumps({"fingerprint": fingerprint(config), "config": config}, default=str))
    os.replace(tmp, mark)


def scan(spark: SparkSession, path: str, schema: str, files: int = 64, kind: str = "parquet") -> DataFrame:
    """A stream of the files of a folder, at most `files` a batch; which were read is kept in the checkpoint."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", f"*.{kind}").load(path)


def bottom_k(df: DataFrame, keys: list[str], identity: str, seed: int, k: int) -> DataFrame:
    """The k rows of each key with the lowest hash scores; equal rows count once."""
    score = hash_score(F.lit(str(seed)), *[F.col(c).cast("string") for c in keys], F.col(identity).cast("string"))
    w = Window.partitionBy(*keys).orderBy("score", identity)
    rows = df.withColumn("score", score).dropDuplicates([*keys, identity])
    return rows.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= k).drop("_nth")


def reservoir(stream: DataFrame, keys: list[str], identity: str, k: int, out: str, checkpoint: str, seed: int = 42) -> StreamingQuery:
    """Keep the bottom-k sample of all that has come in `out`, batch by batch.

    Each batch merges its own bottom k with the last generation and writes a new one, named by the batch, so that a
    repeated batch gives the same; the sample depends on the rows alone, not on batches or their order.
    """
    guard(checkpoint, {"keys": keys, "identity": identity, "k": k, "seed": seed})

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = bottom_k(batch, keys, identity, seed, k)
        if number:
            kept = spark.read.parquet(f"{out}/batch={number - 1}").drop("score")  # only the first batch may find nothing
            own = bottom_k(kept.unionByName(own.drop("score")), keys, identity, seed, k)
        own.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(out: str) -> str:
    """The last generation a reservoir wrote."""
    return max((p for p in Path(out).glob("batch=*")), key=lambda p: int(p.name.split("=")[1])).as_posix()


def windows(stream: DataFrame, key: str, identity: str, quantum: int) -> DataFrame:
    """key, number, ids: complete windows of `quantum` ids in order of arrival; a partial tail is held.

    State per key: the ids waiting, fewer than `quantum`, and the number of the next window. Repeats are dropped before,
    by `deduplicated`, whose state the watermark bounds.
    """
    kind = stream.schema[key].dataType.simpleString()

    def of(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, held = state.get if state.exists else (0, [])
        held = list(held)
        for f in frames:
            held += f[identity].tolist()
        full = len(held) // quantum
        made = [(k[0], number + i, held[i * quantum : (i + 1) * quantum]) for i in range(full)]
        state.update((number + full, held[full * quantum :]))
        yield pd.DataFrame(made, columns=[key, "number", "ids"])

    return stream.select(key, identity).groupBy(key).applyInPandasWithState(of, f"`{key}` {kind}, number long, ids array<long>", "number long, held array<long>", "append", GroupStateTimeout.NoTimeout)


def deduplicated(stream: DataFrame, keys: list[str], at: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream without repeats within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, keys: list[str], value: str, width: str = "1 hour", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """keys, start, n, total per event-time window; an extension beyond the count windows. Runs on streams and tables alike."""
    w = events.withWatermark(at, late) if events.isStreaming else events
    g = w.groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return g.select(*keys, F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """keys, start, end, n per session of events less than `gap` apart."""
    w = events.withWatermark(at, late) if events.isStreaming else events
    g = w.groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there into Parquet files, exactly once through the checkpoint, and stop."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def listener(report: Callable[[str, int, float], None]):
    """A listener that reports (name, rows, rows a second) of each batch."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event): ...

        def onQueryProgress(self, event):
            p = event.progress
            report(p.name or str(p.id), int(p.numInputRows), float(p.processedRowsPerSecond or 0))

        def onQueryIdle(self, event): ...

        def onQueryTerminated(self, event): ...

    return Progress()
