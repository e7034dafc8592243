"""Folding event sequences: answers that come in pieces, conversations, logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def folded(events: DataFrame, keys: list[str], order: str, ids: str, text: str, finish: str, at: str) -> DataFrame:
    """One row per stream of pieces: mode, output_ids, text, first_at, last_at, complete.

    Ids are cumulative where every piece begins with the one before, else they are differences and joined. The text is
    the last one of cumulative, all of difference streams. A stream without a finish reason is not complete.
    A stream is one answer: its pieces are gathered, answers are spread.
    """
    piece = F.struct(F.col(order).alias("o"), F.col(ids).alias("i"), F.col(text).alias("t"), F.col(finish).alias("f"), F.col(at).alias("at"))
    g = events.groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias("p"))
    p = F.col("p")
    shifted = F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))
    cumulative = F.forall(F.zip_with(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), shifted, lambda a, b: F.slice(b["i"], F.lit(1), F.size(a["i"])) == a["i"]), lambda x: x)
    last = F.element_at(p, -1)
    with_output = F.filter(p, lambda x: F.size(x["i"]) > 0)
    return g.select(
        *keys,
        F.when(cumulative, "cumulative").otherwise("delta").alias("mode"),
        F.when(cumulative, last["i"]).otherwise(F.flatten(F.transform(p, lambda x: x["i"]))).alias("output_ids"),
        F.when(cumulative, last["t"]).otherwise(F.array_join(F.transform(p, lambda x: x["t"]), "")).alias("text"),
        F.try_element_at(with_output, F.lit(1))["at"].alias("first_at"),
        F.try_element_at(with_output, F.lit(-1))["at"].alias("last_at"),
        F.exists(p, lambda x: x["f"].isNotNull()).alias("complete"),
    )


def turns(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per assistant turn of the conversations without a bad turn; what was said before is referred to, not copied.

    Bad is an unknown role or an empty text. A turn's context is the conversation's rows with a lower `turn`; `context`
    joins them where they are asked for. Bad conversations are found by a pre-aggregated count.
    """
    good = F.col(role).isin("user", "assistant", "system", "tool") & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    bad = df.where(~F.coalesce(good, F.lit(False))).select(conversation).distinct()
    return df.where(F.col(role) == "assistant").join(bad, conversation, "left_anti")


def context(asked: DataFrame, df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """`asked` (rows of `turns`) with `context`, the array of what was said before: for the turns that are rendered now."""
    told = df.select(conversation, F.col(turn).alias("_turn"), F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("_said"))
    joined = asked.join(told, conversation, "left")
    before = F.array_sort(F.collect_list(F.when(F.col("_turn") < F.col(turn), F.col("_said"))))
    return joined.groupBy(*asked.columns).agg(before.alias("context"))


def accounting(df: DataFrame, status: str = "status") -> DataFrame:
    """rows, success, error, skipped, balanced: whether the outcomes add up to the input."""
    n = lambda s: F.count_if(F.col(status) == s)
    made = df.agg(F.count("*").alias("rows"), n("success").alias("success"), n("error").alias("error"), n("skipped").alias("skipped"))
    return made.withColumn("balanced", F.col("rows") == F.col("success") + F.col("error") + F.col("skipped"))


def shows(log: DataFrame, marks: list[str], last: int = 65_536, line: str = "line", value: str = "value") -> DataFrame:
    """file, found: whether one of the marks stands in the last bytes of a log, whatever the case.

    Only the last `last` lines of a file can hold them; of these, so many as there are bytes are looked at, the first
    one in part. A mark does not go across lines.
    """
    ends = log.groupBy("file").agg(F.max(line).alias("_end"))
    tail = log.join(ends, "file").where(F.col(line) > F.col("_end") - last)
    later = Window.partitionBy("file").orderBy(F.col(line).desc()).rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length(F.coalesce(F.col(value), F.lit("")))
    left = F.lit(last) - F.coalesce(F.sum(size + 1).over(later), F.lit(0)) - 1
    cut_ = tail.withColumn("_left", left).withColumn("_size", size).where("_left > 0")
    raw = F.substring(F.col(value).cast("binary"), F.greatest(F.col("_size") - F.col("_left"), F.lit(0)).cast("int") + 1, F.lit(1 << 30))
    text = F.lower(F.expr("decode(`_tail`, 'utf-8')"))
    cut_ = cut_.withColumn("_tail", raw)
    hit: Column = F.lit(False)
    for m in marks:
        hit = hit | F.coalesce(F.contains(text, F.lit(m.lower())), F.lit(False))
    return cut_.groupBy("file").agg(F.some(hit).alias("found"))


def fan_out(df: DataFrame, call: Callable[[str, dict], str], endpoints: Sequence[str], workers: int = 8, tries: int = 3, pause: float = 0.5) -> DataFrame:
    """`df` with output, error, endpoint, attempts and history of calling a service for each row.

    Every partition keeps up to `workers` calls under way and gives its rows back in their order. A failed call goes on
    to the next endpoint after a pause that doubles; after `tries` the row has the last error and no output. history
    names each failed attempt. `call` is given an endpoint and the row, and must bear being repeated: a lost task runs
    again.
    """
    import time
    from concurrent.futures import ThreadPoolExecutor

    import pandas as pd

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def ask(at: int, row: dict) -> tuple:
        history: list[str] = []
        for k in range(tries):
            endpoint = endpoints[(at + k) % len(endpoints)]
            try:
                return call(endpoint, row), None, endpoint, k + 1, history
            except Exception as e:  # whatever the service does wrong is told in the row
                history.append(f"{endpoint}: {type(e).__name__}: {e}")
                if k + 1 < tries:
                    time.sleep(pause * 2**k)
        return None, history[-1], endpoint, tries, history

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for f in frames:
                made = list(pool.map(ask, range(len(f)), f.to_dict("records")))
                yield f.assign(**{c: [m[i] for m in made] for i, c in enumerate(("output", "error", "endpoint", "attempts", "history"))})

    return df.mapInPandas(of, f"{types}, output string, error string, endpoint string, attempts int, history array<string>")
