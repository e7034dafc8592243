"""Session defaults and the two things every job needs from the cluster: a way to cut lineage and table paths."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on; `conf` overrides, with `__` standing for a dot."""
    builder = SparkSession.builder.config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()})
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the reliable checkpoint folder, so that a lost executor costs no recomputation of its lineage.

    The folder is `spark.checkpoint.dir`. Where the session names none, a temporary one is set in local mode (tests,
    notebooks); on a cluster, whose machines share no such folder, that is an error.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of checkpoints, set by `spark.checkpoint.dir` if the context has none yet."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `base`."""
    return spark.read.parquet(os.path.join(base, f"{name}.parquet"))


#: Lets Spark delete a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a Parquet table beside the checkpoints and read back.

    Cuts the lineage as `cut` does, but in packed columns; the shuffle files that made the table are deleted once it is
    written, as nothing needs them any more.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_folder(spark), f"table-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the workers, once per application: their Python need not have it on its path."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        here = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="corpusloom-")) / "corpusloom.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, f.relative_to(here.parent))
        sc.addPyFile(str(archive))
    return spark
