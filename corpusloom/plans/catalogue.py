"""All core queries by name, with the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans import benchmark, corpus, reports, scoring, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in (corpus, scoring, benchmark, reports, stateful):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
