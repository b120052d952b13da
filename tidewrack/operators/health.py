"""Readiness of the parts a service depends on, from real probes."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions.urls import health_url
from tidewrack.runtime import put, remove


def storage(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(name, ok, error)``: whether a file can be written and removed below ``path``."""
    probe, error = f"{path}/.ready-{os.urandom(4).hex()}", None
    try:
        put(spark, probe, "ok")
        remove(spark, probe)
    except Exception as e:  # noqa: BLE001 what fails is the answer
        error = f"{type(e).__name__}: {e}"[:500]
    return spark.createDataFrame([("storage", error is None, error)], "name string, ok boolean, error string")


def services(addresses: DataFrame, probe: Callable[[str], int]) -> DataFrame:
    """``(name, ok, error)`` for each row of ``addresses(name, url)``: whether ``probe`` of its health address gives a status below 400.

    An address without scheme or host is an error and isn't probed, nor is a null one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, url in zip(b["name"], b["_health"]):
                error = None
                if not url:
                    error = "invalid address"
                else:
                    try:
                        status = probe(url)
                        error = f"status {status}" if status >= 400 else None
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                rows.append((name, error is None, error))
            yield pd.DataFrame(rows, columns=["name", "ok", "error"])

    return addresses.select("name", F.coalesce(health_url(F.col("url")), F.lit("")).alias("_health")).mapInPandas(run, "name string, ok boolean, error string")


def readiness(*checks: DataFrame) -> DataFrame:
    """One row ``(status, ready, failed)``: ready only if every check is; without any check it is ready."""
    own = checks[0]
    for c in checks[1:]:
        own = own.unionByName(c)
    ready = F.coalesce(F.bool_and("ok"), F.lit(True))
    return own.agg(ready.alias("ready"), F.count_if(~F.col("ok")).alias("failed")).select(F.when(F.col("ready"), "ready").otherwise("not_ready").alias("status"), "ready", "failed")
