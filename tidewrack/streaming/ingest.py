"""Micro-batch ingestion: unseen rows are classified, appended and announced.

The set of seen addresses is a table, not streaming state, so it survives restarts and grows on disk. Three steps make a batch, each under its
number and each with a mark once it is whole, so a batch that runs again after a lost driver goes on where it stopped:

1. ``articles/batch_id=<n>`` is written; Spark's ``_SUCCESS`` is the mark. Only marked folders count as seen or stored, so what a broken attempt left
   behind hides none of its own rows, and is overwritten.
2. ``log/<n>`` holds the batch's rows and the running total, which is carried on from the batch before, so nothing is counted twice over.
3. ``announced/<n>`` is put down after the announcement. A driver lost between the two announces again; the event carries its batch's number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewrack.operators.dedupe import fresh
from tidewrack.runtime import cut, exists, get, listed, put, small


class Ingest:
    """``path`` must be shared by all executors; ``prepare`` turns a batch into stored columns; ``announce`` gets ``{event, batch, count, total}``, and
    ``{event, total, updated}`` is what a client is greeted with."""

    def __init__(self, spark: SparkSession, path: str, prepare: Callable[[DataFrame], DataFrame] | None = None, announce: Callable[[dict], None] | None = None) -> None:
        self.spark, self.path, self.prepare, self.announce = spark, path, prepare or (lambda df: df), announce

    def _committed(self) -> list[str]:
        """Folders of the batches that were written whole."""
        return [mark.removesuffix("/_SUCCESS") for mark in listed(self.spark, f"{self.path}/articles/batch_id=*/_SUCCESS")]

    def stored(self, columns: str) -> DataFrame:
        """Everything stored so far, in the given columns (a schema string)."""
        folders = self._committed()
        return self.spark.read.schema(columns).parquet(*folders) if folders else self.spark.createDataFrame([], columns)

    def _known(self, rows: DataFrame) -> DataFrame:
        """Those addresses of a batch that are stored. A small batch is broadcast to the scan of the addresses, so the history isn't shuffled."""
        own = small(cut(rows.select("url").where("url <> ''").distinct()))
        return cut(self.stored("url string").join(own, "url", "left_semi").distinct())

    def total(self) -> int:
        """Rows of all batches up to the last, as logged."""
        logged = sorted(int(p.rsplit("/", 1)[1]) for p in listed(self.spark, f"{self.path}/log/[0-9]*") if "." not in p.rsplit("/", 1)[1])
        return int(get(self.spark, f"{self.path}/log/{logged[-1]}").split()[1]) if logged else 0

    def batch(self, rows: DataFrame, number: int) -> None:
        out, log, mark = f"{self.path}/articles/batch_id={number}", f"{self.path}/log/{number}", f"{self.path}/announced/{number}"
        if not exists(self.spark, f"{out}/_SUCCESS"):
            self.prepare(fresh(rows, self._known(rows))).write.mode("overwrite").parquet(out)
        if not exists(self.spark, log):
            n = self.spark.read.parquet(out).count()
            put(self.spark, log, f"{n} {self.total() + n}")
        if self.announce and not exists(self.spark, mark):
            n, total = map(int, get(self.spark, log).split())
            if n:
                self.announce({"event": "new_articles", "batch": number, "count": n, "total": total})
            put(self.spark, mark)

    def greeting(self, clock: str) -> dict:
        """What a client is told when it connects: the number of stored rows and the time."""
        return {"event": "status", "total": self.total(), "updated": clock}

    def start(self, stream: DataFrame, checkpoint: str, every: str | None = "15 minutes") -> StreamingQuery:
        """Runs on ``stream``; ``every`` is the fixed rate, ``None`` takes what is there and ends."""
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def totals(events: DataFrame) -> DataFrame:
    """``(batch, n, total)`` of announced events ``(batch_id, n)``."""
    from pyspark.sql import Window as W

    per = events.groupBy("batch_id").agg(F.sum("n").alias("n"))
    return per.select(F.col("batch_id").alias("batch"), "n", F.sum("n").over(W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, 0)).alias("total"))
