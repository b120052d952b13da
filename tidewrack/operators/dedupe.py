"""Which rows of a batch are kept, and what is remembered of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unseen(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows with an address that isn't empty and hasn't been seen; Spark picks the join by the size of ``seen``."""
    return batch.where(F.col("url") != "").join(seen.select("url").distinct(), "url", "left_anti")


def fresh(batch: DataFrame, seen: DataFrame, order: str = "source_ord") -> DataFrame:
    """Unseen rows, of which the source first in order keeps an address; its own repeats stay.

    The least order of each address is aggregated before the shuffle and joined back, so an address with very many rows meets in no window.
    """
    own = unseen(batch, seen)
    first = own.groupBy("url").agg(F.min(order).alias("_first"))
    return own.join(first, "url").where(F.col(order).eqNullSafe(F.col("_first"))).drop("_first")


def appended(articles: DataFrame, batch: DataFrame) -> DataFrame:
    return articles.unionByName(batch, allowMissingColumns=True)


def remembered(seen: DataFrame, batch: DataFrame) -> DataFrame:
    """The set of seen addresses with a batch's added."""
    return seen.select("url").unionAll(batch.select("url").where(F.col("url") != "")).distinct()


def batch_totals(batches: DataFrame, batch: str = "batch_no") -> DataFrame:
    """``(batch, n, total)``: rows of each batch and the running total, over one row per batch."""
    counts = batches.groupBy(F.col(batch).alias("batch")).agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("total", running)
