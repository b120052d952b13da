"""The article store: the JSON document it can be imported from, and the Parquet layout it lives in."""

from __future__ import annotations

import os
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.operators.dedupe import unseen
from tidewrack.runtime import exists
from tidewrack.schema import CLOCK, STORE_DOCUMENT, STORED_ARTICLE


def _document(spark: SparkSession, path: str) -> DataFrame:
    """The store's document; a missing one is empty, a corrupt one an error, never an empty store."""
    if not exists(spark, path):
        return spark.createDataFrame([], STORE_DOCUMENT)
    return spark.read.schema(STORE_DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored article with its place ``ingest_seq``."""
    return _document(spark, path).select(F.posexplode("articles").alias("ingest_seq", "a")).select(F.col("ingest_seq").cast("bigint"), "a.*")


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    """``(url)``: the distinct seen addresses of the document; none where it is missing."""
    return _document(spark, path).select(F.explode("seen_urls").alias("url")).where("url is not null").distinct()


class Repository(Protocol):
    """What operators ask of a store, so that another one can take its place."""

    def articles(self) -> DataFrame: ...

    def seen(self) -> DataFrame: ...

    def append(self, batch: DataFrame) -> None: ...


class Store:
    """``articles/`` and ``seen_urls/`` under a path shared by all executors; batches are appended by Spark's commit protocol."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame:
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def articles(self) -> DataFrame:
        return self._read("articles", "ingest_seq bigint, source_ord int, url string, title string, summary string, source string, image_url string, category string, classification_method string, fetched_at string")

    def seen(self) -> DataFrame:
        return self._read("seen_urls", "url string")

    def append(self, batch: DataFrame) -> None:
        """Adds articles, and those of their addresses that aren't among the seen ones yet."""
        batch.select(*self.articles().columns).write.mode("append").parquet(f"{self.path}/articles")
        unseen(batch.select("url"), self.seen()).distinct().write.mode("append").parquet(f"{self.path}/seen_urls")

    def export(self, path: str) -> None:
        """The store as JSON lines in UTF-8, nulls written out: ``articles/`` in the article's shape and ``seen_urls/``. Spark commits each folder as a whole."""
        self.articles().select(*STORED_ARTICLE.names).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/articles")
        self.seen().distinct().write.mode("overwrite").json(f"{path}/seen_urls")

    def totals(self, clock) -> DataFrame:
        """One row ``(total_articles, last_updated)``."""
        return self.articles().agg(F.count("*").alias("total_articles")).select("total_articles", F.date_format(clock, CLOCK).alias("last_updated"))


def write_captures(captures: DataFrame, folder: str) -> None:
    """One Markdown file for each row of ``captures(path, text)``, written by the tasks into a folder that all executors share."""

    def write(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            name = r["path"] if r["path"].endswith(".md") else r["path"] + ".md"
            temporary = os.path.join(folder, f".{name}.{os.getpid()}")
            with open(temporary, "w", encoding="utf-8") as f:
                f.write(r["text"] or "")
            os.replace(temporary, os.path.join(folder, name))

    captures.select("path", "text").foreachPartition(write)
