"""Lookups with defaults, and flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.runtime import small

# --- Fixed values.
#: Colour of a source that isn't registered.
DEFAULT_COLOR = "#1a3a6b"
#: What a trained model's labels stand for; others are society.
LABELS = {"economics": "economy", "politics": "politics", "social": "society"}


def flagged(articles: DataFrame, urls: DataFrame) -> DataFrame:
    """``articles`` with ``is_new``: whether their address is among ``urls(url)``. The distinct addresses are joined by size, not by hint."""
    marks = urls.select("url").where("url is not null").distinct().withColumn("is_new", F.lit(True))
    return articles.join(marks, "url", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def with_color(articles: DataFrame, sources: DataFrame, default: str = DEFAULT_COLOR) -> DataFrame:
    """``articles`` with their source's colour. ``sources`` is the registry; Spark broadcasts it if its size allows."""
    colors = sources.select(F.col("name").alias("source"), "color")
    return articles.join(colors, "source", "left").withColumn("color", F.coalesce("color", F.lit(default)))


def with_label(articles: DataFrame, labels: DataFrame) -> DataFrame:
    """``articles`` with the label and icon of their category; the first row of ``labels(ord, category, label, icon)`` for an unknown one.

    The labels are broadcast once a count has shown them to be few; beyond that the join is a shuffle. The default is one row.
    """
    first = labels.orderBy("ord").limit(1).select(F.col("label").alias("l0"), F.col("icon").alias("i0"))
    own = articles.join(small(labels.select("category", "label", "icon")), "category", "left").crossJoin(F.broadcast(first))
    return own.withColumn("label", F.coalesce("label", "l0")).withColumn("icon", F.coalesce("icon", "i0")).drop("l0", "i0")


def from_model_label(label):
    """The category of a model's label."""
    pairs = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.element_at(pairs, label), F.lit("society"))
