"""The feed: filters, stable order, pages, counts.

Everything is declarative: filters reach the scan, and a page is one ``TakeOrderedAndProject``, so no full sort takes place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.text import has_literal
from tidewrack.schema import CATEGORIES


def matching(articles: DataFrame, source: str = "", q: str = "", category: str | None = None) -> DataFrame:
    """Articles of a source (any case), with a literal keyword in title or summary, of a category; an unknown category is no filter.

    Null titles, summaries and sources count as empty.
    """
    source, q = (source or "").strip().lower(), (q or "").strip().lower()
    if source:
        articles = articles.where(F.lower(F.coalesce("source", F.lit(""))) == source)
    if q:
        articles = articles.where(has_literal(F.lower(F.coalesce("title", F.lit(""))), q) | has_literal(F.lower(F.coalesce("summary", F.lit(""))), q))
    if category in CATEGORIES:
        articles = articles.where(F.col("category") == category)
    return articles


def newest_first() -> list:
    """Latest ``fetched_at`` first, missing ones last, ties in order of arrival."""
    return [F.coalesce("fetched_at", F.lit("")).desc(), F.col("ingest_seq").asc()]


def page(articles: DataFrame, number: int = 1, size: int = 20, **filters) -> DataFrame:
    """One page of the feed; a page beyond the last is empty."""
    return matching(articles, **filters).orderBy(*newest_first()).offset((max(1, number) - 1) * size).limit(size)


def meta(articles: DataFrame, number: int = 1, size: int = 20, **filters) -> DataFrame:
    """One row ``(page, page_size, total, total_pages, has_next, has_prev)``; the page isn't clamped to the last."""
    number = max(1, number)
    pages = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("total") / size).cast("bigint"))
    total = matching(articles, **filters).agg(F.count("*").alias("total"))
    return total.select(
        F.lit(number).cast("bigint").alias("page"), F.lit(size).cast("bigint").alias("page_size"), "total", pages.alias("total_pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_prev")
    )


def page_buttons(total_pages: int, number: int) -> tuple[list[int], bool, bool]:
    """Buttons around a page, and whether pages are left out before and after; none for a single page."""
    if total_pages <= 1:
        return [], False, False
    first = max(1, number - 2)
    last = min(total_pages, first + 4)
    return list(range(first, last + 1)), first > 1, last < total_pages


def button_windows(counts: DataFrame, size: int = 20) -> DataFrame:
    """``(source, page, first, last, before, after)`` for every page of every source's feed in ``counts(source, n)``."""
    pages = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("n") / size).cast("bigint"))
    own = counts.select("source", pages.alias("pages")).where("pages > 1").select("source", "pages", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pages"))).alias("page"))
    first = F.greatest(F.lit(1).cast("bigint"), F.col("page") - 2)
    own = own.withColumn("first", first).withColumn("last", F.least(F.col("pages"), F.col("first") + 4))
    return own.select("source", "page", "first", "last", (F.col("first") > 1).alias("before"), (F.col("last") < F.col("pages")).alias("after"))


def ticker(articles: DataFrame, n: int = 15) -> DataFrame:
    """``(pos, title)``: the newest titles, twice in a row."""
    from pyspark.sql import Window as W

    top = articles.orderBy(*newest_first()).limit(n)
    # at most ``n`` rows are numbered, so the one partition of this window is bounded
    numbered = top.withColumn("pos", F.row_number().over(W.orderBy(*newest_first())).cast("bigint")).select("pos", "title")
    total = numbered.agg(F.count("*").alias("k"))
    return numbered.unionByName(numbered.crossJoin(F.broadcast(total)).select((F.col("pos") + F.col("k")).alias("pos"), "title"))


def source_counts(articles: DataFrame) -> DataFrame:
    """``(source, n)``; a missing source is ``unknown``, an empty one stays empty."""
    return articles.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


def category_counts(articles: DataFrame) -> DataFrame:
    """``(category, n)`` for all nine categories, zero included, and ``all`` for all rows."""
    spark = articles.sparkSession
    counted = articles.groupBy("category").agg(F.count("*").alias("k"))
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    filled = F.broadcast(names).join(counted, "category", "left").select("category", F.coalesce("k", F.lit(0).cast("bigint")).alias("n"))
    return filled.unionByName(articles.agg(F.count("*").alias("n")).select(F.lit("all").alias("category"), "n"))


def per_source_cap(articles: DataFrame, n: int = 10, after: bool = False) -> DataFrame:
    """The first ``n`` rows of each source with a title; ``after``: blank titles are left out before counting instead of after.

    One hot source doesn't meet in one task whole: each task keeps its own first rows, by partial limits of the window's group limit.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("source").orderBy("ingest_seq")
    titled = F.coalesce(F.regexp_replace("title", r"[\s\p{Z}]+", ""), F.lit("")) != ""
    own = articles.where(titled) if after else articles
    own = own.withColumn("pos", F.row_number().over(w).cast("bigint")).where(F.col("pos") <= n)
    return own if after else own.where(titled)


def total_pages(total: int, size: int) -> int:
    return max(1, math.ceil(total / size))
