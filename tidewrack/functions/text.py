"""String functions as column expressions; pandas functions only where Spark has none (entities)."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidewrack.schema import PLACEHOLDER, TRUNCATED


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def has_literal(c: Column, needle: str) -> Column:
    """Whether ``needle`` stands in ``c``, no character of it being a wildcard."""
    return F.contains(c, F.lit(needle))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def first_image(c: Column) -> Column:
    """``src`` of the first ``img`` tag with either kind of quotes, else ''."""
    return F.regexp_extract(c, r"""<img[^>]+src=["']([^"']+)["']""", 1)


def safe_name(url: Column) -> Column:
    """The last path segment without characters that file names can't hold, or ``article``."""
    last = F.element_at(F.split(url, "/"), -1)
    return F.coalesce(F.nullif(F.regexp_replace(last, r'[\\/*?:"<>|]', ""), F.lit("")), F.lit("article"))


def for_model(c: Column, limit: int = 4000) -> Column:
    """Text cut to ``limit`` characters with a mark, if longer."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(TRUNCATED))).otherwise(c)


def crop_words(c: Column, n: int = 500) -> Column:
    """The first ``n`` words, one space apart."""
    return F.array_join(F.slice(F.split(strip(c), r"[\s\p{Z}]+"), 1, n), " ")


def without_fences(c: Column) -> Column:
    """A model's answer without code fences around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(json)?", ""), r"```$", ""))


def weighted_text(title: Column, body: Column) -> Column:
    """Title three times, then the body, null counting as empty."""
    t, b = F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(t, F.lit(" "), t, F.lit(" "), t, F.lit(" "), b)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def or_placeholder(summary: Column) -> Column:
    """The placeholder for a null or empty summary; a blank one becomes empty."""
    return F.when(F.coalesce(summary, F.lit("")) == "", F.lit(PLACEHOLDER)).otherwise(strip(summary))


def minutes_label(n: Column) -> Column:
    return F.concat(n.cast("string"), F.lit(" minutes"))


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """HTML entities resolved; nulls stay."""
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else None)
