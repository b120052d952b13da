"""Address functions as column expressions."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewrack.functions.text import strip


def percent_encode(c: Column) -> Column:
    """Everything but letters, figures and ``_.-~`` encoded, a space as ``%20``."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def scheme(c: Column) -> Column:
    return F.try_parse_url(c, F.lit("PROTOCOL"))


def authority(c: Column) -> Column:
    """Host with its port."""
    return F.try_parse_url(c, F.lit("AUTHORITY"))


def accepted_request(c: Column) -> Column:
    """The trimmed address of a request that starts with ``http://`` or ``https://``, null for any other."""
    return F.when(c.rlike("^https?://"), strip(c))


def health_url(c: Column) -> Column:
    """``/healthz`` on the same host, '' without scheme or host."""
    return F.when(scheme(c).isNotNull() & authority(c).isNotNull(), F.concat(scheme(c), F.lit("://"), authority(c), F.lit("/healthz"))).otherwise(F.lit(""))


def proxied(url: Column, source: Column, outlets: list[str], hosts: list[str], prefix: str = "/api/image?url=") -> Column:
    """Images of the named outlets (any case) or of allowed hosts, by way of the proxy; others and empty ones as they are."""
    ours = F.lower(F.coalesce(source, F.lit(""))).isin([o.lower() for o in outlets]) | F.coalesce(authority(url).isin(hosts), F.lit(False))
    return F.when((F.coalesce(url, F.lit("")) != "") & ours, F.concat(F.lit(prefix), percent_encode(url))).otherwise(url)


def proxyable(url: Column, hosts: list[str]) -> Column:
    """Whether the image proxy serves an address: http or https, and an allowed host with its port."""
    return F.coalesce(scheme(url).isin("http", "https") & authority(url).isin(hosts), F.lit(False))


def completed(url: str, base: str) -> str:
    """A relative address resolved against ``base``; one that starts with ``http`` stays."""
    return url if url.startswith("http") else urljoin(base.rstrip("/") + "/", url)


def absolute(base: str):
    """:func:`completed` for a column; null stays null."""

    @F.pandas_udf("string")
    def join(s: pd.Series) -> pd.Series:
        return s.map(lambda u: completed(u, base) if isinstance(u, str) else None)

    return join
