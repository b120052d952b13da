"""Python data sources for listing pages and feeds: one partition per address, fetched on the executors.

``fetcher`` names an importable callable ``address -> text`` (``module:function``), so tests and air-gapped runs pass files. A source
whose fetch fails yields a row with ``error`` instead of ending the cycle.
"""

from __future__ import annotations

import importlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewrack.functions import feeds, markup


def read_file(address: str) -> str:
    """The default fetcher: a local file."""
    with open(address.removeprefix("file://"), encoding="utf-8") as f:
        return f.read()


def _callable(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


class _Page(InputPartition):
    def __init__(self, ordinal: int, source: str, address: str) -> None:
        self.ordinal, self.source, self.address = ordinal, source, address


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = dict(options)

    def partitions(self):
        names = self.options.get("sources", "").split(",")
        addresses = [a for a in self.options.get("path", self.options.get("addresses", "")).split(",") if a]
        return [_Page(k, names[k] if k < len(names) and names[k] else a, a) for k, a in enumerate(addresses)]

    def read(self, partition):
        try:
            text = _callable(self.options.get("fetcher", "tidewrack.sources.listing:read_file"))(partition.address)
            yield from self.rows(partition, text)
        except Exception as e:  # noqa: BLE001 one source's failure is a row, not the end of the cycle
            yield (partition.ordinal, partition.source, None, None, None, None, None, f"{type(e).__name__}: {e}")

    def rows(self, partition, text):
        raise NotImplementedError


class _Headings(_Reader):
    def rows(self, partition, text):
        flag = lambda name: self.options.get(name, "false").lower() == "true"
        drop = frozenset(d.strip().upper() for d in self.options.get("drop", "").split("|") if d.strip())
        found = markup.headings(markup.parse(text), self.options.get("selector", "h3"), self.options.get("base", ""), int(self.options.get("limit", "10")), flag("after"), drop, flag("plain"))
        for pos, title, link in found:
            yield (partition.ordinal, partition.source, pos, title, link, "", "", None)


class _Items(_Reader):
    def rows(self, partition, text):
        base = self.options.get("base", "")
        for x in feeds.items(text, int(self.options.get("limit", "10"))):
            if x.title:
                within = (markup.hero_image(markup.parse(h), base) for h in (x.description, x.encoded) if h)
                image = x.media_url or x.enclosure_url or next(filter(None, within), "")
                yield (partition.ordinal, partition.source, x.pos, x.title, x.link, x.description, image, None)


class ListingSource(DataSource):
    """``spark.read.format("html_listing")``; options ``path``, ``sources``, ``selector``, ``base``, ``limit``, ``after``, ``drop`` (titles, with ``|`` between), ``plain``, ``fetcher``."""

    @classmethod
    def name(cls):
        return "html_listing"

    def schema(self):
        return "source_ord int, source string, pos int, title string, url string, description string, image_url string, error string"

    def reader(self, schema):
        return _Headings(self.options)


class FeedSource(ListingSource):
    """``spark.read.format("rss")`` with the same options and columns."""

    @classmethod
    def name(cls):
        return "rss"

    def reader(self, schema):
        return _Items(self.options)


def register(spark) -> None:
    spark.dataSource.register(ListingSource)
    spark.dataSource.register(FeedSource)
