"""Pages and feeds to rows. Trees are read in Arrow batches; what an expression can do stays one."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import feeds as feeds_of
from tidewrack.functions import markup
from tidewrack.functions.text import first_image, or_placeholder, strip, strip_tags
from tidewrack.functions.text import unescape as unescaped
from tidewrack.schema import CLOCK


#: What can be read off a page, by name.
FACTS: dict[str, Callable] = {
    "page_summary": lambda tree, base, selectors, n: markup.lead(tree, selectors, n),
    "page_image": lambda tree, base, selectors, n: markup.hero_image(tree, base),
    "page_text": lambda tree, base, selectors, n: markup.main_text(tree),
}


def page_facts(pages: DataFrame, base: str, selectors: list[str], html: str = "html", sentences: int = 3, facts: tuple[str, ...] = tuple(FACTS)) -> DataFrame:
    """``pages`` with the named facts read off their HTML, each page parsed once; null and empty pages give empty strings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            trees = [markup.parse(x if isinstance(x, str) else "") for x in b[html]]
            for name in facts:
                b[name] = [FACTS[name](t, base, selectors, sentences) for t in trees]
            yield b

    names = ", ".join([f"`{c}` {k}" for c, k in pages.dtypes] + [f"{name} string" for name in facts])
    return pages.mapInPandas(run, names)


def article_reads(requests: DataFrame, fetch: Callable[[str], str], base: str, selectors: list[str], sentences: int = 3) -> DataFrame:
    """``(url, page_summary, page_image, page_text)`` of each row of ``requests(url)``: fetched, parsed and read in one pass.

    An address that doesn't start with ``http``, a null one, and one whose fetch or page fails give three empty strings.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url in b["url"]:
                said = [""] * len(FACTS)
                if isinstance(url, str) and url.startswith("http"):
                    try:
                        tree = markup.parse(fetch(url))
                        said = [read(tree, base, selectors, sentences) for read in FACTS.values()]
                    except Exception:  # noqa: BLE001 a page that can't be had is an empty one
                        said = [""] * len(FACTS)
                rows.append((url, *said))
            yield pd.DataFrame(rows, columns=["url", *FACTS])

    return requests.select("url").mapInPandas(run, ", ".join(["url string", *(f"{name} string" for name in FACTS)]))


def listing_items(pages: DataFrame, selector: str, base: str, limit: int = 10, after: bool = False, drop: tuple[str, ...] = (), plain: bool = False, html: str = "html", key: str = "url") -> DataFrame:
    """``(<key>, pos, title, link)`` of listing pages' headings, by the rules of :func:`markup.headings`; ``drop`` are titles in any case."""
    unwanted = frozenset(d.upper() for d in drop)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *h) for k, text in zip(b[key], b[html]) for h in markup.headings(markup.parse(text if isinstance(text, str) else ""), selector, base, limit, after, unwanted, plain)]
            yield pd.DataFrame(rows, columns=["k", "pos", "title", "link"])

    out = pages.select(key, html).mapInPandas(run, f"k {dict(pages.dtypes)[key]}, pos int, title string, link string")
    return out.withColumnRenamed("k", key)


def feed_items(feeds: DataFrame, xml: str = "xml", key: str = "source", limit: int = 10, strict: bool = True, base: str | None = None) -> DataFrame:
    """``(<key>, pos, title, link, description, media_url, enclosure_url, encoded)`` of a feed's first items.

    A null or empty feed has no items. One that can't be parsed even after repair fails the query, or, without ``strict``, gives one row with nulls but
    for ``key``, so its loss shows. With ``base``, ``html_image`` is the image of the description's markup, or else of the encoded body's, for items that
    name none otherwise.
    """
    names = [*feeds_of.Item._fields, *(["html_image"] if base is not None else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b[key], b[xml]):
                try:
                    own = list(feeds_of.items(text, limit)) if text else []
                except ET.ParseError:
                    if strict:
                        raise
                    rows.append((k, *[None] * len(names)))
                    continue
                for x in own:
                    image = ()
                    if base is not None:
                        bodies = () if x.media_url or x.enclosure_url else (x.description, x.encoded)
                        image = (next(filter(None, (markup.hero_image(markup.parse(h), base) for h in bodies if h)), ""),)
                    rows.append((k, *x, *image))
            out = pd.DataFrame(rows, columns=["k", *names])
            out["pos"] = out["pos"].astype("Int32")
            yield out

    kinds = ", ".join(f"{n} {'int' if n == 'pos' else 'string'}" for n in names)
    return feeds.select(key, xml).mapInPandas(run, f"k {dict(feeds.dtypes)[key]}, {kinds}").withColumnRenamed("k", key)


def feed_articles(items: DataFrame, page_image: Column | None = None) -> DataFrame:
    """Feed items as ``(title, summary, url, image_url)``.

    The image is the first that isn't empty of media, enclosure, the items' markup (``html_image`` where :func:`feed_items` was asked for it, else the first
    image of the description) and the page.
    """
    within = F.col("html_image") if "html_image" in items.columns else first_image(F.col("description"))
    candidates = [F.col("media_url"), F.col("enclosure_url"), within] + ([page_image] if page_image is not None else [])
    image = F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(""))
    return items.where(strip(F.col("title")) != "").select(*[c for c in items.columns if c in ("source", "pos")], "title", strip(unescaped(strip_tags(F.col("description")))).alias("summary"), F.col("link").alias("url"), image.alias("image_url"))


def built(items: DataFrame, clock: Column, *keys: str) -> DataFrame:
    """Rows in the store's shape but for their category, after ``keys``: trimmed, with the placeholder and a stamp from ``clock``."""
    return items.select(
        *keys, strip(F.col("title")).alias("title"), or_placeholder(F.col("summary")).alias("summary"), "source", "url", F.coalesce("image_url", F.lit("")).alias("image_url"), F.date_format(clock, CLOCK).alias("fetched_at")
    )


def articles_from(items: DataFrame, lexicon: DataFrame, cues: DataFrame, clock: Column, **options) -> DataFrame:
    """Items ``(ingest_seq, title, summary, source, url, image_url)`` as complete stored rows, each with its category and method. ``ingest_seq`` must be unique."""
    from tidewrack.operators.classify import classify

    own = items.select("ingest_seq", "title", "summary", "url")
    stored = built(items, clock, "ingest_seq")
    return stored.join(classify(own, lexicon, cues, **options).withColumnRenamed("method", "classification_method"), "ingest_seq")
