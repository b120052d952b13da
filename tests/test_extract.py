"""Markup, feeds, fetch tiers and answers."""

import json

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import markup
from tidewrack.operators import collect, extract


def test_hero_image():
    page = markup.parse('<meta property="og:image" content=""><img src="/a/logo.png"><img src="/a/photo.jpg">')
    assert markup.hero_image(page, "https://s") == "https://s/a/photo.jpg"
    assert markup.hero_image(markup.parse('<meta property="og:image" content="//c/x.jpg"><img src="/a/photo.jpg">'), "https://s") == "https://c/x.jpg"
    assert markup.hero_image(markup.parse('<img srcset="https://s/large.jpg 2x, b 1x">')) == "https://s/large.jpg"
    assert markup.hero_image(markup.parse("")) == ""


def test_lead():
    page = markup.parse("<div class='x detail'><p>A<p> <p>B</p><p>C</p><p>D</p></div>")
    assert markup.lead(page, ["article", "div.detail"]) == "A. B. C"
    assert markup.lead(page, ["article"]) == "" and len(markup.lead(markup.parse(f"<article><p>{'x' * 900}</p></article>"), ["article"])) == 400


def test_links():
    first = lambda html: markup.nearest_link(markup.parse(html).first("h3"), "https://s/")
    assert first("<h3><a href='/a'>x</a></h3>") == "https://s/a"
    assert first("<a href='http://b'><h3>x</h3></a>") == "http://b"
    assert first("<h3>x</h3><p></p><a href='/c'></a>") == "https://s/c"
    assert first("<li><p><a href='/d'></a></p><h3>x</h3></li>") == "https://s/d"
    assert first("<h3><a href='rel'>x</a></h3>") == "" and first("<h3>x</h3>") == ""


def test_deep_and_broken_markup():
    deep = "<div>" * 5000 + "x" + "</p></i></div>"
    assert markup.parse(deep).text() == "x"
    assert markup.main_text(markup.parse("<body><nav><p>menu menu</p></nav><div><p>one</p><p>two<script>no</p></script></p></div></body>")) == "one\n\ntwo"
    assert markup.parse(None).text() == "" and markup.parse("<!x <p>a").text() is not None


def test_operators_with_nulls_and_empty_tables(spark):
    pages = spark.createDataFrame([("u", None), ("v", ""), ("w", "<h3>NEWS</h3><h3 class='c'>b</h3><h3>c</h3><h3>d</h3>")], "url string, html string")
    facts = extract.page_facts(pages, "", ["article"]).collect()
    assert [r.page_image for r in facts] == ["", "", ""]
    items = extract.listing_items(pages, "h3", "https://s", limit=1, after=True, drop=("news",), plain=True).collect()
    assert [(r.url, r.pos, r.title) for r in items] == [("w", 2, "c")]
    assert extract.listing_items(pages.limit(0), "h3", "").count() == 0


def test_feed_items(spark):
    xml = "<rss><channel><item><title>A</title><link>l</link><description>&lt;img src='d.jpg'&gt;x &amp;amp; y</description></item><item><title> </title></item></channel></RSS>junk".replace("</RSS>", "</rss>")
    feeds = spark.createDataFrame([("s", xml), ("t", "no feed"), ("u", None), ("v", "")], "source string, xml string")
    items = extract.feed_items(feeds, strict=False)
    r = extract.feed_articles(items).collect()
    assert [(x.source, x.title, x.summary, x.image_url) for x in r] == [("s", "A", "x & y", "d.jpg")]
    assert [x.source for x in items.where("pos is null").collect()] == ["t"]
    with pytest.raises(Exception, match="ParseError"):
        extract.feed_items(feeds).collect()
    assert extract.feed_items(feeds.where("source <> 't'").limit(0)).count() == 0


def test_feed_image_from_the_encoded_body(spark):
    xml = "<rss xmlns:content='http://purl.org/rss/1.0/modules/content/'><channel><item><title>A</title><description>&lt;img src='/site-logo.png'&gt;</description><content:encoded><![CDATA[<img src='/pic/one.jpg'>]]></content:encoded></item></channel></rss>"
    feeds = spark.createDataFrame([("s", xml)], "source string, xml string")
    assert extract.feed_articles(extract.feed_items(feeds, base="https://s")).first().image_url == "https://s/pic/one.jpg"


def test_article_reads(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError
        return "<article><p>A</p></article><img src='/pic/one.jpg'>"

    rows = extract.article_reads(spark.createDataFrame([("http://a",), ("http://bad",), ("ftp://a",), (None,), ("",)], "url string"), fetch, "https://s", ["article"]).collect()
    assert [(r.page_summary, r.page_image, r.page_text) for r in rows] == [("A", "https://s/pic/one.jpg", "A")] + [("", "", "")] * 4


def test_tiers_as_strategies(spark):
    block, ok = "Just a moment " + "x" * 200, "x" * 101
    plan = collect.tiers(("one", lambda u: (200, "short")), ("two", lambda u: (200, block if u.endswith("b") else ok)), ("three", collect.reader(lambda u: (0, u), "https://r/", retry=False)))
    rows = collect.fetched(spark.createDataFrame([("https://h/a",), ("https://h/b",)], "url string"), plan).collect()
    assert [(r.method, r.md) for r in rows] == [("two", ok), ("three", "https://r/http://https://h/b")]
    assert collect.reader(lambda u: (200, u), "https://r/")("http://p") == (200, "https://r/http://p")


def test_tiers(spark):
    ok, block = "x" * 101, "Just a moment " + "x" * 101
    rows = [("a", 1, 200, "x" * 100), ("a", 2, 200, ok), ("b", 1, 200, block), ("c", 2, 200, block), ("c", 3, 0, block), ("d", 1, 500, ok), ("d", 3, 0, ""), ("e", 1, None, None)]
    got = {r.url: r.tier for r in collect.first_accepted(spark.createDataFrame(rows, "url string, tier int, status int, md string")).collect()}
    assert got == {"a": 2, "b": 1, "c": 3, "d": None, "e": None}


def test_fetched(spark):
    def fails(url):
        raise OSError

    rows = collect.fetched(spark.createDataFrame([("https://x ",), ("ftp://x",), (None,)], "url string"), [("one", fails), ("two", lambda u: "text")]).collect()
    assert [(r.url, r.md, r.method) for r in rows] == [("https://x", "text", "two")]


def test_answers(spark):
    raws = ['```json {"title": "t"} ```', '{"bullets": null}', '{"category": "nope"}', "no json", None, '{"sentiment": "neutral", "keywords": ["a"]}', "[1]"]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(raws)], "k int, raw string").select("k", collect.parsed_answer(F.col("raw")).alias("s")).orderBy("k").collect()
    assert rows[0].s.title == "t" and rows[0].s.bullets == [] and rows[5].s.keywords == ["a"]
    assert [r.s is None for r in rows] == [False, True, True, True, True, False, True]


def test_summarised(spark):
    def client(prompt):
        if prompt == "bad":
            raise RuntimeError
        return json.dumps({"title": prompt})

    caps = spark.createDataFrame([("a", "x", "m"), ("b", "", None), ("c", "bad", "m"), ("d", None, None)], "url string, md string, method string")
    assert {r.url: r.status for r in collect.summarised(caps, client).collect()} == {"a": 200, "b": 422, "c": 500, "d": 422}


def test_retries():
    waits, calls = [], []

    def busy(url):
        calls.append(url)
        if len(calls) < 3:
            raise collect.Unavailable
        return "text"

    assert collect.retrying(busy, sleep=waits.append)("u") == "text" and waits == [2.0, 4.0]

    def gone(url):
        raise OSError

    for fetch, error in ((gone, OSError), (lambda u: (_ for _ in ()).throw(collect.Unavailable()), collect.Unavailable)):
        try:
            collect.retrying(fetch, sleep=waits.append)("u")
        except error:
            continue
        raise AssertionError


def test_collected(spark, tmp_path):
    saved = []
    requests = spark.createDataFrame([("https://h/a",), ("https://h/none",), ("nope",)], "url string")
    rows = collect.collected(requests, [("one", lambda u: None if u.endswith("none") else "body")], lambda p: '{"title": "t"}', F.expr("timestamp'2025-07-01 12:00:00'"), lambda df: saved.extend(df.collect()))
    got = {r.url: (r.path, r.status) for r in rows.collect()}
    assert got == {"https://h/a": ("20250701_120000_a.md", 200), "https://h/none": (None, 422)}
    assert [(r.path, r.text) for r in saved] == [("20250701_120000_a.md", "# Source URL: https://h/a\n\nbody")]


def test_proxied_images(spark):
    def fetch(url):
        if url.endswith("x"):
            raise OSError
        return (404, b"") if url.endswith("4") else (200, b"img")

    rows = spark.createDataFrame([("https://h/a",), ("https://h/4",), ("https://h/x",), ("https://other/a",), (None,), ("ftp://h/a",)], "url string")
    assert [(r.status, r.body) for r in collect.proxied_images(rows, ["h"], fetch).collect()] == [(200, b"img"), (502, None), (502, None), (400, None), (400, None), (400, None)]


def test_articles_from(spark):
    lexicon = spark.createDataFrame([("sports", "goal", ["goal"], 9.0)], "category string, keyword string, tokens array<string>, weight double")
    cues = spark.createDataFrame([(0, "/tech", "technology")], "cue_ord int, cue string, category string")
    items = spark.createDataFrame([(1, " goal ", None, "A", "u", None), (2, "x", "y", "A", "h/tech", "i")], "ingest_seq bigint, title string, summary string, source string, url string, image_url string")
    rows = extract.articles_from(items, lexicon, cues, F.expr("timestamp'2025-07-01 12:00:00'")).orderBy("ingest_seq").collect()
    assert [(r.title, r.category, r.image_url, r.fetched_at) for r in rows] == [("goal", "sports", "", "2025-07-01 12:00:00"), ("x", "technology", "i", "2025-07-01 12:00:00")]
    assert rows[0].summary and set(rows[0].asDict()) >= {"summary", "source", "url", "classification_method"}
