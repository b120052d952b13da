"""Feed, counts and lookups on hand-made rows."""


from tidewrack.operators import feed, lookup
from tidewrack.schema import ARTICLE


def articles(spark, *rows):
    base = dict(ingest_seq=0, source_ord=0, url="u", title="t", summary="s", source="A", image_url="", category="world", classification_method="m", fetched_at="2025-01-01 10:00:00")
    return spark.createDataFrame([{**base, "ingest_seq": k, **r} for k, r in enumerate(rows)], ARTICLE)


def seqs(df):
    return [r["ingest_seq"] for r in df.collect()]


def test_order_is_stable_and_missing_last(spark):
    df = articles(spark, {"fetched_at": "10:00"}, {"fetched_at": "10:05"}, {"fetched_at": "10:05"}, {"fetched_at": None})
    assert seqs(feed.page(df)) == [1, 2, 0, 3]


def test_pages_have_no_upper_clamp(spark):
    df = articles(spark, *[{}] * 41)
    first = feed.meta(df, 0).first()
    assert (first.page, first.total_pages, first.has_next, first.has_prev) == (1, 3, True, False)
    assert len(seqs(feed.page(df, 3))) == 1 and not feed.meta(df, 3).first().has_next
    past = feed.meta(df, 9).first()
    assert seqs(feed.page(df, 9)) == [] and past.has_prev and not past.has_next


def test_empty_table(spark):
    df = articles(spark)
    m = feed.meta(df).first()
    assert (m.total, m.total_pages, m.has_next) == (0, 1, False)
    assert feed.source_counts(df).collect() == [] and feed.page(df).collect() == []
    assert {r.category: r.n for r in feed.category_counts(df).collect()}["all"] == 0


def test_filters(spark):
    df = articles(spark, {"title": "50% off"}, {"title": "500 off"}, {"title": None, "summary": None, "source": None, "category": None})
    assert seqs(feed.matching(df, q="50%")) == [0]
    assert len(seqs(feed.matching(df, category="nope"))) == 3
    assert seqs(feed.matching(df, category="world", source=" a ")) == [0, 1]


def test_counts(spark):
    df = articles(spark, {"source": None}, {"source": ""}, {"source": "A"})
    assert {r.source: r.n for r in feed.source_counts(df).collect()} == {"unknown": 1, "": 1, "A": 1}
    counts = {r.category: r.n for r in feed.category_counts(articles(spark, {}, {})).collect()}
    assert counts["world"] == 2 and counts["sports"] == 0 and counts["all"] == 2 and len(counts) == 10


def test_buttons():
    assert feed.page_buttons(10, 5) == ([3, 4, 5, 6, 7], True, True)
    assert feed.page_buttons(10, 1) == ([1, 2, 3, 4, 5], False, True)
    assert feed.page_buttons(10, 10) == ([8, 9, 10], True, False)
    assert feed.page_buttons(1, 1) == ([], False, False)


def test_caps(spark):
    df = articles(spark, {"title": " "}, {"title": "a"}, {"title": "b"})
    assert seqs(feed.per_source_cap(df, 2)) == [1]
    assert seqs(feed.per_source_cap(df, 2, after=True)) == [1, 2]


def test_ticker_doubles(spark):
    rows = feed.ticker(articles(spark, {"title": "a"}, {"title": "b"})).orderBy("pos").collect()
    assert [r.title for r in rows] == ["a", "b", "a", "b"]


def test_lookups(spark):
    df = articles(spark, {"url": "x"}, {"url": None, "source": None})
    flags = {r.ingest_seq: r.is_new for r in lookup.flagged(df, spark.createDataFrame([("x",), ("x",), (None,)], "url string")).collect()}
    assert flags == {0: True, 1: False}
    sources = spark.createDataFrame([(0, "A", "", "#fff")], "source_ord int, name string, url string, color string")
    assert {r.ingest_seq: r.color for r in lookup.with_color(df, sources).collect()} == {0: "#fff", 1: lookup.DEFAULT_COLOR}


def test_page_plan_is_top_k_with_pushdown(spark, tmp_path):
    path = str(tmp_path / "a")
    articles(spark, *[{}] * 5).write.parquet(path)
    df = feed.page(spark.read.parquet(path), 2, 5, category="world").select("ingest_seq", "fetched_at")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(category,world)" in plan and "image_url" not in plan.split("ReadSchema")[1]
