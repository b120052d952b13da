"""Dedupe, store, stream and sources."""

import pytest
from pyspark.sql import functions as F

from tidewrack import runtime
from tidewrack.operators import dedupe, health
from tidewrack.sources import listing
from tidewrack.sources.registry import Registry, settings
from tidewrack.sources.store import Store, read_document, read_seen, write_captures
from tidewrack.streaming.ingest import Ingest, totals


def batch(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ingest_seq bigint, source_ord int, url string")


def urls_of(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def test_in_source_repeats_survive(spark):
    rows = batch(spark, (0, "u0"), (0, "u1"), (0, "u1"), (0, ""), (1, "u1"), (1, "u2"), (1, None))
    got = dedupe.fresh(rows, urls_of(spark, "u0", None)).orderBy("ingest_seq").collect()
    assert [(r.source_ord, r.url) for r in got] == [(0, "u1"), (0, "u1"), (1, "u2")]
    assert dedupe.fresh(rows.limit(0), urls_of(spark, "u0")).count() == 0


def test_remembered_and_totals(spark):
    assert dedupe.remembered(urls_of(spark, "a"), batch(spark, (0, "a"), (0, "b"), (0, ""))).count() == 2
    rows = spark.createDataFrame([(1,), (1,), (2,)], "batch_no int")
    assert [(r.batch, r.n, r.total) for r in dedupe.batch_totals(rows).orderBy("batch").collect()] == [(1, 2, 2), (2, 1, 3)]


def test_stream_equals_batches_and_survives_a_rerun(spark, tmp_path):
    schema = "ingest_seq bigint, source_ord int, url string"
    src = tmp_path / "in"
    batch(spark, (0, "a"), (0, "a"), (1, "a"), (1, "b")).coalesce(1).write.mode("append").parquet(str(src))
    said = []
    sink = Ingest(spark, str(tmp_path / "out"), announce=said.append)
    run = lambda: sink.start(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "cp"), None).awaitTermination()
    run()
    batch(spark, (0, "b"), (0, "c")).coalesce(1).write.mode("append").parquet(str(src))
    run()
    run()
    assert sorted(r.url for r in sink.stored("url string").collect()) == ["a", "a", "b", "c"]
    assert [e["count"] for e in said] == [3, 1] and said[-1]["total"] == 4
    assert sink.greeting("now") == {"event": "status", "total": 4, "updated": "now"}
    sink.batch(batch(spark, (0, "z")), 0)  # a number that was written already
    assert sink.stored("url string").count() == 4
    assert totals(spark.createDataFrame([(0, 3), (1, 1)], "batch_id bigint, n bigint")).agg(F.max("total")).first()[0] == 4


def test_a_half_written_batch_loses_nothing(spark, tmp_path):
    """Files of a batch are there, its mark is not: the rerun must not take its own rows for seen ones."""
    said = []
    sink = Ingest(spark, str(tmp_path / "out"), announce=said.append)
    sink.batch(batch(spark, (0, "a")), 0)
    rows = batch(spark, (0, "a"), (0, "b"), (0, "c"))
    broken = tmp_path / "out" / "articles" / "batch_id=1"
    rows.where("url = 'b'").write.parquet(str(broken))
    (broken / "_SUCCESS").unlink()
    assert sorted(r.url for r in sink.stored("url string").collect()) == ["a"]
    sink.batch(rows, 1)
    assert sorted(r.url for r in sink.stored("url string").collect()) == ["a", "b", "c"]
    assert [(e["batch"], e["count"], e["total"]) for e in said] == [(0, 1, 1), (1, 2, 3)]


@pytest.mark.parametrize("step", ["log", "announce"])
def test_a_batch_lost_after_its_write_is_announced(spark, tmp_path, step):
    said, lost = [], [True]

    def announce(event):
        if step == "announce" and lost:
            lost.pop()
            raise ConnectionError
        said.append(event)

    sink = Ingest(spark, str(tmp_path / "out"), announce=announce)
    rows = batch(spark, (0, "a"), (0, "b"))
    if step == "log":
        rows.write.parquet(str(tmp_path / "out" / "articles" / "batch_id=0"))  # written whole, then the driver was lost
    else:
        with pytest.raises(ConnectionError):
            sink.batch(rows, 0)
    again = Ingest(spark, str(tmp_path / "out"), announce=announce)
    again.batch(rows, 0)
    again.batch(rows, 0)
    assert [(e["batch"], e["count"], e["total"]) for e in said] == [(0, 2, 2)] and again.stored("url string").count() == 2


def test_an_empty_batch_is_not_announced(spark, tmp_path):
    said = []
    sink = Ingest(spark, str(tmp_path / "out"), announce=said.append)
    sink.batch(batch(spark, (0, "a")).limit(0), 0)
    sink.batch(batch(spark, (0, None), (0, "")), 1)
    assert not said and sink.total() == 0 and sink.stored("url string").count() == 0


def test_store_round_trip(spark, tmp_path):
    assert read_document(spark, str(tmp_path / "none.json")).count() == 0 and read_seen(spark, str(tmp_path / "none.json")).count() == 0
    path = tmp_path / "doc.json"
    path.write_text('{"metadata": {}, "articles": [{"title": "a", "url": "u"}, {"title": null}], "seen_urls": ["u"]}', encoding="utf-8")
    assert [(r.ingest_seq, r.title) for r in read_document(spark, str(path)).collect()] == [(0, "a"), (1, None)]
    path.write_text("{broken", encoding="utf-8")
    with pytest.raises(Exception):  # noqa: B017 a corrupt store is never taken for an empty one
        read_document(spark, str(path)).collect()
    store = Store(spark, str(tmp_path / "store"))
    assert store.articles().count() == 0
    row = spark.createDataFrame([(1, 0, "u", "t", "s", "A", "", "world", "m", "x")], store.articles().schema)
    store.append(row)
    store.append(row.withColumn("url", F.lit("")))
    store.append(row)
    assert store.seen().count() == 1  # a repeat isn't remembered twice
    store.export(str(tmp_path / "json"))
    lines = [x for f in (tmp_path / "json" / "articles").glob("*.json") for x in f.read_text(encoding="utf-8").splitlines()]
    assert len(lines) == 3 and '"image_url":""' in lines[0] and read_seen(spark, str(path.with_name("gone"))).count() == 0
    assert store.articles().count() == 3 and store.seen().count() == 1 and store.totals(F.current_timestamp()).first().total_articles == 3


def test_capture_files(spark, tmp_path):
    write_captures(spark.createDataFrame([("a", "# x"), ("b.md", None)], "path string, text string"), str(tmp_path / "md"))
    assert (tmp_path / "md" / "a.md").read_text() == "# x" and (tmp_path / "md" / "b.md").read_text() == ""


def test_registry_and_settings(spark, tmp_path):
    r = Registry()
    r.add("A", "http://a", "#1")
    r.add("B", "http://b", "#2")
    with pytest.raises(ValueError):
        r.add("A", "", "")
    assert [(x.source_ord, x.name) for x in r.table(spark).collect()] == [(0, "A"), (1, "B")]
    env = tmp_path / ".env"
    env.write_text('# c\nX="1=2"\nbad\n\nY = z\n', encoding="utf-8")
    get = settings(str(env), {"X": "", "Z": "q"})
    assert (get("X"), get("Y"), get("Z"), get("N", "d")) == ("1=2", "z", "q", "d")


def test_data_sources(spark, tmp_path):
    listing.register(spark)
    page = tmp_path / "a.html"
    page.write_text("<h3>One</h3><a href='/1'>x</a><h3> </h3><h3><a href='http://o/2'>Two</a></h3>", encoding="utf-8")
    rows = spark.read.format("html_listing").option("path", f"{page},{tmp_path}/none").option("sources", "A,B").option("base", "https://s").load().orderBy("source_ord", "pos").collect()
    assert [(r.source, r.title, r.url) for r in rows if not r.error] == [("A", "One", "https://s/1"), ("A", "Two", "http://o/2")]
    assert [r.source for r in rows if r.error] == ["B"]
    page.write_text("<h3>NEWS</h3><h3 class='c'>b</h3><h3>c</h3><h3>d</h3>", encoding="utf-8")
    options = {"path": str(page), "drop": "news|more", "plain": "true", "after": "true", "limit": "1"}
    assert [r.title for r in spark.read.format("html_listing").options(**options).load().collect()] == ["c"]
    feed = tmp_path / "f.xml"
    feed.write_text("<rss><channel><item><title>A &amp;amp; B</title><link> u </link><enclosure url='i.jpg'/></item></channel></rss>junk", encoding="utf-8")
    r = spark.read.format("rss").option("path", str(feed)).load().first()
    assert (r.title, r.url, r.image_url, r.error) == ("A & B", "u", "i.jpg", None)


def test_readiness(spark, tmp_path):
    def probe(url):
        if "down" in url:
            raise OSError("down")
        return 503 if "busy" in url else 200

    services = spark.createDataFrame([("a", "http://up/x"), ("b", "http://down"), ("c", "http://busy"), ("d", "nowhere"), ("e", None)], "name string, url string")
    checks = health.services(services, probe)
    assert [(r.name, r.ok) for r in checks.orderBy("name").collect()] == [("a", True), ("b", False), ("c", False), ("d", False), ("e", False)]
    assert health.storage(spark, str(tmp_path)).first().ok and not list(tmp_path.iterdir())
    (tmp_path / "file").write_text("")
    assert not health.storage(spark, str(tmp_path / "file")).first().ok
    assert health.readiness(health.storage(spark, str(tmp_path)), checks).first().failed == 4
    assert health.readiness(checks.where("name = 'a'")).first().status == "ready" and health.readiness(checks.limit(0)).first().ready


def test_broadcasts_are_bounded_by_bytes(spark):
    df = spark.createDataFrame([("x" * 1000,)] * 10, "t string")
    assert runtime.bounded(df) and not runtime.bounded(df, bound=9) and not runtime.bounded(df, size=9_000)
