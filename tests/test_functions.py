"""Column functions against Python."""

from html import escape
from urllib.parse import quote

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewrack.functions import text, tokens, urls


def one(spark, c, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(c(F.col("v")).alias("r")).first().r


def test_strip_and_placeholder(spark):
    assert one(spark, text.strip, "　 a b \n") == "a b"
    assert one(spark, text.or_placeholder, "") == text.PLACEHOLDER and one(spark, text.or_placeholder, None) == text.PLACEHOLDER
    assert one(spark, text.or_placeholder, "  ") == ""


def test_for_model(spark):
    assert one(spark, text.for_model, "x" * 4000) == "x" * 4000
    assert one(spark, text.for_model, "x" * 4001) == "x" * 4000 + text.TRUNCATED


def test_safe_name(spark):
    assert one(spark, text.safe_name, "http://x/a/") == "article"
    assert one(spark, text.safe_name, "http://x/a?b=1") == "ab=1"
    assert one(spark, text.safe_name, None) == "article"


def test_fences(spark):
    assert one(spark, text.without_fences, ' ```json {"a":1}\n``` ') == '{"a":1}'


def test_requests(spark):
    assert one(spark, urls.accepted_request, " https://x") is None
    assert one(spark, urls.accepted_request, "https://x ") == "https://x"
    assert one(spark, urls.health_url, "https://h:80/a?b") == "https://h:80/healthz" and one(spark, urls.health_url, "nope") == ""


def test_proxied(spark):
    f = lambda u: urls.proxied(u, F.lit("the outlet"), ["The Outlet"], [])
    assert one(spark, f, "") == "" and one(spark, f, None) is None
    assert one(spark, f, "http://a/b c") == "/api/image?url=http%3A%2F%2Fa%2Fb%20c"
    g = lambda u: urls.proxied(u, F.lit(None).cast("string"), [], ["h:1"])
    assert one(spark, g, "http://h:1/x").startswith("/api/") and one(spark, g, "http://h/x") == "http://h/x"


def test_absolute(spark):
    join = urls.absolute("https://a.b")
    assert one(spark, join, "/x") == "https://a.b/x" and one(spark, join, "//c/y") == "https://c/y" and one(spark, join, "http://z") == "http://z" and one(spark, join, None) is None


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",), blacklist_characters="\x00"), max_size=30), min_size=1, max_size=20))
def test_encoders_equal_python(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", urls.percent_encode(F.col("v")).alias("p"), text.escape_html(F.col("v")).alias("h")).collect()
    for r in rows:
        assert r.p == quote(r.v, safe="") and r.h == escape(r.v).replace("&#x27;", "'")


def test_tokens(spark):
    assert one(spark, tokens.words, "By-election 5G, l'été!") == ["by-election", "5g", "l'été"] and one(spark, tokens.words, None) == []
    assert one(spark, lambda c: tokens.count_phrase(tokens.words(c), ["a", "a"]), "a a a") == 2
    assert one(spark, lambda c: tokens.count_phrase(tokens.words(c), ["a", "b"]), "a") == 0
    assert one(spark, tokens.keyword_weight, "four") == 1.0 and one(spark, tokens.keyword_weight, "fives") == 2.0
    cut = tokens.dictionary_words(["โรคหัวใจ", "โรค"])
    assert one(spark, cut, "พบโรคหัวใจใน AB") == ["พบ", "โรคหัวใจ", "ใน", "ab"]


def test_softmax(spark):
    p = one(spark, tokens.softmax, [1.0, 1000.0], "array<double>")
    assert abs(sum(p) - 1) < 1e-12 and p[1] > 0.999


def test_unescape(spark):
    assert one(spark, text.unescape, "a&amp;b&nbsp;") == "a&b " and one(spark, text.unescape, None) is None
