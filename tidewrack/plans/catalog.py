"""Registered queries and their SQL twins. Each runs over its whole tables; limits are those of the feature (pages, tickers, caps)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewrack.functions import text, urls
from tidewrack.functions import tokens as tok
from tidewrack.operators import classify, collect, dedupe, extract, feed, health, lookup, model
from tidewrack.runtime import checkpoint_dir, scratch, table
from tidewrack.schema import CATEGORIES, SENTIMENTS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return register


OUTLET, HOSTS = "Tallmere Ledger", ["img.tuldoly1.example", "img.sumevcon5.example"]
#: Labels and icons of the categories for the reader's page (a starter table; any may be passed).
LABELS = [(k, c, c.capitalize(), i) for k, (c, i) in enumerate(zip(CATEGORIES, "P E T H N S R A W".split()))]
CLOCK = "timestamp'2025-07-01 12:00:00'"

_PROXY_SQL = f"""CASE WHEN coalesce(image_url, '') <> '' AND (lower(coalesce(source, '')) = '{OUTLET.lower()}' OR coalesce(regexp_extract(image_url, '^[a-z]+://([^/?#]+)', 1) IN ({", ".join(f"'{h}'" for h in HOSTS)}), false))
  THEN '/api/image?url=' || url_encode(image_url) ELSE image_url END"""
_MATCH_SQL = "contains(lower(coalesce(title, '')), 'plan') OR contains(lower(coalesce(summary, '')), 'plan')"


# --- feed ---


@query(f"""SELECT a.ingest_seq, a.title, a.source, a.category, a.fetched_at, {_PROXY_SQL.replace("image_url", "a.image_url").replace("source", "a.source")} AS image_url, coalesce(s.color, '#1a3a6b') AS color
FROM articles a LEFT JOIN sources s ON a.source = s.name ORDER BY coalesce(a.fetched_at, '') DESC, a.ingest_seq LIMIT 20""")
def feed_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the whole feed as a reader sees it: proxied images and the sources' colours."""
    rows = lookup.with_color(feed.page(table(spark, sf_dir, "articles"), 1, 20), table(spark, sf_dir, "sources"))
    return rows.select("ingest_seq", "title", "source", "category", "fetched_at", urls.proxied(F.col("image_url"), F.col("source"), [OUTLET], HOSTS).alias("image_url"), "color")


@query(f"""SELECT ingest_seq, title, source, category, fetched_at, {_PROXY_SQL} AS image_url FROM articles
WHERE lower(coalesce(source, '')) = 'tallmere ledger' AND ({_MATCH_SQL}) ORDER BY coalesce(fetched_at, '') DESC, ingest_seq LIMIT 20 OFFSET 20""")
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of one source's articles with a keyword, images by way of the proxy."""
    rows = feed.page(table(spark, sf_dir, "articles"), 2, 20, source=" tallmere ledger ", q=" PLAN ")
    return rows.select("ingest_seq", "title", "source", "category", "fetched_at", urls.proxied(F.col("image_url"), F.col("source"), [OUTLET], HOSTS).alias("image_url"))


@query(f"""WITH t AS (SELECT count(*) AS total FROM articles WHERE {_MATCH_SQL}), p AS (SELECT total, greatest(1, CAST(ceil(total / 20) AS BIGINT)) AS total_pages FROM t)
SELECT CAST(n AS BIGINT) AS page, CAST(20 AS BIGINT) AS page_size, total, total_pages, n < total_pages AS has_next, n > 1 AS has_prev FROM p, (VALUES (1), (3), (99999)) v(n)""")
def feed_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page metadata of the first, the third and a page past the end."""
    a = table(spark, sf_dir, "articles")
    return feed.meta(a, 0, q="plan").unionByName(feed.meta(a, 3, q="plan")).unionByName(feed.meta(a, 99999, q="plan"))


@query("SELECT ingest_seq FROM articles WHERE lower(coalesce(source, '')) = 'delta wire'")
def category_filter_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An unknown category is no filter."""
    return feed.matching(table(spark, sf_dir, "articles"), source="Delta Wire", category="nope").select("ingest_seq")


@query("SELECT ingest_seq FROM articles WHERE contains(lower(coalesce(title, '')), '%') OR contains(lower(coalesce(summary, '')), '%')")
def keyword_is_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword's wildcards are plain characters."""
    return feed.matching(table(spark, sf_dir, "articles"), q="%").select("ingest_seq")


@query("SELECT ingest_seq FROM articles WHERE category = 'sports'")
def category_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.matching(table(spark, sf_dir, "articles"), category="sports").select("ingest_seq")


@query("SELECT coalesce(source, 'unknown') AS source, count(*) AS n FROM articles GROUP BY 1")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.source_counts(table(spark, sf_dir, "articles"))


_CATEGORY_VALUES = ", ".join(f"('{c}')" for c in CATEGORIES)


@query(f"SELECT c AS category, count(a.category) AS n FROM (VALUES {_CATEGORY_VALUES}) v(c) LEFT JOIN articles a ON a.category = c GROUP BY c UNION ALL SELECT 'all', count(*) FROM articles")
def category_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.category_counts(table(spark, sf_dir, "articles"))


@query("""WITH c AS (SELECT coalesce(source, 'unknown') AS source, greatest(1, CAST(ceil(count(*) / 20) AS BIGINT)) AS pages FROM articles GROUP BY 1),
p AS (SELECT source, pages, unnest(generate_series(CAST(1 AS BIGINT), pages)) AS page FROM c WHERE pages > 1),
w AS (SELECT *, greatest(1, page - 2) AS first FROM p), x AS (SELECT *, least(pages, first + 4) AS last FROM w)
SELECT source, page, first, last, first > 1 AS before, last < pages AS after FROM x""")
def page_button_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.button_windows(feed.source_counts(table(spark, sf_dir, "articles")))


@query("""WITH t AS (SELECT title, row_number() OVER (ORDER BY coalesce(fetched_at, '') DESC, ingest_seq) AS pos FROM articles ORDER BY pos LIMIT 15)
SELECT pos, title FROM t UNION ALL SELECT pos + (SELECT count(*) FROM t), title FROM t""")
def ticker_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.ticker(table(spark, sf_dir, "articles"))


_TITLED = r"regexp_replace(coalesce(title, ''), '[\s\p{Z}]+', '', 'g') <> ''"


@query(f"SELECT ingest_seq, source, pos FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ingest_seq) AS pos FROM articles) WHERE pos <= 10 AND {_TITLED}")
def per_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of each source, blank titles left out afterwards."""
    return feed.per_source_cap(table(spark, sf_dir, "articles")).select("ingest_seq", "source", "pos")


@query(f"SELECT ingest_seq, source, pos FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ingest_seq) AS pos FROM articles WHERE {_TITLED}) WHERE pos <= 10")
def per_source_cap_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten with a title of each source."""
    return feed.per_source_cap(table(spark, sf_dir, "articles"), after=True).select("ingest_seq", "source", "pos")


# --- lookups ---


@query("SELECT i.ingest_seq, i.url IN (SELECT url FROM articles WHERE url IS NOT NULL) IS TRUE AS is_new FROM incoming i")
def new_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows flagged by whether their address is in a set."""
    return lookup.flagged(table(spark, sf_dir, "incoming"), table(spark, sf_dir, "articles")).select("ingest_seq", "is_new")


@query("SELECT a.ingest_seq, coalesce(s.color, '#1a3a6b') AS color FROM articles a LEFT JOIN sources s ON a.source = s.name")
def source_color_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The colour of each article's source; null and unregistered sources get the default."""
    return lookup.with_color(table(spark, sf_dir, "articles"), table(spark, sf_dir, "sources")).select("ingest_seq", "color")


_LABEL_VALUES = ", ".join(f"({k}, '{c}', '{label}', '{i}')" for k, c, label, i in LABELS)


@query(f"SELECT a.ingest_seq, coalesce(l.label, '{LABELS[0][2]}') AS label, coalesce(l.icon, '{LABELS[0][3]}') AS icon FROM articles a LEFT JOIN (VALUES {_LABEL_VALUES}) l(ord, category, label, icon) ON a.category = l.category")
def category_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.with_label(table(spark, sf_dir, "articles"), spark.createDataFrame(LABELS, "ord int, category string, label string, icon string")).select("ingest_seq", "label", "icon")


@query("SELECT ingest_seq, CASE category WHEN 'economics' THEN 'economy' WHEN 'politics' THEN 'politics' WHEN 'social' THEN 'society' ELSE 'society' END AS category FROM articles")
def model_label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").select("ingest_seq", lookup.from_model_label(F.col("category")).alias("category"))


# --- dedupe, append ---


@query("SELECT ingest_seq FROM incoming WHERE url <> '' AND url NOT IN (SELECT url FROM articles WHERE url IS NOT NULL)")
def unseen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.unseen(table(spark, sf_dir, "incoming"), table(spark, sf_dir, "articles")).select("ingest_seq")


@query("""SELECT ingest_seq FROM (SELECT *, rank() OVER (PARTITION BY url ORDER BY source_ord) AS r FROM incoming
WHERE url <> '' AND url NOT IN (SELECT url FROM articles WHERE url IS NOT NULL)) WHERE r = 1""")
def dedupe_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh rows: unseen ones of the first source for each address, its own repeats included."""
    return dedupe.fresh(table(spark, sf_dir, "incoming"), table(spark, sf_dir, "articles")).select("ingest_seq")


@query("SELECT ingest_seq, url, title FROM articles UNION ALL SELECT ingest_seq, url, title FROM incoming")
def append_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.appended(table(spark, sf_dir, "articles"), table(spark, sf_dir, "incoming").drop("batch_no")).select("ingest_seq", "url", "title")


@query("SELECT url FROM articles UNION SELECT url FROM incoming WHERE url <> ''")
def seen_set_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.remembered(table(spark, sf_dir, "articles"), table(spark, sf_dir, "incoming"))


@query("SELECT batch_no AS batch, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY batch_no) AS BIGINT) AS total FROM incoming GROUP BY batch_no")
def cumulative_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.batch_totals(table(spark, sf_dir, "incoming"))


# --- classification ---

_CUES_SQL = """cues AS (SELECT a.ingest_seq, min(c.cue_ord) AS cue_ord FROM articles a JOIN url_cues c ON contains(lower(coalesce(a.url, '')), c.cue) GROUP BY 1)"""
_WORDS_SQL = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}]+(?:[-''’][\p{{L}}\p{{M}}\p{{N}}]+)*')"
_TEXT_SQL = "coalesce(title, '') || ' ' || coalesce(title, '') || ' ' || coalesce(title, '') || ' ' || coalesce(summary, '')"
_RULE_VALUES = ", ".join(f"('{c}', {k}, {[*parts]})" for c, k, parts in classify.RULES)
_SCORES_SQL = f"""docs AS (SELECT ingest_seq, url, {_TEXT_SQL} AS text, {_WORDS_SQL.format(_TEXT_SQL)} AS tokens FROM articles),
lens AS (SELECT DISTINCT len(tokens) AS n FROM lexicon),
grams AS (SELECT ingest_seq, unnest(list_transform(range(1, greatest(len(tokens) - n + 2, 1)), lambda i: array_to_string(tokens[i : i + n - 1], ' '))) AS gram FROM docs, lens),
hits AS (SELECT g.ingest_seq, l.category, sum(l.weight) AS score FROM grams g JOIN lexicon l ON g.gram = array_to_string(l.tokens, ' ') GROUP BY 1, 2),
bonus AS (SELECT d.ingest_seq, r.category, count(*) * 5.0 AS score FROM docs d JOIN (VALUES {_RULE_VALUES}) r(category, rule_id, parts) ON list_has_all(d.tokens, r.parts) GROUP BY 1, 2),
scores AS (SELECT ingest_seq, category, CAST(sum(score) AS DOUBLE) AS score FROM (SELECT * FROM hits UNION ALL SELECT * FROM bonus) GROUP BY 1, 2)"""
_ORDER_VALUES = ", ".join(f"('{c}', {k})" for k, c in enumerate(CATEGORIES))
_TOP_SQL = f"""ranked AS (SELECT d.ingest_seq, o.category, coalesce(s.score, 0.0) AS score, row_number() OVER (PARTITION BY d.ingest_seq ORDER BY coalesce(s.score, 0.0) DESC, o.ord) AS r
  FROM (SELECT DISTINCT ingest_seq FROM scores) d CROSS JOIN (VALUES {_ORDER_VALUES}) o(category, ord) LEFT JOIN scores s ON s.ingest_seq = d.ingest_seq AND s.category = o.category),
top2 AS (SELECT ingest_seq, max(CASE WHEN r = 1 THEN category END) AS top1, max(CASE WHEN r = 1 THEN score END) AS score1, max(CASE WHEN r = 2 THEN category END) AS top2, max(CASE WHEN r = 2 THEN score END) AS score2 FROM ranked WHERE r <= 2 GROUP BY 1)"""
_CLASSES_SQL = f"""{_CUES_SQL}, {_SCORES_SQL}, {_TOP_SQL},
classes AS (SELECT d.ingest_seq,
  CASE WHEN c.cue IS NOT NULL THEN c.category WHEN regexp_replace(d.text, '[\\s\\p{{Z}}]+', '', 'g') = '' THEN 'society'
    WHEN t.top1 NOT IN ('economy', 'politics', 'society') AND t.score1 - t.score2 >= 5 THEN t.top1 WHEN t.score1 > 0 THEN t.top1 ELSE 'society' END AS category,
  CASE WHEN c.cue IS NOT NULL THEN 'URL Priority (' || c.cue || ')' WHEN regexp_replace(d.text, '[\\s\\p{{Z}}]+', '', 'g') = '' THEN 'Fallback (Empty Text)'
    WHEN t.top1 NOT IN ('economy', 'politics', 'society') AND t.score1 - t.score2 >= 5 THEN printf('Rule-based (Domain Expert: %s, score=%.1f)', t.top1, t.score1)
    WHEN t.score1 > 0 THEN 'Rule-based (ML Low Confidence: 0.00)' ELSE 'Fallback (Default, ML conf: 0.00)' END AS method
  FROM docs d LEFT JOIN cues q USING (ingest_seq) LEFT JOIN url_cues c ON c.cue_ord = q.cue_ord LEFT JOIN top2 t USING (ingest_seq))"""


def _classified_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "articles"), table(spark, sf_dir, "lexicon"), table(spark, sf_dir, "url_cues")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles, lexicon, _ = _classified_tables(spark, sf_dir)
    docs = articles.select("ingest_seq", tok.words(text.weighted_text(F.col("title"), F.col("summary"))).alias("tokens"))
    return classify.scored(docs, lexicon, classify.rules_table(spark))


@query(f"WITH {_CUES_SQL} SELECT a.ingest_seq, u.category, u.cue FROM articles a LEFT JOIN cues c USING (ingest_seq) LEFT JOIN url_cues u ON u.cue_ord = c.cue_ord")
def url_cue_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles, _, cues = _classified_tables(spark, sf_dir)
    category, cue = classify.cue_column(F.col("url"), classify.cue_list(cues))
    return articles.select("ingest_seq", category.alias("category"), cue.alias("cue"))


@query(f"WITH {_SCORES_SQL} SELECT ingest_seq, category, score FROM scores")
def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query(rf"""WITH t AS (SELECT ingest_seq, {_WORDS_SQL.format("coalesce(summary, '')")} AS w FROM articles)
SELECT ingest_seq, len(list_filter(w, lambda x: x = 'the')) AS n_the, len(list_filter(range(1, greatest(len(w), 1)), lambda i: w[i] = 'more' AND w[i + 1] = 'inspectors')) AS n_phrase FROM t""")
def phrase_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a word and a phrase occur in each summary."""
    own = table(spark, sf_dir, "articles").select("ingest_seq", tok.words(F.coalesce("summary", F.lit(""))).alias("w"))
    return own.select("ingest_seq", tok.count_token(F.col("w"), "the").cast("bigint").alias("n_the"), tok.count_phrase(F.col("w"), ["more", "inspectors"]).cast("bigint").alias("n_phrase"))


@query(f"WITH {_SCORES_SQL} SELECT ingest_seq, category, CAST(score AS DOUBLE) AS score FROM bonus")
def compound_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of satisfied rules alone."""
    docs = table(spark, sf_dir, "articles").select("ingest_seq", tok.words(text.weighted_text(F.col("title"), F.col("summary"))).alias("tokens"))
    return classify.bonuses(docs, classify.rules_table(spark))


@query("SELECT category, keyword, weight, CASE WHEN length(keyword) > 4 THEN 2.0 ELSE 1.0 END::DOUBLE AS expected FROM lexicon")
def keyword_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lexicon").select("category", "keyword", "weight", tok.keyword_weight(F.col("keyword")).cast("double").alias("expected"))


@query(f"WITH {_SCORES_SQL}, {_TOP_SQL} SELECT * FROM top2")
def top2_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.top_two(_scores(spark, sf_dir))


@query(f"WITH {_CLASSES_SQL} SELECT * FROM classes")
def classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category and method of every article by cues, scores and rules, without a model."""
    articles, lexicon, cues = _classified_tables(spark, sf_dir)
    return classify.classify(articles, lexicon, cues)


@query()
def classify_segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with longest-match words in scripts without spaces."""
    articles, lexicon, cues = _classified_tables(spark, sf_dir)
    words = [r["keyword"] for r in lexicon.select("keyword").limit(classify.STARTS + 1).collect()]
    if len(words) > classify.STARTS:
        raise ValueError(f"over {classify.STARTS} keywords")
    return classify.classify(articles, lexicon, cues, tokenise=tok.dictionary_words(words))


_MODEL_LABELS = ["economics", "politics", "social"]
_MODEL_SQL = (
    _CLASSES_SQL[: _CLASSES_SQL.index("classes AS")]
    + r"""asked AS (SELECT ingest_seq, length(array_to_string(string_split_regex(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[\s\p{Z}]+')[1:500], ' ')) AS n FROM docs),
told AS (SELECT ingest_seq, CASE n % 3 WHEN 0 THEN 'economics' WHEN 1 THEN 'politics' ELSE 'social' END AS label, n % 5 <> 0 AS sure, CASE WHEN n % 5 = 0 THEN '0.33' ELSE '0.79' END AS conf FROM asked),
classes AS (SELECT d.ingest_seq,
  CASE WHEN c.cue IS NOT NULL THEN c.category WHEN regexp_replace(d.text, '[\s\p{Z}]+', '', 'g') = '' THEN 'society' WHEN t.top1 NOT IN ('economy', 'politics', 'society') AND t.score1 - t.score2 >= 5 THEN t.top1
    WHEN m.sure THEN CASE m.label WHEN 'economics' THEN 'economy' WHEN 'politics' THEN 'politics' ELSE 'society' END WHEN t.score1 > 0 THEN t.top1 ELSE 'society' END AS category,
  CASE WHEN c.cue IS NOT NULL THEN 'URL Priority (' || c.cue || ')' WHEN regexp_replace(d.text, '[\s\p{Z}]+', '', 'g') = '' THEN 'Fallback (Empty Text)'
    WHEN t.top1 NOT IN ('economy', 'politics', 'society') AND t.score1 - t.score2 >= 5 THEN printf('Rule-based (Domain Expert: %s, score=%.1f)', t.top1, t.score1) WHEN m.sure THEN 'ML (' || m.label || ') (conf=' || m.conf || ')'
    WHEN t.score1 > 0 THEN 'Rule-based (ML Low Confidence: ' || m.conf || ')' ELSE 'Fallback (Default, ML conf: ' || m.conf || ')' END AS method
  FROM docs d LEFT JOIN cues q USING (ingest_seq) LEFT JOIN url_cues c ON c.cue_ord = q.cue_ord LEFT JOIN top2 t USING (ingest_seq) JOIN told m USING (ingest_seq))"""
)


@query(f"WITH {_MODEL_SQL} SELECT * FROM classes")
def classify_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a model for what the rules leave open: a stand-in whose decision values follow from the cropped text's length."""

    def score(texts: list[str]) -> list[list[float]]:
        return [[2.0 * (len(t) % 5 != 0 and len(t) % 3 == k) for k in range(3)] for t in texts]

    articles, lexicon, cues = _classified_tables(spark, sf_dir)
    return classify.classify(articles, lexicon, cues, model=model.model_step(score, _MODEL_LABELS))


_VALID = ", ".join(f"'{c}'" for c in CATEGORIES)


@query(f"""WITH {_CLASSES_SQL} SELECT a.ingest_seq, CASE WHEN coalesce(a.category IN ({_VALID}), false) THEN a.category ELSE c.category END AS category,
CASE WHEN coalesce(a.category IN ({_VALID}), false) THEN a.classification_method ELSE c.method END AS classification_method, NOT coalesce(a.category IN ({_VALID}), false) AS changed
FROM articles a JOIN classes c USING (ingest_seq)""")
def backfill_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.backfilled(*_classified_tables(spark, sf_dir)).select("ingest_seq", "category", "classification_method", "changed")


# --- extraction: documents rendered as pages and feeds ---


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as HTML pages: a heading, a link, an image, paragraphs of the body's lines."""
    body = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = F.concat(F.lit("<html><body><nav><p>Menu</p></nav><h3><a href='/doc/"), F.col("doc_id").cast("string"), F.lit("'>Document "), F.col("doc_id").cast("string"), F.lit("</a></h3><img src='/img/logo.png'><img src='/img/photo-"), F.col("doc_id").cast("string"), F.lit(".jpg'><article><p>"))
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(head, F.replace(body, F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p></article></body></html>")).alias("html"))


_BODY_SQL = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_PAGE_SQL = f"""'<html><body><nav><p>Menu</p></nav><h3><a href=''/doc/' || doc_id || '''>Document ' || doc_id || '</a></h3><img src=''/img/logo.png''><img src=''/img/photo-' || doc_id || '.jpg''><article><p>' || replace({_BODY_SQL}, chr(10) || chr(10), '</p><p>') || '</p></article></body></html>'"""


@query(f"SELECT doc_id, regexp_replace({_PAGE_SQL}, '<[^>]+>', '', 'g') AS plain FROM documents")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", text.strip_tags(F.col("html")).alias("plain"))


@query(f"""SELECT doc_id, regexp_extract({_PAGE_SQL}, 'href=''([^'']+)''', 1) AS link, regexp_extract({_PAGE_SQL}, '<img[^>]+src=["'']([^"'']+)["'']', 1) AS image FROM documents""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First link and first image of each page by expressions."""
    return _pages(spark, sf_dir).select("doc_id", F.regexp_extract("html", "href='([^']+)'", 1).alias("link"), text.first_image(F.col("html")).alias("image"))


#: Heads of pages, and where a heading's link and a page's image stand in them: one of each sort, in turn by document.
_LINKS = [
    "<div><h3><a href='/doc/#'>Document #</a></h3></div>", "<a href='https://other.example/#'><div><h3>Document #</h3></div></a>", "<section><h3>Document #</h3><p>by</p><a href='/doc/#'>more</a></section>",
    "<li><p><a href='/doc/#'>more</a></p><h3>Document #</h3></li>", "<div><h3><a href='doc/#'>Document #</a></h3></div>",
]
_LINKED = ["https://site.example/doc/", "https://other.example/", "https://site.example/doc/", "https://site.example/doc/", None]
_IMAGES = [
    "<meta property='og:image' content='/img/card-#.jpg'><img src='/img/photo-#.jpg'>", "<meta property='og:image' content=''><img src='/img/logo.png'><img src='/img/photo-#.jpg'>", "<meta name='twitter:image' content='https://cdn.example/card-#.jpg'>",
    "<meta name='twitter:image' content='/img/other-#.jpg'><meta property='og:image:secure_url' content='//cdn.example/safe-#.jpg'>", "<img data-src='/img/banner-#.jpg'><img data-lazy-src='/img/lazy-#.jpg'>",
    "<img srcset='/img/large-#.jpg 2x, /img/small-#.jpg 1x'>", "<img src=''><img data-srcset='/img/set-#.jpg 100w'>", "<img src='/i.png'><img src='/img/avatar-#.png'>",
]
_PICTURED = ["https://site.example/img/card-", "https://site.example/img/photo-", "https://cdn.example/card-", "https://cdn.example/safe-", "https://site.example/img/lazy-", "https://site.example/img/large-", "https://site.example/img/set-", None]


def _in_turn(kinds: list[str], key: str) -> Column:
    """One of ``kinds`` for each row, in turn by its number, which replaces ``#``."""
    at = F.element_at(F.array(*map(F.lit, kinds)), (F.col(key) % len(kinds)).cast("int") + 1)
    return F.replace(at, F.lit("#"), F.col(key).cast("string"))


def _in_turn_sql(kinds: list[str | None], key: str, end: str = "") -> str:
    cases = " ".join(f"WHEN {k} THEN " + ("''" if x is None else f"'{x}' || {key} || '{end}'") for k, x in enumerate(kinds))
    return f"CASE {key} % {len(kinds)} {cases} END"


def _varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each document, of every sort of head, with a menu and a second, unwanted heading."""
    html = F.concat(F.lit("<html><head></head><body><nav><h3>News</h3></nav><h3 class='side'>Most read</h3>"), _in_turn(_LINKS, "doc_id"), _in_turn(_IMAGES, "doc_id"), F.lit("<h3>Last</h3></body></html>"))
    return table(spark, sf_dir, "documents").select("doc_id", html.alias("html"))


@query(f"SELECT doc_id, CAST(2 AS INTEGER) AS pos, 'Document ' || doc_id AS title, {_in_turn_sql(_LINKED, 'doc_id')} AS link FROM documents")
def listing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one wanted heading of each page with its nearest link, of all sorts: menu titles and classed headings dropped, then the limit."""
    return extract.listing_items(_varied(spark, sf_dir), "h3", "https://site.example", limit=1, after=True, drop=("NEWS",), plain=True, key="doc_id")


@query(f"SELECT doc_id, CAST(p AS INTEGER) AS pos, coalesce(t, 'Document ' || doc_id) AS title, CASE WHEN p = 2 THEN {_in_turn_sql(_LINKED, 'doc_id')} WHEN doc_id % 5 = 1 AND p = 1 THEN 'https://other.example/' || doc_id ELSE '' END AS link FROM documents, (VALUES (0, 'News'), (1, 'Most read'), (2, NULL)) v(p, t)")
def listing_limit_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three headings of each page, whatever they are: the limit comes before the filters."""
    return extract.listing_items(_varied(spark, sf_dir), "h3", "https://site.example", limit=3, key="doc_id")


@query(f"SELECT doc_id, {_in_turn_sql(_PICTURED, 'doc_id', '.jpg')} AS page_image FROM documents")
def hero_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's image: declared, plain, lazy or of a set, decoration left out."""
    return extract.page_facts(_varied(spark, sf_dir), "https://site.example", [], facts=("page_image",)).select("doc_id", "page_image")


_STRIPPED = r"regexp_replace(x, '^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$', '', 'g')"
_PARAGRAPHS_SQL = rf"list_filter(list_transform(string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) || chr(10)), lambda x: {_STRIPPED}), lambda x: x <> '')"


@query(f"WITH p AS (SELECT doc_id, {_PARAGRAPHS_SQL} AS ps FROM documents) SELECT doc_id, coalesce(array_to_string(ps[1:3], '. ')[1:400], '') AS page_summary FROM p")
def page_paragraph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first paragraphs of each page's article, read off its tree; the first selector matches nothing."""
    return extract.page_facts(_pages(spark, sf_dir), "https://site.example", ["div.detail", "article"], facts=("page_summary",)).select("doc_id", "page_summary")


@query(rf"WITH p AS (SELECT doc_id, list_transform({_PARAGRAPHS_SQL}, lambda x: regexp_replace(x, '[\s\p{{Z}}\x1c-\x1f\x85]+', ' ', 'g')) AS ps FROM documents) SELECT doc_id, CASE WHEN len(ps) > 0 THEN array_to_string(ps, chr(10) || chr(10)) ELSE 'Document ' || doc_id END AS page_text FROM p")
def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's main text by density; a page without any gives what it shows outside its menu."""
    return extract.page_facts(_pages(spark, sf_dir), "https://site.example", [], facts=("page_text",)).select("doc_id", "page_text")


@query(f"WITH p AS (SELECT doc_id, url, {_PARAGRAPHS_SQL} AS ps FROM documents) SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN '' ELSE coalesce(array_to_string(ps[1:3], '. ')[1:400], '') END AS page_summary, CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN '' ELSE 'https://site.example/img/photo-' || doc_id || '.jpg' END AS page_image FROM p")
def article_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages fetched and read in one pass; every third fetch fails, and every fourth address is no web address. The page travels as the address."""

    def fetch(url: str) -> str:
        if url.startswith("http://fails"):
            raise OSError
        return url.split("?", 1)[1]

    page = F.concat(F.when(F.col("doc_id") % 3 == 0, "http://fails?").when(F.col("doc_id") % 4 == 0, "ftp://x?").otherwise("http://x?"), "html")
    asked = _pages(spark, sf_dir).select("doc_id", page.alias("url"))
    read = extract.article_reads(asked.select("url"), fetch, "https://site.example", ["article"])
    return asked.join(read.distinct(), "url").select("doc_id", "page_summary", "page_image")


@query("SELECT doc_id, CASE WHEN url LIKE 'http%' THEN url ELSE 'https://site.example' || url END AS url FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN url ELSE '/doc/' || doc_id END AS url FROM documents)")
def link_absolutise(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("doc_id") % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("/doc/"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", urls.absolute("https://site.example")(own).alias("url"))


_FEED_TITLE = r"trim(regexp_replace(regexp_replace(replace(coalesce(title, ''), '&', '+'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]', '', 'g'), '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g'))"


@query(rf"""WITH n AS (SELECT *, ingest_seq // 12 AS feed, row_number() OVER (PARTITION BY ingest_seq // 12 ORDER BY ingest_seq) - 1 AS pos FROM articles)
SELECT feed, CAST(pos AS INTEGER) AS pos, {_FEED_TITLE} AS title, coalesce(url, '') AS url, CASE ingest_seq % 5 WHEN 0 THEN 'https://m.example/' WHEN 1 THEN 'https://e.example/' WHEN 2 THEN 'https://d.example/' WHEN 3 THEN 'https://site.example/body/' ELSE 'https://p.example/' END || ingest_seq || '.jpg' AS image_url
FROM n WHERE pos < 10 AND {_FEED_TITLE} <> ''""")
def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as feeds of up to twelve items with junk after the end, read back: the first ten, the image from media, enclosure, description, encoded body or page."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.replace(F.coalesce("title", F.lit("")), F.lit("&"), F.lit("+")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]", ""), r"[\s\p{Z}\x1c-\x1f\x85]+", " "))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), text.escape_html(c), F.lit(f"</{name}>"))
    picture = [
        "<media:content url='https://m.example/#.jpg'/><enclosure url='https://e.example/no.jpg'/>", "<enclosure url='https://e.example/#.jpg'/><description>&lt;img src='https://d.example/no.jpg'&gt;</description>",
        "<description>&lt;p&gt;x&lt;img src='/icon.png'&gt;&lt;img src='https://d.example/#.jpg'&gt;&lt;/p&gt;</description>", "<description>&lt;img src='/logo-wide.png'&gt;</description><content:encoded><![CDATA[<p><img data-src='/body/#.jpg'></p>]]></content:encoded>", "<description>none</description>",
    ]
    item = F.concat(F.lit("<item>"), tag("title", plain), tag("link", F.coalesce("url", F.lit(""))), _in_turn(picture, "ingest_seq"), F.lit("</item>"))
    # a feed is at most twelve items, so its group is bounded
    feeds = table(spark, sf_dir, "articles").groupBy(F.floor(F.col("ingest_seq") / 12).alias("feed")).agg(F.sort_array(F.collect_list(F.struct("ingest_seq", item.alias("xml")))).alias("x"))
    head = "<rss xmlns:media='http://search.yahoo.com/mrss/' xmlns:content='http://purl.org/rss/1.0/modules/content/'><channel>"
    xml = F.concat(F.lit(head), F.array_join(F.col("x.xml"), ""), F.lit("</channel></rss>junk<"))
    items = extract.feed_items(feeds.select("feed", xml.alias("xml")), key="feed", base="https://site.example")
    items = items.join(feeds.select("feed", "x.ingest_seq"), "feed").withColumn("seq", F.col("ingest_seq")[F.col("pos")]).withColumnRenamed("feed", "source")
    page = F.concat(F.lit("https://p.example/"), F.col("seq").cast("string"), F.lit(".jpg"))
    return extract.feed_articles(items, page).select(F.col("source").alias("feed"), "pos", "title", "url", "image_url")


@query(r"""SELECT ingest_seq, regexp_replace(coalesce(title, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS title,
CASE WHEN coalesce(summary, '') = '' THEN '(ไม่มีเนื้อหา)' ELSE regexp_replace(summary, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') END AS summary, source, url, coalesce(image_url, '') AS image_url, '2025-07-01 12:00:00' AS fetched_at FROM incoming""")
def article_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows in the store's shape."""
    own = table(spark, sf_dir, "incoming").withColumn("title", F.coalesce("title", F.lit("")))
    return extract.built(own, F.expr(CLOCK), "ingest_seq")


_ROWS_SQL = _CLASSES_SQL.replace("FROM articles", "FROM incoming")


@query(f"WITH {_ROWS_SQL} SELECT i.ingest_seq, c.category, c.method AS classification_method, coalesce(i.image_url, '') AS image_url FROM incoming i JOIN classes c USING (ingest_seq)")
def article_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming rows as complete stored rows, each classified."""
    _, lexicon, cues = _classified_tables(spark, sf_dir)
    return extract.articles_from(table(spark, sf_dir, "incoming"), lexicon, cues, F.expr(CLOCK)).select("ingest_seq", "category", "classification_method", "image_url")


# --- collect ---


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts for each document: a short cut, the text with a block notice on every seventh, the text."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), "doc_id", "text")
    rows = F.array(
        F.struct(F.lit(1).alias("tier"), F.when(F.col("doc_id") % 3 == 0, 503).otherwise(200).alias("status"), F.substring("text", 1, 101).alias("md")),
        F.struct(F.lit(2).alias("tier"), F.lit(200).alias("status"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Just a moment "), F.col("text"))).otherwise(F.col("text")).alias("md")),
        F.struct(F.lit(3).alias("tier"), F.lit(0).alias("status"), F.col("text").alias("md")),
    )
    return d.select("url", F.explode(rows).alias("x")).select("url", "x.*")


@query("""SELECT CAST(doc_id AS VARCHAR) AS url, CAST(CASE WHEN doc_id % 3 <> 0 AND length(text[1:101]) > 100 THEN 1 WHEN doc_id % 7 <> 0 AND length(text) > 100 AND NOT contains(text, 'Just a moment') AND NOT contains(text, 'Enable JavaScript') THEN 2
WHEN coalesce(text, '') <> '' THEN 3 END AS INTEGER) AS tier FROM documents""")
def fetch_tier_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first tier whose text is accepted."""
    return collect.first_accepted(_attempts(spark, sf_dir)).select("url", "tier")


@query(r"""SELECT ingest_seq, CASE WHEN regexp_replace(string_split(url, '/')[-1], '[\\/*?:"<>|]', '', 'g') = '' THEN 'article' ELSE coalesce(regexp_replace(string_split(url, '/')[-1], '[\\/*?:"<>|]', '', 'g'), 'article') END AS name FROM articles""")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").select("ingest_seq", text.safe_name(F.col("url")).alias("name"))


@query(r"""SELECT ingest_seq, '20250701_120000_' || CASE WHEN regexp_replace(string_split(url, '/')[-1], '[\\/*?:"<>|]', '', 'g') = '' THEN 'article' ELSE coalesce(regexp_replace(string_split(url, '/')[-1], '[\\/*?:"<>|]', '', 'g'), 'article') END || '.md' AS path,
'# Source URL: ' || url || chr(10) || chr(10) || summary AS text FROM articles""")
def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and texts of the files that captured pages are saved in."""
    return table(spark, sf_dir, "articles").select("ingest_seq", collect.capture_path(F.col("url"), F.expr(CLOCK)).alias("path"), collect.capture_text(F.col("url"), F.col("summary")).alias("text"))


@query("""SELECT ingest_seq, image_url AS url, CASE WHEN NOT coalesce(regexp_extract(image_url, '^https?://([^/?#]+)', 1) IN ('img.tuldoly1.example', 'img.sumevcon5.example'), false) THEN 400 WHEN contains(image_url, '7') THEN 502 ELSE 200 END::INTEGER AS status,
CASE WHEN coalesce(regexp_extract(image_url, '^https?://([^/?#]+)', 1) IN ('img.tuldoly1.example', 'img.sumevcon5.example'), false) AND NOT contains(image_url, '7') THEN length(image_url) END::BIGINT AS size FROM (SELECT min(ingest_seq) AS ingest_seq, image_url FROM articles GROUP BY image_url)""")
def image_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image asked of the proxy once, with a stand-in for the other side: addresses with a 7 are not found there, others are their own bytes."""
    asked = table(spark, sf_dir, "articles").groupBy(F.col("image_url").alias("url")).agg(F.min("ingest_seq").alias("ingest_seq"))
    answers = collect.proxied_images(asked.select("url"), HOSTS, lambda url: (404, None) if "7" in url else (200, url.encode()))
    return asked.join(answers, asked["url"].eqNullSafe(answers["url"])).select("ingest_seq", asked["url"], answers["status"].cast("int").alias("status"), F.length(answers["body"]).cast("bigint").alias("size"))


@query(r"""SELECT ingest_seq, nullif(regexp_extract(url, '^([A-Za-z]+)://', 1), '') AS scheme, nullif(regexp_extract(url, '^[A-Za-z]+://([^/?#]+)', 1), '') AS authority, CASE WHEN regexp_matches(url, '^https?://') THEN url END AS accepted,
CASE WHEN regexp_matches(url, '^[A-Za-z]+://[^/?#]+') THEN regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1) || '/healthz' ELSE '' END AS health, coalesce(regexp_extract(image_url, '^https?://([^/?#]+)', 1) IN ('img.tuldoly1.example', 'img.sumevcon5.example'), false) AS proxyable FROM articles""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "articles").select(
        "ingest_seq", urls.scheme(u).alias("scheme"), urls.authority(u).alias("authority"), urls.accepted_request(u).alias("accepted"), urls.health_url(u).alias("health"), urls.proxyable(F.col("image_url"), HOSTS).alias("proxyable")
    )


@query(f"SELECT ingest_seq, {_PROXY_SQL} AS image_url, url_encode(coalesce(title, '')) AS encoded FROM articles")
def proxy_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").select("ingest_seq", urls.proxied(F.col("image_url"), F.col("source"), [OUTLET], HOSTS).alias("image_url"), urls.percent_encode(F.coalesce("title", F.lit(""))).alias("encoded"))


@query("SELECT doc_id, CASE WHEN length(text) > 4000 THEN text[1:4000] || chr(10) || chr(10) || '...[Content Truncated]...' ELSE text END AS prompt FROM documents")
def truncate_for_llm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.for_model(F.col("text")).alias("prompt"))


@query(r"SELECT doc_id, array_to_string(string_split_regex(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '[\s\p{Z}]+')[1:500], ' ') AS cropped FROM documents")
def crop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.crop_words(F.col("text")).alias("cropped"))


_ANSWER = ("title", "source_url", "published_at", "language", "summary", "bullets", "category", "sentiment", "keywords")


@query(f"""WITH v AS (SELECT *, NOT coalesce(category NOT IN ({_VALID}) OR sentiment NOT IN ('positive', 'neutral', 'negative'), false) AND bullets IS NOT NULL AND keywords IS NOT NULL AS valid FROM summaries)
SELECT summary_id, valid, {", ".join(f"CASE WHEN valid THEN {c} END AS {c}" for c in _ANSWER)} FROM v""")
def strip_fences_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries written as fenced JSON answers, parsed and validated again, all nine fields."""
    raw = F.concat(F.lit("```json\n"), collect.answer_text(F.struct(*_ANSWER)), F.lit("\n```"))
    own = table(spark, sf_dir, "summaries").select("summary_id", collect.parsed_answer(raw).alias("s"))
    return own.select("summary_id", F.col("s").isNotNull().alias("valid"), *[F.col(f"s.{c}").alias(c) for c in _ANSWER])


@query("SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 422 WHEN doc_id % 5 = 0 THEN 500 ELSE 200 END::INTEGER AS status, CASE WHEN coalesce(text, '') <> '' AND doc_id % 5 <> 0 THEN length(CASE WHEN length(text) > 4000 THEN text[1:4000] || chr(10) || chr(10) || '...[Content Truncated]...' ELSE text END) END::BIGINT AS n_chars FROM documents")
def summarise_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through gate, model and validation, with a deterministic stand-in for the model that says how long its prompt is; every fifth answer is no JSON."""

    def client(prompt: str) -> str:
        import json

        return "```json\n" + json.dumps({"title": str(len(prompt)), "category": "world", "sentiment": "neutral"}) + "\n```"

    docs = table(spark, sf_dir, "documents")
    answered = lambda part, ask: collect.summarised(part.select(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("md"), F.lit("given").alias("method")), ask)
    out = answered(docs.where("doc_id % 5 <> 0"), client).unionByName(answered(docs.where("doc_id % 5 = 0"), lambda prompt: "no answer"))
    return out.select(F.col("url").cast("bigint").alias("doc_id"), F.col("status").cast("int").alias("status"), F.col("summary.title").cast("bigint").alias("n_chars"))


@query("SELECT summary_id, CASE WHEN contains(lower(sentiment), 'positive') THEN 'positive' WHEN contains(lower(sentiment), 'negative') THEN 'negative' ELSE 'neutral' END AS shown FROM summaries")
def sentiment_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentiment a reader sees: by substring, in any case."""
    low = F.lower("sentiment")
    shown = F.when(F.contains(low, F.lit(SENTIMENTS[0])), SENTIMENTS[0]).when(F.contains(low, F.lit(SENTIMENTS[2])), SENTIMENTS[2]).otherwise(SENTIMENTS[1])
    return table(spark, sf_dir, "summaries").select("summary_id", shown.alias("shown"))


@query("SELECT ingest_seq, replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM articles")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "articles").select("ingest_seq", text.escape_html(F.col("title")).alias("escaped"))


@query("SELECT ingest_seq, title AS plain FROM articles")
def html_unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles escaped and read back, those that hold entities themselves included."""
    return table(spark, sf_dir, "articles").select("ingest_seq", text.unescape(text.escape_html(F.col("title"))).alias("plain"))


# --- store ---


@query("SELECT url, n FROM (SELECT url, count(*) AS n FROM (SELECT url FROM articles UNION ALL SELECT url FROM incoming) WHERE url <> '' GROUP BY url)")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles and incoming rows appended to a store, exported and read back: each seen address, once, with its stored rows."""
    from tidewrack.sources.store import Store

    path = scratch(spark, "store")
    store = Store(spark, path)
    for part in (table(spark, sf_dir, "articles"), table(spark, sf_dir, "incoming")):
        store.append(part)
    store.export(f"{path}/export")
    rows = spark.read.schema("url string").json(f"{path}/export/articles").groupBy("url").agg(F.count("*").alias("n"))
    return spark.read.schema("url string").json(f"{path}/export/seen_urls").join(rows, "url").select("url", "n")


# --- stream, ops ---


@query("""SELECT ingest_seq FROM (SELECT *, rank() OVER (PARTITION BY batch_no, url ORDER BY source_ord) AS r, min(batch_no) OVER (PARTITION BY url) AS first_batch FROM incoming WHERE url <> '') WHERE batch_no = first_batch AND r = 1""")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``incoming`` as a file stream: its twelve batches arrive one after the other, and the stream takes each up where the last run ended."""
    from tidewrack.streaming.ingest import Ingest

    path = scratch(spark, "ingest")
    sink, rows = Ingest(spark, f"{path}/store"), table(spark, sf_dir, "incoming")
    for r in sorted(x["batch_no"] for x in rows.select("batch_no").distinct().collect()):
        rows.where(F.col("batch_no") == r).write.mode("append").parquet(f"{path}/arrivals")
        sink.start(spark.readStream.schema(rows.schema).parquet(f"{path}/arrivals"), f"{path}/offsets", None).awaitTermination()
    return sink.stored("ingest_seq bigint")


@query("SELECT CAST(vec_id AS BIGINT) AS vec_id, round(max(p), 6) AS confidence FROM (SELECT vec_id, exp(x - max(x) OVER (PARTITION BY vec_id)) / sum(exp(x)) OVER (PARTITION BY vec_id) * exp(max(x) OVER (PARTITION BY vec_id)) AS p FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)) GROUP BY 1")
def softmax_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest normalised exponential of each vector."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.round(F.array_max(tok.softmax(values)), 6).alias("confidence"))


@query("""WITH v AS (SELECT vec_id, embedding AS e, embedding[1] AS x FROM embeddings), p AS (SELECT vec_id, x, list_position(e, list_max(e)) - 1 AS k, 1 / list_sum(list_transform(e, lambda y: exp(y::DOUBLE - list_max(e)::DOUBLE))) AS share FROM v)
SELECT CAST(vec_id AS BIGINT) AS vec_id, 'c' || k AS label, round(share, 6) AS confidence, CASE WHEN x > 0 THEN 'yes' ELSE 'no' END AS binary_label, round(1 / (1 + exp(-abs(x::DOUBLE))), 6) AS binary_confidence, 0.6::DOUBLE AS unscored FROM p""")
def model_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and confidences from a model's decision values, from a single one, and from a model without any."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    size = own.select(F.max(F.size("e"))).first()[0] or 0
    many, one, none = model.judged(F.col("e"), [f"c{k}" for k in range(size)], "decision"), model.judged(F.col("e")[0], ["no", "yes"], "binary"), model.judged(F.lit("x"), [], "label")
    own = own.select("vec_id", many.alias("m"), one.alias("o"), none.alias("n"))
    return own.select("vec_id", "m.label", F.round("m.confidence", 6).alias("confidence"), F.col("o.label").alias("binary_label"), F.round("o.confidence", 6).alias("binary_confidence"), F.col("n.confidence").cast("double").alias("unscored"))


@query("SELECT count(*) AS total, '15 minutes' AS every, '2025-07-01 12:00:00' AS now, CASE WHEN (SELECT bool_and(regexp_matches(url, '^[A-Za-z]+://[^/?#]+')) FROM sources) THEN 'ready' ELSE 'not_ready' END AS ready FROM articles")
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row about the store: rows, interval, clock, readiness of its folder and of each source's health address."""
    parts = table(spark, sf_dir, "sources").select("name", "url")
    ready = health.readiness(health.storage(spark, checkpoint_dir(spark)), health.services(parts, lambda url: 200 if url.endswith("/healthz") else 404))
    total = table(spark, sf_dir, "articles").agg(F.count("*").alias("total"))
    return total.crossJoin(F.broadcast(ready)).select("total", text.minutes_label(F.lit(15)).alias("every"), F.date_format(F.expr(CLOCK), "yyyy-MM-dd HH:mm:ss").alias("now"), F.col("status").alias("ready"))


@query("""WITH e AS (SELECT event_type, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, hour, n, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY hour) AS BIGINT) AS total FROM e""")
def event_running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each event type by hour, and running."""
    hour = F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("hour")
    own = table(spark, sf_dir, "events").groupBy("event_type", hour).agg(F.count("*").alias("n"))
    return own.withColumn("total", F.sum("n").over(Window.partitionBy("event_type").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)))
