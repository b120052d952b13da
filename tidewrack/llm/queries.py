"""Queries of the text operators, and SQL where it can express them over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm import languages, leaks, line_templates, residue, sentences, shared_spans, stories, subjects, tokenize, truncated
from tidewrack.runtime import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _language_field(spark: SparkSession, sf_dir: str) -> languages.LanguageField:
    return languages.LanguageField().fit(languages.sample(table(spark, sf_dir, "summaries"), "summary_id", "summary", "language"))


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in several languages, and summaries whose label doesn't name their language."""
    field = _language_field(spark, sf_dir)
    a = languages.mislabelled(table(spark, sf_dir, "summaries"), field, "summary_id", "summary", "language")
    b = languages.mislabelled(table(spark, sf_dir, "articles"), field, "ingest_seq", "summary")
    a, b = (df.select(F.lit(name).alias("tbl"), F.col(key).alias("rec_id"), "lang") for name, key, df in (("summaries", "summary_id", a), ("articles", "ingest_seq", b)))
    return a.unionByName(b).distinct()


@query
def p1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of every text with their language and a confidence."""
    field = _language_field(spark, sf_dir)
    a, b = (languages.passages(table(spark, sf_dir, name), field, key, "summary").select(F.lit(name).alias("tbl"), F.col(key).alias("rec_id"), "start_pos", "end_pos", "lang", "confidence") for name, key in (("summaries", "summary_id"), ("articles", "ingest_seq")))
    return a.unionByName(b)


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``incoming`` whose story is older, with the row that brought it first."""
    return stories.repeated_stories(table(spark, sf_dir, "articles"), table(spark, sf_dir, "incoming"))


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose summary is cut off."""
    return truncated.truncated(table(spark, sf_dir, "articles")).distinct()


@query
def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each source's summaries are cut off."""
    return truncated.rates(table(spark, sf_dir, "articles"))


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects(table(spark, sf_dir, "articles"), table(spark, sf_dir, "lexicon"), table(spark, sf_dir, "subject_labels"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects each article reports on."""
    return _subjects(spark, sf_dir).select("ingest_seq", "subject").distinct()


@query
def p4_make_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collection's make-up: articles for each subject."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.countDistinct("ingest_seq").alias("n_articles"))


@query
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and summaries of ``articles`` that are residue or hold an unfilled slot."""
    return residue.residue(table(spark, sf_dir, "articles")).select("ingest_seq", "field").distinct()


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``articles.summary`` that their source repeats."""
    return line_templates.repeated_lines(table(spark, sf_dir, "articles")).select("ingest_seq", F.col("line_no").cast("int").alias("line_no"))


@query
def p6_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each summary without its repeated lines."""
    return line_templates.strip_lines(table(spark, sf_dir, "articles").select("ingest_seq", "source", "summary"))


@query
def p6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that a source repeats with other names or words in some places, as templates with slots, and how many rows hold one."""
    return line_templates.learned_templates(table(spark, sf_dir, "articles"))


def _boundaries(spark: SparkSession, sf_dir: str) -> tuple[list[tuple[str, DataFrame, str]], sentences.BoundaryModel]:
    """The tables with sentences, and a boundary model fitted to both."""
    tables = [("articles", table(spark, sf_dir, "articles"), "ingest_seq"), ("summaries", table(spark, sf_dir, "summaries"), "summary_id")]
    return tables, sentences.fit([df.select("summary") for _, df, _ in tables])


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each sentence of each summary of ``articles`` and ``summaries`` starts."""
    tables, model = _boundaries(spark, sf_dir)
    a, b = (sentences.sentences(df, model, key, "summary").select(F.lit(name).alias("tbl"), F.col(key).alias("rec_id"), "start_pos") for name, df, key in tables)
    return a.unionByName(b)


@query
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by the 50k byte-level vocabulary."""
    return tokenize.token_ids(table(spark, sf_dir, "documents"))


@query
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold four tenths or more of a held-out item in one stretch."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


@query
def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item that leaked, the number of documents and the largest share of it that stands in one."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy(F.col("item").alias("item_id")).agg(F.countDistinct("doc").alias("n_docs"), F.max("share").alias("max_share"))


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with a run of at least 200 characters in common."""
    return shared_spans.shared_pairs(table(spark, sf_dir, "documents"))


@query
def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document with shared passages, how many others it shares them with and how much of it is shared."""
    return shared_spans.shared_share(table(spark, sf_dir, "documents"))


ORACLE["p6_found"] = r"""
WITH lines AS (
  SELECT ingest_seq, source, unnest(string_split(summary, chr(10))) AS line, generate_subscripts(string_split(summary, chr(10)), 1) - 1 AS line_no
  FROM articles WHERE source <> '' AND summary <> '(ไม่มีเนื้อหา)'),
keyed AS (
  SELECT ingest_seq, source, line_no,
    regexp_replace(regexp_replace(lower(nfc_normalize(line)), '[\s\p{P}\p{S}\p{Z}]+', '', 'g'), '[0-9๐-๙]+', '#', 'g') AS k
  FROM lines WHERE line <> '(ไม่มีเนื้อหา)'),
kept AS (SELECT source, k, count(DISTINCT ingest_seq) AS n FROM keyed WHERE k <> '' GROUP BY source, k),
totals AS (SELECT source, count(*) AS c FROM articles GROUP BY source)
SELECT DISTINCT keyed.ingest_seq, CAST(keyed.line_no AS INTEGER) AS line_no
FROM keyed JOIN kept USING (source, k) JOIN totals USING (source)
WHERE n >= 5 AND n >= 0.03 * c"""

ORACLE["p6_stripped"] = f"""
WITH found AS ({ORACLE["p6_found"]}),
split AS (SELECT ingest_seq, unnest(string_split(summary, chr(10))) AS line, generate_subscripts(string_split(summary, chr(10)), 1) - 1 AS line_no FROM articles),
kept AS (SELECT s.ingest_seq, string_agg(s.line, chr(10) ORDER BY s.line_no) AS summary FROM split s LEFT JOIN found f ON f.ingest_seq = s.ingest_seq AND f.line_no = s.line_no WHERE f.ingest_seq IS NULL GROUP BY 1)
SELECT a.ingest_seq, a.source, CASE WHEN a.summary IS NOT NULL THEN coalesce(k.summary, '') END AS summary FROM articles a LEFT JOIN kept k USING (ingest_seq)"""

# windows of 200 characters by their hashes; shared ones are those of more than one document
_WINDOWS = """
WITH w AS (SELECT doc_id, i, hash(substring(text, i, 200)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
hot AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), s AS (SELECT doc_id, i, h FROM w SEMI JOIN hot USING (h))"""

ORACLE["p10_found"] = f"""{_WINDOWS}, d AS (SELECT DISTINCT doc_id, h FROM s)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM d a JOIN d b ON a.h = b.h AND a.doc_id < b.doc_id"""

ORACLE["p10_share"] = f"""{_WINDOWS}, d AS (SELECT DISTINCT doc_id, h FROM s),
p AS (SELECT DISTINCT a.doc_id, b.doc_id AS other FROM d a JOIN d b ON a.h = b.h AND a.doc_id <> b.doc_id), n AS (SELECT doc_id, count(*) AS n_others FROM p GROUP BY 1),
c AS (SELECT doc_id, CAST(sum(least(200, i - coalesce(before, -1000))) AS BIGINT) AS shared_chars FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM s) GROUP BY 1)
SELECT c.doc_id AS doc, n_others, shared_chars, shared_chars / length(text) AS share FROM c JOIN n USING (doc_id) JOIN documents USING (doc_id)"""
