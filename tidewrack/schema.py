"""Row shapes and enumerations of the engine."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

# --- Fixed values: names, enumerations and formats that stored data and clients depend on.
#: Categories in lexicon order, which decides ties; the three sentiments; the mark for an empty summary; the store's clock format.
CATEGORIES = ("politics", "economy", "technology", "health", "environment", "society", "sports", "entertainment", "world")
SENTIMENTS = ("positive", "neutral", "negative")
PLACEHOLDER = "(ไม่มีเนื้อหา)"
CLOCK = "yyyy-MM-dd HH:mm:ss"
#: Mark after text that was cut for a model.
TRUNCATED = "\n\n...[Content Truncated]..."

_TEXT = StringType()
STORED_ARTICLE = StructType([StructField(c, _TEXT) for c in ("title", "summary", "source", "url", "image_url", "category", "classification_method", "fetched_at")])
ARTICLE = StructType([StructField("ingest_seq", LongType()), StructField("source_ord", IntegerType()), *STORED_ARTICLE.fields])
STORE_DOCUMENT = StructType(
    [
        StructField("metadata", StructType([StructField("version", _TEXT), StructField("last_updated", _TEXT), StructField("total_articles", IntegerType()), StructField("total_sources", IntegerType())])),
        StructField("articles", ArrayType(STORED_ARTICLE)),
        StructField("seen_urls", ArrayType(_TEXT)),
    ]
)
CAPTURE = StructType([StructField(c, _TEXT) for c in ("url", "md", "method", "path", "captured_at")])
SUMMARY = StructType(
    [StructField(c, _TEXT) for c in ("title", "source_url", "published_at", "language", "summary")]
    + [StructField("bullets", ArrayType(_TEXT)), StructField("category", _TEXT), StructField("sentiment", _TEXT), StructField("keywords", ArrayType(_TEXT))]
)
SOURCE = StructType([StructField("source_ord", IntegerType()), StructField("name", _TEXT), StructField("url", _TEXT), StructField("color", _TEXT)])
COMPOUND_RULE = StructType([StructField("category", _TEXT), StructField("rule_id", IntegerType()), StructField("tokens", ArrayType(_TEXT))])
