"""Categories by address cues, keyword and phrase scores, and rules on tokens; an optional model for what the rules leave open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.text import strip, weighted_text
from tidewrack.functions.tokens import grams, grams_from, has_all, once, words
from tidewrack.runtime import bounded
from tidewrack.schema import CATEGORIES, COMPOUND_RULE

#: Points for a satisfied rule; margin that settles a category at once; categories that a margin alone never settles; confidence a model needs.
BONUS, MARGIN, DEFERRED, TRUST = 5.0, 5.0, ("economy", "politics", "society"), 0.5

#: Keywords up to which their first tokens are a literal set of the plan.
STARTS = 5_000

#: A starter set of rules: all parts must occur. Any table of the same shape may be passed instead.
RULES = [
    ("economy", 0, ["interest", "rate"]), ("economy", 1, ["export", "orders"]), ("economy", 2, ["wage", "growth"]), ("economy", 3, ["zolltarif", "lohnwachstum"]),
    ("environment", 0, ["flood", "barrier"]), ("environment", 1, ["air", "quality"]), ("environment", 2, ["river", "pollution"]), ("environment", 3, ["luftqualität", "plastikmüll"]),
]


def rules_table(spark) -> DataFrame:
    return spark.createDataFrame(RULES, COMPOUND_RULE)


def cue_list(cues: DataFrame, bound: int = 1000) -> list[tuple[int, str, str]]:
    """A site's cues, which become part of the plan; more than ``bound`` are an error."""
    rows = cues.select("cue_ord", "cue", "category").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"over {bound} address cues")
    return [tuple(r) for r in rows]


def cue_column(url: Column, cues: list[tuple[int, str, str]]) -> tuple[Column, Column]:
    """Category and cue of the first cue that stands in an address, nulls if none does."""
    category, cue = F.lit(None).cast("string"), F.lit(None).cast("string")
    low = F.lower(F.coalesce(url, F.lit("")))
    for _, text, name in sorted(cues, reverse=True):
        hit = F.contains(low, F.lit(text))
        category, cue = F.when(hit, F.lit(name)).otherwise(category), F.when(hit, F.lit(text)).otherwise(cue)
    return category, cue


def scored(docs: DataFrame, lexicon: DataFrame, rules: DataFrame, doc: str = "ingest_seq", tokens: str = "tokens") -> DataFrame:
    """``(<doc>, category, score)``: weights of all keyword occurrences plus the bonus of each satisfied rule; categories without any are left out.

    Each occurrence of a keyword of n tokens is an n-gram that equals it, so scoring is one equi-join. The lexicon is broadcast after its
    size has been checked and joined by a shuffle beyond that.
    """
    lex = lexicon.where(F.size("tokens") > 0).select("category", F.array_join("tokens", " ").alias("gram"), F.col("tokens")[0].alias("start"), F.size("tokens").alias("n"), "weight")
    if bounded(lexicon, STARTS):
        # a small lexicon's first tokens are a literal set, so only n-grams that can match are built and leave the scan
        by_length: dict[int, set[str]] = {}
        for r in lex.select("n", "start").distinct().collect():
            by_length.setdefault(r["n"], set()).add(r["start"])
        built, side = [(lambda t, n=n, own=own: grams_from(t, n, sorted(own))) for n, own in sorted(by_length.items())], F.broadcast(lex)
    else:
        lengths = [r["n"] for r in lex.select("n").distinct().orderBy("n").collect()]  # a few: the lengths of phrases
        built, side = [(lambda t, n=n: grams(t, n)) for n in lengths], lex
    every = once(F.col(tokens), lambda t: F.flatten(F.array(*[f(t) for f in built]))) if built else F.array().cast("array<string>")
    hits = docs.select(F.col(doc), F.explode(every).alias("gram")).join(side.select("category", "gram", "weight"), "gram").groupBy(doc, "category").agg(F.sum("weight").alias("score"))
    return hits.unionByName(bonuses(docs, rules, doc, tokens)).groupBy(doc, "category").agg(F.sum("score").alias("score"))


def bonuses(docs: DataFrame, rules: DataFrame, doc: str = "ingest_seq", tokens: str = "tokens") -> DataFrame:
    """``(<doc>, category, score)``: the bonus of each satisfied rule. Rules are looked up by their first part, so documents meet only rules they can satisfy."""
    own = rules.where(F.size("tokens") > 0).select("category", F.array_distinct("tokens").alias("parts")).withColumn("gram", F.col("parts")[0])
    has = docs.select(F.col(doc), F.array_distinct(tokens).alias("has"))
    if bounded(rules, STARTS):
        starts = sorted(r["gram"] for r in own.select("gram").distinct().collect())
        has = has.select(doc, "has", F.explode(F.filter("has", lambda t: t.isin(starts) if starts else F.lit(False))).alias("gram"))
        own = F.broadcast(own)
    else:
        has = has.select(doc, "has", F.explode("has").alias("gram"))
    bonus = has.join(own, "gram").where(has_all(F.col("has"), F.col("parts")))
    return bonus.groupBy(doc, "category").agg((F.count("*") * F.lit(BONUS)).alias("score"))


def top_two(scores: DataFrame, doc: str = "ingest_seq") -> DataFrame:
    """``(<doc>, top1, score1, top2, score2)``; ties go by category order, categories without points count as 0."""
    rank = F.create_map(*[F.lit(x) for k, c in enumerate(CATEGORIES) for x in (c, k)])
    rows = scores.where(F.col("category").isin(*CATEGORIES))
    sums = rows.groupBy(doc).agg(*[F.coalesce(F.max(F.when(F.col("category") == c, F.col("score"))), F.lit(0.0)).alias(c) for c in CATEGORIES])
    order = F.sort_array(F.array(*[F.struct((-F.col(c)).alias("s"), F.element_at(rank, F.lit(c)).alias("k"), F.lit(c).alias("c")) for c in CATEGORIES]))
    return sums.select(doc, order[0]["c"].alias("top1"), (-order[0]["s"]).alias("score1"), order[1]["c"].alias("top2"), (-order[1]["s"]).alias("score2"))


def classify(
    articles: DataFrame, lexicon: DataFrame, cues: DataFrame, rules: DataFrame | None = None, doc: str = "ingest_seq", tokenise: Callable[[Column], Column] = words, model: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``(<doc>, category, method)`` for every article.

    An address cue decides first, then blank text falls back, then a clear margin, then ``model`` (documents to ``(<doc>, label, confidence)``, asked only
    about rows the rules leave open), then any points, then the default. ``cues`` is the site's short ordered list.
    """
    from tidewrack.operators.lookup import from_model_label

    rules = rules if rules is not None else rules_table(articles.sparkSession)
    listed = cue_list(cues)
    cue_category, cue = cue_column(F.col("url"), listed)
    text = weighted_text(F.col("title"), F.col("summary"))
    own = articles.select(doc, cue_category.alias("cue_category"), cue.alias("cue"), text.alias("text"), (strip(text) == "").alias("blank"))
    open_rows = own.where(F.col("cue").isNull() & ~F.col("blank")).select(doc, "text", tokenise(F.col("text")).alias("tokens"))
    top = top_two(scored(open_rows, lexicon, rules, doc), doc)
    joined = own.select(doc, "cue_category", "cue", "blank", "text").join(top, doc, "left")
    s1, s2 = F.coalesce("score1", F.lit(0.0)), F.coalesce("score2", F.lit(0.0))
    settled = F.coalesce(~F.col("top1").isin(*DEFERRED), F.lit(False)) & (s1 - s2 >= MARGIN)
    if model is None:
        joined = joined.withColumn("label", F.lit(None).cast("string")).withColumn("confidence", F.lit(0.0))
    else:
        asked = joined.where(F.col("cue").isNull() & ~F.col("blank") & ~settled).select(doc, "text")
        joined = joined.join(model(asked), doc, "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    sure = F.col("confidence").cast("double")
    steps = [
        (F.col("cue").isNotNull(), F.col("cue_category"), F.concat(F.lit("URL Priority ("), F.col("cue"), F.lit(")"))),
        (F.col("blank"), F.lit("society"), F.lit("Fallback (Empty Text)")),
        (settled, F.col("top1"), F.format_string("Rule-based (Domain Expert: %s, score=%.1f)", F.col("top1"), s1)),
        (sure >= TRUST, from_model_label(F.col("label")), F.format_string("ML (%s) (conf=%.2f)", F.col("label"), sure)),
        (s1 > 0, F.col("top1"), F.format_string("Rule-based (ML Low Confidence: %.2f)", sure)),
    ]
    category, method = F.lit("society"), F.format_string("Fallback (Default, ML conf: %.2f)", sure)
    for test, c, m in reversed(steps):
        category, method = F.when(test, c).otherwise(category), F.when(test, m).otherwise(method)
    return joined.select(doc, category.alias("category"), method.alias("method"))


def backfilled(articles: DataFrame, lexicon: DataFrame, cues: DataFrame, rules: DataFrame | None = None, force: bool = False, **options) -> DataFrame:
    """``articles`` with missing and unknown categories filled in, and ``changed``; only those rows are classified. ``ingest_seq`` must be unique."""
    wrong = F.lit(True) if force else F.coalesce(~F.col("category").isin(*CATEGORIES), F.lit(True))
    found = classify(articles.where(wrong), lexicon, cues, rules, **options).withColumnsRenamed({"category": "_category", "method": "_method"})
    own = articles.join(found, "ingest_seq", "left").withColumn("changed", F.col("_category").isNotNull())
    own = own.withColumn("category", F.coalesce("_category", "category")).withColumn("classification_method", F.coalesce("_method", "classification_method"))
    return own.drop("_category", "_method")
