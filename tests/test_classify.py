"""Scores, rules and classification on hand-made rows."""

from pyspark.sql import functions as F

from tidewrack.functions.tokens import words
from tidewrack.operators import classify


def lexicon(spark, *rows):
    return spark.createDataFrame([(c, k, k.split(), w) for c, k, w in rows], "category string, keyword string, tokens array<string>, weight double")


def cues(spark):
    return spark.createDataFrame([(1, "-sport", "sports"), (2, "/tech", "technology")], "cue_ord int, cue string, category string")


def run(spark, lex, *docs, **options):
    rows = spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "ingest_seq bigint, url string, title string, summary string")
    return [(r.category, r.method) for r in classify.classify(rows, lex, cues(spark), classify.rules_table(spark).limit(0), **options).orderBy("ingest_seq").collect()]


def test_branches(spark):
    lex = lexicon(spark, ("sports", "goal", 1.0), ("politics", "vote", 1.0), ("economy", "bond", 1.0))
    got = run(
        spark, lex,
        ("https://h/x-sport-y/tech", "a", ""), ("", "", ""), (None, None, None), ("", "none of it", ""),
        ("", "goal goal", "goal goal goal vote vote vote vote"),  # 9 to 4
        ("", "goal goal", "goal goal vote vote vote vote"),  # 8 to 4
        ("", "vote vote vote", ""), ("", "", "goal bond"),
    )
    assert got == [
        ("sports", "URL Priority (-sport)"), ("society", "Fallback (Empty Text)"), ("society", "Fallback (Empty Text)"), ("society", "Fallback (Default, ML conf: 0.00)"),
        ("sports", "Rule-based (Domain Expert: sports, score=9.0)"), ("sports", "Rule-based (ML Low Confidence: 0.00)"),
        ("politics", "Rule-based (ML Low Confidence: 0.00)"), ("economy", "Rule-based (ML Low Confidence: 0.00)"),
    ]


def test_model_is_asked_about_open_rows_only(spark):
    lex = lexicon(spark, ("sports", "goal", 1.0))
    asked = []

    def model(df):
        asked.append(df.count())
        return df.select("ingest_seq", F.lit("economics").alias("label"), F.lit(0.75).alias("confidence"))

    got = run(spark, lex, ("", "goal goal", ""), ("", "other", ""), ("https://h/tech", "other", ""), model=model)
    assert got[1] == ("economy", "ML (economics) (conf=0.75)") and got[0][0] == "sports" and got[2][0] == "technology" and asked == [1]


def test_scores(spark):
    lex = lexicon(spark, ("economy", "a a", 2.0), ("economy", "a", 1.0), ("world", "x", 1.0))
    docs = spark.createDataFrame([(1, "a a a"), (2, ""), (3, None)], "ingest_seq bigint, t string").select("ingest_seq", words(F.col("t")).alias("tokens"))
    rules = spark.createDataFrame([("economy", 0, ["a", "b"]), ("world", 1, ["a"])], "category string, rule_id int, tokens array<string>")
    got = {(r.ingest_seq, r.category): r.score for r in classify.scored(docs, lex, rules).collect()}
    assert got == {(1, "economy"): 7.0, (1, "world"): 5.0}
    assert classify.scored(docs, lex.limit(0), rules.limit(0)).count() == 0


def test_top_two_ties_in_order(spark):
    scores = spark.createDataFrame([(1, "sports", 3.0), (1, "economy", 3.0)], "ingest_seq bigint, category string, score double")
    r = classify.top_two(scores).first()
    assert (r.top1, r.score1, r.top2, r.score2) == ("economy", 3.0, "sports", 3.0)


def test_backfill(spark):
    rows = spark.createDataFrame([(0, "", "goal", "", "Sports", None), (1, "", "goal", "", "world", "kept"), (2, "", "", "", None, None)], "ingest_seq bigint, url string, title string, summary string, category string, classification_method string")
    out = classify.backfilled(rows, lexicon(spark, ("sports", "goal", 1.0)), cues(spark)).orderBy("ingest_seq").collect()
    assert [(r.category, r.changed) for r in out] == [("sports", True), ("world", False), ("society", True)] and out[1].classification_method == "kept"


def test_model_step(spark):
    from tidewrack.operators import model

    def score(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[float(len(t.split())), 1.0] for t in texts]

    docs = spark.createDataFrame([(1, "w " * 900), (2, ""), (3, "bad"), (4, None)], "ingest_seq bigint, text string")
    got = {r.ingest_seq: (r.label, round(r.confidence, 3)) for r in model.model_step(score, ["long", "short"])(docs).collect()}
    assert got == {1: ("long", 1.0), 2: ("short", 0.731), 3: (None, 0.0), 4: ("short", 0.731)}
    one = model.model_step(lambda texts: [-1.0 for _ in texts], ["no", "yes"], "binary")(docs.limit(1)).first()
    assert (one.label, round(one.confidence, 3)) == ("no", 0.731)
    assert model.model_step(lambda texts: ["x" for _ in texts], [], "label")(docs.limit(1)).first().confidence == 0.6
    assert model.model_step(score, ["a", "b"])(docs.limit(0)).count() == 0


def test_trained_model(spark):
    from tidewrack.operators import model

    rows = [(k, f"goal match team {k}" if k % 2 else f"vote party law {k}", "social" if k % 2 else "politics") for k in range(40)]
    df = spark.createDataFrame(rows, "ingest_seq bigint, text string, label string")
    step = model.trained(df)
    assert all(r.label == w[2] and 0.5 < r.confidence <= 1 for r, w in zip(step(df.select("ingest_seq", "text")).orderBy("ingest_seq").collect(), rows))
