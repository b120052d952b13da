"""The classifier's model step: cropped text in, a label and a confidence out, whatever kind of scores the model has."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions.text import crop_words
from tidewrack.functions.tokens import softmax

#: Words of a text that a model reads; confidence of a model without scores (fixed values).
WORDS, UNSCORED = 500, 0.6


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def judged(scores: Column, classes: list[str], kind: str) -> Column:
    """``struct(label, confidence)`` from a model's ``scores``; null scores give nulls.

    ``proba``: an array of probabilities; ``decision``: an array of one score for each class, made probabilities by a softmax; ``binary``: one score, the
    second class where it is positive; ``label``: the label itself, with a fixed confidence. Ties go to the first class.
    """
    if kind == "label":
        return F.struct(scores.alias("label"), F.when(scores.isNotNull(), UNSCORED).alias("confidence"))
    if kind == "binary":
        label = F.when(scores > 0, classes[1]).when(scores.isNotNull(), classes[0])
        return F.struct(label.alias("label"), sigmoid(F.abs(scores)).alias("confidence"))
    shares = softmax(scores) if kind == "decision" else scores
    names = F.array(*map(F.lit, classes))
    first = F.array_position(scores, F.array_max(scores)).cast("int")
    return F.struct(F.when(F.array_max(scores).isNotNull() & (first > 0), F.element_at(names, first)).alias("label"), F.array_max(shares).alias("confidence"))


def model_step(score: Callable[[list[str]], list], classes: list[str], kind: str = "decision", doc: str = "ingest_seq", text: str = "text") -> Callable[[DataFrame], DataFrame]:
    """What :func:`classify` takes as ``model``: documents to ``(<doc>, label, confidence)``.

    ``score`` gets a batch of texts, cropped to their first words, and gives scores as :func:`judged` takes them. Where it fails on a batch its texts are
    scored one by one, and one that fails alone has no label and a confidence of 0, so the rules go on without a model.
    """
    shape = {"binary": "double", "label": "string"}.get(kind, "array<double>")

    def one(t: str):
        try:
            return score([t])[0]
        except Exception:  # noqa: BLE001 a text the model can't read is left to the rules
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b.pop("_cropped").tolist()
            try:
                b["scores"] = pd.Series(list(score(texts)), dtype=object, index=b.index)
            except Exception:  # noqa: BLE001
                b["scores"] = pd.Series([one(t) for t in texts], dtype=object, index=b.index)
            yield b

    def step(docs: DataFrame) -> DataFrame:
        own = docs.select(doc, crop_words(F.coalesce(F.col(text), F.lit("")), WORDS).alias("_cropped"))
        scored = own.mapInPandas(run, f"{doc} {dict(docs.dtypes)[doc]}, scores {shape}").withColumn("j", judged(F.col("scores"), classes, kind))
        return scored.select(doc, "j.label", F.coalesce("j.confidence", F.lit(0.0)).alias("confidence"))

    return step


def trained(labelled: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16) -> Callable[[DataFrame], DataFrame]:
    """A model fitted on ``labelled(text, label)``: hashed TF-IDF and multinomial logistic regression, all in the JVM; documents to ``(<first column>, label, confidence)``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, IndexToString, RegexTokenizer, StringIndexer
    from pyspark.ml.functions import vector_to_array

    own = labelled.select(crop_words(F.coalesce(F.col(text), F.lit("")), WORDS).alias("_t"), F.col(label).alias("_l")).where("_l is not null")
    names = StringIndexer(inputCol="_l", outputCol="_y", stringOrderType="alphabetAsc").fit(own)
    words = RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"[^\p{L}\p{M}\p{N}]+")
    steps = Pipeline(stages=[words, HashingTF(inputCol="_w", outputCol="_f", numFeatures=features), IDF(inputCol="_f", outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_y", probabilityCol="_p", predictionCol="_n", regParam=0.01, maxIter=30)])
    fitted = steps.fit(names.transform(own))

    def step(docs: DataFrame) -> DataFrame:
        key = docs.columns[0]
        out = fitted.transform(docs.select(key, crop_words(F.coalesce(F.col("text"), F.lit("")), WORDS).alias("_t")))
        return out.select(key, judged(vector_to_array("_p"), list(names.labels), "proba").alias("j")).select(key, "j.label", "j.confidence")

    return step
