"""Document quality by supervised subword embeddings: hashed words and character n-grams."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import embed, sample
from .common import fold

FEATURES = embed.Features(bits=14, orders=(2, 3, 4), words=True, lower=False)
#: At most so many documents of each label are learned from.
PER_LABEL = 3000
THRESHOLD = 0.3


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of labels that may be learned from: fold not 0 of 5. Of several for an id the largest counts."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    return known.groupBy("doc_id").agg(F.max(label).alias("label"))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> embed.Model:
    """Learn quality from a bounded sample (sample.bounded), then shift the bias from the sample's shares of labels to their own.

    Without usable labels the model has no class; with one label it has that one.
    """
    texts, y, weights = sample.bounded(docs, learnable(labels, "quality"), per_label)
    model = embed.train(texts, y, FEATURES, epochs=6)
    share = dict(zip(y, weights, strict=True))
    shift = np.log([share[k] for k in model.classes])
    return replace(model, bias=model.bias + model.temperature * shift)  # probabilities divide the bias by the temperature


def predict(docs: DataFrame, model: embed.Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without text, with held_out, score (probability of label 1) and predicted.

    A null text scores as an empty one; held_out is false for a null id; an empty table gives an
    empty result. Every score is 0.5 from a model of no class, 0 or 1 from one that knows that
    label only. Columns of these names are replaced.
    """
    rows = docs.drop("held_out", "score", "predicted")
    score = F.get("__probs", F.lit(model.classes.index(1))) if 1 in model.classes else F.lit(0.0 if model.classes else 0.5)
    return (
        embed.score(rows, model)
        .withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)))
        .withColumn("score", score).withColumn("predicted", (F.col("score") >= threshold).cast("int")).drop("__probs")
    )
