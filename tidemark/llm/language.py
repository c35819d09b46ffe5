"""Language identification by averaged hashed subword embeddings, with calibrated rejection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import embed, sample
from .common import fold

FEATURES = embed.Features(bits=13, orders=(1, 2, 3, 4), words=False, lower=True)
#: At most so many documents of each language are learned from.
PER_LANGUAGE = 1500
UNKNOWN = "und"


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> embed.Model:
    """Learn from documents with a language whose fold (crc32 of the id, modulo 4) is not 2.

    A bounded sample (sample.bounded) is learned from: of the sample.MOST_CLASSES commonest
    languages, so a rarer one is never predicted, and of texts up to sample.LONGEST characters.
    Without such documents the model has no language.
    """
    texts, labels, _ = sample.bounded(docs.filter(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", F.col("lang").alias("label")), None, per_language)
    return embed.train(texts, labels, FEATURES)


def predict(docs: DataFrame, model: embed.Model) -> DataFrame:
    """``docs`` without text, with held_out, lang_pred, score and rejected.

    A text that is null or has no letter is ``und`` with score 0 and rejected; others get the
    likeliest learned language, and are rejected when its calibrated probability is under the
    model's limit. With a model of no language they are ``und`` with score 0 and not rejected.
    held_out is false for a null id; an empty table gives an empty result. Columns of these
    names are replaced.
    """
    names = ("held_out", "lang_pred", "score", "rejected")
    rows = docs.drop(*names).withColumn("__letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    out = embed.score(rows, model)
    best = F.coalesce(F.array_max("__probs"), F.lit(0.0))
    likeliest = F.element_at(F.array(*[F.lit(x) for x in model.classes]), F.array_position("__probs", best).cast("int")) if model.classes else F.lit(UNKNOWN)
    return (
        out.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)))
        .withColumn("lang_pred", F.when(F.col("__letters"), likeliest).otherwise(F.lit(UNKNOWN)))
        .withColumn("score", F.when(F.col("__letters"), best).otherwise(0.0))
        .withColumn("rejected", ~F.col("__letters") | (best < model.reject_below))
        .drop("__probs", "__letters")
    )


def accepted(docs: DataFrame, model: embed.Model) -> DataFrame:
    """The rows of ``docs`` that are not rejected, text and all."""
    rows = docs.withColumn("__text", F.col("text"))
    return predict(rows, model).filter(~F.col("rejected")).withColumnRenamed("__text", "text").select(*docs.columns)
