"""Bounded samples of labelled documents for the models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The classes that are learned at most, the commonest first.
MOST_CLASSES = 500
#: Characters of all sampled texts, dealt evenly to the classes, and of the longest text that is sampled.
MOST_CHARS, LONGEST = 64_000_000, 500_000
_BITS = 30


def bounded(docs: DataFrame, known: DataFrame | None, per_class: int, most_chars: int = MOST_CHARS, longest: int = LONGEST, most_classes: int = MOST_CLASSES, seed: int = 11) -> tuple[list, list, list[float]]:
    """Whole texts, labels and weights of at most ``per_class`` ids of each class, chosen by a hash of the id.

    ``docs`` has doc_id and text, and the label either stands there or in ``known`` (doc_id, label).
    Null labels and ids are left out, and texts over ``longest`` characters. What is joined to
    choose are ids and hashes; only the chosen texts are then fetched. An id counts once in a
    class, with one of its texts (a null text is an empty one). A class stops at its share of
    ``most_chars``, so the driver gets at most per_class texts of a class, and most_chars +
    classes * longest characters. Weights are a class's share of all ids (counted
    approximately, within 2 %) over its share of the sample, so that weighted the sample has
    the classes' own shares. In order of class and hash.
    """
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    if known is None:
        rows = docs.filter("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", "label", F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"))
    else:
        rows = texts.select("doc_id", "hash", F.length("text").alias("chars")).join(known.filter("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", "label"), "doc_id")
    common = rows.groupBy("label").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).orderBy(F.col("n").desc(), "label").limit(most_classes)
    counts = {r.label: max(r.n, 1) for r in common.collect()}  # at most most_classes rows
    if not counts:
        return [], [], []
    rate = F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(int(min(1.0, 1.3 * per_class / n) * (1 << _BITS))))])
    spot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << _BITS))
    some = rows.withColumn("spot", spot).filter((F.col("spot") < rate[F.col("label")]) & (F.col("chars") <= longest))
    one = some.groupBy("label", "spot", "doc_id").agg(F.min(F.struct("hash", "chars")).alias("m"))
    turn = W.partitionBy("label").orderBy("spot", "doc_id")  # about 1.3 * per_class rows a class
    one = one.withColumns({"nth": F.row_number().over(turn), "before": F.sum("m.chars").over(turn) - F.col("m.chars")})
    chosen = one.filter((F.col("nth") <= per_class) & (F.col("before") < most_chars // len(counts))).select("label", "spot", "doc_id", F.col("m.hash").alias("hash"))
    got = texts.join(F.broadcast(chosen), ["doc_id", "hash"]).groupBy("label", "spot", "doc_id").agg(F.min("text").alias("text")).toPandas().sort_values(["label", "spot", "doc_id"], kind="stable")  # bounded as above
    drawn = got["label"].value_counts().to_dict()
    weight = got["label"].map({k: counts[k] / n for k, n in drawn.items()}).astype(float)
    return got["text"].tolist(), got["label"].tolist(), (weight / weight.mean()).tolist()
