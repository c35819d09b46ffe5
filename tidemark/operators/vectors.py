"""Vectors: checks, norms, normalisation, cosine neighbours and principal components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .order import percentiles


def dot(a: Column, b: Column) -> Column:
    """Summed in double, in order of position."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """``v`` divided by its length, as doubles; a zero vector stays."""
    return F.transform(F.array(norm(v)), lambda n: F.transform(v, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))[0]


def bad_vectors(df: DataFrame, dim: int, column: str = "vec") -> DataFrame:
    """Rows whose vector is null, of another length, or has a value that is not finite."""
    v = F.col(column)
    return df.filter(v.isNull() | (F.size(v) != dim) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def norm_stats(df: DataFrame, column: str = "vec") -> DataFrame:
    norms = df.select(norm(F.col(column)).alias("n"))
    p = percentiles(norms, "n", (0.01, 0.05, 0.5, 0.95, 0.99)).select(*[F.col("p")[i].alias(f"p{x}") for i, x in enumerate((1, 5, 50, 95, 99))])
    return norms.agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max")).join(p, how="cross")  # one row each


def lookup(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """The vectors of the wanted ids; a wanted id without one is an error."""
    missing = wanted.select("item_id").distinct().join(vectors, "item_id", "left_anti").count()
    if missing:
        raise ValueError(f"{missing} wanted ids have no vector")
    return vectors.join(wanted.select("item_id").distinct(), "item_id", "left_semi")


def cosine_neighbours(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, neighbour, score): each query's ``k`` nearest other items, ties by id.

    ``queries`` is a bounded set of anchors, paired with every item; scores stay in the task
    that makes them but for each anchor's best.
    """
    q = queries.select("item_id", normalised(F.col("vec")).alias("q"))
    n = q.count()
    if n > 10_000:
        raise ValueError(f"{n} anchors; take a sample of at most 10,000")
    i = items.select(F.col("item_id").alias("neighbour"), normalised(F.col("vec")).alias("v"))
    scored = i.join(F.broadcast(q), F.col("item_id") != F.col("neighbour")).select("item_id", "neighbour", F.round(dot(F.col("q"), F.col("v")), 10).alias("score"))
    best = W.partitionBy("item_id").orderBy(F.col("score").desc(), "neighbour")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "neighbour", "score")


def principal_variance(df: DataFrame, k: int, column: str = "vec") -> DataFrame:
    """(component, share): variance explained by each of the first ``k`` components of centred vectors."""
    return _pca(df, k, column)[1]


def principal(df: DataFrame, k: int, column: str = "vec") -> DataFrame:
    """``df`` with pc: coordinates on the first ``k`` components. Vectors are centred first; signs are arbitrary."""
    return _pca(df, k, column)[0]


def _pca(df: DataFrame, k: int, column: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    dim = df.select(F.size(column)).first()[0]
    mean = df.agg(*[F.avg(F.col(column)[i].cast("double")).alias(f"m{i}") for i in range(dim)]).first()
    centred = df.withColumn("__c", array_to_vector(F.zip_with(F.col(column), F.array(*[F.lit(float(x)) for x in mean]), lambda x, m: x.cast("double") - m)))
    model = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred)
    shares = df.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(model.explainedVariance.toArray())], "component int, share double")
    return model.transform(centred).withColumn("pc", vector_to_array("__p")).drop("__c", "__p"), shares


def aligned(vectors: DataFrame, id_map: DataFrame, dim: int) -> DataFrame:
    """(dense_id, vec): a vector for each dense id, zeros where there is none."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return id_map.join(vectors.withColumnRenamed("item_id", "raw_id"), "raw_id", "left").select("dense_id", F.coalesce("vec", zero).alias("vec"))


def with_popularity(vectors: DataFrame, train: DataFrame) -> DataFrame:
    """Vectors of the train items with how often train has them; a train item without vector is an error."""
    pop = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("popularity"))
    out = vectors.join(pop, "item_id")
    if out.count() != pop.count():
        raise ValueError("some train items have no vector")
    return out
