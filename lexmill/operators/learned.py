"""Learned fusion: boosted trees on fusion features, blended with the fused score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.scores import standardize


def fit(features: DataFrame, columns: list[str], label: str = "label", rounds: int = 50, rate: float = 0.05, depth: int = 4, least: int = 40, seed: int = 123):
    """A boosted-tree classifier whose two classes weigh alike."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    count = features.agg(F.count("*").alias("n"), F.sum(F.col(label)).alias("ones")).first()
    weight = F.when(F.col(label) == 1, count.n / (2.0 * max(count.ones or 0, 1))).otherwise(count.n / (2.0 * max(count.n - (count.ones or 0), 1)))
    rows = VectorAssembler(inputCols=columns, outputCol="_x").transform(features.withColumn("_w", weight).withColumn("_y", F.col(label).cast("double")))
    return GBTClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=rounds, stepSize=rate, maxDepth=depth, minInstancesPerNode=least, seed=seed).fit(rows)


def apply(model, features: DataFrame, columns: list[str], blend: float = 0.5) -> DataFrame:
    """Adds learned (probability) and blended: both scores standardised by the guarded form within their query."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = model.transform(VectorAssembler(inputCols=columns, outputCol="_x").transform(features))
    rows = rows.withColumn("learned", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")
    both = standardize(rows, ["score", "learned"], guarded=True)
    return both.withColumn("blended", F.col("z_score") * (1 - blend) + F.col("z_learned") * blend)
