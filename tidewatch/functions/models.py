"""Learned spam score on the spam features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import spam_features

FEATURES = ("url_ratio", "keyword_hits", "phone_count", "caps_ratio", "special_count", "content_length", "url_count")


def spam_model(train: DataFrame, rows: DataFrame, text: str = "text", label: str = "label", trees: int = 10, depth: int = 4) -> DataFrame:
    """``rows`` with ``spam_probability`` from boosted trees on the seven features, fitted on ``train`` (text, label 0/1)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    cast = lambda df: spam_features(df, text).withColumns({c: F.col(c).cast("double") for c in FEATURES})
    stages = [VectorAssembler(inputCols=[*FEATURES], outputCol="_f"), GBTClassifier(featuresCol="_f", labelCol=label, maxIter=trees, maxDepth=depth, seed=7)]
    model = Pipeline(stages=stages).fit(cast(train).withColumn(label, F.col(label).cast("double")))
    scored = model.transform(cast(rows.drop(label)))
    return scored.withColumn("spam_probability", vector_to_array("probability")[1]).drop("_f", "probability", "rawPrediction", "prediction", *FEATURES)
