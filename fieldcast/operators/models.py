"""Model store: fitted models with their metadata, saved once and read back by version.

A linear model is a coefficient table, a tree model an MLlib pipeline; both lie under
``<root>/models/<version>``. The registry is a table with one row a version: kind,
framework, feature order, intercept, residual spread and holdout metrics. The row is
written last, so a version is known only when its model is whole. Saving a version
again replaces it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldcast.operators import tables as W
from fieldcast.operators.training import LinearModel

REGISTRY_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("framework", T.StringType()), T.StructField("feature_order", T.StringType()),
    T.StructField("intercept", T.DoubleType()), T.StructField("residual_std", T.DoubleType()),
    T.StructField("rmse", T.DoubleType()), T.StructField("mae", T.DoubleType()), T.StructField("r2", T.DoubleType()),
    T.StructField("n_valid", T.LongType()),
])
TREES = "gbt"


@dataclass
class TreeModel:
    """A fitted MLlib pipeline with the features it was trained on."""
    features: list[str]
    pipeline: object
    version: str
    framework: str = TREES

    def score(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with the raw prediction as `name`; its other columns untouched."""
        out = self.pipeline.transform(df.withColumn("_row", F.struct(*df.columns)))
        return out.select("_row.*", F.col("prediction").alias(name))


def save_model(spark: SparkSession, root: str, model, kind: str, metrics: dict) -> None:
    """Store a fitted model of `kind` (``preseason``, ``in_season``) with its holdout `metrics`."""
    where = f"{root}/models/{model.version}"
    if isinstance(model, LinearModel):
        rows = [(k, f, float(c), float(m)) for k, (f, c, m) in enumerate(zip(model.features, model.coef, model.means))]
        spark.createDataFrame(rows, "place int, feature string, coef double, mean double") \
            .coalesce(1).write.mode("overwrite").parquet(where)
    else:
        model.pipeline.write().overwrite().save(where)
    row = (model.version, kind, model.framework, ",".join(model.features), float(getattr(model, "intercept", 0.0)),
           *(float(metrics[c]) for c in ("residual_std", "rmse", "mae", "r2")), int(metrics["n_valid"]))
    known = W.published(spark, f"{root}/registry", REGISTRY_SCHEMA).where(F.col("version") != model.version)
    W.publish(spark, f"{root}/registry", known.unionByName(spark.createDataFrame([row], REGISTRY_SCHEMA)).coalesce(1))


def registry(spark: SparkSession, root: str) -> DataFrame:
    """The versions in the store (one row each)."""
    return W.published(spark, f"{root}/registry", REGISTRY_SCHEMA)


def load_model(spark: SparkSession, root: str, version: str, features: Sequence[str] | None = None):
    """The stored model `version`. A version that is unknown, or was trained on another feature order, is refused."""
    found = registry(spark, root).where(F.col("version") == version).first()
    if found is None:
        raise KeyError(f"no model {version!r} in the store")
    order = found["feature_order"].split(",")
    if features is not None and list(features) != order:
        raise ValueError(f"model {version!r} was trained on another feature order")
    where = f"{root}/models/{version}"
    if found["framework"] == TREES:
        from pyspark.ml import PipelineModel
        return TreeModel(order, PipelineModel.load(where), version)
    rows = spark.read.parquet(where).orderBy("place").collect()
    return LinearModel(order, np.array([r["coef"] for r in rows]), found["intercept"], np.array([r["mean"] for r in rows]),
                       version=version, framework=found["framework"])
