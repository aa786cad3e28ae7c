"""Model jobs: distributed pre-training and batch scoring."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kifuframe.functions import board
from kifuframe.functions.arrays import computed_once
from kifuframe.session import stored

# Fixed value: share of the fast head in the total loss.
FAST_WEIGHT = 0.5

PREDICTION_TYPE = T.StructType([
    T.StructField("logits", T.ArrayType(T.DoubleType())),
    T.StructField("value", T.DoubleType()),
    T.StructField("fast_logits", T.ArrayType(T.DoubleType())),
])


def board_features(positions: DataFrame, n: int) -> DataFrame:
    """One signed value per cell (1 own, -1 opponent, 0 empty) plus the side to move."""
    own = board.signs(F.col("own_cells"), F.col("opp_cells"), n).cast("array<double>")
    side = F.array(F.col("player").cast("double"))
    return positions.withColumn("features", array_to_vector(F.concat(own, side)))


def pretrain(examples: DataFrame, n: int, epochs: int = 10, reg: float = 1e-4) -> tuple[PipelineModel, dict]:
    """Fit policy and fast policy (multinomial) and value (linear) on examples; all fits are distributed.

    The fast head is the policy fitted for half as many rounds under ten times the penalty. Gradients are
    summed in the executors; the driver keeps the coefficients only. The features are stored once for
    all fits; the losses are those of the finished models over all examples.
    """
    # the label metadata fixes one class per cell, played or not
    classes = {"ml_attr": {"type": "nominal", "num_vals": n * n}}
    data = stored(board_features(examples, n).select(
        "features", F.col("action").cast("double").alias("action"), "value"), "features")
    data = data.withColumn("action", F.col("action").alias("action", metadata=classes))

    def head(name: str, rounds: int, penalty: float) -> LogisticRegression:
        return LogisticRegression(
            labelCol="action", featuresCol="features", family="multinomial", maxIter=rounds, regParam=penalty,
            predictionCol=f"{name}_move", rawPredictionCol=f"{name}_raw", probabilityCol=f"{name}_probability")

    value = LinearRegression(
        labelCol="value", featuresCol="features", maxIter=epochs, regParam=reg, predictionCol="value_prediction")
    model = PipelineModel(stages=[
        head("policy", epochs, reg).fit(data), head("fast", (epochs + 1) // 2, 10 * reg).fit(data), value.fit(data)])

    def loss(name: str) -> Column:
        chosen = F.get(vector_to_array(f"{name}_probability"), F.col("action").cast("int"))
        return F.avg(-F.log(F.greatest(chosen, F.lit(1e-300))))

    found = model.transform(data).agg(
        F.count("*").alias("rows"), loss("policy").alias("policy"), loss("fast").alias("fast"),
        F.avg(F.pow(F.col("value_prediction") - F.col("value"), 2)).alias("value")).first()
    report = {
        "pretrain_loss": float(found["policy"] + found["value"] + FAST_WEIGHT * found["fast"]),
        "policy_loss": float(found["policy"]),
        "value_loss": float(found["value"]),
        "fast_loss": float(found["fast"]),
        "epochs": epochs,
        "total_examples": int(found["rows"]),
    }
    return model, report


def score(positions: DataFrame, model: PipelineModel, n: int) -> DataFrame:
    """Policy logits, fast logits and value of each position from a fitted pipeline."""
    return (
        model.transform(board_features(positions, n))
        .withColumn("logits", vector_to_array("policy_raw"))
        .withColumn("fast_logits", vector_to_array("fast_raw"))
        .withColumnRenamed("value_prediction", "value_output")
        .drop("features", "policy_raw", "policy_probability", "fast_raw", "fast_probability", "fast_move")
    )


def score_with(planes: DataFrame, make_predict: Callable[[], Callable[[np.ndarray], dict]], n: int,
               batch_size: int = 256) -> DataFrame:
    """Three outputs per position from any array function, in batches inside the tasks.

    ``make_predict`` runs once per Python worker and returns a function from a
    ``(batch, 19, n, n)`` array to ``logits``, ``value`` and ``fast_logits``.
    """
    predict = predict_batch_udf(
        make_predict, return_type=PREDICTION_TYPE, batch_size=batch_size, input_tensor_shapes=[[19, n, n]])
    # the array code that builds the planes stays below the Python call, once per row
    ready = computed_once(planes.withColumnRenamed("planes", "_source"), planes=F.col("_source"))
    scored = computed_once(ready.select(
        *[c for c in planes.columns if c != "planes"], predict("planes").alias("_raw")), _out=F.col("_raw"))
    return scored.select("*", "_out.*").drop("_raw", "_out")
