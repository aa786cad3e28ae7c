"""Loss and schedule tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kifuframe.functions import policy


def policy_cross_entropy(df: DataFrame, target: Column) -> DataFrame:
    return df.withColumn("policy_loss", policy.cross_entropy(F.col("logits"), target))


def value_mse(df: DataFrame, value: str = "value", target: str = "target_value") -> DataFrame:
    gap = F.col(value) - F.col(target)
    return df.withColumn("value_loss", gap * gap)


def fast_kl(df: DataFrame) -> DataFrame:
    """KL of the fast policy from the policy, the pre-training form."""
    return df.withColumn("fast_loss", policy.kl_divergence(F.col("logits"), F.col("fast_logits")))


def fast_cross_entropy(df: DataFrame) -> DataFrame:
    """Cross-entropy of the fast policy against the policy, the self-play form."""
    return df.withColumn(
        "fast_loss", policy.cross_entropy(F.col("fast_logits"), policy.softmax(F.col("logits"))))


def total_loss(df: DataFrame, by: list[str], weight: str | None = None, policy_weight: float = 1.0,
               value_weight: float = 1.0, fast_weight: float = 0.5) -> DataFrame:
    """Weighted means of the three losses per group and their weighted sum.

    The means divide by the row count, not by the weight sum.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    means = df.groupBy(*by).agg(*[
        F.avg(F.col(name) * w).alias(name) for name in ("policy_loss", "value_loss", "fast_loss")])
    return means.withColumn(
        "total_loss",
        policy_weight * F.col("policy_loss") + value_weight * F.col("value_loss")
        + fast_weight * F.col("fast_loss"))


def epoch_loss(batch_losses: DataFrame) -> DataFrame:
    """Mean of batch means per epoch, and over all batches where ``epoch`` is null."""
    return batch_losses.rollup("epoch").agg(
        F.avg("total_loss").alias("loss"), F.count("*").alias("batches"))


def cosine_lr(step: Column, lr: float = 1e-3, eta_min: float = 1e-5, t_max: int = 5000) -> Column:
    return eta_min + (lr - eta_min) * (1 + F.cos(F.lit(math.pi) * step / t_max)) / 2


def temperature(step: Column, start: float = 1.0, minimum: float = 0.1, decay: float = 0.9999) -> Column:
    return F.greatest(F.lit(minimum), start * F.pow(F.lit(decay), step))
