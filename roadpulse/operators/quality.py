"""Forecast quality in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forecast_metrics(pairs: DataFrame, eps: float = 1e-6, threshold: float = 0.5) -> DataFrame:
    """One row over ``(pred_count, count, pred_prob, prob, pred_level, level)``: errors and accuracies."""
    error = F.col("pred_count") - F.col("count")
    same_side = (F.col("pred_prob") >= threshold) == (F.col("prob") >= threshold)
    return pairs.agg(
        F.avg(F.abs(error)).alias("count_mae"),
        F.sqrt(F.avg(error * error)).alias("count_rmse"),
        (F.avg(F.abs(error / (F.abs(F.col("count")) + eps))) * 100).alias("count_mape"),
        F.avg(same_side.cast("double")).alias("prob_acc"),
        F.avg((F.col("pred_level") == F.col("level")).cast("double")).alias("level_acc"),
    )
