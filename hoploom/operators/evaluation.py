"""Answer quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contain_accuracy, judge_accuracy


def score_predictions(predictions: DataFrame) -> DataFrame:
    """Adds contain_accuracy, and llm_accuracy where a judge's verdict is there, to (pred_answer, gold_answer)."""
    out = predictions.withColumn("contain_accuracy", contain_accuracy(F.col("pred_answer"), F.col("gold_answer")))
    return out.withColumn("llm_accuracy", judge_accuracy(F.col("verdict"))) if "verdict" in predictions.columns else out


def mean_accuracy(scored: DataFrame) -> DataFrame:
    """Means of both metrics; NULL without rows."""
    llm = F.avg("llm_accuracy") if "llm_accuracy" in scored.columns else F.lit(None).cast("double")
    return scored.agg(llm.alias("llm_accuracy"), F.avg("contain_accuracy").alias("contain_accuracy"))


def sparsity(pairs: DataFrame, row: str, col: str) -> DataFrame:
    """Non-zeros, rows, columns and sparsity in percent of a table of coordinates."""
    n = pairs.agg(F.count(F.lit(1)).alias("nnz"), F.countDistinct(row).alias("n_rows"), F.countDistinct(col).alias("n_cols"))
    return n.withColumn("sparsity", (1 - F.col("nnz") / (F.col("n_rows") * F.col("n_cols"))) * 100)
