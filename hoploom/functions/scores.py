"""Score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Into 0..1; constant inputs are all 1."""
    return F.when(high == low, 1.0).otherwise((value - low) / (high - low))


def with_minmax(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Min-max per key. The extremes are aggregated first: a window would gather a key's rows in one task."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    return df.join(ends, keys).withColumn(out, minmax(F.col(value), F.col("_low"), F.col("_high"))).drop("_low", "_high")


def entity_bonus(score: Column, occurrences: Column, tier: Column) -> Column:
    return score * F.log1p(occurrences.cast("double")) / F.greatest(tier, F.lit(1))


def passage_score(normalised: Column, bonus: Column, ratio: float, weight: float) -> Column:
    return (F.lit(ratio) * normalised + F.log1p(bonus)) * F.lit(weight)


def clamp_reset(weight: Column) -> Column:
    """NaN and negative weights are 0."""
    return F.when(F.isnan(weight) | (weight < 0), 0.0).otherwise(weight)


def hybrid_affinity(lexical: Column, cosine: Column, alpha: float) -> Column:
    return F.lit(alpha) * lexical + F.lit(1 - alpha) * ((cosine + 1) / 2)


def adaptive_clusters(complexity: Column, threshold: float, min_p: int, max_p: int) -> Column:
    """How many clusters a question of this complexity may use."""
    return F.when(complexity < threshold, min_p).otherwise((F.lit(min_p) + (complexity - threshold) / (1 - threshold) * (max_p - min_p)).cast("int"))
