"""Score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def min_max(score: Column, over: WindowSpec) -> Column:
    """Scores scaled to 0 to 1 within a window; where all are equal, 1."""
    low, high = F.min(score).over(over), F.max(score).over(over)
    return F.when(high == low, F.lit(1.0)).otherwise((score - low) / F.nullif(high - low, F.lit(0.0)))


def percent(score: Column) -> Column:
    """A score as a percentage with one decimal."""
    return F.concat(F.call_function("format_number", score * 100, F.lit("0.0")), F.lit("%"))


def batch_size(utilisation: Column, base: int = 64, least: int = 16, most: int = 128) -> Column:
    """Batch size by memory use in percent; ``base`` where it is unknown."""
    return (
        F.when(utilisation.isNull(), F.lit(base))
        .when(utilisation < 40, F.lit(min(base * 2, most)))
        .when(utilisation < 70, F.lit(base))
        .when(utilisation < 85, F.lit(max(base // 2, least)))
        .otherwise(F.lit(least))
    )
