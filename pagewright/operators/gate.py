"""The release gate: every fixture has to pass by itself; an average can't make up for one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.operators.reference import percentage

THRESHOLD = 70.0


def fixture_decisions(measured: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds passed and reasons to (stage_id, fixture_id, score, integrity)."""
    threshold = percentage(threshold, "threshold")
    low, broken = F.col("score") < threshold, ~F.coalesce("integrity", F.lit(False))
    below = F.concat(F.lit("overall_below_threshold:"), F.col("score").cast("string"), F.lit(f"<{threshold:g}"))
    reasons = F.array_compact(F.array(F.when(low, below), F.when(broken, F.lit("integrity_failed")), F.when(~low & ~broken, F.lit("individual_overall_and_integrity_passed"))))
    return measured.withColumns({"passed": ~low & ~broken, "reasons": reasons})


def repeated_fixtures(measured: DataFrame) -> DataFrame:
    """Fixtures that a stage has more than once; a stage with any of them is in error."""
    return measured.groupBy("stage_id", "fixture_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def stage_decisions(decided: DataFrame) -> DataFrame:
    """(stage_id, fixtures, minimum, average, total, passed) of fixture decisions; average and total, the unrounded sum, are diagnostics."""
    return decided.groupBy("stage_id").agg(
        F.count(F.lit(1)).alias("fixtures"), F.round(F.min("score"), 6).alias("minimum"), F.round(F.avg("score"), 6).alias("average"), F.sum("score").alias("total"), F.bool_and("passed").alias("passed"),
    )


def with_previous(measured: DataFrame, previous: DataFrame, key: Sequence[str] = ("stage_id", "fixture_id")) -> DataFrame:
    """Adds the score before and the change."""
    return measured.join(previous.select(*key, F.col("score").alias("previous")), list(key), "left").withColumn("change", F.round(F.col("score") - F.col("previous"), 6))


def unknown_previous(measured: DataFrame, previous: DataFrame, key: Sequence[str] = ("stage_id", "fixture_id")) -> DataFrame:
    """Previous scores of fixtures that the suite doesn't have: an error."""
    return previous.join(measured.select(*key), list(key), "left_anti")
