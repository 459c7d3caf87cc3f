"""Counts of groups and their target over a stream: the table that information value and stability are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators.reports import grouped_target


def target_counts(stream: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """(var_name, group, ord, n, t) of all rows so far, for output mode complete or update; state grows with the groups only."""
    return grouped_target(stream, names, target)


def windowed_counts(stream: DataFrame, time: str, width: str, late: str, names: Sequence[str], target: str) -> DataFrame:
    """(start, var_name, group, n, t) by time window, the splits of a stability report; rows later than ``late`` are left out.

    The watermark closes a window, which then leaves the state; in mode append it is written once.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("var_name"), F.col(c).cast("string").alias("group")) for c in names])
    rows = stream.withWatermark(time, late).select(F.col(time).alias("at"), F.col(target).cast("long").alias("y"), F.explode(cells).alias("x")).select("at", "y", "x.*")
    g = rows.groupBy(F.window("at", width).alias("w"), "var_name", "group").agg(F.count("*").alias("n"), F.sum("y").alias("t"))
    return g.select(F.col("w.start").alias("start"), "var_name", "group", "n", "t")
