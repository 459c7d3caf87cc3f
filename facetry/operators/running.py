"""Running sums over an order that no single task holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A group's values are dealt into SIDE * SIDE ranges, found in two steps of SIDE comparisons.
SIDE = 16


def running(rows: DataFrame, value: str, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """``rows`` plus run_<c> for each c of ``sums``: its sum over the rows of the group up to and with the row's value.

    ``rows`` hold a numeric value once a group. Approximate quantiles cut a group's values into ranges; a range is a
    window of its own, and what lies before it comes from the sums of ranges, SIDE * SIDE rows a group at most.
    Groups may be many, so only what stands for all rows at once is broadcast. Any quantiles give exact sums; they only set how even the ranges are. Null values are left out.
    """
    rows = rows.where(F.col(value).isNotNull())
    x = F.col(value).cast("double")
    share = ", ".join(f"{i / SIDE**2}D" for i in range(1, SIDE**2))  # as text: a literal each would be a call each
    marks = rows.groupBy(*by).agg(F.expr(f"percentile_approx(cast(`{value}` as double), array({share}), 10000)").alias("_q"))
    on = list(by)
    dealt = rows.join(marks, on) if on else rows.crossJoin(F.broadcast(marks))
    coarse = F.size(F.filter(F.sequence(F.lit(1), F.lit(SIDE - 1)), lambda i: F.get("_q", i * SIDE - 1) <= x))
    fine = F.size(F.filter(F.slice("_q", F.col("_c") * SIDE + 1, F.lit(SIDE - 1)), lambda m: m <= x))
    dealt = dealt.withColumn("_c", coarse).withColumn("_r", F.col("_c") * SIDE + fine).drop("_q", "_c")
    order = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    before = Window.partitionBy(*by).orderBy(order("_r")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = dealt.groupBy(*by, "_r").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    ranges = ranges.select(*by, "_r", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_r").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"run_{c}": F.sum(c).over(inside) for c in sums}).join(ranges if on else F.broadcast(ranges), [*by, "_r"])
    return out.withColumns({f"run_{c}": F.col(f"run_{c}") + F.col(f"_b_{c}") for c in sums}).drop("_r", *[f"_b_{c}" for c in sums])
