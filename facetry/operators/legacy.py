"""The older cutoffs: groups of cumulative share, small ones joined to the smaller neighbour."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions.workers import find_us
from facetry.operators.binning import histogram
from facetry.operators.running import running


def share_groups(df: DataFrame, names: Sequence[str], min_size: float = 5.0, rnd: int = 2) -> DataFrame:
    """(variable, grp, prc, value): groups of rounded values by running share; a value above the size is half a group lower."""
    h = histogram(df, names)
    totals = h.groupBy("variable").agg(F.sum("n").alias("total"))
    h = h.where("value is not null").groupBy("variable", F.bround("value", rnd).alias("value")).agg(F.sum("n").alias("n"))
    h = running(h, "value", ["n"], ["variable"]).join(F.broadcast(totals), "variable").withColumn("prc", 100.0 * F.col("n") / F.col("total"))
    group = F.floor(100.0 * F.col("run_n") / F.col("total") / min_size) - F.when(F.col("prc") > min_size, 0.5).otherwise(0.0)
    return h.withColumn("grp", group).groupBy("variable", "grp").agg(F.sum("prc").alias("prc"), F.max("value").alias("value"))


def legacy_cutoffs(df: DataFrame, names: Sequence[str], min_size: float = 5.0, rnd: int = 2, join_below: float | None = None) -> DataFrame:
    """(variable, cutoffs) of inner cutoffs. There are 200 groups at most a variable for the one sequential pass."""
    find_us(df.sparkSession)
    least = min_size if join_below is None else join_below

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf.sort_values("grp")
        key, prc, value = g["grp"].tolist(), g["prc"].tolist(), g["value"].tolist()
        for i in range(len(key)):
            if round(prc[i]) < least and len(key) > 1:
                left = i == len(key) - 1 or (i > 0 and prc[i - 1] < prc[i + 1])
                key[i] = key[i - 1] if left else key[i + 1]
        top: dict[float, float] = {}
        for k, v in zip(key, value, strict=True):
            top[k] = max(v, top.get(k, v))
        return pd.DataFrame({"variable": [pdf["variable"].iloc[0]], "cutoffs": [[top[k] for k in sorted(top)][:-1]]})

    return share_groups(df, names, min_size, rnd).groupBy("variable").applyInPandas(merge, "variable string, cutoffs array<double>")
