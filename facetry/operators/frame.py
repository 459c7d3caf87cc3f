"""Projection, missing values, maps, frequencies and column profiles. Every function returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegralType, NumericType

from facetry.functions.labels import MISSING
from facetry.operators.running import running


def numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, NumericType)


def integral(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, IntegralType)


def project(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Named columns in order; a missing one raises."""
    if lost := [n for n in names if n not in df.columns]:
        raise ValueError(f"no such columns: {lost}")
    return df.select(*names)


def clean(df: DataFrame) -> DataFrame:
    """NaN becomes null in floating columns."""
    kinds = (FloatType, DoubleType)
    return df.select(*[F.when(F.isnan(f.name), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema])


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def drop_missing(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(names) if names else None)


def without_values(df: DataFrame, name: str, values: Sequence, missing: bool = False) -> DataFrame:
    """Rows whose value is none of ``values``; nulls go too if ``missing``."""
    gone = F.coalesce(F.col(name).isin(list(values)), F.lit(False)) if values else F.lit(False)
    return df.where(~gone & (F.col(name).isNotNull() if missing else F.lit(True)))


def any_of(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Rows where one of the variables at least has its value."""
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == v, F.lit(False)) for c, v in values.items()]))


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Nulls replaced; a text for a column of another type turns the column into text."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string") if isinstance(v, str) else F.col(c), F.lit(v)) for c, v in values.items()})


def map_values(df: DataFrame, maps: Mapping[str, Mapping]) -> DataFrame:
    """Values replaced by the maps of their columns; others stay."""
    new = {}
    for c, m in maps.items():
        if m:
            table = F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
            new[c] = F.coalesce(table[F.col(c)], F.col(c).cast(table_type(m)))
    return df.withColumns(new)


def table_type(m: Mapping) -> str:
    v = next(iter(m.values()))
    return "boolean" if isinstance(v, bool) else "long" if isinstance(v, int) else "double" if isinstance(v, float) else "string"


def count_missing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(variable, n_missing), in one pass."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return one.unpivot([], list(names), "variable", "n_missing")


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """(value, count, percent) with nulls counted like any value."""
    n = df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("count"))
    total = n.agg(F.sum("count").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("value", "count", (100.0 * F.col("count") / F.col("total")).alias("percent"))


def nunique(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(variable, n_unique, has_null): distinct values other than null; one variable's values at a time shuffle distinct."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in names])).alias("x")).select("x.*")
    seen = long.groupBy("variable", "value").agg(F.lit(1).alias("one"))
    return seen.groupBy("variable").agg(F.count("value").alias("n_unique"), F.max(F.col("value").isNull()).alias("has_null"))


def profile(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(variable, n, n_missing, minimum, maximum, whole) of numeric columns, all in one pass."""
    cols = []
    for c in names:
        x = F.col(c).cast("double")
        cols.append(F.struct(F.lit(c).alias("variable"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("n_missing"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.coalesce(F.bool_and(x % 1 == 0), F.lit(True)).alias("whole")))
    return df.agg(F.array(*cols).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def binary_columns(df: DataFrame) -> DataFrame:
    """(variable) of numeric and boolean columns whose values are exactly 0 and 1, both, without null."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (NumericType, BooleanType))]
    return df.agg(F.array(*[F.struct(F.lit(c).alias("variable"), _binary(F.col(c)).alias("ok")) for c in names]).alias("p")).select(F.explode("p").alias("p")).where("p.ok").select("p.variable")


def _binary(c: Column) -> Column:
    x = c.cast("double")
    return (F.count_if(c.isNull() | ~x.isin(0.0, 1.0)) == 0) & F.coalesce((F.min(x) == 0) & (F.max(x) == 1), F.lit(False))


def target_report(df: DataFrame, target: str) -> DataFrame:
    """One row (valid, n, n_target)."""
    return df.agg(_binary(F.col(target)).alias("valid"), F.count("*").alias("n"), F.sum(F.col(target).cast("long")).alias("n_target"))


def check_target(df: DataFrame, target: str) -> None:
    if not target_report(df, target).first()["valid"]:
        raise ValueError(f"{target} must hold 0 and 1, both, and nothing else")


def within_cardinality(df: DataFrame, names: Sequence[str], most: int = 200) -> DataFrame:
    """(variable, n_unique) of variables with at most ``most`` distinct values; null counts as one."""
    n = nunique(df, names)
    return n.select("variable", (F.col("n_unique") + F.col("has_null").cast("int")).alias("n_unique")).where(F.col("n_unique") <= most)


def text_values(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns as text with the missing mark for null."""
    return fill_missing(df, dict.fromkeys(names, MISSING))


def with_sums(df: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """Rows of a report with whole-report aggregates beside each: one row, joined to all."""
    return df.crossJoin(F.broadcast(df.agg(*[x.alias(k) for k, x in sums.items()])))


def numbered(df: DataFrame, value: str, name: str, ties: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Rows numbered from 1 by a number, null last, and by ``ties`` among equal ones.

    Rows before a value come from running sums over ranges of values; a window holds the rows of one value only.
    """
    df = df.withColumn("_v", F.coalesce(F.col(value).cast("double"), F.lit(float("-inf") if descending else float("inf"))))
    ahead = running(df.groupBy("_v").agg(F.count("*").alias("n")), "_v", ["n"], descending=descending).select("_v", (F.col("run_n") - F.col("n")).alias("_ahead"))
    own = F.row_number().over(Window.partitionBy("_v").orderBy(*(ties or ["_v"])))
    return df.withColumn("_own", own).join(ahead, "_v").withColumn(name, (F.col("_ahead") + F.col("_own")).cast("int")).drop("_v", "_own", "_ahead")
