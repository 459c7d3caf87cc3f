"""Category order, cross tables, predicate regions and exclusive set intersections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.labels import MISSING, NOT_MISSING
from facetry.operators.frame import numbered, with_sums
from facetry.operators.reports import concentration, ratio

_NUMBER = r"-?[0-9_]+(?:\.[0-9_]+)?"
_UPPER = rf"^(?:<= |\({_NUMBER}; )({_NUMBER})"
_LAST = rf"^> ({_NUMBER})"


def category_order(values: DataFrame, value: str, by: str) -> DataFrame:
    """``values`` plus place from 1: missing marks, then numbers or bins by bound if all are such, else by ``by``."""
    plain = F.col(value).isin(MISSING, NOT_MISSING)
    number = lambda pattern: F.regexp_replace(F.regexp_extract(value, pattern, 1), "_", "").try_cast("double")
    v = values.withColumn("_d", number(rf"^({_NUMBER})")).withColumn("_u", number(_UPPER)).withColumn("_l", number(_LAST) + 1)
    v = v.withColumn("_b", F.coalesce("_u", "_l"))
    v = with_sums(v, {"_digits": F.bool_and(plain | F.col("_d").isNotNull()), "_bins": F.bool_and(plain | F.col("_b").isNotNull())})
    key = F.when(F.col("_digits"), F.col("_d")).when(F.col("_bins"), F.col("_b")).otherwise(F.col(by).cast("double"))
    first = F.when(F.col(value) == MISSING, 0).when(F.col(value) == NOT_MISSING, 1).otherwise(2)
    v = v.withColumn("_f", first).withColumn("_k", F.when(F.col("_f") < 2, float("-inf")).otherwise(F.coalesce(key, F.lit(-1.7e308))))
    return numbered(v, "_k", "place", ["_f", value]).drop("_d", "_u", "_l", "_b", "_k", "_f", "_digits", "_bins")


def pivoted(rows: DataFrame, down: str, across: str, cell: str, values: Sequence[str] | None = None) -> DataFrame:
    """One row a value of ``down``, one column a value of ``across``."""
    return rows.groupBy(down).pivot(across, list(values) if values else None).agg(F.first(cell))


def cross_report(df: DataFrame, one: str, two: str, target: str | None = None, min_population: float = 0.0) -> DataFrame:
    """Pairs and margins of two variables; margins keep only values that a pair of enough population has.

    Without a target only counts and populations stay.
    """
    a, b = sorted((one, two))
    work = df if target else df.withColumn("_one", F.lit(1))
    r = concentration(work, [a, b], target or "_one", 1, 2)
    pairs = r.where(F.col("var2_name").isNotNull() & (F.col("population") >= min_population))
    margins = r.where(F.col("var2_name").isNull())
    seen = pairs.select(F.lit(a).alias("n"), F.col("var1_value").alias("v")).union(pairs.select(F.lit(b), "var2_value")).distinct()
    margins = margins.join(seen, (F.col("var1_name") == F.col("n")) & (F.col("var1_value") == F.col("v")), "left_semi")
    out = pairs.unionByName(margins)
    return out if target else out.select("var1_name", "var1_value", "var2_name", "var2_value", "count", "population")


def with_radius(report: DataFrame) -> DataFrame:
    """A cross report plus radius of its pairs: population over the largest pair's, halved."""
    pairs = F.when(F.col("var2_name").isNotNull(), F.col("population"))
    largest = report.agg(F.max(pairs).alias("_top"))
    return report.crossJoin(F.broadcast(largest)).withColumn("radius", ratio(pairs, F.col("_top")) / 2).drop("_top")


def predicate_totals(df: DataFrame, predicates: Mapping[str, Column], target: str) -> DataFrame:
    """(predicate, n, population, target, target_rate) of each predicate on its own, in one pass."""
    y = F.col(target).cast("long")
    cells = [F.struct(F.lit(k).alias("predicate"), F.count_if(p).alias("n"), (100 * ratio(F.count_if(p), F.count("*"))).alias("population"), F.coalesce(F.sum(F.when(p, y)), F.lit(0)).alias("target"), (100 * ratio(F.sum(F.when(p, y)), F.count_if(p))).alias("target_rate")) for k, p in predicates.items()]
    return df.agg(F.array(*cells).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def regions(df: DataFrame, predicates: Mapping[str, Column], target: str) -> DataFrame:
    """Non-empty patterns of predicates with rows, share of all rows, target and rate; an empty region has no rate."""
    names = list(predicates)
    g = df.select(*[F.coalesce(p, F.lit(False)).alias(k) for k, p in predicates.items()], F.col(target).cast("long").alias("y")).groupBy(*names).agg(F.count("*").alias("n"), F.sum("y").alias("t"))
    grid = df.sparkSession.range(1, 1 << len(names)).select(*[(F.shiftright("id", i).bitwiseAND(1) == 1).alias(k) for i, k in enumerate(names)])
    whole = g.agg(F.sum("n").alias("all"))
    out = grid.join(g, names, "left").crossJoin(F.broadcast(whole))
    n, t = F.coalesce("n", F.lit(0)), F.coalesce("t", F.lit(0))
    return out.select(*names, n.alias("n"), (100 * ratio(n, F.col("all"))).alias("population"), t.alias("target"), (100 * ratio(t, n)).alias("target_rate"))


def intersections(sets: Mapping[str, DataFrame], keys: Sequence[str], least: int = 0, most: int | None = None, degrees: tuple[int, int] | None = None) -> DataFrame:
    """(mask, degree, size) of every exclusive intersection of the sets, empty ones too; bit i is the i-th set."""
    tagged = reduce(DataFrame.union, [d.select(*keys).distinct().withColumn("tag", F.lit(1 << i).cast("long")) for i, d in enumerate(sets.values())])
    n = tagged.groupBy(*keys).agg(F.bit_or("tag").alias("mask")).groupBy("mask").agg(F.count("*").alias("size"))
    grid = next(iter(sets.values())).sparkSession.range(1, 1 << len(sets)).select(F.col("id").alias("mask"))
    out = grid.join(n, "mask", "left").select("mask", F.bit_count("mask").alias("degree"), F.coalesce("size", F.lit(0)).alias("size")).where(F.col("size") >= least)
    if most is not None:
        out = out.where(F.col("size") <= most)
    return out.where(F.col("degree").between(*degrees)) if degrees else out


def legacy_cross(df: DataFrame, one: str, two: str, target: str, aggregate=lambda c: 100 * F.avg(c), show_min: float = 1.0) -> DataFrame:
    """(one, two, size, value, population) of pairs with at least ``show_min`` percent of the rows."""
    g = df.groupBy(one, two).agg(F.count("*").alias("size"), aggregate(F.col(target)).alias("value"))
    g = with_sums(g, {"_all": F.sum("size")})
    return g.withColumn("population", 100 * ratio(F.col("size"), F.col("_all"))).where(F.col("population") >= show_min).drop("_all")

