"""Whole analyses from a raw frame: variables chosen, target checked, filled, mapped and binned, then reported."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from facetry.operators import cross, frame, reports
from facetry.operators.binning import Spec, prepared

#: Distinct values that a variable of a concentration or stability report may have.
MOST_VALUES = 200


def chosen(df: DataFrame, names: Sequence[str] | None, ignore: Sequence[str], *apart: str | None) -> list[str]:
    """The named variables, or all columns but the ignored ones; target and split never are variables."""
    return [c for c in (names if names is not None else [c for c in df.columns if c not in ignore]) if c not in apart]


def display(report: DataFrame, digits: int = 2) -> DataFrame:
    """A report for reading: doubles rounded half to even."""
    return report.select(*[F.bround(f.name, digits).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in report.schema])


def value_ranges(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """Distinct values of each variable with null as one: a row a variable reaches the driver."""
    return {r["variable"]: r["n_unique"] + r["has_null"] for r in frame.nunique(df, names).collect()} if names else {}


def groups(df: DataFrame, name: str, maps: Mapping | None = None, binning: Spec = True) -> DataFrame:
    """Rows and share of each group of one variable."""
    return reports.group_stats(prepared(df, [name], None, maps, binning), name)


def information(df: DataFrame, target: str, names: Sequence[str] | None = None, ignore: Sequence[str] = (), maps: Mapping | None = None, binning: Spec = True, by_target: bool = True, by_iv: bool = True) -> tuple[DataFrame, DataFrame]:
    """(short, full) information value of all variables; the strongest first, or by name."""
    frame.check_target(df, target)
    names = chosen(df, names, ignore, target)
    full = reports.iv_report(prepared(df, names, target, maps, binning, by_target), names, target)
    order = [F.col("total_iv").desc(), "var_name"] if by_iv else ["var_name"]
    return reports.iv_short(full).orderBy(*order), full.orderBy(*order, "group_number")


def _narrowed(df: DataFrame, names: Sequence[str], constants: bool) -> list[str]:
    """Variables with MOST_VALUES values at most, and, unless ``constants``, two at least."""
    n = value_ranges(df, names)
    return [c for c in names if n.get(c, 0) <= MOST_VALUES and (constants or n.get(c, 0) > 1)]


def concentrated(df: DataFrame, target: str, low: int = 1, high: int = 1, names: Sequence[str] | None = None, ignore: Sequence[str] = (), maps: Mapping | None = None, binning: Spec = True, by_target: bool = True, pop_more: float | None = None, tr_less: float | None = None, tr_more: float | None = None) -> DataFrame:
    """Target concentration over combinations of variables that are neither constant nor of too many values."""
    frame.check_target(df, target)
    names = chosen(df, names, ignore, target)
    work = prepared(df, names, target, maps, binning, by_target)
    return reports.concentration(work, _narrowed(work, names, False), target, low, high, pop_more, tr_less, tr_more)


def stable(df: DataFrame, split: str, low: int = 1, high: int = 1, names: Sequence[str] | None = None, ignore: Sequence[str] = (), main: object = None, target: str | None = None, maps: Mapping | None = None, binning: Spec = True, least: float | int | None = None, pop: float | None = None, tgt: float | None = None) -> DataFrame:
    """Stability over a split, bins without the target; only segments that meet the bounds given."""
    if target:
        frame.check_target(df, target)
    names = chosen(df, names, ignore, target, split)
    work = prepared(df, names, target, maps, binning, False, (split,))
    report = reports.stability(work, split, _narrowed(work, names, True), low, high, main, target)
    bounds = (least, pop, tgt)
    return reports.stable_segments(report, high, *bounds) if any(b is not None for b in bounds) else report


def crossed(df: DataFrame, one: str, two: str, target: str | None = None, maps: Mapping | None = None, binning: Spec = True, min_population: float = 0.0) -> DataFrame:
    """Pairs and margins of two variables, with the radius of a pair's circle: half its share of the largest pair."""
    work = prepared(df, [one, two], target, maps, binning)
    return cross.with_radius(cross.cross_report(work, one, two, target, min_population))


def eligible(df: DataFrame, names: Sequence[str], most: int = 20) -> DataFrame:
    """(variable, n_unique) of numeric variables, and of others with at most ``most`` values; null counts as one."""
    numbers = [c for c in names if frame.numeric(df, c)]
    n = frame.within_cardinality(df, names, (1 << 63) - 1)
    return n.where(F.col("variable").isin(numbers) | (F.col("n_unique") <= most))
