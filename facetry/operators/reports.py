"""Group statistics, information value, concentration over combinations, and stability over a split.

Inputs hold label columns, and optionally their places under ``__ord``. Each report is one aggregation of the
data; what follows works on groups. Totals are windows or sums over groups, never over rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.functions.labels import EPSILON, ORD
from facetry.operators.frame import numbered, with_sums

#: Grouping sets of one aggregation at most; more are united.
SETS = 64


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def place_of(df: DataFrame, c: str) -> Column:
    return F.col(c + ORD).cast("double") if c + ORD in df.columns else F.lit(1.0)


def group_stats(df: DataFrame, name: str) -> DataFrame:
    """(group_number, group, total, population) of one variable."""
    g = df.groupBy(F.col(name).alias("group"), place_of(df, name).alias("ord")).agg(F.count("*").alias("total"))
    g = with_sums(numbered(g, "ord", "group_number", ["group"]), {"whole": F.sum("total")})
    return g.select("group_number", "group", "total", (100 * ratio(F.col("total"), F.col("whole"))).alias("population"))


def grouped_target(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """(var_name, group, ord, n, t) of all variables in one aggregation."""
    cells = F.array(*[F.struct(F.lit(c).alias("var_name"), F.col(c).cast("string").alias("group"), place_of(df, c).alias("ord")) for c in names])
    return df.select(F.col(target).cast("long").alias("y"), F.explode(cells).alias("x")).select("y", "x.*").groupBy("var_name", "group", "ord").agg(F.count("*").alias("n"), F.sum("y").alias("t"))


def iv_report(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """Information value by group; a share of 0 counts as one row in both factors."""
    w = Window.partitionBy("var_name")
    g = grouped_target(df, names, target)
    g = g.withColumn("tt", F.sum("t").over(w)).withColumn("nn", F.sum("n").over(w)).withColumn("ff", F.col("nn") - F.col("tt"))
    pt, pn = ratio(F.col("t"), F.col("tt")), ratio(F.col("n") - F.col("t"), F.col("ff"))
    one = F.lit(1.0)
    g = g.withColumn("pt", F.when(pt == 0, ratio(one, F.col("tt"))).otherwise(pt)).withColumn("pn", F.when(pn == 0, ratio(one, F.col("ff"))).otherwise(pn))
    g = g.withColumn("woe", F.ln(ratio(F.col("pt"), F.col("pn")))).withColumn("group_iv", 100 * F.abs(F.col("pt") - F.col("pn")) * F.col("woe"))
    return g.select(
        "var_name", F.row_number().over(w.orderBy("ord", "group")).alias("group_number"), "group", F.col("n").alias("count"), F.col("t").alias("target"),
        (100 * ratio(F.col("n"), F.col("nn"))).alias("population"), (100 * ratio(F.col("t"), F.col("tt"))).alias("target_population"), (100 * ratio(F.col("t"), F.col("n"))).alias("target_rate"),
        "woe", "group_iv", F.sum(F.abs("group_iv")).over(w).alias("total_iv"),
    )


def iv_short(report: DataFrame) -> DataFrame:
    return report.select("var_name", "total_iv").distinct()


def legacy_iv(df: DataFrame, names: Sequence[str], target: str) -> DataFrame:
    """The older form: zero shares give null, signed sum as total."""
    w = Window.partitionBy("var_name")
    g = grouped_target(df, names, target)
    tt, nn = F.sum("t").over(w), F.sum("n").over(w)
    g = g.withColumn("pt", ratio(F.col("t"), tt)).withColumn("pn", ratio(F.col("n") - F.col("t"), nn - tt))
    q = ratio(F.col("pt"), F.col("pn"))
    g = g.withColumn("woe", F.when(q > 0, F.ln(q))).withColumn("group_iv", 100 * (F.col("pt") - F.col("pn")) * F.col("woe"))
    return g.select("var_name", "group", F.col("n").alias("count"), F.col("t").alias("target"), (100 * ratio(F.col("t"), F.col("n"))).alias("target_rate"), "woe", "group_iv", F.sum("group_iv").over(w).alias("total_iv"))


def combos(names: Sequence[str], low: int, high: int) -> list[tuple[str, ...]]:
    return [c for k in range(low, high + 1) for c in combinations(sorted(names), k)]


def segments(df: DataFrame, names: Sequence[str], low: int, high: int, sums: dict[str, Column], extra: Sequence[str] = ()) -> DataFrame:
    """Rows (extra..., seg array<struct<name, value, ord>>, sums) for every combination of low to high variables.

    The data is aggregated once, to the finest level; all combinations are grouping sets of that.
    """
    places = [place_of(df, c).alias(c + ORD) for c in names]
    base = df.select(*extra, *[F.col(c).cast("string").alias(c) for c in names], *places, *[x.alias(k) for k, x in sums.items()])
    keys = [k for c in names for k in (c, c + ORD)]
    base = base.groupBy(*extra, *keys).agg(*[F.sum(k).alias(k) for k in sums])
    sets = combos(names, low, high)
    out = []
    for i in range(0, len(sets), SETS):
        lists = [[F.col(x) for x in [*extra, *(k for c in s for k in (c, c + ORD))]] for s in sets[i : i + SETS]]
        all_keys = [F.col(x) for x in [*extra, *keys]]
        g = base.groupingSets(lists, *all_keys).agg(*[F.sum(k).alias(k) for k in sums], *[F.grouping(c).alias(f"_g_{c}") for c in sorted(names)])
        seg = F.filter(F.array(*[F.when(F.col(f"_g_{c}") == 0, F.struct(F.lit(c).alias("name"), F.col(c).alias("value"), F.col(c + ORD).alias("ord"))) for c in sorted(names)]), lambda x: x.isNotNull())
        out.append(g.select(*extra, seg.alias("seg"), *sums))
    return reduce(DataFrame.union, out)


def spread(report: DataFrame, most: int) -> DataFrame:
    """seg as var1_name, var1_value, ... columns, null past the segment's size."""
    cols = [x for i in range(most) for x in (F.get("seg", F.lit(i))["name"].alias(f"var{i + 1}_name"), F.get("seg", F.lit(i))["value"].alias(f"var{i + 1}_value"))]
    return report.select(*cols, *[c for c in report.columns if c != "seg"])


def _key(seg: Column) -> Column:
    return F.transform(seg, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def concentration(df: DataFrame, names: Sequence[str], target: str, low: int = 1, high: int = 1, pop_more: float | None = None, tr_less: float | None = None, tr_more: float | None = None) -> DataFrame:
    """Target concentration of all segments, with the parents of lowest and highest rate.

    A zero share counts as one row inside the logarithm only. Parents are the segments with one variable less; of
    equal rates the parent without the alphabetically last variable wins. They are sought before any filter,
    also when ``low`` leaves them out of the report.
    """
    y = F.col(target).cast("long")
    g = segments(df, names, max(1, low - 1), high, {"count": F.when(y.isNotNull(), 1).otherwise(0).cast("long"), "target": F.coalesce(y, F.lit(0))})
    # Every combination splits the same rows, so any one variable has the totals.
    one = sorted(names)[0] if low <= 2 else None
    if one:
        totals = g.where((F.size("seg") == 1) & (F.get("seg", F.lit(0))["name"] == one)).agg(F.sum("count").alias("nn"), F.sum("target").alias("tt"))
    else:
        totals = df.agg(F.count(target).alias("nn"), F.coalesce(F.sum(y), F.lit(0)).alias("tt"))
    g = g.crossJoin(F.broadcast(totals)).withColumn("ff", F.col("nn") - F.col("tt"))
    pt, pn = ratio(F.col("target"), F.col("tt")), ratio(F.col("count") - F.col("target"), F.col("ff"))
    lt, ln_ = F.when(pt == 0, ratio(F.lit(1.0), F.col("tt"))).otherwise(pt), F.when(pn == 0, ratio(F.lit(1.0), F.col("ff"))).otherwise(pn)
    g = g.select("seg", "count", (100 * ratio(F.col("count"), F.col("nn"))).alias("population"), "target", (100 * ratio(F.col("target"), F.col("count"))).alias("target_rate"), (100 * pt).alias("target_population"), (100 * F.abs(pt - pn) * F.ln(ratio(lt, ln_))).alias("group_iv"))
    report = g.where(F.size("seg") >= low)
    if high > 1:
        parents = g.select(F.to_json(_key(F.col("seg"))).alias("parent"), F.col("target_rate").alias("rate"))
        kids = report.where(F.size("seg") > 1).select("seg", F.posexplode("seg").alias("at", "gone"))
        kids = kids.select(F.to_json(_key(F.col("seg"))).alias("key"), F.to_json(_key(F.filter("seg", lambda x, i: i != F.col("at")))).alias("parent"), F.col("gone.name").alias("gone"), "at")
        best = kids.join(parents, "parent").groupBy("key").agg(F.min(F.struct("rate", -F.col("at"), "gone")).alias("lo"), F.max(F.struct("rate", "at", "gone")).alias("hi"))
        best = best.select("key", F.concat(F.lit("- "), "lo.gone").alias("parent_min"), F.col("lo.rate").alias("parent_min_tr"), F.concat(F.lit("- "), "hi.gone").alias("parent_max"), F.col("hi.rate").alias("parent_max_tr"))
        report = report.withColumn("key", F.to_json(_key(F.col("seg")))).join(best, "key", "left").drop("key")
    else:
        report = report.withColumns({"parent_min": F.lit(None).cast("string"), "parent_min_tr": F.lit(None).cast("double"), "parent_max": F.lit(None).cast("string"), "parent_max_tr": F.lit(None).cast("double")})
    if pop_more is not None:
        report = report.where(F.col("population") >= pop_more)
    rates = [c for c in ((F.col("target_rate") <= tr_less) if tr_less is not None else None, (F.col("target_rate") >= tr_more) if tr_more is not None else None) if c is not None]
    if rates:
        report = report.where(reduce(lambda a, b: a | b, rates))
    return spread(report, high)


def named(report: DataFrame, most: int) -> DataFrame:
    """Segments with a name ``(v1 = "x") & (v2 = "y")``."""
    parts = [F.when(F.col(f"var{i}_name").isNotNull(), F.format_string('(%s = "%s")', f"var{i}_name", f"var{i}_value")) for i in range(1, most + 1)]
    return report.withColumn("segment", F.concat_ws(" & ", *parts))


def sub_segments(report: DataFrame, most: int, chosen: dict[str, str]) -> DataFrame:
    """Segments that lie inside the chosen one."""
    for name, value in chosen.items():
        hits = [(F.col(f"var{i}_name") == name) & (F.col(f"var{i}_value") == value) for i in range(1, most + 1)]
        report = report.where(F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits]), F.lit(False)))
    return report


def chosen_segments(report: DataFrame, most: int, chosen: dict[str, str]) -> DataFrame:
    """Segments made of chosen values only, of one or more; columns past their number go, and longer segments come first."""
    k = min(len(chosen), most)
    for i in range(1, most + 1):
        name, value = F.col(f"var{i}_name"), F.col(f"var{i}_value")
        hits = [(name == c) & (value == v) for c, v in chosen.items()]
        report = report.where(name.isNull() | reduce(lambda a, b: a | b, hits)) if i <= k else report.where(name.isNull())
    report = report.drop(*[f"var{i}_{x}" for i in range(k + 1, most + 1) for x in ("name", "value")])
    return report.orderBy(*[F.col(f"var{i}_name").asc_nulls_last() for i in range(k, 0, -1)])


def stability(df: DataFrame, split: str, names: Sequence[str], low: int = 1, high: int = 1, main: object = None, target: str | None = None) -> DataFrame:
    """Population, and target, of each segment in each split against the main rows: those of split ``main``, or all.

    Null splits are left out of the report and kept in an all-rows main. Every split has a row for every segment.
    """
    sums = {"n": F.lit(1).cast("long")} | ({"t": F.col(target).cast("long")} if target else {})
    of_main = F.lit(True) if main is None else F.coalesce(F.col(split) == F.lit(main), F.lit(False))
    sums |= {f"m{k}": F.when(of_main, x).otherwise(F.lit(0).cast("long")) for k, x in list(sums.items())}
    g = segments(df, names, low, high, sums, [split]).withColumn("key", F.to_json(_key(F.col("seg"))))
    mains = g.groupBy("key").agg(F.first("seg").alias("seg"), *[F.sum(f"m{k}").alias(f"main_{k}") for k in ("n", "t") if k in sums])
    some = g.where(F.to_json(F.transform("seg", lambda x: x["name"])) == F.to_json(F.array(*[F.lit(c) for c in sorted(names)[:low]])))
    per = some.where(F.col(split).isNotNull()).groupBy(split).agg(*[F.sum(k).alias(f"all_{k}") for k in ("n", "t") if k in sums])
    whole = some.agg(*[F.sum(f"m{k}").alias(f"all_main_{k}") for k in ("n", "t") if k in sums])
    grid = mains.crossJoin(F.broadcast(per)).crossJoin(F.broadcast(whole))
    own = g.where(F.col(split).isNotNull()).select("key", split, *[F.col(k).alias(f"sec_{k}") for k in ("n", "t") if k in sums])
    r = grid.join(own, ["key", split], "left").na.fill(0, [f"sec_{k}" for k in ("n", "t") if k in sums])
    filled = lambda x: F.when(x == 0, F.lit(EPSILON)).otherwise(x)
    pm, ps = F.coalesce(100 * ratio(F.col("main_n"), F.col("all_main_n")), F.lit(0.0)), F.coalesce(100 * ratio(F.col("sec_n"), F.col("all_n")), F.lit(0.0))
    shift = lambda a, b: (b - a) * F.abs(F.ln(filled(b) / filled(a)))
    cols = {"count_main": F.col("main_n"), "count_secondary": F.col("sec_n")}
    if target:
        tm, ts = F.coalesce(100 * ratio(F.col("main_t"), F.col("all_main_t")), F.lit(0.0)), F.coalesce(100 * ratio(F.col("sec_t"), F.col("all_t")), F.lit(0.0))
        cols |= {"target_main": F.col("main_t"), "target_secondary": F.col("sec_t")}
    cols |= {"population_main": pm, "population_secondary": ps}
    if target:
        rate = lambda t, n: 100.0 * F.col(t) / F.when(F.col(n) == 0, F.lit(EPSILON)).otherwise(F.col(n).cast("double"))
        cols |= {"target_rate_main": rate("main_t", "main_n"), "target_rate_secondary": rate("sec_t", "sec_n"), "target_population_main": tm, "target_population_secondary": ts}
    cols |= {"population_stability": shift(pm, ps)}
    if target:
        cols |= {"target_stability": shift(tm, ts)}
    return spread(r.select(split, "seg", *[x.alias(k) for k, x in cols.items()]), high)


def stable_segments(report: DataFrame, most: int, least: float | int | None = None, pop: float | None = None, tgt: float | None = None, outside: bool = False) -> DataFrame:
    """All rows of segments that have a row that meets every condition.

    A share (float) or count (int) must be exceeded; stability must lie within the bounds, or outside them.
    """
    keep = F.lit(True)
    if least is not None:
        keep &= F.col("population_secondary") > 100 * least if isinstance(least, float) else F.col("count_secondary") > least
    for name, bound in (("population_stability", pop), ("target_stability", tgt)):
        if bound is not None:
            keep &= ~F.col(name).between(-bound, bound) if outside else F.col(name).between(-bound, bound)
    keys = [f"var{i}_{x}" for i in range(1, most + 1) for x in ("name", "value")]
    good = report.where(keep).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    return report.join(good, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_semi")
