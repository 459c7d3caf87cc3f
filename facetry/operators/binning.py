"""Cutoffs of numeric variables (fixed, by least share, by tree) and binned columns.

A binned variable is two columns: its label, and under the name with ``__ord`` its place. Cutoffs of all variables
come from one histogram job; only they reach the driver, as they become expressions of the next job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.labels import MISSING, ORD, accuracy, bin_labels, bin_place, place_label, round_number
from facetry.functions.workers import find_us
from facetry.operators.frame import fill_missing, integral, map_values, numeric


@dataclass(frozen=True)
class Binning:
    """Least share of a bin in percent, digits that cutoffs are rounded to, or fixed cutoffs."""

    min_prc: float = 15.0
    rnd: int | None = None
    cutoffs: tuple[float, ...] | None = None


Spec = bool | Binning | Sequence[str] | Mapping[str, bool | Binning]


def normalized(spec: Spec, names: Sequence[str], df: DataFrame) -> dict[str, Binning]:
    """The binning of each numeric variable that is to be binned."""
    if isinstance(spec, bool):
        chosen = dict.fromkeys(names, Binning()) if spec else {}
    elif isinstance(spec, Binning):
        chosen = dict.fromkeys(names, spec)
    elif isinstance(spec, Mapping):
        chosen = {c: Binning() if b is True else b for c, b in spec.items() if b}
    else:
        chosen = dict.fromkeys(spec, Binning())
    return {c: b for c, b in chosen.items() if c in names and numeric(df, c)}


def histogram(df: DataFrame, names: Sequence[str], target: str | None = None) -> DataFrame:
    """(variable, value, n, t): rows and target of each distinct value, null and NaN as null."""
    y = F.col(target).cast("long") if target else F.lit(0).cast("long")
    cells = [F.struct(F.lit(c).alias("variable"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("value")) for c in names]
    return df.select(y.alias("y"), F.explode(F.array(*cells)).alias("x")).groupBy(F.col("x.variable").alias("variable"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"), F.sum("y").alias("t"))


def _profiled(hist: DataFrame) -> DataFrame:
    """One row a variable: its values in order with their percent, and what the early exits need."""
    return hist.groupBy("variable").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("known"),
        F.max("n").alias("top"),
        F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "n", "t")))).alias("cells"),
    )


def degenerate(min_prc: float) -> Column:
    """Whether a variable is too empty, too uniform or constant for cutoffs."""
    share = lambda n: 100.0 * F.col(n) / F.col("total")
    return (share("known") < min_prc) | (share("top") >= 100 - min_prc) | (F.size("cells") <= 1)


def greedy_cutoffs(df: DataFrame, names: Sequence[str], min_prc: float = 15.0) -> DataFrame:
    """(variable, cutoffs) by one left-to-right fold over each variable's values, in native expressions.

    Values below the least share gather until they reach it; a value that has it alone gets its own bin, after
    what has gathered if that is 80 % of the share or more. The last cutoff goes, so a short tail joins its
    left neighbour. Whole variables get whole cutoffs when ``min_prc`` has no decimals.
    """
    min_prc = max(min_prc, 0.001)
    digits, part = accuracy(min_prc), 0.8 * min_prc
    made = _profiled(histogram(df, names))
    state = F.struct(F.array().cast("array<double>").alias("cuts"), F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("acc"))

    def step(s: Column, x: Column) -> Column:
        p = 100.0 * x["n"] / F.col("total")
        acc = s["acc"] + p
        small = F.bround(p, digits) < min_prc
        full = F.bround(acc, digits) >= min_prc
        grown = F.struct(F.when(full, F.array_append(s["cuts"], x["value"])).otherwise(s["cuts"]).alias("cuts"), x["value"].alias("last"), F.when(full, 0.0).otherwise(acc).alias("acc"))
        before = F.when(s["acc"] >= part, F.array_append(s["cuts"], s["last"])).otherwise(s["cuts"])
        own = F.struct(F.array_append(before, x["value"]).alias("cuts"), s["last"].alias("last"), F.lit(0.0).alias("acc"))
        return F.when(small, grown).otherwise(own)

    done = F.aggregate("cells", state, step, lambda s: F.when(s["acc"] >= part, F.array_append(s["cuts"], s["last"])).otherwise(s["cuts"]))
    cuts = F.when(degenerate(min_prc), F.array().cast("array<double>")).otherwise(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))))
    whole = F.forall("cells", lambda x: x["value"] % 1 == 0)
    tidy = F.array_sort(F.array_distinct(F.when(F.lit(digits == 0) & whole, F.transform("c2", lambda v: F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("double"))).otherwise(F.col("c2"))))
    return made.withColumn("c", done).withColumn("c2", cuts).select("variable", tidy.alias("cutoffs"))


def cart_cutoffs(value: np.ndarray, n: np.ndarray, t: np.ndarray, least: int) -> list[float]:
    """Cuts of a Gini tree on one feature without a depth limit, from a histogram in ascending order.

    A node splits if it is impure and both sides can hold ``least`` rows; the split with the least weighted
    impurity wins, the lowest of equal ones. Cuts lie midway between neighbours, in single precision.
    """
    cn, ct = np.concatenate([[0], np.cumsum(n)]).astype(float), np.concatenate([[0], np.cumsum(t)]).astype(float)
    v = value.astype(np.float32)
    cuts: list[float] = []
    todo = [(0, len(v))]
    while todo:
        a, b = todo.pop()
        size, hits = cn[b] - cn[a], ct[b] - ct[a]
        if b - a < 2 or hits in (0, size) or size < 2 * least:
            continue
        k = np.arange(a + 1, b)
        ln, lt = cn[k] - cn[a], ct[k] - ct[a]
        rn, rt = size - ln, hits - lt
        ok = (ln >= least) & (rn >= least)
        if not ok.any():
            continue
        purity = (lt**2 + (ln - lt) ** 2) / ln + (rt**2 + (rn - rt) ** 2) / rn
        purity[~ok] = -np.inf
        i = int(k[int(np.argmax(purity))])
        cuts.append(float(v[i - 1] / 2 + v[i] / 2))
        todo += [(a, i), (i, b)]
    return sorted(c for c in set(cuts) if v[0] < c < v[-1])


def tree_cutoffs(df: DataFrame, names: Sequence[str], target: str, min_prc: float = 15.0) -> DataFrame:
    """(variable, cutoffs) by a tree for each variable, grown from its histogram in one grouped task."""
    min_prc = max(min_prc, 0.001)
    find_us(df.sparkSession)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        total, known = pdf["n"].sum(), pdf[pdf["value"].notna()].sort_values("value")
        share = 100 * known["n"].sum() / total
        bare = share < min_prc or 100 * pdf["n"].max() / total >= 100 - min_prc or len(known) <= 1
        cuts = [] if bare else cart_cutoffs(known["value"].to_numpy(), known["n"].to_numpy(), known["t"].to_numpy(), round(min_prc * total / 100))
        return pd.DataFrame({"variable": [pdf["variable"].iloc[0]], "cutoffs": [cuts]})

    return histogram(df, names, target).groupBy("variable").applyInPandas(grow, "variable string, cutoffs array<double>")


def cutoffs(df: DataFrame, specs: Mapping[str, Binning], target: str | None = None) -> dict[str, list[float]]:
    """Inner cutoffs of each variable; one job for each least share asked for."""
    out: dict[str, list[float]] = {c: sorted(set(b.cutoffs)) for c, b in specs.items() if b.cutoffs is not None}
    shares: dict[float, list[str]] = {}
    for c, b in specs.items():
        if b.cutoffs is None:
            shares.setdefault(b.min_prc, []).append(c)
    for share, names in shares.items():
        found = tree_cutoffs(df, names, target, share) if target else greedy_cutoffs(df, names, share)
        out |= {r["variable"]: list(r["cutoffs"]) for r in found.collect()}
    for c, b in specs.items():
        if b.cutoffs is None and integral(df, c):
            out[c] = sorted({int(np.floor(x)) for x in out.get(c, [])})
        if b.rnd is not None:
            out[c] = sorted({round_number(x, b.rnd) for x in out.get(c, [])})
    return {c: out.get(c, []) for c in specs}


def binned(df: DataFrame, cuts: Mapping[str, Sequence[float]], legacy: bool = False) -> DataFrame:
    """Each variable replaced by its label, with its place beside it."""
    missing = "Missing" if legacy else MISSING
    places = {c + ORD: bin_place(F.nanvl(F.col(c).cast("double"), F.lit(None)), x) for c, x in cuts.items()}
    df = df.withColumns(places)
    return df.withColumns({c: place_label(F.col(c + ORD), bin_labels(x, legacy), missing) for c, x in cuts.items()})


def prepared(df: DataFrame, names: Sequence[str], target: str | None = None, maps: Mapping | None = None, binning: Spec = True, by_target: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """Report-ready variables: unbinned ones filled and mapped, then numeric ones binned; ``keep`` stays as it is.

    Values of unbinned variables keep their rank as place if they are numbers; text has place 1.
    """
    specs = normalized(binning, names, df)
    cuts = cutoffs(df, specs, target if by_target else None)
    rest = [c for c in names if c not in specs]
    kept = df.select(*dict.fromkeys([*names, *([target] if target else []), *keep]))
    ranks = {c + ORD: F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(F.lit(1.0) + (F.col(c).cast("double") if numeric(df, c) else F.lit(0.0))) for c in rest}
    kept = fill_missing(kept.withColumns(ranks), dict.fromkeys(rest, MISSING))
    maps = dict(maps or {})
    if maps and not all(isinstance(m, Mapping) for m in maps.values()):
        maps = dict.fromkeys(rest, maps)
    kept = map_values(kept, {c: {str(k): str(v) for k, v in m.items()} for c, m in maps.items() if c in rest})
    return binned(kept, cuts)
