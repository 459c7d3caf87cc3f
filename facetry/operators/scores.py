"""Association of variables and quality of scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.operators.frame import with_sums
from facetry.operators.reports import ratio
from facetry.operators.running import running


def cramers_v(df: DataFrame, one: str, two: str, corrected: bool = True) -> DataFrame:
    """One row (v): Cramer's V of two columns, bias-corrected or plain; 2 x 2 tables get Yates' correction."""
    g = df.where(F.col(one).isNotNull() & F.col(two).isNotNull()).groupBy(F.col(one).alias("a"), F.col(two).alias("b")).agg(F.count("*").cast("double").alias("o"))
    g = g.withColumn("ra", F.sum("o").over(Window.partitionBy("a"))).withColumn("cb", F.sum("o").over(Window.partitionBy("b")))
    g = with_sums(g, {"n": F.sum("o")}).withColumn("e", F.col("ra") * F.col("cb") / F.col("n"))
    s = g.agg(F.count_distinct("a").alias("r"), F.count_distinct("b").alias("k"), F.max("n").alias("n"), F.sum(F.col("o") ** 2 / F.col("e")).alias("oe"), F.sum(F.pow(F.greatest(F.abs(F.col("o") - F.col("e")) - 0.5, F.lit(0.0)), F.lit(2.0)) / F.col("e")).alias("yates"), F.count("*").alias("cells"))
    # Empty cells add their expectation; over all cells chi2 is sum(o^2 / e) - n.
    s = s.withColumn("chi2", F.when((F.col("r") == 2) & (F.col("k") == 2) & (F.col("cells") == 4), F.col("yates")).otherwise(F.col("oe") - F.col("n")))
    phi = ratio(F.col("chi2"), F.col("n"))
    if not corrected:
        return s.select(F.sqrt(ratio(phi, F.least("r", "k") - 1)).alias("v"))
    n1 = F.col("n") - 1
    bias = ratio((F.col("k") - 1) * (F.col("r") - 1), n1)
    rc, kc = (F.col(c) - ratio((F.col(c) - 1) ** 2, n1) for c in ("r", "k"))
    return s.select(F.sqrt(ratio(F.greatest(F.lit(0.0), phi - bias), F.least(rc, kc) - 1)).alias("v"))


def correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, corr) Pearson, both ways and the diagonal, in one pass."""
    pairs = list(combinations(names, 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs for x, y in ((a, b), (b, a))]
    cells += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("corr")) for c in names]
    return one.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def ranked(df: DataFrame, name: str) -> DataFrame:
    """(value, rank): average rank of each distinct value, by running counts over distinct values."""
    g = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    return running(g, "value", ["n"]).select("value", (F.col("run_n") - (F.col("n") - 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(a, b, corr) of average ranks; rows with a null in any of the variables are left out."""
    base = work = df.na.drop(subset=list(names)).select(*names)
    for c in names:
        work = work.join(ranked(base.select(c), c).select(F.col("value").alias(c), F.col("rank").alias(f"_r_{c}")), c)
    return correlations(work.select(*[F.col(f"_r_{c}").alias(c) for c in names]), names)


def kendall(df: DataFrame, one: str, two: str) -> DataFrame:
    """One row (tau): tau-b of two numeric columns.

    Distinct values of the second have ranks. Two ranks first differ at one binary digit; for each digit and each
    prefix before it, running sums in order of the first column count the pairs in and out of order. So the work is
    the distinct value pairs times the digits, and no pair of rows is made.
    """
    known = df.where(F.col(one).isNotNull() & F.col(two).isNotNull())
    g = known.groupBy(F.col(one).cast("double").alias("x"), F.col(two).cast("double").alias("y")).agg(F.count("*").alias("n"))
    ranks = running(g.groupBy("y").agg(F.lit(1).cast("long").alias("one")), "y", ["one"]).select("y", (F.col("run_one") - 1).alias("rank"))
    digits = max(1, int(ranks.agg(F.max("rank")).first()[0] or 0).bit_length())
    cells = g.join(ranks, "y").select("x", "n", "rank", F.explode(F.array(*[F.lit(i) for i in range(digits)])).alias("digit"))
    high = F.expr("(rank >> digit) & 1") == 1
    cells = cells.groupBy("digit", F.expr("rank >> (digit + 1)").alias("prefix"), "x").agg(F.sum(F.when(high, 0).otherwise(F.col("n"))).alias("low"), F.sum(F.when(high, F.col("n")).otherwise(0)).alias("high"))
    run = running(cells, "x", ["low", "high"], ["digit", "prefix"])
    d = lambda c: F.col(c).cast("double")
    s = run.agg(F.sum(d("high") * (d("run_low") - d("low")) - d("low") * (d("run_high") - d("high"))).alias("s"))
    ties = lambda c: g.groupBy(c).agg(F.sum("n").alias("n")).agg(F.sum(d("n")).alias(f"n{c}"), F.sum(d("n") * d("n")).alias(f"t{c}"))
    p = s.crossJoin(F.broadcast(ties("x"))).crossJoin(F.broadcast(ties("y")))
    pairs = lambda c: F.col(f"n{c}") * F.col(f"n{c}") - F.col(f"t{c}")
    return p.select(ratio(2 * F.col("s"), F.sqrt(pairs("x") * pairs("y"))).alias("tau"))


def cramer_matrix(df: DataFrame, names: Sequence[str], corrected: bool = True) -> DataFrame:
    """(a, b, corr) of Cramer's V, both ways and the diagonal."""
    rows = [cramers_v(df, a, b, corrected).select(F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col("v").alias("corr")) for x, y in ((a, b), (b, a))])).alias("x")).select("x.*") for a, b in combinations(names, 2)]
    same = df.sparkSession.createDataFrame([(c, c, 1.0) for c in names], "a string, b string, corr double")
    return reduce(DataFrame.union, rows, same)


def top_correlations(matrix: DataFrame, top: int) -> DataFrame:
    """(a, abs_max, mean, median, top array<string>) over the other variables of each row of a matrix."""
    other = matrix.where("a <> b")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.abs("corr").desc(), "b"))
    best = other.withColumn("place", place).where(F.col("place") <= top).groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "b"))), lambda x: x["b"]).alias("top"))
    s = other.groupBy("a").agg(F.max(F.abs("corr")).alias("abs_max"), F.avg(F.abs("corr")).alias("mean"), F.median(F.abs("corr")).alias("median"))
    return s.join(best, "a")


def score_steps(df: DataFrame, pred: str, fact: str) -> DataFrame:
    """(score, n, t, cn, ct): rows and hits of each distinct score, and of all scores at least as high."""
    g = df.where(F.col(pred).isNotNull() & F.col(fact).isNotNull()).groupBy(F.col(pred).cast("double").alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(fact).cast("long")).alias("t"))
    return running(g, "score", ["n", "t"], descending=True).withColumnsRenamed({"run_n": "cn", "run_t": "ct"})


def with_totals(steps: DataFrame) -> DataFrame:
    """Steps plus nn and tt, their sums, as one row beside each."""
    return steps.crossJoin(F.broadcast(steps.agg(F.sum("n").alias("nn"), F.sum("t").alias("tt"))))


def roc_auc(df: DataFrame, pred: str, fact: str) -> DataFrame:
    """One row (auc, gini), equal scores as one step."""
    s = score_steps(df, pred, fact)
    f = F.col("n") - F.col("t")
    s = s.agg(F.sum(f * (F.col("ct") - F.col("t") / 2.0)).alias("area"), F.sum("t").alias("tt"), F.sum(f).alias("ff"))
    auc = ratio(F.col("area"), F.col("tt") * F.col("ff"))
    return s.select(auc.alias("auc"), (2 * auc - 1).alias("gini"))


def pr_curve(df: DataFrame, pred: str, fact: str) -> DataFrame:
    """(threshold, precision, recall) at each distinct score."""
    return with_totals(score_steps(df, pred, fact)).select(F.col("score").alias("threshold"), ratio(F.col("ct"), F.col("cn")).alias("precision"), ratio(F.col("ct"), F.col("tt")).alias("recall"))


def lift(df: DataFrame, pred: str, fact: str) -> DataFrame:
    """(score, share_all, share_target) of all scores at least as high."""
    return with_totals(score_steps(df, pred, fact)).select("score", ratio(F.col("cn"), F.col("nn")).alias("share_all"), ratio(F.col("ct"), F.col("tt")).alias("share_target"))


def calibration(df: DataFrame, pred: str, fact: str, bins: Sequence[float]) -> DataFrame:
    """(bin, low, high, count, predicted, observed, population) of right-closed bins between fixed edges, empty ones too."""
    edges = sorted(bins)
    place: Column = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        place = F.when((F.col(pred) > edges[i]) & (F.col(pred) <= edges[i + 1]), i).otherwise(place)
    g = df.select(place.alias("bin"), F.col(pred).cast("double").alias("p"), F.col(fact).cast("double").alias("y")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("count"), F.avg("p").alias("predicted"), F.avg("y").alias("observed"))
    g = with_sums(g, {"_all": F.sum("count")}).withColumn("population", 100 * ratio(F.col("count"), F.col("_all"))).drop("_all")
    grid = df.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    return grid.join(g, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0)))


def by_segment(df: DataFrame, segments: dict[str, Column], report) -> DataFrame:
    """A report for each named segment of rows, with its name."""
    return reduce(DataFrame.unionByName, [report(df.where(c)).withColumn("segment", F.lit(k)) for k, c in segments.items()])
