"""Micro-frames with results worked out by hand, for the traps of the semantics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions.labels import MISSING, NOT_MISSING, ORD, accuracy, bin_labels, number_text
from facetry.operators import binning, cross, frame, legacy, reports, scores
from facetry.operators.cache import ReportCache
from facetry.operators.running import running
from facetry.sources import tables
from facetry.streaming import counts


def greedy(spark, values, min_prc=15.0, kind="int"):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    return binning.greedy_cutoffs(df, ["v"], min_prc).first()["cutoffs"]


def test_number_text():
    assert [number_text(x) for x in (5000, -100, -1234567.5, 0.03, 999)] == ["5_000", "-100", "-1_234_567.5", "0.03", "999"]
    assert [accuracy(x) for x in (15.0, 12.5, 3, 0.25)] == [0, 1, 0, 2]
    assert bin_labels([10, 20]) == ["<= 10", "(10; 20]", "> 20"]
    assert bin_labels([]) == [NOT_MISSING]


def test_greedy_pairs_and_tail(spark):
    assert greedy(spark, range(1, 11)) == [2.0, 4.0, 6.0, 8.0]


def test_greedy_big_value(spark):
    # Shares 12, 60, 20, 8: the 12 reach 80 % of 15, the 60 and the 20 stand alone, the tail of 8 joins the 20.
    assert greedy(spark, [1] * 3 + [2] * 15 + [3] * 5 + [4] * 2) == [1.0, 2.0]


def test_greedy_fractions_are_not_cut_off(spark):
    cuts = greedy(spark, [x / 20 for x in range(1, 11)], kind="double")
    assert cuts == pytest.approx([0.1, 0.2, 0.3, 0.4])


@pytest.mark.parametrize("values", [[None] * 4, [3.0] * 4, [None] * 9 + [1.0], [float("nan"), None] * 3])
def test_degenerate_variables_have_no_cutoffs(spark, values):
    assert greedy(spark, values, kind="double") == []


def test_nan_and_null_are_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (30.0,)], "v double")
    got = [(r["v"], r["v" + ORD]) for r in binning.binned(df, {"v": [10]}).collect()]
    assert sorted(got) == sorted([("<= 10", 1), (MISSING, 0), (MISSING, 0), ("> 10", 2)])


def test_tree(spark):
    df = spark.createDataFrame([(i, int(i > 10)) for i in range(1, 21)], "v int, y int")
    assert binning.tree_cutoffs(df, ["v"], "y", 10).first()["cutoffs"] == [10.5]
    assert binning.cutoffs(df, {"v": binning.Binning(10)}, "y") == {"v": [10]}


def test_tree_leaves_hold_their_least_share():
    rng = np.random.default_rng(1)
    v, n = np.arange(200.0), rng.integers(1, 9, 200)
    t = rng.binomial(n, (np.sin(v / 15) + 1) / 2)
    cuts = binning.cart_cutoffs(v, n, t, 50)
    assert cuts and min(np.histogram(v, [-1, *cuts, 1e9], weights=n)[0]) >= 50


def test_zero_cells_in_both_formulas(spark):
    rows = [("a", 0)] * 4 + [("b", 1)] * 2 + [("c", 0), ("c", 1)]
    df = spark.createDataFrame(rows, "g string, y int")
    iv = {r["group"]: r["group_iv"] for r in reports.iv_report(df, ["g"], "y").collect()}
    con = {r["var1_value"]: r["group_iv"] for r in reports.concentration(df, ["g"], "y").collect()}
    assert iv["a"] == pytest.approx(100 * abs(1 / 3 - 4 / 5) * math.log((1 / 3) / (4 / 5)))
    assert con["a"] == pytest.approx(100 * abs(0 - 4 / 5) * math.log((1 / 3) / (4 / 5)))
    assert iv["c"] == pytest.approx(con["c"])


def test_parent_ties_keep_the_one_without_the_last_variable(spark):
    rows = [(a, b, y) for a in "xy" for b in "uv" for y in (0, 1)]
    got = reports.concentration(spark.createDataFrame(rows, "a string, b string, y int"), ["a", "b"], "y", 1, 2).where("var2_name is not null")
    assert {(r["parent_min"], r["parent_max"]) for r in got.collect()} == {("- b", "- b")}


def test_combinations_from_two_on_still_have_parents(spark):
    rows = [(a, b, int(a == "x")) for a in "xy" for b in "uv" for _ in range(2)]
    got = reports.concentration(spark.createDataFrame(rows, "a string, b string, y int"), ["a", "b"], "y", 2, 2).collect()
    assert len(got) == 4 and all(r["parent_min"] for r in got)


def test_stability_is_dense_and_zero_against_itself(spark):
    df = spark.createDataFrame([("s1", "a", 1), ("s1", "b", 0), ("s2", "a", 1), ("s2", "a", 0), (None, "a", 0)], "s string, g string, y int")
    got = {(r["s"], r["var1_value"]): r for r in reports.stability(df, "s", ["g"], target="y").collect()}
    assert len(got) == 4 and got["s2", "b"]["count_secondary"] == 0 and math.isfinite(got["s2", "b"]["population_stability"])
    own = reports.stability(df.where("s = 's1'"), "s", ["g"], main="s1", target="y").collect()
    assert all(r["population_stability"] == 0 and r["target_stability"] == 0 for r in own)


def test_fill_comes_before_map(spark):
    df = spark.createDataFrame([("a", 1), (None, 0), (None, 1), ("b", 0)], "g string, y int")
    got = binning.prepared(df, ["g"], "y", {"g": {MISSING: "x"}}, False)
    assert sorted(r["g"] for r in got.collect()) == ["a", "b", "x", "x"]


@pytest.mark.parametrize("values", [[0, 1, None], [0, 2], [0, 0, 0]])
def test_bad_targets(spark, values):
    with pytest.raises(ValueError):
        frame.check_target(spark.createDataFrame([(v,) for v in values], "y int"), "y")


def test_missing_column_raises(spark):
    with pytest.raises(ValueError):
        frame.project(spark.range(1), ["nope"])


def test_intersections_keep_empty_ones(spark):
    sets = {k: spark.createDataFrame([(x,) for x in v], "k int") for k, v in {"a": [1, 2, 3], "b": [3, 4], "c": [5]}.items()}
    assert {r["mask"]: r["size"] for r in cross.intersections(sets, ["k"]).collect()} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0}


def test_category_order(spark):
    df = spark.createDataFrame([("> 20", 1.0), (MISSING, 9.0), ("<= 3", 5.0), ("(3; 20]", 0.0)], "v string, r double")
    got = cross.category_order(df, "v", "r").orderBy("place").collect()
    assert [r["v"] for r in got] == [MISSING, "<= 3", "(3; 20]", "> 20"]


def test_scores(spark):
    rows = [(0.9, 1), (0.8, 1), (0.8, 0), (0.3, 0), (0.1, 1), (0.1, 0)]
    df = spark.createDataFrame(rows, "p double, y int")
    wins = sum((a > b) + (a == b) / 2 for a, x in rows if x for b, y in rows if not y)
    r = scores.roc_auc(df, "p", "y").first()
    assert r["auc"] == pytest.approx(wins / 9) and r["gini"] == pytest.approx(2 * wins / 9 - 1)
    assert scores.lift(df, "p", "y").count() == 4
    assert [x["count"] for x in scores.calibration(df, "p", "y", [0, 0.5, 0.95, 1]).orderBy("bin").collect()] == [3, 3, 0]


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_over_ranges(spark, descending):
    rng = np.random.default_rng(4)
    cells = {(g, float(v)): int(n) for g in "ab" for v, n in zip(np.unique(rng.normal(size=3000).round(3)), rng.integers(1, 9, 3000), strict=False)}
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()] + [("a", None, 5)], "g string, v double, n int")
    got = running(df, "v", ["n"], ["g"], descending).collect()
    want, sums = {}, {"a": 0, "b": 0}
    for (g, v), n in sorted(cells.items(), key=lambda x: x[0][1], reverse=descending):
        sums[g] += n
        want[g, v] = sums[g]
    assert {(r["g"], r["v"]): r["run_n"] for r in got} == want
    assert running(df.where("n < 0"), "v", ["n"]).count() == 0


def test_kendall(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "a int, b int")
    assert scores.kendall(df, "a", "b").first()["tau"] == pytest.approx(1)


def test_kendall_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(-9, 9, 400), rng.normal(size=400).round(1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (1, None)], "a int, b double")
    dx, dy = np.sign(x[:, None] - x[None]), np.sign(y[:, None] - y[None])
    assert scores.kendall(df, "a", "b").first()["tau"] == pytest.approx((dx * dy).sum() / math.sqrt((dx**2).sum() * (dy**2).sum()))
    assert scores.kendall(df.withColumn("b", F.lit(1.0)), "a", "b").first()["tau"] is None


@pytest.mark.parametrize("descending", [False, True])
def test_numbered(spark, descending):
    rng = np.random.default_rng(6)
    rows = [(None if i % 50 == 0 else float(v), f"k{i:04}") for i, v in enumerate(rng.integers(0, 60, 500))]
    got = {r["k"]: r["place"] for r in frame.numbered(spark.createDataFrame(rows, "v double, k string"), "v", "place", ["k"], descending).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, 0 if r[0] is None else -r[0] if descending else r[0], r[1]))
    assert got == {k: i for i, (_, k) in enumerate(order, 1)}


def test_reports_as_files_and_html(spark, tmp_path):
    df = spark.createDataFrame([("<a>", 1.5), (None, 2.0)], "g string, x double").coalesce(1)
    assert tables.as_html(df) == "<table>\n<tr><th>g</th><th>x</th></tr>\n<tr><td>&lt;a&gt;</td><td>1.5</td></tr>\n<tr><td></td><td>2.0</td></tr>\n</table>"
    with pytest.raises(ValueError):
        tables.as_html(df, 1)
    tables.write(df, str(tmp_path / "r"), "csv")
    assert sorted(map(str, tables.csv(spark, str(tmp_path / "r")).collect())) == sorted(map(str, df.collect()))


def test_stream_counts_equal_the_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 5} 00:00:00", "ab"[i % 2], i % 3, int(i % 7 == 0)) for i in range(200)]
    df = spark.createDataFrame(rows, "ts string, g string, k int, y int").withColumn("ts", F.to_timestamp("ts"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    key = lambda d: sorted(map(str, d.collect()))
    q = counts.target_counts(stream(), ["g", "k"], "y").writeStream.format("memory").queryName("all_counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert key(spark.table("all_counts")) == key(reports.grouped_target(df, ["g", "k"], "y"))
    q = counts.windowed_counts(stream(), "ts", "1 day", "30 days", ["g"], "y").writeStream.format("memory").queryName("daily").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    last = spark.table("daily").groupBy("start", "group").agg(F.max("n").alias("n"), F.max("t").alias("t"))
    assert key(last) == key(df.groupBy(F.col("ts").alias("start"), F.col("g").alias("group")).agg(F.count("*").alias("n"), F.sum("y").alias("t")))


def test_legacy_cutoffs_degenerate(spark):
    df = spark.createDataFrame([(3.0,)] * 4, "v double")
    assert legacy.legacy_cutoffs(df, ["v"]).first()["cutoffs"] == []


def test_report_cache_answers_narrower_ranges(spark):
    made = []

    def make(low, high):
        made.append((low, high))
        df = spark.createDataFrame([("a", "x", 1), ("b", "x", 0), ("a", "y", 0)], "g string, h string, y int")
        return reports.concentration(df, ["g", "h"], "y", low, high)

    cache = ReportCache()
    assert cache.get("k", 1, 2, make).where(F.col("var2_name").isNotNull()).count() == 3
    assert cache.get("k", 1, 1, make).count() == 4 and made == [(1, 2)]


def test_no_python_but_for_trees(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "v int, g string, y int")
    for d in (binning.greedy_cutoffs(df, ["v"]), reports.concentration(df, ["g"], "y"), reports.iv_report(df, ["g"], "y")):
        assert "Python" not in d._jdf.queryExecution().toString() and "Pandas" not in d._jdf.queryExecution().toString()
