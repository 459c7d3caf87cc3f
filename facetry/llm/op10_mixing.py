"""Mixing sources to target weights by a time-varying curriculum.

Targets: sources by code point, null last, get weights and share the total by weight; none may exceed ``cap``
times its size, and the excess is reshared by weight. Positions: a source's schedule g(t) >= 0 on [0, 1] is
integrated to G(t); the source has asked for target * G(t) / G(1) words by time t. Its documents, in a fixed
pseudo-random order and repeated in rounds, fill that demand one after another, so an occurrence whose words
start at c gets the position t with target * G(t) / G(1) = c. An occurrence is taken if its middle word is not
past the target, so a source's words miss the target by half a document at most. The mix is range-sorted by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.llm.common import WORD, cut, read, row_keys, sums_before

WEIGHTS = (1.0, 2.0, 3.0)
#: Knots (t, g) of the schedules, given to the sources in turn: steady, rising and falling.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float] = WEIGHTS, cap: float = 3.0) -> dict[str | None, tuple[float, int]]:
    """Source -> (target, place in the order), in plain Python. Water-filling, to the end: each round caps a source or ends."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weigh = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, left, open_ = dict(order), float(sum(n for _, n in order)), {s for s, _ in order}
    out: dict[str | None, float] = {}
    while open_:
        w = sum(weigh[s] for s in sorted(open_, key=lambda s: (s is None, s or "")))
        over = {s for s in open_ if left * weigh[s] / w > cap * size[s]}
        for s in over or open_:
            out[s] = cap * size[s] if over else left * weigh[s] / w
        left -= sum(out[s] for s in sorted(over, key=lambda s: (s is None, s or "")))
        open_ = open_ - over if over else set()
    return {s: (out[s], i) for i, (s, _) in enumerate(order)}


def with_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """Rows (nul, src, source_size) plus place and target, as ``targets`` has them, for any number of sources.

    With sources in order of cap by weight, the first that the level does not cap tells the level of all.
    """
    placed = sums_before(sources, ["nul", "src"], {"place": F.lit(1).cast("long")})
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("place") % len(weights))
    placed = placed.withColumn("weight", weight).withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    filled = cut(sums_before(placed, ["ratio", "place"], {"used": F.col("most"), "closed": F.col("weight")}))
    total = filled.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("open"))
    level = (F.col("total") - F.col("used")) / (F.col("open") - F.col("closed"))
    level = filled.crossJoin(F.broadcast(total)).select("ratio", level.alias("level")).where("level <= ratio").agg(F.min_by("level", "ratio").alias("level"))
    share = F.col("level") * F.col("weight")
    return filled.crossJoin(F.broadcast(level)).select("nul", "src", "source_size", "place", F.when(share < F.col("most"), share).otherwise(F.col("most")).alias("target"))


def position(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The t in [0, 1] at which the integral of the piecewise-linear schedule reaches ``share`` of its whole."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    total, out = sum(area), F.lit(knots[-1][0])
    for i in reversed(range(len(area))):
        a, b, x, done = knots[i], knots[i + 1], area[i], sum(area[:i])
        need, slope = share * total - done, (b[1] - a[1]) / (b[0] - a[0])
        root = need / a[1] if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), F.lit(a[1] ** 2) + 2 * slope * need)) - a[1]) / slope
        out = F.when(share * total < done + x, a[0] + root).otherwise(out)
    return out


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = 3, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, times, taken, position (of the first occurrence taken, else null).

    size counts the words of the text (null or empty: 0). A null source is a source of its own, last in order.
    A source without words has target 0. Rows of one id, and repeated rows, each count; rows without an id are
    ordered by their text. Rows that tie in every key are alike, so which of them comes first does not show. An
    empty table gives an empty result. Documents of a source are dealt by the md5 of their id into 4096 runs a
    source, which are summed before any window, so no window holds a whole source. Nothing reaches the driver.
    """
    at = _planned(docs, weights, cap, schedules, id_col, text_col, source_col)
    source = F.when(~F.col("nul"), F.col("src")).alias(source_col)
    return at.select(F.col("id").alias(id_col), source, "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), "position")


def _planned(docs: DataFrame, weights: Sequence[float], cap: int, schedules: Sequence[Sequence[tuple[float, float]]], id_col: str, text_col: str, source_col: str, keep: Sequence[Column] = ()) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), text)))
    source = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), source.isNull().alias("nul"), F.coalesce(source, F.lit("")).alias("src"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), order.alias("key"), F.xxhash64(text).alias("tie"), *keep)
    rows = cut(rows.withColumn("run", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")))  # texts are read once
    runs = cut(rows.groupBy("nul", "src", "run").agg(F.sum("size").alias("words")))
    per = with_targets(runs.groupBy("nul", "src").agg(F.sum("words").alias("source_size")), weights, cap)
    before = Window.partitionBy("nul", "src").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("nul", "src", "run", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead")).join(per, ["nul", "src"])
    inside = Window.partitionBy("nul", "src", "run").orderBy("key", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(runs, ["nul", "src", "run"])
    start = F.col("ahead") + F.col("inside")
    # Round r of a document starts at r * source_size + start.
    taken = lambda r: F.when((F.col("size") > 0) & (2 * (start + r * F.col("source_size")) + F.col("size") <= 2 * F.col("target")), 1).otherwise(0)
    times = sum((taken(r) for r in range(1, cap)), taken(0))
    at = at.withColumn("start", start).withColumn("times", times.cast("int")).withColumn("schedule", F.col("place") % len(schedules))
    where = occurrence_position(F.col("start"), schedules)
    return at.withColumn("position", F.when(F.col("times") > 0, where))


def occurrence_position(start: Column, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> Column:
    """Position of an occurrence whose words start at ``start`` of its source's demand."""
    share = start / F.expr("nullif(target, 0)")
    out = F.lit(None).cast("double")
    for i, knots in enumerate(schedules):
        out = F.when(F.col("schedule") == i, position(share, knots)).otherwise(out)
    return out


def mixture(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: int = 3, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, range-sorted by training position.

    Its columns are those of ``docs``; a document without words is never taken. Null ids are allowed. Only keys go
    through the plan; rows come to their positions in one join, where repeated rows, which are alike, stand once.
    """
    names = docs.columns
    keys = row_keys(docs)
    plan = _planned(docs, weights, cap, schedules, id_col, text_col, source_col, keys).where("times > 0")
    plan = plan.withColumn("round", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    at = occurrence_position(F.col("start") + F.col("round") * F.col("source_size"), schedules)
    plan = cut(plan.select("k1", "k2", at.alias("at"), "round"))
    rows = plan.join(docs.select(F.struct(*names).alias("row"), *keys).dropDuplicates(["k1", "k2"]), ["k1", "k2"])
    return rows.orderBy("at", F.col("row").getField(id_col), "round", "k1").select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.round("position", 9).alias("position")).orderBy("position", "doc_id")


QUERIES = {"op10_mixing": op10_mixing}
#: Exact up to the last bits of doubles; targets of sources in order of cap by weight, as the rounds of water-filling end.
SQL = {
    "op10_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(doc_id::varchar, 'null ' || coalesce(text, ''))) as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
o as (select *, row_number() over (order by source nulls last) - 1 as i from s),
w as (select *, (1 + i % 3)::double as weight, 3.0::double * source_size as cap from o),
c as (select *, sum(weight) over (order by cap / weight desc, i desc rows between unbounded preceding and current row) as w_open, coalesce(sum(cap) over (order by cap / weight, i rows between unbounded preceding and 1 preceding), 0) as used, sum(source_size) over () as total from w),
lv as (select arg_min(level, ratio) as level from (select (total - used) / w_open as level, cap / weight as ratio from c) where level <= ratio),
t as (select source, source_size, i % 3 as schedule, case when lv.level is null or cap <= lv.level * weight then cap else lv.level * weight end as target from c, lv),
x as (select d.*, coalesce(sum(d.size) over (partition by d.source order by k, doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as start from d),
y as (select x.doc_id, x.size, t.source_size, t.target, t.schedule, x.start, case when x.size > 0 then (2 * start + x.size <= 2 * target)::int + (2 * (start + t.source_size) + x.size <= 2 * target)::int + (2 * (start + 2 * t.source_size) + x.size <= 2 * target)::int else 0 end as times from x join t on x.source is not distinct from t.source)
select doc_id, size, source_size, target, (times * size)::bigint as taken,
  round(case when times > 0 then case schedule when 0 then start / target when 1 then sqrt(0.25 + 2 * start / target) - 0.5 else 1.5 - sqrt(greatest(0, 2.25 - 2 * start / target)) end end, 9) as "position"
from y
"""
}
