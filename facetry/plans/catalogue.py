"""All queries of the library by name, over the test tables, and the SQL they are held against.

Doubles are rounded to six digits on both sides, as sums differ in their last bits with their order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from facetry.functions.labels import MISSING, ORD, bin_labels
from facetry.operators import binning, cross, frame, legacy, reports, scores
from facetry.plans import analysis
from facetry.sources.tables import parquet

QTY, DISCOUNT, TAX, PRICE, BALANCE, CHARS = (10, 20, 30, 40), (0.03, 0.07), (0.02, 0.05), (100000, 200000), (0, 2500.5, 5000), (500, 1500, 3000)


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(f.name, 6) + 0.0).alias(f.name) if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema])


def li(spark: SparkSession, sf: str) -> DataFrame:
    return parquet(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_linestatus", "l_shipdate", F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_quantity")).alias("qty_null"), (F.col("l_returnflag") == "R").cast("int").alias("y"))


def oc(spark: SparkSession, sf: str) -> DataFrame:
    o, c = parquet(spark, sf, "orders"), parquet(spark, sf, "customer")
    j = o.join(c, o["o_custkey"] == c["c_custkey"])
    return j.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "c_mktsegment", "o_totalprice", "c_acctbal", F.year("o_orderdate").alias("year"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))


def dl(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = parquet(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), parquet(spark, sf, "labels")
    return d.join(lab, "doc_id").select("lang", "source", "n_chars", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("y"))


FRAMES = {
    "li": "li as (select l_quantity, l_discount, l_tax, l_linenumber, l_linestatus, l_shipdate, case when l_linenumber = 7 then null else l_quantity end as qty_null, (l_returnflag = 'R')::int as y from lineitem)",
    "oc": "oc as (select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, c_mktsegment, o_totalprice, c_acctbal, year(o_orderdate)::int as year, (o_orderstatus = 'F')::int as y from orders join customer on o_custkey = c_custkey)",
    "dl": "dl as (select lang, source, n_chars, quality::int as quality, toxic::int as y from documents join labels using (doc_id))",
}


def bin_sql(c: str, cuts: Sequence[float]) -> tuple[str, str]:
    """Label and place of a column in fixed bins."""
    labels = bin_labels(cuts)
    arms = "".join(f" when {c} <= {x}::double then '{lab}'" for x, lab in zip(cuts, labels, strict=False))
    places = "".join(f" when {c} <= {x}::double then {i}" for i, x in enumerate(cuts, 1))
    return f"case when {c} is null then '{MISSING}'{arms} else '{labels[-1]}' end", f"case when {c} is null then 0{places} else {len(cuts) + 1} end"


#: Variables of the report frames: cuts, or None for unbinned ones.
LI_VARS: dict[str, tuple | None] = {"l_discount": DISCOUNT, "l_linenumber": None, "l_linestatus": None, "l_quantity": QTY}
OC_VARS: dict[str, tuple | None] = {"c_acctbal": BALANCE, "c_mktsegment": None, "o_orderpriority": None}
NUMBERS = {"l_linenumber"}


def prepared(df: DataFrame, variables: dict[str, tuple | None], keep: Sequence[str] = ("y",)) -> DataFrame:
    spec = {c: binning.Binning(cutoffs=tuple(x)) for c, x in variables.items() if x}
    cuts = {c: list(b.cutoffs) for c, b in spec.items()}
    rest = [c for c in variables if c not in spec]
    ranks = {c + ORD: F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(F.lit(1.0) + (F.col(c).cast("double") if frame.numeric(df, c) else F.lit(0.0))) for c in rest}
    return binning.binned(frame.text_values(df.select(*variables, *keep).withColumns(ranks), rest), cuts)


def base_sql(name: str, variables: dict[str, tuple | None], keep: str = "y") -> str:
    cols = []
    for c, cuts in variables.items():
        lab, place = bin_sql(c, cuts) if cuts else (f"coalesce({c}::varchar, '{MISSING}')", f"case when {c} is null then 0 else 1 + {c if c in NUMBERS else 0} end")
        cols += [f"{lab} as {c}", f"({place})::double as {c}__ord"]
    return f"with {FRAMES[name]}, b as (select {', '.join(cols)}, {keep} from {name})"


IV_COLUMNS = "var_name, row_number() over (partition by var_name order by ord, \"group\")::int as group_number, \"group\", n as count, t as target, round(100 * n::double / nn, 6) as population, round(100 * t::double / tt, 6) as target_population, round(100 * t::double / n, 6) as target_rate, round(woe, 6) as woe, round(giv, 6) as group_iv, round(sum(abs(giv)) over (partition by var_name), 6) as total_iv"


def iv_sql(base: str, names: Sequence[str]) -> str:
    cells = " union all ".join(f"select '{c}' as var_name, {c} as \"group\", {c}__ord as ord, count(*)::bigint as n, sum(y)::bigint as t from b group by all" for c in names)
    return f"""{base}, g as ({cells}),
s as (select *, sum(n) over (partition by var_name)::double as nn, sum(t) over (partition by var_name)::double as tt from g),
p as (select *, case when t = 0 then 1 / tt else t / tt end as pt, case when n = t then 1 / (nn - tt) else (n - t) / (nn - tt) end as pn from s),
w as (select *, ln(pt / pn) as woe, 100 * abs(pt - pn) * ln(pt / pn) as giv from p)
select {IV_COLUMNS} from w"""


def seg_sql(names: Sequence[str], low: int, high: int, sums: str, extra: str = "", source: str = "b", most: int | None = None) -> str:
    most = most or high
    out = []
    for k in range(low, high + 1):
        for c in combinations(sorted(names), k):
            cols = ", ".join(f"'{c[i]}' as var{i + 1}_name, {c[i]} as var{i + 1}_value" if i < k else f"null::varchar as var{i + 1}_name, null::varchar as var{i + 1}_value" for i in range(most))
            out.append(f"select {cols}, {extra + ',' if extra else ''} {sums} from {source} group by all")
    return " union all ".join(out)


def keys(n: int, alias: str = "") -> str:
    return ", ".join(f"{alias}var{i}_{x}" for i in range(1, n + 1) for x in ("name", "value"))


def concentration_sql(base: str, names: Sequence[str], low: int, high: int, where: str = "true", columns: str | None = None) -> str:
    """All combinations as grouping sets of one scan; parents meet their children by equality of whole segments."""
    names = sorted(names)
    sets = ", ".join(f"({', '.join(c)})" for k in range(max(1, low - 1), high + 1) for c in combinations(names, k))
    seg = ", ".join(f"case when grouping({c}) = 0 then {{'name': '{c}', 'value': {c}::varchar}} end" for c in names)
    cells = ", ".join(f"seg[{i}].name as var{i}_name, seg[{i}].value as var{i}_value" for i in range(1, high + 1))
    stats = "count, round(population, 6) as population, target, round(target_rate, 6) as target_rate, round(target_population, 6) as target_population, round(group_iv, 6) as group_iv"
    extra = "'- ' || lo as parent_min, round(lo_rate, 6) as parent_min_tr, '- ' || hi as parent_max, round(hi_rate, 6) as parent_max_tr"
    return f"""{base}, g as materialized (select list_filter([{seg}], lambda x: x is not null) as seg, count(y)::bigint as count, coalesce(sum(y), 0)::bigint as target from b group by grouping sets ({sets})),
z as materialized (select count(y)::double as nn, sum(y)::double as tt from b),
s as materialized (select seg, count, target, 100 * count / nn as population, 100 * target / nullif(count, 0)::double as target_rate, 100 * target / tt as target_population,
  100 * abs(target / tt - (count - target) / nullif(nn - tt, 0)) * ln((case when target = 0 then 1 / tt else target / tt end) / (case when count = target then 1 / nullif(nn - tt, 0) else (count - target) / nullif(nn - tt, 0) end)) as group_iv from g, z),
u as materialized (select seg, i, seg[i].name as gone, list_concat(seg[:i - 1], seg[i + 1:]) as parent from (select seg, unnest(range(1, len(seg) + 1)) as i from s where len(seg) > 1)),
q as materialized (select u.seg as child, arg_min(gone, (p.target_rate, -i)) as lo, min(p.target_rate) as lo_rate, arg_max(gone, (p.target_rate, i)) as hi, max(p.target_rate) as hi_rate from u join s p on p.seg = u.parent group by u.seg),
r as materialized (select {cells}, s.*, lo, lo_rate, hi, hi_rate from s left join q on s.seg = q.child)
select {columns or f'{keys(high, "r.")}, {stats}, {extra}'} from r where r.var{low}_name is not null and ({where})"""


def stability_sql(base: str, names: Sequence[str], low: int, high: int, split: str, main: str = "true", target: bool = True) -> str:
    t = target
    sums = f"count(*)::bigint as n, count(*) filter ({main})::bigint as mn" + (f", sum(y)::bigint as t, coalesce(sum(y) filter ({main}), 0)::bigint as mt" if t else "")
    same = " and ".join(f"m.{k.strip()} is not distinct from o.{k.strip()}" for k in keys(high).split(","))
    e = lambda x: f"(case when {x} = 0 then 1e-6::double else {x} end)"
    shift = lambda a, b: f"round(({b} - {a}) * abs(ln({e(b)} / {e(a)})), 6)"
    pct = lambda a, b: f"coalesce(100 * {a}::double / nullif({b}, 0), 0)"
    rate = lambda a, n: f"round(100 * {a}::double / {e(n + '::double')}, 6)"
    out = ["mn as count_main", "n as count_secondary"] + (["mt as target_main", "t as target_secondary"] if t else []) + ["round(pm, 6) as population_main", "round(ps, 6) as population_secondary"]
    out += [f"{rate('mt', 'mn')} as target_rate_main", f"{rate('t', 'n')} as target_rate_secondary", "round(tm, 6) as target_population_main", "round(ts, 6) as target_population_secondary"] if t else []
    out += [f"{shift('pm', 'ps')} as population_stability"] + ([f"{shift('tm', 'ts')} as target_stability"] if t else [])
    return f"""{base}, g as ({seg_sql(names, low, high, sums, split)}),
m as (select {keys(high)}, sum(mn)::bigint as mn {', sum(mt)::bigint as mt' if t else ''} from g group by all),
d as (select {split}, count(*)::double as an {', sum(y)::double as "at"' if t else ''} from b where {split} is not null group by all),
z as (select count(*) filter ({main})::double as amn {f', coalesce(sum(y) filter ({main}), 0)::double as amt' if t else ''} from b),
f as (select d.{split}, {keys(high, 'm.')}, m.mn, coalesce(o.n, 0) as n {', m.mt, coalesce(o.t, 0) as t' if t else ''}, {pct('m.mn', 'amn')} as pm, {pct('coalesce(o.n, 0)', 'an')} as ps {f", {pct('m.mt', 'amt')} as tm, {pct('coalesce(o.t, 0)', chr(34) + 'at' + chr(34))} as ts" if t else ''} from m cross join d cross join z left join g o on {same} and d.{split} = o.{split}),
stab as (select {split}, {keys(high)}, {', '.join(out)} from f)"""


def greedy_sql(name: str, names: Sequence[str], min_prc: int, digits: int = 0) -> str:
    """The fold as a recursive query over each variable's values."""
    cells = " union all ".join(f"select '{c}' as variable, {c}::double as value, count(*)::bigint as n from {name} group by all" for c in names)
    return f"""with recursive {FRAMES[name]}, h as ({cells}),
tot as (select variable, sum(n)::double as total, coalesce(sum(n) filter (value is not null), 0)::double as known, max(n)::double as top, count(value) as k, bool_and(value % 1 = 0) as whole from h group by variable),
v as (select h.variable, value, 100 * n / total as p, row_number() over (partition by h.variable order by value) as i from h join tot using (variable) where value is not null),
fold(variable, i, cuts, last, acc) as (
  select variable, 0::bigint, []::double[], null::double, 0::double from tot
  union all
  select f.variable, v.i,
    case when round_even(p, {digits}) < {min_prc} then case when round_even(acc + p, {digits}) >= {min_prc} then list_append(cuts, value) else cuts end
         else list_append(case when acc >= {0.8 * min_prc} then list_append(cuts, last) else cuts end, value) end,
    case when round_even(p, {digits}) < {min_prc} then value else last end,
    case when round_even(p, {digits}) < {min_prc} then case when round_even(acc + p, {digits}) >= {min_prc} then 0 else acc + p end else 0 end
  from fold f join v on v.variable = f.variable and v.i = f.i + 1),
fin as (select variable, arg_max(cuts, i) as cuts, arg_max(last, i) as last, arg_max(acc, i) as acc from fold group by variable),
ended as (select variable, case when acc >= {0.8 * min_prc} then list_append(cuts, last) else cuts end as c from fin),
cutoffs as (select variable, case when 100 * known / total < {min_prc} or 100 * top / total >= {100 - min_prc} or k <= 1 then []::double[] else list_sort(list_distinct(list_transform(c[1:len(c) - 1], lambda x: case when whole and {digits} = 0 then trunc(x) else x end))) end as cutoffs from ended join tot using (variable))"""


def tree_sql(name: str, names: Sequence[str], min_prc: float) -> str:
    """The tree as a recursive query over runs of each variable's values: a run is split where its parts are purest."""
    cells = " union all ".join(f"select '{c}' as variable, {c}::double as value, count(*)::bigint as n, sum(y)::bigint as t from {name} group by all" for c in names)
    sums = lambda x: f"(x.{x} - lo.{x}), (hi.{x} - x.{x})"
    part = lambda n, t: f"({t} * {t} + ({n} - {t}) * ({n} - {t})) / {n}"
    (ln, rn), (lt, rt) = (sums(x).split(", ") for x in ("cn", "ct"))
    return f"""with recursive {FRAMES[name]}, h as ({cells}),
tot as (select variable, round_even({min_prc}::double * sum(n) / 100, 0) as least, count(value) as k, 100 * coalesce(sum(n) filter (value is not null), 0)::double / sum(n) < {min_prc} or 100 * max(n)::double / sum(n) >= {100 - min_prc} or count(value) <= 1 as bare from h group by variable),
v as (select variable, value::float::double as v, row_number() over w as i, (sum(n) over w)::double as cn, (sum(t) over w)::double as ct from h where value is not null window w as (partition by variable order by value)),
c as (select variable, i, cn, ct from v union all select variable, 0, 0, 0 from tot),
node(variable, a, b) as (
  select variable, 0::bigint, k from tot where not bare
  union all
  select variable, unnest([a, i]), unnest([i, b]) from (
    select d.variable, d.a, d.b, arg_max(x.i, ({part(ln, lt)} + {part(rn, rt)}, -x.i)) as i
    from node d join tot using (variable) join c lo on lo.variable = d.variable and lo.i = d.a join c hi on hi.variable = d.variable and hi.i = d.b join c x on x.variable = d.variable and x.i > d.a and x.i < d.b
    where hi.ct - lo.ct > 0 and hi.ct - lo.ct < hi.cn - lo.cn and {ln} >= least and {rn} >= least
    group by d.variable, d.a, d.b)),
ends as (select variable, min(v) as low, max(v) as high from v group by variable),
found as (select distinct d.variable, (l.v / 2 + r.v / 2)::float::double as cut from node d join v l on l.variable = d.variable and l.i = d.b join v r on r.variable = d.variable and r.i = d.b + 1),
cuts as (select tot.variable, coalesce(list(cut order by cut) filter (cut > low and cut < high), []::double[]) as cutoffs from tot left join found using (variable) left join ends using (variable) group by tot.variable)"""


def tree_base_sql(name: str, names: Sequence[str], min_prc: float) -> str:
    """Labels and places of variables in the tree's bins."""
    cols = []
    for c in names:
        cut = f"(select cutoffs from cuts where variable = '{c}')"
        place = f"case when {c} is null then 0 else 1 + len(list_filter({cut}, lambda x: x < {c})) end"
        cols.append(f"{place} as {c}__place, {cut} as {c}__cuts")
    label = lambda c: f"case when {c}__place = 0 then '{MISSING}' when len({c}__cuts) = 0 then '__NOT_MISSING__' when {c}__place = 1 then '<= ' || {c}__cuts[1]::varchar when {c}__place > len({c}__cuts) then '> ' || {c}__cuts[-1]::varchar else '(' || {c}__cuts[{c}__place - 1]::varchar || '; ' || {c}__cuts[{c}__place]::varchar || ']' end as {c}, {c}__place::double as {c}__ord"
    return f"{tree_sql(name, names, min_prc)}, placed as (select {', '.join(cols)}, y from {name}), b as (select {', '.join(label(c) for c in names)}, y from placed)"


def legacy_sql(name: str, names: Sequence[str], min_size: float = 5.0, digits: int = 2) -> str:
    """The older cutoffs: groups by running share, each small one joined to a neighbour, from left to right."""
    cells = " union all ".join(f"select '{c}' as variable, {c}::double as value, count(*)::bigint as n from {name} group by all" for c in names)
    small = f"round_even(s.prc, 0) < {min_size} and s.m > 1"
    left = "(s.i = s.m or (s.i > 1 and s.before < s.after))"
    return f"""with recursive {FRAMES[name]}, h as ({cells}),
tot as (select variable, sum(n)::double as total from h group by variable),
r as (select variable, round_even(value, {digits}) as value, sum(n)::double as n from h where value is not null group by 1, 2),
p as (select variable, value, 100.0 * n / total as prc, floor(100.0 * (sum(n) over (partition by variable order by value)) / total / {min_size}) as g from r join tot using (variable)),
q as (select variable, g - case when prc > {min_size} then 0.5 else 0 end as grp, sum(prc) as prc, max(value) as value from p group by all),
s as (select *, row_number() over w as i, count(*) over (partition by variable) as m, lag(prc) over w as before, lead(prc) over w as after, lead(grp) over w as next from q window w as (partition by variable order by grp)),
fold(variable, i, key) as (
  select variable, 1::bigint, case when {small} and not {left} then next else grp end::double from s where i = 1
  union all
  select s.variable, s.i, case when {small} then case when {left} then f.key else s.next end else s.grp end::double from fold f join s on s.variable = f.variable and s.i = f.i + 1),
tops as (select variable, key, max(value) as value from fold join s using (variable, i) group by all),
ends as (select *, row_number() over (partition by variable order by key desc) as from_end from tops)"""


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        Q[name] = lambda spark, sf: r6(f(spark, sf))
        if sql:
            SQL[name] = sql.replace(", 6)", ", 6) + 0.0::double")  # no negative zeros, as in r6
        return f

    return put


LI = f"with {FRAMES['li']}"
OC = f"with {FRAMES['oc']}"
NUM = ["l_quantity", "l_discount", "l_tax", "qty_null"]

query("scan_parquet", "select count(*)::bigint as n, sum(l_linenumber)::bigint as total from lineitem")(lambda s, d: parquet(s, d, "lineitem").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("total")))
query("project_columns", f"{LI} select l_linestatus, l_linenumber from li")(lambda s, d: frame.project(li(s, d), ["l_linestatus", "l_linenumber"]))
query("union_diagonal", f"{LI} select l_linestatus, l_linenumber, null::double as l_tax from li union all select null, l_linenumber, l_tax from li")(lambda s, d: frame.union_by_name([li(s, d).select("l_linestatus", "l_linenumber"), li(s, d).select("l_linenumber", "l_tax")]))
query("filter_missing", f"{LI} select qty_null, l_tax from li where qty_null is not null and l_tax is not null")(lambda s, d: frame.drop_missing(li(s, d).select("qty_null", "l_tax")))
query("fill_missing", f"{LI} select coalesce(qty_null, -1) as qty_null, l_linenumber from li")(lambda s, d: frame.fill_missing(li(s, d).select("qty_null", "l_linenumber"), {"qty_null": -1.0}))
query("count_missing", f"{LI} select 'qty_null' as variable, count(*) filter (qty_null is null)::bigint as n_missing from li union all select 'l_tax', count(*) filter (l_tax is null)::bigint from li")(lambda s, d: frame.count_missing(li(s, d), ["qty_null", "l_tax"]))
query("map_values", f"{LI} select case l_linestatus when 'O' then 'open' else l_linestatus end as l_linestatus, case l_linenumber when 1 then 100 when 2 then 200 else l_linenumber end::bigint as l_linenumber from li")(lambda s, d: frame.map_values(li(s, d).select("l_linestatus", "l_linenumber"), {"l_linestatus": {"O": "open"}, "l_linenumber": {1: 100, 2: 200}}))
query("profile_columns", f"{LI} " + " union all ".join(f"select '{c}' as variable, count(*)::bigint as n, count(*) filter ({c} is null)::bigint as n_missing, round(min({c}), 6)::double as minimum, round(max({c}), 6)::double as maximum, coalesce(bool_and({c} % 1 = 0), true) as whole from li" for c in NUM))(lambda s, d: frame.profile(li(s, d), NUM))
query("nunique", f"{LI} " + " union all ".join(f"select '{c}' as variable, count(distinct {c})::bigint as n_unique, count(*) > count({c}) as has_null from li" for c in [*NUM, "l_linestatus"]))(lambda s, d: frame.nunique(li(s, d), [*NUM, "l_linestatus"]))
query("value_counts", f"{LI} select qty_null as value, count(*)::bigint as count, round(100 * count(*)::double / sum(count(*)) over (), 6) as percent from li group by all")(lambda s, d: frame.value_counts(li(s, d), "qty_null"))
query("binary_columns", "select unnest(['quality', 'y']) as variable")(lambda s, d: frame.binary_columns(dl(s, d)))
query("validate_binary_target", f"{LI} select true as valid, count(*)::bigint as n, sum(y)::bigint as n_target from li")(lambda s, d: frame.target_report(li(s, d), "y"))
query("cardinality_guard", "select variable, n_unique from (select 'user_id' as variable, count(distinct user_id)::bigint as n_unique from events union all select 'event_type', count(distinct event_type)::bigint from events union all select 'value', count(distinct value)::bigint from events) where n_unique <= 100")(lambda s, d: frame.within_cardinality(parquet(s, d, "events"), ["user_id", "event_type", "value"], 100))


def fixed(s: SparkSession, d: str) -> DataFrame:
    return binning.binned(oc(s, d).select("o_orderkey", "c_acctbal"), {"c_acctbal": BALANCE}).withColumnRenamed("c_acctbal" + ORD, "place")


query("binarize_fixed", f"{OC} select o_orderkey, {bin_sql('c_acctbal', BALANCE)[0]} as c_acctbal, ({bin_sql('c_acctbal', BALANCE)[1]})::int as place from oc")(fixed)
query("group_stats", f"{base_sql('oc', {'c_acctbal': BALANCE})} select row_number() over (order by c_acctbal__ord)::int as group_number, c_acctbal as \"group\", count(*)::bigint as total, round(100 * count(*)::double / sum(count(*)) over (), 6) as population from b group by c_acctbal, c_acctbal__ord")(lambda s, d: reports.group_stats(prepared(oc(s, d), {"c_acctbal": BALANCE}), "c_acctbal"))
query("iv_var", iv_sql(base_sql("li", {"l_quantity": QTY}), ["l_quantity"]))(lambda s, d: reports.iv_report(prepared(li(s, d), {"l_quantity": QTY}), ["l_quantity"], "y"))
query("iv_report", iv_sql(base_sql("li", LI_VARS), list(LI_VARS)))(lambda s, d: reports.iv_report(prepared(li(s, d), LI_VARS), list(LI_VARS), "y"))
query("iv_report_short", f"select distinct var_name, total_iv from ({iv_sql(base_sql('li', LI_VARS), list(LI_VARS))})")(lambda s, d: reports.iv_short(r6(reports.iv_report(prepared(li(s, d), LI_VARS), list(LI_VARS), "y"))))
query("var_stat", f"select * exclude (group_number) from ({iv_sql(base_sql('dl', {'source': None}), ['source'])})")(lambda s, d: reports.iv_report(prepared(dl(s, d), {"source": None}), ["source"], "y").drop("group_number"))


def exploded(df: DataFrame) -> DataFrame:
    return df.select("variable", F.explode("cutoffs").alias("cutoff"))


query("cutoffs_unsupervised", f"{greedy_sql('li', ['l_quantity', 'l_discount'], 15)} select variable, round(unnest(cutoffs), 6) as cutoff from cutoffs")(lambda s, d: exploded(binning.greedy_cutoffs(li(s, d), ["l_quantity", "l_discount"])))
query("all_vars_cutoffs", f"{greedy_sql('li', NUM, 20)} select variable, round(unnest(cutoffs), 6) as cutoff from cutoffs")(lambda s, d: exploded(binning.greedy_cutoffs(li(s, d), NUM, 20)))
query("cutoffs_supervised", f"{tree_sql('li', NUM, 10)} select variable, round(unnest(cutoffs), 6) as cutoff from cuts")(lambda s, d: exploded(binning.tree_cutoffs(li(s, d), NUM, "y", 10.0)))


def auto(s: SparkSession, d: str) -> DataFrame:
    df = binning.prepared(li(s, d), ["qty_null"], None, None, {"qty_null": binning.Binning(20.0)})
    return df.groupBy(F.col("qty_null" + ORD).alias("place")).agg(F.count("*").alias("n"))


query("binarize_auto", f"{greedy_sql('li', ['qty_null'], 20)} select case when qty_null is null then 0 else 1 + len(list_filter(c.cutoffs, lambda x: x < qty_null)) end::int as place, count(*)::bigint as n from li, cutoffs c group by 1")(auto)


def prep(s: SparkSession, d: str) -> DataFrame:
    df = li(s, d).withColumn("st", F.when(F.col("l_linenumber") > 5, None).otherwise(F.col("l_linestatus")))
    out = binning.prepared(df, ["st", "l_quantity"], "y", {"st": {MISSING: "none"}}, {"l_quantity": binning.Binning(cutoffs=QTY)})
    return out.groupBy("st", "l_quantity", "l_quantity" + ORD).agg(F.count("*").alias("n"), F.sum("y").alias("t")).withColumnRenamed("l_quantity" + ORD, "place")


query("preprocess", f"{LI} select coalesce(case when l_linenumber > 5 then null else l_linestatus end, 'none') as st, {bin_sql('l_quantity', QTY)[0]} as l_quantity, ({bin_sql('l_quantity', QTY)[1]})::int as place, count(*)::bigint as n, sum(y)::bigint as t from li group by all")(prep)

LIB, DLB = base_sql("li", LI_VARS), base_sql("dl", {"lang": None, "source": None, "n_chars": CHARS})
DL_VARS = {"lang": None, "source": None, "n_chars": CHARS}
for _k in (1, 2, 3):
    query(f"concentration_{_k}", concentration_sql(LIB, list(LI_VARS), 1, _k))(lambda s, d, k=_k: reports.concentration(prepared(li(s, d), LI_VARS), list(LI_VARS), "y", 1, k))
query("concentration_parents", concentration_sql(DLB, list(DL_VARS), 2, 2))(lambda s, d: reports.concentration(prepared(dl(s, d), DL_VARS), list(DL_VARS), "y", 2, 2))
query("concentration_filtered", concentration_sql(LIB, list(LI_VARS), 1, 2, "round(population, 6) >= 2 and (round(target_rate, 6) <= 33 or round(target_rate, 6) >= 34)"))(lambda s, d: reports.concentration(prepared(li(s, d), LI_VARS), list(LI_VARS), "y", 1, 2, 2.0, 33.0, 34.0))
_inside = "(case when r.var1_name = 'l_linestatus' then r.var1_value when r.var2_name = 'l_linestatus' then r.var2_value when r.var3_name = 'l_linestatus' then r.var3_value end) = 'O'"
query("segment_subsegments", concentration_sql(LIB, list(LI_VARS), 1, 3, _inside))(lambda s, d: reports.sub_segments(reports.concentration(prepared(li(s, d), LI_VARS), list(LI_VARS), "y", 1, 3), 3, {"l_linestatus": "O"}))
_name = "'(' || r.var1_name || ' = \"' || r.var1_value || '\")' || coalesce(' & (' || r.var2_name || ' = \"' || r.var2_value || '\")', '')"
query("segment_names", concentration_sql(LIB, list(LI_VARS), 1, 2, columns=f"{_name} as segment, count"))(lambda s, d: reports.named(reports.concentration(prepared(li(s, d), LI_VARS), list(LI_VARS), "y", 1, 2), 2).select("segment", "count"))
_made = "(r.var1_name, r.var1_value) in (('l_linestatus', 'O'), ('l_discount', '<= 0.03')) and (r.var2_name is null or (r.var2_name, r.var2_value) in (('l_linestatus', 'O'), ('l_discount', '<= 0.03'))) and r.var3_name is null"
query("segment_made_of", concentration_sql(LIB, list(LI_VARS), 1, 3, _made, "r.var1_name, r.var1_value, r.var2_name, r.var2_value, count, target"))(lambda s, d: reports.chosen_segments(reports.concentration(prepared(li(s, d), LI_VARS), list(LI_VARS), "y", 1, 3), 3, {"l_linestatus": "O", "l_discount": "<= 0.03"}).select("var1_name", "var1_value", "var2_name", "var2_value", "count", "target"))

OCB = base_sql("oc", OC_VARS, "y, year")
oc_prep = lambda s, d: prepared(oc(s, d), OC_VARS, ("y", "year"))
for _k in (1, 2):
    query(f"stability_{_k}", stability_sql(OCB, list(OC_VARS), 1, _k, "year") + " select * from stab")(lambda s, d, k=_k: reports.stability(oc_prep(s, d), "year", list(OC_VARS), 1, k, None, "y"))
query("stability_split_value", stability_sql(OCB, list(OC_VARS), 1, 1, "year", "year = 1996") + " select * from stab")(lambda s, d: reports.stability(oc_prep(s, d), "year", list(OC_VARS), 1, 1, 1996, "y"))
query("stability_no_target", stability_sql(OCB, list(OC_VARS), 1, 2, "year", target=False) + " select * from stab")(lambda s, d: reports.stability(oc_prep(s, d), "year", list(OC_VARS), 1, 2))
_same = " and ".join(f"a.{k.strip()} is not distinct from k.{k.strip()}" for k in keys(2).split(","))
query("stability_filtered", stability_sql(OCB, list(OC_VARS), 1, 2, "year") + f", k as (select distinct {keys(2)} from stab where population_secondary > 5 and population_stability between -0.001 and 0.001) select a.* from stab a where exists (select 1 from k where {_same})")(lambda s, d: reports.stable_segments(r6(reports.stability(oc_prep(s, d), "year", list(OC_VARS), 1, 2, None, "y")), 2, 0.05, 0.001))


def dense(s: SparkSession, d: str) -> DataFrame:
    df = oc(s, d).select("year", "o_orderstatus", "o_orderpriority")
    grid = df.select("year").distinct().crossJoin(df.select("o_orderpriority").distinct())
    n = df.where("o_orderstatus = 'P'").groupBy("year", "o_orderpriority").agg(F.count("*").alias("n"))
    return grid.join(n, ["year", "o_orderpriority"], "left").na.fill(0, ["n"])


query("join_densify", f"{OC} select a.year, b.o_orderpriority, count(oc.o_orderkey)::bigint as n from (select distinct year from oc) a cross join (select distinct o_orderpriority from oc) b left join oc on oc.year = a.year and oc.o_orderpriority = b.o_orderpriority and oc.o_orderstatus = 'P' group by all")(dense)


def ordered(s: SparkSession, d: str) -> DataFrame:
    one = reports.concentration(prepared(oc(s, d), {"c_acctbal": BALANCE}), ["c_acctbal"], "y")
    return cross.category_order(one.select("var1_value", "target_rate"), "var1_value", "target_rate")


query("category_order", f"select var1_value, target_rate, row_number() over (order by ord)::int as place from ({base_sql('oc', {'c_acctbal': BALANCE})} select c_acctbal as var1_value, c_acctbal__ord as ord, round(100 * sum(y)::double / count(*), 6) as target_rate from b group by all)")(ordered)
_years = list(range(1995, 2002))
query("cross_pivot", f"{OC} select o_orderpriority, " + ", ".join(f"round(100 * sum(y) filter (year = {x})::double / nullif(count(*) filter (year = {x}), 0), 6) as y{x}" for x in _years) + " from oc group by all")(lambda s, d: cross.pivoted(oc(s, d).groupBy("o_orderpriority", F.concat(F.lit("y"), "year").alias("year")).agg((100 * reports.ratio(F.sum("y"), F.count("*"))).alias("rate")), "o_orderpriority", "year", "rate", [f"y{x}" for x in _years]))
_two = {"c_mktsegment": None, "o_orderpriority": None}
_cross = concentration_sql(base_sql("oc", _two), list(_two), 1, 2)
_near = "where (var2_name is not null and population >= 4) or (var2_name is null and exists (select 1 from c p where p.var2_name is not null and p.population >= 4 and ((c.var1_name = p.var1_name and c.var1_value = p.var1_value) or (c.var1_name = p.var2_name and c.var1_value = p.var2_value))))"
query("cross_vars", f"with c as ({_cross}) select * from c {_near}")(lambda s, d: cross.cross_report(prepared(oc(s, d), _two), "c_mktsegment", "o_orderpriority", "y", 4.0))
query("cross_vars_no_target", f"with c as ({_cross}) select var1_name, var1_value, var2_name, var2_value, count, population from c {_near}")(lambda s, d: cross.cross_report(prepared(oc(s, d), _two), "c_mktsegment", "o_orderpriority", None, 4.0))
_pred = {"rich": "o_totalprice > 200000", "urgent": "o_orderpriority = '1-URGENT'", "autos": "c_mktsegment = 'AUTOMOBILE'"}
query("venn_regions", f"{OC}, p as (select {', '.join(f'({v}) as {k}' for k, v in _pred.items())}, y from oc), m as (select {', '.join(f'(i >> {k}) & 1 = 1 as {c}' for k, c in enumerate(_pred))} from range(1, 8) t(i)) select m.*, count(y)::bigint as n, round(100 * count(y)::double / (select count(*) from oc), 6) as population, coalesce(sum(y), 0)::bigint as target, round(100 * sum(y)::double / nullif(count(y), 0), 6) as target_rate from m left join p using ({', '.join(_pred)}) group by {', '.join(f'm.{k}' for k in _pred)}")(lambda s, d: cross.regions(oc(s, d), {k: F.expr(v) for k, v in _pred.items()}, "y"))
query("upset_intersections", "with k as (select o_custkey, bit_or(case o_orderstatus when 'F' then 1 when 'O' then 2 else 4 end)::bigint as mask from orders group by 1), m as (select i::bigint as mask from range(1, 8) t(i)) select m.mask, bit_count(m.mask)::int as degree, count(k.mask)::bigint as size from m left join k using (mask) group by m.mask")(lambda s, d: cross.intersections({x: parquet(s, d, "orders").where(F.col("o_orderstatus") == x).select("o_custkey") for x in ("F", "O", "P")}, ["o_custkey"]))
query("legacy_cross", f"{OC}, g as (select o_orderpriority, c_mktsegment, count(*)::bigint as size, round(100 * avg(y), 6) as value, round(100 * count(*)::double / sum(count(*)) over (), 6) as population from oc group by 1, 2) select * from g where population >= 4")(lambda s, d: cross.legacy_cross(oc(s, d), "o_orderpriority", "c_mktsegment", "y", show_min=4.0))


def cramer_sql(name: str, a: str, b: str, corrected: bool = True) -> str:
    v = "sqrt(greatest(0, chi2 / n - (k - 1) * (r - 1) / (n - 1)) / (least(r - (r - 1) * (r - 1) / (n - 1), k - (k - 1) * (k - 1) / (n - 1)) - 1))" if corrected else "sqrt(chi2 / n / (least(r, k) - 1))"
    return f"(with g as (select {a} as a, {b} as b, count(*)::double as o from {name} group by 1, 2), m as (select *, sum(o) over (partition by a) * sum(o) over (partition by b) / sum(o) over () as e, sum(o) over () as n from g), s as (select count(distinct a)::double as r, count(distinct b)::double as k, max(n) as n, sum(o * o / e) - max(n) as x, sum(greatest(abs(o - e) - 0.5, 0) * greatest(abs(o - e) - 0.5, 0) / e) as yates from m), c as (select *, case when r = 2 and k = 2 then yates else x end as chi2 from s) select {v} from c)"


query("cramers_v", f"{OC} select round({cramer_sql('oc', 'o_orderpriority', 'o_orderstatus')}, 6) as v union all select round({cramer_sql('oc', 'c_mktsegment', 'o_orderstatus', False)}, 6)")(lambda s, d: scores.cramers_v(oc(s, d), "o_orderpriority", "o_orderstatus").union(scores.cramers_v(oc(s, d), "c_mktsegment", "o_orderstatus", False)))
_c3 = ["l_quantity", "l_discount", "l_tax"]


def corr_sql(source: str, names: Sequence[str]) -> str:
    return " union all ".join(f"select '{a}' as a, '{b}' as b, {'1.0::double' if a == b else f'corr({a}, {b})'} as corr from {source}" if a != b else f"select '{a}' as a, '{b}' as b, 1.0::double as corr" for a in names for b in names)


_ranks = "rk as (select " + ", ".join(f"(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double)::double as {c}" for c in _c3) + " from li)"
query("corr_pearson", f"{LI} select a, b, round(corr, 6) as corr from ({corr_sql('li', _c3)})")(lambda s, d: scores.correlations(li(s, d), _c3))
query("corr_spearman", f"{LI}, {_ranks} select a, b, round(corr, 6) as corr from ({corr_sql('rk', _c3)})")(lambda s, d: scores.spearman(li(s, d), _c3))
_oc3 = ["c_mktsegment", "o_orderpriority", "o_orderstatus"]
query("corr_cramer", f"{OC} " + " union all ".join(f"select '{a}' as a, '{b}' as b, round({cramer_sql('oc', min(a, b), max(a, b)) if a != b else '1.0::double'}, 6) as corr" for a in _oc3 for b in _oc3))(lambda s, d: scores.cramer_matrix(oc(s, d), _oc3))
query("corr_top", f"{LI}, c as ({corr_sql('li', _c3)}) select a, round(max(abs(corr)), 6) as abs_max, round(avg(abs(corr)), 6) as mean, round(median(abs(corr)), 6) as median, arg_max(b, abs(corr)) as best from c where a <> b group by a")(lambda s, d: scores.top_correlations(scores.correlations(li(s, d), _c3), 1).withColumn("best", F.col("top")[0]).drop("top"))
query("legacy_var_stat", f"{base_sql('oc', OC_VARS)}, g as (" + " union all ".join(f"select '{c}' as var_name, {c} as \"group\", count(*)::bigint as n, sum(y)::bigint as t from b group by 2" for c in OC_VARS) + "), s as (select *, t / (sum(t) over (partition by var_name))::double as pt, (n - t) / (sum(n - t) over (partition by var_name))::double as pn from g), w as (select *, case when pt > 0 and pn > 0 then ln(pt / pn) end as woe from s) select var_name, \"group\", n as count, t as target, round(100 * t::double / n, 6) as target_rate, round(woe, 6) as woe, round(100 * (pt - pn) * woe, 6) as group_iv, round(sum(100 * (pt - pn) * woe) over (partition by var_name), 6) as total_iv from w")(lambda s, d: reports.legacy_iv(prepared(oc(s, d), OC_VARS), list(OC_VARS), "y"))
query("legacy_cutoffs", f"{legacy_sql('li', NUM)} select variable, round(value, 6) as cutoff from ends where from_end > 1")(lambda s, d: exploded(legacy.legacy_cutoffs(li(s, d), NUM)))


def scored(s: SparkSession, d: str) -> DataFrame:
    return li(s, d).select((F.col("l_quantity") / 50).alias("p"), "y")


_steps = f"{LI}, st as (select l_quantity / 50 as score, count(*)::double as n, sum(y)::double as t from li group by 1), cu as (select *, sum(n) over (order by score desc) as cn, sum(t) over (order by score desc) as ct, sum(n) over () as nn, sum(t) over () as tt from st)"
query("roc_auc", f"{_steps}, a as (select sum((n - t) * (ct - t / 2)) / (max(tt) * (max(nn) - max(tt))) as auc from cu) select round(auc, 6) as auc, round(2 * auc - 1, 6) as gini from a")(lambda s, d: scores.roc_auc(scored(s, d), "p", "y"))
query("pr_curve", f"{_steps} select round(score, 6) as threshold, round(ct / cn, 6) as precision, round(ct / tt, 6) as recall from cu")(lambda s, d: scores.pr_curve(scored(s, d), "p", "y"))
query("lift", f"{_steps} select round(score, 6) as score, round(cn / nn, 6) as share_all, round(ct / tt, 6) as share_target from cu")(lambda s, d: scores.lift(scored(s, d), "p", "y"))
_edges = [0.0, 0.25, 0.5, 0.75, 1.0, 1.25]
query("calibration", f"{LI}, e as (select i::int as bin, i * 0.25::double as low, (i + 1) * 0.25::double as high from range(0, 5) t(i)), g as (select (ceil(l_quantity / 50 / 0.25::double) - 1)::int as bin, count(*)::bigint as count, round(avg(l_quantity / 50), 6) as predicted, round(avg(y), 6) as observed, round(100 * count(*)::double / sum(count(*)) over (), 6) as population from li group by 1) select e.bin, e.low, e.high, coalesce(count, 0) as count, predicted, observed, population from e left join g using (bin)")(lambda s, d: scores.calibration(scored(s, d), "p", "y", _edges))

_fixed = {"c_acctbal": binning.Binning(cutoffs=BALANCE)}
_wide = ["c_acctbal", "c_mktsegment", "o_orderkey", "o_orderpriority"]
query("concentration_guarded", concentration_sql(OCB, list(OC_VARS), 1, 2))(lambda s, d: analysis.concentrated(oc(s, d), "y", 1, 2, _wide, binning=_fixed))
query("stability_guarded", stability_sql(OCB, list(OC_VARS), 1, 1, "year") + " select * from stab")(lambda s, d: analysis.stable(oc(s, d), "year", names=_wide, target="y", binning=_fixed))
query("ranked_variables", f"select var_name, total_iv, rank() over (order by total_iv desc, var_name)::int as place from (select distinct var_name, total_iv from ({iv_sql(base_sql('oc', OC_VARS), list(OC_VARS))}))")(lambda s, d: frame.numbered(r6(analysis.information(oc(s, d), "y", list(OC_VARS), binning=_fixed)[0]), "total_iv", "place", ["var_name"], True))
query("iv_report_tree", iv_sql(tree_base_sql("li", NUM, 15), NUM))(lambda s, d: analysis.information(li(s, d), "y", NUM)[1])
query("eligible_columns", "select * from (select 'event_type' as variable, count(distinct event_type)::bigint as n_unique from events union all select 'value', count(distinct value)::bigint from events union all select 'props', count(distinct props)::bigint from events) where variable = 'value' or n_unique <= 20")(lambda s, d: analysis.eligible(parquet(s, d, "events"), ["event_type", "value", "props"]))
query("cross_radius", f"with c as ({_cross}), k as (select * from c {_near}) select *, round(case when var2_name is not null then population / (select max(population) from k where var2_name is not null) / 2 end, 6) as radius from k")(lambda s, d: cross.with_radius(r6(cross.cross_report(prepared(oc(s, d), _two), "c_mktsegment", "o_orderpriority", "y", 4.0))))
query("venn_totals", f"{OC}, p as (select {', '.join(f'({v}) as {k}' for k, v in _pred.items())}, y from oc) " + " union all ".join(f"select '{k}' as predicate, count(*) filter ({k})::bigint as n, round(100 * count(*) filter ({k})::double / count(*), 6) as population, coalesce(sum(y) filter ({k}), 0)::bigint as target, round(100 * sum(y) filter ({k})::double / nullif(count(*) filter ({k}), 0), 6) as target_rate from p" for k in _pred))(lambda s, d: cross.predicate_totals(oc(s, d), {k: F.expr(v) for k, v in _pred.items()}, "y"))
query("filter_values", f"{OC} select o_orderkey, o_orderstatus from oc where o_orderstatus not in ('F', 'P') or o_orderstatus is null")(lambda s, d: frame.without_values(oc(s, d).select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "P"]))
query("filter_any", f"{OC} select o_orderkey from oc where o_orderstatus = 'P' or c_mktsegment = 'BUILDING'")(lambda s, d: frame.any_of(oc(s, d), {"o_orderstatus": "P", "c_mktsegment": "BUILDING"}).select("o_orderkey"))
query("corr_kendall", f"{LI}, g as (select l_linenumber as x, y, count(*)::double as n from li group by 1, 2), p as (select sum(a.n * b.n * sign(b.x - a.x) * sign(b.y - a.y)) as s, sum(case when a.x <> b.x then a.n * b.n else 0 end) as dx, sum(case when a.y <> b.y then a.n * b.n else 0 end) as dy from g a cross join g b) select round(s / nullif(sqrt(dx * dy), 0), 6) as tau from p")(lambda s, d: scores.kendall(li(s, d), "l_linenumber", "y"))

QUERIES = Q
