"""Line dedup by distinct-site spread, with DataFrame functions only.

A line's spread is the number of distinct sites it stands on. HyperLogLog sketches of the sites, one a line
hash, merge in the aggregation; lines whose estimate lies near the threshold get an exact distinct count.
Lines spread over at least ``min_sites`` sites are boilerplate and go from every document that has another line.
A document all of whose lines are boilerplate repeats other documents whole; it stays as it is, marked ``copied``,
and which copy stays is for document deduplication to decide.

Texts are split and hashed once, into a table of one row of line hashes a document; everything else but the last
step works on hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import cut, fresh, read, table

#: Distinct sites that make a line boilerplate.
MIN_SITES = 5
#: log2 of a sketch's registers, and how many standard errors count as near the threshold.
LG_K, ERRORS = 8, 5
#: A hot line's rows are dealt over so many tasks.
SALTS = 16


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def real_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"[\t-\r]", "")) != ""


def line_key(line: Column) -> Column:
    """128 bits by two seeds."""
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2) of lines on at least ``min_sites`` sites, from rows (h1, h2, site); null sites are not counted."""
    # A document's repeats and a partition's repeats fold first, so the hottest line leaves a few rows a task.
    known = lines.where("site is not null")
    seen = known.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    seen = cut(seen.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * 0.5))
    near = ERRORS * 1.04 / 2 ** (LG_K / 2)
    low, high = min_sites * (1 - near) - 1, min_sites * (1 + near) + 1
    sure = seen.where(F.col("sites") > high).select("h1", "h2")
    doubtful = seen.where((F.col("sites") >= low) & (F.col("sites") <= high)).select("h1", "h2")
    # Folded to one row a line and site before any join, so that a hot line's rows never meet in one task.
    exact = known.groupBy("h1", "h2", "site").agg(F.lit(1).alias("one")).join(doubtful, ["h1", "h2"], "left_semi")
    exact = exact.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites).select("h1", "h2")
    return sure.union(exact)


def without_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """``docs`` with the text cleaned, plus n_lines, n_removed and copied (all lines, white space aside, are boilerplate; none is removed).

    A null text stays null and has no lines; an empty one is one empty line. Lines of white space only are
    never boilerplate. Rows with null ids, with one id and several texts, or repeated, are each cleaned by
    their own text. A null site does not count towards a line's spread, but its documents are cleaned too.
    Columns named like the added ones are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed", "copied")])
    keys = F.transform(text_lines(F.col(text_col)), lambda x: F.when(real_line(x), line_key(x)))
    made = table(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("sum"), F.col(site_col).cast("string").alias("site"), keys.alias("keys")))
    real = F.size(F.filter("keys", lambda k: k.isNotNull()))
    lines = made.select("id", "sum", "site", real.alias("n_real"), F.posexplode("keys").alias("at", "key")).where("key is not null").select("id", "sum", "site", "n_real", "at", "key.*")
    bad = cut(spread_lines(lines.select("h1", "h2", "site"), min_sites)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.drop("site").withColumn("salt", F.pmod(F.xxhash64("id", "sum", "at"), F.lit(SALTS)).cast("int"))
    hits = salted.join(bad, ["h1", "h2", "salt"], "left_semi").groupBy("id", "sum").agg(F.array_sort(F.collect_set("at")).alias("bad"), F.max("n_real").alias("n_real"))
    of, its, bad_at = fresh(docs, "_id", "_sum", "_bad")
    hits = hits.select(F.col("id").alias(of), F.col("sum").alias(its), F.col("bad").alias(bad_at), (F.col("n_real") == F.size("bad")).alias("copied"))
    known = docs.join(hits, F.col(id_col).eqNullSafe(F.col(of)) & F.xxhash64(F.col(text_col)).eqNullSafe(F.col(its)) & F.col(text_col).isNotNull(), "left")
    known = known.withColumn("copied", F.coalesce("copied", F.lit(False)))
    acts = F.col(bad_at).isNotNull() & ~F.col("copied")
    # What lies between the removed places, slice by slice: the array of lines is bound once and each line copied once.
    after = lambda j: F.coalesce(F.get(bad_at, j - 1), F.lit(-1)) + 1
    kept = lambda lines: F.flatten(F.transform(F.sequence(F.lit(0), F.size(bad_at)), lambda j: F.slice(lines, after(j) + 1, F.coalesce(F.get(bad_at, j), F.size(lines)) - after(j))))
    clean = F.array_join(F.transform(F.array(text_lines(F.col(text_col))), kept)[0], "\n")
    breaks = F.length(text_col) - F.length(F.translate(text_col, "\n", ""))
    out = known.withColumn("n_lines", F.coalesce(breaks + 1, F.lit(0)).cast("long"))
    out = out.withColumn("n_removed", F.when(acts, F.size(bad_at)).otherwise(0).cast("long"))
    return out.withColumn(text_col, F.when(acts, clean).otherwise(F.col(text_col))).select(*docs.columns, "n_lines", "n_removed", "copied")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", "copied", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
SQL = {
    "op3_line_dedup": f"""
with l as (select doc_id, source, text, unnest(str_split(text, chr(10))) as line, generate_subscripts(str_split(text, chr(10)), 1) as pos from documents where text is not null),
b as (select line from l where trim(regexp_replace(line, '[\\t-\\r]', '', 'g')) <> '' group by line having count(distinct source) >= {MIN_SITES}),
m as (select l.*, b.line is not null as bad from l left join b on l.line = b.line),
g as (select doc_id, text, count(*) as n_lines, count(*) filter (bad) as n_bad, count(*) filter (trim(regexp_replace(line, '[\\t-\\r]', '', 'g')) <> '') as n_real, string_agg(line, chr(10) order by pos) filter (not bad) as clean from m group by doc_id, text),
r as (select *, n_bad > 0 and n_bad = n_real as copied from g)
select d.doc_id, coalesce(r.n_lines, 0)::bigint as n_lines, (case when r.copied then 0 else coalesce(r.n_bad, 0) end)::bigint as n_removed, coalesce(r.copied, false) as copied,
  sha256(coalesce(case when r.copied or r.n_bad = 0 then d.text else coalesce(r.clean, '') end, '')) as text_sha256
from documents d left join r on d.doc_id = r.doc_id and d.text = r.text
"""
}
