"""Embedding near-dedup by sorted projection passes.

Each pass hashes every vector by the signs of random projections, joined into one key, and orders the vectors
by label and key. Vectors that point the same way share long prefixes, so near pairs stand close in some pass:
each vector is compared with the ``window`` after it, and further as long as it keeps finding partners. Pairs
are verified in double precision and united over the passes. Keys are made of vectors less the centre of their
label, so that a common direction does not crowd the prefixes. The number of passes follows from the sizes of
labels and their vectors' distances from the centre, so that a pair at the threshold is found with the wanted
probability.

A partition's edge ends the growth of its windows, so groups of more than ``window`` linked vectors are compared
again as a whole, in tiles and exactly; each tile gives counts of partners, not pairs.

Exact copies fold into one class first, and only class representatives are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import SEED, components, cut, lookup, read, workers_find_us

WINDOW = 64
RECALL = 0.999
BITS = 63
#: Members of a tile.
TILE = 2048


def passes_for(n: int, threshold: float, window: int, recall: float) -> int:
    """Passes after which a pair at the threshold has stood within the window with probability ``recall``.

    One pass finds it if it agrees on the prefix bits that leave half a window of the n vectors.
    """
    agree = 1 - math.acos(threshold) / math.pi
    one = agree ** max(0.0, math.log2(max(2 * n / window, 1)))
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - min(one, 1 - 1e-9))))


def unit(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length, scaled to length one in double precision."""
    n = len(vectors)
    v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def sign_keys(v: np.ndarray, passes: int) -> np.ndarray:
    """(rows, passes) keys of BITS sign bits, the first projection highest."""
    out = np.zeros((len(v), passes), np.int64)
    weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
    for p in range(passes):
        planes = np.random.default_rng([SEED, p, v.shape[1]]).standard_normal((v.shape[1], BITS))
        out[:, p] = ((v @ planes) > 0).astype(np.int64) @ weights
    return out


def codes(labels: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct labels, and the place of each row's label in them."""
    d = labels.dictionary_encode()
    return d.dictionary, d.indices.to_numpy()


def centred(vectors: pa.Array, centres: pa.Array) -> np.ndarray:
    """Unit vectors less their centres."""
    u = unit(vectors)
    return u - centres.flatten().to_numpy(zero_copy_only=False).reshape(u.shape)


def centres_of(classes: DataFrame) -> DataFrame:
    """(label, dim, n, centre): the mean of each label's unit vectors of one length."""
    label = classes.schema["label"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                names, at = codes(part.column("label"))
                out = np.zeros((len(names), d))
                np.add.at(out, at, unit(part.column("vec")))
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(names), d, np.int32)), pa.array(np.bincount(at, minlength=len(names))), pa.array(list(out), pa.list_(pa.float64()))], ["label", "dim", "n", "sum"])

    rows = classes.select("label", F.size("vec").alias("dim"), "vec").mapInArrow(sums, f"label {label}, dim int, n bigint, sum array<double>")
    rows = rows.select("label", "dim", "n", F.posexplode("sum").alias("i", "x")).groupBy("label", "dim", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    rows = rows.groupBy("label", "dim").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", (F.col("x") / F.col("n")).alias("x")))).alias("c"))
    return rows.select("label", "dim", "n", F.transform("c", lambda c: c["x"]).alias("centre"))


def passes_of(placed: DataFrame, threshold: float, window: int, recall: float) -> int:
    """Passes that the label in most need of them takes, from rows (label, dim, n, centre, vec); 2 n / window at most.

    A pair at the threshold that lies near the centre is seen from there under a wider angle. Vectors nearer to it
    than the pair's own distance do not count: around them all are partners, and windows grow.
    """
    label = placed.schema["label"].dataType.simpleString()

    def grid(n: int) -> np.ndarray:
        least = passes_for(n, threshold, window, recall)
        return np.unique(np.ceil(least * 2 ** np.arange(0, max(0.0, math.log2(max(2 * n / window / least, 1))) + 0.25, 0.125)))

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                names, at = codes(part.column("label"))
                far = (centred(part.column("vec"), part.column("centre")) ** 2).sum(axis=1)
                size = part.column("n").to_numpy()
                for k in range(len(names)):
                    own = far[(at == k) & (far > 1 - threshold)]
                    n = int(size[at == k][0])
                    agree = 1 - np.arccos(1 - (1 - threshold) / own) / math.pi
                    one = agree ** max(0.0, math.log2(max(2 * n / window, 1)))
                    tries = grid(n)
                    lost = [float(((1 - one) ** p).sum()) for p in tries]
                    m = len(tries)
                    yield pa.RecordBatch.from_arrays([pa.array([names[k].as_py()] * m, names.type), pa.array([int(d)] * m, pa.int32()), pa.array(tries.astype(np.int64)), pa.array(lost, pa.float64()), pa.array([len(own)] * m, pa.int64())], ["label", "dim", "passes", "lost", "rows"])

    sums = placed.select("label", "dim", "n", "centre", "vec").mapInArrow(missed, f"label {label}, dim int, passes bigint, lost double, rows bigint")
    sums = sums.groupBy("label", "dim", "passes").agg(F.sum("lost").alias("lost"), F.sum("rows").alias("rows"))
    enough = F.min(F.when(F.col("lost") <= (1 - recall) * F.col("rows"), F.col("passes")))
    need = sums.groupBy("label", "dim").agg(F.coalesce(enough, F.max("passes")).alias("need")).agg(F.max("need")).first()
    return int(need[0] or 2)


def window_pairs(v: np.ndarray, group: np.ndarray, threshold: float, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that reach the threshold, each row against those after it in order.

    A row goes on past ``window`` while its last ``window`` neighbours held a partner.
    """
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    last = np.zeros(len(v), np.int64)
    rows, k = np.arange(len(v) - 1), 1
    while len(rows):
        ok = group[rows] == group[rows + k]
        near = np.zeros(len(rows), bool)
        near[ok] = np.einsum("ij,ij->i", v[rows[ok]], v[rows[ok] + k]) >= threshold
        a.append(rows[near])
        b.append(rows[near] + k)
        last[rows[near]] = k
        k += 1
        rows = rows[ok & (k - last[rows] <= window)]
        rows = rows[rows + k < len(v)]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def linked(classes: DataFrame, threshold: float, window: int, recall: float) -> DataFrame:
    """(a, b) distinct class representatives whose cosine reaches the threshold, from rows (rep, label, vec)."""
    total = classes.count()
    placed = lookup(classes.select("rep", "label", F.size("vec").alias("dim"), "vec"), cut(centres_of(classes)), ["label", "dim"])
    passes = passes_of(placed, threshold, window, recall)
    rep = classes.schema["rep"].dataType.simpleString()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                if part.num_rows:
                    k = sign_keys(centred(part.column("vec"), part.column("centre")), passes)
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), p, np.int32)), part.column("label"), part.column("dim"), pa.array(k[:, p]), part.column("rep"), part.column("vec")], ["pass", "label", "dim", "key", "rep", "vec"])

    label, vec = (classes.schema[c].dataType.simpleString() for c in ("label", "vec"))
    # Keys are made anew for the sample that range partitioning takes: cheaper than the vectors of all passes on disk.
    keyed = placed.select("rep", "label", "dim", "vec", "centre").mapInArrow(keys, f"pass int, label {label}, dim int, key bigint, rep {rep}, vec {vec}")
    parts = max(1, min(100_000, total * passes // (16 * window)))
    order = ["pass", "label", "dim", "key", "rep"]
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def compare(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        new = np.zeros(rows.num_rows, bool)
        for c in ("pass", "label", "dim"):
            v = rows[c].combine_chunks().dictionary_encode()
            code = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        group, dims = np.cumsum(new), rows["dim"].to_numpy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        cuts = np.flatnonzero(np.concatenate([[True], dims[1:] != dims[:-1], [True]]))
        for s, e in zip(cuts, cuts[1:], strict=False):
            x, y = window_pairs(unit(rows["vec"].slice(s, e - s).combine_chunks()), group[s:e], threshold, window)
            a.append(x + s)
            b.append(y + s)
        return np.concatenate(a), np.concatenate(b)

    fields = f"a {rep}, b {rep}, edge int, side int, pass int, label {label}, dim int, key bigint, rep {rep}, vec {vec}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)  # of bounded size: 16 windows
        x, y = compare(rows)
        reps = rows["rep"].combine_chunks()
        none = {c: pa.nulls(len(x), rows.schema.field(c).type) for c in ("pass", "label", "dim", "key", "rep", "vec")}
        yield pa.RecordBatch.from_pydict({"a": reps.take(pa.array(x)), "b": reps.take(pa.array(y)), "edge": pa.nulls(len(x), pa.int32()), "side": pa.nulls(len(x), pa.int32())} | none)
        me = TaskContext.get().partitionId()
        for side, edge, t in ((0, me, rows.slice(max(0, rows.num_rows - window))), (1, me - 1, rows.slice(0, window))):
            m = t.num_rows
            yield pa.RecordBatch.from_pydict({"a": pa.nulls(m, reps.type), "b": pa.nulls(m, reps.type), "edge": pa.array([edge] * m, pa.int32()), "side": pa.array([side] * m, pa.int32())} | {c: t[c].combine_chunks() for c in none})

    found = cut(dealt.mapInArrow(run, fields))

    def across(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("side", *order)])
        x, y = compare(t)
        reps = t["rep"].combine_chunks()
        return pa.table({"a": reps.take(pa.array(x)), "b": reps.take(pa.array(y))})

    seams = found.where("edge >= 0").select("edge", "side", *order, "vec").groupBy("edge").applyInArrow(across, f"a {rep}, b {rep}")
    both = found.where("a is not null").select("a", "b").union(seams)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def partner_counts(members: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """(rep, more) for rows (component, label, rep, vec, n, members): the sum of n over all partners in the component.

    Exact: a component is cut into tiles by hash, and a row goes to every pair of tiles that has its own.
    """
    rep = members.schema["rep"].dataType.simpleString()
    rows = members.withColumn("cuts", F.ceil(F.col("members") / tile).cast("long")).withColumn("mine", F.pmod(F.xxhash64("rep"), "cuts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).withColumn("dim", F.size("vec"))
    rows = rows.select("component", "label", "dim", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).alias("side"), (F.col("mine") == F.col("other")).alias("one"), "rep", "vec", "n")

    def count(t: pa.Table) -> pa.Table:
        v, n = unit(t["vec"].combine_chunks()), t["n"].to_numpy()
        side, one = t["side"].to_numpy(), t["one"][0].as_py()
        more = np.zeros(len(v), np.int64)
        a, b = (np.arange(len(v)),) * 2 if one else (np.flatnonzero(~side), np.flatnonzero(side))
        for i in range(0, len(a), 256):
            x = a[i : i + 256]
            near = v[x] @ v[b].T >= threshold
            if one:
                near[np.arange(len(x)), x] = False
            more[x] += near @ n[b]
            if not one:
                more[b] += n[x] @ near
        return pa.table({"rep": t["rep"], "more": pa.array(more)})

    return rows.groupBy("component", "label", "dim", "low", "high").applyInArrow(count, f"rep {rep}, more bigint").groupBy("rep").agg(F.sum("more").alias("more"))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, window: int = WINDOW, recall: float = RECALL, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component) for every row: vectors linked directly, and the smallest id reachable.

    Vectors that are null, empty, zero or hold a null or non-finite component, and those with a null label,
    link with nothing: no links, their own component. Vectors of different lengths never link. Equal vectors
    of one label link with each other. Rows are kept, a row for a row; equal ids count as separate vectors.
    """
    workers_find_us(vectors.sparkSession)
    x = F.col("vec")
    good = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")).withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("vec", F.when(F.col("good"), x)).withColumn("label", F.when(F.col("good"), F.col("label")))
    classes = cut(rows.where("good").groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("rep is not null"))
    links = cut(linked(classes.select("rep", "label", "vec"), threshold, window, recall))
    sizes = classes.select("rep", "n")
    both = links.union(links.select("b", "a")).toDF("rep0", "rep")
    groups = components(links).select(F.col("node").alias("rep"), "component")
    large = groups.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") > window)
    large = cut(groups.join(large, "component"))
    partners = both.join(large.select(F.col("rep").alias("rep0")), "rep0", "left_anti").join(sizes, "rep").groupBy("rep0").agg(F.sum("n").alias("more")).select(F.col("rep0").alias("rep"), "more")
    partners = partners.union(partner_counts(classes.join(large, "rep"), threshold))
    known = classes.join(partners, "rep", "left").join(groups, "rep", "left")
    known = cut(known.select("label", "vec", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")))
    out = lookup(rows.where("good"), known, ["label", "vec"]).select("id", "n_links", "component")
    out = out.union(rows.where("not good").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "n_links", F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))


QUERIES = {"op5_embeddings": op5_embeddings}
SQL: dict[str, str] = {}
