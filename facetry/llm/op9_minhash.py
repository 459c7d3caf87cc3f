"""Document fingerprints by MinHash.

Shingles of five words get a 64-bit hash; each of PERMS universal hash functions (multiply-add, high bits kept)
permutes them and keeps the smallest value, in numpy over whole blocks of texts. A fingerprint is the low 16
bits of each minimum as hex digits, and the likeness of two is the share of equal places.

``near_duplicates`` joins bands of the signature in Spark. Texts with the same shingle set fold into one class
first. Classes that share a band are compared in tiles, as in op7, by their signatures, and what comes within
reach is verified by the exact Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import SEED, blocks, components, cut, lookup, mix64, read, table, words_of, workers_find_us

PERMS, WORDS = 128, 5
BANDS, ROWS = 32, 4
#: Texts without words have this hash as their only shingle, so that they are like each other only.
NONE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(SEED)
A = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)
P = np.uint64(0x100000001B3)


def shingle_hashes(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row starts (n+1) and 64-bit hashes of the word shingles of each text; fewer words: the whole sequence."""
    starts, flat = words_of(texts)
    coded = flat.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    unique = np.fromiter((digest(w, SEED) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = unique[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    n = np.diff(starts)
    shingles = np.maximum(n - words + 1, 1)
    at = np.concatenate([[0], np.cumsum(shingles)])
    first = np.repeat(starts[:-1], shingles) + np.arange(at[-1]) - np.repeat(at[:-1], shingles)
    left = np.repeat(starts[1:], shingles) - first
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    out = np.zeros(at[-1], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words):
            out = out * P + np.where(j < left, padded[first + np.minimum(j, left.clip(0))], NONE)
    return at, mix64(out)


def signatures(starts: np.ndarray, h: np.ndarray, run: int = 1 << 16, perms: int = PERMS) -> np.ndarray:
    """(texts, perms) minima of the permuted hashes, as uint32; every text has a shingle at least."""
    out = np.empty((len(starts) - 1, perms), np.uint32)
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + run, side="right")) - 1)
        part, cuts = h[starts[i] : starts[j]], starts[i:j] - starts[i]
        with np.errstate(over="ignore"):
            for k in range(perms):
                out[i:j, k] = np.minimum.reduceat(((part * A[k] + B[k]) >> np.uint64(32)).astype(np.uint32), cuts)
        i = j
    return out


def hexed(sig: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes().hex() for row in (sig & np.uint32(0xFFFF)).astype(">u2")], pa.string())


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a & np.uint32(0xFFFF)) == (b & np.uint32(0xFFFF))).mean(axis=1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for every row; null and empty texts, and texts without words, share one fingerprint."""
    workers_find_us(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), hexed(signatures(*shingle_hashes(b.column("text"))))], ["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", tile: int = 1024) -> DataFrame:
    """(id, component) for every row: the smallest id reachable through pairs of Jaccard ``threshold`` or more.

    The pairs are those that share a signature band (at 0.8: 99.99 % of them). Texts of equal shingle sets,
    null and empty ones included, are in one class. Rows are kept, a row for a row; null ids come last.
    """
    workers_find_us(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            starts, h = shingle_hashes(b.column("text"))
            sig = signatures(starts, h)
            sets = [np.unique(h[s:e]).view(np.int64) for s, e in zip(starts, starts[1:], strict=False)]
            key = [hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() for x in sets]
            bands = mix64((sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64) * (P ** np.arange(1, ROWS + 1, dtype=np.uint64))).sum(axis=2)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(key), pa.array([x.tobytes() for x in (sig & np.uint32(0xFFFF)).astype("<u2")], pa.binary()), pa.array(list(bands), pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))], ["id", "key", "sig", "bands", "shingles"])

    kind = rows.schema["id"].dataType.simpleString()
    made = table(rows.mapInArrow(sketch, f"id {kind}, key string, sig binary, bands array<bigint>, shingles array<bigint>"))
    classes = made.groupBy("key").agg(F.min("id").alias("least"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    placed = classes.select("key", "sig", F.posexplode("bands").alias("band", "value"))
    sizes = placed.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    placed = placed.join(sizes, ["band", "value"]).withColumn("cuts", F.ceil(F.col("n") / tile).cast("long")).withColumn("mine", F.pmod(F.xxhash64("key"), "cuts"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    placed = placed.withColumn("tiles", F.least("mine", "other") * F.col("cuts") + F.greatest("mine", "other")).withColumn("side", (F.col("mine") > F.col("other")).cast("int"))
    reach = threshold - 4 * (threshold * (1 - threshold) / PERMS) ** 0.5

    def compare(t: pa.Table) -> pa.Table:
        keys, side = t["key"].to_pylist(), t["side"].to_numpy()
        sig = np.stack([np.frombuffer(x, "<u2") for x in t["sig"].to_pylist()])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        two = side.min() != side.max()
        for i in range(len(sig)):
            j = np.flatnonzero((side != side[i]) & (side > 0)) if two and side[i] == 0 else np.arange(i + 1, len(sig)) if not two else np.zeros(0, np.int64)
            near = j[(sig[j] == sig[i]).mean(axis=1) >= reach]
            a.append(np.full(len(near), i))
            b.append(near)
        x, y = np.concatenate(a), np.concatenate(b)
        return pa.table({"a": pa.array([min(keys[i], keys[j]) for i, j in zip(x, y, strict=True)], pa.string()), "b": pa.array([max(keys[i], keys[j]) for i, j in zip(x, y, strict=True)], pa.string())})

    pairs = placed.select("band", "value", "tiles", "side", "key", "sig").groupBy("band", "value", "tiles").applyInArrow(compare, "a string, b string").distinct()
    sets = made.groupBy("key").agg(F.first("shingles").alias("shingles"))
    pairs = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    links = pairs.where(F.size(F.array_intersect("x", "y")) >= threshold * F.size(F.array_union("x", "y"))).select("a", "b")
    groups = components(links).withColumnRenamed("node", "key")
    roots = cut(classes.select("key", "least").join(groups, "key", "left").select("key", "least", F.coalesce("component", "key").alias("root")))
    least = cut(roots.groupBy("root").agg(F.min("least").alias("component")))
    found = cut(lookup(roots.select("key", "root"), least, ["root"]).select("key", "component"))
    return lookup(made.select("id", "key"), found, ["key"]).select(F.col("id").alias(id_col), "component")


def with_next(docs: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (run, id, text, ghost), to be sorted by id in each run: the texts, and at each run's end the first of the next.

    Runs are ranges of ids between quantiles; the first of the first run ends the last. A ghost is a document
    that only stands there as the next one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    splits = sorted({q for q in (docs.select(F.percentile_approx(id_col, [i / parts for i in range(1, parts)], 10_000)).first()[0] or [])}) if parts > 1 else []
    run = F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.size(F.filter(F.array(*[F.lit(s) for s in splits]), lambda s: s <= F.col("id")))) if splits else F.lit(0)
    rows = rows.withColumn("run", run).withColumn("tie", F.xxhash64("text"))
    heads = rows.groupBy("run").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "tie")).alias("head")).collect()  # a row a run
    heads = sorted((r["run"], r["head"]["id"], r["head"]["tie"]) for r in heads)
    if not heads:
        return rows.select("run", "id", "text", F.lit(False).alias("ghost"))
    before = docs.sparkSession.createDataFrame([(r, i, t, heads[k - 1][0]) for k, (r, i, t) in enumerate(heads)], f"r int, i {rows.schema['id'].dataType.simpleString()}, t long, before int")
    ghost = rows.join(F.broadcast(before), (F.col("run") == F.col("r")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("tie") == F.col("t")), "left")
    both = F.when(F.col("before").isNotNull(), F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("ghost")), F.struct(F.col("before").alias("run"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("ghost"))))
    return ghost.select("id", "text", F.explode(both).alias("_at")).select("_at.run", "id", "text", "_at.ghost")


def edited_pairs(docs: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has its last quarter of code points replaced by the first as many, or all, of the next
    document by id (null ids first, ties by hash); after the last comes the first, so a lone document is its
    own next. Null texts count as empty.
    """
    workers_find_us(docs.sparkSession)
    rows = with_next(docs, parts, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.repartition(parts, "run").sortWithinPartitions("run", "ghost", F.col("id").asc_nulls_first(), "tie")

    def pairs(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        edited = []
        for t, n in zip(texts, nexts, strict=True):
            k = len(t) // 4
            edited.append(t[: len(t) - k] + n[:k])
        # The next text is mostly the next row's own.
        other = [i for i, n in enumerate(nexts) if i + 1 == len(texts) or n is not texts[i + 1]]
        where = np.arange(1, len(texts) + 1)
        where[other] = len(texts) + np.arange(len(other))
        both = signatures(*shingle_hashes(pa.array(texts + [nexts[i] for i in other], pa.large_string())))
        one, two, three = both[: len(texts)], signatures(*shingle_hashes(pa.array(edited, pa.large_string()))), both[where]
        sums = [hashlib.sha256(e.encode()).hexdigest() for e in edited]
        return pa.RecordBatch.from_pydict({"id": ids, "n_chars": pa.array([len(t) for t in texts], pa.int64()), "edited_sha256": pa.array(sums, pa.string()), "fingerprint": hexed(one), "edited_fingerprint": hexed(two), "near_edited": pa.array(likeness(one, two)), "near_next": pa.array(likeness(one, three))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None  # the run, and the row that waits for its next
        for b in blocks(batches, "text", 4 << 20):
            runs, ids, texts, ghosts = (b.column(c).to_pylist() for c in ("run", "id", "text", "ghost"))
            own, text, after = [], [], []
            for r, i, t, g in zip(runs, ids, texts, ghosts, strict=True):
                if last is not None and r == at:
                    own.append(last[0])
                    text.append(last[1])
                    after.append(t)
                last, at = None if g else (i, t), r
            if own:
                yield pairs(pa.array(own, b.column("id").type), text, after)

    return dealt.mapInArrow(run, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return edited_pairs(docs, int(spark.conf.get("spark.sql.shuffle.partitions"))).withColumnRenamed("id", "doc_id")


QUERIES = {"op9_minhash": op9_minhash}
SQL: dict[str, str] = {}
