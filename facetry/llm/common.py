"""Shared plumbing: the shared folder, lineage cuts, Arrow text blocks and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

#: The separators of a word: space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SEED = 42


#: Environment of Python workers: memory that is freed goes back to the system, as a worker lives on beside the JVM.
MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def workers_find_us(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started, and give freed memory back."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    for k, v in MEMORY.items():
        env.setdefault(k, v)
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode, where driver and executors are one process."""
    workers_find_us(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="facetry-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Compute now and cut the lineage, with the rows kept in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """As ``cut``, but a Parquet table, which later reads can prune by column and which has its true size as statistics."""
    return _stored(df)[0]


def _stored(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _removed(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_us(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of whole rows with about ``most`` bytes of text; a longer row stays whole."""
    for b in batches:
        if b.num_rows == 0:
            continue
        sizes = np.nan_to_num(pc.binary_length(b.column(text)).to_numpy(zero_copy_only=False).astype(float))
        cum, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            base = cum[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(cum, base + most, side="right")))
            yield b.slice(at, end - at)
            at = end


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row starts (n+1) and the flat words of each text; null counts as empty. Words are split at ASCII white space."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    # One cast to plain lists: the kernel keeps empty strings at the ends, which are no words.
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
        flat = flat.filter(pa.array(full))
    return starts, flat


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each row's run; empty runs give 0."""
    if values.dtype.kind == "f":  # each row on its own, for full precision
        full, out = np.diff(starts) > 0, np.zeros(len(starts) - 1)
        if full.any():
            out[full] = np.add.reduceat(values, starts[:-1][full])
        return out
    c = np.concatenate([[0], np.cumsum(values)])
    return c[starts[1:]] - c[starts[:-1]]


def lower_ascii(texts: pa.Array) -> pa.Array:
    """A-Z lower-cased, null as empty. The kernel misreads a slice that was cast to wide offsets, so it gets a copy."""
    return pc.ascii_lower(pa.concat_arrays([pc.fill_null(texts, "")]))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def union_find(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root (smallest member) of each of n items under links a-b, by vectorised hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        live = ra != rb
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of undirected ``edges`` (a, b); component is the smallest node reachable.

    Each round hooks every node to its smallest neighbour, halves the paths twice, relabels the links and
    keeps those that still join two labels. Nothing is collected; each step is a table in the shared folder, removed
    once no later step reads it. (Checkpoints keep estimates of size, which joins of a table with itself square each
    time, until planning itself takes no end.) Joins meet two fresh exchanges, so that adaptive execution can split a
    hub's rows.
    """
    spark, old = edges.sparkSession, []

    def step(df: DataFrame) -> DataFrame:
        out, path = _stored(df)
        old.append(path)
        return out

    links = step(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = step(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("component", F.col("node")))
    while not links.isEmpty():
        up = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
        up = step(up.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("y")))
        for _ in range(2):
            up = step(up.join(up.select(F.col("x").alias("y"), F.col("y").alias("z")), "y").select("x", F.col("z").alias("y")))
        to = lambda df, c, up=up: df.join(up.select(F.col("x").alias(c), F.col("y").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        labels = step(to(labels, "component"))
        links = to(to(links, "a"), "b").where("a <> b")
        links = step(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        _removed(spark, old[:-2])
        del old[:-2]
    return labels


def lookup(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join, null-safe on ``keys``, to a side with one row a key; adaptive execution may split hot keys of ``left``."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(r, on, "left").drop(*[f"_r_{k}" for k in keys])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with so many underscores before it that no column of ``df`` is called so, letter case aside."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def row_keys(df: DataFrame) -> list[Column]:
    """Two hashes of a whole row, k1 and k2; only rows that are alike in every column share them."""
    plain = (StringType, BinaryType, BooleanType, NumericType, DateType, TimestampType, TimestampNTZType)
    cols = [F.col(f"`{f.name}`") if isinstance(f.dataType, plain) else F.to_json(F.struct(F.col(f"`{f.name}`")), {"ignoreNullFields": "false"}) for f in df.schema]
    nulls = [c.isNull() for c in cols]  # hashes pass over nulls
    return [F.xxhash64(*nulls, *cols).alias("k1"), F.xxhash64(F.lit("row"), *nulls, *cols).alias("k2")]


def sums_before(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` plus the sum of each of ``sums`` over all rows before it; ``order`` tells all rows apart.

    Rows are dealt into ranges, and each range is a window of its own; the sums of whole ranges, one row a
    partition, are all that meets in one task.
    """
    dealt = cut(rows.withColumns({f"_of_{k}": x for k, x in sums.items()}).repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(*[F.sum(f"_of_{k}").alias(f"_all_{k}") for k in sums])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_ahead_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({k: F.coalesce(F.sum(f"_of_{k}").over(inside), F.lit(0)) for k in sums}).join(F.broadcast(parts), "_part")
    return out.withColumns({k: F.col(k) + F.col(f"_ahead_{k}") for k in sums}).select(*rows.columns, *sums)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of int64 of one length, compressed by byte planes; the first goes as differences."""
    first = np.diff(columns[0], prepend=np.zeros(1, columns[0].dtype))
    return len(first).to_bytes(8, "little") + zstandard.ZstdCompressor(level=3).compress(b"".join(_planes(c) for c in (first, *columns[1:])))


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=max(1, n * 8 * columns)), np.uint8)
    out = [np.ascontiguousarray(raw[i * n * 8 : (i + 1) * n * 8].reshape(8, n).T).view("<i8").ravel() for i in range(columns)]
    out[0] = np.cumsum(out[0])
    return out


def open_fs(uri: str):
    """A pyarrow file system and the path in it, for a folder that driver and executors share."""
    from pyarrow import fs

    path = uri.removeprefix("file:")
    return (fs.LocalFileSystem(), "/" + path.lstrip("/")) if path != uri or uri.startswith("/") else fs.FileSystem.from_uri(uri)
