"""SimHash near-dedup by exact tiled comparison.

Equal fingerprints fold into one row first. A pair within the radius agrees on at least one of radius + 1 bit
bands, so tiles are cut inside the groups that agree on a band: tile pairs with no band in common are skipped
as a whole, and the comparison stays exact. Inside a group, members are ordered by population count and cut
into tiles; a tile pair whose population counts differ beyond the radius is skipped, any other is compared by
numpy exclusive-or and bit counts. Groups larger than ``TILE`` are cut into tiles across tasks, a pair of
tiles a task. Each comparison keeps a spanning forest of its links, so copies are never expanded into pairs.

``similar_texts`` holds near copies to a Jaccard similarity of word shingles. At 0.8 fingerprints differ by some ten
bits, which no bit band survives, so its tiles are cut inside the groups that share a band of minima of permuted
shingle hashes. The comparison by bits, at a radius that such pairs keep, proposes a spanning forest of least distances;
its pairs are verified on the two texts. Where some fail, the components that are left apart are compared whole, in
tiles and exactly, but for the largest of them with itself; so no pair is left out, and a group of copies costs a few
verifications a member.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import SEED, blocks, components, cut, lookup, lower_ascii, mix64, read, table, union_find, words_of, workers_find_us
from facetry.llm.op9_minhash import P, shingle_hashes, signatures

#: Members of a tile, and of a group that one task compares whole.
TILE = 2048
#: Members of a tile whose pairs within a wide radius are held at once; bytes of text of a tile whose texts are.
WIDE_TILE, TILE_BYTES = 512, 8 << 20
#: Exact copies of a text are dealt over so many tasks.
SALTS = 16
#: Bands of permuted minima, and minima a band: of pairs at 0.8, 99.96 % share a band.
BANDS, ROWS = 20, 5


def simhashes(texts: pa.Array, words: int = 4) -> np.ndarray:
    """64-bit SimHash of each text over its word shingles, repeats included; 0 for a text without words."""
    starts, flat = words_of(lower_ascii(texts))
    out = np.zeros(len(texts), np.uint64)
    if not len(flat):
        return out
    # All words in one buffer, a space after each, so that a shingle is a slice of it.
    buf = memoryview(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat.cast(pa.string())), " ")[0].as_buffer())
    ends = np.cumsum(pc.binary_length(flat).to_numpy().astype(np.int64) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = np.diff(starts)
    shingles = np.where(n == 0, 0, np.maximum(n - words + 1, 1))
    at = np.concatenate([[0], np.cumsum(shingles)])
    rank = np.arange(at[-1]) - np.repeat(at[:-1], shingles)
    first = np.repeat(starts[:-1], shingles) + rank
    last = np.minimum(first + words, np.repeat(starts[1:], shingles)) - 1
    digest = xxhash.xxh64_intdigest
    step = 1 << 16
    h = np.empty(at[-1], np.uint64)
    for i in range(0, len(h), step):
        a, b = begins[first[i : i + step]].tolist(), ends[last[i : i + step]].tolist()
        h[i : i + step] = np.fromiter((digest(buf[x:y], SEED) for x, y in zip(a, b, strict=True)), np.uint64, len(a))
    votes = np.zeros((len(texts), 64), np.int64)
    row = np.repeat(np.arange(len(texts)), shingles)
    for i in range(0, len(h), step):
        bits = np.unpackbits(h[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        r = row[i : i + step]
        cuts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        votes[r[cuts]] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    major = (2 * votes > shingles[:, None]).astype(np.uint8)
    return np.packbits(major, axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp long) for every row; the fingerprint's bits as a signed long."""
    workers_find_us(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(simhashes(b.column("text"), words).view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in a, in b) of pairs within the radius; both sides ordered by population count."""
    pa_, pb = np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    step = 256
    for i in range(0, len(a), step):
        for j in range(i if same else 0, len(b), step):
            x, y = a[i : i + step], b[j : j + step]
            if pb[j] - pa_[min(i + step, len(a)) - 1] > radius or pa_[i] - pb[min(j + step, len(b)) - 1] > radius:
                continue
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            live = p + i < q + j if same else slice(None)
            left.append(p[live] + i)
            right.append(q[live] + j)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups from rows sorted by ``keys``; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        same = np.ones(t.num_rows, bool)
        for k in keys:
            v = t[k].to_numpy()
            same &= v == v[-1]
        n = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if n:
            yield t.slice(0, n)
        held = t.slice(n).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def near_pairs(t: pa.Table, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one group within the radius, from rows (band, value, tiles, side, fp) of whole groups; two tiles pair across only."""
    keys = np.stack([t[k].to_numpy() for k in ("band", "value", "tiles")])
    fp, side = t["fp"].to_numpy().view(np.uint64), t["side"].to_numpy()
    new = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    size = np.diff(np.append(new, len(fp)))
    a: list[np.ndarray] = [np.zeros(0, np.int64)]
    b: list[np.ndarray] = [np.zeros(0, np.int64)]
    # Small groups side by side: each row against the k-th after it in its group, for all groups at once.
    small = size <= 64
    rows = np.flatnonzero(np.repeat(small, size))
    rest = np.repeat(new + size, size) - np.arange(len(fp))
    two = np.repeat(np.add.reduceat(side, new) > 0, size)
    for k in range(1, int(size[small].max(initial=1))):
        rows = rows[rest[rows] > k]
        near = rows[(np.bitwise_count(fp[rows] ^ fp[rows + k]) <= radius) & (~two[rows] | (side[rows] != side[rows + k]))]
        a.append(near)
        b.append(near + k)
    yield np.concatenate(a), np.concatenate(b)
    for s, n in zip(new[~small], size[~small], strict=True):
        order = s + np.lexsort((fp[s : s + n], np.bitwise_count(fp[s : s + n])))
        ia, ib = (order[side[order] == 0], order[side[order] == 1]) if two[s] else (order, order)
        p, q = compare_tiles(fp[ia], fp[ib], radius, not two[s])
        yield ia[p], ib[q]


def group_links(t: pa.Table, radius: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest (member, root) of the links of each group."""
    fp = t["fp"].to_numpy()
    for u, v in near_pairs(t, radius):
        live = np.unique(np.concatenate([u, v]))
        root = live[union_find(len(live), np.searchsorted(live, u), np.searchsorted(live, v))]
        moved = live != root
        yield pa.RecordBatch.from_arrays([pa.array(fp[live[moved]]), pa.array(fp[root[moved]])], ["a", "b"])


def bands_of(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """Bit ranges (shift, width) that each key of a band joins: radius + 1 + extra blocks, 1 + extra of them a key.

    A pair within the radius leaves at least 1 + extra blocks equal. More blocks a key make groups smaller, so
    ``extra`` grows with the number of distinct fingerprints until a group has some hundred members on average.
    """
    from itertools import combinations

    for extra in range(0, 5):
        blocks_ = radius + 1 + extra
        edge = [round(64 * i / blocks_) for i in range(blocks_ + 1)]
        bits = [(edge[i], edge[i + 1] - edge[i]) for i in range(blocks_)]
        if n / 2 ** sum(sorted(w for _, w in bits)[: 1 + extra]) <= 256:
            break
    return [list(c) for c in combinations(bits, 1 + extra)]


def tiled(rows: DataFrame, tile: int, key: str) -> DataFrame:
    """Rows (band, value, fp, ...) of groups of two or more, plus tiles and side, dealt and sorted by group and tiles.

    A group past ``tile`` is cut into tiles by hash of ``key``, and a row goes to every pair of tiles that has its own.
    """
    names = [c for c in rows.columns if c not in ("band", "value")]
    size = rows.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(size, ["band", "value"]).withColumn("cuts", F.ceil(F.col("n") / tile).cast("long"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64(key), "cuts"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)))
    rows = rows.select("band", "value", (F.least("mine", "other") * F.col("cuts") + F.greatest("mine", "other")).alias("tiles"), (F.col("mine") > F.col("other")).cast("int").alias("side"), *names)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "band", "value", "tiles").sortWithinPartitions("band", "value", "tiles")


def linked(distinct: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(a, b) rows that connect distinct fingerprints ``fp`` exactly as all pairs within the radius do."""
    workers_find_us(distinct.sparkSession)
    keys = bands_of(distinct.count(), radius)
    part = lambda shift, width: F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1)
    values = []
    for ranges in keys:
        v = F.lit(0).cast("long")
        for shift, width in ranges:
            v = F.shiftleft(v, width).bitwiseOR(part(shift, width))
        values.append(v)
    rows = tiled(distinct.select("fp", F.posexplode(F.array(*values)).alias("band", "value")), tile, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["band", "value", "tiles"]):
            yield from group_links(t, radius)

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component) for every row: component is the smallest id reachable through links.

    Null and empty texts, and texts without words, have fingerprint 0 and link like any other. Repeated rows
    and equal ids are kept, a row for a row. A null id is larger than any other for a component's smallest id.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words))
    links = linked(cut(rows.select("fp").distinct()), radius)
    return _classed(rows, "fp", components(links)).select(F.col("id").alias(id_col), "fp", "component")


def _classed(rows: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """``rows`` (id, key, ...) plus component: the smallest id in the group of the key, from ``groups`` (node, component)."""
    per = cut(rows.groupBy(key).agg(F.min("id").alias("least")))
    roots = per.join(groups.withColumnRenamed("node", key), key, "left").select(key, "least", F.coalesce("component", key).alias("root"))
    least = cut(roots.groupBy("root").agg(F.min("least").alias("component_id")))
    found = cut(lookup(roots.select(key, "root"), least, ["root"]).select(key, F.col("component_id").alias("component")))
    return lookup(rows, found, [key])


def radius_for(similarity: float) -> int:
    """Bits by which fingerprints of shingle sets at this Jaccard similarity differ, and four deviations more."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * differ + 4 * math.sqrt(64 * differ * (1 - differ)))


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row starts (n+1) and the distinct shingle hashes of each text in order, A-Z lower-cased."""
    starts, h = shingle_hashes(lower_ascii(texts.cast(pa.large_string())), words)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((h, row))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(starts) - 1))]), h[new]


def set_bits(starts: np.ndarray, h: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """64-bit SimHash of each row's hashes."""
    votes, row = np.zeros((len(starts) - 1, 64), np.int64), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    for i in range(0, len(h), step):
        bits, r = np.unpackbits(h[i : i + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), row[i : i + step]
        at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        votes[r[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    return np.packbits(2 * votes > np.diff(starts)[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def nearest_forest(t: pa.Table, radius: int) -> Iterator[pa.RecordBatch]:
    """(a, b) keys of a spanning forest of least distances of each group's pairs within the radius."""
    fp, key = t["fp"].to_numpy().view(np.uint64), t["key"].to_numpy()
    for u, v in near_pairs(t, radius):
        order = np.lexsort((np.maximum(key[u], key[v]), np.minimum(key[u], key[v]), np.bitwise_count(fp[u] ^ fp[v])))
        u, v, root = u[order], v[order], np.arange(len(fp))
        first = np.zeros(len(u), bool)
        while len(live := np.flatnonzero(root[u] != root[v])):  # each component takes its least pair
            best = np.full(len(fp), len(u))
            np.minimum.at(best, root[u[live]], live)
            np.minimum.at(best, root[v[live]], live)
            first[best[best < len(u)]] = True
            root = union_find(len(fp), u[first], v[first])
        yield _keyed(key, u[first], v[first])


def root_links(t: pa.Table, similarity: float, words: int) -> pa.Table:
    """(a, b) roots that pairs of texts at the similarity join, from rows (root, side, text) of a tile or two; a forest of them."""
    starts, h = shingle_sets(t["text"].combine_chunks(), words)
    roots = t["root"].combine_chunks().dictionary_encode()
    root, side, size = roots.indices.to_numpy(), t["side"].to_numpy(), np.diff(starts)
    member = np.repeat(np.arange(len(size)), size)
    # Members by shingle, and for every entry its shingle's run of members.
    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    run, holders = np.diff(np.append(new, len(h))), member[order]
    which = np.empty(len(h), np.int64)
    which[order] = np.repeat(np.arange(len(new)), run)
    two = side.min() != side.max()
    a: list[np.ndarray] = [np.zeros(0, np.int64)]
    b: list[np.ndarray] = [np.zeros(0, np.int64)]
    for i in np.flatnonzero(side == 0) if two else range(len(size)):
        w = which[starts[i] : starts[i + 1]]
        n = run[w]
        both = np.bincount(holders[np.repeat(new[w] - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(size))
        near = np.flatnonzero((both >= similarity * (size[i] + size - both)) & (root != root[i]) & (side == 1 if two else True))
        a.append(np.full(len(near), root[i]))
        b.append(root[near])
    up = union_find(len(roots.dictionary), np.concatenate(a), np.concatenate(b))
    moved = np.flatnonzero(up != np.arange(len(up)))
    return pa.table({"a": roots.dictionary.take(pa.array(moved)), "b": roots.dictionary.take(pa.array(up[moved]))})


def _keyed(key: np.ndarray, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(key[u], key[v])), pa.array(np.maximum(key[u], key[v]))], ["a", "b"])


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """(a, b) of class keys, from pairs of short keys, whose texts' shingle sets reach the similarity."""
    one = texts.select(F.col("short").alias("a"), F.col("key").alias("ka"), F.col("text").alias("x"))
    two = texts.select(F.col("short").alias("b"), F.col("key").alias("kb"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in blocks([whole], "x", 1 << 20):
                (sx, x), (sy, y) = (shingle_sets(b.column(c), words) for c in ("x", "y"))
                both = np.array([len(np.intersect1d(x[i:j], y[k:m], assume_unique=True)) for i, j, k, m in zip(sx, sx[1:], sy, sy[1:], strict=False)], np.int64)
                near = both >= similarity * (np.diff(sx) + np.diff(sy) - both)
                yield b.select(["ka", "kb"]).rename_columns(["a", "b"]).filter(pa.array(near))

    return pairs.join(one, "a").join(two, "b").select("ka", "kb", "x", "y").mapInArrow(run, "a string, b string")


def similar_texts(docs: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text", tile: int = WIDE_TILE) -> DataFrame:
    """(id, component) for every row: the smallest id reachable through texts whose shingle sets reach the similarity.

    Texts of equal shingle sets fold into one class first; pairs are sought as the module's head says. Null and empty
    texts, and texts without words, are one class. Rows are kept, a row for a row; a null id is larger than any other.
    """
    workers_find_us(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    mark = F.xxhash64("text").alias("mark")
    kind = rows.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = P ** np.arange(1, ROWS + 1, dtype=np.uint64)
        for b in blocks(batches, "text", 2 << 20):
            starts, h = shingle_sets(b.column("text"), words)
            key = [hashlib.blake2b(h[i:j].tobytes(), digest_size=16).hexdigest() for i, j in zip(starts, starts[1:], strict=False)]
            low = signatures(starts, h, perms=BANDS * ROWS).reshape(-1, BANDS, ROWS).astype(np.uint64)
            bands = mix64((low * powers).sum(axis=2)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), pa.array(key), pa.array(set_bits(starts, h).view(np.int64)), pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))], ["id", "mark", "key", "fp", "bands"])

    made = cut(rows.select("id", mark, "text").mapInArrow(sketch, f"id {kind}, mark bigint, key string, fp bigint, bands array<bigint>"))
    classes = cut(made.groupBy("key").agg(F.min("mark").alias("mark"), F.first("fp").alias("fp"), F.first("bands").alias("bands")).withColumn("short", F.xxhash64("key")))
    radius = radius_for(similarity)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["band", "value", "tiles"]):
            yield from nearest_forest(t, radius)

    placed = tiled(classes.select(F.col("short").alias("key"), "fp", F.posexplode("bands").alias("band", "value")), tile, "key")
    pairs = cut(placed.mapInArrow(propose, "a bigint, b bigint").distinct())
    named = pairs.select(F.col("a").alias("short")).union(pairs.select("b")).distinct()
    wanted = cut(classes.join(named, "short").select("short", "key", "mark"))
    salted = wanted.select("mark").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    texts = rows.select(mark, "text", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).join(salted, ["mark", "salt"], "left_semi")
    texts = table(texts.groupBy("mark").agg(F.first("text").alias("text")).join(wanted, "mark").withColumn("size", F.octet_length("text")))
    groups = components(verified(pairs, texts, similarity, words)).withColumnRenamed("node", "key")
    roots = cut(lookup(wanted.select("short", "key"), groups, ["key"]).select("short", "key", F.coalesce("component", "key").alias("root")))
    apart = pairs.join(roots.select(F.col("short").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("short").alias("b"), F.col("root").alias("rb")), "b")
    whole = components(apart.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).withColumnRenamed("node", "root")
    over = _joined(roots.join(whole, "root"), texts, similarity, words, tile)
    final = roots.join(components(over).select(F.col("node").alias("root"), F.col("component").alias("last")), "root", "left")
    return _classed(made.select("id", "key"), "key", final.select(F.col("key").alias("node"), F.coalesce("last", "root").alias("component"))).select(F.col("id").alias(id_col), "component")


def _joined(members: DataFrame, texts: DataFrame, similarity: float, words: int, tile: int) -> DataFrame:
    """(a, b) roots that a pair of texts at the similarity joins, from members (component, root, short).

    A component is cut into tiles: those of its largest root, and those of all others. A row goes to every pair of
    tiles that has its own and is not of the largest root alone.
    """
    rows = members.select("component", "root", "short").join(texts.select("short", "size"), "short")
    size = rows.groupBy("component", "root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    size = size.groupBy("component").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "bytes", "root")).alias("top"))
    cuts = lambda n, size: F.greatest(F.lit(1).cast("long"), F.ceil(n / (4 * tile)), F.ceil(size / TILE_BYTES))
    size = size.select("component", F.col("top.root").alias("main"), cuts(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("others"), cuts(F.col("top.n"), F.col("top.bytes")).alias("own"))
    rows = rows.join(cut(size), "component").withColumn("large", F.col("root") == F.col("main"))
    rows = rows.withColumn("mine", F.when(F.col("large"), F.col("others") + F.pmod(F.xxhash64("short"), "own")).otherwise(F.pmod(F.xxhash64("short"), "others")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1 + F.when(F.col("large"), 0).otherwise(F.col("own")))))
    tiles = F.least("mine", "other") * (F.col("others") + F.col("own")) + F.greatest("mine", "other")
    rows = rows.select("component", "root", "short", tiles.alias("tiles"), (F.col("mine") > F.col("other")).cast("int").alias("side")).join(texts.select("short", "text"), "short")
    return rows.select("component", "tiles", "root", "side", "text").groupBy("component", "tiles").applyInArrow(lambda t: root_links(t, similarity, words), "a string, b string")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_simhash": op7_simhash}
SQL: dict[str, str] = {}
