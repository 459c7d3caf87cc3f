"""N-gram language model in an Elias-Fano trie, and scoring of whole texts.

Level 1 is the vocabulary: sorted word hashes in an Elias-Fano sequence, with exact counts; a word's place is its
id. Level n holds the n-grams that occur at least ``min_count`` times (by default all), as children of their contexts,
the nodes of level n - 1: an Elias-Fano sequence of contexts, Elias-Fano pointers to each context's run of children, and in
each run the ids of the last words in order. A query finds its context by successor search and then the word
by successor search inside the context's run. Nodes keep quantised smoothed probabilities (interpolated
absolute discounting, add-one at the bottom) and, as contexts, the quantised weight of the shorter context.

Every level is cut by hash into segments, files in the shared folder that workers map into memory. They are
made level by level by grouped tasks: a task holds one segment's counts, an n-gram is counted only where its
n - 1 first and last words survived (which drops nothing that could survive), and the driver sees only the
sizes of segments.
"""

from __future__ import annotations

import contextlib
import ctypes
import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import SEED, blocks, crc_mod, cut, lower_ascii, mix64, open_fs, pack, read, row_sums, shared_dir, unpack, words_of, workers_find_us

#: Longest n-gram; occurrences that an n-gram of two words or more needs (1: nothing is pruned); what is taken off each count.
ORDER, MIN_COUNT, DISCOUNT = 3, 1, 0.75
#: Bytes of text a segment stands for, and segments at least.
SEGMENT, LEAST = 64 << 20, 48
END = np.uint64(xxhash.xxh64_intdigest(b"\n end", SEED))
STEP = 2047.0  # quantisation: 16 bits of -log2, in steps of 1 / STEP
U = np.uint64
#: The lowest and the highest bit of each byte; place of the k-th set bit of a byte at 256 k + byte.
ONES, TOPS = U(0x0101010101010101), U(0x8080808080808080)
SELECT = np.zeros(8 * 256, U)
for _b in range(256):
    for _k, _p in enumerate(p for p in range(8) if _b >> p & 1):
        SELECT[_k << 8 | _b] = _p


@lru_cache(maxsize=1)
def keep_large_arrays() -> None:
    """This worker keeps freed arrays below 32 MB for itself: here they are made and freed by the million tokens."""
    with contextlib.suppress(OSError, AttributeError):  # another C library
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 64 << 20)  # M_TRIM_THRESHOLD


class Packed:
    """Unsigned numbers of equal width, side by side."""

    def __init__(self, words: np.ndarray, bits: int) -> None:
        self.words, self.bits = words, bits

    @staticmethod
    def build(v: np.ndarray, bits: int) -> np.ndarray:
        words = np.zeros((len(v) * bits >> 6) + 2, U)
        if bits:
            x, at = v.astype(U) & U((1 << bits) - 1), np.arange(len(v), dtype=U) * U(bits)
            w, off = (at >> U(6)).astype(np.int64), at & U(63)
            np.bitwise_or.at(words, w, x << off)
            spill = off + U(bits) > U(64)
            np.bitwise_or.at(words, w[spill] + 1, x[spill] >> (U(64) - off[spill]))
        return words

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        at = i.astype(U) * U(self.bits)
        w, off = (at >> U(6)).astype(np.int64), at & U(63)
        second = np.where(off > 0, self.words[w + 1] << ((U(64) - off) & U(63)), U(0))
        return (self.words[w] >> off | second) & U((1 << self.bits) - 1)


class EliasFano:
    """A sorted sequence of unsigned numbers: low bits packed, high bits as unary runs with rank directories."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str) -> None:
        self.n, self.bits = (int(x) for x in arrays[f"{name}.size"])
        self.lows = Packed(arrays[f"{name}.low"], self.bits)
        self.high, self.ones, self.zeros = (arrays[f"{name}.{k}"] for k in ("high", "ones", "zeros"))
        self.top: int | None = None  # high part of the last element

    @staticmethod
    def build(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
        v = values.astype(U)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        ones = (v >> U(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((top >> bits) + n + 64 >> 6) * 64 + 64, np.uint8)
        flags[ones] = 1
        high = np.packbits(flags, bitorder="little").view(U)
        c = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        return {f"{name}.size": np.array([n, bits]), f"{name}.low": Packed.build(v, bits), f"{name}.high": high, f"{name}.ones": c, f"{name}.zeros": np.arange(len(c)) * 64 - c}

    @staticmethod
    def _pick(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the k-th set bit of each word: running bit counts of its bytes lead to a byte, a table into it."""
        c = word - ((word >> U(1)) & U(0x5555555555555555))
        c = (c & U(0x3333333333333333)) + ((c >> U(2)) & U(0x3333333333333333))
        c = ((c + (c >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * ONES
        k = k.astype(U)
        byte = np.bitwise_count(((k * ONES) | TOPS) - c & TOPS).astype(U) << U(3)
        rest = k - ((c << U(8)) >> byte & U(255))
        return (byte + SELECT[(rest << U(8)) | (word >> byte & U(255))]).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.ones, i, side="right") - 1
        place = w * 64 + self._pick(self.high[w], i - self.ones[w])
        return (place - i).astype(U) << U(self.bits) | self.lows[i]

    def ends(self, h: np.ndarray) -> np.ndarray:
        """Number of elements whose high part is at most h."""
        w = np.searchsorted(self.zeros, h, side="right") - 1
        w = np.minimum(w, len(self.high) - 1)
        return w * 64 + self._pick(~self.high[w], h - self.zeros[w]) - h

    def runs(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Elements [lo, hi) whose high part is h: the ones from the zero before them to the next zero."""
        lo = np.where(h > 0, self.ends(np.maximum(h - 1, 0)), 0)
        at = lo + h
        word, off = self.high[at >> 6], (at & 63).astype(U)
        rest = word >> off
        run = np.bitwise_count(rest & ~(rest + U(1))).astype(np.int64)
        hi = lo + run
        cross = np.flatnonzero(off.astype(np.int64) + run >= 64)  # the run goes on in the next word
        hi[cross] = self.ends(h[cross])
        return lo, hi

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x, -1 if it is not in the sequence: the successor in its high part's run is compared."""
        x = x.astype(U)
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        if self.top is None:
            self.top = int(self[np.array([self.n - 1])][0]) >> self.bits
        inside = np.flatnonzero(x >> U(self.bits) <= U(self.top))
        x = x[inside]
        lo, hi = self.runs((x >> U(self.bits)).astype(np.int64))
        want = x & U((1 << self.bits) - 1)
        at = successor(self.lows.__getitem__, lo, hi, want)
        ok = np.flatnonzero(at < hi)
        ok = ok[self.lows[at[ok]] == want[ok]]
        out[inside[ok]] = at[ok]
        return out


def successor(get, lo: np.ndarray, hi: np.ndarray, want: np.ndarray) -> np.ndarray:
    """First place in [lo, hi) whose value is at least ``want``, or hi - 1, for all queries at once.

    It is the only place that can hold ``want``; runs of one are not read.
    """
    lo, hi = lo.copy(), hi.copy()
    live = np.flatnonzero(hi - lo > 1)
    while len(live):
        low, high = lo[live], hi[live]
        mid = (low + high - 1) >> 1
        less = get(mid) < want[live]
        lo[live] = low = np.where(less, mid + 1, low)
        hi[live] = high = np.where(less, high, mid + 1)
        live = live[high - low > 1]
    return lo


class Counts:
    """Counts in a byte each, with a list of the few that are 255 or more."""

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.small, self.at, self.large = arrays["count.small"], arrays["count.at"], arrays["count.large"]

    @staticmethod
    def build(count: np.ndarray) -> dict[str, np.ndarray]:
        at = np.flatnonzero(count >= 255)
        return {"count.small": np.minimum(count, 255).astype(np.uint8), "count.at": at, "count.large": count[at].astype(np.int64)}

    def __len__(self) -> int:
        return len(self.small)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        out = self.small[i].astype(np.int64)
        big = np.flatnonzero(out == 255)
        out[big] = self.large[np.searchsorted(self.at, i[big])]
        return out


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file, renamed into place when whole, so that a repeated task does no harm."""
    fs, path = open_fs(uri)
    head, at = {}, 0
    for k, a in arrays.items():
        head[k] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 64) * 64
    top = json.dumps(head).encode()
    top += b" " * (-(len(top) + 8) % 64)
    new = f"{path}.{uuid.uuid4().hex}"
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(new) as f:
        f.write(len(top).to_bytes(8, "little") + top)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 64))
    fs.move(new, path)


def load(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory; from a remote store by a temporary copy without a name."""
    from pyarrow.fs import LocalFileSystem

    fs, path = open_fs(uri)
    if isinstance(fs, LocalFileSystem):
        raw = np.memmap(path, np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as f, fs.open_input_stream(path) as s:
            while part := s.read(1 << 24):
                f.write(part)
            f.flush()
            raw = np.memmap(f, np.uint8, "r")
    raw = raw.view(np.ndarray)  # plain slices of the map
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    return {k: raw[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for k, (kind, at, size) in head.items()}


def quantised(p: np.ndarray) -> np.ndarray:
    return np.rint(-np.log2(np.maximum(p, 2.0**-31)) * STEP).clip(0, 65535).astype(np.uint16)


def value(q: np.ndarray) -> np.ndarray:
    return np.exp2(-q.astype(np.float64) / STEP)


@dataclass(frozen=True)
class Level:
    """Where a level's segments are, and the first node of each (and of the end)."""

    uri: str
    n: int
    base: tuple[int, ...]

    def segment(self, s: int) -> dict:
        return _segment(f"{self.uri}/L{self.n}-{s}", self.n)

    def weights(self, s: int) -> np.ndarray:
        return _segment(f"{self.uri}/W{self.n}-{s}", 0)["weight"]

    @property
    def segments(self) -> int:
        return len(self.base) - 1

    def gather(self, node: np.ndarray, kind: str) -> np.ndarray:
        """Counts ('count') or context weights ('weight', quantised) of nodes."""
        base = np.array(self.base)
        out = np.zeros(len(node), np.int64)
        order, cuts = by_segment(np.searchsorted(base, node, side="right") - 1, self.segments)
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]):
            i = order[cuts[s] : cuts[s + 1]]
            out[i] = (self.weights(s) if kind == "weight" else self.segment(s)["count"])[node[i] - base[s]]
        return out

    def find(self, parent: np.ndarray | None, word: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """(node, count or quantised probability) of each query; -1 and 0 where there is none. Level 1 has no parents.

        Queries come sorted by parent, if they have one: each context is then sought once in a segment.
        """
        node, got = np.full(len(word), -1, np.int64), np.zeros(len(word), np.int64)
        order, cuts = by_segment(place(parent, word, self.segments), self.segments)
        for s in np.flatnonzero(cuts[1:] > cuts[:-1]):
            i = order[cuts[s] : cuts[s + 1]]
            seg = self.segment(s)
            if parent is None:
                at = seg["word"].find(word[i])
            else:
                at = np.full(len(i), -1, np.int64)
                above = parent[i]
                first = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
                ctx = seg["context"].find(above[first])
                known = np.flatnonzero(ctx >= 0)
                run = np.diff(np.append(first, len(i)))[known]
                q = np.repeat(first[known], run) + np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
                if len(q):
                    lo, hi = (np.repeat(seg["pointer"][ctx[known] + d].astype(np.int64), run) for d in (0, 1))
                    words, w = seg["last"], word[i[q]]
                    p = successor(words.__getitem__, lo, hi, w.astype(U))
                    ok = np.flatnonzero(p < hi)
                    ok = ok[words[p[ok]] == w[ok].astype(U)]
                    at[q[ok]] = p[ok]
            hit = at >= 0
            node[i[hit]] = at[hit] + self.base[s]
            got[i[hit]] = seg[kind][at[hit]]
        return node, got


@lru_cache(maxsize=4096)
def _segment(uri: str, n: int) -> dict:
    a = load(uri)
    if n == 1:
        return {"word": EliasFano(a, "word"), "count": a["count"]}
    if n > 1:
        return {"context": EliasFano(a, "context"), "pointer": EliasFano(a, "pointer"), "last": Packed(a["last"], int(a["bits"][0])), "p": a["p"], "count": Counts(a) if "count.small" in a else None}
    return a


def place(parent: np.ndarray | None, word: np.ndarray, segments: int) -> np.ndarray:
    """Segment of each n-gram, by a hash of all its words."""
    with np.errstate(over="ignore"):
        h = word.astype(U) if parent is None else mix64(parent.astype(U) * U(0x9E3779B97F4A7C15) + word.astype(U))
    return (mix64(h) % U(segments)).astype(np.int64)


def by_segment(seg: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(seg.astype(np.int16 if segments < 1 << 15 else np.int32), kind="stable")  # short numbers sort by radix
    return order, np.concatenate([[0], np.cumsum(np.bincount(seg, minlength=segments))])


def summed(blobs: list[bytes], columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct keys (all columns but the last) in order, and their summed last column."""
    parts = [unpack(b, columns) for b in blobs]
    cols = [np.concatenate([p[i] for p in parts]) for i in range(columns)]
    keys = [c.view(U) for c in cols[:-1]]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    total = np.add.reduceat(cols[-1][order], at) if len(at) else cols[-1]
    return [k[at] for k in keys], total


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts (n+1), codes of tokens, and the hash of each code; an end closes every text."""
    keep_large_arrays()
    starts, flat = words_of(lower_ascii(texts))
    coded = flat.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, SEED) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), U, len(coded.dictionary))
    with_end = starts + np.arange(len(starts))
    code = np.full(with_end[-1], len(h), np.int32)
    inner = np.ones(len(code), bool)
    inner[with_end[1:] - 1] = False
    code[inner] = coded.indices.to_numpy()
    return with_end, code, np.append(h, END)


def histories(levels: list[Level], starts: np.ndarray, code: np.ndarray, hashes: np.ndarray, top: int, min_count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1 .. top: (n, node of the n-gram that ends at each token or -1, its count or quantised p, its context's weight or -1)."""
    node, got = levels[0].find(None, hashes, "count")
    weight = np.full(len(hashes), -1, np.int32)
    if len(levels) > 1:
        weight[node >= 0] = levels[0].gather(node[node >= 0], "weight")
    last, given = node[code], weight[code]
    word, often = last, (got >= min_count)[code]
    yield 1, last, got[code], np.full(len(code), -1, np.int32)
    rank = (np.arange(len(code)) - np.repeat(starts[:-1], np.diff(starts))).astype(np.int32)
    for n in range(2, top + 1):
        before = np.full(len(code), -1, np.int32)
        before[1:] = given[:-1]
        before[rank < n - 1] = -1
        # A weight of 0 steps says that the context has no children; a rare word is nobody's child.
        live = np.flatnonzero((before > 0) & often)
        key = last[live - 1] * (levels[0].base[-1] + 1) + word[live]
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        parent, w = np.divmod(key[new], levels[0].base[-1] + 1)
        found, q = levels[n - 1].find(parent, w, "p")
        which = np.cumsum(new) - 1
        last, at = np.full(len(code), -1, np.int64), live[order]
        last[at] = found[which]
        p = np.zeros(len(code), np.uint16)
        p[at] = q[which]
        given = np.full(len(code), -1, np.int32)
        if n < len(levels):
            weight = np.full(len(found), -1, np.int32)
            weight[found >= 0] = levels[n - 1].gather(found[found >= 0], "weight")
            given[at] = weight[which]
        yield n, last, p, before


def _counted(docs: DataFrame, levels: list[Level], n: int, segments: int, min_count: int) -> DataFrame:
    """(seg, blob) of the n-grams of ``docs``: keys and counts, packed for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", (32 if n == 1 else 16 if n == 2 else 8) << 20):
            starts, code, hashes = tokens_of(b.column("text"))
            if n == 1:
                count = np.bincount(code, minlength=len(hashes))
                used = np.flatnonzero(count)
                used = used[np.argsort(hashes[used])]
                keys, count = [hashes[used].view(np.int64)], count[used]
                seg = place(None, hashes[used], segments)
            else:
                *_, (_, last, got, _) = histories(levels, starts, code, hashes, n - 1, min_count)
                word, most = last, levels[0].base[-1] + 1
                if n > 2:
                    node, got = levels[0].find(None, hashes, "count")
                    word, got = node[code], got[code]
                rank = np.arange(len(code)) - np.repeat(starts[:-1], np.diff(starts))
                often = got >= min_count
                # Both the n-gram's first and its last n - 1 words are nodes, and its words are frequent enough.
                i = np.flatnonzero((rank[1:] >= n - 1) & (last[:-1] >= 0) & (last[1:] >= 0) & often[1:] & (often[:-1] if n == 2 else True)) + 1
                key = np.sort(last[i - 1] * most + word[i])
                at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                count = np.diff(np.append(at, len(key)))
                parent, w = np.divmod(key[at], most)
                at = slice(None)
                keys = [parent[at], w[at]]
                seg = place(keys[0], keys[1], segments)
            order, cuts = by_segment(seg, segments)
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            blobs = [pack(*(k[order[cuts[s] : cuts[s + 1]]] for k in (*keys, count))) for s in full]
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["seg", "blob"])

    return docs.mapInArrow(run, "seg int, blob binary")


def train(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, text_col: str = "text") -> tuple[list[Level], int]:
    """The levels of a model of all texts, and the number of training tokens.

    Keys of a context and a word are one number, so nodes times words must stay below 2^63.

    Null texts count as empty; an empty text is one end. An empty table gives levels without nodes.
    """
    spark = docs.sparkSession
    uri = f"{shared_dir(spark).rstrip('/')}/lm-{uuid.uuid4().hex}"
    docs = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(LEAST, -(-size // SEGMENT))
    levels: list[Level] = []
    total = 0
    for n in range(1, order + 1):

        known = tuple(levels)

        def build(t: pa.Table) -> pa.Table:
            s = t["seg"][0].as_py()
            keys, count = summed(t["blob"].to_pylist(), 2 if n == 1 else 3)
            none = {"kind": pa.nulls(0, pa.string()), "seg": pa.nulls(0, pa.int32()), "n": pa.nulls(0, pa.int64()), "tokens": pa.nulls(0, pa.int64()), "blob": pa.nulls(0, pa.binary())}
            rows = pa.table(none).schema
            if n == 1:
                save(f"{uri}/L1-{s}", EliasFano.build(keys[0], "word") | {"count": count})
                save(f"{uri}/W1-{s}", {"weight": np.zeros(len(count), np.uint16)})
                return pa.Table.from_pylist([{"kind": "size", "seg": s, "n": len(count), "tokens": int(count.sum()), "blob": None}], rows)
            keep = count >= min_count
            parent, word, count = keys[0][keep].view(np.int64), keys[1][keep].view(np.int64), count[keep]
            whole = known[n - 2].gather(parent, "count")
            at = np.flatnonzero(np.diff(parent, prepend=-1))
            arrays = EliasFano.build(parent[at], "context") | EliasFano.build(np.append(at, len(parent)), "pointer")
            bits = int(known[0].base[-1]).bit_length()
            save(f"{uri}/L{n}-{s}", arrays | {"bits": np.array([bits]), "last": Packed.build(word, bits), "p": quantised((count - DISCOUNT) / np.maximum(whole, 1))} | (Counts.build(count) if n < order else {}))
            if n < order:  # only contexts have a weight
                save(f"{uri}/W{n}-{s}", {"weight": np.zeros(len(count), np.uint16)})
            out = [{"kind": "size", "seg": s, "n": len(count), "tokens": int(count.sum()), "blob": None}]
            if len(at):
                given = np.add.reduceat(count * 4 - int(4 * DISCOUNT), at)  # in quarters, whole numbers
                base = np.array(known[n - 2].base)
                of = np.searchsorted(base, parent[at], side="right") - 1
                o, cuts = by_segment(of, known[n - 2].segments)
                out += [{"kind": "given", "seg": int(c), "n": 0, "tokens": 0, "blob": pack(parent[at][o[cuts[c] : cuts[c + 1]]], given[o[cuts[c] : cuts[c + 1]]])} for c in np.flatnonzero(cuts[1:] > cuts[:-1])]
            return pa.Table.from_pylist(out, rows)

        made = cut(_counted(docs, levels, n, segments, min_count).groupBy("seg").applyInArrow(build, "kind string, seg int, n bigint, tokens bigint, blob binary"))
        sizes = {r["seg"]: (r["n"], r["tokens"]) for r in made.where("kind = 'size'").select("seg", "n", "tokens").collect()}
        total = total or sum(t for _, t in sizes.values())
        for s in set(range(segments)) - set(sizes):  # no n-gram fell there
            none = np.zeros(0, np.int64)
            save(f"{uri}/L{n}-{s}", EliasFano.build(none, "word") | EliasFano.build(none, "context") | EliasFano.build(np.zeros(1, np.int64), "pointer") | {"bits": np.zeros(1, np.int64), "last": Packed.build(none, 0), "p": none.astype(np.uint16), "count": none} | Counts.build(none))
            save(f"{uri}/W{n}-{s}", {"weight": none.astype(np.uint16)})
        levels.append(Level(uri, n, tuple(np.concatenate([[0], np.cumsum([sizes.get(s, (0, 0))[0] for s in range(segments)])]).tolist())))
        if n == 1:
            continue
        upper = levels[n - 2]

        def weigh(t: pa.Table) -> pa.Table:
            s = t["seg"][0].as_py()
            (node,), given = summed(t["blob"].to_pylist(), 2)
            seg = load(f"{upper.uri}/L{upper.n}-{s}")
            count = seg["count"] if upper.n == 1 else Counts(seg)
            weight = np.zeros(len(count), np.uint16)  # one, in steps
            i = node.view(np.int64) - upper.base[s]
            weight[i] = np.maximum(quantised(np.maximum(1 - given / 4 / count[i], 2.0**-31)), 1)
            save(f"{upper.uri}/W{upper.n}-{s}", {"weight": weight})
            return pa.table({"seg": pa.array([s], pa.int32())})

        made.where("kind = 'given'").select("seg", "blob").groupBy("seg").applyInArrow(weigh, "seg int").count()
        _segment.cache_clear()
    return levels, total


def scores(docs: DataFrame, levels: list[Level], total: int, min_count: int = MIN_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for every row: add-one unigrams, and the model.

    Null texts count as empty: one end. Rows are kept, a row for a row.
    """
    workers_find_us(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    floor = total + levels[0].base[-1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            starts, code, hashes = tokens_of(b.column("text"))
            for n, node, got, before in histories(levels, starts, code, hashes, len(levels), min_count):
                if n == 1:
                    count, p = got, (got + 1) / floor
                    base = np.log10(p)
                    continue
                live = np.flatnonzero(before > 0)
                p[live] *= value(before[live])
                seen = np.flatnonzero(node >= 0)
                p[seen] += value(got[seen])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(starts)), pa.array(row_sums(count > 0, starts)), pa.array(row_sums(base, starts)), pa.array(row_sums(np.log10(p), starts))], ["id", "n_tokens", "n_known", "base_score", "score"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens bigint, n_known bigint, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 7) == 2
    levels, total = train(docs.where(~held))
    out = scores(docs, levels, total)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op8_lm": op8_lm}
SQL: dict[str, str] = {}
