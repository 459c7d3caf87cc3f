"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces' UTF-8 bytes drives one pass over the text. At each position the
output links give every piece that ends there, longest first, and each relaxes the best score of that position
from the score where it starts; the best path is read back. For a unigram model the score is the sum of piece
scores, as its Viterbi has it. For a BPE model a step from one piece to the next counts only if merging would
keep that pair apart, which leaves exactly one path: the merges' own result.

No piece holds a space marker after another character, so a text falls into parts at those places that are
segmented independently. Distinct parts of a block are segmented once, side by side in numpy, and their pieces
are gathered into the documents' ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import blocks, read, workers_find_us

SPACE = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Fields of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[i : i + n]
            i += n


class Codec:
    """Encoder and decoder for one model file; unigram and BPE models with identity normalization."""

    def __init__(self, path: str) -> None:
        pieces: list[tuple[bytes, float, int]] = []
        self.bpe, self.byte_fallback, self.prefix = False, False, True
        squeeze = True
        with open(path, "rb") as f:
            model = f.read()
        for k, v in _fields(model):
            if k == 1:
                p = dict(_fields(v))
                pieces.append((p[1], struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0], p.get(3, NORMAL)))
            elif k == 2:
                spec = dict(_fields(v))
                if spec.get(3, 1) not in (1, 2):
                    raise ValueError("neither a unigram nor a BPE model")
                self.bpe, self.byte_fallback = spec.get(3, 1) == 2, bool(spec.get(35, 0))
            elif k == 3:
                spec = dict(_fields(v))
                if spec.get(2):
                    raise ValueError("the model normalizes characters; only identity normalization is read here")
                self.prefix, squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if squeeze or any(t == USER for *_, t in pieces):
            raise ValueError("models that drop white space or define user symbols are not read here")
        self.size = len(pieces)
        self.unk = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte_ids = np.full(256, self.unk, np.int32)
        for i, (s, _, t) in enumerate(pieces):
            if t == BYTE:
                self.byte_ids[int(s[3:5], 16)] = i
        self.score = np.array([s for _, s, _ in pieces])
        self.text = [p if t == NORMAL else b"" for p, _, t in pieces]
        self.independent = all(SPACE not in p.lstrip(SPACE) and b"\n" not in p for p in self.text)
        self.length = np.array([len(p) for p in self.text], np.int32)
        self._automaton()
        if self.bpe:
            self._merges()
        # What a piece decodes to, as one buffer with offsets; control pieces decode to nothing.
        surface = [bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(SPACE, b" ") if t == NORMAL else " ⁇ ".encode() if t == UNKNOWN else b"" for p, _, t in pieces]
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surface])]).astype(np.int64)
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    def _automaton(self) -> None:
        """Dense transitions, the piece that ends at each state, and links to the next shorter piece that does."""
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for i, p in enumerate(self.text):
            s = 0
            for b in p:
                if b not in children[s]:
                    children[s][b] = len(children)
                    children.append({})
                    piece.append(-1)
                s = children[s][b]
            if p:
                piece[s] = i
        n = len(children)
        self.piece = np.array(piece, np.int32)
        self.goto = np.zeros((n, 256), np.int32)
        self.link = np.zeros(n, np.int32)
        fail = np.zeros(n, np.int32)
        level = np.zeros(1, np.int64)
        while len(level):
            edges = [(s, b, c) for s in level.tolist() for b, c in children[s].items()]
            if not edges:
                break
            s, b, c = np.array(edges).T
            fail[c] = np.where(s == 0, 0, self.goto[fail[s], b])
            self.link[c] = np.where(self.piece[fail[c]] >= 0, fail[c], self.link[fail[c]])
            self.goto[s, b] = c
            self.goto[c] = self.goto[fail[c]]
            level = c
        self.first = np.where(self.piece >= 0, np.arange(n), self.link).astype(np.int32)

    def _merges(self) -> None:
        """Rank of each piece (characters first, then merges by score), and the last merge that makes it."""
        known = {p: i for i, p in enumerate(self.text) if p}
        single = np.array([bool(p) and len(p.decode()) == 1 for p in self.text])
        order = sorted((i for p, i in known.items()), key=lambda i: (not single[i], -self.score[i], i))
        self.rank = np.full(self.size, self.size, np.int64)
        self.rank[order] = np.arange(len(order))
        by_rank = np.array(order)
        n = len(order)
        left, right = np.arange(n), np.arange(n)
        pair: dict[int, int] = {}
        alive = single[by_rank].copy()

        def valid(a: int, b: int) -> bool:
            limit = n
            while True:
                c = pair.get(a * n + b)
                if c is not None and c < limit:
                    return False
                if a > b:
                    limit = a
                    a = right[a]
                    if a == limit:
                        limit = b + 1
                        b = left[b]
                        if b + 1 == limit:
                            return True
                else:
                    limit = b + 1
                    b = left[b]
                    if b + 1 == limit:
                        limit = a
                        a = right[a]
                        if a == limit:
                            return True

        for r in range(int(single.sum()), n):
            p = self.text[by_rank[r]]
            for k in range(len(p) - 1, 0, -1):
                a, b = known.get(p[:k]), known.get(p[k:])
                if a is None or b is None:
                    continue
                a, b = int(self.rank[a]), int(self.rank[b])
                if a < r and b < r and alive[a] and alive[b] and valid(a, b):
                    pair[a * n + b] = r
                    left[r], right[r], alive[r] = a, b, True
                    break
        self.n, self.left, self.right = n, left, right
        self.alive = np.zeros(self.size, bool)
        self.alive[by_rank[alive]] = True
        self.pair_keys = np.array(sorted(pair), np.int64)
        self.pair_rank = np.array([pair[k] for k in self.pair_keys.tolist()], np.int64)

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps pieces a and b, side by side, apart."""
        a, b, n = self.rank[a], self.rank[b], self.n
        out = np.zeros(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), n)
        while len(at):
            key = a * n + b
            k = np.searchsorted(self.pair_keys, key).clip(max=len(self.pair_keys) - 1)
            clash = (self.pair_keys[k] == key) & (self.pair_rank[k] < limit)
            down = a > b
            # First the piece of higher rank is taken apart, then the other one.
            la = np.where(down, a, b + 1)
            na, nb = np.where(down, self.right[a], a), np.where(down, b, self.left[b])
            stuck = np.where(down, na == la, nb + 1 == la)
            lb = np.where(down, b + 1, a)
            mb, ma = np.where(stuck & down, self.left[b], nb), np.where(stuck & ~down, self.right[a], na)
            done = stuck & np.where(down, mb + 1 == lb, ma == lb)
            limit = np.where(stuck, lb, la)
            out[at[done & ~clash]] = True
            live = ~done & ~clash
            at, a, b, limit = at[live], ma[live], mb[live], limit[live]
        return out

    def _parts(self, data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of many parts of like length: counts, and flat ids. Longest parts first, one step a byte."""
        most = int(n.max())
        w = len(n)
        back = np.full((w, most + 1), -1, np.int32)  # the piece that ends there; -2 a character without a piece
        best = np.full((w, most + 1), -np.inf)
        best[:, 0] = 0
        unknown = float(self.score.min()) - 10
        state = np.zeros(w, np.int32)
        begin = np.zeros(w, np.int64)  # where the current character starts
        live = np.searchsorted(-n, -np.arange(1, most + 1), side="right")
        for i in range(1, most + 1):
            m = live[i - 1]
            byte = data[at[:m] + i - 1]
            state[:m] = self.goto[state[:m], byte]
            nxt = np.where(n[:m] > i, data[np.minimum(at[:m] + i, len(data) - 1)], 0)
            rows = np.flatnonzero((nxt & 0xC0) != 0x80)  # a character ends here
            own = np.zeros(m, bool)
            cand, r = self.first[state[rows]], rows
            while len(r):
                live_c = cand > 0
                r, cand = r[live_c], cand[live_c]
                p = self.piece[cand]
                j = i - self.length[p]
                own[r[j == begin[r]]] = True
                if self.bpe:
                    ok = self.alive[p] & (best[r, j] > -np.inf)
                    prev = back[r, j]
                    test = ok & (prev >= 0)
                    ok[test] = self._apart(prev[test], p[test])
                    back[r[ok], i] = p[ok]
                    best[r[ok], i] = 0
                    r, cand = r[~ok], cand[~ok]  # the path is unique
                else:
                    s = best[r, j] + self.score[p]
                    ok = s > best[r, i]
                    back[r[ok], i] = p[ok]
                    best[r[ok], i] = s[ok]
                cand = self.link[cand]
            lone = rows[~own[rows]]
            s = best[lone, begin[lone]] + (0 if self.bpe else unknown)
            ok = s > best[lone, i]
            back[lone[ok], i] = -2
            best[lone[ok], i] = s[ok]
            begin[rows] = i
        ids, who = [], []
        pos, r = n.copy(), np.arange(w)
        while len(r):
            p = back[r, pos[r]]
            piece = p >= 0
            if self.byte_fallback:
                ids.append(np.where(piece, p, self.byte_ids[data[at[r] + pos[r] - 1]]))
                who.append(r)
            else:
                ids.append(np.where(piece, p, self.unk)[p != -1])
                who.append(r[p != -1])
            pos[r] -= np.where(piece, self.length[p], 1)
            r = r[pos[r] > 0]
        ids, who = np.concatenate(ids[::-1]), np.concatenate(who[::-1])
        order = np.argsort(who, kind="stable")
        return np.bincount(who, minlength=w), ids[order].astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Row starts (n+1) and flat ids; null and empty texts have none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pc.replace_substring(texts, " ", "▁")
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("▁", texts, ""))))
        raw = texts.cast(pa.large_binary())
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        if not len(data):
            return np.zeros(len(raw) + 1, np.int64), np.zeros(0, np.int32)
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        if self.independent:
            mark = np.zeros(len(data), bool)
            mark[:-2] = (data[:-2] == SPACE[0]) & (data[1:-1] == SPACE[1]) & (data[2:] == SPACE[2])
            after = np.zeros(len(data), bool)
            after[3:] = mark[:-3]
            cut[:-1] |= mark & ~after
            line = data == 10
            cut[:-1] |= line
            cut[1:] |= line
        at = np.flatnonzero(cut)
        parts = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        flat = coded.dictionary
        doff = np.frombuffer(flat.buffers()[1], np.int64)[: len(flat) + 1]
        ddata, n = np.frombuffer(flat.buffers()[2], np.uint8), np.diff(doff)
        order = np.argsort(-n, kind="stable")
        count, made = np.zeros(len(flat), np.int64), []
        i = 0
        while i < len(order):  # parts of like length, in tables of bounded size
            top = int(n[order[i]])
            j = i + max(1, min((1 << 20) // (top + 1), 1 << 16))
            j = min(j, int(np.searchsorted(-n[order], -(top // 2), side="right"))) if top > 16 else j
            part = order[i : max(j, i + 1)]
            count[part], ids = self._parts(ddata, doff[part], n[part])
            made.append(ids)
            i += len(part)
        ids = np.concatenate(made)
        begin = np.zeros(len(flat), np.int64)
        begin[order] = np.concatenate([[0], np.cumsum(count[order])])[:-1]
        code = coded.indices.to_numpy()
        total = np.concatenate([[0], np.cumsum(count[code])])
        out = ids[np.repeat(begin[code] - total[:-1], count[code]) + np.arange(total[-1])]
        return total[np.searchsorted(at, offsets)], out

    def decode(self, starts: np.ndarray, ids: np.ndarray) -> pa.Array:
        """Texts as bytes, without the space that encoding puts before them."""
        n = np.diff(self.surface_at)[ids]
        total = np.concatenate([[0], np.cumsum(n)])
        data = self.surface[np.repeat(self.surface_at[ids] - total[:-1], n) + np.arange(total[-1])]
        at = total[starts]
        if self.prefix:
            lead = np.zeros(len(at) - 1, bool)
            full = at[1:] > at[:-1]
            lead[full] = data[at[:-1][full]] == 32
            keep = np.ones(len(data), bool)
            keep[at[:-1][lead]] = False
            data, at = data[keep], at - np.concatenate([[0], np.cumsum(lead)])
        return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` plus ids array<int>, n_tokens and round_trip (decoding gives the text back), a row for a row.

    A null or empty text has no ids and round-trips as empty. A text that itself holds the space marker
    decodes to a space there, and round_trip is false. Columns named like the added ones are replaced.
    ``model`` is the file's path on every executor; texts are whole.
    """
    workers_find_us(docs.sparkSession)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "n_tokens", "round_trip")])
    schema = docs.limit(0).withColumns({"ids": F.lit(None).cast("array<int>"), "n_tokens": F.lit(None).cast("long"), "round_trip": F.lit(None).cast("boolean")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in blocks(batches, text_col, 2 << 20):
            texts = pc.fill_null(b.column(text_col), "")
            starts, ids = c.encode(texts)
            same = pc.equal(c.decode(starts, ids), texts.cast(pa.large_binary()))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(np.diff(starts)), same], [*b.schema.names, "ids", "n_tokens", "round_trip"])

    return docs.mapInArrow(run, schema)


def decoded(rows: DataFrame, model: str, ids_col: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with ``into`` set to the text that ``ids_col`` decodes to; null ids give the empty text."""
    workers_find_us(rows.sparkSession)
    rows = rows.drop(into)
    schema = rows.limit(0).withColumn(into, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for b in batches:
            lists = b.column(ids_col)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy().astype(np.int32) if n.sum() else np.zeros(0, np.int32)
            raw = c.decode(np.concatenate([[0], np.cumsum(n)]), flat)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.decode("utf-8", "replace") for x in raw.to_pylist()], pa.string())], [*b.schema.names, into])

    return rows.mapInArrow(run, schema)


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "round_trip", "ids")


QUERIES = {"op1_pieces": op1_pieces}
SQL: dict[str, str] = {}
