"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line gets shape features of its own and of its neighbours; the field labels it good or bad. Documents
are marked as a whole, so in training each line takes its document's label. A document's raw quality is the mean of
its lines' forward-backward marginals, weighted by length; a logistic map of its logit, fitted on the training
sample, makes it a probability. Texts alone make a score: labels, languages, sources and ids are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import blocks, crc_mod, read, words_of, workers_find_us

#: Labelled documents that the field is fitted on at most, whole, taken by a hash of the id.
SAMPLE = 4000
#: Lines over which the likelihood is summed at once in training: a longer document counts as several chains. Features
#: of neighbours cross their ends, and scoring runs over whole documents.
CHAIN = 48

_CLASS = np.zeros(256, np.int64)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b".,;:?'\"()-", b"!", b"#$%&*", b"|<>{}[]/\\=_~^`@+"), 1):
    for _c in _set:
        _CLASS[_c] = _i
_CLASS[0xC0:] = 9  # first byte of a character past ASCII
CLASSES = 10
#: Bytes of text that a worker takes at once.
BLOCK = 2 << 20
OWN = 16


def line_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts (n+1), features (lines, OWN) and lengths in characters; a null or empty text is one empty line."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    starts = lists.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    raw = pc.binary_length(lines).to_numpy().astype(np.int64)
    at = np.concatenate([[0], np.cumsum(raw)])
    flat = lines.cast(pa.large_binary())
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = data[offsets[0] : offsets[-1]]
    n = np.zeros((len(lines), CLASSES))
    i = 0
    while i < len(lines):  # bounded runs of bytes, a long line whole
        j = max(i + 1, int(np.searchsorted(at, at[i] + (1 << 20), side="right")) - 1)
        row = np.repeat(np.arange(j - i), raw[i:j])
        n[i:j] = np.bincount(row * CLASSES + _CLASS[data[at[i] : at[j]]], minlength=(j - i) * CLASSES).reshape(-1, CLASSES)
        i = j
    chars = pc.utf8_length(lines).to_numpy().astype(np.float64)
    wstart, words = words_of(lines)
    count = np.diff(wstart).astype(float)
    # Distinct words of a line, and words that equal the one before.
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.zeros(0, np.int64)
    line = np.repeat(np.arange(len(lines)), np.diff(wstart))
    pair = np.unique(line * (code.max(initial=0) + 1) + code)
    distinct = np.bincount(pair // (code.max(initial=0) + 1), minlength=len(lines)).astype(float)
    again = np.bincount(line[1:][(code[1:] == code[:-1]) & (line[1:] == line[:-1])], minlength=len(lines)).astype(float)
    # Lines that stand more than once in their document.
    lcode = lines.dictionary_encode().indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    _, inv, times = np.unique(doc * (lcode.max(initial=0) + 1) + lcode, return_inverse=True, return_counts=True)
    repeated = (times[inv] > 1) & (chars > 0)
    size, w = np.maximum(chars, 1), np.maximum(count, 1)
    letters = np.maximum(n[:, 1] + n[:, 2] + n[:, 9], 1)
    x = np.column_stack([
        np.log1p(chars) / 8, np.log1p(count) / 6, (n[:, 1] + n[:, 2] + n[:, 9]) / size, n[:, 2] / letters, n[:, 3] / size,
        n[:, 5] / size * 5, np.minimum(n[:, 6] / w, 1) * 2, np.minimum(n[:, 7] / w, 1) * 2, np.minimum(n[:, 8] / w, 1) * 2, n[:, 0] / size,
        np.minimum(n[:, 1:].sum(axis=1) / w / 10, 3), np.where(count > 4, distinct / w, 1), again / w * 2, repeated.astype(float), (chars == 0).astype(float),
        np.where(count > 4, (distinct / w) < 0.35, 0.0),
    ])
    return starts, x, chars + 1


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at a text's ends), marks of the ends, and 1."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    start = np.zeros(len(x), bool)
    start[first[first < len(x)]] = True
    end = np.append(start[1:], True)
    before[start] = 0
    after[end] = 0
    return np.column_stack([x, before, after, start, end, np.ones(len(x))])


@dataclass(frozen=True)
class Field:
    """Weights of a line's good label, transition scores (from, to), and the map of a document's logit."""

    w: np.ndarray
    t: np.ndarray
    slope: float = 1.0
    shift: float = 0.0


def chains(starts: np.ndarray, most: int) -> np.ndarray:
    """Cut rows into chains of at most ``most`` lines: starts (m+1)."""
    return np.unique(np.concatenate([np.concatenate([np.arange(s, e, most) for s, e in zip(starts, starts[1:], strict=False)] or [[0]]), starts[-1:]])).astype(np.int64)


def _soft(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(e: np.ndarray, starts: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line good), and summed pair marginals (2, 2), by forward-backward over all chains at once, longest first."""
    n = np.diff(starts)
    order = np.argsort(-n, kind="stable")
    s, n = starts[:-1][order], n[order]
    fwd, bwd = np.zeros((len(e), 2)), np.zeros((len(e), 2))
    live = np.searchsorted(-n, -np.arange(1, n[0] + 1 if len(n) else 1), side="right") if len(n) else []
    fwd[s, 1] = e[s]
    for k in range(1, len(live)):
        i = s[: live[k]] + k
        p = fwd[i - 1]
        for y in (0, 1):
            fwd[i, y] = _soft(p[:, 0] + t[0, y], p[:, 1] + t[1, y]) + (e[i] if y else 0)
    for k in range(len(live) - 1, 0, -1):
        i = s[: live[k]] + k
        nxt = bwd[i] + np.column_stack([np.zeros(len(i)), e[i]])
        for y in (0, 1):
            bwd[i - 1, y] = _soft(nxt[:, 0] + t[y, 0], nxt[:, 1] + t[y, 1])
    both = fwd + bwd
    z = _soft(both[:, 0], both[:, 1])
    pairs = np.zeros((2, 2))
    inner = np.ones(len(e), bool)
    inner[s] = False
    i = np.flatnonzero(inner)
    nxt = bwd[i] + np.column_stack([np.zeros(len(i)), e[i]])
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = np.exp(fwd[i - 1, a] + t[a, b] + nxt[:, b] - z[i]).sum()
    return np.exp(both[:, 1] - z), pairs


def document_logits(field: Field, starts: np.ndarray, x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Logit of the length-weighted mean marginal of each text."""
    p, _ = marginals(with_neighbours(x, starts[:-1]) @ field.w, starts, field.t)
    mean = np.add.reduceat(p * length, starts[:-1]) / np.add.reduceat(length, starts[:-1])
    mean = mean.clip(1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def fit(starts: np.ndarray, x: np.ndarray, length: np.ndarray, y: np.ndarray, steps: int = 250, ridge: float = 1e-3, rate: float = 0.08) -> Field:
    """Maximum likelihood of the labels, a ridge on every weight, by Adam over the whole sample."""
    f = with_neighbours(x, starts[:-1])
    cut_at = chains(starts, CHAIN)
    gold = np.repeat(y.astype(float), np.diff(starts))
    inner = np.ones(len(x), bool)
    inner[cut_at[:-1]] = False
    same = np.array([(inner & (gold == 0)).sum(), (inner & (gold == 1)).sum()], float)
    theta, m, v = np.zeros(f.shape[1] + 4), 0.0, 0.0
    for k in range(1, steps + 1):
        t = theta[-4:].reshape(2, 2)
        p, pairs = marginals(f @ theta[:-4], cut_at, t)
        grad = np.concatenate([f.T @ (p - gold), (pairs - np.diag(same)).ravel()]) / len(x) + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    field = Field(theta[:-4], theta[-4:].reshape(2, 2))
    z = document_logits(field, starts, x, length)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps of a ridged logistic regression
        p = 1 / (1 + np.exp(-(a * z + b)))
        r, h = p - y, p * (1 - p)
        g = np.array([r @ z + 0.1 * (a - 1), r.sum()])
        hess = np.array([[h @ z**2 + 0.1, h @ z], [h @ z, h.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, g)
    return Field(field.w, field.t, float(max(a, 0.05)), float(b))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit on at most ``sample`` labelled documents, taken by a hash of their ids; features are made on the executors.

    Null ids, null labels and labels other than 0 and 1 are not used. Without any of one label there is
    nothing to learn: then every text scores 0.5.
    """
    workers_find_us(docs.sparkSession)
    chosen = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("_id is not null").groupBy("_id").agg(F.min("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id").select("_id", "y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            starts, x, length = line_table(b.column("text"))
            parts = [np.column_stack([x[s:e], length[s:e]]) for s, e in zip(starts, starts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("y"), pa.array([p.astype(np.float32).ravel() for p in parts], pa.list_(pa.float32()))], ["id", "y", "x"])

    got = rows.mapInArrow(run, f"id {rows.schema['_id'].dataType.simpleString()}, y int, x array<float>").toArrow()
    got = got.sort_by("id")
    width, y = OWN + 1, got["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return Field(np.zeros(3 * OWN + 3), np.zeros((2, 2)), 1.0, 0.0)
    n = pc.list_value_length(got["x"]).to_numpy() // width
    flat = pc.list_flatten(got["x"]).to_numpy().astype(np.float64).reshape(-1, width)
    return fit(np.concatenate([[0], np.cumsum(n)]).astype(np.int64), flat[:, :-1], flat[:, -1], y)


def scored(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row, by the whole text. Null texts score as empty ones; a row for a row."""
    workers_find_us(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            z = field.slope * document_logits(field, *line_table(b.column("text"))) + field.shift
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(1 / (1 + np.exp(-z.clip(-500, 500))))], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def quality_filter(docs: DataFrame, field: Field, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with their columns, whose text scores ``least`` or more."""
    workers_find_us(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text_col, BLOCK):
            z = field.slope * document_logits(field, *line_table(b.column(text_col))) + field.shift
            yield b.filter(pa.array(1 / (1 + np.exp(-z.clip(-500, 500))) >= least))

    return docs.mapInArrow(run, docs.schema).select(*names)


def learnable(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels outside the held-out third."""
    return labels.where(crc_mod(id_col, 3) != 1)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = train(docs, learnable(read(spark, sf_dir, "labels")))
    out = scored(docs, field)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_quality": op6_quality}
SQL: dict[str, str] = {}
