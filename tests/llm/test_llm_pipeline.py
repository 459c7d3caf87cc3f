"""The pipeline's rows against a plain re-computation, document by document, and the operators' SQL."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

import corpus_pipeline
from facetry.llm import op6_quality, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def score(field, text):
    """Forward-backward over one document, line by line."""
    starts, x, length = op6_quality.line_table(pa.array([text or ""]))
    f = op6_quality.with_neighbours(x, starts[:-1])
    e = [(0.0, float(v)) for v in f @ field.w]
    fwd, bwd = [e[0]], [(0.0, 0.0)]
    for k in range(1, len(e)):
        fwd.append(tuple(np.logaddexp(fwd[-1][0] + field.t[0, y], fwd[-1][1] + field.t[1, y]) + e[k][y] for y in (0, 1)))
    for k in range(len(e) - 1, 0, -1):
        bwd.append(tuple(np.logaddexp(field.t[y, 0] + e[k][0] + bwd[-1][0], field.t[y, 1] + e[k][1] + bwd[-1][1]) for y in (0, 1)))
    bwd = bwd[::-1]
    p = [1 / (1 + math.exp(min(700.0, a[0] + b[0] - a[1] - b[1]))) for a, b in zip(fwd, bwd, strict=True)]
    mean = min(max(sum(q * n for q, n in zip(p, length, strict=True)) / sum(length), 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(field.slope * math.log(mean / (1 - mean)) + field.shift)))


def without_lines(docs):
    real = lambda line: re.sub("[\t-\r]", "", line).strip(" ") != ""
    sites = defaultdict(set)
    for d in docs:
        for line in (d["text"] or "").split("\n") if d["text"] is not None else []:
            if real(line) and d["source"] is not None:
                sites[line].add(d["source"])
    out = []
    for d in docs:
        if d["text"] is not None:
            lines = d["text"].split("\n")
            bad = [real(x) and len(sites[x]) >= 5 for x in lines]
            if any(bad) and sum(bad) < sum(real(x) for x in lines):
                text = "\n".join(x for x, b in zip(lines, bad, strict=True) if not b)
                d = d | {"text": text, "n_chars": len(text)}
        out.append(d | {"n_chars": None if d["text"] is None else len(d["text"])})
    return out


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def one_of_each_group(docs):
    docs = sorted(docs, key=lambda d: d["doc_id"])
    sets = [shingles(d["text"]) for d in docs]
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i + 1, len(docs)):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [d for i, d in enumerate(docs) if top(i) == i]


def mixed(docs):
    size = Counter()
    for d in docs:
        size[d["source"]] += len(words(d["text"]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / whole > 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over} if over else {s: left * weight[s] / whole for s in open_}
        left -= sum(3.0 * size[s] for s in over)
        open_ = open_ - over if over else set()
    out = []
    for s in order:
        own = sorted((d for d in docs if d["source"] == s), key=lambda d: (hashlib.md5(str(d["doc_id"]).encode()).hexdigest(), d["doc_id"]))
        at = 0
        for _ in range(3):
            for d in own:
                n = len(words(d["text"]))
                if n and at + n / 2 <= target[s]:
                    out.append(d)
                at += n
    return out


def test_rows_equal_a_plain_computation(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    field = op6_quality.train(docs, op6_quality.learnable(spark.read.parquet(f"{SF}/labels.parquet")))
    rows = [r.asDict() for r in docs.collect()]
    want = mixed(one_of_each_group(without_lines([d for d in rows if score(field, d["text"]) >= 0.5])))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    expected = Counter((*[d[c] for c in names], tuple(sp.encode(d["text"] or ""))) for d in want)
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) > 50 and Counter((*[r[c] for c in names], tuple(r["ids"])) for r in got) == expected


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), db.sql(queries.SQL[name]).df()
    plain = lambda df: sorted(tuple("" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].astype(object).values.tolist())
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
