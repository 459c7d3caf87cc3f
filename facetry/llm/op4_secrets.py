"""Secret scans: base patterns plus an assignment-aware lexer with constant propagation.

The lexer reads a text as source or configuration syntax and makes (name, literal) pairs from ``name = "x"``,
``name: x``, ``"name": "x"``, ``name => x``, ``<name>x</name>``, ``obj["name"] = x``, ``f(name=x)`` and
``export NAME=x``. A value may be a quoted literal, a joined sequence of literals, a bare word, or another
name; names are resolved through the constants assigned so far, so ``k = "..."; password = k`` marks the
literal where it stands. A pair's score is the sensitivity of its name times the plausibility of its literal.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import blocks, read, workers_find_us

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: RE2 supersets of the patterns: texts that match none hold no span of that kind.
SIFT = {"assign": r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]""", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}
#: Parts of a name and how sensitive they make it.
NAMES = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 0.9, "secret": 1.0, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "credential": 0.8, "credentials": 0.8, "token": 0.9, "bearer": 0.8, "authkey": 0.9, "connectionstring": 0.7}
#: Words of a name are joined over whatever stands between them on its line, so a mark may stand between any two letters.
SIFT["lexed"] = "(?i)(" + "|".join(r"[^A-Za-z0-9\n]*".join(n) for n in NAMES) + ")"
PLACEHOLDER = re.compile(r"(?i)^(none|null|nil|true|false|undefined|changeme|example|placeholder|redacted|your[-_ ]?.*|x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|todo|test|password|secret|token|str|string|int|bytes|optional)$")
LEX = re.compile(
    r"""(?P<str>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)|(?P<tag><(?P<tname>[A-Za-z_][\w.:-]*+)[^<>\n]*+>(?P<tval>[^<>\n]*+)</)|(?P<name>[A-Za-z_$][\w$]*(?:[.-][A-Za-z_$][\w$]*)*)|(?P<op>:=|=>|==|!=|<=|>=|[=:])|(?P<num>\d[\w.+/-]*)|(?P<nl>\n)|(?P<open>[\[({,;+])|(?P<close>[\])}])|(?P<word>(?:\\["'`]|[^\s"'`\[\](){},;])+)""",
)
BARE = re.compile(r"[^\s\"'`,;(){}\[\]]+")


def sensitivity(name: str) -> float:
    """The most sensitive part of a name, its words taken apart at case changes and marks."""
    words = [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]
    joined = [*words, *("".join(words[i : i + 2]) for i in range(len(words) - 1)), "".join(words)]
    return max((NAMES.get(w.removesuffix("s") if w not in NAMES else w, 0.0) for w in joined), default=0.0)


def plausibility(literal: str) -> float:
    """0 for what can't be a secret, else up to 1 by length, entropy and mixture of character kinds."""
    if len(literal) < 8 or PLACEHOLDER.match(literal) or " " in literal.strip():
        return 0.0
    counts = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    kinds = sum(bool(re.search(p, literal)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z\d]"))
    return min(1.0, entropy / 4) * (0.5 + 0.5 * (kinds > 1))


def lexed(text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
    """(start, end, score) of literals, without their quotes, that reach a sensitive name with at least this score."""
    found: dict[tuple[int, int], float] = {}
    # A value is its own literals and the values of the names in it, so that sums of names grow no lists.
    values: list[tuple[list[tuple[int, int]], list[int]]] = []
    reached: list[float] = []
    known: dict[str, int] = {}

    def bind(name: str, spans: list[tuple[int, int]], parts: list[int]) -> None:
        known[name] = len(values)
        values.append((spans, parts))
        reached.append(0.0)
        s, to = sensitivity(name), [known[name]]
        while to:
            if reached[at := to.pop()] >= s:
                continue
            reached[at] = s
            for a, b in values[at][0]:
                if (score := s * plausibility(text[a:b])) >= least:
                    found[a, b] = max(score, found.get((a, b), 0))
            to += values[at][1]

    tokens = [m for m in LEX.finditer(text)]
    k, begin, bare, inside = 0, 0, 0, 0  # the last bare word's start and end, and its last token
    while k < len(tokens):
        m = tokens[k]
        if m.lastgroup == "tag" or m["tag"]:
            bind(m["tname"], [m.span("tval")], [])
        name = m["name"] or (m["str"][1:-1] if m["str"] else None)
        at = k + 1
        while name and at < len(tokens) and tokens[at]["close"]:  # obj["name"] = x
            at += 1
        if name and at < len(tokens) and (op := tokens[at]["op"]) in ("=", ":", ":=", "=>"):
            spans: list[tuple[int, int]] = []
            parts: list[int] = []
            at += 1
            typed = op == ":"
            while at < len(tokens):
                v = tokens[at]
                if v["str"]:
                    spans.append((v.start() + 1, v.end() - 1))
                elif v["name"] and v["name"] in known:
                    parts.append(known[v["name"]])
                elif typed and v["name"] and at + 1 < len(tokens) and tokens[at + 1]["op"] == "=":  # name: type = value
                    at, typed = at + 2, False
                    continue
                elif v["nl"] or v["close"]:
                    break
                elif not v["open"] and (begin <= v.start() < bare or (w := BARE.match(text, v.start()))):
                    if not begin <= v.start() < bare:
                        (begin, bare), inside = w.span(), at
                        while inside + 1 < len(tokens) and tokens[inside + 1].start() < bare:
                            inside += 1
                    spans.append((v.start(), bare))
                    at = inside
                if at + 1 < len(tokens) and (tokens[at + 1]["open"] == "+" or tokens[at + 1]["str"] and v["str"]):
                    at += 1 + (tokens[at + 1]["open"] == "+")  # a sum, or literals side by side
                    continue
                break
            if spans or parts:
                bind(name, spans, parts)
            k = max(k + 1, at if not (at < len(tokens) and tokens[at]["name"]) else min(at, k + 1))
            continue
        k += 1
    return [(a, b, s) for (a, b), s in sorted(found.items())]


def scan(text: str, maybe: tuple[bool, bool, bool, bool] = (True,) * 4) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then in the order of KINDS."""
    spans: list[tuple[str, int, int]] = []
    if maybe[0]:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if maybe[1]:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if maybe[2]:
        spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if maybe[3]:
        spans += [("lexed", a, b) for a, b, _ in lexed(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) for every row of ``docs``.

    A null text counts as empty and has no spans. Null ids and repeated rows are kept, a row for a row; other
    columns are not read. Each text is scanned whole; RE2 first sifts out those that can't hold a kind.
    """
    workers_find_us(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in blocks(batches, "text"):
            texts = b.column("text")
            maybe = [pc.match_substring_regex(texts, SIFT[k]).to_pylist() for k in KINDS]
            out: list[list[dict]] = []
            for i, m in enumerate(zip(*maybe, strict=True)):
                out.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(texts[i].as_py(), m)] if any(m) else [])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, kind)], ["id", "spans"])

    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.select(F.col("id").alias(id_col), "spans")


def joined(spans: str) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(read(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["kind"] != "lexed"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES = {"op4_secrets": op4_secrets}
SQL: dict[str, str] = {}


def digest(text: str) -> str:
    """base_sha256 of one text, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in scan(text, (True, True, True, False))).encode()).hexdigest()
