"""Token counts without ids: each distinct pre-token is counted once, then joined to the documents' frequencies.

A pre-token is a run without ASCII white space. No token of these vocabularies crosses white space, the
normalizer works within such runs, and special strings hold no white space, so a text's count is the sum over
its pre-tokens. One pass writes blocks of documents: for each document its pre-tokens, as places among the block's
distinct ones, with their frequencies; and the distinct ones themselves, dealt by hash into segments. A segment's
task counts each distinct pre-token of the whole table that falls to it once, with the library, and answers every
block in that block's order. The counts are joined to the blocks, gathered and summed by document.

A very frequent word stands once a block in its segment and not once a document, strings are shuffled once, and the
frequencies move once, compressed.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import SEED, blocks, pack, read, row_sums, table, unpack, words_of, workers_find_us

#: Bytes of text of a block; a longer text is a block of its own.
BLOCK = 16 << 20
#: Bytes of text a segment of pre-tokens stands for, and segments at least.
SEGMENT, LEAST = 64 << 20, 32

#: A word of these letters alone is one pre-token, and lower-casing it by letter is what the normalizer does.
LETTERS = r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$"
#: Marks that end a word after an ASCII letter or digit are one pre-token of their own.
TAIL = r"^(.*[a-z0-9])([.,;:!?#$%&*]+)$"


def byte_letters() -> dict[int, str]:
    """Letters of Latin-1 as the byte-level alphabet writes their UTF-8 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {c: "".join(char[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


@lru_cache(maxsize=2)
def piece_counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """Counts of distinct words by the tokenizers library, for a vocabulary whose tokens do not cross white space.

    Lower-case words of Latin letters, which are one pre-token as they stand, go straight to the library's
    model; any other word goes through its whole chain of special strings, normalizer and pre-tokenizer.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    model, letters = tok.model, byte_letters()

    def whole(words: list[str]) -> list[int]:
        out: list[int] = []
        for i in range(0, len(words), 1024):
            out += [len(e.ids) for e in tok.encode_batch_fast(words[i : i + 1024], add_special_tokens=False)]
        return out

    def heads(words: pa.Array) -> np.ndarray:
        easy = pc.match_substring_regex(words, LETTERS).to_numpy(zero_copy_only=False)
        out = np.zeros(len(words), np.int64)
        if easy.any():
            out[easy] = [len(model.tokenize(w)) for w in "\n".join(words.filter(pa.array(easy)).to_pylist()).translate(letters).split("\n")]
        out[~easy] = whole(words.filter(pa.array(~easy)).to_pylist())
        return out

    def count(words: pa.Array) -> np.ndarray:
        # Letter case counts only inside special strings; those words are left as they are.
        special = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        out = np.zeros(len(words), np.int64)
        out[special] = whole(words.filter(pa.array(special)).to_pylist())
        lower = words.filter(pa.array(~special))
        latin = pc.match_substring_regex(lower, r"^[\x00-\x7f\x{c0}-\x{ff}]*$").to_numpy(zero_copy_only=False)
        lower = pc.if_else(pa.array(latin), pc.utf8_lower(lower), lower)
        tailed = pc.match_substring_regex(lower, TAIL)
        head = pc.if_else(tailed, pc.replace_substring_regex(lower, TAIL, r"\1"), lower).dictionary_encode()
        tail = pc.if_else(tailed, pc.replace_substring_regex(lower, TAIL, r"\2"), "").dictionary_encode()
        out[~special] = heads(head.dictionary)[head.indices.to_numpy()] + np.array(whole(tail.dictionary.to_pylist()), np.int64)[tail.indices.to_numpy()]
        return out

    return count


def frequencies(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of a block, the most frequent first; and by document how many of them it has, which, and how often each."""
    starts, words = words_of(texts)
    coded = words.dictionary_encode()
    most = max(1, len(coded.dictionary))
    row = np.repeat(np.arange(len(texts)), np.diff(starts))
    code = coded.indices.to_numpy()
    order = np.argsort(-np.bincount(code, minlength=len(coded.dictionary)), kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    pair, times = np.unique(row * most + place[code], return_counts=True) if len(words) else (row, row)
    return coded.dictionary.take(pa.array(order)), np.bincount(pair // most, minlength=len(texts)), pair % most, times


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens). Null ids and repeated rows are kept, a row for a row;
    other columns are not read. ``tokenizer`` is the vocabulary file's path on every executor; texts are whole.
    """
    workers_find_us(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(LEAST, -(-size // SEGMENT))
    fields = ["block", "seg", "ids", "n_bytes", "n_words", "pairs", "words"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, press = xxhash.xxh64_intdigest, zstandard.ZstdCompressor(level=3)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        for b in blocks(batches, "text", BLOCK):
            words, n, at, times = frequencies(b.column("text"))
            seg = np.fromiter((digest(w, SEED) % segments for w in words.cast(pa.large_binary()).to_pylist()), np.int64, len(words))
            order = np.argsort(seg, kind="stable")
            block = uuid.uuid4().int >> 65
            n_bytes = pc.binary_length(b.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([-1], pa.int32()), one(b.column("id")), one(n_bytes), one(pa.array(n, pa.int32())), pa.array([pack(at, times)], pa.binary()), pa.array([pack(seg)], pa.binary())], fields)
            if not len(words):
                continue
            found, first = np.unique(seg[order], return_index=True)
            words = words.take(pa.array(order))
            # No pre-token holds a line feed.
            blobs = [press.compress("\n".join(words[i:j].to_pylist()).encode()) for i, j in zip(first, np.append(first[1:], len(order)), strict=True)]
            none = [pa.nulls(len(found), t) for t in (b.column("id").type, pa.int64(), pa.int32())]
            lists = [pa.nulls(len(found), pa.list_(x.type)) for x in none]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(found, pa.int32()), *lists, pa.nulls(len(found), pa.binary()), pa.array(blobs, pa.binary())], fields)

    def count(t: pa.Table) -> pa.Table:
        by_library, open_ = piece_counter(tokenizer), zstandard.ZstdDecompressor()
        lists = [open_.decompress(x).decode().split("\n") for x in t["words"].to_pylist()]
        coded = pa.array([w for x in lists for w in x], pa.large_string()).dictionary_encode()
        n = by_library(coded.dictionary.cast(pa.string()))[coded.indices.to_numpy()]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        return pa.table({"block": t["block"], "seg": t["seg"], "n": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(n, pa.int32()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, n_bytes, n_words, counts = (b.column(c)[i].values for c in ("ids", "n_bytes", "n_words", "counts"))
                total = np.zeros(len(ids), np.int64)
                if counts is not None:
                    (at, times), (seg,) = unpack(b.column("pairs")[i].as_py(), 2), unpack(b.column("words")[i].as_py(), 1)
                    n = np.empty(len(seg), np.int64)
                    n[np.argsort(seg, kind="stable")] = counts.to_numpy()  # answers come by segment
                    total = row_sums(n[at] * times, np.concatenate([[0], np.cumsum(n_words.to_numpy())]))
                yield pa.RecordBatch.from_arrays([ids, n_bytes, pa.array(total)], ["id", "n_bytes", "n_tokens"])

    made = table(rows.mapInArrow(split, f"block bigint, seg int, ids array<{kind}>, n_bytes array<bigint>, n_words array<int>, pairs binary, words binary"))
    counted = made.where("seg >= 0").select("block", "seg", "words").groupBy("seg").applyInArrow(count, "block bigint, seg int, n array<int>")
    counts = counted.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("seg", "n"))).alias("parts"))
    counts = counts.select("block", F.flatten(F.transform("parts", lambda p: p["n"])).alias("counts"))
    placed = made.where("seg < 0").drop("seg").join(counts, "block", "left")
    out = placed.mapInArrow(add, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_token_counts": op2_token_counts}
SQL: dict[str, str] = {}
