"""A corpus from documents to token ids: quality, lines, near duplicates, mixture, pieces.

Each stage gets what its predecessor kept, as Parquet read again, and returns the columns of documents; the last adds
the ids. Extra columns pass through. SQL cannot express the classifier, the fingerprints and the encoding.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import fresh, read, shared_dir
from facetry.llm.op1_pieces import encoded
from facetry.llm.op3_lines import without_boilerplate
from facetry.llm.op6_quality import learnable, quality_filter, train
from facetry.llm.op7_simhash import similar_texts
from facetry.llm.op10_mixing import mixture


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels outside the held-out third, does not reject."""
    field = train(docs, learnable(read(spark, sf_dir, "labels")))
    return quality_filter(docs, field)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without boilerplate lines, but for those with no other lines; n_chars follows the text."""
    out = without_boilerplate(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by five-word shingles at a similarity of 0.8 or more.

    It is the one of the smallest id, null ids last; repeated rows leave one.
    """
    h, k = fresh(docs, "_h", "_k")
    keyed = docs.withColumn(h, F.xxhash64("text")).withColumn(k, F.xxhash64("doc_id", h))
    groups = similar_texts(keyed.select(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", F.col(h).alias("_h"), F.col(k).alias("_k")).alias("doc_id"), "text"))
    kept = groups.where(F.col("doc_id") == F.col("component")).select(F.col("doc_id._k").alias(k)).distinct()
    return keyed.join(kept, k, "left_semi").dropDuplicates([k]).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order, documents as often as it takes them."""
    return mixture(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", duplicates),
    ("mixing", mix),
    ("pieces", pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with a Parquet table in the shared folder after each but the last."""
    docs = read(spark, sf_dir, "documents")
    top = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{top}/{i}-{name}")
            docs = spark.read.parquet(f"{top}/{i}-{name}")
    return docs
