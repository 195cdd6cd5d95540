"""A training corpus from ``documents``: identified, deduplicated, scrubbed, mixed, encoded.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a
DataFrame, written as Parquet and read again as the next one's ``docs``. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from potentia.llm import langid, mixing, secrets, simhash
from potentia.llm.queries import encode_digests
from potentia.session import checkpoint_dir
from potentia.sources.tables import load


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (1), taught by every row with a language: rows without an identified language go."""
    return langid.keep_identified(docs, F.col("lang").isNotNull())


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (5): one document of each group stays."""
    return simhash.deduplicate(docs, shingle=4, max_bits=4)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans (3): every document stays, its secrets replaced and n_chars counted anew."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources (7): a document appears as often as the mix takes it."""
    return mixing.mixed_corpus(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE (2): (doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row."""
    return encode_digests(docs, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_redaction", redact_secrets),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

ORACLE_SQL = None  # mixture inference and pivotal rounding are not SQL; tests hold them to brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = load(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
