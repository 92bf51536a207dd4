"""A training-corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns a DataFrame that is written as Parquet and read again as
the next stage's docs.  All stages but the last return the columns of the
documents table.

``run`` writes the stages' outputs to the session's shared checkpoint folder.
The stages cannot be expressed in SQL as a whole; ``tests/llm`` holds them
against brute force.

Defined results, for every stage: a null text counts as the empty text (and stays
null where the stage passes rows on), a null or repeated id is a row like any
other, except that near_dedup keeps one row of equal ids and texts as of other copies;
an empty table gives an empty table; further columns pass through all stages but the
last, which reads doc_id and text alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrus.llm import bpe, decontaminate, quality, secrets, simhash
from papyrus.llm import texts as X
from papyrus.session import cut_lineage

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.keep_clean(docs, X.read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; all documents stay."""
    return secrets.redact(docs, secrets.train(docs), length_col="n_chars")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text (unsigned 32-bit little-endian, joined), with the
    digests of the ids and of the bytes they decode to."""
    done = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secret_scan", secret_scan), ("byte_bpe", byte_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table to the last stage's rows."""
    docs = X.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
