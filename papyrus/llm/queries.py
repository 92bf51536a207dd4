"""The registered ``opN_<name>`` queries: each applies its operator to the
whole intended table and derives the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrus.llm import (bpe, decontaminate, fill_middle, hard_negatives, line_dedup, ngram_lm, quality, run_index, secrets,
                         simhash, token_files, toxicity, wrappers)
from papyrus.llm import texts as X
from papyrus.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@register("op1_run_index_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = run_index.dedup_substrings(X.read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                       (F.octet_length("spans") / 16).cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@register("op2_html_wrappers")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = wrappers.extract(X.read(spark, sf_dir, "pages"))
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


@register("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(X.read(spark, sf_dir, "documents"),
                             public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(X.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


@register("op5_ngram_lm")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.read(spark, sf_dir, "documents")
    scored = ngram_lm.score(docs, ngram_lm.train_model(docs))
    return scored.select("doc_id", ngram_lm.held_out("doc_id").alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score", "perplexity")


def _of_kind(kind: str) -> F.Column:
    """Number of base spans of a kind.  The lambda has one argument: Spark
    hands a second one the place in the list."""
    return F.size(F.filter("base", lambda span: span.startswith(f"{kind}:"))).cast("long")


@register("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.read(spark, sf_dir, "documents")
    found = secrets.find(docs, secrets.train(docs))
    counts = [_of_kind(k).alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
                        F.array_join("spans", ",").alias("spans"))


@register("op7_benchmark_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(X.read(spark, sf_dir, "documents"), X.read(spark, sf_dir, "benchmark"))
    n_hit = (F.octet_length("hit_words") / 4).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


@register("op8_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_files.write_tokens(X.read(spark, sf_dir, "documents"), path,
                             public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return token_files.crc(token_files.read_tokens(spark, path)).drop("tokens")


@register("op9_line_dedup", line_dedup.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(X.read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_units", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(X.read(spark, sf_dir, "documents"))


@register("op11_fill_in_middle", fill_middle.SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_middle.fill_in_middle(X.read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), "restored_sha256")


@register("op12_hard_negatives", hard_negatives.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.quantised(X.read(spark, sf_dir, "embeddings"))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


@register("op13_toxicity")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = X.read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, X.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
