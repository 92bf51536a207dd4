"""Text operators of the recommender (S1, P3, A1, T1, T1b, T2, A5, A6, T6,
W1, A11, J1).

Tokenising is native expressions (``regexp_extract_all``, higher order
functions) plus the JVM function inside ``StopWordsRemover``; words are counted
within their row by Arrow, which needs no shuffle.  Statistics are kept per corpus row: one doi may have several
rows (titles), so rows carry a ``row`` id, stored once with the cleaned
corpus.  Term statistics use the long format ``(row, doi, word, tf)`` instead
of sparse vectors: it needs no vocabulary on the driver and every aggregation
is partial (map-side).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrus.functions.ranking import dense_index, top_k_per_group
from papyrus.schemas import CORPUS
from papyrus.session import cut_lineage

# Fixed values of the tokenizer: Latin word = a letter followed by letters
# or digits; words of one or two characters are dropped.
TOKEN_PATTERN = r"([A-Za-z][A-Za-z0-9]*)"
MIN_TOKEN_LENGTH = 3
TOP_KEYWORDS = 20
WEIGHT_DIGITS = 4


# ----------------------------------------------------------------- corpus

def clean_corpus(raw: DataFrame) -> DataFrame:
    """Keep ``doi, title, abstract``; drop rows with a null among
    them; drop duplicate rows (one doi may survive with several titles)."""
    return raw.select("doi", "title", "abstract").dropna().dropDuplicates()


def number_rows(corpus: DataFrame) -> DataFrame:
    """The corpus with a ``row`` id, written once so that every reader sees
    the same ids; term statistics are keyed by it."""
    return cut_lineage(corpus.withColumn("row", F.monotonically_increasing_id()))


def read_corpus_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON records with an explicit schema (no inference pass)."""
    return clean_corpus(spark.read.schema(CORPUS).json(path))


# -------------------------------------------------------------- tokenising

def tokens_of(text: Column) -> Column:
    """Latin words of length >= 3, case kept, in text order."""
    words = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(1))
    return F.filter(words, lambda w: F.length(w) >= MIN_TOKEN_LENGTH)


def tokenize(corpus: DataFrame, input_col: str = "abstract", output_col: str = "seg") -> DataFrame:
    return corpus.withColumn(output_col, tokens_of(F.col(input_col)))


def remove_stopwords(df: DataFrame, stop: list[str], input_col: str = "seg",
                     output_col: str = "words", case_sensitive: bool = False) -> DataFrame:
    """Drop stop words from token arrays; by default the match ignores
    case and the kept tokens keep their case.  For a list of the caller;
    :func:`drop_stopwords` takes a table of any size."""
    remover = StopWordsRemover(inputCol=input_col, outputCol=output_col, stopWords=stop,
                               caseSensitive=case_sensitive)
    return remover.transform(df)


def drop_stopwords(tokens: DataFrame, stop: DataFrame, case_sensitive: bool = False) -> DataFrame:
    """T2 on the long token form: rows whose ``word`` is not in the ``word``
    column of the stop table."""
    fold = (lambda c: c) if case_sensitive else F.lower
    stopped = stop.select(fold(F.col("word")).alias("stop"))
    return tokens.join(stopped, fold(F.col("word")) == F.col("stop"), "left_anti")


def word_lists(corpus: DataFrame, stop: list[str]) -> DataFrame:
    """The corpus without its abstracts and with ``words``: their tokens
    without stop words."""
    return remove_stopwords(tokenize(corpus), stop).drop("abstract", "seg")


def token_table(df: DataFrame, words_col: str = "words") -> DataFrame:
    """Long format ``(doi, pos, word)`` of a token-array column."""
    return df.select("doi", F.posexplode(words_col).alias("pos", "word"))


LEXICON_TOKEN = r"([\p{L}\p{N}]+)"


def tokenize_lexicon(corpus: DataFrame, lexicon: DataFrame, input_col: str = "abstract") -> DataFrame:
    """The part-of-speech rule with a user lexicon ``(word, flag)``.

    Words are runs of letters/digits.  A word found in the lexicon keeps
    its flag; an unknown word is ``eng`` when it is ASCII letters/digits,
    else ``x``.  Kept: length >= 2 and (noun flags ``n*``, or ``x``, or
    ``eng`` with length >= 3).  Returns ``(doi, pos, word)`` in text order.
    """
    words = (corpus.select("doi", F.posexplode(F.regexp_extract_all(F.col(input_col),
                                                                   F.lit(LEXICON_TOKEN), F.lit(1)))
                           .alias("pos", "word")))
    lex = lexicon.select("word", "flag").dropDuplicates(["word"])
    tagged = words.join(lex, "word", "left").withColumn(
        "flag", F.coalesce(F.col("flag"),
                           F.when(F.col("word").rlike("^[A-Za-z0-9]+$"), F.lit("eng")).otherwise(F.lit("x"))))
    n = F.length("word")
    keep = (n > 1) & (((F.col("flag") == "eng") & (n > 2))
                      | ((F.col("flag") != "eng") & (F.col("flag").startswith("n") | (F.col("flag") == "x"))))
    kept = tagged.filter(keep)
    return kept.select("doi", "pos", "word")


# ----------------------------------------------------------- term weights

#: Words of the lists that are counted at once.
COUNTED = 1 << 20


def _counts(rows: pa.RecordBatch) -> pa.RecordBatch:
    """``(row, doi, word, tf)`` of rows ``(row, doi, words)``."""
    listed = rows.column(2)
    coded = pc.list_flatten(listed).dictionary_encode(null_encoding="encode")
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    parent = pc.list_parent_indices(listed).to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, len(coded.dictionary))
    pair, n = np.unique(parent * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row = pa.array(pair // width)
    return pa.RecordBatch.from_arrays(
        [rows.column(0).take(row), rows.column(1).take(row), coded.dictionary.take(pa.array(pair % width)),
         pa.array(n.astype(np.int64))], names=["row", "doi", "word", "tf"])


def term_freq(words: DataFrame, words_col: str = "words") -> DataFrame:
    """A5/T4: ``(row, doi, word, tf)``, counted per corpus row.

    A row is one row of the table, so its words are counted where they lie:
    no shuffle.  Null and empty lists have no words."""
    chosen = words.select("row", "doi", F.col(words_col).alias("words"))
    kinds = {f.name: f.dataType for f in chosen.schema.fields}
    schema = T.StructType([T.StructField("row", kinds["row"]), T.StructField("doi", kinds["doi"]),
                           T.StructField("word", kinds["words"].elementType), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + COUNTED, side="right")))
                yield _counts(batch.slice(at, to - at))
                at = to

    return chosen.mapInArrow(run, schema)


def idf_of(df: Column, n_docs: int) -> Column:
    return F.log((F.lit(float(n_docs)) + F.lit(1.0)) / (df + F.lit(1.0)))


def idf_table(tf: DataFrame, n_docs: int) -> DataFrame:
    """``(word, df, idf, total)`` with ``idf = ln((N+1)/(df+1))``
    (minimum document frequency 0) and ``total`` the corpus count."""
    return (tf.groupBy("word")
            .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
            .withColumn("idf", idf_of(F.col("df"), n_docs)))


#: Words whose weights are sent to all tasks when keywords are chosen.
COMMON = 50_000


def _weighted(joined: DataFrame) -> DataFrame:
    return joined.select("row", "doi", "word", "tf", (F.col("tf") * F.col("idf")).alias("tfidf"), "total")


def tfidf(tf: DataFrame, idf: DataFrame, common: DataFrame | None = None) -> DataFrame:
    """``(row, doi, word, tf, tfidf, total)``, raw count times idf.

    ``common``, rows of ``idf`` that fit a task, is sent to all tasks, so
    that only the counts of the other words are shuffled by word."""
    of = ["word", "idf", "total"]
    if common is None:
        return _weighted(tf.join(idf.select(of), "word"))
    some = F.broadcast(common.select(of))
    near = _weighted(tf.join(some, "word"))
    rest = tf.join(some.select("word"), "word", "left_anti")
    return near.unionByName(_weighted(rest.join(idf.select(of), "word")))


def common_words(idf: DataFrame, size: int = COMMON) -> DataFrame:
    """The ``size`` most frequent rows of a stored ``idf``, written."""
    return cut_lineage(bounded_vocabulary(idf.select("word", "df", "idf", "total"), size))


def vocabulary(idf: DataFrame) -> DataFrame:
    """``(word, idf, index)``; index 0 is the most frequent word over
    the corpus, ties by word (a distributed zipWithIndex, no driver list)."""
    return dense_index(idf.select("word", "idf", "total"),
                       [F.desc("total"), F.asc("word")], "index").select("word", "idf", "index")


#: Rows of one bin that are ordered at once; larger bins are cut finer.
BIN = 10_000


def bounded_vocabulary(idf: DataFrame, size: int, min_df: float = 1.0, n_docs: int | None = None) -> DataFrame:
    """T4: the ``size`` most frequent words over the corpus among those in at
    least ``min_df`` documents (below 1: of that share of ``n_docs``), ties by
    word: ``(word, df, idf, total)`` as stored in ``idf``, which is read
    several times.

    There is no sort of the vocabulary: :func:`_last_key` finds the last key
    that stays by histograms, and the result is a filter by that key.  A
    size of zero gives no row, one beyond the vocabulary all; null words take
    no part.
    """
    if min_df < 1 and n_docs is None:
        raise ValueError("a share of documents needs n_docs")
    least = min_df if min_df >= 1 else min_df * n_docs
    kept = idf.where(F.col("word").isNotNull() & (F.col("df") >= F.lit(float(least))))
    if size <= 0:
        return kept.where(F.lit(False))
    # bytes whose order is that of falling counts, then of words
    rest = F.lpad(F.hex(F.lit((1 << 63) - 1) - F.col("total").cast("long")), 16, "0")
    key = F.concat(F.unhex(rest), F.encode("word", "UTF-8"))
    last = _last_key(kept.select(key.alias("key")), size)
    return kept if last is None else kept.where(key <= F.lit(last))


def _last_key(keys: DataFrame, k: int) -> bytes | None:
    """The ``k``-th smallest of distinct binary keys (null if there are
    fewer).  Each round counts the keys below the common prefix by their next
    two bytes, counts that tasks merge before the shuffle and of which the
    driver sees at most 65,793, and goes on with the one bin that holds the
    ``k``-th, until it is small."""
    while True:
        low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
        if n < k:
            return None
        if n <= BIN:
            return bytes(keys.orderBy("key").limit(k).agg(F.max("key")).first()[0])
        same = next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))
        head = F.substring("key", 1, same + 2)
        bins = sorted((bytes(r[0]), r[1]) for r in keys.groupBy(head.alias("head")).count().collect())
        for found, count in bins:
            if k <= count:
                break
            k -= count
        keys = keys.where(head == F.lit(found))


def count_vectors(tf: DataFrame, bounded: DataFrame) -> DataFrame:
    """T4: ``(row, doi, index, tf)`` over a bounded vocabulary; index 0 is its
    most frequent word.  Words outside are left out."""
    return tf.join(vocabulary(bounded).select("word", "index"), "word").select("row", "doi", "index", "tf")


def _best(weights: DataFrame, k: int) -> DataFrame:
    order = [F.desc("tfidf"), F.desc("total"), F.asc("word")]
    return top_k_per_group(weights, ["row"], order, k, rank_col="rank")


def keywords(weights: DataFrame, titles: DataFrame, k: int = TOP_KEYWORDS) -> DataFrame:
    """``(row, doi, title, keyword, weight, rank)``: the ``k`` best words
    of a corpus row by tf-idf; ties go to the lower vocabulary index (larger
    corpus count, then word); the weight is rounded to 4 places after
    ranking.  ``titles`` has ``(row, title)``; the window leaves its rows
    partitioned by ``row``, so only the titles are shuffled for the join."""
    return (_best(weights, k).join(titles.select("row", "title"), "row")
            .select("row", "doi", "title", F.col("word").alias("keyword"),
                    F.round("tfidf", WEIGHT_DIGITS).alias("weight"), "rank"))


def keywords_by_index(weights: DataFrame, vocab: DataFrame, k: int = TOP_KEYWORDS) -> DataFrame:
    """W1 in index form ``(row, doi, index, weight)`` as the sparse-vector
    route produces it."""
    return (_best(weights, k).join(vocab.select("word", "index"), "word")
            .select("row", "doi", "index", F.round("tfidf", WEIGHT_DIGITS).alias("weight")))


def keyword_vocab_join(by_index: DataFrame, vocab: DataFrame, titles: DataFrame) -> DataFrame:
    """Index-form keywords back to words through the vocabulary."""
    return (by_index.join(vocab.select("index", F.col("word").alias("keyword")), "index")
            .join(titles.select("row", "title"), "row")
            .select("doi", "title", "keyword", "weight"))


def corpus_statistics(corpus: DataFrame, stop: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(words, tf, idf)`` of a numbered corpus (one count action for N).

    ``tf`` feeds both the idf aggregation and the tf-idf join, so it is
    materialised once instead of re-tokenising the corpus for each; so is
    ``idf``, of one row a word.
    """
    words = word_lists(corpus, stop)
    tf = cut_lineage(term_freq(words))
    return words, tf, cut_lineage(idf_table(tf, corpus.count()))
