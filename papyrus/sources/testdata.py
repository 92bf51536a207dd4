"""Bibliographic inputs derived from the driver's generated tables.

The generated tables are TPC-H-like plus a text corpus.  The rules below
turn them into the inputs the operators take (papers, authors, citations,
authorship, corpus, word vectors).  Every rule is a plain DataFrame
transformation, so its cost grows with the tables; the DuckDB twins of
these rules live in :mod:`papyrus.plans.oracle`.

Fixed derivation rules (must be identical in the oracle SQL):

* citation ``src -> dst``: within one order, among line items with
  quantity > 40, each part cites the part of the previous line (order
  by line number, part, supplier); ids are ``'P' || partkey``.  Parts of
  orders whose key is a multiple of 500 also cite ``'X' || orderkey``,
  a paper outside the corpus (dangling edges on purpose).
* authorship: the supplier of line number 1 wrote the part.
* papers: year ``1995 + partkey % 7`` (null when ``partkey % 13 = 0``),
  IEEE keywords ``[brand, type]`` (null when ``partkey % 7 = 0``), author
  keywords = words of the name (null when ``partkey % 11 = 0``).
  The title is the name, for ``partkey % 3 = 0`` as ``'The <name> of it'``
  (stop words).
* corpus: ``'D' || doc_id``, first line of the text as title, text as
  abstract; documents ``10k + 3`` take the identifier of ``10k + 2`` (one
  identifier, two rows), titles of ``doc_id % 17 = 0`` are null, and rows of
  ``doc_id % 25 = 0`` occur twice.
* word vectors: the n-th word (from 0, alphabetical) of the corpus
  vocabulary takes a quarter of the embedding ``vec_id = n % (rows of
  embeddings)``, so that documents have more than ten near neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DANGLING_ORDER_STEP = 500
CITE_MIN_QUANTITY = 40
YEAR_BASE, YEAR_SPAN = 1995, 7
NULL_YEAR_STEP, NULL_IEEE_STEP, NULL_AUTHKW_STEP, STOP_TITLE_STEP = 13, 7, 11, 3
SAME_DOI_STEP, SAME_DOI, NULL_TITLE_STEP, TWICE_STEP = 10, 3, 17, 25
VECTOR_SCALE = 0.25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pid(c) -> F.Column:
    return F.concat(F.lit("P"), c.cast("string"))


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citation edges ``(src, dst)``; multi-edges, a self-loop and
    dangling targets occur on purpose."""
    li = table(spark, sf_dir, "lineitem")
    by_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    inside = (li.filter(F.col("l_quantity") > CITE_MIN_QUANTITY)
              .select(F.col("l_partkey").alias("s"),
                      F.lag("l_partkey").over(by_order).alias("d"))
              .filter(F.col("d").isNotNull())
              .select(_pid(F.col("s")).alias("src"), _pid(F.col("d")).alias("dst")))
    dangling = (li.filter(F.col("l_orderkey") % DANGLING_ORDER_STEP == 0)
                .select(_pid(F.col("l_partkey")).alias("src"),
                        F.concat(F.lit("X"), F.col("l_orderkey").cast("string")).alias("dst")))
    return inside.unionByName(dangling)


def wrote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorship ``(paper_doi, author_id INT)``, distinct pairs."""
    li = table(spark, sf_dir, "lineitem")
    return (li.filter(F.col("l_linenumber") == 1)
            .select(_pid(F.col("l_partkey")).alias("paper_doi"),
                    F.col("l_suppkey").cast("int").alias("author_id"))
            .distinct())


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("int").alias("author_id"),
                    F.col("s_name").alias("author_name"),
                    F.lit(None).cast("array<string>").alias("affiliations"),
                    F.lit(None).cast("string").alias("firstname"),
                    F.lit(None).cast("string").alias("lastname"))


def papers_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar columns of the papers table, one row per paper."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        _pid(k).alias("paper_doi"),
        F.when(k % STOP_TITLE_STEP == 0, F.concat(F.lit("The "), F.col("p_name"), F.lit(" of it")))
         .otherwise(F.col("p_name")).alias("title"),
        F.col("p_brand").alias("publishedby"),
        F.when(k % NULL_IEEE_STEP == 0, F.lit(None).cast("array<string>"))
         .otherwise(F.array(F.col("p_brand"), F.col("p_type"))).alias("ieee_keywords"),
        F.when(k % NULL_AUTHKW_STEP == 0, F.lit(None).cast("array<string>"))
         .otherwise(F.split(F.col("p_name"), " ")).alias("authors_keywords"),
        F.col("p_partkey").cast("string").alias("publicationNumber"),
        F.when(k % NULL_YEAR_STEP == 0, F.lit(None).cast("int"))
         .otherwise((F.lit(YEAR_BASE) + k % YEAR_SPAN).cast("int")).alias("publicationDate"),
    )


def papers(spark: SparkSession, sf_dir: str, with_refs: bool = True) -> DataFrame:
    """The papers table with its array columns (authors, references).

    Arrays are sorted ``collect_list`` results; duplicates are kept in
    ``refs_doi``; both are null for papers without any row.  The reference
    array of a heavily citing paper is as large as its out-degree, so
    consumers that do not need it pass ``with_refs=False`` (null column).
    """
    base = papers_long(spark, sf_dir)
    auth = (wrote(spark, sf_dir).groupBy("paper_doi")
            .agg(F.sort_array(F.collect_list("author_id")).alias("author_id")))
    joined = base.join(auth, "paper_doi", "left")
    if with_refs:
        refs = (cites(spark, sf_dir).groupBy(F.col("src").alias("paper_doi"))
                .agg(F.sort_array(F.collect_list("dst")).alias("refs_doi")))
        joined = joined.join(refs, "paper_doi", "left")
    else:
        joined = joined.withColumn("refs_doi", F.lit(None).cast("array<string>"))
    return (joined
            .select("paper_doi", "title", "publishedby", "author_id", "ieee_keywords",
                    "authors_keywords",
                    F.lit(None).cast("array<string>").alias("pubTopics"),
                    "publicationNumber", "publicationDate",
                    F.array().cast("array<int>").alias("metrics"),
                    F.lit(None).cast("array<string>").alias("refs"),
                    F.lit(None).cast("array<string>").alias("googleScholarLink"),
                    "refs_doi"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw corpus rows ``(doi, title, abstract)`` before cleaning."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    number = F.when(k % SAME_DOI_STEP == SAME_DOI, k - 1).otherwise(k)
    title = F.when(k % NULL_TITLE_STEP != 0, F.split_part(F.col("text"), F.lit("\n"), F.lit(1)))
    times = F.explode(F.sequence(F.lit(1), F.when(k % TWICE_STEP == 0, 2).otherwise(1)))
    return d.select(F.concat(F.lit("D"), number.cast("string")).alias("doi"), title.alias("title"),
                    F.col("text").alias("abstract"), times.alias("n")).drop("n")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, vector ARRAY<DOUBLE>)`` from the embeddings table."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))


#: Rows that :func:`embedding_variants` makes of one embedding, and their step.
VARIANTS, VARIANT_STEP = 4, 0.03


def embedding_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, vector)``: groups of near vectors, for joins whose threshold
    selects: variant ``n`` of a vector has ``n * 0.03 * ((7 i + n) % 3 - 1)``
    added to component ``i``."""
    e = embeddings(spark, sf_dir).select("vec_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("n"))
    moved = F.transform("vector", lambda x, i: x + F.col("n") * F.lit(VARIANT_STEP) * ((7 * i + F.col("n")) % 3 - 1))
    return e.select((F.col("vec_id") * VARIANTS + F.col("n")).alias("id"), moved.alias("vector"))


def word_vectors(spark: SparkSession, sf_dir: str, word_counts: DataFrame,
                 min_count: int = 3) -> DataFrame:
    """``(word, vector)``: the n-th word (alphabetical, from 0) among words
    seen at least ``min_count`` times takes embedding ``n % rows``.

    ``word_counts`` is ``(word, total)`` over the corpus (the idf table has
    it).  A stand-in for trained vectors that SQL can reproduce; the
    vocabulary matches what Word2Vec keeps with the same ``min_count``.
    """
    from papyrus.functions.ranking import dense_index

    counts = word_counts.filter(F.col("total") >= min_count)
    vocab = dense_index(counts.select("word"), [F.asc("word")], "n")
    emb = embeddings(spark, sf_dir)
    rows = emb.count()
    return (vocab.join(emb, (F.col("n") % F.lit(rows)) == F.col("vec_id"))
            .select("word", F.transform("vector", lambda x: x * VECTOR_SCALE).alias("vector")))
