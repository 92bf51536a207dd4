"""Recommender queries: corpus, tokens, term weights, keywords, vectors,
similarity (S1, T1-T10, A3-A6, A11, W1, J1, J2, J4, K2, K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrus.operators import cooccurrence
from papyrus.operators import simjoin
from papyrus.operators import skipgram
from papyrus.operators import text as T
from papyrus.operators import vectors as VEC
from papyrus.plans import oracle as O
from papyrus.plans.registry import register, rnd
from papyrus.sources import stopwords as SW
from papyrus.session import cut_lineage, release, scratch_path
from papyrus.sources import models
from papyrus.sources import testdata as td

STOP = list(SW.FIXTURE_STOPWORDS)
STOP_SQL = "[" + ", ".join("'" + w + "'" for w in STOP) + "]"
TOKEN_SQL = f"regexp_extract_all(abstract, '{T.TOKEN_PATTERN}', 1)"


# ----------------------------------------------------------------- Spark

def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned corpus, for plans that read it once."""
    return T.clean_corpus(td.corpus(spark, sf))


def statistics(spark: SparkSession, sf: str):
    """The corpus is stored here: tokens, row count and titles read it."""
    c = T.number_rows(corpus(spark, sf))
    words, tf, idf = T.corpus_statistics(c, STOP)
    return c, words, tf, idf


def fixture_keywords(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """``(keywords, idf)`` of the corpus."""
    c, words, tf, idf = statistics(spark, sf)
    return T.keywords(T.tfidf(tf, idf, T.common_words(idf)), c), idf


def stored_keywords(c: DataFrame, tf: DataFrame, idf: DataFrame) -> DataFrame:
    """The keywords, written; the corpus and its counts, which are larger,
    are deleted as soon as nothing more is taken from them."""
    titles = cut_lineage(c.select("row", "title"))
    release(c)
    kw = cut_lineage(T.keywords(T.tfidf(tf, idf, T.common_words(idf)), titles).select("doi", "title", "keyword", "weight"))
    release(tf)
    release(titles)
    return kw


def fixture_doc_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the documents, written."""
    c, _, tf, idf = statistics(spark, sf)
    kw = stored_keywords(c, tf, idf)
    docs = VEC.stored_document_vectors(kw, td.word_vectors(spark, sf, idf.select("word", "total")))
    release(kw)
    return docs


def first_doc(docs: DataFrame) -> str:
    """The query document of the registered similarity queries: the
    smallest identifier that has a vector."""
    return docs.agg(F.min("doi")).first()[0]


# ------------------------------------------------------------------ SQL

TEXT_CTES = [
    O.CORPUS,
    f"W AS (SELECT row, doi, title, list_filter(list_filter({TOKEN_SQL}, lambda x: length(x) >= {T.MIN_TOKEN_LENGTH}), "
    f"lambda x: NOT list_contains({STOP_SQL}, lower(x))) AS words FROM corpus)",
    "TF AS (SELECT row, doi, w AS word, count(*) AS tf FROM W, unnest(words) AS t(w) GROUP BY row, doi, w)",
    "IDF AS (SELECT word, count(*) AS df, sum(tf) AS total, "
    "ln((CAST((SELECT count(*) FROM corpus) AS DOUBLE) + 1.0) / (CAST(count(*) AS DOUBLE) + 1.0)) AS idf "
    "FROM TF GROUP BY word)",
    "TI AS (SELECT TF.row, TF.doi, TF.word, TF.tf, TF.tf * IDF.idf AS tfidf, IDF.total "
    "FROM TF JOIN IDF ON TF.word = IDF.word)",
    f"KW AS (SELECT k.doi, corpus.title, k.word AS keyword, round(k.tfidf, {T.WEIGHT_DIGITS}) AS weight, "
    f"CAST(k.rk AS INTEGER) AS rank FROM (SELECT row, doi, word, tfidf, row_number() OVER (PARTITION BY row "
    f"ORDER BY tfidf DESC, total DESC, word) AS rk FROM TI) k JOIN corpus ON k.row = corpus.row "
    f"WHERE k.rk <= {T.TOP_KEYWORDS})",
]

VECTOR_CTES = TEXT_CTES + [
    "VOC AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS n FROM IDF WHERE total >= 3)",
    "WV AS (SELECT VOC.word, list_transform(CAST(e.embedding AS DOUBLE[]), lambda x: x * 0.25) AS vector FROM VOC JOIN embeddings e "
    "ON e.vec_id = VOC.n % (SELECT count(*) FROM embeddings))",
    "KV AS (SELECT KW.doi, KW.title, KW.keyword, KW.weight, "
    "list_transform(WV.vector, lambda x: x * KW.weight) AS weighted FROM KW JOIN WV ON KW.keyword = WV.word)",
    "DS AS (SELECT DISTINCT doi, weighted FROM KV)",
    "DT AS (SELECT doi, min(title) AS title FROM KV GROUP BY doi)",
    "DN AS (SELECT doi, count(*) AS k FROM DS GROUP BY doi)",
    "EL AS (SELECT doi, CAST(generate_subscripts(weighted, 1) - 1 AS INTEGER) AS dim, unnest(weighted) AS x FROM DS)",
    "DV AS (SELECT EL.doi, DT.title, EL.dim, sum(EL.x) / DN.k AS value FROM EL "
    "JOIN DN ON EL.doi = DN.doi JOIN DT ON EL.doi = DT.doi GROUP BY EL.doi, DT.title, EL.dim, DN.k)",
    "DVL AS (SELECT doi, title, list(value ORDER BY dim) AS vector FROM DV GROUP BY doi, title)",
    "Q AS (SELECT vector AS q FROM DVL WHERE doi = (SELECT min(doi) FROM DVL))",
    "DIST AS (SELECT doi, title, sqrt(list_reduce(list_transform(range(1, len(vector) + 1), "
    "lambda i: (vector[i] - q[i]) * (vector[i] - q[i])), lambda a, b: a + b)) AS distance FROM DVL, Q)",
]


# -------------------------------------------------------------- queries

@register("corpus_clean", O.with_(O.CORPUS) + "SELECT doi, title, abstract FROM corpus")
def corpus_clean(spark, sf):
    return corpus(spark, sf)


@register("tokenize", O.with_(O.CORPUS)
          + f"SELECT doi, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, unnest(toks) AS token FROM "
            f"(SELECT doi, list_filter({TOKEN_SQL}, lambda x: length(x) >= {T.MIN_TOKEN_LENGTH}) AS toks "
            f"FROM corpus) t")
def tokenize(spark, sf):
    seg = T.tokenize(corpus(spark, sf))
    return seg.select("doi", F.posexplode("seg").alias("pos", "token"))


@register("tokens_no_stop", O.with_(*TEXT_CTES[:2])
          + "SELECT doi, CAST(generate_subscripts(words, 1) - 1 AS INTEGER) AS pos, unnest(words) AS word FROM W")
def tokens_no_stop(spark, sf):
    return T.token_table(T.word_lists(corpus(spark, sf), STOP))


@register("tokens_stop_table", O.with_(*TEXT_CTES[:2])
          + "SELECT doi, unnest(words) AS word FROM W")
def tokens_stop_table(spark, sf):
    """T2 against a stop table instead of a list."""
    tokens = T.token_table(T.tokenize(corpus(spark, sf)), "seg")
    return T.drop_stopwords(tokens, SW.stopwords_frame(spark)).select("doi", "word")


@register("stopwords_scan", f"SELECT word FROM {SW.sql_values()} WHERE word IN "
          "(SELECT lower(w) FROM documents, unnest(regexp_extract_all(text, '([A-Za-z]+)', 1)) AS t(w))")
def stopwords_scan(spark, sf):
    """S3: a stop list read from a file, restricted to the words that the
    documents hold."""
    path = scratch_path(spark, "stop")
    SW.stopwords_frame(spark).write.text(path)
    words = td.table(spark, sf, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w"))
    return SW.read_stopwords(spark, path).join(words.select(F.lower("w").alias("word")), "word", "left_semi")


LEX_RULE = ("CASE WHEN lower(w) LIKE '%tion' OR lower(w) LIKE '%ment' OR lower(w) LIKE '%ness' THEN 'n' "
            "WHEN lower(w) LIKE '%ing' OR lower(w) LIKE '%ed' THEN 'v' "
            "WHEN lower(w) LIKE '%ly' THEN 'd' END")
LEX_TOKEN_SQL = f"regexp_extract_all(abstract, '{T.LEXICON_TOKEN}', 1)"


def suffix_lexicon(c: DataFrame) -> DataFrame:
    """A part-of-speech lexicon derived from the corpus by suffix rules
    (nouns -tion/-ment/-ness, verbs -ing/-ed, adverbs -ly); a stand-in
    for a user dictionary."""
    lw = F.lower(F.col("word"))
    flag = (F.when(lw.endswith("tion") | lw.endswith("ment") | lw.endswith("ness"), "n")
            .when(lw.endswith("ing") | lw.endswith("ed"), "v")
            .when(lw.endswith("ly"), "d"))
    words = c.select(F.explode(F.regexp_extract_all("abstract", F.lit(T.LEXICON_TOKEN), F.lit(1)))
                     .alias("word")).distinct()
    return words.select("word", flag.alias("flag")).filter(F.col("flag").isNotNull())


@register("tokenize_lexicon", O.with_(
    O.CORPUS,
    f"TK AS (SELECT doi, CAST(generate_subscripts(toks, 1) - 1 AS INTEGER) AS pos, unnest(toks) AS word FROM "
    f"(SELECT doi, {LEX_TOKEN_SQL} AS toks FROM corpus) t)",
    f"LEX AS (SELECT DISTINCT w AS word, {LEX_RULE} AS flag FROM corpus, "
    f"unnest({LEX_TOKEN_SQL}) AS t(w))",
    "TG AS (SELECT TK.doi, TK.pos, TK.word, coalesce(LEX.flag, CASE WHEN regexp_full_match(TK.word, "
    "'[A-Za-z0-9]+') THEN 'eng' ELSE 'x' END) AS flag FROM TK LEFT JOIN LEX ON TK.word = LEX.word)")
    + "SELECT doi, pos, word FROM TG WHERE length(word) > 1 AND ((flag = 'eng' AND length(word) > 2) "
      "OR (flag <> 'eng' AND (starts_with(flag, 'n') OR flag = 'x')))")
def tokenize_lexicon(spark, sf):
    c = corpus(spark, sf)
    return T.tokenize_lexicon(c, suffix_lexicon(c))


@register("term_freq", O.with_(*TEXT_CTES[:3]) + "SELECT doi, word, tf FROM TF")
def term_freq(spark, sf):
    numbered = corpus(spark, sf).withColumn("row", F.monotonically_increasing_id())
    return T.term_freq(T.word_lists(numbered, STOP)).drop("row")


@register("idf_table", O.with_(*TEXT_CTES[:4])
          + f"SELECT word, df, round(idf, {O.DP}) AS idf FROM IDF")
def idf_table(spark, sf):
    return statistics(spark, sf)[3].select("word", "df", rnd("idf"))


@register("tfidf", O.with_(*TEXT_CTES[:5])
          + f"SELECT doi, word, tf, round(tfidf, {O.DP}) AS tfidf FROM TI")
def tfidf(spark, sf):
    _, _, tf, idf = statistics(spark, sf)
    return T.tfidf(tf, idf).select("doi", "word", "tf", rnd("tfidf"))


@register("vocab_index", O.with_(*TEXT_CTES[:4])
          + f"SELECT word, round(idf, {O.DP}) AS idf, row_number() OVER (ORDER BY total DESC, word) - 1 "
            "AS \"index\" FROM IDF")
def vocab_index(spark, sf):
    return T.vocabulary(statistics(spark, sf)[3]).select("word", rnd("idf"), "index")


#: Bound and least document frequency of the registered vocabulary.
VOCAB_SIZE, VOCAB_MIN_DF = 500, 2
SQL_BOUNDED = (f"BV AS (SELECT word, df, total, idf, row_number() OVER (ORDER BY total DESC, word) - 1 AS i FROM IDF "
               f"WHERE df >= {VOCAB_MIN_DF} QUALIFY i < {VOCAB_SIZE})")


@register("vocab_bounded", O.with_(*TEXT_CTES[:4], SQL_BOUNDED) + "SELECT word, df, CAST(total AS BIGINT) AS total FROM BV")
def vocab_bounded(spark, sf):
    """T4: the most frequent words with a least document frequency."""
    idf = statistics(spark, sf)[3]
    return T.bounded_vocabulary(idf, VOCAB_SIZE, VOCAB_MIN_DF).select("word", "df", "total")


@register("count_vectors", O.with_(*TEXT_CTES[:4], SQL_BOUNDED)
          + "SELECT TF.doi, BV.i AS \"index\", TF.tf FROM TF JOIN BV ON TF.word = BV.word")
def count_vectors(spark, sf):
    """T4: the count vectors over the bounded vocabulary, in long form."""
    _, _, tf, idf = statistics(spark, sf)
    return T.count_vectors(tf, T.bounded_vocabulary(idf, VOCAB_SIZE, VOCAB_MIN_DF)).drop("row")


@register("vocab_idf_merged", O.with_(*TEXT_CTES[:4]) + f"SELECT word, df, CAST(total AS BIGINT) AS total, round(idf, {O.DP}) AS idf FROM IDF")
def vocab_idf_merged(spark, sf):
    """Statistics stored in two overlapping steps; the second counts only
    the rows that the first did not hold."""
    store = models.TermStore(spark, scratch_path(spark, "terms"))
    raw = td.corpus(spark, sf)
    number = F.substring("doi", 2, 20).cast("long")
    store.add("first", raw.where(number % 3 != 0), STOP)
    store.add("second", raw.where(number % 2 == 0).unionByName(raw.where(number % 3 == 0)), STOP)
    return store.idf().select("word", "df", "total", rnd("idf"))


@register("keywords_top20", O.with_(*TEXT_CTES)
          + "SELECT doi, title, keyword, weight, rank FROM KW")
def keywords_top20(spark, sf):
    return fixture_keywords(spark, sf)[0].drop("row")


@register("keyword_vocab_join", O.with_(*TEXT_CTES) + "SELECT doi, title, keyword, weight FROM KW")
def keyword_vocab_join(spark, sf):
    c, _, tf, idf = statistics(spark, sf)
    vocab = T.vocabulary(idf)
    by_index = T.keywords_by_index(T.tfidf(tf, idf, T.common_words(idf)), vocab)
    return T.keyword_vocab_join(by_index, vocab, c)


@register("keyword_vector_join", O.with_(*VECTOR_CTES[:9])
          + f"SELECT doi, keyword, weight, round(list_sum(weighted), {O.DP}) AS vsum FROM KV")
def keyword_vector_join(spark, sf):
    """J2 + T7: keywords that have a word vector, with the weighted vector
    summarised by its element sum."""
    kw, idf = fixture_keywords(spark, sf)
    kv = VEC.keyword_vectors(kw, td.word_vectors(spark, sf, idf.select("word", "total")))
    vsum = F.aggregate("weighted", F.lit(0.0), lambda a, x: a + x)
    return kv.select("doi", "keyword", "weight", F.round(vsum, O.DP).alias("vsum"))


@register("weighted_vectors", O.with_(*VECTOR_CTES[:9])
          + f"SELECT doi, keyword, CAST(generate_subscripts(weighted, 1) - 1 AS INTEGER) AS dim, "
            f"round(unnest(weighted), {O.DP}) AS value FROM KV")
def weighted_vectors(spark, sf):
    """Every element of the weighted keyword vectors."""
    kw, idf = fixture_keywords(spark, sf)
    kv = VEC.keyword_vectors(kw, td.word_vectors(spark, sf, idf.select("word", "total")))
    return kv.select("doi", "keyword", F.posexplode("weighted").alias("dim", "value")).select(
        "doi", "keyword", "dim", rnd("value"))


@register("doc_vectors", O.with_(*VECTOR_CTES[:14])
          + f"SELECT doi, title, dim, round(value, {O.DP}) AS value FROM DV")
def doc_vectors(spark, sf):
    return VEC.vector_elements(fixture_doc_vectors(spark, sf)).select("doi", "title", "dim", rnd("value"))


@register("similar_exact", O.with_(*VECTOR_CTES)
          + f"SELECT doi, title, round(distance, {O.DP}) AS distance FROM DIST "
            f"WHERE distance < {O.dbl(VEC.SIMILARITY_THRESHOLD)}")
def similar_exact(spark, sf):
    """J4 exact: every document within distance 2.0 of the query document."""
    docs = fixture_doc_vectors(spark, sf)
    return VEC.similar_exact(docs, first_doc(docs)).select("doi", "title", rnd("distance"))


@register("recommend", O.with_(*VECTOR_CTES)
          + f"SELECT doi, title, round(distance, {O.DP}) AS distance FROM DIST "
            f"WHERE distance < {O.dbl(VEC.SIMILARITY_THRESHOLD)} AND doi <> (SELECT min(doi) FROM DVL) "
            f"ORDER BY round(distance, {VEC.DISTANCE_TIE_DIGITS}), doi LIMIT {VEC.NEIGHBOURS}")
def recommend(spark, sf):
    """Ten nearest documents to the query document (exact distances)."""
    docs = fixture_doc_vectors(spark, sf)
    return VEC.recommend(docs, first_doc(docs)).select("doi", "title", rnd("distance"))


#: Hash tables of the registered LSH queries: with buckets five times the
#: threshold wide, a pair within it shares one of so many tables but for a
#: chance below 1e-12, so the exact result is their twin.
FULL_RECALL_TABLES = 16


@register("recommend_lsh", O.with_(*VECTOR_CTES)
          + f"SELECT doi, title, round(distance, {O.DP}) AS distance FROM DIST "
            f"WHERE distance < {O.dbl(VEC.SIMILARITY_THRESHOLD)} AND doi <> (SELECT min(doi) FROM DVL) "
            f"ORDER BY round(distance, {VEC.DISTANCE_TIE_DIGITS}), doi LIMIT {VEC.NEIGHBOURS}")
def recommend_lsh(spark, sf):
    """T9 + T10: the same request answered through the LSH index, saved and
    loaded before."""
    docs = fixture_doc_vectors(spark, sf)
    path = scratch_path(spark, "index")
    VEC.save_index(VEC.build_index(docs, num_tables=FULL_RECALL_TABLES), path)
    index = VEC.load_index(spark, path)
    return VEC.recommend(docs, first_doc(docs), exact=False, index=index).select("doi", "title", rnd("distance"))


@register("word2vec_vocab", O.with_(*TEXT_CTES[:4])
          + f"SELECT word, {VEC.W2V_SIZE} AS dim FROM IDF WHERE total >= {VEC.W2V_MIN_COUNT}")
def word2vec_vocab(spark, sf):
    """The trained vocabulary equals the words seen >= 3 times."""
    words = T.word_lists(corpus(spark, sf), STOP)
    return skipgram.train(words, VEC.W2V_SIZE, VEC.W2V_MIN_COUNT).select("word", F.size("vector").alias("dim"))


@register("recommend_word2vec", O.with_(*VECTOR_CTES[:9])
          + "SELECT (SELECT min(doi) FROM KV) AS query, true AS others_only, true AS near_only, true AS ten_at_most, "
            "true AS with_vectors_only")
def recommend_word2vec(spark, sf):
    """E1 end to end with trained vectors: tokens -> stop words -> Word2Vec
    + tf-idf keywords -> document vectors -> LSH -> ten neighbours.  The
    vectors are trained, so facts about the neighbours are returned."""
    c, words, tf, idf = statistics(spark, sf)
    trained = skipgram.train(words, VEC.W2V_SIZE, VEC.W2V_MIN_COUNT)
    kw = stored_keywords(c, tf, idf)
    docs = VEC.stored_document_vectors(kw, trained)
    release(kw)
    query = first_doc(docs)
    found = VEC.recommend(docs, query, exact=False).join(docs.select("doi", F.lit(True).alias("known")), "doi", "left")
    every = lambda c: F.coalesce(F.every(c), F.lit(True))
    return found.agg(F.lit(query).alias("query"), every(F.col("doi") != query).alias("others_only"),
                     every(F.col("distance") < VEC.SIMILARITY_THRESHOLD).alias("near_only"),
                     (F.count("*") <= VEC.NEIGHBOURS).alias("ten_at_most"),
                     every(F.coalesce("known", F.lit(False))).alias("with_vectors_only"))



@register("vector_lookup_sql", O.with_(*VECTOR_CTES[:15])
          + "SELECT doi, title, CAST(len(vector) AS INTEGER) AS dims, "
            f"round(list_sum(vector), {O.DP}) AS vsum FROM DVL WHERE doi = (SELECT min(doi) FROM DVL)")
def vector_lookup_sql(spark, sf):
    """Point lookup of the query document's vector with bound SQL."""
    docs = fixture_doc_vectors(spark, sf)
    hit = VEC.lookup_vector_sql(docs, first_doc(docs), "document_vectors")
    vsum = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return hit.select("doi", "title", F.size("vector").alias("dims"), F.round(vsum, O.DP).alias("vsum"))


@register("model_roundtrip", O.with_(*TEXT_CTES[:4])
          + f"SELECT word, {VEC.W2V_SIZE} AS dim, true AS same FROM IDF WHERE total >= {VEC.W2V_MIN_COUNT}")
def model_roundtrip(spark, sf):
    """A fitted Word2Vec model, a table of vectors, saved to the shared
    folder and loaded back serves the same vectors."""
    path = scratch_path(spark, "model")
    trained = cut_lineage(skipgram.train(T.word_lists(corpus(spark, sf), STOP), VEC.W2V_SIZE, VEC.W2V_MIN_COUNT))
    models.save_table(trained, path)
    back = models.load_table(spark, path).withColumnRenamed("vector", "loaded")
    both = trained.join(back, "word", "full_outer")
    return both.select("word", F.size("loaded").alias("dim"),
                       F.coalesce(F.col("vector") == F.col("loaded"), F.lit(False)).alias("same"))


@register("similar_lsh", O.with_(*VECTOR_CTES)
          + f"SELECT doi, title, round(distance, {O.DP}) AS distance FROM DIST "
            f"WHERE distance < {O.dbl(VEC.SIMILARITY_THRESHOLD)}")
def similar_lsh(spark, sf):
    """J4 approximate: documents within distance 2.0 of the query document
    found through the LSH buckets."""
    docs = fixture_doc_vectors(spark, sf)
    index = VEC.build_index(docs, num_tables=FULL_RECALL_TABLES)
    return VEC.similar_lsh(index, first_doc(docs)).select("doi", "title", rnd("distance"))


# ------------------------------------------------------- joins of vectors

JOIN_THRESHOLD, NEAR_THRESHOLD = 1.2, 0.5
#: Hashing of the registered join: a pair within the threshold misses all
#: tables with a chance below 1e-9, so the exact result is its twin.
HASHING = {"dims": 64, "tables": 12, "keys": 8, "width": 1.2, "probes": 33}


def _join_sql(vectors: str, threshold: float) -> str:
    return (f"WITH E AS MATERIALIZED ({vectors}) SELECT q.id AS query, e.id AS id, "
            f"round(sqrt(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(q.vector, e.vector)])), {O.DP}) AS distance "
            f"FROM E q JOIN E e ON q.id % 20 = 0 "
            f"WHERE sqrt(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(q.vector, e.vector)])) < {O.dbl(threshold)}")


@register("similarity_join_exact", _join_sql("SELECT vec_id AS id, [CAST(x AS DOUBLE) FOR x IN embedding] AS vector FROM embeddings", JOIN_THRESHOLD))
def similarity_join_exact(spark, sf):
    """J4 between tables: the embeddings with an id divisible by 20 against
    all, by cells around pivots."""
    docs = td.embeddings(spark, sf).withColumnRenamed("vec_id", "id")
    found = simjoin.similarity_join_exact(docs, docs.where("id % 20 = 0"), JOIN_THRESHOLD)
    return found.select("query", "id", rnd("distance"))


@register("similarity_join_lsh", _join_sql(
    f"SELECT vec_id * {td.VARIANTS} + n AS id, [CAST(embedding[i] AS DOUBLE) + n * {O.dbl(td.VARIANT_STEP)} * ((7 * (i - 1) + n) % 3 - 1) "
    f"FOR i IN range(1, len(embedding) + 1)] AS vector FROM embeddings, range({td.VARIANTS}) r(n)", NEAR_THRESHOLD))
def similarity_join_lsh(spark, sf):
    """J4 / T9 between tables: variants of the embeddings, those with an id
    divisible by 20 against all, by hash buckets with several probes."""
    docs = td.embedding_variants(spark, sf)
    found = simjoin.similarity_join_lsh(docs, docs.where("id % 20 = 0"), NEAR_THRESHOLD, **HASHING)
    return found.select("query", "id", rnd("distance"))


# ------------------------------------------- vectors of a large vocabulary

def fixture_ppmi(spark: SparkSession, sf: str) -> DataFrame:
    _, words, _, idf = statistics(spark, sf)
    known = idf.where(F.col("total") >= VEC.W2V_MIN_COUNT).select("word")
    return cooccurrence.ppmi(words, known)


@register("word_ppmi", O.with_(
    *TEXT_CTES[:4],
    f"K AS (SELECT t.row, t.i, t.word FROM (SELECT row, generate_subscripts(words, 1) AS i, unnest(words) AS word FROM W) t "
    f"JOIN IDF ON t.word = IDF.word WHERE IDF.total >= {VEC.W2V_MIN_COUNT})",
    f"D AS (SELECT unnest(range(1, {cooccurrence.WINDOW} + 1)) AS d)",
    "NEAR AS (SELECT a.row, a.word AS x, a.i + D.d AS j FROM K a, D)",
    "ONE AS (SELECT x, K.word AS y FROM NEAR JOIN K ON NEAR.row = K.row AND NEAR.j = K.i)",
    "C AS (SELECT word, context, count(*) AS n FROM (SELECT x AS word, y AS context FROM ONE UNION ALL "
    "SELECT y, x FROM ONE) t GROUP BY word, context)",
    "M AS (SELECT word, CAST(sum(n) AS DOUBLE) AS total FROM C GROUP BY word)",
    "J AS (SELECT C.word, C.context, C.n, C.n * (SELECT sum(total) FROM M) AS seen, a.total * b.total AS chance "
    "FROM C JOIN M a ON C.word = a.word JOIN M b ON C.context = b.word)")
    + f"SELECT word, context, n, round(ln(seen / chance), {O.DP}) AS ppmi FROM J WHERE seen > chance")
def word_ppmi(spark, sf):
    """The matrix that the vectors of a large vocabulary are taken from."""
    return fixture_ppmi(spark, sf).select("word", "context", "n", rnd("ppmi"))


@register("word_vectors_ppmi")
def word_vectors_ppmi(spark, sf):
    """T3 without a model on the driver: one vector a word, by subspace
    iteration on the table of :func:`word_ppmi`."""
    return cooccurrence.word_vectors(fixture_ppmi(spark, sf), VEC.W2V_SIZE)
