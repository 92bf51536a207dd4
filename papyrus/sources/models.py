"""Model and table persistence.

Fitted Spark ML models are saved with their own writers; the long-format
statistics (vocabulary, idf, word and document vectors) are plain parquet
tables, so a later job reloads them without refitting.  :class:`TermStore`
keeps document frequencies that later corpora extend.
"""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSHModel, Word2VecModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrus.operators import text


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_word2vec(path: str) -> Word2VecModel:
    return Word2VecModel.load(path)


def load_lsh(path: str) -> BucketedRandomProjectionLSHModel:
    return BucketedRandomProjectionLSHModel.load(path)


def save_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


class TermStore:
    """Stored term statistics that grow with the corpus.

    Below ``path`` lie ``counts`` (part, word, df, total), ``seen`` (part,
    digest of a corpus row) and ``manifest`` (part, rows), a table of
    one row per part that is written last: a part without it was interrupted
    and is neither read nor in the way of a new try under the same name.  A new
    part is tokenised alone; no earlier text is read again.  A corpus row that
    an earlier part holds is not counted twice (only digests are compared), so
    that parts give what their union gives in one go.  One writer at a time.

    Rows with a null ``doi``, ``title`` or ``abstract`` take no part; an empty
    part is noted and counts nothing.
    """

    _COUNTS = T.StructType([T.StructField("part", T.StringType()), T.StructField("word", T.StringType()),
                            T.StructField("df", T.LongType()), T.StructField("total", T.LongType())])
    _SEEN = T.StructType([T.StructField("part", T.StringType()), T.StructField("digest", T.BinaryType())])
    _MANIFEST = T.StructType([T.StructField("part", T.StringType()), T.StructField("rows", T.LongType())])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        """All parts of a table; an empty one where nothing is written yet."""
        folder = f"{self.path}/{table}"
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(folder)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder)

    def parts(self) -> DataFrame:
        """``(part, rows)`` of the parts that are stored whole."""
        return self._read("manifest", self._MANIFEST)

    def _whole(self, table: str, schema: T.StructType) -> DataFrame:
        return self._read(table, schema).join(self.parts().select("part"), "part", "left_semi")

    def _write(self, df: DataFrame, table: str, part: str) -> None:
        """One folder per part; an interrupted one is replaced."""
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/part={part}")

    def add(self, part: str, corpus: DataFrame, stop: list[str]) -> int:
        """Count the corpus rows ``(doi, title, abstract)`` that no part holds
        yet; returns their number.  A part's name, of letters, digits, ``-``
        and ``_``, is used once: adding it again raises ``ValueError``."""
        if not part or not part.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a part's name: {part!r}")
        if self.parts().where(F.col("part") == part).limit(1).count():
            raise ValueError(f"part {part!r} is stored already")
        digest = F.unhex(F.md5(F.to_json(F.struct("doi", "title", "abstract"))))
        rows = text.clean_corpus(corpus).withColumn("digest", digest)
        old = self._whole("seen", self._SEEN).select("digest")
        new = text.number_rows(rows.join(old, "digest", "left_anti"))
        tf = text.term_freq(text.word_lists(new.drop("digest"), stop))
        n = new.count()
        self._write(tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")), "counts", part)
        self._write(new.select("digest"), "seen", part)
        self._write(self.spark.range(1).select(F.lit(n).cast("long").alias("rows")), "manifest", part)
        return n

    def idf(self) -> DataFrame:
        """``(word, df, total, idf)`` over all parts, as :func:`text.idf_table`
        gives for their union."""
        n = self.parts().agg(F.sum("rows")).first()[0] or 0
        sums = self._whole("counts", self._COUNTS).groupBy("word").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        return sums.withColumn("idf", text.idf_of(F.col("df"), n))
