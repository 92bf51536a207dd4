"""Stop-word lists (S3).

Deployments pass their own list file (one word per line) to
:func:`read_stopwords`.  The fixtures and tests use the short list below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Common English function words used as the fixture stop list
# (lower case, natural order).  The oracle SQL embeds the same list.
FIXTURE_STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before "
    "being below between both but by can did do does doing down during each few for from "
    "further had has have having he her here hers herself him himself his how i if in into "
    "is it its itself just me more most my myself no nor not now of off on once only or "
    "other our ours ourselves out over own same she should so some such than that the their "
    "theirs them themselves then there these they this those through to too under until up "
    "very was we were what when where which while who whom why will with you your yours "
    "yourself yourselves"
).split()


def read_stopwords(spark: SparkSession, path: str, strip: bool = True) -> DataFrame:
    """``(word)`` from a text file, one word per line.

    ``strip=True`` trims blanks around each line; ``strip=False`` keeps the
    line as is apart from its line break (the descriptive reports compare
    words exactly against such lines).  Empty lines are dropped.
    """
    lines = spark.read.text(path)
    word = F.trim(F.col("value")) if strip else F.regexp_replace(F.col("value"), "\r$", "")
    return lines.select(word.alias("word")).filter(F.col("word") != "").distinct()


def stopwords_frame(spark: SparkSession, words=FIXTURE_STOPWORDS) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def sql_values(words=FIXTURE_STOPWORDS) -> str:
    """The list as a DuckDB/ANSI ``VALUES`` table ``sw(word)``."""
    vals = ", ".join("('" + w.replace("'", "''") + "')" for w in words)
    return f"(VALUES {vals}) AS sw(word)"
