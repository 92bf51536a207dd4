"""Ranges of a text key from the data."""

import random

import pytest
from pyspark.sql import functions as F

from papyrus.functions.quantiles import KeySketch, key_bounds, key_sketch
from papyrus.sources import papers
from papyrus.sources import testdata as td


def sizes(df, column, bounds):
    return [df.where(p).count() for p in papers.key_ranges(column, bounds)]


def test_sketch_keeps_the_number_of_rows():
    rng = random.Random(1)
    sketch = KeySketch(64)
    for n in (1, 63, 64, 65, 1000, 3, 5000):
        sketch.add([f"{rng.random():.9f}" for _ in range(n)])
    rows = sketch.rows()
    assert (2 ** rows["level"]).sum() == 1 + 63 + 64 + 65 + 1000 + 3 + 5000
    assert all(len(x) <= 64 for x in sketch.levels)


def test_parts_are_even_over_many_tasks(spark):
    """400,000 keys with one long prefix, in rising order over 150 tasks (five
    merges): every part is within a tenth of its share."""
    keys = spark.range(0, 400_000, 1, 150).select(
        F.concat(F.lit("10.1000/journal."), F.format_string("%09d", F.col("id") * 7)).alias("paper_doi"))
    for parts in (2, 16, 40):
        got = sizes(keys, "paper_doi", papers.paper_bounds(keys, parts))
        assert len(got) == parts + 1 and got[-1] == 0 and sum(got) == 400_000
        assert all(abs(n - 400_000 / parts) <= 0.1 * 400_000 / parts for n in got[:-1])


def test_shuffled_keys_and_a_heavy_one(spark):
    """A third of the rows have one key: it is in one range, the rest even."""
    keys = spark.range(0, 90_000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, "m").otherwise(F.sha1(F.col("id").cast("string"))).alias("k"))
    bounds = key_bounds(keys, "k", 12)
    assert bounds == sorted(set(bounds))
    got = sizes(keys, "k", bounds)
    assert sum(got) == 90_000
    assert sorted(got)[-1] <= 30_000 + 7_500 * 1.1 and sorted(got)[-2] <= 7_500 * 1.1


def test_odd_columns(spark):
    some = spark.createDataFrame([("a",), (None,), ("",), ("O'x",), ("é",), ("a",)], "k string")
    bounds = key_bounds(some, "k", 3)
    assert sum(sizes(some, "k", bounds)) == 6
    assert key_bounds(some, "k", 1) == []
    assert key_bounds(some.where("k IS NULL"), "k", 4) == []
    assert key_bounds(spark.createDataFrame([("x",)] * 50, "k string"), "k", 5) == ["x"]
    assert key_sketch(some.where("false"), "k").count() == 0
    with pytest.raises(ValueError):
        key_bounds(some, "k", 0)


def test_parts_of_the_papers(spark, tmp_path):
    """The papers of sf0.01, read from files."""
    td.papers(spark, "/root/testdata/sf0.01").write.parquet(str(tmp_path / "papers"))
    table = papers.read_papers(spark, str(tmp_path / "papers"))
    got = sizes(table, "paper_doi", papers.paper_bounds(table, 8))
    share = table.count() / 8
    assert all(abs(n - share) <= 0.1 * share for n in got[:-1])
