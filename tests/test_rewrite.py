"""Rewrites of tables, files, and rows from JSON."""

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import rewrite as R
from lumenfold.sources import formats


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"), spark.createDataFrame([(2, "x"), (3, "b"), (4, None), (4, None)], "k int, v string")


def rows(df):
    return sorted((r.k, r.v) for r in df.collect())


def test_insert_and_upsert(pair):
    old, new = pair
    assert rows(R.insert_new(old, new, ["k"])) == [(1, "a"), (2, None), (3, "c"), (4, None)]
    once = new.dropDuplicates(["k"])
    assert rows(R.upsert(old, once, ["k"])) == [(1, "a"), (2, "x"), (3, "b"), (4, None)]
    assert rows(R.upsert(old, once, ["k"], F.col("new_v") > F.col("v"))) == [(1, "a"), (2, None), (3, "c"), (4, None)]


def test_update_and_delete_leave_unknown_rows(pair):
    old, _ = pair
    assert rows(R.update_where(old, F.col("v") == "a", v=F.lit("z"))) == [(1, "z"), (2, None), (3, "c")]
    assert rows(R.delete_where(old, F.col("v") == "a")) == [(2, None), (3, "c")]


def test_limited(pair):
    old, _ = pair
    assert R.limited(old, 2)[1] and not R.limited(old, 3)[1] and R.limited(old, 0)[0] == []


@pytest.mark.parametrize("fmt", formats.FORMATS)
def test_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 'say "hi", ok'), (2, "é")], "k int, v string")
    formats.write(df, str(tmp_path / fmt), fmt)
    assert rows(formats.read(spark, str(tmp_path / fmt), df.schema, fmt)) == rows(df)
    with pytest.raises(ValueError):
        formats.read(spark, "x", df.schema, "xls")


def test_rows_of_json(spark):
    assert [(r.key, r.value.a) for r in formats.rows_of_json(spark, '[{"a": 5}, {"a": null}]', "struct<a:int>").collect()] == [(0, 5), (1, None)]
