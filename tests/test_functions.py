"""Vector functions and their SQL forms against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import udfs as U
from lumenfold.functions import vector as V


def value(spark, col):
    return spark.range(1).select(col.alias("x")).head()[0]


def vec(*x):
    return V.lit_vector(x)


def test_arithmetic(spark):
    assert value(spark, V.add(vec(1, 2, 3), vec(1, 1, 1))) == [2, 3, 4]
    assert value(spark, V.sub(vec(3, 4, 5), vec(1, 1, 1))) == [2, 3, 4]
    assert value(spark, V.scale(vec(1, 2, 3), 2)) == [2, 4, 6]
    assert value(spark, V.norm(vec(3, 4, 0))) == 5
    assert value(spark, V.normalize(vec(3, 4, 0))) == pytest.approx([0.6, 0.8, 0])


def test_distances(spark):
    assert value(spark, V.l2_distance(vec(1, 0), vec(0, 1))) == pytest.approx(2**0.5)
    assert value(spark, V.cosine_distance(vec(1, 0), vec(0, 1))) == 1
    assert value(spark, V.cosine_distance(vec(1, 0), vec(0, 0))) == 1
    assert value(spark, V.cosine_similarity(vec(1, 0), vec(0, 0))) == 0
    assert value(spark, V.lp_distance(vec(0, 0), vec(3, 4), 2)) == pytest.approx(5)
    assert value(spark, V.l2_distance(vec(1, 0), F.lit(None).cast("array<double>"))) is None
    with pytest.raises(ValueError):
        V.lp_distance(vec(1), vec(1), 0)
    with pytest.raises(Exception, match="dim mismatch"):
        value(spark, V.l2_distance(vec(1, 0), vec(1, 0, 0)))


def test_quantized_forms(spark):
    q = value(spark, V.quantize_int8(vec(1, -0.5, 0)))
    assert q["codes"] == [127, -64, 0] and q["scale"] == pytest.approx(1 / 127)
    ten = vec(*([1, -1] * 5))
    assert bytes(value(spark, V.quantize_binary(ten))) == bytes([0b10101010, 0b10000000])
    assert value(spark, V.hamming_distance(V.quantize_binary(ten), V.quantize_binary(vec(*([1, -1] * 4 + [1, 1]))))) == 1


def test_text_and_packed_forms(spark):
    assert value(spark, V.from_text(F.lit("[1, 2.5]"))) == [1, 2.5]
    assert value(spark, V.to_json(vec(1, 2))) == "[1.0,2.0]"
    assert value(spark, U.decode_packed(U.encode_packed(vec(1, 2)))) == [1, 2]


def test_sql_names(spark):
    names = U.register(spark, "lf_")
    assert len(names) > 35
    assert spark.sql("SELECT lf_vector_l2_distance(array(1d, 0d), array(0d, 1d))").head()[0] == pytest.approx(2**0.5)
    assert spark.sql("SELECT lf_vector_dims(lf_vector(5))").head()[0] == 5
    assert spark.sql("SELECT lf_dimension_dfa(array(1d, 2d))").head()[0] is None
    assert spark.sql("SELECT lf_change_point_detect(concat(array_repeat(0d, 20), array_repeat(5d, 20)), 5, 1d)").head()[0] == [20]
    assert spark.sql("SELECT lf_vector_from_text('[1, 2]')").head()[0] == [1, 2]


def test_ordered_series_and_fingerprints(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (1, 1, 4.0), (2, 1, 7.0)], "g int, t int, v double")
    assert {r.g: r.series for r in U.ordered_series(df, ["g"], "t", "v").collect()} == {1: [4, 5], 2: [7]}
    from lumenfold.functions.kernels import fingerprint

    one = spark.createDataFrame([([0.5, -1.0, 2.0],), (None,)], "v array<double>").select(U.fingerprints(F.col("v"), 12, 3).alias("f")).collect()
    assert bytes(one[0].f) == fingerprint([0.5, -1.0, 2.0], 12, 3) and one[1].f is None
