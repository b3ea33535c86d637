import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thalweg.functions import scalars, transforms
from thalweg.functions.aggregators import AGGREGATORS, aggregate


def values(spark, xs):
    return spark.createDataFrame([(k, None if x is None else float(x)) for k, x in enumerate(xs)], "pos int, x double")


def agg(spark, method, xs):
    return values(spark, xs).agg(aggregate(method, "x", F.col("pos")).alias("v")).first()[0]


@pytest.mark.parametrize("method, expected", [("ARITH", 2), ("GEOM", 6 ** (1 / 3)), ("HARM", 18 / 11), ("ADJHARM", 18 / 11), ("MEDIAN", 2), ("MAX", 3), ("MIN", 1), ("SD", (2 / 3) ** 0.5), ("VAR", 2 / 3), ("CV", (2 / 3) ** 0.5 / 2), ("FIRST", 1), ("SUM", 6)])
def test_aggregators(spark, method, expected):
    assert agg(spark, method, [1, 2, 3]) == pytest.approx(expected)


def test_all_aggregators_are_covered():
    assert len(AGGREGATORS) == 12


def test_adjusted_harmonic(spark):
    assert agg(spark, "ADJHARM", []) is None or agg(spark, "ADJHARM", []) == 0
    assert agg(spark, "ADJHARM", [-1, -2, -3]) == 0
    assert agg(spark, "ADJHARM", [0, 1, 2, 3]) == pytest.approx(0.8181818)
    assert agg(spark, "ADJHARM", [5, 7, 0, 0]) == 0


@pytest.mark.parametrize("method, xs", [("HARM", [1, 2, 3, 0]), ("GEOM", [1, 2, 3, -1])])
def test_aggregator_domains(spark, method, xs):
    with pytest.raises(PySparkException):
        agg(spark, method, xs)


def test_unknown_aggregator():
    with pytest.raises(ValueError):
        aggregate("NONE", "x")
    with pytest.raises(TypeError):
        aggregate(3, "x")


def test_rescale(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 5.0), (3.0, 6.0)], "a double, b double")
    assert [tuple(r) for r in transforms.rescale_columns(df, ["a", "b"], 0, 10).collect()] == [(0, 0), (5, 5), (10, 10)]
    with pytest.raises(ValueError):
        transforms.rescale_columns(df, ["a"], 5, 5)
    with pytest.raises(ValueError):
        transforms.rescale_columns(df, ["a"], "0", 5)
    with pytest.raises(ValueError):
        transforms.rescale_columns(df.limit(0), ["a"])
    with pytest.raises(TypeError):
        transforms.rescale_columns([1, 2], ["a"])


def test_constant_column_rescales_to_null(spark):
    assert transforms.rescale_columns(values(spark, [4, 4]), ["x"]).first()["x"] is None


def curve(spark, t, shape, xs=tuple(range(11))):
    df = values(spark, xs)
    w = W.partitionBy()
    x = F.col("x")
    y = df.select("pos", transforms.transform(x, F.min(x).over(w), F.max(x).over(w), F.lit(t), F.lit(float(shape))).alias("y"))
    out = y.select("pos", transforms.rescale_over(F.col("y"), w).alias("y")).orderBy("pos")
    return [r["y"] for r in out.collect()]


def test_transform_relations(spark):
    ricker = curve(spark, 1, 3)
    assert curve(spark, 4, 3) == pytest.approx(ricker)
    assert curve(spark, 3, 3) == pytest.approx([1 - y for y in ricker])
    mono = curve(spark, 5, 3)
    assert mono == pytest.approx([(1 - math.exp(-x / 3)) / (1 - math.exp(-10 / 3)) for x in range(11)])
    assert curve(spark, 6, 3) == pytest.approx(mono[::-1])
    assert curve(spark, 7, 3) == pytest.approx([1 - y for y in mono])
    assert curve(spark, 8, 3) == pytest.approx([1 - y for y in mono][::-1])
    assert curve(spark, 0, 3) == curve(spark, 5, 0) == pytest.approx([x / 10 for x in range(11)])


@pytest.mark.parametrize("shape", [0, -1, "x", None])
def test_bad_shape(shape):
    with pytest.raises(ValueError):
        transforms.check_shape(shape)


def test_unknown_transform(spark):
    with pytest.raises(PySparkException):
        curve(spark, 9, 1)


def test_minmax_variants(spark):
    w = W.partitionBy()
    df = values(spark, [0, 2, 10])
    assert [r["x"] for r in transforms.minmax_nonzero(df, "x", w).orderBy("pos").collect()] == [0.2, 0.2, 1.0]
    masked = df.select("pos", transforms.masked_minmax(F.col("x"), F.col("x") > 0, w).alias("x")).orderBy("pos")
    assert [r["x"] for r in masked.collect()] == [0, 0, 1]
    flat = values(spark, [3, 3]).select(transforms.masked_minmax(F.col("x"), F.lit(True), w).alias("x"))
    assert [r["x"] for r in flat.collect()] == [3, 3]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_haversine(spark):
    assert one(spark, scalars.haversine(F.lit(48.8566), F.lit(2.3522), F.lit(51.5074), F.lit(-0.1278))) == pytest.approx(344, abs=1)


def test_combinations(spark):
    assert [one(spark, scalars.combinations(F.lit(n).cast("long"), k)) for n, k in ((5, 2), (10, 5), (0, 0), (2, 3))] == [10, 252, 1, 0]


def test_lists(spark):
    xs = F.array(*map(F.lit, [1, 2, 2, 3, 1, 4, 5, 4]))
    assert one(spark, scalars.unique(xs)) == [1, 2, 3, 4, 5]
    path = F.array(*map(F.lit, [1, 2, 3, 4, 5]))
    assert [one(spark, scalars.adjacent(path, F.lit(a), F.lit(b))) for a, b in ((1, 2), (4, 3), (1, 3), (6, 7))] == [True, True, False, False]


def test_information_criteria(spark):
    assert one(spark, scalars.aic(F.lit(-10.0), F.lit(3))) == 26
    assert one(spark, scalars.bic(F.lit(-10.0), F.lit(3), F.lit(math.e))) == pytest.approx(23)
    w = [r[0] for r in spark.range(50).select(scalars.signed_weight(1, 0.25).alias("w")).collect()]
    assert all(0.25 <= abs(x) <= 1 for x in w) and min(w) < 0 < max(w)


def test_minmax_of_stored_values(spark):
    cells = spark.createDataFrame([(0, 1, 2.0), (1, 0, 4.0), (2, 2, 3.0), (2, 3, None)], "i int, j int, value double")
    assert sorted((r.i, r.j, r.value) for r in transforms.minmax_stored(cells).collect()) == [(0, 1, 0.0), (1, 0, 1.0), (2, 2, 0.5), (2, 3, None)]
    same = cells.where("i = 0")
    assert transforms.minmax_stored(same).first()["value"] == 2.0
    assert transforms.minmax_stored(cells.limit(0)).count() == 0
