from martlet.functions.casts import safe_double, safe_int


def test_safe_double(spark):
    df = spark.createDataFrame([("99.9",), ("abc",), ("",), (None,)], "x string")
    assert [r.v for r in df.select(safe_double("x").alias("v")).collect()] == [99.9, 0.0, 0.0, 0.0]
    assert [r.v for r in df.select(safe_double("x", None).alias("v")).collect()] == [99.9, None, None, None]


def test_safe_int(spark):
    df = spark.createDataFrame([("100",), ("3.7",), ("abc",), (None,)], "x string")
    assert [r.v for r in df.select(safe_int("x").alias("v")).collect()] == [100, 0, 0, 0]
    num = spark.createDataFrame([(3.7,), (None,)], "x double")
    assert [r.v for r in num.select(safe_int("x", numeric=True).alias("v")).collect()] == [3, 0]
    assert [r.v for r in num.select(safe_int("x", None, numeric=True).alias("v")).collect()] == [3, None]
