import time

import pytest
from pyspark.sql import functions as F

from veilframe.functions import validators as V

PASSWORDS = {"abc123": True, "abc12": False, "abcdef": False, "123456": False, "a@b": True, "--\n  ab1234": True, "abc\n1234567": False, "1234567a\nb": True, "": False, None: False}


@pytest.mark.parametrize("passes", [V.field_value_passes, V.secret_value_passes])
def test_password_shapes(spark, passes):
    df = spark.createDataFrame([(v,) for v in PASSWORDS], "v string")
    assert {r.v: r.ok for r in df.select("v", passes(F.lit("PASSWORD"), F.col("v")).alias("ok")).collect()} == PASSWORDS


def test_long_line_without_digit(spark):
    df = spark.createDataFrame([("word " * 100_000,)], "v string")
    begin = time.time()
    assert not df.select(V.field_value_passes(F.lit("PASSWORD"), F.col("v"))).first()[0]
    assert time.time() - begin < 20
