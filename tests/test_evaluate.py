from pyspark.sql import functions as F

from veilframe.functions import text as T
from veilframe.operators import evaluate as E
from veilframe.operators import stats as S


def test_scores(spark):
    truth = spark.createDataFrame([("f", 0, "g0", "EMAIL", "mina.solberg@gmail", "REDACT"), ("f", 1, "g1", "PHONE", "555 0142", "REDACT"), ("f", 2, "g2", "NAME", "meter 12", "LEAVE"), ("f", 3, "g3", "FACE", None, "REDACT")], "fixture string, gt_ord int, gt_id string, entity_type string, text string, action string")
    found = spark.createDataFrame([("f", 1, 0, "EMAIL", "Mina Dot Solberg At Gmail"), ("f", 1, 1, "ID", "meter 12")], "fixture string, run int, ord int, entity string, text string")
    row = E.score_runs(truth, found, found, ["fixture"], ["fixture", "run"]).first()
    assert (row.tp, row.fp, row.fn, row.over_redact, row.type_mismatch) == (1, 1, 1, 1, 0)
    total = E.micro(E.score_runs(truth, found, found, ["fixture"], ["fixture", "run"]), ["fixture"]).first()
    assert (total.precision, total.recall, total.f1) == (0.5, 0.5, 0.5)


def test_prf_of_nothing_is_null(spark):
    assert list(spark.range(1).select(*E.prf(*[F.lit(0)] * 3)).first()) == [None] * 3


def test_stats(spark):
    df = spark.createDataFrame([("a", x) for x in (4.0, 1.0, 2.0, 3.0)] + [("b", 7.0), ("c", float("nan"))], "k string, v double")
    rows = {r.k: r for r in S.summarize(df, ["k"], "v").collect()}
    assert (rows["a"].mean, rows["a"].median, rows["a"].p95, rows["a"].n) == (2.5, 2.5, 4.0, 4)
    assert rows["b"].std == 0 and rows["c"].n == 0 and rows["c"].mean is None
    assert spark.createDataFrame([(0, 10.0), (1, 12.0), (2, 14.0)], "x int, y double").select(S.slope(F.col("y"), F.col("x"))).first()[0] == 2


def test_text(spark):
    row = spark.createDataFrame([("Mina Dot Solberg At Gmail", "B-CITY")], "t string, l string").select(T.match_key(F.col("t")), *T.bio_label(F.col("l")), T.softmax(F.array(F.lit(0.0), F.lit(0.0)))[0]).first()
    assert list(row) == ["mina.solberg@gmail", "B", "CITY", 0.5]
