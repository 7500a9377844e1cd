import pytest

from veilframe.functions import geometry as G
from veilframe.operators import fuse as U
from veilframe.operators import layout as L
from pyspark.sql import functions as F


def items(spark, *rows):
    data = [(1, i, f"ocr_{i}", t, 0.9, tuple(map(float, b))) for i, (t, b) in enumerate(rows)]
    return spark.createDataFrame(data, f"image_id int, ord long, id string, text string, confidence double, box {G.BOX}")


def values(df):
    return sorted((r.field_type, r.value) for r in df.collect())


def test_reading_order(spark):
    df = items(spark, ("Certificate No: ABC123XY98", (100, 300, 620, 340)), ("Name: John", (100, 100, 300, 130)), ("Batch: 98", (100, 500, 200, 530)))
    assert [r.id for r in L.reading_order(df, ["image_id"]).orderBy("reading_order").collect()] == ["ocr_1", "ocr_0", "ocr_2"]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("Certificate No: ABC123XY98", (100, 300, 620, 340))], [("CERTIFICATE_NUMBER", "ABC123XY98")]),
        ([("Certificate No:", (100, 300, 300, 330)), ("ABC123XY98", (100, 340, 300, 370))], [("CERTIFICATE_NUMBER", "ABC123XY98")]),
        ([("Certiflcate N0", (100, 300, 280, 330)), ("ABC123", (400, 300, 600, 330))], [("CERTIFICATE_NUMBER", "ABC123")]),
        ([("Certificate Number", (100, 300, 280, 330)), ("ABC 123 XY 98", (400, 300, 600, 330))], [("CERTIFICATE_NUMBER", "ABC 123 XY 98")]),
        ([("ending", (0, 0, 50, 20)), ("3524", (60, 0, 100, 20))], [("CARD_NUMBER", "3524")]),
        ([("Hello World", (0, 0, 100, 20))], []),
    ],
)
def test_field_candidates(spark, rows, want):
    assert values(L.field_candidates(items(spark, *rows), ["image_id"])) == want


def test_fusion(spark):
    schema = f"image_id int, source string, ids array<string>, text string, label string, type string, confidence double, box {G.BOX}, ord long"
    box = (0.0, 0.0, 10.0, 10.0)
    line = "Old account ending 3524 was closed by the bank in the year two thousand"
    df = spark.createDataFrame(
        [
            (1, "ner", ["a"], "ABC123XY98", None, "ID", 0.9, box, 0), (1, "ner", ["a"], "98", None, "ID", 0.6, box, 1),
            (2, "ner", ["a"], "X1", None, "ID", 0.9, box, 0), (2, "deterministic_context", ["a"], "X1", "No", "NUM", 0.95, box, 1),
            (3, "ner", ["a"], "X1", None, "ID", 0.9, box, 0), (3, "ner", ["b"], "X2", None, "ID", 0.9, (20.0, 0.0, 30.0, 10.0), 1),
            (4, "ner", ["a"], line, None, "ID", 0.8, box, 0), (4, "deterministic_context", ["a"], "3524", None, "CARD_NUMBER", 0.9, box, 1),
        ],
        schema,
    )
    got = {}
    for r in U.fuse(df, ["image_id"]).collect():
        got.setdefault(r.image_id, []).append((r.text, r.sources))
    assert got[1] == [("ABC123XY98", ["ner"])] and got[2] == [("X1", ["deterministic_context", "ner"])]
    assert len(got[3]) == 2 and got[4] == [("3524", ["deterministic_context", "ner"])]


def test_geometry(spark):
    row = spark.range(1).select(
        G.iou(G.box(*map(F.lit, (0, 0, 10, 10))), G.box(*map(F.lit, (5, 5, 15, 15)))).alias("iou"),
        G.clamp(G.box(*map(F.lit, (-10, -5, 510, 310))), F.lit(500), F.lit(300)).alias("c"),
        G.clamp(G.box(*map(F.lit, (600, 0, 700, 10))), F.lit(500), F.lit(300)).alias("none"),
        G.sub_box(G.box(*map(F.lit, (100, 100, 300, 140))), F.lit("DOB : 05/07/2002"), F.lit("05/07/2002")).alias("s"),
    ).first()
    assert abs(row.iou - 25 / 175) < 1e-9 and tuple(row.c) == (0, 0, 500, 300) and row.none is None and row.s.x1 > 100 and row.s.y2 == 140


def test_suppression(spark):
    rows = [(0.95, (100.0, 100.0, 200.0, 200.0)), (0.85, (105.0, 105.0, 195.0, 195.0)), (0.9, (300.0, 300.0, 400.0, 400.0))]
    df = spark.createDataFrame([(rows,)], f"b array<struct<score:double,box:{G.BOX}>>")
    assert [x.score for x in df.select(G.suppress(F.col("b")).alias("k")).first().k] == [0.95, 0.9]


def test_gates(spark):
    schema = f"text string, score double, box {G.BOX}, entity string, types array<string>, sources array<string>, decision string, salvaged boolean, confirmed boolean, failed boolean, ocr_text string, ocr_box {G.BOX}"
    box = (0.0, 0.0, 10.0, 10.0)
    base = lambda text, score, b, entity="ID", **k: (text, score, b, entity, [entity], ["ner"], k.get("decision", "fusion_fallback"), False, False, k.get("failed", False), None, None)
    df = spark.createDataFrame([base("AB1234", 0.9, box), base("Certificate No", 0.9, box), base("AB1234", 0.1, box), base("AB1234", 0.9, None), base("AB1234", 0.6, box, failed=True), base("Ann Lee", 0.6, box, "FIRST_NAME"), base("AB1234", 0.6, box)], schema)
    assert [r.drop_gate for r in U.gates(df).collect()] == [None, 5, 6, 1, None, None, 6]
