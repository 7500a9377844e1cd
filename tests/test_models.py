import json

from pyspark.sql import functions as F

from veilframe.functions import geometry as G
from veilframe.operators import models as M
from veilframe.sources import files as S


def test_word_entities(spark):
    tokens = [("Ann", "B-NAME", 0.9, 0, 3), ("ie", "O", 0.1, 3, 5), (" Lee", "I-NAME", 0.8, 5, 9), (" in", "O", 0.9, 9, 12), (" Rome", "B-CITY", 0.2, 12, 17), (" 12", "I-AGE", 0.5, 17, 20)]
    df = spark.createDataFrame([(tokens,)], "t array<struct<text:string,label:string,score:double,start:int,end:int>>")
    got = [(e.entity, e.start, e.end, round(e.score, 3)) for e in df.select(M.word_entities(F.col("t")).alias("e")).first().e]
    assert got == [("NAME", 0, 9, 0.6), ("AGE", 17, 20, 0.5)]


def test_adjacent_entities(spark):
    df = spark.createDataFrame([(1, "A", 0, 3, 0.9), (1, "A", 4, 6, 0.7), (1, "B", 7, 9, 0.8), (1, "B", 12, 13, 0.5)], "d int, entity string, start int, end int, score double")
    got = sorted((r.entity, r.start, r.end, r.score) for r in M.adjacent_entities(df, ["d"]).collect())
    assert got == [("A", 0, 6, 0.7), ("B", 7, 9, 0.8), ("B", 12, 13, 0.5)]


def test_token_offsets(spark):
    df = spark.createDataFrame([("a bb  a", ["a", " bb", " x", "a"])], "text string, t array<string>")
    assert [(o.start, o.end) for o in df.select(M.token_offsets(F.col("text"), F.col("t")).alias("o")).first().o] == [(0, 1), (1, 4), (4, 4), (6, 7)]


def test_first_json():
    assert M.first_json('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert M.first_json("<think>{x</think> so {redactions: [1], b: {c: 2}} end") == '{"redactions": [1], "b": {"c": 2}}'
    assert M.first_json('{"a": {"b": 1') == '{"a": {"b": 1}}' and M.first_json("nothing") is None and M.first_json(None) is None


def test_clean_caption():
    known = [{"text": "4906 5637 6032", "type": "CARD"}, {"text": "Ann Lee", "type": "NAME"}, {"text": "India", "type": "COUNTRY"}]
    assert M.clean_caption("Ann  Lee of India has 490656376032. Ann Lee of India has 490656376032.", known) == "[REDACTED:NAME] of India has [REDACTED:CARD]."
    assert len(M.clean_caption("One sentence of many words is here now. " + "x " * 500, [])) <= 600 and M.clean_caption(None, []) is None


def test_redact_chunks(spark):
    chunks = spark.createDataFrame([(1, "a", "mail a@b.org and A@B.ORG, a+b"), (1, "b", None)], "d int, id string, text string")
    found = spark.createDataFrame([(1, "a", "EMAIL", "a@b.org"), (1, "a", "X", "a+b"), (1, "c", "X", "z")], "d int, source_id string, entity string, text string")
    rows = {r.id: r for r in M.redact_chunks(chunks, found, ["d"]).collect()}
    assert rows["a"].text == "mail [REDACTED:EMAIL] and [REDACTED:EMAIL], [REDACTED:X]" and rows["a"].redacted and rows["b"].text is None and not rows["b"].redacted


def test_faces_and_regions(spark):
    boxes = [0.1, 0.1, 0.3, 0.3] + [0.0] * 12 + [0.11, 0.11, 0.31, 0.31] + [0.0] * 12 + [0.5, 0.5, 0.9, 0.9] + [0.0] * 12
    df = spark.createDataFrame([(1, 100, 100, boxes, [0.9, 0.8, 0.95])], "i int, width int, height int, boxes array<double>, scores array<double>")
    got = M.faces(df, ["i"]).orderBy("source_id").collect()
    assert [(f.source_id, f.score) for f in got] == [("face_000", 0.95), ("face_001", 0.9)]
    r = spark.createDataFrame([("FACE", 100, 100, (0.0, 0.0, 10.0, 10.0)), ("ID", 100, 100, None)], f"entity string, width int, height int, box {G.BOX}")
    rows = {x.entity: x for x in M.regions(r).collect()}
    assert tuple(rows["FACE"].region) == (0, 0, 13, 13) and rows["FACE"].style == "blur" and rows["ID"].region is None


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"_fixture": "a.html", "entities": [{"id": "e", "entity_type": "EMAIL", "text": "x@y.z", "action": "REDACT"}]}, indent=1))
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "visual-tasks.json").write_text(json.dumps({"tasks": [{"id": "t", "fixture": "a", "kind": "static", "check": "li-count", "expected": 3}]}))
    assert [(r.fixture, r.gt_id, r.text) for r in S.ground_truth(spark, str(tmp_path)).collect()] == [("a", "e", "x@y.z")]
    assert S.visual_tasks(spark, str(tmp_path)).first().expected == "3"
    df = spark.createDataFrame([("data:image/png;base64,YWJj",), ("http://x",)], "u string")
    assert [r[0] for r in df.select(S.data_url(F.col("u"))).collect()] == [b"abc", None]
    assert S.markdown(spark.createDataFrame([(1, None)], "a int, b string")) == "| a | b |\n|---|---|\n| 1 | - |\n"
    top = spark.createDataFrame([(1, "top"), (2, "alone")], "p int, text string")
    kids = spark.createDataFrame([(1, 1, "second"), (1, 0, "first"), (1, 2, None)], "p int, frame_ord int, text string")
    assert {r.p: (r.text, r.unreachable) for r in S.frames(top, kids, ["p"]).collect()} == {1: ("top\n\nfirst\n\nsecond", 1), 2: ("alone", 0)}
    answer = 'event: x\ndata: {"result":{"tools":[{"name":"click","description":"d"}]}}\n'
    assert spark.createDataFrame([(answer,)], "a string").select(S.tools_of(F.col("a")).alias("t")).first().t[0].name == "click"
