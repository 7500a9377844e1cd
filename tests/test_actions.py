from datetime import datetime

from pyspark.sql import functions as F

from veilframe.operators import actions as A
from veilframe.streaming import streams as M


def at(s):
    return datetime(2024, 1, 1, 0, s // 60, s % 60)


def test_destructive(spark):
    rows = [("click", "Delete it", "", "", False), ("click", "Next", "", "", False), ("type", "", "", "file", False), ("type", "", "", "Email", False), ("scroll", "", "", "", False), ("submit", "", "", "", False), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "tool string, label string, text string, input_type string, is_form_submit boolean")
    got = [r.reasons for r in A.gate(df).collect()]
    assert got == [["keyword:delete|remove|erase|destroy|wipe"], [], ["unknown-input-type:file"], [], [], ["form-submit"], ["unknown-tool:(missing)"]]


def test_correlation(spark):
    q = spark.createDataFrame([("a", 1, at(0)), ("b", 1, at(0)), ("a", 1, at(5)), ("a", 2, at(0))], "client string, id int, at timestamp")
    r = spark.createDataFrame([("a", 1, "ok", at(10)), ("a", 1, "ok", at(11)), ("a", 2, "ok", at(90))], "client string, id int, status string, at timestamp")
    got = {(x.client, x.id, x.at): x.status for x in A.correlate(q, r).collect()}
    assert got == {("a", 1, at(0)): "ok", ("a", 1, at(5)): "duplicate", ("b", 1, at(0)): "timeout", ("a", 2, at(0)): "timeout"}


def test_codes(spark):
    events = [("c", 0.0, "issue"), *[("c", float(i), "wrong") for i in range(1, 6)], ("c", 10.0, "right"), ("c", 70.0, "right"), ("c", 71.0, "right"), ("d", 0.0, "issue"), ("d", 700.0, "right"), ("e", 1.0, "right")]
    df = spark.createDataFrame(events, "code_id string, at double, kind string")
    want = ["issued", *["incorrect"] * 4, "locked", "locked", "ok", "unknown", "issued", "expired", "unknown"]
    assert [r.outcome for r in M.replay_codes(df).orderBy("code_id", "at").collect()] == want


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "mail a@b.org"), (2, None)], "doc_id long, text string").write.parquet(str(src))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(src))
    q = M.redact_stream(stream).writeStream.format("memory").queryName("red").start()
    q.processAllAvailable()
    q.stop()
    assert {r.doc_id: r.redacted for r in spark.table("red").collect()} == {1: "mail <EMAIL_ID>", 2: None}


def test_code_stream(spark, tmp_path):
    src = tmp_path / "codes"
    spark.createDataFrame([("c", 0.0, "issue"), ("c", 1.0, "wrong"), ("c", 2.0, "right")], "code_id string, at double, kind string").write.parquet(str(src))
    stream = spark.readStream.schema("code_id string, at double, kind string").parquet(str(src))
    q = M.stream_codes(stream).writeStream.format("memory").queryName("codes").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [r.outcome for r in spark.table("codes").orderBy("at").collect()] == ["issued", "incorrect", "ok"]


def test_tool_calls(spark):
    df = spark.createDataFrame([('{"tool":"click","args":{"ref":"el_1"}}',), ("no",), ('{"tool":"fly","args":{}}',), ('{"tool":"click","args":3}',)], "t string")
    assert [r.c.problem for r in df.select(A.tool_call(F.col("t")).alias("c")).collect()] == [None, "not-json", "unknown-tool", "bad-arguments"]


def test_answers_and_timeouts_of_streams(spark, tmp_path):
    q, r = tmp_path / "q", tmp_path / "r"
    late = datetime(2024, 1, 1, 2)
    spark.createDataFrame([("a", 1, at(0)), ("b", 1, at(0)), ("z", 9, late)], "client string, id int, at timestamp").coalesce(1).write.parquet(str(q))
    spark.createDataFrame([("a", 1, "ok", at(10)), ("b", 1, "ok", at(90)), ("z", 8, "ok", late)], "client string, id int, status string, at timestamp").coalesce(1).write.parquet(str(r))
    requests = spark.readStream.schema("client string, id int, at timestamp").parquet(str(q))
    responses = spark.readStream.schema("client string, id int, status string, at timestamp").parquet(str(r))
    run = M.answered(requests, responses).writeStream.format("memory").queryName("answered").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    got = {x.client: x.status for x in spark.table("answered").collect()}
    assert got["a"] == "ok" and got.get("b", "timeout") == "timeout" and "z" not in got


def test_distinct_requests(spark, tmp_path):
    src = tmp_path / "d"
    spark.createDataFrame([("a", 1, at(0)), ("a", 1, at(3)), ("b", 1, at(0))], "client string, id int, at timestamp").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("client string, id int, at timestamp").parquet(str(src))
    run = M.distinct_requests(stream).writeStream.format("memory").queryName("distinct_requests").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("distinct_requests").count() == 2


def test_requests_on_a_stream(spark, tmp_path):
    rows = [("a", "1", 0.0, "request"), ("a", "1", 1.0, "request"), ("a", "1", 2.0, "response"), ("a", "1", 3.0, "response"), ("a", "2", 4.0, "request"), ("a", "", 5.0, "close"), ("a", "2", 6.0, "response")]
    spark.createDataFrame(rows, "client string, id string, at double, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("client string, id string, at double, kind string").parquet(str(tmp_path / "in"))
    run = M.stream_requests(stream).writeStream.format("memory").queryName("requests").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    got = [r.outcome for r in spark.table("requests").orderBy("at").collect()]
    assert got == ["sent", "duplicate-id", "answered", "dropped", "sent", "swept 1", "dropped"]
    assert sorted(r.outcome for r in M.replay_requests(spark.createDataFrame(rows, "client string, id string, at double, kind string")).collect()) == sorted(got)
