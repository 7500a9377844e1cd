import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import spans as S
from veilframe.functions import validators as V
from veilframe.operators import detect as D
from veilframe.plans.queries import QUERIES, SQL

GOLDEN = [
    ("pay to user@okhdfcbank now", "UPI_VPA@7-22"),
    ("john.doe@example.com", "EMAIL_ID@0-20"),
    ("contact me@office", "UPI_VPA@8-17"),
    ("order 123456789012 shipped", ""),
    ("id 099999999999 end", ""),
    ("short 12345 end", ""),
    ("username john_doe_99", "USERNAME@9-20"),
    ("password: s3cret!", "PASSWORD@10-17"),
    ("account number 123456789012", "BANK_ACCOUNT@15-27"),
    ("PIN: 4829", "PIN@5-9"),
    ("482910", ""),
    ("OTP 482910", "OTP@4-10"),
    ("tax id: AB-123456", "TAX_ID@8-17"),
    ("device id: 12:34:ab-x", "DEVICE_ID@11-21"),
    ("employee id: E-12345", "EMPLOYEE_ID@13-20"),
    ("customer no. C12345", "CUSTOMER_ID@13-19"),
    ("café \U0001f600 john@x.org", "EMAIL_ID@7-17"),
    ("éuser@x.com", "EMAIL_ID@1-11"),
    ("4111 1111 1111 1111 ", "CARD_NUMBER@0-20"),
    ("GB82WEST12345698765432", "IBAN@0-22"),
    ("192.168.1.1 and 256.1.1.1", "IP_ADDRESS@0-11"),
    ("", ""),
    (None, ""),
]


def test_golden_spans(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "doc_id long, text string")
    got = {r.doc_id: r.d for r in D.detect(df).select("doc_id", S.listed(F.col("detections")).alias("d")).collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [d for _, d in GOLDEN]


def test_redaction_and_confidence(spark):
    df = spark.createDataFrame([(1, "username john_doe_99 mail a@b.org"), (2, None), (3, "OTP 482910")], "doc_id long, text string")
    rows = {r.doc_id: r for r in D.process(df).collect()}
    assert rows[1].redacted == "username <USERNAME> mail <EMAIL_ID>"
    assert rows[2].redacted is None and rows[2].detections == []
    assert rows[3].detections[0].confidence >= 0.75 and "value" not in rows[3].detections[0].asDict()


def test_verhoeff_finds_exactly_one_check_digit(spark):
    df = spark.createDataFrame([(str(n),) for n in range(234567890120, 234567890130)], "v string")
    assert df.where(V.verhoeff(F.col("v"))).count() == 1


@pytest.mark.parametrize(("value", "ok"), [("4111111111111111", True), ("4111-1111-1111-1111", True), ("4111111111111112", False), ("411111111111", False), (None, False)])
def test_luhn(spark, value, ok):
    assert spark.createDataFrame([(value,)], "v string").select(V.luhn(F.col("v"))).first()[0] is ok


def test_placeholder_guard(spark):
    df = spark.createDataFrame([("My name is <FIRST_NAME> and I live in Berlin.",)], "text string")
    span = lambda a, b: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(0).alias("rank"), F.lit("X").alias("type"), F.lit("").alias("value"), F.lit(0.5).alias("confidence"), F.lit("ner").alias("source"))
    kept = df.select(S.without_holes(F.col("text"), F.array(span(10, 15), span(36, 42))).alias("k")).first().k
    assert [(s.start, s.end) for s in kept] == [(36, 42)]


def test_self_audit_blocks_and_uses_model_findings(spark):
    df = spark.createDataFrame([(1, "Ann lives here"), (2, "mail a@b.org")], "doc_id long, text string")
    model = spark.createDataFrame([(1, "FIRST_NAME", 0, 3, 0.9)], "doc_id long, type string, start int, end int, score double")
    rows = {r.doc_id: r for r in D.self_audit(df, model=model).collect()}
    assert rows[1].redacted == "<FIRST_NAME> lives here" and not rows[1].blocked
    assert rows[2].redacted == "mail <EMAIL_ID>" and rows[2].reason is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="a1@. -:PINpin<>", max_size=40), min_size=1, max_size=20))
def test_spans_are_disjoint_and_match_their_text(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in D.detect(df).collect():
        last = 0
        for s in r.detections:
            assert s.start >= last and r.text[s.start : s.end] == s.value
            last = s.end


def test_unlabeled_formats(spark):
    df = spark.createDataFrame([("card ending in 3524, W XYZ0LM 1234, 1Z999AA10123456784, mina dot solberg at gmail",), ("weekends 2024 and Harbor@2019",)], "text string")
    got = [[(s.type, s.value) for s in r.s] for r in df.select(D.unlabeled_spans(F.col("text")).alias("s")).collect()]
    assert ("CARD_NUMBER", "3524") in got[0] and ("EMAIL", "mina dot solberg at gmail") in got[0] and ("TRACKING_NUMBER", "1Z999AA10123456784") in got[0]
    assert ("IFSC", "W XYZ0LM 1234") in got[0] and got[1] == [("PASSWORD", "Harbor@2019")]


@pytest.mark.parametrize(
    ("name", "number", "texts"),
    [
        ("p6_aadhaar", "234567890124", ['token = "8b540ef2c226668020056c2469c653445539f8d7"', "x2345 6789 0124", "2345-6789-0124_", "2345\v6789\v0124", "é234567890124é"]),
        ("p11_card_number", "4111111111111111", ['token = "068c002651439458202064d35406d6b34bf01abe"', "x4111 1111 1111 1111 1111 1", "4111-1111-1111-1111_", "é4111111111111111é"]),
    ],
)
def test_numbers_between_letters_count_as_in_the_sql(spark, tmp_path, name, number, texts):
    rng = random.Random(7)
    edges = ["", " ", "-", "a", "_", "é", "\n", "\t", "\v", "\u00a0", "7", ".", "  "]
    for _ in range(1500):
        gap = rng.choice(edges)
        put = gap.join(number[i : i + 4] for i in range(0, len(number), 4))
        texts = [*texts, "".join(rng.choice(edges) for _ in range(2)).join(["", put, rng.choice(["", put, "12"])]) + rng.choice(edges)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(SQL[name]).fetchall()
    assert len(want) > 100 and sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want)
