import corpus_pipeline
from pyspark.sql import functions as F

from veilframe.llm import decontam
from veilframe.llm.queries import QUERIES, SQL
from veilframe.llm.simhash import jaccard, shingle_set

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs
        if name != "bpe":
            assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").count() == 0
    kept = {r.doc_id: shingle_set(r.text) for r in seen["near_dedup"].collect()}
    before = {r.doc_id: shingle_set(r.text) for r in seen["line_dedup"].collect()}
    for i in before.keys() - kept.keys():  # each that went has its like among those that stay
        assert any(jaccard(before[i], s) >= 0.8 for s in kept.values())
    windows = {w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in decontam.windows_of(r.text)}
    for r in seen["decontamination"].collect():
        line = b" " + b" ".join(decontam.words_of(r.text)) + b" "
        assert not any(b" " + w + b" " in line for w in windows)
    assert seen["bpe"].where("not round_trip").count() == 0 and seen["bpe"].where(F.size("ids") != F.col("n_tokens")).count() == 0
    assert seen["bpe"].count() == seen["decontamination"].count()


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and SQL.keys() <= QUERIES.keys()


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in SQL.items():
        got, want = QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        rows = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
        assert rows(got) == rows(want), name
