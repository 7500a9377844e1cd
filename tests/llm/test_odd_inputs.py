"""Every operator on nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from veilframe.llm import bpe, decontam, linededup, media, pii, quality, sharding, simhash, stages, toxicity, urlfilter

LONG = "lorem ipsum dolor sit amet\n" * 40_000
PATH = P.path("byte_bpe_50k.tiktoken")
CLASH = (
    "terms runs says fp k l n c h th a b y of_id of_th veil_k veil_l veil_x veil_y veil_n veil_th veil_runs veil_text veil_says veil_copies veil_items veil_first veil_terms veil_of_id "
    "key host path rule verdict entry component copies token items spans score predicted stat_n_words shard slot size ids tile media error email term n_words n_hit removed"
).split()


def rules(spark):
    return spark.createDataFrame(list(urlfilter.RULES), "verdict string, host string, path string"), spark.createDataFrame([("x.org/",)], "entry string")


def bench(spark):
    return spark.createDataFrame([(1, "sit amet lorem"), (None, "nothing of it"), (2, None)], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score(d, toxicity.Lexicon(toxicity.GENERAL, []), [-3.0, 1.0, 1.0]),
    "media": lambda s, d: media.text_media_digests(d),
    "tiles": lambda s, d: media.tiles(d.withColumn("image", F.col("text").cast("binary")), "image"),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "near_dedup": lambda s, d: simhash.one_of_each_group(d),
    "url_filter": lambda s, d: urlfilter.judge(d, *rules(s), url="text"),
    "sharding": lambda s, d: sharding.shards(d),
    "bpe": lambda s, d: bpe.with_digests(d, PATH, P.PATTERN),
    "quality": lambda s, d: quality.score(d, (0.0, [(((0, True, 3.0),), 1.0)])),
    "decontamination": lambda s, d: decontam.contamination(d, bench(s)),
    "decontamination in blocks": lambda s, d: decontam.contamination(d, bench(s), block_bytes=10),
    "line_dedup": lambda s, d: linededup.delete_repeated(d),
    "pii": lambda s, d: pii.find(d),
    "sanitise": lambda s, d: pii.sanitise(d),
}
SF = "/root/testdata/sf0.001"
STAGES = {name: getattr(stages, name) for name in ("quality", "line_dedup", "near_dedup", "decontamination", "bpe")}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, docs, name):
    texts = [None, "", " \n", "a@b.co and 10.0.0.1", "tie", "tie", "\U0001f600\u00e9\u4e2d \x00 end", LONG]
    table = docs(*texts, (None, "no id"), (None, None), (5, "tie"), (5, "tie"))
    for c in CLASH:
        table = table.withColumn(c, F.lit("clash"))
    out = OPERATORS[name](spark, table)
    got = out.select([c for c in out.columns if c not in ("text", "image")]).collect()
    n = table.select("text").distinct().count() - 1 if name == "near_dedup" else table.count()  # null is like empty
    assert len(got) == (n - 1 if name == "near_dedup" else n)  # " \\n" has no words either
    assert OPERATORS[name](spark, table.limit(0)).count() == 0


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows_of_stages(spark, docs, name):
    good = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    table = docs(None, "", " ", "tie", "tie", LONG[:100_000], (None, "no id"), (None, None), (4, "tie")).union(good)
    for c in ("runs", "k", "fp", "items", "ids", "score", "veil_first"):
        table = table.withColumn(c, F.lit("clash"))
    out = STAGES[name](spark, table, SF)
    assert name == "bpe" or out.columns == table.columns
    assert 0 < out.count() <= table.count()
    assert STAGES[name](spark, table.limit(0), SF).count() == 0
