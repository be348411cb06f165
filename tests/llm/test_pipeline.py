"""The stages, one after another, each against what its operator says of its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from lagscope.llm.common import materialise, read
from lagscope.llm.decontamination import find_contamination
from lagscope.llm.mixing import mix_sources, taken_words
from lagscope.llm.near_dedup import near_duplicates
from lagscope.llm.quality import resample_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs, out = read(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        new = materialise(stage(spark, docs, SF), f"test-{name}")
        out.append((docs, new))
        docs = new
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_columns_and_texts_stay(tables):
    for docs, new in tables[:-1]:
        assert new.schema == docs.schema
    for docs, new in tables[:3]:
        assert new.exceptAll(docs).count() == 0


def test_quality(spark, tables):
    docs, new = tables[0]
    assert ids(new) == ids(resample_quality(docs, read(spark, SF, "labels")).filter("kept"))


def test_near_dedup(tables):
    docs, new = tables[1]
    assert ids(new) == ids(near_duplicates(docs).filter("kept")) and new.count() < docs.count()


def test_decontamination(spark, tables):
    docs, new = tables[2]
    assert ids(new) == ids(find_contamination(docs, read(spark, SF, "benchmark")).filter("n_hit = 0"))


def test_mixing(tables):
    docs, new = tables[3]
    words = new.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("words"))
    want = {r["id"]: r["taken"] for r in taken_words(mix_sources(docs)).filter("taken > 0").collect()}
    assert {r["doc_id"]: r["words"] for r in words.collect()} == want


def test_token_files(tables):
    docs, new = tables[4]
    assert new.count() == docs.count() and new.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
