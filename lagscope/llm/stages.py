"""Pipeline stages: each lets one operator's decision take effect on a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, read, scratch_path, vocabulary_path
from .decontamination import find_contamination
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .quality import keep_quality
from .token_files import read_token_files, token_index, write_token_files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling draws.

    Defined cases: a null or empty text, or one of white space alone, has no weight and goes; a very long text is
    weighed whole; ties at the last draw and repeated rows stay or go together; a null id is judged by its text; no
    documents give none, and no labels of both kinds keep all that have a weight; columns of any other name pass.
    """
    return keep_quality(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near duplicates, that of the least id.

    Rows are judged one by one, by id and text together: of several texts of one id each stays unless it is a
    near copy of a row that stays.

    Defined cases: rows with null or empty texts, or white space alone, are copies of nothing and all stay; null
    ids are judged like others, after them; a very long text counts whole; of rows with the same id and text one
    stays, the same in every run; no documents give none; columns of any other name pass.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("doc_id", "text").alias("node"))
    judged = near_duplicates(rows, id_col="node")
    nodes = judged.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component"), F.count("*").alias("n"))
    nodes = nodes.join(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "node")
    least = nodes.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("x"))
    kept = nodes.join(least.select(F.col("x.node").alias("node")), "node").select("node", ((F.col("n") > 1) & (F.col("n_shingles") > 0)).alias("several"))
    found = rows.select("row", "node").join(kept, "node")
    one = found.filter("several").groupBy("node").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return found.filter("not several").select("row").unionByName(one.select("row")).select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a window of a benchmark item.

    Defined cases: null and empty texts have no words and stay; a very long text is searched whole; repeated rows
    stay or go together, whatever their ids, null included; no documents give none; an empty benchmark drops
    nothing; columns of any other name pass.
    """
    found = find_contamination(docs, read(spark, sf_dir, "benchmark"), carry=True)
    return found.filter("n_hit = 0").select("row.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each pass of the mix over a document: the whole text, or of a pass over some of its blocks
    their words, joined by one space.  A document that the mix takes nothing of is dropped.

    Defined cases: null and empty texts have no words to take and go; null is a source of its own; repeated rows
    and ids are separate documents, null ids too, and each keeps its own columns; a very long text is many blocks;
    no documents give none; columns of any other name pass, and ``n_chars`` follows the text.
    """
    mix = mix_sources(docs, carry=True)
    parts = mix.taken.groupBy("tie", "pass").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("parts"))
    both = mix.rows.join(parts.join(mix.documents.select("tie", "size"), "tie"), "tie")
    words = F.regexp_extract_all("row.text", F.lit(WORD), 0)
    some = F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(words, p["begin"].cast("int") + 1, (p["end"] - p["begin"]).cast("int")))), " ")
    length = F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["end"] - p["begin"])
    text = F.when(length == F.col("size"), F.col("row.text")).otherwise(some)
    both = both.select("row", text.alias("text"))
    fields = {"text": F.col("text")} | ({"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return both.select(*(fields.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token files and return the index that they hold.

    Defined cases: a null or empty text has the end id alone; a very long text makes a long block; null ids come
    first; equal ids stand together, ordered by their texts' hashes, and repeated rows are written each time; no
    documents give no block; other columns are not read.
    """
    path = scratch_path(spark, "pipeline-token-files")
    write_token_files(docs, path, tokenizer=vocabulary_path())
    return token_index(read_token_files(spark, path))
