"""The registered queries of this subpackage: thin views of its operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, read, scratch_path, vocabulary_path
from .decontamination import find_contamination
from .embedding_dedup import linked_embeddings
from .manifest import merkle_manifest
from .mixing import mix_sources, taken_words
from .multi_index import nearest_vectors
from .near_dedup import near_duplicates
from .periodic_runs import periodic_runs
from .quality import resample_quality
from .sharding import balanced_shards
from .substring_dedup import remove_repeated_substrings
from .token_files import read_token_files, token_index, write_token_files
from .toxicity import score_toxicity
from .url_filter import judge_urls

#: Rules of the URL filter query: verdict, and host and path.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_substrings(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(read(spark, sf_dir, "documents"), path, tokenizer=vocabulary_path())
    return token_index(read_token_files(spark, path))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), rules=URL_RULES)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "weight", "draw", "kept")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=3, percent=85, rows=5)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_embeddings(read(spark, sf_dir, "embeddings"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = taken_words(mix_sources(read(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = balanced_shards(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    out = merkle_manifest(read(spark, sf_dir, "documents"), changed={"text": tampered})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _planted(docs: DataFrame) -> DataFrame:
    """Every tenth text, by a hash of its id, repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g")).filter("h % 10 = 0 AND text IS NOT NULL").select("doc_id", "g", F.regexp_extract_all("text", F.lit(WORD), 0).alias("w"))
    words = words.filter("size(w) > 0").withColumns({"n": F.size("w"), "a": F.expr("int(g % size(w))")}).withColumn("p", F.expr("int(1 + (n - a) div (3 + g % 8))"))
    repeated = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.expr("int((n - a + p - 1) div p)")))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(repeated, F.lit(1), F.col("n") - F.col("a"))), " ")
    whole = docs.select("doc_id", "text", h.alias("h")).filter(f"h % 10 <> 0 OR h IS NULL OR text IS NULL OR NOT rlike(text, r'{WORD}')")
    return whole.select("doc_id", "text").unionByName(words.select("doc_id", text.alias("text")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic_runs(_planted(read(spark, sf_dir, "documents")))
    x = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return out.withColumn("x", x).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("x.start")).alias("start"), F.col("x.length").alias("length"), (-F.col("x.period")).alias("period"),
        F.expr("1000 * x.length div -x.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_token_files, op4_url_filter, op5_quality, op6_near_dedup, op7_embedding_dedup, op8_mixing, op9_decontamination, op10_sharding, op11_nearest_vectors, op12_manifest, op13_periodic_runs)}
