"""The stages on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lagscope.llm import stages
from lagscope.llm.common import vocabulary_path
from lagscope.llm.mixing import mix_sources, shard_counts, taken_words
from lagscope.llm.token_files import Encoder

RNG = random.Random(21)
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "re", "so") for b in ("d", "f", "g", "k", "l", "m", "n", "p")]
#: Names that the stages or their operators use inside.
CLASH = ["id", "parts", "size", "text_hash", "row", "node", "tie", "pass", "n", "weight", "component", "items", "several"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


ONE, TWO, LEAK = prose(80), prose(80), prose(30)
ROWS = [
    (1, ONE, "a"), (2, ONE + " tail", "b"), (2, TWO, "b"), (3, None, "a"), (3, None, "a"), (4, "", None), (None, prose(50), "b"), (None, TWO + " end", "c"), (5, prose(60), "a"), (5, prose(60), "a"),
    (6, "same words here again and again", "c"), (6, "same words here again and again", "a"), (7, prose(40) + " " + LEAK, "a"), (8, "word " * 5000, "b"), (9, " \n", "c"),
]
SCHEMA = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    rows = [(*r, f"row {i}") for i, r in enumerate(ROWS)]
    spark.createDataFrame(rows, f"{SCHEMA}, lang string").withColumn("n_chars", F.char_length("text").cast("bigint")).withColumns({c: F.concat(F.lit(f"{c} "), "lang") for c in CLASH}).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(1, 10)] + [(None, 1, 0), (4, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, None), (None, "")], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("stage", [stages.quality, stages.near_dedup, stages.decontamination, stages.mixing])
def test_columns_pass_and_empty_tables(spark, docs, tables, stage):
    out = stage(spark, docs, tables)
    assert out.schema.simpleString() == docs.schema.simpleString()
    for r in out.collect():  # every row is some row of the input in all that no stage writes
        i = int(r["lang"].split()[1])
        assert (r["doc_id"], r["source"]) == (ROWS[i][0], ROWS[i][2]) and all(r[c] == f"{c} row {i}" for c in CLASH)
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert stage(spark, docs.limit(0), tables).count() == 0


def left(out):
    return sorted(int(r["lang"].split()[1]) for r in out.select("lang").collect())


def test_quality_keeps_texts_with_words(spark, docs, tables):
    kept = left(stages.quality(spark, docs, tables))
    assert not {3, 4, 5, 14} & set(kept)
    assert (10 in kept) == (11 in kept)


def test_near_dedup_judges_rows(spark, docs, tables):
    """Of rows 0 and 1 the first stays, and of 2 and 7; a text of its own under a repeated id stays; of 10 and 11,
    with the same id and text, one; texts without words all stay."""
    kept = left(stages.near_dedup(spark, docs, tables))
    assert kept == left(stages.near_dedup(spark, docs.repartition(5), tables))
    assert Counter(x for x in kept if x not in (10, 11)) == Counter([0, 2, 3, 4, 5, 6, 8, 9, 12, 13, 14])
    assert len({10, 11} & set(kept)) == 1


def test_decontamination_drops_only_the_leak(spark, docs, tables):
    assert left(stages.decontamination(spark, docs, tables)) == [i for i in range(len(ROWS)) if i != 12]


def test_mixing_keeps_each_rows_own_columns(spark, docs, tables):
    out = stages.mixing(spark, docs, tables).collect()
    words = defaultdict(int)
    for r in out:
        i = int(r["lang"].split()[1])
        own, new = (ROWS[i][1] or "").split(), r["text"].split()
        assert new == own or all(w in own for w in new)
        words[r["source"]] += len(new)
    targets = {r["rank"]: r["target"] for r in mix_sources(docs).documents.select("rank", "target").distinct().collect()}
    assert sum(words.values()) == sum(round(t) for t in targets.values())
    assert sorted(words.values()) == sorted(round(t) for t in targets.values() if round(t))


def test_token_files(spark, docs, tables):
    got = stages.token_files(spark, docs, tables).collect()
    encoder = Encoder(vocabulary_path()).tokenizer
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((d, len(encoder.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, _ in ROWS)
    assert stages.token_files(spark, docs.limit(0), tables).count() == 0


def test_small_sources_meet_their_targets(spark):
    """Blocks are longer than what a source gives: its last slot takes a part of one."""
    rows = [(s * 100 + i, prose(n), f"s{s}") for s, sizes in enumerate([[40], [150, 250], [30] * 3, [1] * 7]) for i, n in enumerate(sizes)]
    out = taken_words(mix_sources(spark.createDataFrame(rows, SCHEMA))).collect()
    by = defaultdict(int)
    for r in out:
        assert r["taken"] <= 3 * r["size"]
        by[r["source_size"], r["target"]] += r["taken"]
    assert len(by) == 4 and all(abs(taken - target) <= 0.5 for (_, target), taken in by.items())


def test_shard_counts_are_drawn_and_settled(spark):
    n = {0: 7000, 1: 2900, 2: 99, 3: 1}
    sources = spark.createDataFrame([(r, x) for r, x in n.items()], "rank int, n bigint")
    rows = [tuple(r) for r in shard_counts(sources, 10_000, 512, 7).select("shard", "rank", "n").collect()]
    assert rows and sorted(rows) == sorted(tuple(r) for r in shard_counts(sources.repartition(3), 10_000, 512, 7).select("shard", "rank", "n").collect())
    sizes, totals = Counter(), Counter()
    for shard, rank, x in rows:
        sizes[shard] += x
        totals[rank] += x
    assert totals == n and [sizes[k] for k in sorted(sizes)] == [512] * 19 + [272]
    of_first = [x for shard, rank, x in rows if rank == 0 and shard < 19]
    spread = (sum((x - 358.4) ** 2 for x in of_first) / len(of_first)) ** 0.5
    assert 5 < spread < 20  # a multinomial's is 10.4; equal shares would have none
