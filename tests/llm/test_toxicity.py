"""The factorization machine: what pairs say, the fold that is held out, and workers without the repository."""

import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest

from lagscope.llm.toxicity import score_toxicity

INSULTS, GROUPS = ("scumbag", "idiot"), ("gnomes", "elves")
PLAIN = [a + b + c for a in ("ba", "ke", "lo", "mi", "nu", "re", "so") for b in ("dta", "fri", "gta", "kri", "lta", "mri") for c in "xyz"]


def planted(n, both):
    """Texts with insults and group words; toxic: with both of them, or (not ``both``) an insult with its own group."""
    rng = random.Random(1)
    rows = []
    for i in range(n):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(20, 80))]
        x, y = rng.random() < 0.5, rng.random() < 0.5
        insult, group = (rng.choice(INSULTS) if x else "", rng.choice(GROUPS) if y else "") if both else (INSULTS[x], GROUPS[y])
        for word in filter(None, (insult, group)):
            words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words), x, y, int(x and y if both else x == y)))
    return rows


def shares(spark, rows, factors):
    """Of held-out rows: the share that is rightly predicted, and by both traits the share of rows predicted 1."""
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, *_, y in rows], "doc_id bigint, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, labels, bits=16, factors=factors).filter("held_out").collect()}
    own = [r for r in rows if r[0] in got]
    by = {(x, y): np.mean([got[r[0]] for r in own if r[2:4] == (x, y)]) for x in (False, True) for y in (False, True)}
    return np.mean([got[r[0]] == r[4] for r in own]), by


def test_insult_and_group_together(spark):
    right, by = shares(spark, planted(4000, both=True), 8)
    assert right > 0.98 and by[True, True] > 0.97
    assert max(by[True, False], by[False, True], by[False, False]) < 0.02


def test_pairs_that_no_linear_model_can_tell(spark):
    rows = planted(2500, both=False)
    assert shares(spark, rows, 8)[0] > 0.95
    assert shares(spark, rows, 0)[0] < 0.65


def test_contradictory_labels_and_repeated_ids(spark):
    """An id labelled both ways counts as toxic; of an id's texts the same one trains in every run."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(PLAIN) for _ in range(30)) + (" scumbag" if i % 4 == 0 else "") for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(i, texts[0]) for i in range(1, 60, 2)], "doc_id bigint, text string")
    plain = [(i, int(i % 4 == 0)) for i in range(600)]
    twice = spark.createDataFrame(plain + [(i, 0) for i in range(0, 600, 8)] + [(i, None) for i in range(20)], "doc_id bigint, toxic int")
    once = spark.createDataFrame(plain, "doc_id bigint, toxic int")
    of = lambda labels, n: sorted((r["doc_id"], r["score"]) for r in score_toxicity(docs.repartition(n), labels, bits=14).collect())
    assert of(twice, 2) == of(once, 5)


def test_no_text_at_all_and_one_label(spark):
    docs = spark.createDataFrame([(i, None if i % 2 else "") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    assert len({r["score"] for r in score_toxicity(docs, labels, bits=10).collect()}) == 1
    ones = labels.filter("toxic = 1")
    assert {r["score"] for r in score_toxicity(docs, ones, bits=10).collect()} == {1.0}


def test_held_out_rows_are_never_learned_from(spark):
    rows = planted(400, both=True)
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id bigint, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    scores = []
    for turn in (0, 1):
        labels = spark.createDataFrame([(i, 1 - y if turn and held(i) else y) for i, *_, y in rows], "doc_id bigint, toxic int")
        scores.append({r["doc_id"]: (r["held_out"], r["score"]) for r in score_toxicity(docs, labels, bits=12).collect()})
    assert scores[0] == scores[1] and all(h == held(i) for i, (h, _) in scores[0].items())


@pytest.mark.skipif(os.name != "posix", reason="starts a driver of its own")
def test_workers_need_no_copy_of_the_repository(tmp_path):
    """The driver alone has the repository on its path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from lagscope.llm.decontamination import find_contamination
from lagscope.llm.near_dedup import near_duplicates
from lagscope.llm.quality import resample_quality
from lagscope.llm.substring_dedup import remove_repeated_substrings
from lagscope.llm.toxicity import score_toxicity
docs = spark.createDataFrame([(i, "some words " * (i % 5) + ("scumbag" if i % 3 else "")) for i in range(60)], "doc_id bigint, text string")
labels = docs.selectExpr("doc_id", "cast(doc_id % 3 > 0 as int) toxic", "cast(doc_id % 2 as int) quality")
bench = docs.limit(2).selectExpr("doc_id item_id", "text")
for out in (score_toxicity(docs, labels, bits=10), resample_quality(docs, labels), near_duplicates(docs), find_contamination(docs, bench), remove_repeated_substrings(docs)):
    assert out.count() == 60
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
