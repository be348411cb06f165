"""Nearest vectors, manifest and periodic runs against brute force: edge cases, ties, repeated rows, odd shapes."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagscope.llm import queries as q
from lagscope.llm.common import Rolling
from lagscope.llm.manifest import levels_of, merkle_manifest
from lagscope.llm.multi_index import MultiIndex, nearest_vectors
from lagscope.llm.periodic_runs import find_runs, periodic_runs

CLASH = ["id", "rid", "cls", "own", "cell", "region", "query", "rank", "score", "at", "grp", "place", "bucket", "n", "tie", "leaf", "runs", "n_words"]


# nearest neighbours


def brute(rows, every, nearest=5):
    """query id -> list of (score, id), nearest first, for rows of (id, vector)."""
    good = []
    for i, (key, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append((i, key, np.array(v, float)))
    out = Counter()
    for i, key, v in good:
        if key is not None and key % every == 0:
            near = [(-float(v @ w / np.sqrt((v @ v) * (w @ w))), k is None, k or 0, j) for j, k, w in good if j != i and len(w) == len(v)]
            near = [(s, none, k, j) for s, none, k, j in sorted((round(s, 9), none, k, j) for s, none, k, j in near)]
            out[key, tuple((None if none else k, -s) for s, none, k, _ in near[:nearest])] += 1
    return out


def answers(df):
    """The same from an answer; rows of one query id are told apart by their order of ranks."""
    by = defaultdict(list)
    for r in df.collect():
        by[r["query_id"]].append((r["rank"], r["vec_id"], round(r["score"], 9)))
    return by


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(60)]
    same = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    rows += [(100 + i, same) for i in range(30)] + [(200 + i, [2 * x for x in same]) for i in range(3)]  # ties, one a scaled copy
    rows += [(300, None), (310, []), (320, [0.0] * 6), (330, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (340, [float("nan")] * 6), (350, [float("inf")] + [1.0] * 5)]
    rows += [(None, same), (None, [float(x) for x in rng.standard_normal(6)])]
    rows += [(400, [1.0, 0.0]), (401, [1.0, 1.0]), (410, [3.0]), (420, [2.0**660, 2.0**660, 0.0, 0.0, 0.0, 0.0]), (421, [2.0**-660, 2.0**-660, 0.0, 0.0, 0.0, 0.0])]
    return rows


def test_nearest_by_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("clash") for c in CLASH})
    got = answers(nearest_vectors(df, F.col("vec_id") % 10 == 0))
    scaled = [(k, [x * 2.0**-660 for x in v] if k == 420 else [x * 2.0**660 for x in v] if k == 421 else v) for k, v in vectors]
    want = {key: [(i + 1, k, s) for i, (k, s) in enumerate(near)] for key, near in brute(scaled, 10)}
    assert {k: sorted(v) for k, v in got.items()} == {k: [(r, i, round(s, 9)) for r, i, s in v] for k, v in want.items() if v}


def test_repeated_ids_are_separate_rows(spark):
    df = spark.createDataFrame([(10, [1.0, 0.0]), (10, [1.0, 0.0]), (11, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = answers(nearest_vectors(df, F.col("vec_id") % 10 == 0))
    assert sorted(got[10]) == [(1, 10, 1.0), (1, 10, 1.0), (2, 11, 0.0), (2, 11, 0.0)]


def test_no_vectors_and_no_queries(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert nearest_vectors(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert nearest_vectors(spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0
    alone = nearest_vectors(spark.createDataFrame([(50, [1.0])], "vec_id bigint, embedding array<float>"), F.col("vec_id") % 50 == 0)
    assert alone.count() == 0 and alone.columns == ["query_id", "rank", "vec_id", "score"]


def test_traversal_is_in_order_of_summed_distances():
    rng = np.random.default_rng(5)
    index = MultiIndex(np.zeros((9, 2)), np.zeros((7, 2)), 4)
    index.count(np.arange(63), rng.integers(0, 4, 63))
    one, two = rng.random(9), rng.random(7)
    order = [int(c) for c in np.argsort((one[:, None] + two).ravel()) if index.counts[c]]
    assert index.traverse(one, two, 10**9) == order
    for cell in order[::5]:
        (least,) = index.needed(one, two, [cell])
        assert cell in index.traverse(one, two, least) and cell not in index.traverse(one, two, least - 1)


def test_recall_of_the_index(spark):
    """Far fewer entries are reranked than there are, and the recall is what the audit aims at; a hot cell, too."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 24))
    x = centres[rng.integers(0, 60, 6000)] + 0.25 * rng.standard_normal((6000, 24))
    x[:2000] = centres[0] + 1e-3 * rng.standard_normal((2000, 24))  # a third lies in one place
    x[2000:2600] = x[2000]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = answers(nearest_vectors(df, F.col("vec_id") % 50 == 0, least_budget=100))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = total = 0
    for i in range(0, 6000, 50):
        s = u @ u[i]
        s[i] = -2
        least = np.sort(s)[-5]
        assert [r for r, _, _ in sorted(got[i])] == [1, 2, 3, 4, 5]
        found += sum(s[j] >= least - 1e-12 for _, j, _ in got[i])
        total += 5
    assert found / total >= 0.95
    same = sorted(got[2500])
    assert [j for _, j, _ in same] == [2000, 2001, 2002, 2003, 2004]


# manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(level):
    out = [level]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def beside(levels, i):
    for level in levels[:-1]:
        a = i // 8 * 8
        yield "".join(level[a:i]), "".join(level[i + 1 : a + 8])
        i //= 8


def manifest(rows, change):
    """Of rows (doc_id, source, lang, n_chars, text): what merkle_manifest gives."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest("".join(field(v) for v in (*r[:4], text)))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), leaf(r, change(r)), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = Counter()
    for at, g in enumerate(names):
        for i, (_, _, own, claimed, key) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*beside(trees[g], i), *beside(top, at)]
            fold = claimed
            for left, right in path:
                fold = digest(left + fold + right)
            out[key, own, trees[g][-1][0], top[-1][0], digest("".join(a + b for a, b in path)), fold, fold == top[-1][0]] += 1
    return out


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(r):
    return r[4].translate(LOWER) if r[4] is not None and r[0] is not None and r[0] % 3 == 0 else r[4]


def test_manifest_by_brute_force(spark):
    rng = random.Random(2)
    # groups of 1, 8, 9, 64, 65 and over 4096 rows, more than eight of them; nulls; equal ids and rows; a very long text
    rows = [(1, None, "one", 5, "É")] + [(i, "s", "eight", i, "A" * i) for i in range(8)] + [(i, "s", "nine", None, "bB") for i in range(9)]
    rows += [(i, "s", "e", 1, None) for i in range(64)] + [(i, None, "", 1, "") for i in range(65)] + [(rng.randrange(10**9), "s", "en", 3, f"T{i}") for i in range(4200)]
    rows += [(None, "s", None, 2, "x"), (None, "s", None, 2, "Y"), (3, "s", None, 2, "Z"), (3, "s", None, 2, "Z"), (3, "t", None, 2, "Z"), (6, "s", None, 10**6, "Word " * 200_000)]
    rows += [(i, "s", f"lang{i}", 1, "x") for i in range(5)] + [(2**62, "s", "É", 1, "x"), (-5, "s", "é", 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit("clash") for c in CLASH})
    changed = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    got = merkle_manifest(df, changed={"text": changed})
    assert Counter(tuple(r) for r in got.collect()) == manifest(rows, lowered)
    plain = merkle_manifest(df.filter("lang = 'eight'"))
    assert plain.filter("NOT verified").count() == 0 and plain.select("root").distinct().count() == 1


def test_manifest_of_single_rows_and_none(spark):
    one = spark.createDataFrame([(4, "s", "en", 1, "x")], SCHEMA)
    (r,) = merkle_manifest(one).collect()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof_sha256"] == digest("") and r["verified"]
    apart = [(i, "s", f"l{i}", 1, "x") for i in range(3)]
    assert Counter(tuple(r) for r in merkle_manifest(spark.createDataFrame(apart, SCHEMA)).collect()) == manifest(apart, lambda r: r[4])
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_levels():
    assert [levels_of(n) for n in (0, 1, 2, 8, 9, 64, 65, 4096, 4097)] == [0, 0, 1, 1, 2, 2, 3, 4, 5]


# periodic runs


def runs_of(ids):
    n, out, seen = len(ids), [], set()
    for period in range(1, n // 4 + 1):
        a = 0
        while a + period < n:
            b = a
            while b + period < n and ids[b] == ids[b + period]:
                b += 1
            if b > a and b - a + period >= max(6, 4 * period) and (a, b + period) not in seen:
                seen.add((a, b + period))
                out.append((a, b - a + period, period))
            a = b + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_by_brute_force():
    rng, rolling = random.Random(4), Rolling()
    for i in range(600):
        ids = [rng.randrange(rng.choice([1, 2, 2, 3, 50])) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):  # planted repeats, next to each other or overlapping, of random extents
            at, part = rng.randrange(len(ids) + 1), [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            ids[at:at] = (part * rng.randrange(1, 9))[: rng.randrange(1, 50)]
        assert find_runs(np.array(ids, np.int64), rolling) == runs_of(ids), (i, ids)


def test_long_texts_of_one_word_or_of_none_alike():
    rolling = Rolling()
    assert find_runs(np.zeros(200_000, np.int64), rolling) == [(0, 200_000, 1)]
    assert find_runs(np.arange(200_000), rolling) == []
    period = np.arange(1000)
    ids = np.concatenate([np.arange(1000, 50_000), np.tile(period, 30), [0, 1, 2], np.arange(50_000, 99_000)])
    assert find_runs(ids, rolling) == [(49_000, 30_003, 1000)]


def texts(rows):
    out = Counter()
    for key, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        known = {}
        found = runs_of([known.setdefault(w, len(known)) for w in words])
        kept = [True] * len(words)
        for start, length, period in found:
            kept[start + period : start + length] = [False] * (length - period)
        out[key, len(words), tuple(found), b" ".join(w for w, k in zip(words, kept, strict=True) if k).decode()] += 1
    return out


TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 3000), (5, "a b c"), (5, "a b c"), (None, "ha ha ha ha ha ha ha ha ha ha"), (6, "Ré\nRé\tRé Ré Ré Ré x"), (7, "a b a b a b a b a a a a a a b"), (8, "x " + "p q r s " * 5 + "p y"), (9, "A a A a A a"), (10, "z z z z z")]


def test_texts_by_brute_force(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in CLASH})
    got = Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in periodic_runs(df).collect())
    assert got == texts(TEXTS)
    assert periodic_runs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_plants_and_digests(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.choice([None, "", " ", "a", " ".join(rng.choice("abcdefg") for _ in range(rng.randrange(80)))])) for i in range(300)] + [(None, "a a a a a a a"), (7, "Y y " * 9)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for key, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        ((_, _, found, kept),) = texts([(key, " ".join(words))])
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join("%d,%d,%d\n" % r for r in found)
        want[key, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest(lines), digest(kept)] += 1
    assert Counter(tuple(r) for r in q.op13_periodic_runs(spark, str(tmp_path)).collect()) == want
