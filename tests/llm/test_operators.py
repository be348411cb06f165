"""The corpus operators against brute force, on a small table of edge cases and on planted groups."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lagscope.llm import queries as q
from lagscope.llm.common import vocabulary_path
from lagscope.llm.decontamination import find_contamination
from lagscope.llm.embedding_dedup import linked_embeddings
from lagscope.llm.mixing import mix_sources, source_targets, taken_words
from lagscope.llm.near_dedup import MinMax, band_count, near_duplicates
from lagscope.llm.quality import keep_quality, kth_largest, level_between, resample_quality
from lagscope.llm.sharding import balanced_shards
from lagscope.llm.substring_dedup import SLOTS, _pack, heavy_slots, remove_repeated_substrings, repeated_windows
from lagscope.llm.token_files import PER_WORD, Encoder, decode_ids, encode_ids, read_token_files, token_index, write_token_files
from lagscope.llm.toxicity import score_toxicity
from lagscope.llm.url_filter import judge_urls

RNG = random.Random(7)
WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "Ré", "so") for b in ("d", "f", "g", "k", "l", "m", "n", "p")]


def prose(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = prose(120)
PASSAGE = prose(60)
#: id, text, source: nulls, empties, a very long text, ties, repeated rows, copies, near copies, a shared passage.
EDGES = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "word " * 3000, "a"), (5, LONG, "a"), (5, LONG, "a"), (6, LONG, "b"), (7, LONG + " tail", "b"),
    (8, LONG.replace(" ", "\n"), "b"), (None, "one two", "a"), (9, prose(30) + " " + PASSAGE + " " + prose(10), None), (10, PASSAGE.upper(), "c"), (11, PASSAGE + " " + prose(25), "c"), (12, "x", "a"), (13, prose(200), "a"), (14, "one TWO", "b"),
]
SCHEMA = "doc_id bigint, text string, source string"
#: Names that operators use inside.
CLASH = ["id", "doc", "row", "text_hash", "key", "rep", "tie", "rank", "size", "shard", "slot", "weight", "n", "part", "items"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(EDGES, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def test_substrings_by_brute_force(docs, empty):
    window = 35
    where = defaultdict(list)
    rows = [ascii_words(t) for _, t, _ in EDGES]
    for i, w in enumerate(rows):
        for a in range(len(w) - window + 1):
            where[tuple(w[a : a + window])].append((i, a))
    gone = [set() for _ in rows]
    for places in where.values():
        if len(places) > 1:
            for i, a in places:
                gone[i].update(range(a, a + window))
    want = Counter((d, len(w), len(g), b" ".join(x for j, x in enumerate(w) if j not in g).decode()) for (d, _, _), w, g in zip(EDGES, rows, gone, strict=True))
    got = remove_repeated_substrings(docs, buckets=3)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()) == want
    assert remove_repeated_substrings(empty).count() == 0


def test_copies_and_common_lines_fill_no_bucket(spark):
    """Exact copies, and a short line in every document: no bucket gets more than twice the mean of strings or facts."""
    rng = random.Random(8)
    line, copy = " ".join(rng.choice(WORDS) + str(i) for i in range(20)), " ".join(rng.choice(WORDS) + str(i) for i in range(200))
    rows = [(i, copy) for i in range(2000)] + [(2000 + i, " ".join([*(f"{rng.random():.9f}" for _ in range(40)), line, *(f"{rng.random():.9f}" for _ in range(40))])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc bigint, text string").withColumn("text_hash", F.xxhash64("text"))
    buckets = 16
    loads = {}
    for name, heavy in (("plain", np.zeros(SLOTS // 8, np.uint8)), ("counted", heavy_slots(docs, 35, 5, 50_000))):
        load, facts = np.zeros(buckets), np.zeros(buckets)
        shared = spark.sparkContext.broadcast(heavy)
        for r in docs.coalesce(1).mapInArrow(_pack(35, 5, buckets, shared), "bucket int, strings binary, facts binary").collect():
            size = len(zstandard.ZstdDecompressor().decompress(r["strings"])) if r["strings"] else 0
            load[r["bucket"]] += size
            facts[r["bucket"]] += len(zstandard.ZstdDecompressor().decompress(r["facts"]))
        loads[name] = load.max() / load.mean(), facts.max() / facts.mean()
    assert loads["plain"][0] > 2 and max(loads["counted"]) < 2
    got = {r["doc"]: r["n_removed"] for r in remove_repeated_substrings(docs, id_col="doc").select("doc", "n_removed").collect()}
    assert all(got[i] == (200 if i < 2000 else 0) for i in got)


def test_colliding_hashes_fall_back_to_words():
    strings = [b"a b c d", b"a b c x", b"q a b c"]
    flags = repeated_windows(strings, np.array([1, 1, 1]), 3)
    assert [f.tolist() for f in flags] == [[True, False], [True, False], [False, True]]
    assert repeated_windows([b"a b c"], np.array([2]), 3)[0].tolist() == [True]


def shingles(text, n):
    w = [x.lower() for x in ascii_words(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n, percent):
    parent = {d: d for d, _ in rows if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingles(t, n)) for d, t in rows if d is not None]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, r = sorted((root(a), root(b)))
                parent[r] = p
    return {d: root(d) for d in parent}


@pytest.mark.parametrize(("n", "percent", "rows"), [(3, 85, 5), (5, 80, 4)])
def test_near_duplicates_by_brute_force(spark, docs, empty, n, percent, rows):
    want = brute_components([(d, t) for d, t, _ in EDGES], n, percent)
    for r in near_duplicates(docs, shingle=n, percent=percent, rows=rows).collect():
        text = [t for d, t, _ in EDGES if d == r["doc_id"]]
        assert r["n_shingles"] in {len(shingles(t, n)) for t in text}
        assert (r["component_id"], r["kept"]) == ((None, True) if r["doc_id"] is None else (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"]))
    assert near_duplicates(empty).count() == 0


def test_near_duplicates_of_one_id_with_several_texts(spark):
    """An id's rows are one node, linked by any of its texts; a full bitmap changes nothing."""
    rng = random.Random(9)
    a, b, c = (prose(60, rng) for _ in range(3))
    rows = [(1, a), (1, b), (1, b), (2, a + " tail"), (3, b + " tail"), (4, c), (5, c + " tail"), (6, prose(60, rng))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    for bits in (1, 1 << 27):
        assert {r["doc_id"]: r["component_id"] for r in near_duplicates(table, most_bits=bits).collect()} == want


def test_near_duplicates_of_groups_not_quite_alike(spark):
    """Copies of one text with more and more words changed: some link to it, some to one another, some to none."""
    rng = random.Random(3)
    base = prose(100, rng).split()
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            words[rng.randrange(100)] = rng.choice(WORDS) + str(rng.randrange(50))
        rows.append((i, " ".join(words)))
    for i in range(120, 150):  # changed copies of changed copies
        words = rows[i - 60][1].split()
        words[rng.randrange(100)] = "other"
        rows.append((i, " ".join(words)))
    want = brute_components(rows, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=3, percent=85, rows=5).collect()}
    assert got == want and 2 < len(set(want.values())) < 150


@pytest.mark.parametrize("similarity, rows", [(0.85, 5), (0.8, 4)])
def test_bands_meet_as_often_as_independent_ones(similarity, rows):
    """Pairs of sets just at the threshold: none without a common band, and as many bands in common as if the least and
    the greatest of a hash told different things."""
    rng = np.random.default_rng(1)
    bands = band_count(similarity, rows)
    hasher = MinMax(bands, rows)
    common = 340
    own = int(common * (1 - similarity) / (2 * similarity) + 1e-9)
    exact = common / (common + 2 * own)
    sets = []
    for _ in range(1500):
        x = rng.integers(0, 1 << 63, common + 2 * own, dtype=np.uint64) * np.uint64(2)
        sets += [x[: common + own], np.concatenate([x[:common], x[common + own :]])]
    keys = hasher.keys(sets)
    met = (keys[::2] == keys[1::2]).sum(1)
    chance = exact**rows
    assert met.min() > 0
    assert met.mean() == pytest.approx(bands * chance, rel=0.03)
    assert met.std() == pytest.approx((bands * chance * (1 - chance)) ** 0.5, rel=0.08)


def contaminated(text, items):
    pattern = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = [pattern.findall((t or "").encode().lower()) for t in (text, *(t for _, t in items))]
    hit, found = set(), set()
    for (name, _), own in zip(items, words[1:], strict=True):
        n = min(10, len(own))
        grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words[0]) - n + 1):
            if tuple(words[0][i : i + n]) in grams:
                hit.update(range(i, i + n))
                found |= {name} - {None}
    return len(words[0]), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("limit", [1 << 20, 0])
@pytest.mark.parametrize("carry", [False, True])
def test_contamination_by_brute_force(spark, docs, empty, limit, carry):
    items = [(1, LONG), (2, " ".join(PASSAGE.split()[20:40])), (3, "one, two"), (4, None), (5, ""), (6, "word"), (7, PASSAGE.split()[5] + " zzz"), (8, "one Two"), (None, "x")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("name", F.lit("clash"))
    want = Counter((d, *contaminated(t, items)[:2], tuple(contaminated(t, items)[2])) for d, t, _ in EDGES)
    got = find_contamination(docs, bench, most_broadcast=limit, carry=carry).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == want
    if carry:
        assert Counter(r["row"]["text"] for r in got) == Counter(t for _, t, _ in EDGES)
    assert find_contamination(empty, bench, most_broadcast=limit).count() == 0
    assert find_contamination(docs, bench.limit(0), most_broadcast=limit).filter("n_hit > 0").count() == 0


def test_shards(docs, empty):
    rows = balanced_shards(docs, shards=4).collect()
    size = lambda t: len((t or "").encode()) + 8
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, _ in EDGES)
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]))
    assert [r["shard"] for r in order] == sorted(r["shard"] for r in rows)
    total, before = sum(r["size"] for r in rows), 0
    slots = defaultdict(list)
    for r in order:
        assert r["shard"] == min(3, (2 * before + r["size"]) * 4 // (2 * total))
        before += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert balanced_shards(empty).count() == 0


def brute_targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_brute_force(spark, seed):
    rng = random.Random(seed)
    sizes = {(None if i == 0 else f"s{i}"): rng.choice([0, 1, 5, 100, 10_000]) for i in range(rng.randint(1, 9))} | {"s5": 50}
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix(spark, docs, empty):
    mix = mix_sources(docs, block=16, shard_slots=32)
    rows = taken_words(mix).collect()
    assert Counter((r["id"], r["size"]) for r in rows) == Counter((d, len(ascii_words(t))) for d, t, _ in EDGES)
    sizes = Counter()
    for _, t, s in EDGES:
        sizes[s] += len(ascii_words(t))
    by = defaultdict(lambda: [0, 0])
    for r in rows:
        assert r["taken"] <= 3 * r["size"]
        by[r["target"], r["source_size"]][0] += r["taken"]
    want = {(brute_targets(sizes)[s], n) for s, n in sizes.items()}
    assert {(round(t, 6), n) for t, n in by} == {(round(t, 6), n) for t, n in want}
    assert all(abs(taken - t) <= 0.5 for (t, _), (taken, _) in by.items())
    slots = mix.slots.collect()
    places = sorted((r["shard"], r["slot"]) for r in slots)
    assert places == [(i // 32, i % 32) for i in range(len(slots))]  # a permutation fills every place once
    again = taken_words(mix_sources(docs.repartition(3), block=16, shard_slots=32)).collect()
    assert Counter((r["id"], r["size"], r["taken"]) for r in again) == Counter((r["id"], r["size"], r["taken"]) for r in rows)
    assert taken_words(mix_sources(empty)).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 59, 60, 61, 5000):
        for top in (1, 2, 17, 300, 5000, 32767, 32768, 49408, 2**32):
            ids = rng.integers(0, top, n).astype(np.uint32)
            assert (decode_ids(*encode_ids(ids)) == ids).all()
    words, _ = encode_ids(np.zeros(600, np.uint32))
    assert len(words) == 80  # 60 to a word


def test_encoder_equals_the_library():
    encoder = Encoder(vocabulary_path())
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "É", "×", "ÿ", "'s", "'T", "'", "<|endoftext|>", "<|EndOfText|>", "<", "|", ".", "-", "—", "“", "é", "́", "ΑΣ", "1", "٣", "漢", " ", "\n", " ", " ", "İ", "K", "ﬁ", "🙂", "don't", "\x1c", "\x85"]
    for _ in range(300):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3)]
        ids, lengths = encoder.encode([t.encode() for t in texts], 1)
        want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
        assert ids.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want))


def test_encoder_takes_the_short_way_for_letters():
    """Pieces of letters pass no step of the vocabulary but its merges, and give the same ids."""

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.texts = tokenizer, []

        def encode_batch_fast(self, texts, **settings):
            self.texts += texts
            return self.tokenizer.encode_batch_fast(texts, **settings)

    encoder = Encoder(vocabulary_path())
    library, encoder.tokenizer = encoder.tokenizer, Counted(encoder.tokenizer)
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(c for c in map(chr, range(0xC0, 0x100)) if c.isalpha())
    for text in (" ".join("".join(rng.choices(letters, k=rng.randint(1, 25))) for _ in range(3000)), "Été <| " + letters, " ".join(letters)):
        ids, lengths = encoder.encode([text.encode()], 1)
        assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 1] and lengths.tolist() == [len(ids)]
    assert set(encoder.tokenizer.texts) == {"<|"}


def test_encoder_forgets_no_sooner_than_it_must(monkeypatch):
    """Texts of pieces that it remembers teach it nothing; one with too many new pieces makes it start anew."""
    monkeypatch.setattr(Encoder, "REMEMBERED", 10)
    encoder = Encoder(vocabulary_path())
    learnt = []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda pieces: (learnt.append(len(pieces)), learn(pieces)))
    for text in (b"a b c d e f", b"f e d c b a", b"g h i j k l"):
        ids, _ = encoder.encode([text], 1)
        assert ids.tolist() == [*encoder.tokenizer.encode(text.decode(), add_special_tokens=False).ids, 1]
    assert learnt == [6, 0, 6]


def test_packed_words_take_as_many_ids_as_fit():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 59, 60, 61, 200):
        for widest in (1, 2, 4, 7, 15, 16):
            ids = (rng.integers(0, 1 << 16, n) >> rng.integers(16 - widest, 17, n)).astype(np.uint32)
            words, escapes = encode_ids(ids)
            small, want, i = np.minimum(ids, (1 << 15) - 1), [], 0
            while i < n:
                per, s = next((per, s) for s, per in enumerate(PER_WORD) if per <= n - i and small[i : i + per].max() < 1 << 60 // per)
                want.append((s << 60) | sum(int(x) << j * (60 // per) for j, x in enumerate(small[i : i + per])))
                i += per
            assert np.frombuffer(words, "<u8").tolist() == want and (decode_ids(words, escapes) == ids).all()


def test_encoder_of_another_vocabulary():
    """A vocabulary that doesn't split at pieces is asked for each whole text."""
    import public_tokenizers

    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Two  Words", "", " a\tB ", "don't <|endoftext|> é"]
    ids, lengths = encoder.encode([t.encode() for t in texts], 1)
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert not encoder.by_pieces and Encoder(vocabulary_path()).by_pieces
    assert ids.tolist() == sum(want, []) and lengths.tolist() == list(map(len, want))


def test_token_files(spark, docs, empty, tmp_path):
    write_token_files(docs, str(tmp_path / "t"), tokenizer=vocabulary_path())
    got = sorted(token_index(read_token_files(spark, str(tmp_path / "t"))).collect(), key=lambda r: r["start"])
    encoder = Encoder(vocabulary_path()).tokenizer
    ids = lambda t: [*encoder.encode(t or "", add_special_tokens=False).ids, 1]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((d, len(ids(t)), crc(ids(t))) for d, t, _ in EDGES)
    assert [r["doc_id"] for r in got] == sorted((d for d, _, _ in EDGES), key=lambda d: (d is not None, d))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    write_token_files(empty, str(tmp_path / "e"), tokenizer=vocabulary_path())
    assert token_index(read_token_files(spark, str(tmp_path / "e"))).count() == 0


def test_embeddings_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(200)]
    for size, noise in ((300, 0.02), (40, 0.25), (40, 0.35)):  # one tight cluster, and some about the threshold
        centre = rng.standard_normal(16)
        rows += [(len(rows) + i, (centre + noise * rng.standard_normal(16)).tolist()) for i in range(size)]
    rows += [(len(rows) + i, rows[0][1]) for i in range(30)]  # exact copies
    rows += [(len(rows), [3 * x for x in rows[1][1]])]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [1.0, None] * 8), (n + 4, [float("nan")] * 16), (n + 5, [float("inf")] * 16), (n + 6, [1.0] * 8), (n + 7, [1.0] * 8)]
    m = np.array([r[1] for r in rows[:n]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= 0.9) & ~np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(near, label, n).min(1))
        if (new == label).all():
            break
        label = new
    got = {r["vec_id"]: r for r in linked_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rid", F.lit(0)), sample=64).collect()}
    assert len(got) == len(rows)
    links = np.array([got[i]["n_links"] for i in range(n)])
    assert (links == near.sum(1)).all()
    assert [got[i]["component_id"] for i in range(n)] == label.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(n, n + 6))
    assert got[n + 6]["n_links"] == got[n + 7]["n_links"] == 1 and got[n + 7]["component_id"] == n + 6
    empty = linked_embeddings(spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert empty.count() == 0


def pairs_apart(n, singles, cosine=0.92, d=32, seed=3):
    """``n`` pairs of about this cosine, which link with nothing else, and single vectors."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n + singles, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((n, d))
    y -= (y * x[:n]).sum(1, keepdims=True) * x[:n]
    y = cosine * x[:n] + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    return [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]


def test_embeddings_of_rare_links(spark):
    """A sample that meets no link is no evidence that none is missing."""
    rows = pairs_apart(12, 1500)
    got = linked_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), orders=1, neighbours=1, sample=8, most_audits=1).collect()
    assert {r["vec_id"] for r in got if r["n_links"] == 1} == {*range(12), *range(1512, 1524)}
    assert all(r["component_id"] == r["vec_id"] - 1512 for r in got if r["vec_id"] >= 1512)


def test_descent_alone_finds_links(spark, caplog):
    """Thousands of links of their own, and a dense region: the lists hold 98 in 100 of them before any brute force of
    all, and the result is whole."""
    rng = np.random.default_rng(4)
    rows = pairs_apart(1500, 1000, cosine=0.93)
    centre = rng.standard_normal(32)
    spread = rng.standard_normal((300, 32))
    rows += [(len(rows) + i, (centre / np.linalg.norm(centre) + 0.32 * v / np.linalg.norm(v)).tolist()) for i, v in enumerate(spread)]
    caplog.set_level("INFO", logger="lagscope.llm.embedding_dedup")
    got = {r["vec_id"]: r["n_links"] for r in linked_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    said = [r.getMessage() for r in caplog.records]
    assert not any("not compared yet" in m for m in said)
    (audit,) = [m for m in said if m.startswith("audit")]
    planted, probes = map(int, re.search(r"(\d+) of (\d+) probes", audit).groups())
    assert probes > 500 and planted >= 0.98 * probes
    m = np.array([r[1] for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= 0.9).sum(1) - 1
    found = np.array([got[i] for i in range(len(rows))])
    assert (found <= near).all() and found.sum() >= 0.98 * near.sum() and found[:4000].sum() >= 0.98 * near[:4000].sum() > 2000


def test_embeddings_without_links_take_no_brute_force_of_all(spark, caplog):
    caplog.set_level("INFO", logger="lagscope.llm.embedding_dedup")
    x = np.random.default_rng(8).standard_normal((3000, 48))
    got = linked_embeddings(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")).collect()
    assert len(got) == 3000 and all(r["n_links"] == 0 and r["kept"] for r in got)
    assert not any("not compared yet" in r.getMessage() for r in caplog.records)


@pytest.mark.parametrize("most_audits", [1, 3])
def test_embeddings_where_audits_fail(spark, most_audits):
    """Links that the search misses are found by brute force when audits end below the target."""
    rows = pairs_apart(300, 900)
    got = linked_embeddings(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), orders=1, neighbours=1, sample=64, audit_links=20, target_recall=1.01, most_audits=most_audits).collect()
    assert {r["vec_id"] for r in got if r["n_links"] == 1} == {*range(300), *range(1200, 1500)}


URLS = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://Www.Example.ORG/es/1?q=/a"), (5, "http://example.org/en/12.html"), (6, "http://example.org/en/22"), (7, "https://a.com/fr/1#x"), (8, "https://a.com/de/"),
    (9, "https://notorg/x"), (10, "https://b.net"), (11, "https://b.net?x"), (12, "://"), (13, "http://example.org/es/1"), (13, "http://example.org/es/1"), (None, "http://c.net/" + "deep/" * 30 + "9"), (15, "http://ab.com/x/http://d.org/"),
]


def test_url_rules_by_brute_force(spark):
    pages = spark.createDataFrame(URLS, "page_id bigint, url string").withColumns({"host": F.lit("clash"), "template": F.lit(0)})
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    rules = [(v, *r.split("/", 1)) for v, r in q.URL_RULES]
    want = Counter()
    for d, u in URLS:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
            host = host.lower()
        fits = [(len(h) + len(p), f"{h}/{p}", v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, default=(0, None, "allow"))
        want[d, host, path, best[1], best[2]] += 1
    got = judge_urls(pages, labels, rules=q.URL_RULES).collect()
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got) == want
    assert judge_urls(pages.limit(0), labels.limit(0)).count() == 0


def test_url_templates(spark):
    """A bad section of a host is rejected, a good one is not, and numbers become wildcards."""
    pages = [(i, f"http://h.net/{'spam' if i % 2 else 'news'}/{i}.html") for i in range(80)] + [(100 + i, f"http://k.net/p/{i}") for i in range(10)]
    labels = [(i, int(i % 2 == 0), 0) for i in range(60)]
    got = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert got[61]["verdict"] == "block" and got[62]["verdict"] == "allow"
    assert got[61]["template"] == "/spam/*" or got[61]["template"] == "/spam/*.html"


def test_url_templates_of_wide_and_deep_hosts(spark):
    """One bad section among 25 of equal size, and one below eight segments, are told apart."""
    deep = "a/b/c/d/e/f/g/"
    pages = [(i, f"http://wide.net/s{i % 25}/{i}") for i in range(1000)] + [(1000 + i, f"http://deep.net/{deep}{'bad' if i % 10 == 0 else 'good'}/{1000 + i}") for i in range(300)]
    pages.append((5000, "http://deep.net/" + "x/" * 400 + "5000"))
    labels = [(i, int(i % 25 != 7), 0) for i in range(0, 1000) if i % 3] + [(1000 + i, int(i % 10 != 0), 0) for i in range(250)]
    got = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert len(got) == 1301
    assert {i for i in range(1000) if got[i]["verdict"] == "block"} == {i for i in range(1000) if i % 25 == 7}
    assert {i for i in range(300) if got[1000 + i]["verdict"] == "block"} == {i for i in range(300) if i % 10 == 0}


def brute_templates(paths, least=3):
    """(host, path) -> template, level by level, of {(host, path): rows}."""
    wild = lambda x: "*" + (re.search(r"\.[A-Za-z][A-Za-z0-9]{0,4}$", x) or [""])[0]
    out = {}

    def build(rows, template):
        out.update((key, template) for key, left in rows if not left)
        rows = [r for r in rows if r[1]]
        if sum(paths[k] for k, _ in rows) < least:
            out.update((key, template + tuple(map(wild, left))) for key, left in rows)
            return
        counts, groups = Counter(), defaultdict(list)
        for key, left in rows:
            counts[left[0]] += paths[key]
        for key, left in rows:
            groups[left[0] if counts[left[0]] >= least else wild(left[0])].append((key, left[1:]))
        for name, own in groups.items():
            build(own, (*template, name))

    hosts = defaultdict(list)
    for host, path in paths:
        hosts[host].append(((host, path), [x for x in path.split("/") if x]))
    for own in hosts.values():
        build(own, ())
    return out


def brute_purities(pages, labels, strength=5.0, z=1.96):
    """page id -> purity of its merged template; pages are (id, host, path), labels say which numbers are good."""
    label = {}
    for i, _, path in pages:
        m = re.search(r"([0-9]+)[^/0-9]*/?$", path)
        label[i] = labels.get(int(m[1])) if m else None
    template = brute_templates(Counter((h, p) for _, h, p in pages))
    merged = {(h, t): t for (h, _), t in template.items()}
    counts = defaultdict(lambda: [0, 0])
    for i, h, p in pages:
        if label[i] is not None:
            counts[h, template[h, p]][not label[i]] += 1

    def summed(of):
        out = defaultdict(lambda: [0, 0])
        for k in merged:
            g, b = counts[k]
            out[of(k)][0] += g
            out[of(k)][1] += b
        return out

    for d in range(max(map(len, merged.values())), 0, -1):
        hidden = lambda m, d=d: m[: d - 1] + ("*",) + m[d:] if len(m) >= d else m
        branch = summed(lambda k: (k[0], merged[k]))
        pool, after = summed(lambda k: (k[0], hidden(merged[k]))), {}
        for k in merged:
            (g, b), (pg, pb) = branch[k[0], merged[k]], pool[k[0], hidden(merged[k])]
            share = pg / (pg + pb) if pg + pb else None
            error = (share * (1 - share) / (g + b)) ** 0.5 if g + b else 0
            apart = error > 0 and abs(g / (g + b) - share) > z * error
            after[k] = merged[k] if apart else hidden(merged[k])
        merged = after
    table, host, leaf = summed(lambda k: 0)[0], summed(lambda k: k[0]), summed(lambda k: (k[0], merged[k]))
    base = table[0] / sum(table) if sum(table) else 1.0
    out = {}
    for i, h, p in pages:
        own = (host[h][0] + strength * base) / (sum(host[h]) + strength)
        g, b = leaf[h, merged[h, template[h, p]]]
        out[i] = (g + strength * own) / (g + b + strength)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_url_verdicts_by_brute_force(spark, seed):
    """Learned templates, merges and purities on small trees whose branches differ, with chains and early ends."""
    rng = random.Random(seed)
    pages = []
    for i in range(400):
        path = [rng.choice("ab"), *(["same", "chain"] if rng.random() < 0.5 else []), rng.choice(["x", "y", "z", "rare%d.html" % rng.randrange(90)]), *(rng.choice("pq") for _ in range(rng.randrange(3)))]
        pages.append((i, rng.choice(["h.net", "k.net"]), "/" + "/".join([*path[: rng.randrange(2, 9)], f"{i}.html" if rng.random() < 0.8 else ""])))
    labels = {i: int(rng.random() < (0.9 if "x" in p or "/a/" in p else 0.2)) for i, _, p in pages if rng.random() < 0.7}
    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, h, p in pages], "page_id bigint, url string")
    got = judge_urls(df, spark.createDataFrame([(k, v, 0) for k, v in labels.items()], "doc_id bigint, quality int, toxic int")).collect()
    want = brute_purities(pages, labels)
    assert {r["page_id"]: round(r["purity"], 9) for r in got} == {i: round(x, 9) for i, x in want.items()}
    assert all(r["verdict"] == ("block" if want[r["page_id"]] < 0.5 else "allow") for r in got)
    assert len({r["template"] for r in got}) > 3


def test_url_paths_of_many_shared_segments(spark):
    """Chains that several paths share take one round, however long."""
    trap = "/".join(f"s{i}" for i in range(400))
    pages = spark.createDataFrame([(i, f"http://h.net/{trap}/{i % 2}/{i}") for i in range(8)] + [(9, f"http://h.net/{trap}")], "page_id bigint, url string")
    began = time.time()
    got = judge_urls(pages, spark.createDataFrame([(i, i % 2, 0) for i in range(8)], "doc_id bigint, quality int, toxic int")).collect()
    assert len(got) == 9 and time.time() - began < 60
    assert len({r["template"].count("/") for r in got}) == 2


def test_repeated_rows_of_long_texts(spark):
    """Copies with one id and text find the same ranges, and each gets them once."""
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(None, text)] * 300 + [(1, text + " end"), (2, " ".join(f"v{i}" for i in range(60)))]
    got = remove_repeated_substrings(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()
    kept = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"][-5:]) for r in got)
    assert kept == {(None, 200, 200, ""): 300, (1, 201, 200, "end"): 1, (2, 60, 0, rows[-1][1][-5:]): 1}
    assert max(len(r["removed"]) for r in got) == 1


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_contamination_by_an_item_with_an_empty_id(spark, limit):
    """An empty id is an id; a null one is not reported."""
    docs = spark.createDataFrame([(1, PASSAGE), (2, LONG)], "doc_id bigint, text string")
    bench = spark.createDataFrame([("", PASSAGE), (None, PASSAGE), (None, LONG)], "item_id string, text string")
    got = {r["doc_id"]: r for r in find_contamination(docs, bench, most_broadcast=limit).collect()}
    assert got[1]["items"] == [""] and got[2]["items"] == [] and got[2]["n_hit"] == got[2]["n_words"] > 0


def test_level_and_kth(spark):
    assert level_between(np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1])) == 3.0
    assert level_between(np.array([1.0]), np.array([1])) == -np.inf
    values = [RNG.randrange(-(1 << 40), 1 << 40) for _ in range(200)] + [7] * 50
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for k in (1, 2, 100, 249, 250):
        assert kth_largest(df, "v", k, ways=8) == sorted(values, reverse=True)[k - 1]


def labelled(n=400, seed=11):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 4 == 1
        words = prose(rng.randint(5, 120), rng).split()
        if bad:
            words = [w + "$$$" for w in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["scumbag", "Idiot,", "idiots"])
        rows.append((i, " ".join(words), int(not bad), int(toxic)))
    return rows


def test_quality_of_contradictory_labels(spark):
    """Of several labels of one id the worst counts, once: the answer is that of the table without the others."""
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id bigint, text string")
    once = [(i, good and not i % 7 == 3) for i, _, good, _ in rows]
    twice = once + [(i, 1) for i, good in once if not good or i % 5 == 0]
    frame = lambda x: spark.createDataFrame([(i, int(g)) for i, g in x], "doc_id bigint, quality int")
    got = [Counter((r["doc_id"], r["kept"], round(r["draw"], 9)) for r in resample_quality(docs, frame(x)).collect()) for x in (once, twice)]
    assert got[0] == got[1]


def test_quality(spark, docs, empty):
    rows = labelled()
    table = spark.createDataFrame([(d, t, "s") for d, t, _, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(d, q_, None) for d, _, q_, _ in rows if d % 2] + [(None, 1, 0), (3, None, 1)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in resample_quality(table, labels).collect()}
    right = np.mean([got[d]["kept"] == bool(good) for d, _, good, _ in rows])
    assert right > 0.97
    drawn = sorted((r["draw"] for r in got.values()), reverse=True)
    kept = [r["draw"] for r in got.values() if r["kept"]]
    assert sorted(kept, reverse=True) == drawn[: len(kept)]  # the largest draws and no others
    assert sorted(r["doc_id"] for r in keep_quality(table.withColumn("row", F.lit(1)), labels).collect()) == sorted(d for d, r in got.items() if r["kept"])
    edge = {r["doc_id"]: r for r in resample_quality(docs, labels).collect()}
    assert not edge[1]["kept"] and not edge[2]["kept"] and not edge[3]["kept"] and edge[1]["weight"] is None
    assert resample_quality(docs, labels.limit(0)).filter("weight is not null and not kept").count() == 0
    assert resample_quality(empty, labels).count() == 0 and keep_quality(empty, labels).count() == 0


def test_toxicity(spark, docs, empty):
    rows = labelled(800)
    table = spark.createDataFrame([(d, t, "s") for d, t, _, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(d, 1, x) for d, _, _, x in rows], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in score_toxicity(table, labels, bits=14).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [(got[d]["predicted"], x) for d, _, _, x in rows if got[d]["held_out"]]
    assert np.mean([p == x for p, x in held]) > 0.95
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in score_toxicity(table, flipped, bits=14).collect()} == {d: r["score"] for d, r in got.items()}
    edge = score_toxicity(docs, labels, bits=14).collect()
    assert len(edge) == len(EDGES) and all(0 <= r["score"] <= 1 for r in edge)
    assert {r["score"] for r in score_toxicity(docs, labels.limit(0), bits=14).collect()} == {0.0}
    assert score_toxicity(empty, labels, bits=14).count() == 0


def test_digest_of_the_substring_query(spark):
    row = q.op1_substring_dedup(spark, "/root/testdata/sf0.001").filter("n_removed = n_words").first()
    assert row is None or row["kept_sha256"] == hashlib.sha256(b"").hexdigest()
