"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed words and word beginnings (which carry the stem where a
language inflects).  The score is the logistic of a bias, a weight for each term, and the
products of the terms' factors for each pair, so a pair can say what its terms alone don't.
The model is trained on a bounded sample of labelled rows and scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Words, in_pieces, mix64, small_batches, text_bytes, word_table

_U64 = np.uint64
_TABLE = word_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_BYTE_CODES = mix64(np.arange(1, 257, dtype=_U64) * _U64(0xA0761D6478BD642F))
#: Bytes of the word beginnings that are terms of their own.
BEGINNINGS = (4, 5, 6)


def term_sets(texts: list[bytes], bits: int, rolling: Rolling) -> Iterator[np.ndarray]:
    """The distinct hashed terms of each text, in order."""
    for a, b in in_pieces(texts):
        words = Words([t.lower() for t in texts[a:b]], _TABLE)
        codes = _BYTE_CODES[np.frombuffer(words.buffer, np.uint8)]
        kinds = [(rolling.slices(codes, words.starts, words.ends), np.ones(len(words.starts), bool))]
        for n in BEGINNINGS:
            kinds.append((rolling.slices(codes, words.starts, np.minimum(words.starts + n, words.ends)) + _U64(n), words.ends - words.starts >= n))
        terms = [((mix64(h) >> _U64(64 - bits)).astype(np.int32), use) for h, use in kinds]
        for x, y in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            yield np.unique(np.concatenate([h[x:y][use[x:y]] for h, use in terms]))


class Sets:
    """Sets of terms, end to end; ``sizes``: terms of each."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray) -> None:
        self.terms, self.sizes, self.begins = terms, sizes, np.cumsum(sizes) - sizes

    def some(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of some sets, end to end, and where each begins."""
        sizes = self.sizes[rows]
        begins = np.cumsum(sizes) - sizes
        return self.terms[np.repeat(self.begins[rows] - begins, sizes) + np.arange(sizes.sum())], begins


def sums(terms: np.ndarray, begins: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The factor sums, and the scores before the logistic, of sets that lie end to end; none may be empty."""
    v = factors[terms]
    total = np.add.reduceat(v, begins)
    pairs = ((total * total).sum(1) - np.add.reduceat(np.einsum("if,if->i", v, v), begins)) / 2
    return total, bias + np.add.reduceat(weights[terms], begins) + pairs


class FactorizationMachine:
    """Logistic factorization machine over sets of terms: a bias, a weight for each term, and for each pair of
    terms the product of their factors.

    Factors start so small that the pairs of a text of ``size`` terms add noise of about ``noise`` to its margin;
    the product of two terms that matter together grows from there, however long the text.
    """

    def __init__(self, terms: int, factors: int, size: float, seed: int = 2, noise: float = 0.02) -> None:
        spread = np.sqrt(noise / (max(size, 1.0) * max(factors, 1) ** 0.5))
        self.bias = 0.0
        self.weights = np.zeros(terms, np.float32)
        self.factors = np.random.default_rng(seed).standard_normal((terms, factors), np.float32) * np.float32(spread)

    def parameters(self) -> tuple:
        return self.bias, self.weights, self.factors

    def fit(self, sets: Sets, labels: np.ndarray, importance: np.ndarray, rows: np.ndarray, audit: np.ndarray, epochs: int = 16, least_steps: int = 1500, patience: int = 3, rate: float = 0.05, factor_rate: float = 0.02, decay: float = 1e-3, factor_decay: float = 3e-4, batch: int = 64, seed: int = 4) -> None:
        """AdaGrad on the logistic loss of ``rows``, in batches of texts, until the loss of ``audit`` (if any)
        has not fallen for ``patience`` of the later epochs; the parameters at its least stay.

        The first quarter of the epochs leaves the factors alone, and then their steps grow to full length over two
        epochs: in what weights can explain, the pairs of many terms at once would throw margins far off.  Of few
        texts there are more epochs, for ``least_steps`` batches in all."""
        rng = np.random.default_rng(seed)
        rows = rows[sets.sizes[rows] > 0]
        batches = max(1, -(-len(rows) // batch))
        epochs = max(epochs, least_steps // batches)
        share = np.clip(np.average(labels, weights=importance), 1e-6, 1 - 1e-6)
        self.bias = float(np.log(share / (1 - share)))
        gw, gv, gb = np.full(len(self.weights), 1e-4, np.float32), np.full(self.factors.shape, 1e-3, np.float32), 1e-4
        best, stale, step = (self.loss(sets, labels, importance, audit), *map(np.copy, self.parameters())), 0, 0
        for epoch in range(epochs):
            rng.shuffle(rows)
            for i in range(0, len(rows), batch):
                own = rows[i : i + batch]
                terms, begins = sets.some(own)
                total, margin = sums(terms, begins, *self.parameters())
                slope = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[own]) * importance[own] / len(own)).astype(np.float32)
                order = np.argsort(terms, kind="stable")
                first = np.flatnonzero(np.diff(terms[order], prepend=-1))
                used, of = terms[order[first]], np.repeat(np.arange(len(own)), sets.sizes[own])[order]
                pull = np.add.reduceat(slope[of], first)
                dw, db = pull + decay * self.weights[used], float(slope.sum())
                gw[used] += dw**2
                gb += db * db
                self.weights[used] -= rate * dw / np.sqrt(gw[used])
                self.bias -= rate * db / gb**0.5
                if epoch >= epochs // 4:
                    dv = np.add.reduceat((slope[:, None] * total)[of], first) + (factor_decay - pull)[:, None] * self.factors[used]
                    gv[used] += dv**2
                    step += 1
                    self.factors[used] -= min(1.0, step / (2 * batches)) * factor_rate * dv / np.sqrt(gv[used])
            loss = self.loss(sets, labels, importance, audit)
            stale = 0 if loss < best[0] else stale + 1
            if not stale or not len(audit):
                best = (loss, *map(np.copy, self.parameters()))
            if epoch >= epochs // 2 and stale >= patience and len(audit):
                break
        _, self.bias, self.weights, self.factors = best
        self.bias = float(self.bias)

    def of(self, sets: Sets, rows: np.ndarray, at_once: int = 256) -> np.ndarray:
        """The margins of some texts."""
        out = np.full(len(rows), self.bias)
        for i in range(0, len(rows), at_once):
            full = i + np.flatnonzero(sets.sizes[rows[i : i + at_once]])
            if len(full):
                out[full] = sums(*sets.some(rows[full]), *self.parameters())[1]
        return out

    def loss(self, sets: Sets, labels: np.ndarray, importance: np.ndarray, rows: np.ndarray) -> float:
        """The mean logistic loss of some texts; 0 of none."""
        side = np.where(labels[rows] > 0, -1.0, 1.0) * self.of(sets, rows)
        return float(np.average(np.logaddexp(0, side), weights=importance[rows])) if len(rows) else 0.0


def best_margin(margins: np.ndarray, labels: np.ndarray, importance: np.ndarray, most_false: float = 0.005) -> float:
    """The margin above which predicting 1 has the largest F1, among those that at most this share of label 0
    exceeds."""
    order = np.argsort(-margins, kind="stable")
    ranked = np.append(margins[order], margins.min() - 1)
    hit, all_ = np.cumsum((importance * labels)[order]), np.cumsum(importance[order])
    false = np.cumsum(labels[order] == 0) / max(1, (labels == 0).sum())
    f1 = np.where(false <= most_false, 2 * hit / (all_ + (importance * labels).sum()), -1)
    i = int(f1.argmax())
    if f1[i] <= 0:  # nothing can be told apart without going over that share
        return float(ranked[0] + 1)
    return float((ranked[i] + ranked[i + 1]) / 2)


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is divisible by 5; a null id counts as empty text, and is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def _terms(shared, bits: int):
    """Labels and terms of the sampled documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = shared.value
        rolling = Rolling()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            rows = [i for i, d in enumerate(ids) if d in labels]
            if rows:
                texts = text_bytes(batch.column("text").take(pa.array(rows)))
                sets = [s.tobytes() for s in term_sets(texts, bits, rolling)]
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in rows], pa.int64()), pa.array([labels[ids[i]] for i in rows], pa.int32()), pa.array(sets, pa.binary())], names=["id", "label", "terms"])

    return task


def _score(shared, bits: int):
    """Scores of whole texts; the model comes as plain arrays, so workers need no copy of this module."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row_of, *model = shared.value
        rolling = Rolling()
        for batch in batches:
            scores = np.full(batch.num_rows, model[0], np.float64)
            held: list[np.ndarray] = []
            rows: list[int] = []
            size = 0

            def close() -> None:
                sizes = np.fromiter(map(len, held), np.int64, len(held))
                scores[rows] = sums(np.concatenate(held), np.cumsum(sizes) - sizes, *model)[1]
                held.clear()
                rows.clear()

            for i, terms in enumerate(term_sets(text_bytes(batch.column("text")), bits, rolling)):
                own = row_of[terms]
                own = own[own >= 0]
                if len(own):
                    held.append(own)
                    rows.append(i)
                    size += len(own)
                    if size > 1 << 17:
                        close()
                        size = 0
            if held:
                close()
                size = 0
            with np.errstate(over="ignore"):
                chances = 1 / (1 + np.exp(-scores))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(chances)], names=["id", "held_out", "score"])

    return task


def _fitted(known: pa.Table, share: dict[int, int], bits: int, factors: int, least_rows: int, seed: int) -> tuple:
    """From the sampled rows (id, label, terms): the row of each hashed term in the model (-1: in too few texts),
    and the model's parameters."""
    y = known["label"].to_numpy()
    importance = np.array([share[x] / max(1, (y == x).sum()) for x in (0, 1)])[y]
    importance = (importance / importance.mean()).astype(np.float32)
    held = known["terms"].combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1] // 4
    hashed = np.frombuffer(held.buffers()[2], np.int32)[ends[0] : ends[-1]]
    fold = np.array([zlib.crc32(b"fold %d" % d) % 4 > 0 for d in known["id"].to_pylist()])
    whole = not all(0 < (y[f] == 1).sum() < f.sum() for f in (fold, ~fold))
    fold |= whole  # too few rows to keep some back

    rows_of = np.repeat(fold, np.diff(ends))
    often = np.bincount(hashed[rows_of], minlength=1 << bits) >= least_rows
    row_of = np.where(often, np.cumsum(often, dtype=np.int32) - 1, np.int32(-1)).astype(np.int32)
    met = row_of[hashed] >= 0
    sizes = np.diff(np.concatenate([[0], np.cumsum(met)])[ends - ends[0]])
    sets = Sets(row_of[hashed[met]], sizes)
    model = FactorizationMachine(int(often.sum()), factors, sizes.mean(), seed)
    rest = np.flatnonzero(~fold)
    model.fit(sets, y.astype(np.float32), importance, np.flatnonzero(fold), rest)
    if not whole:
        model.bias -= best_margin(model.of(sets, rest), y[rest], importance[rest])
    return row_of, *model.parameters()


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", bits: int = 20, factors: int = 8, most_labelled: int = 5_000, least_rows: int = 10, seed: int = 2) -> DataFrame:
    """Score every whole text: the chance, as the model sees it, that its label is 1.

    Returns one row per document: the id column, ``held_out`` (crc32 of the id as text is divisible by 5: such
    rows' labels are never used), ``score`` and ``predicted`` (score of 0.5 or more).

    ``most_labelled`` bounds the labelled ids of either label that train the model, taken in order of a hash
    of their ids; they are weighted back to the shares that the labels have.  Three quarters of them fit the
    model; the rest end its training, and set its bias, so that 0.5 is where the prediction has the largest F1
    with at most half a per cent of label 0 above it.  Terms in fewer than ``least_rows`` of the fitted texts
    are not in the model.  ``factors``: 0 makes the model linear.

    Defined cases: a null or empty text has no terms and the score of the bias; without labels of both kinds
    all scores are the share of label 1 (0 without labels); labels that are null or of unknown ids are not
    used; an id labelled both 0 and 1 counts as 1; of several texts of a labelled id one trains the model, the same
    in every run; repeated rows have equal scores; empty tables are fine; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.select(F.col(label_id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(~held_out("id"))
    usable = usable.groupBy("id").agg(F.max("label").alias("label"))
    share = {x["label"]: x["count"] for x in usable.groupBy("label").count().collect()}
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    row_of, model = np.full(1 << bits, -1, np.int32), None
    if len(share) == 2:
        sample = {x["id"]: x["label"] for y in (0, 1) for x in usable.filter(F.col("label") == y).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most_labelled).collect()}
        terms = rows.mapInArrow(_terms(spark.sparkContext.broadcast(sample), bits), "id bigint, label int, terms binary")
        known = terms.groupBy("id").agg(F.max("label").alias("label"), F.min("terms").alias("terms")).toArrow().sort_by("id")  # a row a sampled id
        if known.num_rows and len(known["label"].unique()) == 2:
            model = _fitted(known, share, bits, factors, least_rows, seed)
        del known
    if model is None:
        bias = {(): -np.inf, (0,): -np.inf, (1,): np.inf}.get(tuple(share), 0.0)
        model = row_of, bias, np.zeros(0, np.float32), np.zeros((0, factors), np.float32)
    out = rows.withColumn("held_out", held_out("id")).mapInArrow(_score(spark.sparkContext.broadcast(model), bits), "id bigint, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
