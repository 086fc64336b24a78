"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positive sample P, texts of any kind the unlabelled sample U. With the class prior
p (the share of toxic texts among labelled ones) the risk of a linear classifier z is

    p E_P[l(z)] + max(0, E_U[l(-z)] - p E_P[l(-z)]),    l the logistic loss,

whose second part estimates the risk on texts that are not toxic and would be negative only by overfitting;
while it is, the step goes up that part instead of down. Features are hashed: each different word of a text, in
lower case and without marks around it, and its beginnings. A classifier weighs those whose share of texts in P
and in U differs beyond chance (a two-sample z of LEAST_Z or more, in LEAST_TEXTS texts or more); the others are 0.

The fit uses bounded samples: at most MOST_POSITIVE toxic and MOST_UNLABELLED other texts of the learning folds,
those of the least hash of their doc_id, dealt to as many classifiers as there are MEMBER_POSITIVE toxic ones,
which are averaged. The prior counts all
labels of the learning folds, and all texts are scored whole.

Rows whose crc32(doc_id as text) mod 4 is HELD_OUT are never learned from, neither labels nor texts. Null and
empty texts get the score of no words. Null labels and labels of null doc_ids are left out; a doc_id with
several labels is toxic if one says so. Without positive labels all scores are 0. Other columns pass through
whatever their names; a null doc_id is not held out. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.llm.common import blocks_for, materialize
from tally.llm.pieces import Recent

FOLDS, HELD_OUT = 4, 2
MOST_POSITIVE, MOST_UNLABELLED = 10_000, 20_000
#: Positive texts of one classifier.
MEMBER_POSITIVE = 2_500
BITS = 20
THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6, 7)
MARKS = ".,;:!?*$%&#|<>\"'()[]{}-_~"
LEAST_Z, LEAST_TEXTS = 3.0, 10
EPOCHS, BATCH, RATE, DECAY, SEED = 8, 256, 0.1, 1e-3, 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def word_features(token: str) -> list[int]:
    word = token.strip(MARKS)
    if not word:
        return []
    mask = (1 << BITS) - 1
    return [zlib.crc32(word.encode()) & mask, *(zlib.crc32(b"^%d " % n + word[:n].encode()) & mask for n in BEGINNINGS if len(word) > n)]


def tokens(text: str | None) -> list[str]:
    """The different words of a text, in order."""
    return list(dict.fromkeys((text or "").lower().split()))


def text_features(text: str | None) -> set[int]:
    return {f for token in tokens(text) for f in word_features(token)}


class _Rows:
    """Texts as rows of different features."""

    def __init__(self, features: list[np.ndarray]):
        self.at = np.r_[0, np.cumsum([len(f) for f in features])].astype(np.int64)
        self.ids = np.concatenate([*features, np.zeros(0, np.int32)]).astype(np.int64)
        self.n = len(features)

    def only(self, wanted: np.ndarray) -> _Rows:
        keep = wanted[self.ids]
        rows = _Rows([])
        rows.at, rows.ids, rows.n = np.r_[0, np.cumsum(keep)][self.at], self.ids[keep], self.n
        return rows

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of the rows, and to which of them each belongs."""
        sizes = self.at[rows + 1] - self.at[rows]
        owner = np.repeat(np.arange(len(rows)), sizes)
        start = np.repeat(self.at[rows] - np.r_[0, np.cumsum(sizes)[:-1]], sizes)
        return self.ids[start + np.arange(len(owner))], owner


def telling(positive: _Rows, unlabelled: _Rows) -> np.ndarray:
    """Whether each feature's share of texts differs between the samples beyond chance."""
    p, u = (np.bincount(r.ids, minlength=1 << BITS) for r in (positive, unlabelled))
    share = (p + u) / (positive.n + unlabelled.n)
    spread = np.sqrt(np.maximum(1e-12, share * (1 - share)) * (1 / positive.n + 1 / unlabelled.n))
    return (np.abs(p / positive.n - u / unlabelled.n) >= LEAST_Z * spread) & (p + u >= LEAST_TEXTS)


def train(positive: _Rows, unlabelled: _Rows, prior: float, seed: int = SEED) -> np.ndarray:
    """Weights, the last one the bias, by stochastic steps scaled by past gradients."""
    size = 1 << BITS
    wanted = telling(positive, unlabelled)
    positive, unlabelled = positive.only(wanted), unlabelled.only(wanted)
    w, g2 = np.zeros(size + 1), np.full(size + 1, 1e-6)
    w[-1] = math.log(prior / (1 - prior))
    rng = np.random.default_rng(seed)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    loss = lambda x: np.logaddexp(0, -x)

    def margin(rows: _Rows, which: np.ndarray):
        ids, owner = rows.take(which)
        return np.bincount(owner, w[ids], minlength=len(which)) + w[-1], ids, owner

    def step(parts) -> None:
        ids = np.concatenate([p[0] for p in parts])
        each = np.concatenate([p[2][p[1]] for p in parts])
        used, back = np.unique(ids, return_inverse=True)
        grad = np.bincount(back, each, minlength=len(used)) + DECAY * w[used]
        g2[used] += grad**2
        w[used] -= RATE * grad / np.sqrt(g2[used])
        bias = sum(float(p[2].sum()) for p in parts)
        g2[-1] += bias**2
        w[-1] -= RATE * 0.1 * bias / math.sqrt(g2[-1])

    for _ in range(EPOCHS):
        order = rng.permutation(unlabelled.n)
        for at in range(0, unlabelled.n, BATCH):
            u = order[at : at + BATCH]
            p = rng.integers(0, positive.n, min(BATCH, positive.n))
            zu, iu, ou = margin(unlabelled, u)
            zp, ip, op = margin(positive, p)
            rest = loss(-zu).mean() - prior * loss(-zp).mean()
            # slopes of E_U[l(-z)], E_P[l(-z)] and E_P[l(z)] for each text
            du, dn, dp = sigmoid(zu) / len(u), sigmoid(zp) / len(p), -sigmoid(-zp) / len(p)
            if rest >= 0:
                step([(iu, ou, du), (ip, op, prior * (dp - dn))])
            else:
                step([(iu, ou, -du), (ip, op, prior * dn)])
    return w


SAMPLE = "member int, positive boolean, features array<int>"


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> np.ndarray | None:
    """The averaged weights, or None if no label of the learning folds is positive.

    The classifier is fitted on at most most_positive toxic texts, and at most most_unlabelled others, by the least hashes
    of their doc_ids: more of them make the features' shares and the risk estimate more exact, at a cost that grows with
    their number; with fewer the classifier does not become biased, since the prior is counted over all labels."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known, "toxicity-labels")
    n, n_toxic = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    if not n_toxic:
        return None
    prior = min(0.95, n_toxic / n)
    least = lambda df, most: df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    positive = least(known.filter("toxic = 1"), most_positive).withColumn("positive", F.lit(True))
    others = least(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))), most_unlabelled).withColumn("positive", F.lit(False))
    # at most most_positive + most_unlabelled ids
    sample = materialize(positive.union(others).withColumn("member", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(blocks_for(min(n_toxic, most_positive), MEMBER_POSITIVE))).cast("int")), "toxicity-sample")
    texts = docs.join(F.broadcast(sample), "doc_id").select("member", "positive", "text")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = [np.array(sorted(text_features(t)), np.int32) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("member"), batch.column("positive"), pa.array(features, pa.list_(pa.int32()))], ["member", "positive", "features"])

    def learn(table: pa.Table) -> pa.Table:
        positive_ = np.array(table.column("positive").to_pylist(), bool)
        features = [np.asarray(f, np.int32) for f in table.column("features").to_numpy()]
        p, u = (_Rows([features[i] for i in np.flatnonzero(mask)]) for mask in (positive_, ~positive_))
        if not p.n or not u.n:
            return pa.table({"weights": pa.array([], pa.binary())})
        return pa.table({"weights": pa.array([train(p, u, prior).astype("<f4").tobytes()], pa.binary())})

    learned = texts.mapInArrow(featured, SAMPLE).groupBy("member").applyInArrow(learn, "weights binary").collect()  # one row for each member
    if not learned:
        return None
    return np.mean([np.frombuffer(r["weights"], "<f4") for r in learned], axis=0)


def score(docs: DataFrame, weights: np.ndarray | None, text: str = "text") -> DataFrame:
    """docs without the text, with `score`, from 0 to 1, in place of a column of this name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if weights is not None:
            worth = dict(zip(np.flatnonzero(weights[:-1]).tolist(), weights[:-1][weights[:-1] != 0].tolist()))
            # for each word, those of its features that weigh anything
            told = Recent(lambda token: frozenset(f for f in word_features(token) if f in worth))

        def one(t: str | None) -> float:
            if weights is None:
                return 0.0
            found = sorted(set().union(*map(told.__getitem__, tokens(t))))
            z = math.fsum(map(worth.__getitem__, found)) + float(weights[-1])
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                yield batch.drop_columns([text]).append_column("score", pa.array([one(t) for t in batch.column(text).to_pylist()], pa.float64()))

    rest = docs.drop(text, "score")
    return docs.select(text, *[F.col(f"`{c}`") for c in rest.columns]).mapInArrow(run, rest.withColumn("score", F.lit(0.0)).schema)
