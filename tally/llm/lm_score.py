"""Scoring by masked pseudo-likelihood: how likely is each token, given the tokens on both sides?

The tokens are the most frequent words of the whole corpus, counted by a shuffle; all other words are dealt to a few
tokens by their hash. The vocabulary is every word of the corpus: a word that shares a token has the probability of
the token, given both sides, times its own share of the token's occurrences. These shares stay a table that grows with
the corpus and is joined to the texts' words; they are never collected, and the probabilities of all words add up to 1
but for what tokens that no word has take. The network sees SIDE tokens before and SIDE after a place, never the token
itself: their embeddings, one table for each place of the window, are added and squashed, and two softmax layers
give the class of the token and the token in its class. It is trained in numpy, on all texts: each task takes
steps over its own texts from common weights, and the tasks' weights are averaged by the tokens they saw, in
ROUNDS rounds that each take other texts. A text's score is the sum of the log-probabilities of all its words.

Nulls and texts without words have no tokens and score 0, mean null. Very long texts are scored whole, in
batches. Repeated rows are separate documents; other columns take no part. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import materialize

CLASSES = 32
TOKENS = CLASSES * CLASSES
UNKNOWN = 32
SIDE = 2
SIZE = 16
BATCH = 1 << 15
ROUNDS = 2
RATE = 0.1
SEED = 3
#: Different words that a task counts before it passes its counts on.
COUNTED = 200_000


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # lower() of bytes is that of ASCII


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): every word with its count in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        out = lambda: pa.RecordBatch.from_pydict({"word": pa.array(list(counts.keys()), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})
        for batch in batches:
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                counts.update(words(text))
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The TOKENS - UNKNOWN most frequent words with their counts in all texts, ties by the word."""
    return [(bytes(r["word"]), r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(TOKENS - UNKNOWN).collect()]


def shares(counts: DataFrame, known: list[tuple[bytes, int]]) -> DataFrame:
    """(word, log_share) of each word without a token of its own: its part of its token's occurrences."""
    top = counts.sparkSession.createDataFrame([(bytearray(w),) for w, _ in known], "word binary")
    rest = counts.join(F.broadcast(top), "word", "left_anti").withColumn("token", F.crc32("word") % UNKNOWN)
    totals = rest.groupBy("token").agg(F.sum("n").alias("total"))  # UNKNOWN rows at most
    return rest.join(F.broadcast(totals), "token").select("word", F.log(F.col("n") / F.col("total")).alias("log_share"))


SHARED = TOKENS - UNKNOWN


class Ids(dict):
    """Words to tokens; what has no token of its own shares one from SHARED on. That is found anew each time: a checksum takes less time
    than a store of words, most of which come only once."""

    def __init__(self, known: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(known))

    def of(self, said: list[bytes]) -> list[int]:
        own, shared = self.get, zlib.crc32
        return [t if (t := own(w)) is not None else SHARED + shared(w) % UNKNOWN for w in said]


class Network:
    """The weights, in one flat array, and what they say."""

    SHAPES = {"embedding": (2 * SIDE, TOKENS + 1, SIZE), "class_w": (SIZE, CLASSES), "class_b": (CLASSES,), "token_w": (CLASSES, SIZE, CLASSES), "token_b": (CLASSES, CLASSES)}

    def __init__(self, flat: np.ndarray):
        self.flat, self.part, at = flat, {}, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            self.part[name] = flat[at : at + n].reshape(shape)
            at += n

    @classmethod
    def length(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES.values())

    @classmethod
    def fresh(cls, counts: list[int]) -> Network:
        """Small random embeddings; the biases are the logarithms of the words' shares."""
        rng = np.random.default_rng(SEED)
        net = cls(np.zeros(cls.length(), np.float32))
        net.part["embedding"][:] = rng.normal(scale=0.1, size=cls.SHAPES["embedding"])
        net.part["class_w"][:] = rng.normal(scale=0.1, size=cls.SHAPES["class_w"])
        net.part["token_w"][:] = rng.normal(scale=0.1, size=cls.SHAPES["token_w"])
        share = np.ones(TOKENS)
        share[: len(counts)] += counts
        share = share.reshape(CLASSES, CLASSES)
        net.part["class_b"][:] = np.log(share.sum(axis=1) / share.sum())
        net.part["token_b"][:] = np.log(share / share.sum(axis=1, keepdims=True))
        return net

    def forward(self, around: np.ndarray, target: np.ndarray, slopes: bool) -> tuple[np.ndarray, dict | None]:
        """The log-probability of each target, tokens being in order of their class, and the slopes of their mean.
        A token is a column of what the layers say, so that sums and maxima over classes run along the tokens."""
        p = self.part
        near = [np.ascontiguousarray(around[:, o]) for o in range(2 * SIDE)]
        hidden = np.take(p["embedding"][0], near[0], axis=0)
        for o in range(1, 2 * SIDE):
            hidden += np.take(p["embedding"][o], near[o], axis=0)
        np.tanh(hidden, out=hidden)
        n, kind, member = len(target), target // CLASSES, target % CLASSES
        rows = np.arange(n)

        def soft(weights: np.ndarray, bias: np.ndarray, seen: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            logits = weights.T @ seen.T
            logits += bias[:, None]
            logits -= logits.max(axis=0)
            own = logits[chosen, rows[: len(chosen)]]
            np.exp(logits, out=logits)
            total = logits.sum(axis=0)
            if slopes:
                logits /= total
            return own - np.log(total), logits

        of_class, share = soft(p["class_w"], p["class_b"], hidden, kind)
        out = of_class
        grad = {name: np.zeros(shape, self.flat.dtype) for name, shape in self.SHAPES.items()} if slopes else None
        if slopes:
            share[kind, rows] -= 1
            share /= n
            grad["class_w"][:] = (share @ hidden).T
            grad["class_b"][:] = share.sum(axis=1)
            back = p["class_w"] @ share
        cuts = np.searchsorted(kind, np.arange(CLASSES + 1))
        for c in range(CLASSES):
            a, b = cuts[c], cuts[c + 1]
            if a == b:
                continue
            in_class, share = soft(p["token_w"][c], p["token_b"][c], hidden[a:b], member[a:b])
            out[a:b] += in_class
            if slopes:
                share[member[a:b], rows[: b - a]] -= 1
                share /= n
                grad["token_w"][c] = (share @ hidden[a:b]).T
                grad["token_b"][c] = share.sum(axis=1)
                back[:, a:b] += p["token_w"][c] @ share
        if slopes:
            back *= (1 - hidden**2).T
            back = back.astype(np.float64)
            for o in range(2 * SIDE):
                at = near[o].astype(np.intp)
                for k in range(SIZE):
                    grad["embedding"][o, :, k] = np.bincount(at, back[k], minlength=TOKENS + 1)
        return out, grad


def _windows(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, the 2 * SIDE tokens around each, its document); past a text's ends stands the token TOKENS."""
    lengths = np.array([len(d) for d in docs], np.int64)
    tokens = np.fromiter(chain.from_iterable(docs), np.int32, int(lengths.sum()))
    owner = np.repeat(np.arange(len(docs)), lengths)
    at = np.arange(len(tokens)) + SIDE * (owner + 1)  # a gap stands before each text, and one after the last
    line = np.full(len(tokens) + SIDE * (len(docs) + 1), TOKENS, np.int32)
    line[at] = tokens
    around = np.stack([line[at + o] for o in range(-SIDE, SIDE + 1) if o], axis=1)
    return tokens, around, owner


def _batches(batches: Iterator[pa.RecordBatch], ids: Ids, sharing: bool = False) -> Iterator[tuple[list[tuple[int, int]], list[list[int]], list[Counter]]]:
    """Texts as tokens, in groups of about BATCH tokens: (batch number, row) of each, the tokens, and, if asked for,
    the counts of the words that share a token."""
    names, group, others, held = [], [], [], 0
    for number, batch in enumerate(batches):
        for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
            said = words(text)
            doc = ids.of(said)
            if sharing:
                others.append(Counter([w for w, t in zip(said, doc) if t >= SHARED]))
            names.append((number, row))
            group.append(doc)
            held += len(doc)
            if held >= BATCH:
                yield names, group, others
                names, group, others, held = [], [], [], 0
    if group:
        yield names, group, others


def _steps(group: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of at most BATCH tokens of a group, in order of their class: target, around, document."""
    target, around, owner = _windows(group)
    for at in range(0, len(target), BATCH):
        t = target[at : at + BATCH]
        order = np.argsort((t // CLASSES).astype(np.uint8), kind="stable")
        yield t[order], around[at : at + BATCH][order], owner[at : at + BATCH][order]


def train(docs: DataFrame, known: list[tuple[bytes, int]]) -> Network:
    """The weights after all rounds."""
    vocab = [w for w, _ in known]
    net = Network.fresh([n for _, n in known])
    length = Network.length()
    for round_ in range(ROUNDS):
        start = net.flat.tobytes()

        def learn(batches: Iterator[pa.RecordBatch], start: bytes = start) -> Iterator[pa.RecordBatch]:
            own = Network(np.frombuffer(start, np.float32).copy())
            squares = Network(np.full(length, 1e-7, np.float32))
            seen = 0
            for _, group, _ in _batches(batches, Ids(vocab)):
                for target, around, _ in _steps(group):
                    _, grad = own.forward(around, target, slopes=True)
                    for name, g in grad.items():
                        squares.part[name][:] += g**2
                        own.part[name][:] -= RATE * g / np.sqrt(squares.part[name])
                    seen += len(target)
            if seen:
                yield _sum_row(seen, own.flat.astype(np.float64) * seen)

        mine = docs.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == round_).select("text")
        # one row for each task, which a tree of two levels sums
        each = materialize(mine.mapInArrow(learn, SUM), "lm-weights")
        level = max(1, math.isqrt(each.count()))
        dealt = each.select(F.pmod(F.xxhash64("seen", "weights"), F.lit(level)).alias("part"), "seen", "weights")
        total = dealt.repartition(level, "part").select("seen", "weights").mapInArrow(_summed, SUM).coalesce(1).mapInArrow(_summed, SUM).collect()
        for row in total:  # one, or none if there were no tokens
            net = Network((np.frombuffer(row["weights"]) / row["seen"]).astype(np.float32))
    return net


SUM = "seen long, weights binary"


def _sum_row(seen: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"seen": pa.array([seen], pa.int64()), "weights": pa.array([weights.tobytes()], pa.binary())})


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, weights = 0, None
    for batch in batches:
        for n, raw in zip(batch.column("seen").to_pylist(), batch.column("weights")):
            one = np.frombuffer(raw.as_buffer())
            seen, weights = seen + n, one.copy() if weights is None else np.add(weights, one, out=weights)
    if weights is not None:
        yield _sum_row(seen, weights)


def score(docs: DataFrame, net: Network, known: list[tuple[bytes, int]]) -> DataFrame:
    """(row, doc_id, n_tokens, log_likelihood, others) for each row of docs: the score by tokens, and the counts of the
    words that share one."""
    vocab, flat = [w for w, _ in known], net.flat.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = Network(np.frombuffer(flat, np.float32)), Ids(vocab)
        held: dict[int, pa.Array] = {}

        def noted() -> Iterator[pa.RecordBatch]:
            for number, batch in enumerate(batches):
                held[number] = batch.column("row"), batch.column("doc_id")
                yield batch

        for names, group, others in _batches(noted(), ids, sharing=True):
            total = np.zeros(len(group))
            for target, around, owner in _steps(group):
                logs, _ = own.forward(around, target, slopes=False)
                total += np.bincount(owner, logs.astype(np.float64), minlength=len(group))
            n = np.array([len(d) for d in group], np.int64)
            at, doc_ids = ([held[number][c][row].as_py() for number, row in names] for c in (0, 1))
            for old in [k for k in held if k < names[-1][0]]:
                del held[old]
            starts = np.cumsum([0, *map(len, others)], dtype=np.int32)
            pairs = pa.StructArray.from_arrays([pa.array([w for o in others for w in o], pa.binary()), pa.array([k for o in others for k in o.values()], pa.int64())], ["word", "k"])
            yield pa.RecordBatch.from_pydict({"row": pa.array(at, pa.int64()), "doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(n), "log_likelihood": pa.array(total), "others": pa.ListArray.from_arrays(pa.array(starts), pairs)})

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(run, "row long, doc_id long, n_tokens long, log_likelihood double, others array<struct<word: binary, k: long>>")


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) for each row of docs."""
    counts = materialize(word_counts(docs), "lm-counts")
    known = vocabulary(counts)
    scored = materialize(score(docs, train(docs, known), known), "lm-scores")  # rows keep their numbers from here on
    each = scored.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.k")
    extra = each.join(materialize(shares(counts, known), "lm-shares"), "word").groupBy("row").agg(F.sum(F.col("k") * F.col("log_share")).alias("extra"))
    total = F.col("log_likelihood") + F.coalesce("extra", F.lit(0.0))
    whole = scored.join(extra, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"))
    return whole.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
