"""Scores, classifiers, rules and mixing on small tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.llm import ann, lm_score, mixing, quality_rules, toxicity

RNG = random.Random(5)
WORDS = [f"w{i}" for i in range(300)]


def test_gradients_are_slopes():
    rng = np.random.default_rng(0)
    net = lm_score.Network.fresh([10, 5, 3])
    net.flat = net.flat.astype(np.float64)
    net = lm_score.Network(net.flat)
    target = np.sort(rng.integers(0, lm_score.TOKENS, 40))
    around = rng.integers(0, lm_score.TOKENS + 1, (40, 2 * lm_score.SIDE))
    logs, grad = net.forward(around, target, slopes=True)
    at = 0
    for name, shape in lm_score.Network.SHAPES.items():
        n = int(np.prod(shape))
        steepest = np.argsort(-np.abs(grad[name].ravel()))[:3]
        for k in steepest:
            moved = net.flat.copy()
            moved[at + k] += 1e-5
            up = lm_score.Network(moved).forward(around, target, slopes=False)[0].mean()
            assert -(up - logs.mean()) / 1e-5 == pytest.approx(grad[name].ravel()[k], rel=2e-2, abs=1e-6)
        at += n


def test_probabilities_add_up_to_one():
    net = lm_score.Network.fresh([3, 2, 1])
    around = np.full((lm_score.TOKENS, 2 * lm_score.SIDE), 7)
    logs, _ = net.forward(around, np.arange(lm_score.TOKENS), slopes=False)
    assert np.exp(logs.astype(np.float64)).sum() == pytest.approx(1, abs=1e-4)


def test_windows_never_show_the_token():
    target, around, owner = lm_score._windows([[1, 2, 3], [], [4]])
    assert target.tolist() == [1, 2, 3, 4] and owner.tolist() == [0, 0, 0, 2]
    p = lm_score.TOKENS
    assert around.tolist() == [[p, p, 2, 3], [p, 1, 3, p], [1, 2, p, p], [p, p, p, p]]


def test_scores_follow_the_corpus(spark):
    texts = [" ".join(["the", "cat", "sat", "on", "mats"] * 30) for _ in range(60)] + [" ".join(RNG.sample(WORDS, 50)) for _ in range(6)] + [None, "", "cat"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(3)
    got = {r["doc_id"]: r for r in lm_score.pseudo_likelihood(df).collect()}
    assert len(got) == len(texts)
    assert got[0]["n_tokens"] == 150 and got[0]["mean_log_likelihood"] > got[62]["mean_log_likelihood"] + 1
    assert got[66]["n_tokens"] == 0 and got[66]["log_likelihood"] == 0 and got[67]["mean_log_likelihood"] is None
    assert got[0]["log_likelihood"] == pytest.approx(150 * got[0]["mean_log_likelihood"])
    assert lm_score.pseudo_likelihood(df.limit(0)).count() == 0


def test_every_word_has_its_own_probability(spark):
    """Words beyond the tokens, of one token but of different counts, differ by the logarithm of their counts."""
    by_token = {}
    for w in (f"rare{i}" for i in range(200)):
        by_token.setdefault(zlib.crc32(w.encode()) % lm_score.UNKNOWN, []).append(w)
    often, seldom = next(v for v in by_token.values() if len(v) > 1)[:2]
    common = " ".join(f"c{i}" for i in range(lm_score.TOKENS - lm_score.UNKNOWN))
    texts = [common] * 9 + [f"c1 {often} c2", f"c1 {seldom} c2", *[often] * 4]
    got = {r["doc_id"]: r["log_likelihood"] for r in lm_score.pseudo_likelihood(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[9] - got[10] == pytest.approx(math.log(5), abs=1e-4)


def slow_log_probability(net, before, after, token):
    """The network's log-probability of a token between two on each side, in plain Python."""
    part, kinds = net.part, lm_score.CLASSES
    around = [*before, *after]
    hidden = [math.tanh(sum(float(part["embedding"][o][t][k]) for o, t in enumerate(around))) for k in range(lm_score.SIZE)]

    def soft(weights, bias, chosen):
        logits = [float(bias[j]) + sum(h * float(weights[k][j]) for k, h in enumerate(hidden)) for j in range(kinds)]
        top = max(logits)
        return logits[chosen] - top - math.log(sum(math.exp(x - top) for x in logits))

    kind, member = divmod(token, kinds)
    return soft(part["class_w"], part["class_b"], kind) + soft(part["token_w"][kind], part["token_b"][kind], member)


def test_scores_by_brute_force(spark):
    """Every text's score, by the trained weights, from each token and its neighbours, and the words' shares; with nulls,
    repeated rows, a null doc_id and a text longer than a batch of steps."""
    rng = random.Random(4)
    frequent = [f"c{i}" for i in range(lm_score.TOKENS - lm_score.UNKNOWN)]
    texts = [" ".join(frequent) + " " + " ".join(rng.choice(frequent[:40]) for _ in range(50)) for _ in range(3)]
    texts += [" ".join(rng.choice([*frequent[:30], "Rare1", "rare2", "rare3", "\u00e9t\u00e9"]) for _ in range(12)) for _ in range(6)] + [None, "", " \t", "rare1"]
    rows = [*enumerate(texts), (None, texts[4]), (4, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counts = lm_score.word_counts(docs).cache()
    known = lm_score.vocabulary(counts)
    net = lm_score.train(docs, known)
    number = {w: i for i, (w, _) in enumerate(known)}
    every = {bytes(r["word"]): r["n"] for r in counts.collect()}
    of = lambda w: number.get(w, lm_score.TOKENS - lm_score.UNKNOWN + zlib.crc32(w) % lm_score.UNKNOWN)
    total = {}
    for w, n in every.items():
        if w not in number:
            total[of(w)] = total.get(of(w), 0) + n
    want = {}
    for doc_id, text in rows[3:]:
        words = [w.lower() for w in (text or "").encode().split()]
        tokens, gap, score = [of(w) for w in words], [lm_score.TOKENS] * 2, 0.0
        for i, (w, t) in enumerate(zip(words, tokens)):
            line = [*gap, *tokens, *gap]
            score += slow_log_probability(net, line[i : i + 2], line[i + 3 : i + 5], t)
            score += 0.0 if w in number else math.log(every[w] / total[t])
        want[doc_id, len(words)] = score
    got = lm_score.pseudo_likelihood(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if (r["doc_id"], r["n_tokens"]) in want:
            assert r["log_likelihood"] == pytest.approx(want[r["doc_id"], r["n_tokens"]], rel=1e-3, abs=1e-3)
    assert {(r["doc_id"], r["n_tokens"]) for r in got} >= set(want)


def test_a_very_long_text_is_scored_whole(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH", 64)
    long = " ".join(RNG.choice(WORDS[:20]) for _ in range(5000))
    got = {r["doc_id"]: r for r in lm_score.pseudo_likelihood(spark.createDataFrame([(1, long), (2, "w1 w2")], "doc_id long, text string")).collect()}
    assert got[1]["n_tokens"] == 5000 and got[1]["log_likelihood"] < -5000


def test_toxicity_on_held_out_texts(spark):
    bad = ["scoundrel", "rascal", "villain", "fiend"]
    rows, marks = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [RNG.choice(WORDS) for _ in range(60)]
        for _ in range(4 if toxic else 0):
            words[RNG.randrange(60)] = RNG.choice(bad) + RNG.choice(["", ".", ","])
        rows.append((i, " ".join(words), "s", 1.0))
        marks.append((i, int(toxic)))
    rows += [(None, "x", "s", 1.0), (1000, None, "s", 1.0), (1001, "", "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (1, 0), (1, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels))
    assert got.columns == ["doc_id", "source", "weight", "score"]
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    out = [i for i, _ in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((score[i] >= toxicity.THRESHOLD) == bool(dict(marks)[i]) for i in out)
    assert right / len(out) > 0.97 and all(0 <= s <= 1 for s in score.values())
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.score(docs, None).collect()} == {0.0}


def test_toxicity_training_by_brute_force():
    """The same steps text by text, over dictionaries."""
    rng = random.Random(8)
    draw = lambda words: np.array(sorted({rng.choice(words) for _ in range(6)}), np.int32)
    positive, unlabelled = [draw(range(0, 20)) for _ in range(60)], [draw(range(10, 60)) for _ in range(90)]
    prior = 0.2
    got = toxicity.train(toxicity._Rows(positive), toxicity._Rows(unlabelled), prior)

    counts = [[sum(f in t for t in side) for f in range(60)] for side in (positive, unlabelled)]

    def tells(f):
        p, u = counts[0][f], counts[1][f]
        share = (p + u) / 150
        return p + u >= toxicity.LEAST_TEXTS and abs(p / 60 - u / 90) >= toxicity.LEAST_Z * math.sqrt(max(1e-12, share * (1 - share)) * (1 / 60 + 1 / 90))

    keep = {f for f in range(60) if tells(f)}
    positive, unlabelled = ([[f for f in t.tolist() if f in keep] for t in side] for side in (positive, unlabelled))
    w, g2, bias, bias2 = dict.fromkeys(keep, 0.0), dict.fromkeys(keep, 1e-6), math.log(prior / (1 - prior)), 1e-6
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    dice = np.random.default_rng(toxicity.SEED)
    for _ in range(toxicity.EPOCHS):
        order = dice.permutation(len(unlabelled)).tolist()
        for at in range(0, len(order), toxicity.BATCH):
            us = [unlabelled[i] for i in order[at : at + toxicity.BATCH]]
            ps = [positive[i] for i in dice.integers(0, len(positive), min(toxicity.BATCH, len(positive))).tolist()]
            margin = lambda t: sum(w[f] for f in t) + bias
            zu, zp = [margin(t) for t in us], [margin(t) for t in ps]
            rest = sum(math.log1p(math.exp(z)) for z in zu) / len(us) - prior * sum(math.log1p(math.exp(z)) for z in zp) / len(ps)
            if rest >= 0:
                slopes = [(t, sigmoid(z) / len(us)) for t, z in zip(us, zu)] + [(t, prior * (-sigmoid(-z) - sigmoid(z)) / len(ps)) for t, z in zip(ps, zp)]
            else:
                slopes = [(t, -sigmoid(z) / len(us)) for t, z in zip(us, zu)] + [(t, prior * sigmoid(z) / len(ps)) for t, z in zip(ps, zp)]
            grad = {}
            for t, s in slopes:
                for f in t:
                    grad[f] = grad.get(f, 0.0) + s
            for f, g in grad.items():
                g += toxicity.DECAY * w[f]
                g2[f] += g * g
                w[f] -= toxicity.RATE * g / math.sqrt(g2[f])
            total = sum(s for _, s in slopes)
            bias2 += total**2
            bias -= toxicity.RATE * 0.1 * total / math.sqrt(bias2)
    assert keep and got[-1] == pytest.approx(bias, abs=1e-9)
    assert {f: got[f] for f in keep} == pytest.approx(w, abs=1e-9) and not np.delete(got[:-1], sorted(keep)).any()


def test_toxicity_of_odd_rows(spark):
    """An empty table, a very long text, repeated rows, a column called score; scores are sums of the words' weights."""
    docs = spark.createDataFrame([(i, "scum word" if i % 2 else "fine word", 7) for i in range(300)] + [(500, "scum " * 200_000 + "fine", 7), (501, None, 7), (1, "scum word", 7)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, toxic int")
    weights = toxicity.fit(docs, labels)
    got = toxicity.score(docs, weights)
    assert got.columns == ["doc_id", "score"]
    rows = got.collect()
    assert len(rows) == 303 and len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    score = {r["doc_id"]: r["score"] for r in rows}
    for i, text in ((1, "scum word"), (2, "fine word"), (500, "scum fine"), (501, "")):
        z = sum(float(weights[f]) for f in toxicity.text_features(text)) + float(weights[-1])
        assert score[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    assert toxicity.score(docs.limit(0), weights).count() == 0
    assert toxicity.fit(docs.limit(0), labels) is None or toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0
    assert toxicity.fit(docs, labels, most_positive=20, most_unlabelled=40) is not None


def test_held_out_labels_are_not_read(spark):
    docs = spark.createDataFrame([(i, "scum" if i % 2 else "fine") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.array_equal(toxicity.fit(docs, labels), toxicity.fit(docs, flipped))


def naive_repeats(words, k=8):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + k)}
    return len(covered)


def test_quality_counts(spark):
    texts = ["", None, "a b c", "x " * 30, "one two three four five six seven eight nine " * 3, "a\nb\n\na\n \na", "##$ %%% word word", "É" * 5 + "\x0b" + "z", " ".join(RNG.choice(WORDS[:3]) for _ in range(60)), " ".join(f"u{i}" for i in range(2000)) + " u1 u2 u3 u4 u5 u6 u7 u8"]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")
    got = {r["doc_id"]: r for r in quality_rules.features(df).collect()}
    import re

    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), naive_repeats(words))
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


@pytest.mark.parametrize(("n", "k", "p"), [(10, 0, 0.1), (10, 1, 0.2), (500, 4, 0.02), (100_000, 1800, 0.02), (5, 4, 0.5)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(quality_rules.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("t")).first()["t"]
    if k > n * p:
        assert got == 1
    else:
        log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)
        assert got == pytest.approx(sum(math.exp(log(i)) for i in range(k + 1)), rel=1e-6)


def test_cutoffs_spare_good_texts(spark):
    good = [(i, " ".join(RNG.choice(WORDS) for _ in range(40)), "en") for i in range(600)]
    bad = [(600 + i, " ".join(RNG.choice(WORDS) + "%%%" for _ in range(40)), "en") for i in range(100)]
    few = [(800 + i, " ".join(RNG.choice(WORDS) + "%%%" for _ in range(40)), "fr") for i in range(10)]
    docs = spark.createDataFrame([*good, *bad, *few, (None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([*[(i, 1) for i, *_ in good], *[(i, 0) for i, *_ in bad], *[(i, 0) for i, *_ in few], (None, 1), (2, None)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality_rules.judge(docs, labels).filter("kept").collect()}
    assert kept == {i for i, *_ in [*good, *few]}  # too few labels in a stratum certify nothing
    out = quality_rules.keep_good(docs, labels)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == kept
    assert quality_rules.judge(docs, labels.limit(0)).filter("kept").count() == 710


def simulated(spark, n_good, n_bad, reject):
    """Texts without words: their scores are 0.5 for the rules that reject(id, is_good) names, else 0."""
    rows = [(i, "s:en", False, *[0.5 if r in reject(i, i < n_good) else 0.0 for r in quality_rules.RULES]) for i in range(n_good + n_bad)]
    scored = spark.createDataFrame(rows, "doc_id long, stratum string, base_failed boolean, " + ", ".join(f"score_{r} double" for r in quality_rules.RULES))
    return scored, spark.createDataFrame([(i, int(i < n_good)) for i in range(n_good + n_bad)], "doc_id long, quality int")


def test_the_union_of_rules_is_certified(spark):
    """Each rule alone would reject 0.8 % of the good texts, all together 4 %: only as many are taken as spare 98 %."""
    names = quality_rules.RULES
    scored, labels = simulated(spark, 4000, 1000, lambda i, good: {names[i % 125]} if good and i % 125 < 5 else set() if good else set(names))
    taken = quality_rules.calibrate(scored, labels).collect()
    assert len(taken) == 1 and taken[0]["cutoff"] == 0.4
    # rules that reject the same good texts are taken together
    scored, labels = simulated(spark, 4000, 1000, lambda i, good: set() if good and i % 125 else set(names))
    assert {r["rule"] for r in quality_rules.calibrate(scored, labels).collect()} == set(names)
    # what only the proposing half knows is not believed
    hold = {r["id"] for r in spark.range(5000).filter(quality_rules.is_holdout(F.col("id"))).collect()}
    scored, labels = simulated(spark, 4000, 1000, lambda i, good: {"marks"} if not good or (i in hold and i % 10 == 0) else set())
    assert quality_rules.calibrate(scored, labels).count() == 0


def test_a_doc_id_counts_once(spark):
    """Many rows of few labelled documents certify nothing."""
    scored, labels = simulated(spark, 40, 40, lambda i, good: set() if good else {"marks"})
    many = scored.crossJoin(spark.range(100)).drop("id")
    assert quality_rules.calibrate(many, labels).count() == 0
    assert quality_rules.labelled(many, labels).count() == 80


def fill(sizes, weights):
    """Targets by resharing the excess until none is left."""
    total, target, open_ = 1.5 * sum(sizes.values()), dict.fromkeys(sizes, 0.0), set(sizes)
    left = total
    while open_:
        share = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if share * weights[s] >= 2 * sizes[s]}
        if not full:
            target |= {s: share * weights[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


@pytest.mark.parametrize("seed", range(4))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " w" * rng.choice([0, 1, 3, 10, 80, 400]), rng.choice(["a", "a", "a", "b", "Ç", None, "c", "tiny"][: 5 + seed]), "t") for i in range(400)] + [(None, None, "a", "t"), (7, "w w", "z", "t"), (7, "w w", "z", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, tie string").repartition(5)
    got = mixing.mixture_plan(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * 400
    again = mixing.mixture_plan(df.repartition(3)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["tie"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mixture_plan(df.limit(0)).count() == 0


def exact(vectors, query, k):
    scored = sorted((-float(np.dot(v, vectors[query])), i) for i, v in vectors.items() if i != query)
    return [i for _, i in scored[:k]]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = {i: (rng.normal(size=16) * rng.uniform(0.2, 3)).tolist() for i in range(600)}
    for i in range(100, 160):
        vectors[i] = vectors[100]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8), (1004, [1.0] * 3), (None, [1.0] * 16), (5, vectors[5]), (1006, []), (1007, [float("inf")] + [0.0] * 15)]
    df = spark.createDataFrame([*vectors.items(), *odd], "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    rows = ann.nearest(df, F.col("id") % 20 == 0, k=10, block=40).collect()
    by_query = {}
    for r in rows:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by_query) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for q, found in by_query.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(f[2] == pytest.approx(np.dot(vectors[q], vectors[f[1]]), abs=1e-12) for f in found)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hits += len({f[1] for f in found} & set(exact(vectors, q, 10)))
    assert hits / (10 * len(by_query)) >= 0.9
    few = ann.nearest(df.filter("vec_id < 8"), F.col("id") % 20 == 0, k=10).collect()
    assert [r["vec_id"] for r in sorted(few, key=lambda r: r["rank"])] == exact({i: vectors[i] for i in range(8)}, 0, 10)
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_lengths_are_searched_by_themselves(spark):
    """Two equally common lengths, a rare one with queries, one without queries, and a query that is alone."""
    rng = np.random.default_rng(4)
    long_, short = ({i: rng.normal(size=n).tolist() for i in range(at, at + 300)} for n, at in ((16, 0), (8, 300)))
    rare = {1000: [1.0, 2.0, 3.0], 1001: [3.0, 1.0, 0.5], 1003: [0.1, 0.1, 0.1]}
    df = spark.createDataFrame([*long_.items(), *short.items(), *rare.items(), (1007, [1.0] * 5), (2000, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df, F.col("id") % 20 == 0, k=10, block=40).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in (*long_, *short, *rare) if i % 20 == 0}
    assert [(i, round(s, 9)) for _, i, s in found[1000]] == [(1001, 6.5), (1003, 0.6)]
    for vectors in (long_, short):
        own = {q: x for q, x in found.items() if q in vectors}
        assert all([f[0] for f in x] == list(range(1, 11)) and all(f[1] in vectors for f in x) for x in own.values())
        assert sum(f[1] in exact(vectors, q, 10) for q, x in own.items() for f in x) >= 0.9 * 10 * len(own)


def test_mixing_a_very_long_text(spark):
    df = spark.createDataFrame([(1, "w " * 400_000, "a"), (2, "x y", "a"), (3, "z", "b")], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["size"], r["copies"]) for r in mixing.mixture_plan(df).collect()}
    assert got[1][0] == 400_000 and all(c <= 2 for _, c in got.values())


@pytest.mark.parametrize("parameters", [None, (1, 3, 1.0, 5), (3, 10, 2.0, 200)])
def test_recall_through_the_query(spark, data, parameters):
    """The registered query's operator on the smallest table of vectors, by what it chooses and by given parameters."""
    df = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = ann.nearest(df, F.col("id") % 20 == 0, k=20, parameters=parameters, block=100, shard_rows=200).collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    wanted = {q: set(exact(vectors, q, 20)) for q in vectors if q % 20 == 0}
    assert len(rows) == 20 * len(wanted)
    recall = sum(r["vec_id"] in wanted[r["query_id"]] for r in rows) / len(rows)
    assert recall >= (0.9 if parameters is None else 0.1)


def test_more_rows_make_more_functions_worth_it():
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(3000, 32))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    queries, rest = rows[:20], rows[20:]
    near = [rest[np.argsort(-(rest @ q))[:10]] for q in queries]
    small = ann.choose(queries, near, rest[:1000], 1.0, len(rows))
    large = ann.choose(queries, near, rest[:1000], 1.0, 10**9)
    assert large[1] >= small[1] and large[3] >= small[3]


def test_probe_order():
    rng = np.random.default_rng(1)
    within = rng.uniform(size=4)
    got = ann.perturbations(within, 81)
    cost = lambda s: sum(w**2 if d < 0 else (1 - w) ** 2 for w, d in zip(within, s) if d)
    costs = [cost(s) for s in got]
    assert len({tuple(s) for s in got}) == 81 and costs == sorted(costs) and costs[0] == 0




def test_steps_of_scores_keep_no_store_of_words_and_run_along_tokens():
    """Words without a token get it from a checksum, however many there are; a window is made without a Python step for each token; and
    embeddings' slopes are those of a plain sum, for a place that recurs too."""
    known = [f"k{i}".encode() for i in range(9)]
    ids, said = lm_score.Ids(known), [f"x{i}".encode() for i in range(1000)] + known
    want = [lm_score.SHARED + zlib.crc32(w) % lm_score.UNKNOWN for w in said[:1000]] + list(range(9))
    assert ids.of(said) == want and len(ids) == 9
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, lm_score.TOKENS, n).tolist() for n in (0, 5, 1, 0, 700, 2, 0)]
    target, around, owner = lm_score._windows(docs)
    gap = [lm_score.TOKENS] * lm_score.SIDE
    lines = [[*gap, *d, *gap] for d in docs]
    assert around.tolist() == [[*x[i : i + 2], *x[i + 3 : i + 5]] for x in lines for i in range(len(x) - 4)]
    assert target.tolist() == sum(docs, []) and owner.tolist() == [k for k, d in enumerate(docs) for _ in d]
    assert all(len(x) == 0 for x in lm_score._windows([[], []]))
    net = lm_score.Network.fresh([5, 4, 3])
    order = np.argsort(target // lm_score.CLASSES, kind="stable")
    one, grad = net.forward(around[order], target[order], slopes=True)
    first = net.forward(around[order][:1], target[order][:1], slopes=False)[0]
    assert one.dtype == np.float32 and first[0] == pytest.approx(one[0], abs=1e-5)
    assert grad["embedding"][:, lm_score.TOKENS].any() and grad["embedding"].dtype == np.float32
