"""Near copies and repeated passages against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tally.llm import simhash, suffix_array, suffix_dedup
from tally.llm.components import components

RNG = random.Random(11)


def sentence(n):
    return " ".join(RNG.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(RNG.randrange(40)) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize(("memory", "base", "batch"), [(1 << 26, 1 << 23, 1 << 16), (100, 4, 3), (0, 0, 1)])
def test_suffix_array(seed, memory, base, batch, monkeypatch):
    monkeypatch.setattr(suffix_array, "BATCH", batch)
    rng = np.random.default_rng(seed)
    for _ in range(20):
        t = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(1, 90)))
        t = np.r_[t, t[: len(t) // 2], np.full(int(rng.integers(0, 12)), 1), t, 0].astype(np.uint16)
        limit = int(rng.choice([1, 4, 9, 500]))
        pos, lcp = suffix_array.suffix_array(t, limit, memory, base)
        heads = [tuple(t[i : i + limit]) for i in pos]
        assert sorted(pos.tolist()) == list(range(len(t))) and heads == sorted(heads)
        for a, b, n in zip(heads, heads[1:], lcp[1:]):
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert n == min(same, limit)


def brute(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((sum(gone), len([s for s in bytes(gone).split(b"\0") if s]), bytes(c for c, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_repeated_passages(spark, hot):
    passage, other = sentence(40), sentence(25)
    texts = [sentence(30) + passage + sentence(20) for _ in range(12)] + [sentence(60) for _ in range(5)] + [other * 3, "é" + passage[1:200] + "ü", None, "", "short", "a" * 900, "ab" * 400, "a" * 300]
    texts += [texts[0], texts[0], sentence(400), "x" * 120 + "y"]
    rows = [(i if i != 3 else 4, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = suffix_dedup.remove_repeated(df, length=100, hot=hot, shard_bytes=4000).select("row.doc_id", "row.text", "row.runs", "n_bytes", "n_removed", F.size("spans").alias("n"), "kept").collect()
    want = brute([(t or "").encode() for t in texts], 100)
    assert Counter((r["doc_id"], r["text"], r["n_bytes"], r["n_removed"], r["n"], bytes(r["kept"])) for r in got) == Counter((i, t, len((t or "").encode()), *w) for (i, t, _), w in zip(rows, want))
    assert suffix_dedup.remove_repeated(df.limit(0), length=100).count() == 0


def brute_first(docs, length):
    """What is left of docs (doc_id, text) if each string stays where it stands first."""
    seen, out = set(), {}
    for doc_id, t in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if t[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(t[i : i + length])
        out[doc_id] = bytes(c for c, g in zip(t, gone) if not g)
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_first_copies_stay(spark, hot):
    passage, other = sentence(40), sentence(25)
    texts = [sentence(30) + passage + sentence(20) for _ in range(12)] + [other * 3, passage[50:220] + other[20:], None, "", "a" * 900, "ab" * 400, "a" * 300]
    docs = [(50 - i if i != 2 else None, t) for i, t in enumerate(texts)] + [(7, texts[0]), (90, texts[0]), (60, texts[12])]
    docs.append(docs[-1])  # a row that is there twice is one document
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeated(df, length=100, hot=hot, shard_bytes=4000, keep_first=True).select("row.doc_id", "kept").collect()
    want = brute_first({d: (t or "").encode() for d, t in docs}.items(), 100)
    assert len(got) == len(docs) and all(bytes(r["kept"]) == want[r["doc_id"]] for r in got)
    assert passage in {bytes(r["kept"]).decode().find(passage) >= 0 and passage for r in got}


def test_a_hot_anchor_is_cut_in_two(spark):
    """One line in front of texts that differ early, late or in the last byte."""
    line = sentence(14)[:90]
    texts = [sentence(3) + line + f"{k:09d}" + sentence(4) for k in range(80)] + [line + "same end here" + "xyz"[k % 3] * (k // 3) for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = brute([t.encode() for t in texts], 100)
    for hot in (1, 4, 1000):
        got = suffix_dedup.remove_repeated(df, length=100, hot=hot).select("row.doc_id", "n_removed", F.size("spans").alias("n"), "kept").collect()
        assert {r["doc_id"]: (r["n_removed"], r["n"], bytes(r["kept"])) for r in got} == dict(enumerate(want))


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    passage = sentence(30)
    texts = [sentence(300) + passage + sentence(100), sentence(10) + passage, sentence(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.remove_repeated(df, length=100).select("row.doc_id", "n_removed", "kept").collect()}
    assert got == {i: (w[0], w[2]) for i, w in enumerate(brute([t.encode() for t in texts], 100))}


def test_cleaned_documents_keep_their_columns(spark):
    passage = "é" * 90
    df = spark.createDataFrame([(1, "ab" + passage, "en", 92), (2, passage + "cd", "de", 92), (3, "alone", None, 5), (4, None, None, None)], "doc_id long, text string, lang string, n_chars long")
    out = suffix_dedup.without_repeated(df, length=100)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "ab", "en", 2), (2, "cd", "de", 2), (3, "alone", None, 5), (4, None, None, None)]


def slow_fingerprint(text, n_words):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    grams = [" ".join(words)] if 0 < len(words) < n_words else [" ".join(words[i : i + n_words]) for i in range(len(words) - n_words + 1)] if words else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


@pytest.mark.parametrize("text", ["", "  ", "One", "one Two", "É a b\x0bc d", "a b c d e f", "x y z " * 50])
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text, 3)


def linked(prints, radius):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(prints))]


@pytest.mark.parametrize(("radius", "block"), [(2, 8192), (2, 3), (10, 5)])
def test_links_lose_nothing(spark, radius, block):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {0, (1 << 64) - 1}
    for c in centres.tolist():
        for _ in range(12):
            x = c
            for b in rng.integers(0, 64, int(rng.integers(0, radius + 3))).tolist():
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = components(simhash.links(spark.createDataFrame(signed, "fp long"), radius, block)).collect()
    root = {r["node"]: r["root"] for r in found}
    got = [root.get(s[0], s[0]) for s in signed]
    want = linked(prints, radius)
    assert {tuple(i for i, g in enumerate(got) if g == v) for v in set(got)} == {tuple(i for i, w in enumerate(want) if w == v) for v in set(want)}


def test_near_duplicates_and_keep_one(spark):
    base = sentence(200)
    rows = [(9, base, "x"), (4, base, "y"), (6, base + " end", "z"), (2, sentence(150), "q"), (1, None, "n"), (3, "", "n"), (None, sentence(90), "id"), (5, base, "y"), (5, base, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df.select("doc_id", "text")).collect()}
    ids, texts = [r[0] for r in rows], [r[1] or "" for r in rows]
    group = linked([slow_fingerprint(t, 3) for t in texts], simhash.RADIUS)
    least = {g: min((i for i, h in zip(ids, group) if h == g and i is not None), default=None) for g in group}
    assert found == {(i, least[g]) for i, g in zip(ids, group)}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(kept.select("doc_id").collect(), key=str) == sorted([(4,), (2,), (1,), (None,)], key=str)
    assert simhash.keep_one(df.limit(0)).count() == 0


def near_groups(rows):
    """The least id of each document's group of near copies, by comparing all pairs of sets of shingles."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = [i for i, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (both * 10 >= 8 * (len(sets[a]) + len(sets[b]) - both)) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def altered(words, n):
    """words with n of them changed, each far from the others."""
    out = list(words)
    for k in range(n):
        out[(2 * k + 1) * len(words) // (2 * n)] = f"new{k}"
    return out


@pytest.mark.parametrize("block", [1 << 19, 150])
def test_near_copies_by_brute_force(spark, block, monkeypatch):
    """Pairs about 0.8, short texts, and fingerprints that are alike without common shingles."""
    monkeypatch.setattr(simhash, "VERIFIED", block)
    rows = [(1000, None), (1001, ""), (1002, "a b"), (1003, "A b"), (1004, "a c")]
    for k in range(60):
        words = sentence(100 + k).split()
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(altered(words, 1 + k % 4))), (3 * k + 2, " ".join(altered(words, 2 + k % 4)))]
    # fingerprints of the first and the last text are within the radius, their shingles are not alike
    few = [" ".join(f"w{RNG.randrange(10**6)}" for _ in range(5)) for _ in range(3000)]
    prints = np.array([simhash.fingerprint(t.encode(), 5) for t in few], np.uint64)
    a, b = next((a, b) for a in range(len(few)) for b in range(a) if int(prints[a] ^ prints[b]).bit_count() <= 14)
    rows += [(2000, few[a]), (2001, few[b])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df, radius=14).collect()) == sorted(set(near_groups(rows)))


def test_near_copies_of_the_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted(set(near_groups(rows)))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (500, 500)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
