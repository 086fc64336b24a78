"""Personal data, collocations and importance resampling against plain Python, and on odd rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tally.llm import collocations, pii, radix, resampling

SCHEMA = "doc_id long, text string, lang string, source string, n string, phrase string, votes string, part string, pos string"


def rows_of(texts, langs=None):
    return [(i, t, (langs or ["en"] * len(texts))[i], None, "x", "y", "z", "p", "q") for i, t in enumerate(texts)]


# personal data


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c)
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]
    return out


ODD = ["", "a@b.cd_x@e.f@g.h", "1.2.3.4.5.6.7.8", "+1.2.3.4 1111-1111 1111 1111", "4111 1111 1111 1111 4111111111111111-", "0" * 300 + "@x", "@" * 50, "9" * 500, "a." * 200 + "@", "+1" + " " * 300, "1 " * 300, "x@y.z " * 700,
       "+12 345 678 90\n1", "é1.2.3.4€ x@é.com x@a.b\U0001f600 4111111111111111", "256.1.1.1 0.0.0.0 000255.01.1.1", "1.1.1.1 4111-1111-1111-1111 +1 (743) 555-3824 (", "call (743) 555-3824 " * 300]


def mixed_texts():
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 8))) for _ in range(200)]
    card = next(x for x in (f"411111111111{i:04}" for i in range(10_000)) if luhn(x))
    texts = []
    for i in range(300):
        w = [r.choice(words) for _ in range(30)]
        new = [
            ["call", "me", f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}."],
            ["email", f"{r.choice(words)}.{r.choice(words)} [at] {r.choice(words)} [dot] com"],
            ["visa", "card", ".".join(re.findall("....", card)), "and", "me@x.com"],
            ["in 1999 2004 or", "12.345.678", "times 10:30:22", "std::move", "4111111111111112"],
            ["host", f"2001:db8:{r.randint(0, 65535):x}::{r.randint(0, 65535):x}"],
        ][i % 5]
        w[5:5] = new
        texts.append(" ".join(w))
    return texts


def test_personal_data(spark):
    texts = mixed_texts()
    rows = rows_of(texts) + [(1000 + i, t, None, None, "x", "y", "z", "p", "q") for i, t in enumerate(ODD)] + [(None, None, None, None, None, None, None, None, None)] * 2
    found = pii.find(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(found) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    added = {i: Counter() for i in range(5)}
    for r in found:
        assert [tuple(b) for b in r["base"]] == base_spans(text[r["doc_id"]]), r["doc_id"]
        for a in r["added"]:
            assert not any(b["start"] < a["end"] and a["start"] < b["end"] for b in r["base"])
            if r["doc_id"] is not None and r["doc_id"] < 1000:
                added[r["doc_id"] % 5][a["kind"]] += 1
    assert added == {0: {"tel": 60}, 1: {"mail": 60}, 2: {"account": 60}, 3: {}, 4: {"ipv6": 60}}


def test_personal_data_report(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = pii.report(pii.find(docs)).collect()
    assert len(found) == len(text)
    for r in found:
        want = base_spans(text[r["doc_id"]])
        assert r["spans"].split(",")[: len(want)] == [f"{k}:{a}:{b}" for k, a, b in want] or not want
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
    none = pii.report(pii.find(docs.limit(0)))
    assert none.count() == 0 and none.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def plain_estimate(patterns):
    """Expectation-maximisation over [(votes, n)], as the module's docstring says it."""
    q = [(sum(v > 0 for v in votes) + 1) / (sum(v != 0 for v in votes) + 2) for votes, _ in patterns]
    for _ in range(pii.ROUNDS):
        true, false = sum(n * x for (_, n), x in zip(patterns, q)), sum(n * (1 - x) for (_, n), x in zip(patterns, q))
        log = {}
        for j in range(len(pii.LABELERS)):
            for v in (-1, 0, 1):
                a = sum(n * x for (votes, n), x in zip(patterns, q) if votes[j] == v)
                b = sum(n * (1 - x) for (votes, n), x in zip(patterns, q) if votes[j] == v)
                log[j, v] = np.log((a + 1) / (true + 3)) - np.log((b + 1) / (false + 3))
        start = np.log((true + 1) / (false + 1))
        q = [1 / (1 + np.exp(-start - sum(log[j, v] for j, v in enumerate(votes)))) for votes, _ in patterns]
    return q


def test_labelers_are_weighed(spark):
    r = random.Random(1)
    good = [0.9, 0.85, 0.8, 0.7, 0.5, 0.75]
    rows, truth = [], []
    for _ in range(3000):
        y = r.random() < 0.4
        votes = [0 if r.random() < 0.2 else (1 if (r.random() < g) == y else -1) for g in good]
        rows.append(votes)
        truth.append(y)
    found = spark.createDataFrame([([("tel", v)],) for v in rows], "candidates array<struct<kind:string,votes:array<int>>>")
    got = pii.estimate(found).collect()
    patterns = sorted(Counter(map(tuple, rows)).items())
    want = dict(zip([p for p, _ in patterns], plain_estimate(patterns)))
    assert {tuple(x["votes"]): x["n"] for x in got} == dict(patterns)
    for x in got:
        assert x["chance"] == pytest.approx(want[tuple(x["votes"])], abs=1e-9)
    odds = got[0]["odds"]
    assert odds[2] - odds[0] > odds[11] - odds[9] > abs(odds[14] - odds[12])  # labeler 0 is better than 3, and 4 says nothing
    assert np.mean([(want[tuple(v)] > 0.5) == y for v, y in zip(rows, truth)]) > 0.9


# collocations


def plain_collocations(docs, support, top):
    counts = {}
    for text, lang in docs:
        c = counts.setdefault(lang or "und", Counter())
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        n = sum(v for k, v in c.items() if len(k) == 1)
        cand = {k: v for k, v in c.items() if len(k) > 1 and v >= support}
        kept = [k for k, a in cand.items() if not any(len(x) > len(k) and 100 * b >= 50 * a and k in (x[:2], x[1:]) for x, b in cand.items())]
        scored = []
        for k in kept:
            a = cand[k]
            score, cut = min((1_000_000 * a * a // (c[k[:i]] * c[k[i:]]), i) for i in range(1, len(k)))
            scored.append((-score, -a, " ".join(k).encode(), c[k[:cut]], c[k[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, le, ri, n, -s) for i, (s, a, p, le, ri) in enumerate(sorted(scored)[:top])]
    return sorted(out)


@pytest.mark.parametrize("shards,most_bits", [(1, 1 << 29), (3, 1 << 29), (4, 1 << 22), (12, 1 << 29)])
def test_collocations(spark, monkeypatch, shards, most_bits):
    """However many shards there are, and with many chunks and a filter of one block."""
    monkeypatch.setattr(collocations, "CHUNK", 50)
    monkeypatch.setattr(collocations, "MOST_BITS", most_bits)
    r = random.Random(shards)
    words = ["New", "york", "city", "é", "ÉT", "a\x00b", "x\x1fy", "the", "of", " "]
    texts, langs = [None, "", " \t ", "one"], ["en", None, "und", "fr"]
    for _ in range(150):
        texts.append("".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", ",", "?"]) for _ in range(r.randint(0, 30))))
        langs.append(r.choice(["en", "en", "en", "fr", None, "und"]))
    texts += ["New York city hall " * 40] * 2
    langs += ["de", "de"]
    df = spark.createDataFrame(rows_of(texts, langs), SCHEMA).repartition(3)
    counts = collocations.phrase_counts(df, 10, shards)
    assert counts.filter("words > 1 and n < 10").count() == 0
    got = collocations.collocations(df, support=10, top=25, shards=shards)
    assert sorted(map(tuple, got.collect())) == plain_collocations(list(zip(texts, langs)), 10, 25)
    assert collocations.collocations(df.limit(0)).count() == 0 and collocations.collocations(df.filter("text = ''")).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    n = 3_000_000_019
    made = [("en", 0, "", 9 * n), ("en", 1, "a", n), ("en", 1, "b", n + 7), ("en", 2, "a b", n - 5)]
    monkeypatch.setattr(collocations, "phrase_counts", lambda docs, support, shards: spark.createDataFrame(made, "lang string, words byte, phrase string, n long"))
    row = collocations.collocations(spark.range(0)).first()
    assert row["score"] == 1_000_000 * (n - 5) ** 2 // (n * (n + 7)) and (row["l"], row["r"], row["n"]) == (n, n + 7, 9 * n)


# resampling


def test_checksums_from_parts():
    r = random.Random(2)
    texts = [[bytes(r.choice(b"abcxyz\xc3\xa9") for _ in range(r.choice([1, 2, 7, 70, 200]))) for _ in range(r.choice([0, 1, 2, 9]))] for _ in range(80)]
    singles, pairs, sizes = resampling.bucket_arrays(texts)
    assert singles.tolist() == [zlib.crc32(w) % 10_000 for t in texts for w in t]
    assert pairs.tolist() == [zlib.crc32(a + b" " + b) % 10_000 for t in texts for a, b in zip(t, t[1:])]
    assert sizes.tolist() == list(map(len, texts))
    assert resampling.bucket_arrays([])[0].tolist() == []


def test_radix_sort(spark):
    r = random.Random(4)
    keys = [(r.choice([None, 5, -(1 << 62), 1 << 40, -3]), r.choice([None, -7, 0, 3, 4096, 70_000]), i) for i in range(900)]
    for part in (keys, keys[:1], [], [(7, 7, i) for i in range(500)]):
        df = spark.createDataFrame(part, "a long, b long, i long").repartition(3)
        got = radix.radix_sort(df, [("a", True), ("b", False)]).orderBy("pos").collect()
        assert [x["pos"] for x in got] == list(range(len(part)))
        order = lambda x: (x[0] is None, -(x[0] or 0), x[1] is None, x[1] or 0)
        assert [order(x) for x in got] == sorted(map(order, part)) and sorted(x["i"] for x in got) == sorted(x[2] for x in part)


def test_resampling_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "CHUNK", 40)
    long = " ".join(f"w{i % 7} É{i % 5}" for i in range(3000))
    texts = [None, "", "one two", "A-b_c 9 é " * 10, long, long] + [" ".join(random.Random(i).choices(["the", "cat", "sat", "mat", "On"], k=25)) for i in range(40)]
    rows = rows_of(texts) + [(None, texts[-1], None, None, None, None, None, None, None), (7, texts[7], None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for target in ([("the cat sat on the mat",), (None,)], []):
        got = resampling.resample(docs, spark.createDataFrame(target, "text string")).collect()
        assert len(got) == len(rows)
        words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or ""))
        features = lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        bucket = lambda f: zlib.crc32(f.encode()) % 10_000
        s, t = (Counter(bucket(f) for x in side for f in features(words(x))) for side in ([r[1] for r in rows], [x[0] for x in target]))
        gain = resampling.gains(np.array([s[i] for i in range(10_000)]), np.array([t[i] for i in range(10_000)]))
        want = []
        for r in rows:
            f = features(words(r[1]))
            weight = sum(int(gain[bucket(x)]) for x in f) // len(f) if f else 0
            want.append((r[0], len(f), weight, weight + resampling.noise(r[0]), len(words(r[1]))))
        known = lambda x: (x[0] is None, x[0] or 0, *x[1:4])
        assert sorted(map(known, got)) == sorted(map(known, want))
        drawn = sorted((x for x in want if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
        ranked = sorted((x for x in got if x["rank"]), key=lambda x: x["rank"])
        assert [x["rank"] for x in ranked] == list(range(1, len(drawn) // 4 + 1))
        assert [(x["doc_id"], x["score"]) for x in ranked] == [(x[0], x[3]) for x in drawn[: len(drawn) // 4]]
    assert resampling.resample(docs.limit(0), docs.limit(0)).count() == 0
