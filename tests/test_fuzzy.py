"""Ratios against their plain definition, and the join that loses no pair."""

import random

import pytest

from tally.functions import fuzzy
from tally.operators import fuzzy_join


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def strings(r, alphabet, sizes, n):
    return ["".join(r.choice(alphabet) for _ in range(r.choice(sizes))) for _ in range(n)]


def test_ratios():
    r = random.Random(1)
    a, b = strings(r, "abcdé ", [0, 1, 2, 5, 9, 20, 63, 64, 65, 70], 800), strings(r, "abcdéxyz ", [0, 1, 2, 5, 9, 20, 64, 66, 100], 800)
    for x, y in zip(a[:300], b[:300]):
        assert fuzzy.common_of(x, y) == common(x, y)
    for x, y, got in zip(a, b, fuzzy.partial_ratios(a, b)):
        short, long = sorted((x, y), key=len)
        assert got == pytest.approx(fuzzy.partial_ratio_of(x, y))
        if len(short) < len(long) and short:
            windows = [long[max(0, s) : s + len(short)] for s in range(1 - len(short), len(long))]
            assert got == pytest.approx(max(200 * common(short, w) / (len(short) + len(w)) for w in windows))
    assert fuzzy.token_set_ratio_of("colla Vella de Valls", "valls vella") == 100 and fuzzy.token_set_ratio_of("", "x") == 0
    assert fuzzy.token_set_ratio_of("new york mets", "new york yankees") == pytest.approx(100 * (1 - 9 / 29) if 100 * (1 - 9 / 29) > 100 * 16 / 21 else 100 * 16 / 21)


def test_needed_grams_are_there():
    """No string shares fewer grams with a window than the bound says."""
    r = random.Random(2)
    grams = lambda s: {(s[i : i + 2], s[:i].count(s[i : i + 2])) for i in range(len(s) - 1)}
    for least in (70, 75, 85, 95):
        for _ in range(3000):
            s = "".join(r.choice("ab") if r.random() < 0.3 else chr(99 + i) for i in range(r.randint(1, 14)))
            w = "".join(c if r.random() < 0.85 else r.choice("abz") for c in s if r.random() < 0.9)[: len(s)]
            if w and fuzzy.ratio_of(s, w) >= least:
                shared = sum(min(s.count(g), w.count(g)) if g[0] != g[1] else sum(a == g for a in {g}) * min(sum(s[i : i + 2] == g for i in range(len(s) - 1)), sum(w[i : i + 2] == g for i in range(len(w) - 1))) for g in {x for x, _ in grams(s)})
                assert shared >= fuzzy.least_grams(len(s), least, 2)


@pytest.mark.parametrize("least", [30, 50, 75, 85])
def test_join_equals_brute_force(spark, least):
    r = random.Random(least)
    parts = ["colla", "vella", "de", "valls", "nens", "del", "vendrell", "jove", "x", "Sants", "é", "xiquets", "tarragona"]
    names = sorted({" ".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(90)} | set(strings(r, "abcdexyz", [1, 2, 3, 6], 20)) | {"A" * 120, "Ab", "aB"})
    noisy = lambda s: "".join(c if r.random() < 0.9 else r.choice("aeiou ") for c in s)
    texts = sorted({noisy("qui va guanyar " + r.choice(names) + " l'any passat").lower() for _ in range(40)} | {n.lower()[:3] for n in names[:10]} | {"a" * 300, "z"})
    got = fuzzy_join.best_names(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "asked string").repartition(3), spark.createDataFrame([(n,) for n in [*names, None, ""]], "name string"), least, 4)
    want = set()
    for t in texts:
        scored = sorted((-fuzzy.partial_ratio_of(n.lower(), t), n) for n in names)
        want |= {(t, n, round(-s, 9), i + 1) for i, (s, n) in enumerate(scored[:4]) if -s >= least}
    assert {(x["asked"], x["name"], round(x["score"], 9), x["rank"]) for x in got.collect()} == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_large_dictionary(spark):
    """100,000 names: few of all pairs are compared, and the best are those of comparing all."""
    r = random.Random(9)
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    names = sorted({"".join(r.choices(syllables, k=r.randint(5, 9))) for _ in range(101_000)})[:100_000]
    texts = sorted({"quina va ser la millor de " + (x := r.choice(names))[:4] + x[5:] + " en tot l'any" for _ in range(2)})
    n, t = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in texts], "asked string")
    pairs = fuzzy_join._indexed(t, n.selectExpr("name", "name AS low"), 85).count()
    assert pairs < 0.1 * len(names) * len(texts)
    got = {(x["asked"], x["name"], round(x["score"], 9)) for x in fuzzy_join.best_names(t, n, 85, 5).collect()}
    want = set()
    for x in texts:
        scores = fuzzy.partial_ratios(names, [x] * len(names))
        best = sorted((-scores[i], names[i]) for i in (scores >= 85).nonzero()[0])[:5]
        want |= {(x, name, round(-s, 9)) for s, name in best}
    assert got == want and len({x for x, _, _ in want}) == len(texts)


def test_index_rows_hold_no_texts(spark):
    """A text is cut into rows that do not repeat it, and only texts that are shorter than some name are looked up among names."""
    texts = ["x" * 30_000 + "colla vella" + "y" * 30_000, "cola vella", "colla vella dels xiquets", "vella"]
    t, n = spark.createDataFrame([(x,) for x in texts], "asked string"), spark.createDataFrame([("Colla Vella",), ("Colla Jove",)], "name string")
    grams = fuzzy_join._grams(t.selectExpr("asked", "xxhash64(asked) AS key"), "asked", 85)
    assert grams.columns == ["key", "size", "need", "gram"] and grams.count() == sum(len(x) - 1 for x in texts)
    got = {(x["asked"], x["name"], round(x["score"], 6)) for x in fuzzy_join.best_names(t, n, 85, 5).collect()}
    assert got == {(x, name, round(s, 6)) for x in texts for name in ("Colla Vella", "Colla Jove") if (s := fuzzy.partial_ratio_of(x[29_980:30_031] if len(x) > 99 else x, name.lower())) >= 85}
