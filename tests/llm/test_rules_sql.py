"""Quality rules against their SQL on tables in which rules are certified, and some fail."""

import random

import duckdb
from compare import rows

from tally.llm import quality_rules, queries


def made(r, lang, i):
    """A text and its quality: bad ones have symbols, marks, capitals or repeated lines, and a few good ones look like it."""
    words = [f"{lang}{r.randint(0, 400)}w" for _ in range(r.randint(25, 60))]
    good = i % 3 > 0
    if lang == "xx":  # here the rules cannot tell
        return " ".join(w + "##" if r.random() < 0.3 else w for w in words), int(good)
    kind = i % 7
    bad = not good and r.random() < 0.9
    if bad and kind < 2:
        words = [w + "###" for w in words]
    elif bad and kind < 4:
        words = [w + "!?" for w in words]
    elif bad and kind < 5:
        words = [w.upper() for w in words]
    elif bad:
        return "\n".join([" ".join(words[:5])] * 3 + [" ".join(words)]), 0
    return " ".join(words), int(good)


def test_certified_rules_equal_sql(spark, tmp_path):
    r = random.Random(8)
    texts, labels = [], []
    for n, lang in ((2400, "aa"), (1500, "bb"), (900, "xx"), (30, None)):
        for i in range(n):
            text, quality = made(r, lang or "cc", i)
            doc_id = len(texts)
            texts.append((doc_id, text, lang, "s", len(text)))
            if r.random() < 0.95:
                labels.append((doc_id, quality, 0))
    texts += [(len(texts) + i, t, "aa", "s", 0) for i, t in enumerate(["### " * 30, "short", "", None])]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")

    scored = quality_rules.features(docs)
    proposed = quality_rules.proposals(quality_rules.labelled(scored, marks)).collect()
    certified = {(c["stratum"], c["rule"]) for c in quality_rules.calibrate(scored, marks).collect()}
    assert {s for s, _ in certified} >= {"s:aa", "s:bb"} and len(certified) >= 4
    assert {(p["stratum"], p["rule"]) for p in proposed} >= certified

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = rows(queries.QUERIES["op3_quality_rules"](spark, str(tmp_path)))
    assert got == rows(con.execute(queries.OP3_SQL))
    by_method = queries.QUERIES["op3_quality_rules"](spark, str(tmp_path)).filter("NOT base_failed AND NOT kept").count()
    assert by_method > 500
