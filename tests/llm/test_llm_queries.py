"""The registered queries on the smallest tables: against SQL where there is one, else their form."""

import base64
import gzip
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from compare import connection, rows
from test_dedup import brute, brute_first, near_groups

import corpus_pipeline
from tally.llm import bpe, mixing, quality_rules, queries, warc

SQL, QUERIES = queries.oracle_sql(), queries.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(name, spark, data):
    assert rows(QUERIES[name](spark, data)) == rows(connection(data).execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_one_row_for_each_document(name, spark, data):
    found = QUERIES[name](spark, data)
    if name.startswith("op10"):
        assert found.count() == 25 * 20
    else:
        assert found.count() == spark.read.parquet(f"{data}/documents.parquet").count()


def test_op1_cuts_from_400_bytes_on(spark, tmp_path):
    """Passages of over 50 words that two documents share go if they have the contract's 400 bytes, and stay below."""
    rows = []
    for k, size in enumerate((394, 399, 400, 401)):
        passage = " ".join(f"{chr(97 + k)}{i:04d}" for i in range(80))[:size]
        assert len(passage.encode()) == size and len(passage.split()) > 50
        rows += [(2 * k, f"before {k} <{passage}> after {k}"), (2 * k + 1, f"first {k} [{passage}] last {k}")]
    rows += [(8, None), (9, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = [(t or "").encode() for _, t in rows]
    want = {i: (len(t), gone, spans, hashlib.sha256(left).hexdigest()) for (i, _), t, (gone, spans, left) in zip(rows, texts, brute(texts, 400))}
    assert [want[i][1] for i in range(10)] == [0, 0, 0, 0, 400, 400, 401, 401, 0, 0]
    assert {r[0]: tuple(r[1:5]) for r in QUERIES["op1_suffix_dedup"](spark, str(tmp_path)).collect()} == want


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns, name
        if not name.startswith("mixing"):
            assert 0 < docs.count() <= n, name
            n = docs.count()
    out = corpus_pipeline.run(spark, data)
    want = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == want
    assert out.filter(bpe.n_tokens() != out["n_tokens"]).count() == 0


def test_pipeline_stages_by_brute_force(spark, data):
    """Each stage on what the one before it kept."""
    stage = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good = stage[0](spark, docs, data)
    kept = {r["doc_id"] for r in quality_rules.judge(docs, labels).filter("kept").collect()}
    assert sorted(r["doc_id"] for r in good.collect()) == sorted(kept)

    once = stage[1](spark, good, data)
    before = sorted((r["doc_id"], r["text"]) for r in good.collect())
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(set(near_groups(before)))

    cut = stage[2](spark, once, data)
    before = sorted((r["doc_id"], r["text"]) for r in once.collect())
    want = brute_first([(i, t.encode()) for i, t in before], corpus_pipeline.PASSAGE_BYTES)
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {i: w.decode(errors="ignore") for i, w in want.items()}
    assert sum(len(w) for w in want.values()) < sum(len(t.encode()) for _, t in before)

    mixed = stage[3](spark, cut, data)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixture_plan(cut).collect() if r["copies"]}
    assert Counter(r["doc_id"] for r in mixed.collect()) == copies

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = stage[4](spark, mixed, data).collect()
    text = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert len(tokens) == sum(copies.values())
    assert all(np.frombuffer(r["token_ids"], "<u4").tolist() == library.encode_ordinary(text[r["doc_id"]]) and r["text"] == text[r["doc_id"]] for r in tokens)


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, an empty table, columns with clashing names."""
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "en", "a", 5, "r", "k"), (2, None, None, None, None, None, None), (None, words + " more", None, "a", None, "r", "k"), (4, "", "en", None, 0, "x", "y"), (5, " ".join(f"other{i}" for i in range(30)), None, None, None, None, "z"), (5, " ".join(f"other{i}" for i in range(30)), None, None, None, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` string, `key` string")
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for some, want in ((docs, {1, 5}), (docs.limit(0), set())):
        now = some
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == docs.columns, name
        out = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path))
        assert out.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids", "text"]
        assert {r["doc_id"] for r in out.collect()} <= want and {r["doc_id"] for r in now.collect()} <= want


def test_warc_files_read_back(spark, tmp_path):
    html = '<html lang="ca"><head><title>A &amp; B</title></head><body><!-- no --><p>One <b>two</b></p><script>x()</script><a href="/l?a=1&amp;b">go</a></body></html>'
    pages = spark.createDataFrame([(1, "http://x.y/", html, "c"), (2, None, None, "c"), (2, None, None, "c"), (3, "http://z/", "", "c")], "page_id long, url string, html string, header string")
    records = warc.derivatives(warc.responses(pages, "2024-05-01T00:00:00Z"))
    assert records.count() == 8
    first = {r["warc_type"]: r for r in records.filter("target_uri = 'http://x.y/'").collect()}
    assert first["conversion"]["block"] == "One two\ngo"
    assert "title: A & B\r\nlanguage: ca\r\n" in first["metadata"]["block"] and "outlink: /l?a=1&b\r\n" in first["metadata"]["block"]
    assert first["metadata"]["refers_to"] == first["conversion"]["refers_to"] and first["metadata"]["concurrent_to"] == first["conversion"]["record_id"]
    assert "source-http-header: Content-Type: text/html; charset=utf-8" in first["metadata"]["block"]
    warc.write(records, f"{tmp_path}/w")
    back = warc.read(spark, f"{tmp_path}/w").collect()
    assert len(back) == 8 and all(r["whole"] for r in back)
    assert sorted(r["headers"]["warc-record-id"] for r in back) == sorted(r["record_id"] for r in records.collect())
    assert sorted(r["block"] for r in back) == sorted(r["block"] for r in records.collect())
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_records_stand_alone(spark, tmp_path):
    """Blocks that hold what looks like a record, very long pages, malformed tags; each record is read by itself."""
    html = ["<p>WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n", "<div>" + "long text " * 200_000, "a <b c < d > e <", "<p", "é&amp;&#233;"]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(3)
    records = warc.derivatives(warc.responses(pages))
    rows = {r["record_id"]: r for r in records.collect()}
    long = next(r["block"] for r in rows.values() if r["warc_type"] == "conversion" and r["target_uri"] == "http://x/1")
    assert long == ("long text " * 200_000).strip()
    index = warc.write(records, f"file://{tmp_path}/w").collect()
    back = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert all(r["whole"] for r in back) and sorted(r["block"] for r in back) == sorted(r["block"] for r in rows.values())
    assert {r["record_id"] for r in index} == set(rows) and len(index) == len(rows)
    for r in index:
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            text = gzip.decompress(f.read(r["length"])).decode()
        assert text == rows[r["record_id"]]["header"] + "\r\n" + rows[r["record_id"]]["block"] + "\r\n\r\n"
    (tmp_path / "w" / "broken.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")
    assert sum(not r["whole"] for r in warc.read(spark, f"file://{tmp_path}/w").collect()) == 1
