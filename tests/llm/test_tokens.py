"""Byte-level BPE and token files against the libraries."""

import base64
import hashlib
import random
import sys
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tally.llm import bpe, pieces, token_files

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
FILE = P.path("byte_bpe_50k.json")
ODD = ["", " ", "  a", "a  b", "a \n b", "\n\n x\t y ", "don't we'll 's", "<|endoftext|> a<|endoftext|>", "é è ñ", "日本語 テキスト", "a" * 3000, " " * 500 + "x", "ab" * 1500, "x y z", "1234567 89", "!!! ??? ...", "\x1c a\x1f b", "\u0000 nul", "🙂🙃 👨‍👩‍👧"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


@pytest.mark.parametrize("text", ODD)
def test_encodes_as_the_library(text, library):
    enc = bpe.encoder(RANKS, P.PATTERN)
    assert ids(enc.encode(text)) == library.encode_ordinary(text)
    assert bpe._decoded(enc.encode(text), bpe.token_bytes(RANKS)) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from(" \n\t'.aeé")), max_size=60))
def test_any_text(text):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)} if not hasattr(test_any_text, "lib") else None
    if ranks:
        test_any_text.lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = bpe.encoder(RANKS, P.PATTERN)
    assert ids(enc.encode(text)) == test_any_text.lib.encode_ordinary(text)


def test_white_space_is_the_same_everywhere():
    """Texts are cut at spaces only where no character beside them can be white space to the pattern."""
    wide = regex.compile(r"\s")
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if not 0xD800 <= code < 0xE000 and wide.match(c):
            assert c in " \n" or pieces._OTHER_SPACE.match(c), hex(code)


def test_recent_store_keeps_what_is_asked_for():
    made = []
    store = pieces.Recent(lambda k: made.append(k) or k.encode(), kept=3)
    for k in ["a", "b", "c", "a", "d", "a", "e", "a"]:
        assert store[k] == k.encode()
    assert made.count("a") == 1 and len(store) <= 3


@pytest.mark.parametrize("text", ODD)
def test_file_encoder_is_the_library(text):
    whole = Tokenizer.from_file(FILE).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(token_files.encoder(FILE).encode(text), "<u2").tolist() == whole


def test_token_files(spark, tmp_path):
    rng = random.Random(3)
    docs = [(i, rng.choice(ODD) + f" doc {i}") for i in range(300)] + [(None, "no id"), (7, None), (7, ""), (5, "x " * 40_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    folder, found = token_files.token_files(df, FILE, 2, f"file://{tmp_path}/tokens")
    tok = Tokenizer.from_file(FILE)
    want, start = [], 0
    for i, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        own = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    got = sorted(found.collect(), key=lambda r: r["start"])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    assert [r["start"] for r in got] == np.r_[0, np.cumsum([r["n_tokens"] for r in got])[:-1]].tolist()
    assert [r["doc_id"] for r in got][1:] == sorted(r["doc_id"] for r in got[1:])
    files = {p.suffix for p in (tmp_path / "tokens").iterdir()}
    assert files == {".ids", ".offsets", ".docs"}
    assert token_files.token_files(df.limit(0), FILE, 2, f"file://{tmp_path}/none")[1].count() == 0


def test_shards_by_size_and_clashing_columns(spark, tmp_path):
    docs = [(i, "word " * (i % 7), "x", 1, 2) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string, tie string, start int, n_tokens int").repartition(3)
    manifest = token_files.write_shards(df, FILE, 2, f"file://{tmp_path}/t", shard_bytes=100)
    assert manifest.count() > 4 and manifest.agg({"n_docs": "sum"}).first()[0] == 60
    found = {r["doc_id"]: r["n_tokens"] for r in token_files.read_shards(manifest, f"file://{tmp_path}/t").collect()}
    tok = Tokenizer.from_file(FILE)
    assert found == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t, *_ in docs}
    one = token_files._File(token_files.fs.SubTreeFileSystem(str(tmp_path), token_files.fs.LocalFileSystem()), "t/shard-00000.offsets", "<u8")
    assert one.mapped is None and one.range(0, 1).tolist() == [0] and one.range(1, one.n).tolist() == sorted(one.range(1, one.n).tolist())


def test_encode_long_and_clashing(spark, library):
    """Texts of a megabyte, with and without spaces, and columns that are called like the new ones."""
    long = ["x" * 300_000, "one two, three. " * 60_000, "ab\n" * 50_000]
    df = spark.createDataFrame([(i, t, 5, 6) for i, t in enumerate([*long, long[2]])], "doc_id long, text string, token_ids int, decoded int")
    out = bpe.encode(df, RANKS, P.PATTERN, decoded="decoded")
    assert out.columns == ["doc_id", "token_ids", "decoded"]
    for r in out.collect():
        text = long[min(r["doc_id"], 2)]
        assert ids(r["token_ids"]) == library.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()


def test_encode_in_spark(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, decoded int")
    out = bpe.encode(df.withColumnRenamed("decoded", "token"), RANKS, P.PATTERN)
    assert out.columns == ["doc_id", "token", "token_ids"]
    back = {r["doc_id"]: bytes(r["out"]) for r in bpe.decode(out, RANKS, out="out").collect()}
    assert back == {1: b"a b", 2: b"", 3: b""}
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0
    assert hashlib.sha256(b"").hexdigest() == hashlib.sha256(back[2]).hexdigest()
