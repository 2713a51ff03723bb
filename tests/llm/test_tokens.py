import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from segspark.llm import queries
from segspark.llm.bpe import concatenated, decode, digests, encode, encoder
from segspark.llm.pretokens import pretokens
from segspark.llm.token_counts import library, token_counts

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(7)
    letters = "ab e\n\t'st0 9.,é€漢字ß  \x1c\x85🙂Ⅷ²"
    texts = ["", None, "a" * 5000, " " * 3000, "ab" * 3000, "don't we'll  x\n\n y", "<|endoftext|> a<|endoftext|>b", "​﻿", "ſK"]
    texts += ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choices("aehinorst", k=rng.randint(20, 400))) for _ in range(300)]
    return texts


def test_encoding_equals_the_library(lib):
    enc = encoder(RANKS)
    for text in odd_texts():
        ids = [i for p in pretokens(text or "", P.PATTERN) for i in enc.encode(p.encode())]
        assert ids == lib.encode_ordinary(text or ""), text


def test_every_code_point_is_matched_as_the_libraries_do(lib):
    tok, enc = library(JSON), encoder(RANKS)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{c} {c}1{c}" for c in points[at : at + 4096])
        ours = [i for p in pretokens(text, P.PATTERN) for i in enc.encode(p.encode())]
        assert ours == lib.encode_ordinary(text), at
        assert len(ours) == len(tok.encode(text, add_special_tokens=False)), at


def test_round_trip_and_counts(spark, lib):
    texts = odd_texts()[:400]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "a b", 1, "x"), (0, None, 2, "y")], "doc_id long, text string, ids int, decoded string")
    got = {(r.doc_id, r.n_tokens): r for r in digests(decode(encode(docs, RANKS, P.PATTERN), RANKS)).collect()}
    assert (None, 2) in got
    for i, t in enumerate(texts):
        ids = lib.encode_ordinary(t or "")
        r = got[i, len(ids)]
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    tok = library(JSON)
    counted = {r.doc_id: r for r in token_counts(docs.where("doc_id > 0"), JSON, P.PATTERN).collect()}
    for i, t in enumerate(texts[1:], 1):
        n = len(tok.encode(t or "", add_special_tokens=False))
        assert (counted[i].n_tokens, counted[i].n_bytes, counted[i].over_limit) == (n, len((t or "").encode()), n > 1024), t
    assert token_counts(docs.limit(0), JSON, P.PATTERN).count() == 0


def test_queries_equal_the_libraries(spark, lib):
    data = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    tok = library(JSON)
    got = {r.doc_id: r for r in queries.op1_bpe_round_trip(spark, data).collect()}
    counted = {r.doc_id: r for r in queries.op2_token_counts(spark, data).collect()}
    assert set(got) == set(counted) == set(docs)
    for i, text in docs.items():
        ids, n = lib.encode_ordinary(text), len(tok.encode(text, add_special_tokens=False))
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (counted[i].n_bytes, counted[i].n_tokens, counted[i].over_limit) == (len(text.encode()), n, n > 1024)


def test_patterns_and_joining():
    assert pretokens("ab12", r"\p{N}|\p{L}") == list("ab12") and pretokens("ab12ж", r"\p{N}|\p{L}") == list("ab12ж")
    for n in (0, 1, 63, 64, 65, 1000):
        parts = [bytes([k % 256]) * (k % 3) for k in range(n)]
        assert concatenated(parts) == b"".join(parts)
