"""Byte-level BPE: ids equal the library's, bytes come back, whatever the text."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidewater.llm import byte_bpe
from tidewater.llm.queries import op11_byte_bpe

#: Letters, marks, signs and white space; code points on which two years of Unicode differ; scripts without spaces.
PARTS = ["ab", "aé日", "=-#", " \n\t　\x1c\x85", "՘֋࢏౜", "\U0001f600​﻿", "ก็ไทย", "0１²", "'s", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load(byte_bpe.VOCABULARY).ids, special_tokens={})


def naive(piece: bytes, ids: dict) -> list[int]:
    """Merge the leftmost pair of least rank, looking at all pairs each time."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        ranked = [(ids[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids]
        if not ranked:
            return [ids[p] for p in parts]
        _, k = min(ranked)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_trees_merge_as_the_plain_rule():
    rng, ranks = random.Random(3), byte_bpe.load(byte_bpe.VOCABULARY)
    pieces = ["".join(rng.choice("abcdeé日 ") for _ in range(rng.randrange(1, 70))).encode() for _ in range(300)]
    side = {}
    for p in pieces:
        side.setdefault(max(1, (len(p) - 1).bit_length()), []).append(p)
    for levels, members in side.items():
        for p, ids in zip(members, byte_bpe.merge_side_by_side(members, ranks, levels), strict=True):
            assert ids.tolist() == naive(p, ranks.ids) == byte_bpe.merge_alone(p, ranks).tolist()


def test_ids_are_the_librarys_for_all_code_points_and_mixtures(library):
    coder, rng = byte_bpe.encoder(byte_bpe.VOCABULARY), random.Random(5)
    texts = ["".join(rng.choice(rng.choice(PARTS)) for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000)))), "", "a" * 30_000, "日本" * 9000, "".join(rng.choice("abcdefghij") for _ in range(20_000))]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert coder.ranks.decode(ids.astype(int)) == text.encode()


def test_forgetting_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    monkeypatch.setattr(byte_bpe, "LONG", 4)
    monkeypatch.setattr(byte_bpe, "TOGETHER", 10)
    coder, texts = byte_bpe.Encoder(byte_bpe.VOCABULARY), ["some words again", "some words again", "other unwordedness", ""]
    assert [x.tolist() for x in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert all(len(p) <= 4 for p in coder.known)


def test_the_query_is_the_librarys_on_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_byte_bpe(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_edges_columns_and_round_trip(spark):
    rows = [(1, None), (2, ""), (3, " "), (None, "x"), (4, "ß 日本 \U0001f600"), (4, "ß 日本 \U0001f600"), (5, "many words " * 20_000)]
    d = spark.createDataFrame([(i, t, "x", "x", "x") for i, t in rows], "doc_id long, text string, __d string, n_tokens string, ids_sha256 string")
    got = byte_bpe.encode_documents(d).collect()
    assert len(got) == len(rows) and {(r.n_tokens, r.ids_sha256) for r in got if r.doc_id in (1, 2)} == {(0, hashlib.sha256(b"").hexdigest())}
    assert byte_bpe.encode_documents(d.limit(0)).count() == 0
    back = d.select("text", byte_bpe.decode(byte_bpe.encode(F.col("text"))).alias("b")).collect()
    assert all(bytes(r.b) == (r.text or "").encode() for r in back)
