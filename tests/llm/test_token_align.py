"""Alignment against a plain version: whole texts encoded at once, every pair of tokens compared."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidewater.llm import token_align
from tidewater.llm.queries import op13_align

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
PARTS = ["ab ", "aé日 ", "=-# ", " \n\t　\x1c\x85", "՘֋࢏౜", "\U0001f600​﻿ ", "ก็ไทย", "0１²", "'s", "<|endoftext|>", "<s>", "<0x41>"]


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(public_tokenizers.path(token_align.FIRST))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=public_tokenizers.path(token_align.SECOND))


def spans(parts: list[bytes]) -> list[tuple[int, int]]:
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(texts: list, coders) -> list[tuple]:
    a, b = coders
    alphabet = token_align._byte_alphabet()
    docs, links = [], Counter()
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text, return_type=int) if text else []
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or {b"".join(bytes_a), b"".join(bytes_b)} != {(" " + text).encode()}:
            docs.append(None)
            continue
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        cuts = sorted({e for _, e in at_a} & {e for _, e in at_b})
        groups, i, j = [], 0, 0
        for cut in cuts:
            k, m = i, j
            while k < len(at_a) and at_a[k][1] <= cut:
                k += 1
            while m < len(at_b) and at_b[m][1] <= cut:
                m += 1
            groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
            i, j = k, m
        own = Counter()
        k = 0
        for i, (s, e) in zip(ids_a, at_a, strict=True):
            while k < len(at_b) and at_b[k][1] <= s:
                k += 1
            j = k
            while j < len(at_b) and at_b[j][0] < e:
                own[i, ids_b[j]] += 1
                j += 1
        links += own
        docs.append((len(ids_a), len(ids_b), len(cuts), sum(own.values()), own, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, j), n in links.items():
        top[j] = max(top[j], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            own = d[4]
            out.append((*d[:4], sum(n for p, n in own.items() if links[p] == top[p[1]]), sum(n * links[p] for p, n in own.items()), d[5]))
    return out


def odd_texts() -> list:
    rng = random.Random(11)
    texts = ["".join(rng.choice(rng.choice(PARTS)) if rng.random() < 0.7 else rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(400)]
    return [*texts, None, "", " ", "  ", "   ", "a ", " a", "a  ", "a\n", "a \n b", "▁", "a ▁b c", "\x00", "x" * 500, "日本" * 300, "many words here " * 3000, "same", "same"]


def test_odd_texts_align_as_the_plain_version(spark, coders):
    texts = odd_texts()
    rows = spark.createDataFrame([(k, t, "x", "x", "x", "x") for k, t in enumerate(texts)], "doc_id long, text string, row string, id string, link string, n_a string")
    want = plain(texts, coders)
    for options in ({}, {"broadcast_pairs": 0}):
        got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in token_align.align(rows, **options).collect()}
        assert len(got) == len(texts)
        for k, w in enumerate(want):
            assert got[k] == w, repr(texts[k])
    assert token_align.align(rows.limit(0)).count() == 0


def test_forgetting_and_small_batches_change_nothing(monkeypatch, coders):
    monkeypatch.setattr(token_align, "REMEMBERED", 5)
    monkeypatch.setattr(token_align, "LONG", 3)
    both = token_align.Pair(token_align.FIRST, token_align.SECOND)
    texts = [t for t in odd_texts() if t]
    want = plain(texts, coders)
    for text, w in zip(texts, want, strict=True):
        ((counts, digest, links),) = both.texts([text])
        assert (*counts.tolist(), digest) == (*w[:4], w[6]) and len(links) == w[3]


def test_the_query_is_the_plain_version_on_the_whole_table(spark, coders):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op13_align(spark, sf).collect()}
    assert set(rows) == set(texts)
    want = dict(zip(texts, plain(list(texts.values()), coders), strict=True))
    assert all(tuple(rows[i][c] for c in COLUMNS) == w for i, w in want.items())


def test_repeated_ids_and_other_types(spark):
    rows = spark.createDataFrame([("a", "two words"), ("a", "two words"), (None, "two")], "name string, body string")
    got = sorted(tuple(r) for r in token_align.align(rows, "name", "body").select("name", "n_links", "count_sum").na.fill("-").collect())
    assert got == [("-", 1, 3), ("a", 2, 5), ("a", 2, 5)]
