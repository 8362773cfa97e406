"""Token counts by overlap resynchronisation.

Texts up to a chunk are encoded whole. A huge text is cut into overlapping chunks; each is encoded once, with the byte
offsets of its tokens. A chunk that starts at an arbitrary place soon falls into step with the true encoding. The splice is made
where tokens of both chunks begin and both split the text into pre-tokens: the splitter reads from left to right and merges
never cross a pre-token's border, so from a border of the earlier chunk (which started at a true one, and is far enough from its
end for the splitter's lookahead) that the later chunk has too, the later chunk's tokens are the true ones. If the overlap holds
no such border, it is widened and encoded again.

Null and empty texts have 0 tokens. The special string counts as one token, as the library does by default. Repeated rows count
alike; memory follows the chunk, not the text.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPECIAL = "<|endoftext|>"
RESULT = "struct<n_bytes:bigint,n_tokens:bigint,n_chunks:bigint>"
#: Characters: texts up to CHUNK are encoded whole; chunks overlap by OVERLAP at first.
CHUNK, OVERLAP = 20_000, 1_000
#: Pre-tokens at a chunk's end whose border may move when more text follows.
MARGIN = 3


@lru_cache(maxsize=4)
def _encoder(name: str):
    """``(encoder, pattern, bytes of each token)`` for a vocabulary file: the rank file gives the json file's ids, only faster."""
    import public_tokenizers
    import regex
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    return coder, regex.compile(public_tokenizers.PATTERN), lengths


@dataclass
class _Chunk:
    """Tokens of one chunk: the byte offsets in the text at which they begin, and those of its pre-tokens."""

    starts: np.ndarray
    borders: np.ndarray


def _encode(name: str, part: str, low: int, high: int, low_byte: int) -> _Chunk:
    coder, pattern, lengths = _encoder(name)
    text = part[low:high]
    sizes = lengths[coder.encode_ordinary(text)]
    starts = low_byte + np.cumsum(sizes) - sizes
    width = np.fromiter((1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in text), np.int64, len(text))
    at = np.cumsum(width) - width
    borders = np.fromiter((m.start() for m in pattern.finditer(text)), np.int64)
    return _Chunk(starts, low_byte + at[borders])


def count_tokens(text: str, name: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """``(tokens, chunks)`` of one text."""
    coder, _, _ = _encoder(name)
    parts = text.split(SPECIAL)
    total, chunks = len(parts) - 1, 0
    for part in parts:
        if len(part) <= chunk:
            total += len(coder.encode_ordinary(part))
            chunks += bool(part)
            continue
        low, low_byte, high = 0, 0, chunk
        left = _encode(name, part, low, high, low_byte)
        chunks += 1
        true = 0  # the byte from which the left chunk's tokens are the true ones and not counted yet
        while high < len(part):
            wide = overlap
            while True:
                start = max(low, high - wide)
                start_byte = low_byte + len(part[low:start].encode())
                stop = min(len(part), start + wide + chunk)
                right = _encode(name, part, start, stop, start_byte)
                both = np.intersect1d(np.intersect1d(left.starts, right.starts), np.intersect1d(left.borders[:-MARGIN], right.borders[start > low :]))
                both = both[both > true]
                if len(both):
                    break
                if start == low:  # one unbroken pre-token so far: the wider chunk takes the left one's place
                    break
                wide *= 2
            chunks += 1
            if len(both):
                cut = both[-1]
                total += int(np.searchsorted(left.starts, cut) - np.searchsorted(left.starts, true))
                true = int(cut)
            low, low_byte, high, left = start, start_byte, stop, right
        total += len(left.starts) - int(np.searchsorted(left.starts, true))
    return total, chunks


def token_counts(text: Column, vocabulary: str = "byte_bpe_50k.tiktoken", chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """A struct column of UTF-8 bytes, tokens and chunks of each text."""

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        sizes, tokens, pieces = [], [], []
        for t in texts:
            t = t.as_py() or ""
            n, k = count_tokens(t, vocabulary, chunk, overlap)
            sizes.append(len(t.encode()))
            tokens.append(n)
            pieces.append(k)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (sizes, tokens, pieces)], ["n_bytes", "n_tokens", "n_chunks"])

    return run(text)


def count_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, **options) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit, n_chunks."""
    counted = docs.select(id_col, token_counts(F.col(text_col), **options).alias("c"))
    return counted.select(id_col, "c.n_bytes", "c.n_tokens", (F.col("c.n_tokens") > limit).alias("over_limit"), "c.n_chunks")
