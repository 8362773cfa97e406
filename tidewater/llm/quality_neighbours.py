"""Quality by nearest-neighbour voting over latent-semantic vectors.

A bounded sample of labelled documents gives a term-document matrix (hashed words, hashed word shapes and a few terms for
repeated words and lines and for the length; tf-idf weighted); its leading singular vectors are the latent space. The labelled
vectors and the projection are broadcast (their size is fixed by the parameters). Every document is projected,
exact cosines against all labelled vectors are computed block by block, and the nearest neighbours' labels
vote with their similarity as the weight.

A text's score depends on that text and the model alone, not on the rows around it. Null, empty and wordless texts have a
zero vector: no neighbour is similar, so they score 0. Repeated rows score alike; texts of any length are counted whole. Where
several neighbours are equally near, all of them vote. Without labels all score 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bytesops as B
from tidewater.llm.common import bounded_sample

#: Labelled documents (a bounded sample), hashed words and hashed word shapes, latent dimensions, voters; documents per block of cosines.
TRAIN_ROWS, WORDS, SHAPES, DIMENSIONS, VOTERS, BLOCK = 4_000, 2_048, 256, 48, 15, 512
#: Terms besides: a word that repeats the one before it, a line that repeats an earlier one, and the power of two of the number of words.
_REPEAT, _LINE, _LENGTH, LENGTHS = 0, 1, 2, 32
TERMS = WORDS + SHAPES + _LENGTH + LENGTHS
#: Shape classes of bytes: lower-case, upper-case, digit, other letters (bytes of UTF-8), and each mark as itself.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words' shapes: their bytes by class, each run of one class once."""
    kind = _SHAPE[data]
    head = np.concatenate([[True], kind[1:] != kind[:-1]])
    head[starts] = True
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    at = np.flatnonzero(head & (np.cumsum(inside[:-1]) > 0))
    prefix = B.prefix_hash(kind[at])
    return B.span_hash(prefix, np.searchsorted(at, starts), np.searchsorted(at, ends))


def _term_counts(texts: pa.Array) -> np.ndarray:
    """Counts of each text's terms; nothing crosses from one text to the next, so a text's row depends on that text only."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, data, offsets in B.text_slices(texts):
        starts, ends, first = B.words(data, offsets)
        if not len(starts):
            continue
        n = len(offsets) - 1
        size = np.diff(first)
        doc = np.repeat(np.arange(n), size)
        h = B.span_hash(B.prefix_hash(data), starts, ends)
        mine = out[row : row + n]

        def add(term: np.ndarray, d: np.ndarray, to: np.ndarray = mine) -> None:
            cell, c = np.unique(d.astype(np.int64) * TERMS + term, return_counts=True)
            to[cell // TERMS, cell % TERMS] += c

        add((h % np.uint64(WORDS)).astype(np.int64), doc)
        add(WORDS + (_shapes(data, starts, ends) % np.uint64(SHAPES)).astype(np.int64), doc)
        mine[:, WORDS + SHAPES + _REPEAT] = np.bincount(doc[1:][(h[1:] == h[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
        # Lines: sums of word hashes by line, equal ones within a text.
        line = np.searchsorted(np.flatnonzero(data == 10), starts) + doc
        begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        key = np.column_stack([doc[begin].astype(np.uint64), np.add.reduceat(h, begin)])
        _, seen = np.unique(key, axis=0, return_index=True)
        again = np.ones(len(begin), bool)
        again[seen] = False
        mine[:, WORDS + SHAPES + _LINE] = np.bincount(doc[begin][again], minlength=n)
        some = np.flatnonzero(size)
        mine[some, WORDS + SHAPES + _LENGTH + np.minimum(np.log2(size[some]).astype(int), LENGTHS - 1)] = np.maximum(size[some] // 8, 1)
    return out


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, dimensions: int = DIMENSIONS) -> Model | None:
    """Latent space and labelled vectors, from ``rows`` labelled documents at most. None without labels."""
    pick = bounded_sample(labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y")), "id", rows)
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(pick, "id").select("id", _counts(F.col("text")).alias("c"), "y").orderBy("id").toPandas()
    if not len(got):
        return None
    counts = np.stack([np.frombuffer(c, np.float32) for c in got["c"]])
    idf = np.log1p(len(counts) / (1 + (counts > 0).sum(axis=0))).astype(np.float32)
    x = _weigh(counts, idf)
    rng = np.random.default_rng(7)
    q = x.T @ (x @ rng.standard_normal((x.shape[1], dimensions + 8)).astype(np.float32))
    for _ in range(4):  # randomised subspace iteration
        q, _r = np.linalg.qr(q)
        q = x.T @ (x @ q)
    q, _r = np.linalg.qr(q)
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ vt.T)[:, :dimensions].astype(np.float32)
    return Model(idf, basis, _unit(x @ basis).astype(np.float32), got["y"].to_numpy(np.float32))


def _counts(text: Column) -> Column:
    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        parts = [_term_counts(texts.slice(a, BLOCK)) for a in range(0, len(texts), BLOCK)]
        return pa.array([r.tobytes() for c in parts for r in c], pa.binary())

    return run(text)


def vote(vectors: np.ndarray, model: Model, voters: int = VOTERS) -> np.ndarray:
    """Weighted share of label 1 among the nearest labelled vectors of each vector.

    All neighbours as near as the last of them vote too, so their order does not matter. Cosines are rounded to 1e-4, which
    is more than what the size of a block changes in them.
    """
    out = np.zeros(len(vectors))
    k = min(voters, len(model.labels))
    for a in range(0, len(vectors), BLOCK):
        sim = np.round(vectors[a : a + BLOCK] @ model.vectors.T, 4)
        last = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k, None]
        weight = np.where(sim >= last, np.maximum(sim, 0), 0) ** 4
        total = weight.sum(axis=1)
        out[a : a + BLOCK] = weight @ model.labels / np.where(total > 0, total, 1)
    return np.round(out, 9)


def score(text: Column, model: Model | None) -> Column:
    """Similarity-weighted vote for label 1, in 0 to 1."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for a in range(0, len(texts), BLOCK):
            parts.append(vote(_unit(_weigh(_term_counts(texts.slice(a, BLOCK)), model.idf) @ model.basis).astype(np.float32), model))
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return run(text)
