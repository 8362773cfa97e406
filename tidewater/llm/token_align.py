"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Both tokenizers break before a space that follows a character other than white space, whatever stands around it: the first one's splitting pattern
begins a match there, and no entry of the second has its space mark after another character (``Pair`` checks it). A text is cut there into segments, and each
distinct segment is encoded once and remembered. Within a segment the tokenizers' own spans are the coarse cuts: the first library's
character offsets and the second's proto spans. Where tokens share a character, or are single bytes that stand in for one, the cuts
are refined by the bytes that the tokens decode to; cuts and decoded bytes must agree. A text whose tokens decode to other bytes is tried as one
segment, and if that fails has no tokens.

Tasks align texts in their partitions, without a shuffle, and write one row per text with its distinct linked id pairs, and one row per batch of texts with
that batch's pair counts. The counts are summed by a shuffle of these, and joined back to the texts' pairs; sums per text are made before
they meet. What is remembered is bounded by ``REMEMBERED`` segments; that changes the time, never the result.

Null and empty texts have no tokens: zeros and ''. Repeated rows and ids each have their own row and count. Columns beside the two named are
not touched. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import drop_saved, saved

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments that a worker remembers, and the longest of them in characters; characters of texts that are aligned together.
REMEMBERED, LONG, TOGETHER = 500_000, 200, 1 << 20
#: Segments that are encoded as one text.
STRUNG = 100
#: Pairs of ids that are broadcast at most (17 bytes each); beyond it they are joined by a shuffle.
BROADCAST_PAIRS = 1_500_000
_SEGMENT = re.compile(r" [^ ]*(?:(?<=\s) [^ ]*)*")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def segments(text: str) -> list[str]:
    """A space and the text, cut before each space that follows anything but white space; a space at the end makes no segment of its own."""
    out = _SEGMENT.findall(" " + text)
    if len(out) > 1 and out[-1] == " ":
        out[-2:] = [out[-2] + " "]
    return out


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible Latin-1 for themselves, the others from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(others)}


class _Entries:
    """The bytes of each id of a vocabulary."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array(list(map(len, strings)), np.int64)
        self._at = np.cumsum(self.lengths) - self.lengths
        self._bytes = np.frombuffer(b"".join(strings), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self._bytes[np.repeat(self._at[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _refined(coarse: np.ndarray, exact: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ends of tokens: the coarse ones where they are exact, else the last exact one before and the decoded bytes since."""
    decoded = np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(exact, np.arange(len(exact)), -1))
    base = np.where(last >= 0, coarse[last] - decoded[last], 0)
    return np.where(exact, coarse, base + decoded)


@dataclass
class Aligned:
    """Segments aligned: sizes for each, and the linked pairs of segment ``k`` at ``links[at[k] : at[k + 1]]``."""

    counts: np.ndarray  # rows of n_a, n_b, n_groups, n_links
    text: list[str]  # groups, each with its mark at the end
    links: np.ndarray
    at: np.ndarray
    valid: np.ndarray


class Pair:
    """Two tokenizers and what is known of segments."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(first))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path(second))
        alphabet, n = _byte_alphabet(), self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(i) or "" for i in range(n)]
        self.a_bytes = _Entries([bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{second} has entries that go across words")
        self.is_byte = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = _Entries([bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in zip(pieces, self.is_byte, strict=True)])
        self.n_b = len(pieces)
        self._names = [f"{i}{mark}" for mark in ",|;" for i in range(max(n, self.n_b))]
        self._wide = max(n, self.n_b)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[str] = []
        self.counts, self.at, self.links = np.empty((0, 4), np.int64), np.zeros(1, np.int64), np.empty(0, np.int64)
        self.valid = np.empty(0, bool)

    def _tokens(self, texts: list[str]) -> tuple:
        """Ids and ends in bytes of both tokenizers and the numbers of each text's tokens; the bytes of the texts and where they end."""
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        byte_at = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
        char_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        ends = byte_at[char_end]
        begin = np.concatenate([[0], ends[:-1]])
        coded = self.a.encode_batch(texts, add_special_tokens=False)
        n_a = np.fromiter(map(len, coded), np.int64, len(texts))
        ids_a = np.fromiter(chain.from_iterable(c.ids for c in coded), np.int64, int(n_a.sum()))
        spans = np.array([s for c in coded for s in c.offsets], np.int64).reshape(-1, 2) + np.repeat(char_end - np.diff(char_end, prepend=0), n_a)[:, None]
        exact = np.append(spans[1:, 0] >= spans[:-1, 1], True)[: len(spans)]
        ends_a = _refined(byte_at[spans[:, 1]], exact, self.a_bytes.lengths[ids_a])
        protos = [p.pieces for p in self.b.encode([t[1:] for t in texts], return_type="proto", num_threads=1)]
        n_b = np.fromiter(map(len, protos), np.int64, len(texts))
        flat = np.array([(p.id, p.end) for proto in protos for p in proto], np.int64).reshape(-1, 2)
        ids_b = flat[:, 0]
        ends_b = _refined(flat[:, 1] + 1 + np.repeat(begin, n_b), ~self.is_byte[ids_b], self.b_bytes.lengths[ids_b])
        return ids_a, ends_a, n_a, ids_b, ends_b, n_b, np.frombuffer(joined.encode(), np.uint8), ends

    def _faithful(self, ids: np.ndarray, n: np.ndarray, entries: _Entries, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the tokens of each text decode to its bytes."""
        decoded, sizes = entries.decode(ids), np.diff(ends, prepend=0)
        upto = np.concatenate([[0], np.cumsum(entries.lengths[ids])])
        own = np.diff(upto[np.cumsum(n)], prepend=0)
        if len(decoded) == len(raw) and (own == sizes).all() and (decoded == raw).all():
            return np.ones(len(n), bool)
        stop, out = np.cumsum(own), own == sizes
        for k in np.flatnonzero(out):
            out[k] = (decoded[stop[k] - own[k] : stop[k]] == raw[ends[k] - sizes[k] : ends[k]]).all()
        return out

    def align(self, parts: list[str], together: int = STRUNG) -> Aligned:
        """Align segments, each of which begins with a space and has more than it.

        Up to ``together`` segments are strung to one text: what parts them in their own texts parts them there. Segments that end in
        white space stand alone. If a string does not come back from its tokens, its segments are tried one by one.
        """
        strings, of = [], np.empty(len(parts), np.int64)
        room = 0
        for k, part in enumerate(parts):
            if room:
                strings[-1].append(part)
            else:
                strings.append([part])
                room = together
            room = 0 if part[-1].isspace() else room - 1
            of[k] = len(strings) - 1
        ids_a, ends_a, n_a, ids_b, ends_b, n_b, raw, string_ends = self._tokens(list(map("".join, strings)))
        valid = self._faithful(ids_a, n_a, self.a_bytes, raw, string_ends) & self._faithful(ids_b, n_b, self.b_bytes, raw, string_ends)
        if not valid.all():
            good, bad = (np.flatnonzero(x) for x in (valid[of], ~valid[of]))
            out = Aligned(np.zeros((len(parts), 4), np.int64), [""] * len(parts), np.empty(0, np.int64), np.zeros(len(parts) + 1, np.int64), np.zeros(len(parts), bool))
            links = [out.links] * len(parts)
            again = [(good, together)] if together == 1 else [(good, together), (bad, 1)]
            for which, size in again:
                if len(which):
                    got = self.align([parts[k] for k in which], size)
                    out.counts[which], out.valid[which] = got.counts, got.valid
                    for k, text, low, high in zip(which, got.text, got.at, got.at[1:], strict=False):
                        out.text[k], links[k] = text, got.links[low:high]
            out.links, out.at = np.concatenate(links), np.concatenate([[0], np.cumsum(out.counts[:, 3])])
            return out
        if (ends_a != np.cumsum(self.a_bytes.lengths[ids_a])).any() or (ends_b != np.cumsum(self.b_bytes.lengths[ids_b])).any():
            raise RuntimeError("spans and decoded bytes differ")
        ends = np.cumsum(np.fromiter((len(p) if p.isascii() else len(p.encode()) for p in parts), np.int64, len(parts)))
        n_a, n_b = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (ends_a, ends_b))
        both = np.intersect1d(ends_a, ends_b, assume_unique=True)
        every = np.union1d(ends_a, ends_b)  # between two cuts one pair of tokens overlaps
        links = ids_a[np.searchsorted(ends_a, every)] * self.n_b + ids_b[np.searchsorted(ends_b, every)]
        upto = np.searchsorted(every, ends, "right")
        if not np.isin(ends, both).all():
            raise RuntimeError("a segment's border is no border of tokens")
        counts = np.stack([n_a, n_b, np.diff(np.searchsorted(both, ends, "right"), prepend=0), np.diff(upto, prepend=0)], axis=1)
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        marks = np.concatenate([np.where(both[group_a] == ends_a, 1, 0), np.where(both[group_b] == ends_b, 2, 0)])
        names = list(map(self._names.__getitem__, (marks * self._wide + np.concatenate([ids_a, ids_b]))[order].tolist()))
        stops = np.cumsum(n_a + n_b).tolist()
        text = ["".join(names[low:high]) for low, high in zip([0, *stops], stops, strict=False)]
        return Aligned(counts, text, links, np.concatenate([[0], upto]), np.ones(len(parts), bool))

    def _add(self, new: list[str]) -> None:
        got = self.align(new)
        self.index.update(zip(new, range(len(self.text), len(self.text) + len(new)), strict=True))
        self.text += got.text
        self.counts = np.concatenate([self.counts, got.counts])
        self.valid = np.concatenate([self.valid, got.valid])
        self.at = np.concatenate([self.at, got.at[1:] + len(self.links)])
        self.links = np.concatenate([self.links, got.links])

    def texts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
        """For each text: its four counts, the hash of its groups and its linked pairs, one for each link."""
        cut = [segments(t) if t else [] for t in texts]
        distinct = set().union(*cut)
        new = list(distinct.difference(self.index))
        if len(self.index) + len(new) > REMEMBERED:
            self.forget()
            new = list(distinct)
        if new:
            self._add(new)
        for text, parts in zip(texts, cut, strict=True):
            rows = np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))
            if not self.valid[rows].all():
                whole = self.align([" " + text])
                yield whole.counts[0], hashlib.sha256(whole.text[0][:-1].encode()).hexdigest() if whole.valid[0] else "", whole.links
                continue
            if not len(rows):
                yield np.zeros(4, np.int64), "", self.links[:0]
                continue
            sizes = self.counts[rows, 3]
            ends = np.cumsum(sizes)
            links = self.links[np.repeat(self.at[rows] - (ends - sizes), sizes) + np.arange(ends[-1])]
            groups = "".join(map(self.text.__getitem__, rows.tolist()))[:-1]
            yield self.counts[rows].sum(axis=0), hashlib.sha256(groups.encode()).hexdigest(), links
        if any(len(p) > LONG for p in distinct):
            self.forget()


@lru_cache(maxsize=1)
def pair(first: str, second: str) -> Pair:
    return Pair(first, second)


def _tasks(id_type: pa.DataType, first: str, second: str) -> Callable:
    schema = pa.schema([("row", pa.int64()), ("id", id_type), *((c, pa.int64()) for c in _COUNTS), ("groups_sha256", pa.string()), ("links", pa.list_(pa.int64())), ("ns", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = pair(first, second), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, low = [t or "" for t in batch.column(1).to_pylist()], 0
            while low < len(texts):
                high, size = low, 0
                while high < len(texts) and (high == low or size + len(texts[high]) <= TOGETHER):
                    size += len(texts[high])
                    high += 1
                out, keys, ns = [], [], []
                for counts, digest, links in both.texts(texts[low:high]):
                    key, n = np.unique(links, return_counts=True)
                    out.append((*counts.tolist(), digest))
                    keys.append(key)
                    ns.append(n)
                total, where = np.unique(np.concatenate(keys), return_inverse=True)
                keys.append(total)
                ns.append(np.bincount(where, np.concatenate(ns), len(total)).astype(np.int64))
                m = high - low
                lists = np.concatenate([[0], np.cumsum(list(map(len, keys)))]).astype(np.int32)
                columns = [[*range(row, row + m), None], pa.concat_arrays([batch.column(0).slice(low, m), pa.nulls(1, id_type)]), *([*c, None] for c in zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)] + [pa.ListArray.from_arrays(lists, np.concatenate(x)) for x in (keys, ns)], schema=schema)
                row, low = row + m, high

    return run


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str = FIRST, second: str = SECOND, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of ``docs``: its id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in _COUNTS), T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.ArrayType(T.LongType())), T.StructField("ns", T.ArrayType(T.LongType()))])
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    done = saved(source.mapInArrow(_tasks(to_arrow_type(kind), first, second), schema))
    each = F.explode(F.arrays_zip("links", "ns")).alias("x")
    n_b = pair(first, second).n_b
    totals = done.where("row is null").select(each).groupBy(F.col("x.links").alias("link")).agg(F.sum("x.ns").alias("count"))
    totals = saved(totals)
    tops = totals.groupBy((F.col("link") % n_b).alias("b")).agg(F.max("count").alias("top"))
    pairs = totals.join(tops, F.col("link") % n_b == F.col("b")).select("link", "count", (F.col("count") == F.col("top")).alias("best"))
    if totals.count() <= broadcast_pairs:
        pairs = F.broadcast(pairs)
    texts = done.where("row is not null")
    sums = (
        texts.select("row", each).select("row", F.col("x.links").alias("link"), F.col("x.ns").alias("n")).join(pairs, "link")
        .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    )
    out = texts.select("row", "id", *_COUNTS, "groups_sha256").join(sums, "row", "left")
    return out.select(F.col("id").alias(id_col), *_COUNTS, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
