"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each match of the splitting pattern (a piece) is merged on its own: always the leftmost of the adjacent pairs of least rank, until no pair
has a rank. The leaf of a live byte position holds the rank of the pair that begins there together with the position, an inner node
the least of its two children, so the root names the leftmost minimum. A merge kills one position and changes three leaves (the merged
token's, its left neighbour's, the dead one's), each carried up in logarithmic time. The trees of many pieces of like length stand side by side in
one array and take a merge each per round; a piece over ``LONG`` bytes has a tree of its own.

Texts are encoded in Arrow batches inside tasks, in their partitions, without any shuffle. Pieces met before are remembered per
worker, up to ``REMEMBERED``; that changes the time, never the ids. Null and empty texts have no ids. Repeated rows and ids encode alike;
columns beside the two that are named are not touched.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
RESULT = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"
#: Bytes of a piece from which on it has a tree of its own; leaves that are worked on side by side.
LONG, LEAVES = 4096, 1 << 19
#: Characters of texts whose new pieces are merged together.
TOGETHER = 1 << 20
#: Pieces whose ids a worker remembers.
REMEMBERED = 800_000


def _ranges(chars: set[str]) -> str:
    """Code points as the inside of a set of a pattern."""
    out, points = [], sorted(map(ord, chars))
    for k, p in enumerate(points):
        if k and points[k - 1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=2)
def splitter(pattern: str):
    """``text -> pieces`` for a splitting pattern, with the letters and numbers that the rank files' library knows.

    Its tables of letters and numbers are of another year than those of the pattern module here, so each class is asked for once; texts that hold a
    code point on which they differ are split by a pattern with corrected classes.
    """
    import tiktoken

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    differ, exact = set(), pattern
    for name in (r"\p{L}", r"\p{N}"):
        coder = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs, ours = set(bytes(coder.encode_ordinary(every)).decode()), set(regex.findall(name, every))
        more, less = theirs - ours, ours - theirs
        differ |= more | less
        held = f"[{name}--[{_ranges(less)}]]" if less else name
        exact = exact.replace(name, f"[{held}||[{_ranges(more)}]]" if more else held)
    usual = regex.compile(pattern)
    if not differ:
        return usual.findall
    corrected = regex.compile(exact, regex.V1)
    return lambda text: (usual if text.isascii() or differ.isdisjoint(text) else corrected).findall(text)


class Ranks:
    """A rank file: the id of each byte string, and of each pair of ids whose strings joined have one (an id is its rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.n = max(ranks.values()) + 1
        self.none = self.n  # the rank of a pair that has none
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = rank
        self.pairs = pairs
        self._keys = np.array(sorted(pairs), np.int64)
        self._ranks = np.array([pairs[k] for k in self._keys.tolist()], np.int64)
        strings = [b""] * self.n
        for piece, rank in ranks.items():
            strings[rank] = piece
        self.lengths = np.array(list(map(len, strings)), np.int64)
        self._at = np.cumsum(self.lengths) - self.lengths
        self._bytes = np.frombuffer(b"".join(strings), np.uint8)

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; a negative id has no pairs."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where((self._keys[at] == key) & (a >= 0) & (b >= 0), self._ranks[at], self.none)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, one after the other."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self._bytes[np.repeat(self._at[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()


@lru_cache(maxsize=2)
def load(name: str) -> Ranks:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return Ranks({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def merge_side_by_side(pieces: list[bytes], ranks: Ranks, levels: int) -> list[np.ndarray]:
    """Ids of pieces of at most ``2 ** levels`` bytes, one tree each in one array."""
    size, count = 1 << levels, len(pieces)
    lengths = np.fromiter(map(len, pieces), np.int64, count)
    place = np.arange(size)
    inside = place < lengths[:, None]
    token = np.full((count, size + 1), -1, np.int64)  # the last column stands for what lies beyond the piece
    token[:, :size][inside] = ranks.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    tree = np.empty((count, 2 * size), np.int64)
    tree[:, size:] = ranks.of_pairs(token[:, :size], token[:, 1:]) << levels | place
    for level in range(levels - 1, -1, -1):
        at = 1 << level
        tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
    after = np.tile(np.arange(1, size + 2), (count, 1))
    before = np.tile(np.arange(-1, size), (count, 1))  # -1 is the last column too
    none, least = ranks.none << levels, tree[:, 1]
    lanes = np.flatnonzero(least < none)
    while len(lanes):
        root = least[lanes]
        at, merged = root & (size - 1), root >> levels
        dead = after[lanes, at]
        right = np.minimum(after[lanes, dead], size)
        left = before[lanes, at]
        token[lanes, at], token[lanes, dead], after[lanes, at] = merged, -1, right
        before[lanes, np.minimum(right, size - 1)] = np.where(right < size, at, before[lanes, size - 1])
        has = left >= 0
        some = lanes[has]
        tree[some, size + left[has]] = ranks.of_pairs(token[some, left[has]], merged[has]) << levels | left[has]
        tree[lanes, size + at] = ranks.of_pairs(merged, token[lanes, right]) << levels | at
        tree[lanes, size + dead] = none | dead
        row, node = np.concatenate([lanes, lanes, some]), np.concatenate([at, dead, left[has]]) + size
        for _ in range(levels):
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        lanes = lanes[least[lanes] < none]
    live = token[:, :size] >= 0
    return np.split(token[:, :size][live], np.cumsum(live.sum(axis=1))[:-1])


def merge_alone(piece: bytes, ranks: Ranks) -> np.ndarray:
    """Ids of one piece of any length, by a tree in flat arrays."""
    n, pairs, none = len(piece), ranks.pairs, ranks.none
    levels = max(1, (n - 1).bit_length())
    size = 1 << levels
    token = array("q", ranks.byte[np.frombuffer(piece, np.uint8)].tolist())
    first = np.full(size, none, np.int64)
    own = np.frombuffer(token, np.int64)
    first[: n - 1] = ranks.of_pairs(own[:-1], own[1:])
    nodes = np.empty(2 * size, np.int64)
    nodes[size:] = first << levels | np.arange(size)
    for level in range(levels - 1, -1, -1):
        at = 1 << level
        nodes[at : 2 * at] = np.minimum(nodes[2 * at : 4 * at : 2], nodes[2 * at + 1 : 4 * at : 2])
    tree = array("q", nodes.tobytes())
    del own, nodes, first
    after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))

    def put(leaf: int, rank: int) -> None:
        node = size + leaf
        tree[node] = rank << levels | leaf
        while node > 1:
            node >>= 1
            low = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == low:
                break
            tree[node] = low

    while tree[1] >> levels < none:
        at, merged = tree[1] & (size - 1), tree[1] >> levels
        dead = after[at]
        right, left = after[dead], before[at]
        token[at], token[dead], after[at] = merged, -1, right
        put(dead, none)
        if right < n:
            before[right] = at
        put(at, pairs.get(merged * ranks.n + token[right], none) if right < n else none)
        if left >= 0:
            put(left, pairs.get(token[left] * ranks.n + merged, none))
    ids = np.frombuffer(token, np.int64)
    return ids[ids >= 0]


def merge(pieces: list[bytes], ranks: Ranks) -> list[np.ndarray]:
    """Ids of pieces; a piece that is an entry is that one id, as the library has it."""
    out: list = [None] * len(pieces)
    alike: dict[int, list[int]] = {}
    for k, piece in enumerate(pieces):
        if (whole := ranks.ids.get(piece)) is not None:
            out[k] = np.array([whole], np.int64)
        elif len(piece) > LONG:
            out[k] = merge_alone(piece, ranks)
        else:
            alike.setdefault((len(piece) - 1).bit_length(), []).append(k)
    for levels, members in alike.items():
        step = max(1, LEAVES >> levels)
        for low in range(0, len(members), step):
            part = members[low : low + step]
            for k, ids in zip(part, merge_side_by_side([pieces[k] for k in part], ranks, levels), strict=True):
                out[k] = ids
    return out


class Encoder:
    """Encodes batches of texts and remembers pieces."""

    def __init__(self, name: str):
        import public_tokenizers

        self.ranks, self.split, self.known = load(name), splitter(public_tokenizers.PATTERN), {}

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as unsigned 32-bit integers; texts are taken together up to ``TOGETHER`` characters."""
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= TOGETHER):
                size += len(texts[high])
                high += 1
            yield from self._encode([self.split(t) for t in texts[low:high]])
            low = high

    def _encode(self, split: list[list[str]]) -> Iterator[np.ndarray]:
        distinct = set().union(*split)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
        new = list(distinct.difference(self.known))
        ids = dict(zip(new, (x.astype("<u4").tobytes() for x in merge([p.encode() for p in new], self.ranks)), strict=True))
        self.known |= {p: x for p, x in ids.items() if len(p) <= LONG}
        held = self.known if all(len(p) <= LONG for p in new) else self.known | ids
        for pieces in split:
            yield np.frombuffer(b"".join(map(held.__getitem__, pieces)), "<u4")


@lru_cache(maxsize=2)
def encoder(name: str) -> Encoder:
    return Encoder(name)


def encode(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The ids of each text, an array of integers."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([ids.tolist() for ids in encoder(vocabulary).encode([t or "" for t in texts.to_pylist()])], pa.list_(pa.int32()))

    return run(text)


def decode(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The bytes of each array of ids; a null array has none."""

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([load(vocabulary).decode(np.array(r or [], np.int64)) for r in rows.to_pylist()], pa.binary())

    return run(ids)


def digests(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """A struct column of the number of ids, their hash and that of the bytes that they decode to."""

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        coder = encoder(vocabulary)
        counts, ids_hash, text_hash = [], [], []
        for ids in coder.encode([t or "" for t in texts.to_pylist()]):
            counts.append(len(ids))
            ids_hash.append(hashlib.sha256(ids).hexdigest())
            text_hash.append(hashlib.sha256(coder.ranks.decode(ids.astype(np.int64))).hexdigest())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: its id, n_tokens, ids_sha256 and decoded_sha256."""
    return docs.select(id_col, digests(F.col(text_col), vocabulary).alias("__d")).select(id_col, "__d.n_tokens", "__d.ids_sha256", "__d.decoded_sha256")
