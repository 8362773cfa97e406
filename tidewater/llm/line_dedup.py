"""Line dedup by an exact set-similarity join.

Lines are sets of words, ordered by rarity: first by the count of a word's hash bucket over all lines, then by
hash. Equal sets form one class. A line's prefix under that order must share a word with any similar line's
(prefix filter); of the lines that meet under a word, pairs of compatible size (length filter) whose remaining words after
the match suffice (positional filter) and whose 128-bit word maps do not differ in too many bits are verified by exact
Jaccard similarity. A line goes if an equal or similar line stands at an earlier place (id, then line number), whether or not
that one goes too.

Under a word that is often used, lines would meet that have nothing else in common, more of them the more text there is. Such a
word stands with a second one: if the first word that two similar lines share is an often used one, so is the second (it is
less rare), and it stands in both prefixes made longer by one word.

Prefix entries travel packed by ranges of the word hash, whose number follows the count of words. A group that is
large, or holds many near pairs, is not paired: each line is held against the earliest of the group, which settles most;
those left meet earlier ones by what they differ in from it.

Lines without words are kept and match nothing. Words are lower-cased (A-Z) runs of non-space characters. Null texts count
as empty. Ids are longs; rows that repeat an id stand at the same places, so their lines do not count as earlier than each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bytesops as B
from tidewater.llm.common import drop_saved, free, release, saved
from tidewater.llm.setjoin import BROADCAST_IDS, BUCKET, FLUSH, MAPS, differences, may_be_similar, meeting_points, prefix_length

#: Hash buckets of the word counts that give the rarity order, so many that few rare words share one with a common word. A table
#: of 16-bit keys of this length is broadcast. Ranges of them that are counted in one group, and words that a task counts at once.
BITS = 22
BUCKETS, RANGES, COUNTED = 1 << BITS, 64, 2_000_000
#: Words with a higher count in their bucket (and one more for each 1 << SHARE words of all lines) stand with a second one, except in
#: lines of over LONG words, as such entries grow with the square of a line's length.
OFTEN, SHARE, LONG = 4096, 20, 100
#: Rounds in which large groups are held against one leader before all earlier lines are looked at.
LEADERS = 4
#: Lines of a word's group, and near pairs for each of them, beyond which the group is held against leaders first.
LARGE, DENSE = 4096, 16
#: Pairs that a task looks at together.
PAIRS = 100_000
#: Bytes of text that are parsed at once; the work arrays stay in a core's cache.
SLICE = 128 << 10
#: One entry of a line under one word of its prefix: the word, the line's size and the word's place (both to MOST), the line's
#: set, 128 bits, each the parity of the words that it stands for. Lines of MOST words and more pass the filters that need the size.
POST = np.dtype([("t", "<u4"), ("n", "<u2"), ("p", "<u2"), ("cls", "<i8"), ("s0", "<u8"), ("s1", "<u8")])
MOST = 65535
_NEWLINE = 10


def _borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each line of one slice of texts begins and ends, and which line is the first of each text (length: texts + 1)."""
    breaks = np.flatnonzero(data == _NEWLINE)
    first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    return np.sort(np.concatenate([offsets[:-1], breaks + 1])), np.sort(np.concatenate([breaks, offsets[1:]])), first


def _line_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one slice of texts: word hashes, the global line of each word, text of each line, number of each line in its text."""
    starts, ends, _ = B.words(data, offsets)
    h = B.span_hash(B.prefix_hash(data, B.LOWER_CODE), starts, ends) if len(starts) else np.empty(0, np.uint64)
    begins, _, first = _borders(data, offsets)
    line_of_word = np.repeat(np.arange(len(begins)), np.diff(np.append(np.searchsorted(starts, begins), len(starts))))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return h, line_of_word, doc, np.arange(len(doc)) - first[doc]


def _distinct(h: np.ndarray, line: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each line, lines in order; within a line by ``key`` then hash."""
    if int(line[-1] if len(line) else 0) >> 24:
        order = np.lexsort((h, line) if key is None else (h, key, line))
    else:  # one sort by line, key (17 bits at most) and the upper bits of the hash
        one = (line.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24) if key is None else key.astype(np.uint64) << np.uint64(23) | h >> np.uint64(41))
        order = np.argsort(one)
        same = np.diff(one[order]) == 0
        if np.any(np.diff(h[order])[same]):
            order = np.lexsort((h, one))
    h, line = h[order], line[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (line[1:] != line[:-1])]) if len(h) else np.empty(0, bool)
    return h[new], line[new]


def _bucket(h: np.ndarray, bits: int = 17) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def _class(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Non-negative hashes of the lines' sets; ``first``: where each line's words begin."""
    return (B.mix(np.add.reduceat(h, first) ^ n.astype(np.uint64)) >> np.uint64(1)).view(np.int64)


def _sorted_lines(h: np.ndarray, line: np.ndarray, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words and their lines (``_distinct``), where each line begins, its number of words and its class."""
    h, line = _distinct(h, line, key)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    n = np.diff(np.append(first, len(h)))
    return h, line, first, n, _class(h, first, n)


def parse(rows: DataFrame) -> DataFrame:
    """Two kinds of rows: (id, rh, lines, classes) of each document, and (range, buckets, counts) of some words of a task."""
    names = ["id", "rh", "lines", "classes", "range", "buckets", "counts"]

    def lists(at: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(at.astype(np.int32), pa.array(v)) for v in values]

    def counted(held: list) -> pa.RecordBatch:
        used, n = np.unique(np.concatenate(held), return_counts=True)
        at = np.searchsorted(used, np.arange(RANGES + 1) * (BUCKETS // RANGES))
        none = [pa.nulls(RANGES, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*none, pa.array(np.arange(RANGES, dtype=np.int32)), *lists(at, used, n.astype(np.int32))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for b in batches:
            for row, data, offsets in B.text_slices(b.column(2), SLICE):
                h, line, doc, no = _line_sets(data, offsets)
                if not len(h):
                    continue
                held.append(_bucket(h, BITS))
                size += len(h)
                if size >= COUNTED:
                    yield counted(held)
                    held, size = [], 0
                _, line, first, _n, cls = _sorted_lines(h, line)
                ids = line[first]
                m = len(offsets) - 1
                at = np.concatenate([[0], np.cumsum(np.bincount(doc[ids], minlength=m))])
                none = [pa.nulls(m, t) for t in (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(row, m), b.column(1).slice(row, m), *lists(at, no[ids].astype(np.int32), cls), *none], names)
        if size:
            yield counted(held)

    return rows.select("id", "rh", "text").mapInArrow(run, "id long, rh long, lines array<int>, classes array<long>, range int, buckets array<int>, counts array<int>")


def word_counts(parsed: DataFrame) -> np.ndarray:
    """Words of all lines by hash bucket."""
    width = BUCKETS // RANGES

    def add(table: pa.Table) -> pa.Table:
        k = table.column("range")[0].as_py()
        total = np.zeros(width, np.int64)
        for buckets, counts in zip(table.column("buckets").chunks, table.column("counts").chunks, strict=True):
            np.add.at(total, buckets.flatten().to_numpy() - k * width, counts.flatten().to_numpy())
        return pa.table({"range": pa.array([k], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(BUCKETS, np.int64)
    for r in parsed.where("range is not null").select("range", "buckets", "counts").groupBy("range").applyInArrow(add, "range int, counts binary").collect():  # RANGES rows at most
        out[r["range"] * width : (r["range"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return out


def _rarity(counts: np.ndarray) -> np.ndarray:
    """16-bit keys in the order of the counts; equal ones only for equal counts or large ones that are nearly equal."""
    half = 1 << 15
    return np.where(counts < half, counts, half + 1024 * (np.log2(np.maximum(counts, half)) - 15)).astype(np.uint16)


def _entries(h: np.ndarray, first: np.ndarray, n: np.ndarray, cls: np.ndarray, percent: int, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix entries of lines, one of each class, and the upper 24 bits of their hash. ``h``: each line's words in rarity order;
    ``often``: which are often used; each of these stands with every later word of the prefix and the one that follows it. ``t`` holds hash bits 8 to 39.

    Lines of over LONG words, and what can be similar to them, have often used words alone too, and so have lines so short that one
    common word could make them similar.
    """
    _, pick = np.unique(cls, return_index=True)
    mine = np.zeros(len(n), bool)
    mine[pick] = True
    bit = (h >> np.uint64(20)) & np.uint64(127)
    one = np.uint64(1) << (bit & np.uint64(63))
    s0, s1 = (np.bitwise_xor.reduceat(np.where((bit >= 64) == up, one, np.uint64(0)), first) for up in (False, True))
    place = np.arange(len(h)) - np.repeat(first, n)
    of = np.repeat(np.arange(len(n)), n)
    length = prefix_length(n, percent)
    prefix = (place < length[of]) & mine[of]
    alone = (n * 100 >= LONG * percent) | (n * percent < 100 + percent)
    at = np.flatnonzero(prefix & (~often | alone[of]))
    a = np.flatnonzero(prefix & often & (n <= LONG)[of])
    more = np.minimum(length, n - 1)[of[a]] - place[a]
    x = np.repeat(a, more)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(more) - more, more)
    own = np.concatenate([h[at], B.mix(h[x] * np.uint64(3) + h[y])])
    at = np.concatenate([at, y])
    line = of[at]
    out = np.empty(len(at), POST)
    out["t"], out["p"] = (own >> np.uint64(8)).astype(np.uint32), np.minimum(place[at], MOST)
    out["n"], out["cls"], out["s0"], out["s1"] = np.minimum(n[line], MOST), cls[line], s0[line], s1[line]
    return out, (own >> np.uint64(40)).astype(np.int64)


def postings(rows: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """Rows (bucket, body): the packed prefix entries of all lines, dealt out by ranges of the word hash."""
    key, often = _rarity(counts), _rarity(np.array(OFTEN + (int(counts.sum()) >> SHARE)))
    buckets = int(max(8, -(-int(counts.sum()) // (4 * BUCKET))))

    def pack(held: list) -> pa.RecordBatch:
        post, top = (np.concatenate([x[k] for x in held]) for k in range(2))
        bucket = top * buckets >> 24
        order = np.argsort(bucket, kind="stable")
        bucket, post = bucket[order], post[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(cuts[1:], len(bucket))
        body = [post[a:z].tobytes() for a, z in zip(cuts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array(body, pa.binary())], ["bucket", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = 0
        for b in batches:
            for _, data, offsets in B.text_slices(b.column(0), SLICE):
                h, line, _doc, _no = _line_sets(data, offsets)
                if not len(h):
                    continue
                h, _, first, n, cls = _sorted_lines(h, line, key[_bucket(h, BITS)])
                held.append(_entries(h, first, n, cls, percent, key[_bucket(h, BITS)] > often))
                size += len(held[-1][0])
                if size >= FLUSH:
                    yield pack(held)
                    held, size = [], 0
        if size:
            yield pack(held)

    return rows.select("text").mapInArrow(run, "bucket int, body binary")


def _shared(post: np.ndarray) -> np.ndarray:
    """The entries of words that two classes have, each once, by word, size and class: one sort by word, size and the upper 16 bits of
    the class; where these are equal, the rest is sorted too.
    """
    cls = post["cls"]
    key = post["t"].astype(np.uint64) << np.uint64(32) | post["n"].astype(np.uint64) << np.uint64(16) | cls.view(np.uint64) >> np.uint64(47)
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    mixed = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
    order[mixed] = order[mixed][np.lexsort((cls[order[mixed]], key[order[mixed]]))]
    t, cls = key[order] >> np.uint64(32), cls[order]
    once = np.concatenate([[True], (t[1:] != t[:-1]) | (cls[1:] != cls[:-1])])
    order, t = order[once], t[once]
    new = np.concatenate([[True], t[1:] != t[:-1], [True]])
    whole = post.view(np.uint64).reshape(len(post), -1)  # numpy moves rows of longs faster than records
    return whole.take(order[~(new[1:] & new[:-1])], axis=0).view(POST).ravel()


def near_pairs(post: np.ndarray, percent: int, more: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(pairs, words, members)`` of a bucket's entries: pairs of classes that pass the length, positional and bit filters, and of
    large (by ``more`` than LARGE) or dense groups the members under their word instead of pairs.

    Bits that differ are at most as many as the words in which two lines differ; as parities they do not fill up with long lines.
    """
    post = _shared(post)
    t, n, p = post["t"], post["n"].astype(np.int64), post["p"].astype(np.int64)
    apart = np.arange(2 * MOST + 1)  # words in which two lines of so many words together may differ
    apart -= 2 * -(-apart * percent // (100 + percent))
    most = n.max(initial=0) == MOST
    group = np.cumsum(np.concatenate([[False], t[1:] != t[:-1]])[: len(t)]).astype(np.int64)
    size = np.bincount(group)
    large = size > LARGE + more
    ends = np.searchsorted((group << 32) | n, (group << 32) | (n * 100 // percent), "right")
    count = np.where(large[group], 0, ends - np.arange(len(t)) - 1)
    upto = np.cumsum(count)
    s0, s1 = post["s0"].copy(), post["s1"].copy()
    found: list = []
    a = 0
    while a < len(t):
        z = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS)))
        i = np.repeat(np.arange(a, z), count[a:z])
        j = i + 1 + np.arange(len(i)) - np.repeat(upto[a:z] - count[a:z] - (upto[a - 1] if a else 0), count[a:z])
        few = np.bitwise_count(s0[i] ^ s0[j]) <= apart[n[i] + n[j]]  # half of the bits tell most pairs apart
        if most:
            few |= n[j] == MOST
        i, j = i[few], j[few]
        need = -(-(n[i] + n[j]) * percent // (100 + percent))
        differ = np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j])
        ok = (np.minimum(n[i] - p[i], n[j] - p[j]) + np.minimum(p[i], p[j]) >= need) & (differ <= n[i] + n[j] - 2 * need) | (n[j] == MOST)
        found.append((i[ok], j[ok]))
        a = z
    i, j = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.int64) for k in range(2))
    large |= np.bincount(group[i], minlength=len(size)) > DENSE * size
    keep = ~large[group[i]]
    c = post["cls"]
    x, y = c[i[keep]], c[j[keep]]
    x, y = np.minimum(x, y), np.maximum(x, y)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(x)]
    return np.column_stack([x[new], y[new]]), t[large[group]].astype(np.int64), c[large[group]]


def _maps(h: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """64-bit maps of the parities of each line's words: the bits of two lines that differ are at most as many as the words in which they do."""
    out = np.zeros((len(MAPS), len(n)), np.uint64)
    np.bitwise_xor.at(out, (((h >> np.uint64(26)) % np.uint64(len(MAPS))).astype(np.int64), np.repeat(np.arange(len(n)), n)), np.uint64(1) << ((h >> np.uint64(20)) & np.uint64(63)))
    return list(out.view(np.int64))


def _pick(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, no: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of these lines (text and number in it), end to end, and their offsets; a line that is not there is empty."""
    begins, ends, first = _borders(data, offsets)
    there = no < np.diff(first)[text]
    at = np.where(there, first[text] + no, 0)
    size = np.where(there, ends[at] - begins[at], 0)
    out = np.concatenate([[0], np.cumsum(size)])
    return data[np.repeat(begins[at] - out[:-1], size) + np.arange(out[-1])], out


def _words_of(text: Column, lines: Column, classes: Column) -> Column:
    """Class, distinct words and their maps of the wanted lines of a text, where the text has such a line of that class. Only those lines are read for words."""
    kind = pa.struct([("cls", pa.int64()), ("tok", pa.list_(pa.int64())), *[(m, pa.int64()) for m in MAPS]])

    @F.arrow_udf(f"array<struct<cls:bigint,tok:array<bigint>,{','.join(f'{m}:bigint' for m in MAPS)}>>")
    def run(texts: pa.Array, wanted: pa.Array, want: pa.Array) -> pa.Array:
        out = []
        size, wanted, want = wanted.value_lengths().to_numpy(zero_copy_only=False), wanted.flatten().to_numpy(), want.flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(size)])
        for row, data, offsets in B.text_slices(texts, SLICE):
            m = len(offsets) - 1
            text = np.repeat(np.arange(m), size[row : row + m])
            cls = want[at[row] : at[row + m]]
            h, line, _doc, _no = _line_sets(*_pick(data, offsets, text, wanted[at[row] : at[row + m]]))
            if not len(h):
                out.append(pa.array([[]] * m, pa.list_(kind)))
                continue
            h, line, first, n, own = _sorted_lines(h, line)
            same = own == cls[line[first]]
            h, text, own, n = h[np.repeat(same, n)], text[line[first[same]]], own[same], n[same]
            ends = np.concatenate([[0], np.cumsum(n)])
            tok = pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(h.view(np.int64)))
            items = pa.StructArray.from_arrays([pa.array(own), tok, *map(pa.array, _maps(h, ends[:-1], n))], fields=list(kind))
            out.append(pa.ListArray.from_arrays(np.searchsorted(text, np.arange(m + 1)).astype(np.int32), items))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(kind))

    return run(text, lines, classes)


def _later(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of each similar pair (a, b) the class that first stands at a later place."""
    left, right = (sets.select(F.col("id").alias(k), F.col("at").alias(f"{k}_at"), F.col("n").alias(f"{k}_n"), F.col("tok").alias(f"{k}_tok")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("a_tok", "b_tok")))
    alike = both.where((F.col("common") * 100 >= (F.col("a_n") + F.col("b_n") - F.col("common")) * percent) & (F.col("a_at") != F.col("b_at")))
    return alike.select(F.when(F.col("a_at") < F.col("b_at"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()


def _settled(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``_later`` of many pairs (a, b). Pairs whose sizes or word maps are too far apart go before any words are read; then each class
    meets the earlier one whose map is nearest (ties: the earliest), and the others only if that one is not similar.
    """
    keep = ["at", "n", *MAPS]
    placed = pairs
    for k in "ab":
        placed = placed.join(sets.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in keep]), k)
    apart = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in MAPS[1:]), F.bit_count(F.col(f"a_{MAPS[0]}").bitwiseXOR(F.col(f"b_{MAPS[0]}"))))
    near = (apart * (100 + percent) <= (F.col("a_n") + F.col("b_n")) * (100 - percent)) & (F.col("a_n") * 100 >= F.col("b_n") * percent) & (F.col("b_n") * 100 >= F.col("a_n") * percent)
    turn = F.col("a_at") < F.col("b_at")
    placed = placed.where(near & (F.col("a_at") != F.col("b_at")))
    placed = saved(placed.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"), F.least("a_at", "b_at").alias("b_at"), apart.alias("apart")))
    release(pairs.sparkSession)
    first = placed.groupBy("a").agg(F.min(F.struct("apart", "b_at", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    gone = saved(_later(first, sets, percent))
    release(pairs.sparkSession)
    rest = placed.select("a", "b").join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(first, ["a", "b"], "left_anti")
    gone = gone.unionByName(saved(_later(rest, sets, percent)))
    drop_saved(placed)
    release(pairs.sparkSession)
    return gone


def _large_groups(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Classes of large groups (t, id) that are similar to an earlier one.

    Each is held against the earliest of its groups, which settles most; those that are still open look at earlier ones that
    share enough of what they differ in from the group's earliest (``differences``).
    """
    held = saved(groups.join(sets.select("id", "at", "n"), "id"))
    ratio = lambda a, b: (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)
    gone = leaders = None
    for _ in range(LEADERS):
        live = held if gone is None else held.join(gone, "id", "left_anti").join(leaders, "id", "left_anti")
        lead = live.groupBy("t").agg(F.min(F.struct("at", "id", "n")).alias("m")).select("t", F.col("m.at").alias("b_at"), F.col("m.id").alias("b"), F.col("m.n").alias("b_n"))
        star = saved(live.join(lead, "t").where((F.col("b_at") < F.col("at")) & ratio("n", "b_n")).select(F.col("id").alias("a"), "b").distinct())
        now = saved(_later(star, sets, percent))
        gone = now if gone is None else gone.unionByName(now)
        led = lead.select(F.col("b").alias("id"))
        leaders = saved((led if leaders is None else led.unionByName(leaders)).distinct())
        release(groups.sparkSession)
    first = held.groupBy("t").agg(F.min(F.struct("at", "id")).alias("m")).select("t", F.col("m.id").alias("r"))
    near = held.join(first, "t").select("id", "r", "at").distinct().withColumn("inside", F.lit(False))
    told = differences(near, sets, percent)
    similar = told.join(sets.select(F.col("id").alias("r"), F.col("at").alias("r_at")), "r").where("near and r_at < at").select("id")
    gone = saved(gone.unionByName(similar).distinct())
    post = meeting_points(told, ["at"])
    release(groups.sparkSession)
    x = post.join(gone, "id", "left_anti").select(F.col("h").alias("xh"), *[F.col(c).alias(f"x_{c}") for c in ("id", "at", "n", "d", "s", "p", "before", *MAPS)])
    rest = x.join(post, (F.col("h") == F.col("xh")) & (F.col("at") < F.col("x_at")) & may_be_similar(percent)).select(F.col("x_id").alias("a"), F.col("id").alias("b"))
    # Lines that are far from the group's earliest meet those away from it under the group's word.
    placed = saved(held.join(first, "t").join(told.where("away").select("id", "r", "far"), ["id", "r"]).select("id", "t", "n", "at", "far"))
    x = placed.join(gone, "id", "left_anti").select(F.col("t").alias("xt"), *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "at", "far")])
    direct = x.join(placed, (F.col("t") == F.col("xt")) & (F.col("at") < F.col("x_at")) & (F.col("far") | F.col("x_far")) & ratio("n", "x_n")).select(F.col("x_id").alias("a"), F.col("id").alias("b"))
    return gone.unionByName(_settled(rest.unionByName(direct).distinct(), sets, percent))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """Rows (id, rh, line) of the lines that go; ``rh`` is the hash of the whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("rh", F.xxhash64("text"))
    parsed = saved(parse(rows))
    release(docs.sparkSession)
    lines = parsed.where("range is null").select("id", "rh", F.explode(F.arrays_zip("lines", "classes")).alias("z")).select("id", "rh", F.col("z.lines").alias("line"), F.col("z.classes").alias("cls"))

    counts = word_counts(parsed)
    more = int(counts.sum()) >> SHARE

    def meet(table: pa.Table) -> pa.Table:
        pairs, words, members = near_pairs(np.frombuffer(b"".join(table.column("body").to_pylist()), POST), percent, more)
        t = words + (table.column("bucket")[0].as_py() << 32)
        none = pa.nulls(len(pairs), pa.int64())
        a = np.concatenate([pairs[:, 0], members])
        return pa.table({"a": a, "b": pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(members), pa.int64())]), "t": pa.concat_arrays([none, pa.array(t)])})

    met = saved(postings(rows, counts, percent).groupBy("bucket").applyInArrow(meet, "a long, b long, t long"))
    release(docs.sparkSession)
    classes = saved(lines.groupBy("cls").agg(F.min(F.struct("id", "line")).alias("at"), F.count("*").alias("c")))
    pairs = met.where("t is null").select("a", "b").distinct()
    groups = met.where("t is not null").select(F.col("a").alias("id"), "t")
    asked = met.select(F.col("a").alias("cls")).unionByName(met.where("t is null").select(F.col("b").alias("cls"))).distinct()
    heads = saved(classes.join(asked, "cls").select("cls", "at"))
    wanted = heads.groupBy(F.col("at.id").alias("id")).agg(F.collect_list(F.struct(F.col("at.line").alias("line"), "cls")).alias("l"))
    few = F.broadcast if wanted.count() <= BROADCAST_IDS // 4 else (lambda d: d)
    words = rows.select("id", "text").join(few(wanted), "id").select(F.explode(_words_of(F.col("text"), F.col("l.line"), F.col("l.cls"))).alias("w")).select("w.*")
    sets = saved(words.dropDuplicates(["cls"]).join(heads, "cls").select(F.col("cls").alias("id"), "at", "tok", F.size("tok").alias("n"), *MAPS))
    release(docs.sparkSession)
    gone = saved(_settled(pairs, sets, percent).unionByName(_large_groups(groups, sets, percent)).distinct())
    # A line goes with its class's first place, or because it is a later one of its class.
    told = classes.join(gone.withColumnRenamed("id", "cls").withColumn("all", F.lit(True)), "cls", "left").where("c > 1 or all").select("cls", "at", F.coalesce("all", F.lit(False)).alias("all"))
    place = F.struct("id", "line")
    out = saved(lines.join(told, "cls").where(F.col("all") | (place > F.col("at"))).groupBy("id", "rh").agg(F.collect_set("line").alias("gone")))
    for used in (parsed, met, classes, heads, sets, gone):
        drop_saved(used)
    release(docs.sparkSession)
    return out


def _without(text: Column, gone: Column) -> Column:
    """The text without the lines of these numbers."""

    @F.arrow_udf("string")
    def run(texts: pa.Array, lines: pa.Array) -> pa.Array:
        out = []
        for t, g in zip(texts, lines, strict=True):
            parts = t.as_py().split("\n")
            keep = np.ones(len(parts), bool)
            keep[g.values.to_numpy()] = False
            out.append("\n".join([parts[k] for k in np.flatnonzero(keep)]))
        return pa.array(out, pa.string())

    return run(text, gone)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> tuple[DataFrame, str]:
    """``(rows, column)``: all rows and columns, the text without its repeated lines, and the name of one more column, which holds their number."""
    i, rh, lost, removed = free(docs.columns, "id", "rh", "lost", "removed")
    gone = repeats(docs, id_col, text_col, percent).select(F.col("id").alias(i), F.col("rh").alias(rh), F.col("gone").alias(lost))
    hit = (docs[id_col] == F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(rh))
    few = F.broadcast if gone.count() <= BROADCAST_IDS else (lambda d: d)
    # Only the texts that lose lines go through Python, and where the table of ids is small none is moved.
    cut = docs.join(few(gone.select(i, rh)), hit, "left_semi").join(gone, hit)
    cut = cut.select(*[_without(docs[f"`{c}`"], F.col(lost)).alias(c) if c == text_col else docs[f"`{c}`"] for c in docs.columns], F.size(lost).alias(removed))
    return cut.unionByName(docs.join(few(gone.select(i, rh)), hit, "left_anti").withColumn(removed, F.lit(0))), removed


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per document: id, text (without repeated lines), n_removed_lines."""
    d, removed = dedup(docs.select(id_col, text_col), id_col, text_col, percent)
    return d.withColumnRenamed(removed, "n_removed_lines")


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The documents' columns with shortened texts; documents of which no word is left go."""
    d, removed = dedup(docs, id_col, text_col, percent)
    bare = F.length(F.translate(F.coalesce(F.col(text_col), F.lit("")), " \t\n\x0b\f\r", "")) == 0
    return d.where(~((F.col(removed) > 0) & bare)).drop(removed)
