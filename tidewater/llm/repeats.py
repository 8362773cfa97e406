"""Byte dedup by run-length index: long strings that start anywhere else as well.

Candidates come from minimizers: the least hash of the ``GRAM``-byte strings in each window of ``width`` bytes is an anchor,
so two equal windows have the same anchor at the same place. Only anchors that occur twice matter. Where
the leftmost and the rightmost window around such an anchor both occur again, all bytes between are covered at once. The
other windows are settled by an index: their contexts, with one context of each settled kind, are dealt out by anchor;
each bucket's text is suffix-sorted into a Burrows-Wheeler transform, whose runs' ends are sampled: the length of the
longest match with any other suffix is computed there only, and streamed over the positions between, where
it falls by one from each position to the next. Windows whose matching statistic reaches ``width`` are marked.

An anchor with very many contexts is not put in one bucket: its windows' hashes are counted instead, pre-aggregated
before the shuffle. All marks are judged on the input; matches never cross documents. Null texts count as empty; texts shorter than
a window keep all bytes. Ids are longs; rows that repeat an id are documents of their own, told apart by their texts, and equal
rows repeat each other. Texts of any length are read whole; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bytesops as B
from tidewater.llm.common import saved
from tidewater.llm.setjoin import BROADCAST_IDS

WIDTH, GRAM = 400, 200
#: Contexts of one anchor above which its windows are counted rather than indexed; text bytes of a bucket.
HOT, BUCKET_BYTES = 3_000, 2_000_000
#: A key is heavy with more rows than SHARE and than one in HEAVY_KEYS of all rows, so that there are fewer heavy keys than HEAVY_KEYS.
SHARE, HEAVY_KEYS = 2_000, 100_000


def _anchors(data: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions, their hashes, and the running hash of the text."""
    prefix = B.prefix_hash(data)
    if len(data) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64), prefix
    v = B.window_hash(prefix, gram) if len(data) > gram else np.empty(0, np.uint64)
    v = np.append(v, B.span_hash(prefix, np.array([len(data) - gram]), np.array([len(data)])))[: len(data) - gram + 1]
    at = B.sliding_argmin(v, width - gram + 1)
    return at, v[at], prefix


def anchors(text: Column, width: int, gram: int) -> Column:
    """Of each text: anchor hash, position, and hashes of its rightmost-reaching and leftmost-reaching windows."""

    @F.arrow_udf("array<struct<h:bigint,pos:int,fa:bigint,fz:bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        cols: list[list] = [[], [], [], []]
        sizes = []
        for _, data, offsets in B.text_slices(texts):
            for i in range(len(offsets) - 1):
                d = data[offsets[i] : offsets[i + 1]]
                at, h, prefix = _anchors(d, width, gram)
                sizes.append(len(at))
                if len(at):
                    a = np.minimum(at, len(d) - width)
                    z = np.maximum(at + gram, width)
                    cols[0].append(h)
                    cols[1].append(at)
                    cols[2].append(B.span_hash(prefix, a, a + width) ^ (at - a).astype(np.uint64))
                    cols[3].append(B.span_hash(prefix, z - width, z) ^ (at - z + width).astype(np.uint64))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        items = pa.StructArray.from_arrays([pa.array(cat(cols[0], np.uint64).view(np.int64)), pa.array(cat(cols[1], np.int32)), pa.array(cat(cols[2], np.uint64).view(np.int64)), pa.array(cat(cols[3], np.uint64).view(np.int64))], ["h", "pos", "fa", "fz"])
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), items)

    return run(text)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` values: prefix doubling from 8 bytes; each round sorts only
    the suffixes that are not yet told apart. A rank is the first place of a suffix's group.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n].astype(np.uint64)
    order = np.argsort(key)
    rank = np.zeros(n + depth, np.int64)  # places beyond the end rank lowest
    live, slots, key = order, np.arange(n), key[order]
    step = 8
    while True:
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(live)))
        rank[live] = np.repeat(slots[first], size) + 1
        tied = np.repeat(size > 1, size)
        live, slots = live[tied], slots[tied]
        if step >= depth or not len(live):
            return order
        key = (rank[live].astype(np.uint64) << np.uint64(32)) | rank[live + step].astype(np.uint64)
        o = np.argsort(key)
        live, key = live[o], key[o]
        order[slots] = live
        step *= 2


def _common(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, least: int, limit: int) -> np.ndarray:
    """Lengths of the longest common prefixes of pairs of suffixes, up to ``limit``; 0 for those under ``least``.
    One hash tells most pairs off; the rest take a binary search.
    """
    out = np.zeros(len(a), np.int64)
    top = np.minimum(limit, len(prefix) - 1 - np.maximum(a, b))
    long = np.flatnonzero(top >= least)
    live = long[B.span_hash(prefix, a[long], a[long] + least) == B.span_hash(prefix, b[long], b[long] + least)]
    low, high = np.full(len(live), least), top[live]
    while True:
        todo = np.flatnonzero(low < high)
        if not len(todo):
            out[live] = low
            return out
        mid = (low[todo] + high[todo] + 1) // 2
        x, y = a[live[todo]], b[live[todo]]
        same = B.span_hash(prefix, x, x + mid) == B.span_hash(prefix, y, y + mid)
        low[todo[same]] = mid[same]
        high[todo[~same]] = mid[~same] - 1


def matching_statistics(text: np.ndarray, starts: np.ndarray, least: int, depth: int) -> np.ndarray:
    """For each position the longest match (to ``depth``) with any other position, from samples at the ends of the
    runs of the Burrows-Wheeler transform; matches under ``least`` may show as shorter. ``starts``: where the contexts
    begin; those positions are sampled too.
    """
    n = len(text)
    order = suffix_order(text, depth)
    bwt = text[order - 1]
    edge = bwt[1:] != bwt[:-1]  # between ranks i and i + 1
    begins = np.zeros(n, bool)
    begins[starts] = True
    own = begins[order]
    sampled = own.copy()
    sampled[1:] |= edge
    sampled[:-1] |= edge
    sampled[:-1] |= own[1:]
    sampled[1:] |= own[:-1]
    sampled[[0, -1]] = True
    ranks = np.flatnonzero(sampled)
    prefix = B.prefix_hash(text)
    best = np.zeros(len(ranks), np.int64)
    up = ranks > 0
    best[up] = _common(prefix, order[ranks[up] - 1], order[ranks[up]], least, depth)
    down = ranks < n - 1
    best[down] = np.maximum(best[down], _common(prefix, order[ranks[down]], order[ranks[down] + 1], least, depth))
    reach = np.zeros(n, np.int64)
    reach[order[ranks]] = best + order[ranks]
    return np.maximum(np.maximum.accumulate(reach) - np.arange(n), 0)


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def index_bucket(ids: np.ndarray, starts: np.ndarray, bodies: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered ranges (id, start, end) of a bucket's contexts. Overlapping contexts of one document are joined first,
    as a string must not match itself.
    """
    order = np.lexsort((starts, ids))
    joined: list[tuple[int, int, bytearray]] = []
    for k in order.tolist():
        i, s, b = int(ids[k]), int(starts[k]), bodies[k]
        if joined and joined[-1][0] == i and s <= joined[-1][1] + len(joined[-1][2]):
            have = joined[-1]
            have[2].extend(b[have[1] + len(have[2]) - s :])
        else:
            joined.append((i, s, bytearray(b)))
    size = np.array([len(j[2]) for j in joined])
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    text = np.frombuffer(b"\0".join(bytes(j[2]) for j in joined) + b"\0", np.uint8)
    stats = matching_statistics(text, begin[:-1], width, int(size.max()) + 1)
    left = np.repeat(begin[:-1] + size, size + 1) - np.arange(len(text))
    hit = np.minimum(stats, left) >= width
    a, z = _ranges(hit)
    which = np.searchsorted(begin, a, "right") - 1
    base = np.array([j[1] for j in joined])[which] - begin[which]
    return np.array([j[0] for j in joined], np.int64)[which], a + base, z - 1 + width + base


def _counted(rows: DataFrame, keys: list[str], name: str, share: int) -> DataFrame:
    """The rows with the number of rows that have the same keys. Rows of keys with over ``share`` rows are not brought together: those keys, few
    as each has that many rows, are broadcast.
    """
    counts = saved(rows.groupBy(*keys).agg(F.count("*").alias(name)))
    heavy = F.broadcast(counts.where(F.col(name) > share))
    there = rows.join(heavy, keys)
    return there.unionByName(rows.join(heavy, keys, "left_anti").join(counts.where(F.col(name) <= share), keys).select(there.columns))


def covered(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Ranges (id, start, end) whose union is what repeats, of docs (id, text)."""
    grams = saved(docs.where(F.octet_length("text") >= width).select("id", F.explode(anchors(F.col("text"), width, gram)).alias("a")).select("id", "a.*"))
    share = max(SHARE, grams.count() // HEAVY_KEYS)
    met = saved(_counted(grams, ["h"], "c", share).where("c > 1").drop("c"))
    met = _counted(_counted(met, ["fa", "h"], "ca", share), ["fz", "h"], "cz", share)
    met = saved(met.select("id", "h", "pos", "fa", "fz", (F.col("ca") > 1).alias("ra"), (F.col("cz") > 1).alias("rz")))
    # One context of each settled kind serves as a partner; unsettled ones are all looked at.
    unsettled = met.where(~(F.col("ra") & F.col("rz")))
    kinds = met.where("ra and rz").groupBy("h", "fa", "fz").agg(F.min(F.struct("id", "pos")).alias("m")).select("h", "m.id", "m.pos")
    both = saved(unsettled.select("h", "id", "pos").unionByName(kinds.join(unsettled.select("h").distinct(), "h", "left_semi")))
    asked = saved(_counted(both, ["h"], "load", share))
    known = met.where("ra or rz").select("id", "pos", "ra", "rz")
    per_doc = asked.groupBy("id").agg(F.collect_list(F.struct("h", "pos", "load")).alias("q"))
    total = asked.count() * (2 * width - gram)
    buckets = max(16, total // BUCKET_BYTES)
    cuts = _only(docs, per_doc).join(per_doc, "id").select("id", F.col("text").cast("binary").alias("text"), "q")
    cuts = cuts.select("id", F.explode(F.transform("q", lambda q: F.struct(q["h"].alias("h"), q["load"].alias("load"), F.greatest(q["pos"] - (width - gram), F.lit(0)).alias("start"), q["pos"].alias("pos")))).alias("q"), "text")
    body = F.substring(F.col("text"), F.col("q.start") + 1, F.col("q.pos") + width - F.col("q.start"))
    cuts = saved(cuts.select("id", "q.h", "q.load", "q.start", "q.pos", body.alias("body")))

    def search(table: pa.Table) -> pa.Table:
        i, a, z = index_bucket(table.column("id").to_numpy(), table.column("start").to_numpy(), table.column("body").to_pylist(), width)
        return pa.table({"id": pa.array(i, pa.int64()), "start": pa.array(a.astype(np.int64)), "end": pa.array(z.astype(np.int64))})

    cold = cuts.where(F.col("load") <= HOT).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    found = cold.select("id", "start", "body", "bucket").groupBy("bucket").applyInArrow(search, "id long, start long, end long")
    # Anchors with very many contexts: their windows' hashes, counted with partial sums.
    hot = cuts.where(F.col("load") > HOT).select("id", "h", F.explode(_window_hashes(F.col("body"), F.col("start"), width)).alias("w")).select("id", "h", "w.*")
    again = hot.groupBy("h", "hash").agg(F.count_distinct("id", "start").alias("c")).where("c > 1").select("h", "hash")
    hot_found = hot.join(again, ["h", "hash"]).select("id", F.col("start").cast("long").alias("start"), (F.col("start") + width).cast("long").alias("end"))
    return found.unionByName(hot_found).unionByName(_known(known, width, gram))


def _only(docs: DataFrame, wanted: DataFrame, not_wanted: bool = False) -> DataFrame:
    """Rows whose id is wanted (or not), found without moving the texts where the ids are few enough to be broadcast."""
    ids = wanted.select("id").distinct()
    if ids.count() > BROADCAST_IDS:
        return docs.join(ids, "id", "left_anti") if not_wanted else docs
    return docs.join(F.broadcast(ids), "id", "left_anti" if not_wanted else "left_semi")


def _known(known: DataFrame, width: int, gram: int) -> DataFrame:
    right = known.where("ra").select("id", F.col("pos").cast("long").alias("start"), (F.col("pos") + width).cast("long").alias("end"))
    left = known.where("rz").select("id", (F.col("pos") + gram - width).cast("long").alias("start"), (F.col("pos") + gram).cast("long").alias("end"))
    return right.unionByName(left)


def _window_hashes(body: Column, start: Column, width: int) -> Column:
    @F.arrow_udf("array<struct<hash:bigint,start:int>>")
    def run(bodies: pa.Array, starts: pa.Array) -> pa.Array:
        hashes, at, sizes = [], [], []
        for b, s in zip(bodies, starts.to_numpy(zero_copy_only=False), strict=True):
            d = np.frombuffer(b.as_py(), np.uint8)
            n = max(0, len(d) - width + 1)
            k = np.arange(n)
            hashes.append(B.span_hash(B.prefix_hash(d), k, k + width))
            at.append(k + s)
            sizes.append(n)
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.empty(0, t)
        items = pa.StructArray.from_arrays([pa.array(cat(hashes, np.uint64).view(np.int64)), pa.array(cat(at, np.int32))], ["hash", "start"])
        return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), items)

    return run(body, start)


def merge(starts: np.ndarray, ends: np.ndarray, n: int, width: int) -> list[tuple[int, int]]:
    """Disjoint, maximal ranges within a text of n bytes. A window that sticks out of the text is its first or last one."""
    if not len(starts):
        return []
    starts, ends = np.where(ends > n, np.minimum(starts, n - width), starts), np.where(starts < 0, np.maximum(ends, width), ends)
    starts, ends = np.maximum(starts, 0), np.minimum(ends, n)
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return list(zip(s[new].tolist(), e[last].tolist(), strict=True))


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per row of the documents: id, kept (binary: the remaining bytes), n_bytes, n_removed, n_spans, kept_sha256."""
    rows = docs.select(F.col(id_col).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    repeated = rows.groupBy("own").count().where("count > 1").limit(1).count()
    rows = rows.withColumn("id", F.xxhash64("own", "text") if repeated else F.col("own"))
    spans = saved(covered(rows.select("id", "text"), width, gram).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("spans")))

    @F.arrow_udf("struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out: list[list] = [[], [], [], []]
        for t, f in zip(texts, found, strict=True):
            t = (t.as_py() or "").encode()
            ranges: list[tuple[int, int]] = []
            if f.is_valid:
                v = f.values
                ranges = merge(v.field("start").to_numpy(zero_copy_only=False), v.field("end").to_numpy(zero_copy_only=False), len(t), width)
            kept, at = [], 0
            for s, e in ranges:
                kept.append(t[at:s])
                at = e
            kept.append(t[at:])
            out[0].append(len(t))
            out[1].append(sum(e - s for s, e in ranges))
            out[2].append(len(ranges))
            out[3].append(b"".join(kept))
        return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])

    touched = _only(rows, spans).join(spans, "id")
    whole = _only(rows, spans, not_wanted=True).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    done = touched.select("own", "text", "spans").unionByName(whole.select("own", "text", "spans")).select("own", cut(F.col("text"), F.col("spans")).alias("c"))
    return done.select(F.col("own").alias(id_col), "c.kept", "c.n_bytes", "c.n_removed", "c.n_spans", F.sha2("c.kept", 256).alias("kept_sha256"))
