"""Building blocks of the exact set-similarity joins: token sets, shared-token counts, components.

Tokens are 64-bit hashes. ``shared_counts`` tells how many of a set's (prefix) tokens some other class of
sets has too. Each task sorts its own tokens first: a token that two of its own classes share is settled there and
shipped once, so a token of a third of all rows sends one entry per task. Entries travel as packed buckets of a token range,
whose number follows the count of tokens, so each bucket has a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import drop_saved, saved

#: Tokens that a task sorts at once, tokens a bucket is meant to hold, and buckets at least.
FLUSH, BUCKET, LEAST = 500_000, 500_000, 32
#: Stands for any class where a token is known to be shared.
SETTLED = -(1 << 63)
#: Ids that are broadcast at most; more are joined by shuffling.
BROADCAST_IDS = 500_000


def prefix_length(n: np.ndarray | int, percent: int):
    """Tokens of which a set of n must share one with any set of Jaccard similarity >= percent / 100."""
    return n - (-(-n * percent // 100)) + 1


def _pack(token: np.ndarray, klass: np.ndarray, buckets: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Rows (bucket, tokens, classes) of one sorted run, and its local counts by class."""
    order = np.lexsort((klass, token))
    token, klass = token[order], klass[order]
    # Equal sets of one class are one set.
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (klass[1:] != klass[:-1])])
    token, klass = token[new], klass[new]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(first, len(token)))
    here = np.repeat(size > 1, size)
    own, n = np.unique(klass[here], return_counts=True)
    lead = first[size > 1]
    # A settled token goes out once, under no class; that tells the others that it is shared.
    t = np.concatenate([token[~here], token[lead]])
    k = np.concatenate([klass[~here], np.full(len(lead), SETTLED, np.int64)])
    bucket = (t >> np.uint64(40)).astype(np.int64) * buckets >> 24
    order = np.argsort(bucket, kind="stable")
    bucket, t, k = bucket[order], t[order], k[order]
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(cuts[1:], len(bucket))
    return [(int(bucket[a]), t[a:z].tobytes(), k[a:z].tobytes()) for a, z in zip(cuts, ends, strict=True)], own, n


def shared_counts(sets: DataFrame, class_col: str, tokens_col: str, total: int | None = None) -> DataFrame:
    """Rows (cls, shared): how many of a class's tokens another class has too, for classes with any.

    Equal sets have one class, a long. Copies in several tasks may count a token more than once: the result is an
    upper bound, and exact where each class is one row.
    """
    if total is None:
        total = sets.agg(F.sum(F.size(tokens_col))).first()[0] or 0
    buckets = int(max(LEAST, -(-total // BUCKET)))

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n = turn = 0

        def flush():
            rows, own, cnt = _pack(*(np.concatenate([h[k] for h in held]) for k in range(2)), buckets)
            held.clear()
            rows.append((-1 - turn % buckets, own.tobytes(), cnt.astype(np.int64).tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["bucket", "t", "k"])

        for b in batches:
            lists = b.column(1)
            size = np.diff(lists.offsets.to_numpy())
            token = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            held.append((token, np.repeat(b.column(0).to_numpy(zero_copy_only=False), size)))
            turn = turn or int(token[0] % np.uint64(1 << 30)) if len(token) else turn
            n += len(token)
            if n >= FLUSH:
                yield from flush()
                n, turn = 0, turn + 1
        if n:
            yield from flush()

    def meet(table: pa.Table) -> pa.Table:
        t, k = (np.frombuffer(b"".join(table.column(c).to_pylist()), dt) for c, dt in (("t", np.uint64), ("k", np.int64)))
        if table.column("bucket")[0].as_py() < 0:  # local counts
            return pa.table({"cls": pa.array(t.view(np.int64)), "shared": pa.array(k)})
        order = np.lexsort((k, t))
        t, k = t[order], k[order]
        first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        last = np.append(first[1:], len(t)) - 1
        # Shared: two classes, or settled somewhere.
        mixed = (k[first] != k[last]) | (k[first] == SETTLED)
        here = np.repeat(mixed, last - first + 1) & (k != SETTLED)
        own, cnt = np.unique(k[here], return_counts=True)
        return pa.table({"cls": pa.array(own, pa.int64()), "shared": pa.array(cnt.astype(np.int64))})

    packed = sets.select(class_col, tokens_col).mapInArrow(ship, "bucket int, t binary, k binary")
    return packed.groupBy("bucket").applyInArrow(meet, "cls long, shared long").groupBy("cls").agg(F.sum("shared").alias("shared"))


#: 64-bit maps of the parities of a difference's tokens.
MAPS = ("m0", "m1", "m2", "m3", "m4", "m5", "m6", "m7")
#: Tokens that a meeting point knows of those before it.
BEFORE = 8


def _maps(diff: str) -> dict[str, Column]:
    """The bits of two maps that differ are at most as many as the tokens that only one of the differences has."""

    def lane(k: int) -> Column:
        bit = lambda acc, t: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(t, F.lit(64)).cast("int")))
        return F.aggregate(F.filter(diff, lambda t: F.shiftrightunsigned(t, 50).bitwiseAND(len(MAPS) - 1) == k), F.lit(0).cast("long"), bit)

    return {m: lane(k) for k, m in enumerate(MAPS)}


def differences(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """What members of a group differ in from its centre, and how much of it any partner asks them to share.

    ``near``: rows (id, r, inside, ...) of members and the centre of their group; ``sets``: (id, n, tok). With d(x) the size of the
    difference of x and its centre c, and q = (100 - percent) / (100 + percent): two sets are similar where they differ in
    q (|x| + |y|) tokens at most, so their differences from c must share (d(x) + d(y) - q (|x| + |y|)) / 2
    tokens or more. A set that is not similar to c has d(x) > q (|x| + |c|), which makes that at least one for any
    partner. ``least`` is that bound for the best partner; sets that are ``inside`` or ``near`` c need only look for partners that are neither.

    A ``far`` set, which differs in more than half of both, has no ``diff``: it says more about c than about the set. As
    d is a distance, whatever is similar to a far set is ``away``.
    """
    less, more = 100 - percent, 100 + percent
    own = sets.select("id", "n", "tok")
    centre = sets.select(F.col("id").alias("r"), F.col("n").alias("rn"), F.col("tok").alias("rtok"))
    told = near.where("id <> r").join(own, "id").join(centre, "r").withColumn("diff", F.concat(F.array_except("tok", "rtok"), F.array_except("rtok", "tok"))).drop("tok", "rtok")
    told = told.withColumn("d", F.size("diff")).withColumn("near", F.col("d") * more <= (F.col("n") + F.col("rn")) * less)
    asked = F.when(F.col("inside") | F.col("near"), F.col("d") * more + (F.col("rn") - F.col("n")) * less).otherwise(F.col("d") * more - (F.col("n") + F.col("rn")) * less)
    both, q = F.col("n") + F.col("rn"), less / more
    away = (0.5 - q) * percent / 100 - q - 1e-9
    told = told.withColumn("least", F.greatest(F.lit(1), F.ceil(asked / (2 * more)))).withColumns({"far": F.col("d") * 2 > both, "away": F.col("d") >= both * away})
    return saved(told.withColumn("diff", F.when(~F.col("far"), F.transform("diff", lambda x: F.xxhash64("r", x)))).withColumn("key", F.xxhash64("id", "r")))


def meeting_points(told: DataFrame, keep: list[str]) -> DataFrame:
    """Prefixes of differences of sets that are not far: rows (h, p, s, n, d, id, before, keep), h a token that differs from the centre, at place p of s in order of rarity, and the last tokens ``before`` it.

    Differences that no other member has cannot be shared; members that cannot share as many as any partner asks for go first.
    """
    live = told.where(~F.col("far") & (F.col("d") >= F.col("least"))).select("key", "id", *keep, "n", "d", "least", "diff")
    for turn in range(2):  # what goes makes more of them unshared
        before = live
        live = saved(live.drop("s").join(shared_counts(live, "key", "diff").select(F.col("cls").alias("key"), F.col("shared").alias("s")), "key").where("s >= least"))
        if turn:
            drop_saved(before)
    spread = live.select("key", "id", *keep, "n", "d", "least", F.explode("diff").alias("h"))
    often = spread.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    ranked = spread.join(often, "h").groupBy("key", "id", *keep, "n", "d", "least").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("l"))
    ranked = ranked.withColumn("s", F.size("l")).where("s >= least").join(live.select("key", *[m.alias(k) for k, m in _maps("diff").items()]), "key")
    prefix = F.slice("l", F.lit(1), (F.col("s") - F.col("least") + 1).cast("int"))
    out = ranked.select("id", *keep, "n", "d", "s", *MAPS, "l", F.posexplode(prefix).alias("p", "x"))
    last = F.slice("l", F.greatest(F.lit(1), F.col("p") - BEFORE + 1), F.least("p", F.lit(BEFORE)))
    out = saved(out.withColumns({"h": F.col("x.h"), "before": F.transform(last, lambda x: x["h"])}).drop("x", "l"))
    drop_saved(live)
    return out


def may_be_similar(percent: int) -> Column:
    """Of two meeting points (the other's columns begin with x_): length filter, and whether they can differ in few enough tokens.

    A pair has only to be found at the first token that it shares: there, it shares none of those before. Points that are seen to share an earlier one are no match.
    """
    have = F.least(F.col("s") - F.col("p"), F.col("x_s") - F.col("x_p"))
    fits = (F.col("n") * 100 >= F.col("x_n") * percent) & (F.col("x_n") * 100 >= F.col("n") * percent)
    most = (F.col("n") + F.col("x_n")) * (100 - percent)
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"x_{m}"))) for m in MAPS[1:]), F.bit_count(F.col(MAPS[0]).bitwiseXOR(F.col(f"x_{MAPS[0]}"))))
    return fits & ((F.col("d") + F.col("x_d") - 2 * have) * (100 + percent) <= most) & (apart * (100 + percent) <= most) & ~F.arrays_overlap("before", "x_before")


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Rows (id, component): the smallest id reachable over (a, b) edges, for ids that have an edge.

    Each round takes the least label among the neighbours, gives it to the old root too, so that whole trees
    meet, and then follows labels once more. Rounds grow with the logarithm of a chain's length; labels that have not settled
    after ``limit`` rounds are an error.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")))
    for _ in range(limit):
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        step = saved(label.join(near, label["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "m").alias("component")))
        # A root takes the least label that any of its members has found.
        hook = step.groupBy("old").agg(F.min("component").alias("hook")).where("hook < old").withColumnRenamed("old", "top")
        step = saved(step.join(hook, step["id"] == hook["top"], "left").select("id", "old", F.least("component", F.coalesce("hook", "component")).alias("component")))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("root"))
        step = saved(step.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("root", "component")).alias("component")))
        changed = step.where("component <> old").limit(1).count()
        label = step.select("id", "component")
        if not changed:
            return label
    raise RuntimeError(f"components have not settled after {limit} rounds")
