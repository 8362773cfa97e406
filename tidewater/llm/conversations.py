"""Conversation structure repair: the cheapest edits that bring each conversation into turns of ``(system) (user assistant)+``, or nothing.

Edits and their costs: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty turn of user or assistant 2; a truncated row that
stays costs 1 more, a blank or duplicate row must go. Among the cheapest lists of edits the one of ASCII-least initials is taken: the audit.

**Cost.** A node is a place between rows and one of four states (nothing yet, after s, after u, after a). Costs to the end are computed backwards, many conversations
at a time. Conversations over ``BLOCK`` rows are cut into blocks: first each block's least costs from state to state, then, from the last block
to the first, the costs at the borders, then the nodes of each block.

**Path.** The arcs on cheapest paths make a graph in which each node's arcs have different initials. Nodes are ranked by their least
audit of 1, 2, 4, ... initials: a rank of twice the length comes from the node's rank and that of the node which its doubled pointer reaches. The ranks choose each
node's arc, and doubled pointers over the chosen arcs list the nodes of the least path.

Rows move compactly (a hash for role and text) to be held against equal earlier rows by a join on conversation and hash, and to their
conversation's task, which streams them in order and keeps a byte a row. A second stream of the texts, led by the audit, hashes the repaired
conversation; no task holds a conversation's texts.

Nulls in role and text count as one space; a null conversation is a conversation; null turns come first. Rows of equal turn come in
the order of a hash of role and text; repeated rows follow each other, all but the first being duplicates. A row whose role is empty has no initial and
cannot be kept. A conversation of which no row is left has zeros, an empty audit and the hash of nothing. Other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of a block, and nodes that are worked on together.
BLOCK, TOGETHER = 4096, 1 << 18
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Row classes: 4 * fault + initial, with initials s, u, a, other and faults none, must go, truncated; then the end of a conversation.
END = 12
_FAR = 1 << 40
#: The state after an inserted or reroled turn, which each state leaves no choice of; after a kept turn of each initial (-1: none).
_NEXT = np.array([2, 2, 3, 2])
_KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
#: Initials in ASCII order; 0 is the end.
_LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _tables() -> tuple[np.ndarray, ...]:
    """By row class: the cost of deleting, of keeping in each state, of reroling; the state after keeping."""
    drop, keep, rerole, to = np.full(13, DELETE), np.full((13, 4), _FAR), np.full(13, _FAR), np.zeros((13, 4), np.int64)
    for fault, more in ((0, 0), (2, TRUNCATED)):
        for initial in range(4):
            c = 4 * fault + initial
            rerole[c] = REROLE + more
            keep[c] = np.where(_KEPT[initial] >= 0, KEEP + more, _FAR)
            to[c] = np.maximum(_KEPT[initial], 0)
    drop[END], keep[END] = _FAR, [0, _FAR, _FAR, 0]
    return drop, keep, rerole, to


_DROP, _KEEP, _REROLE, _TO = _tables()


def _before(after: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Costs before a row of each class in ``row``, from those after it (lanes, states, targets)."""
    lane = np.arange(len(row))[:, None]
    cost = np.minimum(after + _DROP[row][:, None, None], after[lane, _TO[row]] + _KEEP[row][:, :, None])
    cost = np.minimum(cost, after[:, _NEXT] + _REROLE[row][:, None, None])
    cost[:, 2:] = np.minimum(cost[:, 2:], cost[:, [3, 2]] + INSERT)
    cost[:, :2] = np.minimum(cost[:, :2], cost[:, 2:3] + INSERT)
    return cost


def _backwards(rows: np.ndarray, ends: np.ndarray, sizes: np.ndarray, last: np.ndarray, keep: bool) -> np.ndarray:
    """Costs at the first place of each lane, or at all places (lane after lane, one more than rows), given those at its last."""
    order = np.argsort(-sizes, kind="stable")
    cost = last[order]
    if keep:
        out = np.empty((len(rows) + len(sizes), *last.shape[1:]), last.dtype)
        places = (ends + np.arange(len(ends)))[order]
        out[places] = cost
    left = np.searchsorted(-sizes[order], -np.arange(1, sizes.max(initial=0) + 1), "right")
    for t, m in enumerate(left.tolist(), 1):
        cost[:m] = _before(cost[:m], rows[ends[order[:m]] - t])
        if keep:
            out[places[:m] - t] = cost[:m]
    if keep:
        return out
    first = np.empty_like(cost)
    first[order] = cost
    return first


@dataclass
class _Graph:
    """The least paths of some lanes: each node's initial, and pointers over 1, 2, 4, ... initials."""

    initial: np.ndarray
    pointers: list[np.ndarray]

    def paths(self, start: np.ndarray) -> np.ndarray:
        """The nodes from each start on, in order; the last one repeats."""
        nodes = start[:, None]
        for pointer in reversed(self.pointers):
            nodes = np.stack([nodes, pointer[nodes]], axis=2).reshape(len(start), -1)
        return nodes


def _doubled(pointer: np.ndarray) -> Iterator[np.ndarray]:
    while True:
        yield pointer
        twice = pointer[pointer]
        if (twice == pointer).all():
            return
        pointer = twice


def _graph(rows: np.ndarray, ends: np.ndarray, sizes: np.ndarray, cost: np.ndarray) -> _Graph:
    lanes = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(rows)) + lanes
    node = place[:, None] * 4 + np.arange(4)
    here, after = cost[place], cost[place + 1]
    ended = rows == END
    kept = np.take_along_axis(after, _TO[rows], axis=1) + _KEEP[rows] == here
    arcs = [  # by initial: which nodes have it on a cheapest path, and where it leads
        (kept & ended[:, None], node - node % 4 + 4 + _TO[rows]),
        (after + _DROP[rows][:, None] == here, node + 4),
        (here[:, _NEXT] + INSERT == here, place[:, None] * 4 + _NEXT),
        (kept & ~ended[:, None], place[:, None] * 4 + 4 + _TO[rows]),
        (after[:, _NEXT] + _REROLE[rows][:, None] == here, place[:, None] * 4 + 4 + _NEXT),
    ]
    at = node.ravel()
    open_ = np.stack([a.ravel() for a, _ in arcs])
    leads = np.stack([np.broadcast_to(t, node.shape).ravel() for _, t in arcs])
    if not open_.any(axis=0).all():
        raise AssertionError("a place without a cheapest edit")
    n = 4 * (len(rows) + len(sizes))
    initial, to = np.zeros(n, np.int64), np.arange(n)
    least = open_.argmax(axis=0)
    initial[at], to[at] = least, leads[least, np.arange(len(at))]
    rank = initial
    for pointer in _doubled(to):
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
    among = np.where(open_, np.arange(5)[:, None] * (rank.max() + 1) + rank[leads], np.iinfo(np.int64).max)
    chosen = among.argmin(axis=0)
    initial[at], to[at] = chosen, leads[chosen, np.arange(len(at))]
    return _Graph(initial, list(_doubled(to)))


def _audits(lanes: list[np.ndarray], last: np.ndarray, starts: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """Costs at each lane's first place and the audit from the state that ``starts`` names, given the state that each state leads to."""
    sizes = np.fromiter(map(len, lanes), np.int64, len(lanes))
    ends, rows = np.cumsum(sizes), np.concatenate(lanes)
    cost = _backwards(rows, ends, sizes, last[:, :, None], True)[:, :, 0]
    graph = _graph(rows, ends, sizes, cost)
    first = ends - sizes + np.arange(len(sizes))
    begin = first[:, None] * 4 + np.arange(4)
    reach = begin
    for pointer in graph.pointers[-1:]:
        reach = pointer[pointer[begin]]
    state = starts(reach % 4)
    letters = _LETTERS[graph.initial[graph.paths(first * 4 + state)]]
    return cost[first], [bytes(x[x > 0]) for x in letters]


def repair(conversations: list[np.ndarray]) -> list[tuple[int, str]]:
    """Least cost and audit of each conversation, given as the classes of its rows."""
    out: list = [None] * len(conversations)
    end, done = np.array([END], np.uint8), np.array([0, _FAR, _FAR, _FAR])
    alike: dict[int, list[int]] = {}
    for k, rows in enumerate(conversations):
        if len(rows) <= BLOCK:
            alike.setdefault(len(rows).bit_length(), []).append(k)
        else:
            out[k] = _repair_long([*np.split(rows, range(BLOCK, len(rows), BLOCK))], end, done)
    for size, members in alike.items():
        step = max(1, TOGETHER >> (size + 2))
        for low in range(0, len(members), step):
            part = members[low : low + step]
            cost, audits = _audits([np.append(conversations[k], end) for k in part], np.tile(done, (len(part), 1)), lambda to: np.zeros(len(to), np.int64))
            for k, c, a in zip(part, cost[:, 0].tolist(), audits, strict=True):
                out[k] = (c, a.decode())
    return out


def _repair_long(blocks: list[np.ndarray], end: np.ndarray, done: np.ndarray) -> tuple[int, str]:
    blocks = [*blocks[:-1], np.append(blocks[-1], end)]
    step = max(1, TOGETHER // (4 * BLOCK))
    groups = [range(k, min(k + step, len(blocks))) for k in range(0, len(blocks), step)]
    own = np.where(np.eye(4, dtype=bool), 0, _FAR)
    between = np.empty((len(blocks), 4, 4), np.int64)
    for g in groups:
        sizes = np.array([len(blocks[k]) for k in g])
        between[g.start : g.stop] = _backwards(np.concatenate([blocks[k] for k in g]), np.cumsum(sizes), sizes, np.tile(own, (len(g), 1, 1)), False)
    last = np.empty((len(blocks), 4), np.int64)
    last[-1] = done
    for k in range(len(blocks) - 1, 0, -1):
        last[k - 1] = np.minimum((between[k] + last[k]).min(axis=1), _FAR)
    state, total, audit = 0, None, []

    def starts(to: np.ndarray) -> np.ndarray:
        nonlocal state
        chosen = np.empty(len(to), np.int64)
        for k, row in enumerate(to.tolist()):
            chosen[k], state = state, row[state]
        return chosen

    for g in groups:
        cost, parts = _audits([blocks[k] for k in g], last[g.start : g.stop], starts)
        total = int(cost[0, 0]) if total is None else total
        audit += parts
    return total, b"".join(audit).decode()


@dataclass
class _Open:
    """A conversation of which more rows may come: what is counted so far and the classes of its rows."""

    key: pa.Array
    stats: np.ndarray = field(default_factory=lambda: np.zeros(5, np.int64))  # distinct turns, then STATS[1:5]
    low: int | None = None
    high: int | None = None
    rows: list = field(default_factory=list)
    turn: int | None = None
    digest: bytes | None = None
    initial: int = 0


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are alike."""
    a, b = column[1:], column[:-1]
    return pc.fill_null(pc.not_equal(a, b), False).to_numpy(False) | (a.is_null().to_numpy(False) != b.is_null().to_numpy(False))


def _audit_tasks(kind: pa.DataType) -> Callable:
    schema = pa.schema([("conv", kind), *((c, pa.int64()) for c in STATS), ("audit", pa.string())])

    def closed(convs: list[_Open]) -> pa.RecordBatch:
        done = repair([np.concatenate(c.rows) if c.rows else np.empty(0, np.uint8) for c in convs])
        stats = [((c.high - c.low + 1 - int(c.stats[0])) if c.low is not None else 0, *c.stats[1:].tolist(), cost) for c, (cost, _) in zip(convs, done, strict=True)]
        columns = [pa.concat_arrays([c.key for c in convs]), *(pa.array(x, pa.int64()) for x in zip(*stats, strict=True)), pa.array([a for _, a in done], pa.string())]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Open | None = None
        for batch in batches:
            if not len(batch):
                continue
            key, live = batch.column(0), batch.column(3).to_numpy(False).astype(bool)
            new = np.concatenate([[True], _changes(key)])
            new[0] = now is None or bool(_changes(pa.concat_arrays([now.key, key[:1]]))[0])
            cut = np.flatnonzero(new)
            of = np.cumsum(new)[live]  # 0: of the conversation that is open
            convs = ([now] if now else [_Open(key[:1])]) + [_Open(key[k : k + 1]) for k in cut]
            keep = pa.array(live)
            turn, digest = batch.column(1).filter(keep), batch.column(2).filter(keep)
            initial = batch.column(4).filter(keep).to_numpy(False).astype(np.int64)
            fault = batch.column(5).filter(keep).to_numpy(False).astype(np.int64)
            for n, (low, high) in enumerate(zip(np.searchsorted(of, np.arange(len(convs))), np.searchsorted(of, np.arange(len(convs)), "right"), strict=True)):
                if high > low:
                    _extend(convs[n], turn[low:high], digest[low:high], initial[low:high], fault[low:high])
            if not now:
                convs = convs[1:]
            if len(convs) > 1:
                yield closed(convs[:-1])
            now = convs[-1]
        if now:
            yield closed([now])

    return run


def _extend(conv: _Open, turn: pa.Array, digest: pa.Array, initial: np.ndarray, fault: np.ndarray) -> None:
    """Add rows that follow those seen so far; faults are 0, 1 blank, 2 duplicate, 3 truncated, as far as turns tell."""
    went_on = bool(conv.rows)
    turn_new = np.concatenate([[not went_on or turn[0].as_py() != conv.turn], _changes(turn)])
    again = ~turn_new & np.concatenate([[went_on and digest[0].as_py() == conv.digest], ~_changes(digest)])
    fault = np.where(again & (fault != 1), 2, fault)
    before = np.concatenate([[conv.initial if went_on else 0], initial[:-1]])
    legal = ((before == 0) & (initial == 1)) | ((before == 1) & (initial == 2)) | ((before == 2) & (initial == 1))
    legal[0] |= not went_on
    known = ~turn.is_null().to_numpy(False)
    conv.stats += [(turn_new & known).sum(), (fault == 1).sum(), (fault == 2).sum(), (fault == 3).sum(), (~legal).sum()]
    if known.any():
        ends = pc.min_max(turn).as_py()
        conv.low = ends["min"] if conv.low is None else min(conv.low, ends["min"])
        conv.high = ends["max"] if conv.high is None else max(conv.high, ends["max"])
    conv.rows.append((4 * np.array([0, 1, 1, 2])[fault] + initial).astype(np.uint8))
    conv.turn, conv.digest, conv.initial = turn[-1].as_py(), digest[-1].as_py(), int(initial[-1])


class _Repaired:
    """Hashes one conversation's repaired turns as its rows come."""

    def __init__(self, key: pa.Array, head: list):
        self.key, self.head, self.audit, self.at, self.out = key, head, head[-1] or "", 0, 0
        self.odd = (len(self.audit) - self.audit.count("D")) % 2
        self.hash, self.parts = hashlib.sha256(), []

    def _put(self, role: str | None, text: str) -> None:
        role = role if role is not None else ("user", "assistant")[(self.out - self.odd) % 2]
        self.parts.append(f"\n{role}:{text}" if self.out else f"{role}:{text}")
        self.out += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter != "D":
            self._put(role if letter == "K" else None, text)

    def inserted(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._put(None, "")
            self.at += 1

    def flush(self) -> None:
        self.hash.update("".join(self.parts).encode())
        self.parts = []

    def result(self) -> list:
        self.inserted()
        self.flush()
        if self.at != len(self.audit):
            raise AssertionError("audit and rows differ")
        return [*self.head, self.hash.hexdigest()]


def _hash_tasks(kind: pa.DataType) -> Callable:
    names = [*STATS, "audit", "repaired_sha256"]
    schema = pa.schema([("conv", kind), *((c, pa.int64()) for c in STATS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def batch_of(done: list[_Repaired]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays([d.key for d in done]), *(pa.array(x, schema.field(n).type) for n, x in zip(names, zip(*(d.result() for d in done), strict=True), strict=True))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            heads, roles, texts = batch.column("head").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()
            for k, (head, role, text) in enumerate(zip(heads, roles, texts, strict=True)):
                if head is not None:
                    if now:
                        done.append(now)
                    now = _Repaired(batch.column("conv")[k : k + 1], list(head.values()))
                else:
                    now.row(role, text)
            if now:
                now.flush()
            if done:
                yield batch_of(done)
        if now:
            yield batch_of([now])

    return run


def _key(conv: Column, turn: Column) -> Column:
    return F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` and ``copies`` (0: dropped) of each row, damaged by a hash of conversation and turn."""
    code = F.crc32(_key(F.col(conv), F.col(turn)).cast("binary")) % 20
    filled = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), code.alias("code"))
    return filled.select(
        "conv",
        "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"),
    )


def whole(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as ``damage`` gives them, undamaged."""
    return rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows as ``damage`` gives them: conv, the faults' counts, cost and audit."""
    text = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    compact = rows.select(
        "conv",
        "turn",
        _digest().alias("digest"),
        (F.col("copies") > 0).alias("live"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
        F.when(text == "", 1).when(F.substring(text, -1, 1).isin(".", "!", "?"), 0).otherwise(3).alias("fault"),
        F.explode(F.array_repeat(F.lit(0), F.greatest("copies", F.lit(1)))).alias("copy"),
    ).drop("copy")
    at = F.struct(F.col("turn").isNotNull(), "turn")
    twice = compact.where("live and fault <> 1").groupBy(F.col("conv").alias("c"), F.col("digest").alias("d")).agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("c", "d", "first")
    told = compact.join(twice, F.col("conv").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    later = F.col("first").isNotNull() & (at > F.col("first")) & (F.col("fault") != 1) & F.col("live")
    told = told.select("conv", "turn", "digest", "live", "initial", F.when(later, 2).otherwise(F.col("fault")).alias("fault"))
    kind = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), *(T.StructField(c, T.LongType()) for c in STATS), T.StructField("audit", T.StringType())])
    dealt = told.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "digest")
    return dealt.mapInArrow(_audit_tasks(to_arrow_type(kind)), schema)


def repaired(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What ``audits`` gives and the hash of each conversation's repaired turns (``role:text``, joined by newlines)."""
    heads = audits(rows).select("conv", F.struct(*STATS, "audit").alias("head"))
    turns = rows.where("copies > 0").select("conv", "turn", _digest().alias("digest"), "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).drop("copy")
    both = heads.unionByName(turns, allowMissingColumns=True).select("conv", "head", "turn", "digest", "role", "text")
    kind = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), *(T.StructField(c, T.LongType()) for c in STATS), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    dealt = both.repartition("conv").sortWithinPartitions("conv", F.col("head").isNull(), F.col("turn").asc_nulls_first(), "digest")
    return dealt.mapInArrow(_hash_tasks(to_arrow_type(kind)), schema).withColumnRenamed("conv", conv)
