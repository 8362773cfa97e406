"""N-gram Jaccard join with filters under several global token orders.

A document's set holds the hashes of its word shingles. Two sets can only be similar if, under every global order of
the tokens, their prefixes share a token. The first order (by hash) is applied to the whole corpus: a document
stays a candidate only if enough of its lengthened prefix is shared (a prefix longer by k - 1 must share k).
Survivors' whole sets are counted against each other, and only those that share enough tokens go on. Candidate pairs
share a prefix token under the first order; pairs whose prefixes under the second or third do not meet go before any whole
set is read, and only the rest have their exact similarity taken.

Groups of near copies are not expanded into all pairs: each member is first verified against its groups' most central
members; components form, and only links across components are still looked for (``_across``), so no link
between components is lost. Equal sets are one class from the start.

Null, empty and wordless texts have no shingles and link with nothing. Fewer words than a shingle: the whole
sequence is the one shingle. Ids are longs; every row of a repeated id has a result row of its own, by its own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import bytesops as B
from tidewater.llm.common import drop_saved, release, saved
from tidewater.llm.setjoin import BROADCAST_IDS, MAPS, components, differences, may_be_similar, meeting_points, prefix_length, shared_counts

ORDERS = (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: Tokens, in percent of a set, by which the first prefix is lengthened.
LONGER = 6


def _sets(texts: pa.Array, size: int):
    for _, raw, offsets in B.text_slices(texts):
        data = B.ascii_lower(raw)
        starts, ends, first = B.words(data, offsets)
        h = B.span_hash(B.prefix_hash(data), starts, ends) if len(starts) else np.empty(0, np.uint64)
        for d in range(len(offsets) - 1):
            yield np.unique(B.shingles(h, first[d], first[d + 1], size))


def _extra(n, percent: int):
    return np.maximum(1, n * LONGER // 100) if not isinstance(n, Column) else F.greatest(F.lit(1), F.floor(n * LONGER / 100))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(offsets, pa.array(values.view(np.int64)))


def _class(s: np.ndarray) -> int:
    """A non-negative hash of a whole set; the empty set has 0."""
    return int(B.mix(np.array([s.sum(dtype=np.uint64) ^ np.uint64(len(s))]))[0] >> np.uint64(1)) if len(s) else 0


def sketch(text: Column, size: int, percent: int) -> Column:
    """Set size, set hash and lengthened prefix under the first order."""

    @F.arrow_udf("struct<n:bigint,cls:bigint,pre:array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        n, cls, pre = [], [], []
        for s in _sets(texts, size):
            n.append(len(s))
            cls.append(_class(s))
            pre.append(s[: prefix_length(len(s), percent) + int(_extra(len(s), percent)) - 1] if len(s) else s)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(cls, pa.int64()), _lists(pre)], ["n", "cls", "pre"])

    return run(text)


def whole(text: Column, size: int, percent: int) -> Column:
    """The whole set, its hash and its prefixes under each order."""

    @F.arrow_udf("struct<cls:bigint,tok:array<bigint>,p0:array<bigint>,p1:array<bigint>,p2:array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        cols: list[list] = [[], [], [], []]
        cls = []
        for s in _sets(texts, size):
            cls.append(_class(s))
            cols[0].append(s)
            p = prefix_length(len(s), percent) if len(s) else 0
            cols[1].append(s[:p])
            for k in (1, 2):
                cols[k + 1].append(np.sort(s[np.argsort(B.mix(s ^ np.uint64(ORDERS[k])))[:p]]))
        return pa.StructArray.from_arrays([pa.array(cls, pa.int64()), *[_lists(c) for c in cols]], ["cls", "tok", "p0", "p1", "p2"])

    return run(text)


def _share_prefixes(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) whose prefixes meet under the second and third order too; only prefixes are read."""
    left = sets.select(F.col("id").alias("a"), F.col("p1").alias("a1"), F.col("p2").alias("a2"))
    right = sets.select(F.col("id").alias("b"), F.col("p1").alias("b1"), F.col("p2").alias("b2"))
    met = pairs.join(left, "a").join(right, "b").where(F.arrays_overlap("a1", "b1") & F.arrays_overlap("a2", "b2"))
    return met.select("a", "b")


def _pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with both sets beside them and ``common``, their intersection's size."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("a_n"), F.col("tok").alias("a_tok"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("b_n"), F.col("tok").alias("b_tok"))
    return pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("a_tok", "b_tok")))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs that pass all filters and are similar enough."""
    found = _pairs(_share_prefixes(pairs, sets), sets)
    return found.where(F.col("common") * 100 >= (F.col("a_n") + F.col("b_n") - F.col("common")) * percent).select("a", "b")


def _groups(held: DataFrame, key: list[str]) -> DataFrame:
    """Groups of a key that hold members of several components, with the most frequent one (``main``)."""
    return held.groupBy(*key).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.mode("component").alias("main")).where("lo <> hi").select(*key, "main")


def _across(held: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that cross components, found by what documents differ in from their group's centre (``differences``).

    ``held``: rows (id, n, t, w, component). The centre of a group is the most central member of its main component.
    """
    mixed = saved(held.join(_groups(held, ["t"]), "t"))
    lead = mixed.where("component = main").groupBy("t").agg(F.max(F.struct("w", (-F.col("id")).alias("i"))).alias("c")).select("t", (-F.col("c.i")).alias("r"))
    near = mixed.join(lead, "t").select("id", "r", "component", (F.col("component") == F.col("main")).alias("inside")).distinct()
    told = differences(near, sets, percent)
    links = saved(told.where("near and not inside").select(F.col("id").alias("a"), F.col("r").alias("b")))
    post = meeting_points(told, ["component"])
    met = post.join(_groups(post, ["h"]), "h")
    out = met.where("component <> main").select(F.col("h").alias("xh"), *[F.col(c).alias(f"x_{c}") for c in ("id", "component", "n", "d", "s", "p", "before", *MAPS)])
    once = (F.col("component") == F.col("main")) | (F.col("x_id") < F.col("id"))
    cross = out.join(met, (F.col("h") == F.col("xh")) & (F.col("component") != F.col("x_component")) & once & may_be_similar(percent)).select("x_id", "id")
    # Whatever is far from its group's centre meets those that are away from it under the group's token.
    placed = saved(mixed.join(lead, "t").select("id", "t", "r", "n", "component").join(told.where("away").select("id", "r", "far"), ["id", "r"]).select("id", "t", "n", "component", "far").join(sets.select("id", "shared"), "id"))
    far = placed.where("far").select("t", *[F.col(c).alias(f"x_{c}") for c in ("id", "n", "component", "shared")])
    low = F.least("shared", "x_shared")
    can = (low * 100 >= (F.col("n") + F.col("x_n") - low) * percent) & (F.col("n") * 100 >= F.col("x_n") * percent) & (F.col("x_n") * 100 >= F.col("n") * percent)
    direct = far.withColumnRenamed("t", "xt").join(placed, (F.col("t") == F.col("xt")) & (F.col("component") != F.col("x_component")) & (~F.col("far") | (F.col("x_id") < F.col("id"))) & can)
    cross = saved(cross.unionByName(direct.select("x_id", "id")).select(F.least("x_id", "id").alias("a"), F.greatest("x_id", "id").alias("b")).distinct())
    for used in (told, post, placed, mixed):
        drop_saved(used)
    return links.unionByName(saved(_linked(cross, sets, percent)))


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """``(members, edges)``: (id, n, cls) of every row, and verified links (a, b) between classes that connect
    whatever any link connects. A class holds all documents of one set.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = saved(rows.select("id", sketch(F.col("text"), size, percent).alias("s")).select("id", "s.n", "s.cls", "s.pre"))
    some = base.where("n > 0")
    classes = some.groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    found = shared_counts(some, "cls", "pre")
    alive = saved(classes.join(found, "cls").where(F.col("shared") >= _extra(F.col("n"), percent)).select("cls", "rep"))
    members = saved(base.select("id", "n", "cls"))
    drop_saved(base)
    few = F.broadcast if alive.count() <= BROADCAST_IDS else (lambda d: d)
    sets = rows.join(few(alive), F.col("id") == F.col("rep")).select(F.col("cls").alias("id"), whole(F.col("text"), size, percent).alias("s")).where("s.cls = id")
    sets = sets.select("id", F.size("s.tok").alias("n"), "s.tok", "s.p0", "s.p1", "s.p2")
    if members.groupBy("id", "cls").count().where("count > 1").limit(1).count():  # repeated rows of one id
        sets = sets.dropDuplicates(["id"])
    sets = saved(sets)
    # Tokens that no other survivor has cannot be common. Twice: what goes makes more tokens unshared.
    held = sets
    for _ in range(2):
        full = saved(shared_counts(held, "id", "tok").withColumnRenamed("cls", "id"))
        held = held.drop("shared").join(few(full), "id").where(F.col("shared") * 100 >= F.col("n") * percent)
    held = saved(held)
    drop_saved(sets)
    sets = held
    release(docs.sparkSession)
    post = saved(sets.select("id", "n", F.explode("p0").alias("t")))
    # The most central member of a token's group has the most frequent tokens.
    often = post.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    central = post.join(often, "t").groupBy("id").agg(F.sum(F.log("c")).alias("w"))
    post = saved(post.join(often.select("t"), "t").join(central, "id").withColumn("w", F.col("w") / F.col("n")))
    edges, comp, done = None, post.select("id", F.col("id").alias("component")).distinct(), None
    for k in range(rounds):
        held = post.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
        open_ = saved(held.join(_groups(held, ["t"]), "t"))
        if k and not open_.limit(1).count():
            return members, edges
        # Later rounds take the centre of the largest component, and members outside it.
        inside = F.lit(True) if k == 0 else F.col("component") == F.col("main")
        lead = open_.where(inside).groupBy("t").agg(F.max(F.struct("w", (-F.col("id")).alias("i"), "n")).alias("c"))
        outside = open_ if k == 0 else open_.where("component <> main")
        star = outside.join(lead.select("t", (-F.col("c.i")).alias("r"), F.col("c.n").alias("rn")), "t").where(F.col("id") != F.col("r"))
        star = star.where((F.col("rn") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("rn") * percent)).select(F.col("id").alias("a"), F.col("r").alias("b")).distinct()
        if done is not None:
            star = star.join(done, ["a", "b"], "left_anti")
        star = saved(star)
        done = star if done is None else done.unionByName(star)
        fresh = saved(_linked(star, sets, percent))
        edges = fresh if edges is None else edges.unionByName(fresh)
        comp = components(edges)
        release(docs.sparkSession)
    held = post.join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return members, edges.unionByName(saved(_across(held, sets, percent)))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id reachable by links, itself included)."""
    members, edges = links(docs, id_col, text_col, size, percent)
    comp = components(edges).withColumnRenamed("id", "cls")
    reps = members.where("n > 0").groupBy("cls").agg(F.min("id").alias("rep"))
    held = saved(reps.join(comp, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    least = held.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = held.join(least, "component").select("cls", "component_id")
    out = members.join(named, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those whose group has a smaller id, all columns kept. All rows of a repeated id go if one goes."""
    found = join(docs, id_col, text_col, size, percent)
    gone = found.where(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
