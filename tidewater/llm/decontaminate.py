"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks, in DataFrame functions only.

A window can only be similar to an item if they share one of the item's heaviest shingles: those that make up all but what
the threshold asks for (a weighted prefix). Where a document has such a shingle, windows as long as the item are laid around it, shifted so that any
shingle which both have falls in the same place. Each window gets a 64-bit weighted SimHash. The index holds the
fingerprints of the items in four blocks of 16 bits; a window looks up the items that its shingles name, and by the pigeonhole
principle each pair within 23 bits has a block within 5. Candidates within the radius are verified by exact weighted Jaccard similarity
of their shingles (weight: inverse of the number of different item texts that have the shingle). Words are lower-cased runs of non-space characters.

Null and empty texts, of documents or of items, match nothing. A text shorter than a shingle is one shingle. Rows that repeat an
id are judged by their own texts; every item that a document holds is named; texts of any length are read whole; empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import ascii_lower, free, let, saved

SPACE = r"[\x20\x09-\x0D]+"
BLOCKS, BITS, FLIPS = 4, 16, 5
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Rows of a table that is broadcast at most; larger ones are joined by shuffling.
BROADCAST_ROWS = 400_000
UNIT = 1000


def _shingles(text: Column, size: int) -> Column:
    w = F.filter(F.split(ascii_lower(text), SPACE), lambda x: x != "")
    return let(
        w,
        lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))).otherwise(F.array().cast("array<bigint>")),
    )


def _fingerprint(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted SimHash of (keys, h, weight) rows."""
    bits = [F.sum(F.when(F.shiftright("h", b).bitwiseAND(1) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"s{b}") for b in range(64)]
    sums = rows.groupBy(*keys).agg(*bits, F.sum("weight").alias("mass"))
    word = F.lit(0).cast("long")
    for b in range(64):
        word = word.bitwiseOR(F.when(F.col(f"s{b}") > 0, F.lit((1 << b) - ((1 << 64) if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, word.alias("fp"), "mass")


def _block(fp: Column, b: int) -> Column:
    return F.shiftright(fp, b * BITS).bitwiseAND((1 << BITS) - 1).cast("int")


def _near(fp: Column, other: Column) -> Column:
    """Whether two fingerprints are within the radius: some block within FLIPS bits, then all 64."""
    block = F.lit(False)
    for b in range(BLOCKS):
        block = block | (F.bit_count(_block(fp, b).bitwiseXOR(_block(other, b))) <= FLIPS)
    return block & (F.bit_count(fp.bitwiseXOR(other)) <= RADIUS)


def _heaviest(cells: DataFrame, similarity: float) -> DataFrame:
    """Of each item's shingles (unit, h, weight) those without which the rest has too little mass for the similarity."""
    rest = F.sum("weight").over(Window.partitionBy("unit").orderBy(F.asc("weight"), F.desc("h")))  # this shingle and all lighter ones
    total = F.sum("weight").over(Window.partitionBy("unit"))
    return cells.withColumns({"rest": rest, "total": total}).where(F.col("rest") + 1e-6 >= F.col("total") * similarity).select("unit", "h")


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows (id, rh, item, similarity): the best window of each document for each item it contains; ``rh`` is the hash of its text."""
    # Equal items are one unit.
    item_sh = items.select(F.col(item_col).alias("item"), _shingles(F.col(item_text_col), size).alias("hs")).where(F.size("hs") > 0)
    named = saved(item_sh.select("item", F.xxhash64("hs").alias("unit"), "hs"))
    units = named.groupBy("unit").agg(F.first("hs").alias("hs"))
    spots = units.select("unit", F.xxhash64(F.array_sort(F.array_distinct("hs"))).alias("key"), F.size("hs").alias("len"), F.posexplode("hs").alias("o", "h"))
    rarity = spots.groupBy("h").agg((F.lit(UNIT) / F.count_distinct("key")).cast("int").alias("weight"))
    spots = saved(spots.join(rarity, "h").withColumn("weight", F.greatest("weight", F.lit(1))))
    few = spots.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda d: d)
    unit_cells = spots.select("unit", "h", "weight").distinct()
    # Seeds: stretches, as long as an item, in which a document has one of its heaviest shingles. Rows are told apart by id and text.
    row = ["id", "rh"]
    seen = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("rh"), F.col(text_col).alias("text"))
    heavy = saved(_heaviest(unit_cells, similarity).join(spots.select("unit", "len").distinct(), "unit"))
    seeds = seen.select(*row, F.posexplode(_shingles(F.col("text"), size)).alias("p", "h")).join(small(heavy), "h")
    seeds = saved(seeds.select(*row, "unit", "len", F.floor(F.col("p") / F.col("len")).cast("int").alias("k")).distinct())
    rows = seeds.select(*row).distinct()
    held = saved(seen.join(F.broadcast(rows) if seeds.count() <= BROADCAST_ROWS else rows, row, "left_semi").dropDuplicates(row).select(*row, _shingles(F.col("text"), size).alias("hs")))
    # All windows that hold a seed lie in its stretch and the two beside it; each is laid where a shingle of the item falls in place.
    first = F.greatest((F.col("k") - 1) * F.col("len"), F.lit(0))
    around = held.join(seeds, row).select(*row, "unit", "len", first.alias("first"), F.slice("hs", first + 1, F.col("len") * 3).alias("part"))
    around = around.select(*row, "unit", "len", "first", F.posexplode("part").alias("p", "h")).join(small(spots.select("unit", "h", "o")), ["unit", "h"])
    laid = saved(around.select(*row, "unit", "len", F.greatest(F.col("first") + F.col("p") - F.col("o"), F.lit(0)).alias("at")).distinct())
    window = [*row, "at", "len"]
    windows = held.join(laid.select(*window).distinct(), row).select(*window, F.array_distinct(F.slice("hs", F.col("at") + 1, F.col("len"))).alias("win"))
    weights = spots.select("h", "weight").distinct()
    cells = saved(windows.select(*window, F.explode("win").alias("h")).join(small(weights), "h", "left").withColumn("weight", F.coalesce("weight", F.lit(UNIT))))
    prints = _fingerprint(cells, window)
    index = _fingerprint(unit_cells, ["unit"]).select("unit", F.col("fp").alias("unit_fp"), F.col("mass").alias("unit_mass"))
    near = laid.join(prints, window).join(small(index), "unit").where(_near(F.col("fp"), F.col("unit_fp"))).select(*window, "mass", "unit", "unit_mass")
    shared = near.join(cells, window).join(small(unit_cells.select("unit", "h")), ["unit", "h"]).groupBy(*window, "unit", "mass", "unit_mass").agg(F.sum("weight").alias("both"))
    sim = F.col("both") / (F.col("mass") + F.col("unit_mass") - F.col("both"))
    best = shared.select(*row, "unit", sim.alias("similarity")).where(F.col("similarity") >= similarity).groupBy(*row, "unit").agg(F.max("similarity").alias("similarity"))
    return best.join(named.select("unit", "item"), "unit").groupBy(*row, "item").agg(F.max("similarity").alias("similarity"))


def report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of the documents: id, contaminated, item_ids (sorted), max_similarity (0 if none)."""
    row = ["id", "rh"]
    found = matches(docs, items, id_col, text_col, **options).groupBy(*row).agg(F.array_sort(F.collect_set("item")).alias("item_ids"), F.max("similarity").alias("max_similarity"))
    out = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("rh")).join(found, row, "left")
    return out.select(F.col("id").alias(id_col), F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("max_similarity", F.lit(0.0)).alias("max_similarity"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    bad_id, bad_rh = free(docs.columns, "bad_id", "bad_rh")
    bad = matches(docs, items, id_col, text_col, **options).select(F.col("id").alias(bad_id), F.col("rh").alias(bad_rh)).distinct()
    return docs.join(bad, (docs[id_col] == bad[bad_id]) & (F.xxhash64(docs[text_col]) == bad[bad_rh]), "left_anti")
