"""Mixing sources to target weights by temperature.

Token shares p of the sources are raised to an exponent a and normalised. The exponent is bisected: the largest a
whose mixture reaches the target entropy (a share of the uniform one), then raised if some source would be repeated more
often than the limit. Each source then gets budget x weight tokens: whole epochs, and of one more epoch
the first blocks of a seeded permutation of its blocks, up to the budget.

Prefix sums run over 4096 slices of each source's permutation, and over documents only within the one slice where the
budget ends, so no task sees a whole source. Each epoch has a permutation of its own: ``turns`` holds a document's place for each of its copies, a seeded hash
of epoch and block, and ``turn`` that of the epoch which the budget cuts. Sorted by it, blocks of all sources come interleaved, and a block's documents stand together. Null sources
form the source ''; tokens are words, and documents without words count one token; rows that repeat an id and a text are one unit of all their tokens, so that the budget counts
each; an empty table gives an empty result.
Where no exponent meets both targets, the repetition limit goes before the entropy, and at the natural shares (exponent 1) no source
repeats more than another: ``met`` tells which targets hold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import free, saved

SLICES = 4096
SPACE = r"[\x20\x09-\x0D]+"


def mixture(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    total = sum(tokens.values())
    raw = {s: math.exp(exponent * math.log(t / total)) for s, t in tokens.items()}
    mass = math.fsum(raw.values())
    return {s: r / mass for s, r in raw.items()}


def solve(tokens: dict[str, int], budget: int, entropy: float, max_repeats: float) -> float:
    """The exponent in 0 to 1: as near to the natural shares as the target entropy allows, within the repetition limit."""
    if len(tokens) < 2:
        return 1.0
    want = entropy * math.log(len(tokens))

    def enough(a: float) -> bool:
        return -math.fsum(w * math.log(w) for w in mixture(tokens, a).values() if w > 0) >= want

    def repeats_ok(a: float) -> bool:
        return max(w * budget / tokens[s] for s, w in mixture(tokens, a).items()) <= max_repeats

    def bisect(ok, low: float, high: float) -> float:
        """ok(low) holds, ok(high) does not."""
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if ok(mid) else (low, mid)
        return low

    a = 1.0 if enough(1.0) else bisect(enough, 0.0, 1.0)
    if not repeats_ok(a):
        a = 1.0 if not repeats_ok(1.0) else bisect(repeats_ok, 1.0, a)
    return a


def met(tokens: dict[str, int], budget: int, entropy: float, max_repeats: float) -> dict[str, bool]:
    """Whether the mixture reaches the target entropy, and whether it keeps the repetition limit."""
    w = mixture(tokens, solve(tokens, budget, entropy, max_repeats))
    reached = -math.fsum(x * math.log(x) for x in w.values() if x > 0) >= entropy * math.log(max(len(w), 1)) - 1e-9
    return {"entropy": reached, "repeats": all(w[s] * budget / t <= max_repeats + 1e-9 for s, t in tokens.items())}


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, entropy: float = 0.98, max_repeats: float = 4.0, block_tokens: int = 50_000, seed: int = 20) -> DataFrame:
    """One row per document: id, source, n_tokens, block, turn, turns (the mixture's order), weight (of its source), copies (0: left out).

    ``budget`` is in tokens; without it the corpus keeps its size.
    """
    units = _units(docs, id_col, text_col, source_col, budget, entropy, max_repeats, block_tokens, seed)
    each = units.select(F.explode(F.array_repeat(F.struct(F.col("id").alias(id_col), F.col("src").alias("source"), F.col("tok").alias("n_tokens"), *PLACES), F.col("k").cast("int"))).alias("x"))
    return each.select("x.*")


#: What a document's place in the mixture is made of, besides its tokens.
PLACES = ("block", "turn", "turns", "weight", "copies")


def _key(id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """What tells units apart: id, source and a hash of id and text."""
    return [F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("src"), F.xxhash64(F.lit(seed), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("own")]


def _units(docs: DataFrame, id_col: str, text_col: str, source_col: str, budget: int | None, entropy: float, max_repeats: float, block_tokens: int, seed: int) -> DataFrame:
    """Rows (id, src, own, tok, k, block, turn, turns, weight, copies) of units: k rows of one id, source and text, of tok tokens each."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.size(F.filter(F.split(text, SPACE), lambda x: x != ""))
    rows = docs.select(*_key(id_col, text_col, source_col, seed), F.greatest(n, F.lit(1)).cast("long").alias("tok"))
    rows = saved(rows.groupBy("id", "src", "own", "tok").agg(F.count(F.lit(1)).alias("k")).withColumn("all", F.col("tok") * F.col("k")))
    tokens = {r["src"]: r["t"] for r in rows.groupBy("src").agg(F.sum("all").alias("t")).collect()}  # a row per source
    total = sum(tokens.values())
    spend = total if budget is None else budget
    weights = mixture(tokens, solve(tokens, spend, entropy, max_repeats)) if tokens else {}
    plan = []
    for s, t in tokens.items():
        share = int(weights[s] * spend)
        plan.append((s, weights[s], share // t, share % t, max(1, -(-t // block_tokens))))
    plan = docs.sparkSession.createDataFrame(plan, "src string, weight double, epochs long, rest long, blocks long")
    turn = lambda epoch: F.xxhash64(F.lit(seed), "src", epoch, "block")
    placed = rows.join(plan, "src").withColumn("block", F.pmod("own", "blocks"))
    placed = placed.withColumn("turn", turn(F.col("epochs"))).withColumn("slice", F.shiftrightunsigned("turn", 52).cast("int"))
    placed = saved(placed.drop("blocks"))
    sums = placed.groupBy("src", "slice", "rest").agg(F.sum("all").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("src").orderBy("slice"))  # 4096 rows a source at most
    ends = sums.withColumn("before", upto - F.col("t")).select("src", "slice", "before", (F.col("before") + F.col("t")).alias("after"))
    state = placed.join(ends, ["src", "slice"])
    at_end = (F.col("before") < F.col("rest")) & (F.col("after") > F.col("rest"))
    run = F.sum("all").over(Window.partitionBy("src", "slice").orderBy("turn", "block", "own", "id", "tok").rowsBetween(Window.unboundedPreceding, 0))
    inner = state.where(at_end).withColumn("extra", (F.col("before") + run <= F.col("rest")).cast("long"))
    outer = state.where(~at_end).withColumn("extra", (F.col("after") <= F.col("rest")).cast("long"))
    out = inner.unionByName(outer).withColumn("copies", F.col("epochs") + F.col("extra"))
    turns = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), turn)).otherwise(F.array().cast("array<bigint>"))
    return out.withColumn("turns", turns).select("id", "src", "own", "tok", "k", *PLACES)


def mixture_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, entropy: float = 0.98, max_repeats: float = 4.0, block_tokens: int = 50_000, seed: int = 20) -> DataFrame:
    """The documents with all their columns and their places in the mixture: mix_n_tokens, mix_block, mix_turn, mix_turns, mix_weight, mix_copies (with an
    underscore more where ``docs`` has such a column). Every row gets the places of its own text.
    """
    units = _units(docs, id_col, text_col, source_col, budget, entropy, max_repeats, block_tokens, seed)
    names = free(docs.columns, "id", "src", "own", "mix_n_tokens", *(f"mix_{c}" for c in PLACES))
    units = units.select(*[F.col(c).alias(name) for c, name in zip(("id", "src", "own", "tok", *PLACES), names, strict=True)])
    own = [F.col(f"`{c}`") for c in docs.columns]
    mine = dict(zip(("id", "src", "own"), free([*docs.columns, *names], "m_id", "m_src", "m_own"), strict=True))
    keyed = docs.select(*own, *[c.alias(mine[k]) for k, c in zip(("id", "src", "own"), _key(id_col, text_col, source_col, seed), strict=True)])
    same = F.col(mine["id"]).eqNullSafe(F.col(names[0])) & (F.col(mine["src"]) == F.col(names[1])) & (F.col(mine["own"]) == F.col(names[2]))
    return keyed.join(units, same, "left").select(*own, *names[3:])
