"""Guarded joins, unions of partitioned sheets, reconciliation and conversion across sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import tables as T
from tidewater.operators.metrics import Blocked
from tidewater.operators.ranking import written


def key_facts(df: DataFrame, key: list[str]) -> tuple[int, int]:
    """Rows with the whole key, and distinct keys, in one pass."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    r = df.agg(F.count_if(known).alias("n"), F.count_distinct(F.when(known, F.struct(*key))).alias("d")).first()
    return r["n"], r["d"]


def guarded_join(left: DataFrame, right: DataFrame, key: list[str], prefix: str) -> tuple[DataFrame, DataFrame]:
    """``(joined, report)``. Blocked where the key is missing, does not overlap or is many-to-many, as a left join must
    never add rows. The report has one row: cardinality, left_unmatched, right_unmatched.
    """
    missing = [c for c in key if c not in left.columns or c not in right.columns]
    if missing:
        raise Blocked(f"the key {', '.join(missing)} is missing")
    # One job: rows by key on either side, joined once.
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    sides = [df.groupBy(*key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "l"), (right, "r"))]
    met = F.col("l").isNotNull() & F.col("r").isNotNull()
    r = sides[0].join(sides[1], key, "full").agg(F.max(F.when(known, F.col("l"))).alias("ml"), F.max(F.when(known, F.col("r"))).alias("mr"), F.count_if(met).alias("both"), *[F.coalesce(F.sum(F.when(~met, F.col(c))), F.lit(0)).alias(f"{c}_alone") for c in "lr"]).first()
    if (r["mr"] or 0) > 1:
        raise Blocked("many-to-many: the key repeats on both sides" if (r["ml"] or 0) > 1 else "the key repeats on the right: aggregate it first")
    if not r["both"]:
        raise Blocked("the keys do not overlap")
    extra = right.select(*key, *[F.col(c).alias(f"{prefix}__{c}") for c in right.columns if c not in key])
    report = left.sparkSession.createDataFrame([(r["l_alone"], r["r_alone"], "one-to-one" if r["ml"] == 1 else "many-to-one")], "left_unmatched long, right_unmatched long, cardinality string")
    return left.join(extra, key, "left"), report


def collapse(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: booleans and dates by maximum, numbers by sum, the rest by the first non-null in ``order``."""
    aggs = []
    for f in df.schema:
        if f.name in key or f.name == order:
            continue
        kind = f.dataType.typeName()
        if kind in ("boolean", "date", "timestamp", "timestamp_ntz"):
            aggs.append(F.max(f.name).alias(f.name))
        elif kind in ("double", "float", "integer", "long", "short", "byte") or kind.startswith("decimal"):
            aggs.append(F.sum(f.name).alias(f.name))
        else:
            aggs.append(F.min_by(f.name, F.when(F.col(f.name).isNotNull(), F.col(order))).alias(f.name))
    return df.groupBy(*key).agg(*aggs)


def precedence(status: Column) -> Column:
    out = None
    for k, s in enumerate(T.LIFECYCLE_PRECEDENCE):
        out = F.when(status == s, k) if out is None else out.when(status == s, k)
    return out.otherwise(len(T.LIFECYCLE_PRECEDENCE))


def roster_join(master: DataFrame, roster: DataFrame, person: str, course: str, status: str, order: str) -> DataFrame:
    """Master rows with the roster's most advanced status of the same (person, course); a person with exactly one
    unmatched row on each side is matched on the person alone. Adds roster_status and match_basis.
    """
    rank = F.row_number().over(Window.partitionBy(person, course).orderBy(precedence(F.col(status)), order))
    best = roster.where(F.col(person).isNotNull()).withColumn("__n", rank).where("__n = 1").select(F.col(person).alias("__p"), F.col(course).alias("__c"), F.col(status).alias("__s"))
    keys = master.select(person, course).where(F.col(person).isNotNull()).distinct()
    single = lambda d, p: d.withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy(p))).where("__k = 1").drop("__k")
    free_left = single(keys.join(best, (keys[person] == best["__p"]) & (keys[course].eqNullSafe(best["__c"])), "left_anti"), person)
    free_right = single(best.join(keys, (keys[person] == best["__p"]) & (keys[course].eqNullSafe(best["__c"])), "left_anti"), "__p")
    moved = free_left.join(free_right, free_left[person] == free_right["__p"]).select("__p", F.col(course).alias("__c"), "__s", F.lit("person").alias("__b"))
    table = best.withColumn("__b", F.lit("person_course")).unionByName(moved)
    out = master.join(table, (master[person] == table["__p"]) & master[course].eqNullSafe(table["__c"]), "left")
    return out.withColumnsRenamed({"__s": "roster_status", "__b": "match_basis"}).drop("__p", "__c")


def union_partitions(parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """Sheets that are parts of one roster, stacked by name with the status their source's name implies. A key under several
    statuses keeps its most advanced one and is flagged; repeats with one status stay.
    """
    frames = []
    for name, df in parts.items():
        status = next((s for needle, s in T.LIFECYCLE_BY_SOURCE if needle in name.lower()), None)
        frames.append(df.withColumns({"completion_status": F.lit(status), "source_name": F.lit(name)}))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    rank = precedence(F.col("completion_status"))
    w = Window.partitionBy(*key)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    out = stacked.where(known).withColumn("__r", rank).withColumns({"__best": F.min("__r").over(w), "__worst": F.max("__r").over(w)})
    out = out.where("__r = __best").withColumn("lifecycle_conflict", F.col("__best") < F.col("__worst")).drop("__r", "__best", "__worst")
    return out.unionByName(stacked.where(~known).withColumn("lifecycle_conflict", F.lit(False)))


def reconcile(ledger: DataFrame, rollup: DataFrame, key: str, paid: str, date: str, channel: str, total: str, pending: str, refund: str | None = None, tolerance: float = 1.0) -> DataFrame:
    """Full outer join of receipts per key with a fee rollup: paid, refunded, net, installments, dates, channel, gap and flags."""
    amount = F.coalesce(F.col(paid), F.lit(0.0))
    back = F.coalesce(F.col(refund), F.lit(False)) | (amount < 0) if refund else amount < 0
    # The ledger is read and shuffled once, by (key, channel); the rest rolls that up.
    per = ledger.where(F.col(key).isNotNull()).groupBy(key, channel).agg(F.sum(F.when(~back, amount).otherwise(0.0)).alias("p"), F.sum(F.when(back, F.abs(amount)).otherwise(0.0)).alias("b"), F.count_if(~back & (amount > 0)).alias("i"), F.min(date).alias("f"), F.max(date).alias("t"), F.count(F.lit(1)).alias("k"))
    mode = F.min(F.when(F.col(channel).isNotNull(), F.struct((-F.col("k")).alias("k"), F.col(channel).alias("v"))))
    sums = per.groupBy(key).agg(F.sum("p").alias("paid_total"), F.sum("b").alias("refund_total"), F.sum("i").alias("installments"), F.min("f").alias("first_paid"), F.max("t").alias("last_paid"), mode.alias("m"))
    sums = sums.withColumn("net", F.col("paid_total") - F.col("refund_total")).withColumn("span_days", F.datediff("last_paid", "first_paid")).withColumn("channel", F.col("m.v")).drop("m")
    fees = rollup.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(total).alias("total"), F.sum(pending).alias("pending"))
    both = sums.join(fees, key, "full")
    gap = F.col("total") - F.coalesce("net", F.lit(0.0)) - F.coalesce("pending", F.lit(0.0))
    return both.withColumn("gap", gap).withColumn("mismatch", F.coalesce(F.abs("gap") > tolerance, F.lit(False))).withColumn("negative_pending_flag", F.coalesce(F.col("pending") < 0, F.lit(False)))


def reconciliation_summary(recon: DataFrame) -> DataFrame:
    return recon.agg(F.count(F.lit(1)).alias("n"), F.count_if("mismatch").alias("mismatches"), F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"), F.try_divide(F.sum(F.when(F.col("total").isNotNull(), F.greatest(F.coalesce("net", F.lit(0.0)), F.lit(0.0)))), F.sum("total")).alias("collection_efficiency"))


def default_aging(recon: DataFrame) -> DataFrame:
    """Adds aging: days since the last payment against the ledger's own last payment, for pending amounts above 0."""
    last = recon.agg(F.max("last_paid").alias("__last"))
    d = F.datediff("__last", "last_paid")
    label = F.when(F.col("pending") > 0, F.when(d <= 30, "0-30").when(d <= 60, "31-60").when(d <= 90, "61-90").otherwise("90+"))
    return recon.join(F.broadcast(last)).withColumn("aging", label).drop("__last")


def conversion(touches: DataFrame, person: str, source: str, kind: str, order: str) -> DataFrame:
    """One row per person who enquired: enquiry_source (first), converted (admitted on any source), cross_source (on another)."""
    g = touches.where(F.col(person).isNotNull()).groupBy(person).agg(F.min_by(F.when(F.col(kind) == "enquiry", F.col(source)), F.when(F.col(kind) == "enquiry", F.col(order))).alias("enquiry_source"), F.count_if(F.col(kind) == "enquiry").alias("__e"), F.collect_set(F.when(F.col(kind) == "admission", F.col(source))).alias("__a"))
    out = g.where("__e > 0").withColumn("converted", F.size("__a") > 0)
    return out.withColumn("cross_source", F.col("converted") & (F.size(F.array_remove("__a", F.col("enquiry_source"))) > 0)).drop("__e", "__a")


def master_ids(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Distinct non-null ids over several tables, with the tables that hold them."""
    ids = [df.select(F.col(c).alias("id"), F.lit(name).alias("src")) for name, (df, c) in sources.items()]
    return reduce(lambda a, b: a.unionByName(b), ids).where("id is not null").groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("found_in"))


def coalesce_prefixed(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bare derived columns from the first non-null of themselves and every ``source__column``."""
    for c in columns:
        have = [x for x in df.columns if x == c or x.endswith(f"__{c}")]
        if have:
            df = df.withColumn(c, F.coalesce(*[F.col(f"`{x}`") for x in have]))
    return df


def identity_key(left: DataFrame, right: DataFrame, candidates: list[list[str]]) -> list[str]:
    """The first candidate that is unique on the right and overlaps; Blocked if there is none."""
    for key in candidates:
        if all(c in left.columns and c in right.columns for c in key):
            n, d = key_facts(right, key)
            if n and n == d and left.join(right, key, "left_semi").limit(1).count():
                return key
    raise Blocked("no candidate identifies rows on the right")


def coverage(left: DataFrame, right: DataFrame, person: str, course: str) -> DataFrame:
    """Rows (coverage, n): left rows that match the right on (person, course), whose person the right knows under another course
    only, whom it does not know, and rows without a person.
    """
    pairs = right.where(F.col(person).isNotNull()).groupBy(F.col(person).alias("__p"), F.col(course).alias("__c")).agg(F.lit(True).alias("__pair"))
    people = right.where(F.col(person).isNotNull()).groupBy(F.col(person).alias("__q")).agg(F.lit(True).alias("__person"))
    # A row per (person, course) of the left goes into the joins, with its count.
    rows = left.groupBy(person, course).agg(F.count(F.lit(1)).alias("n"))
    j = rows.join(pairs, (rows[person] == F.col("__p")) & rows[course].eqNullSafe(F.col("__c")), "left").join(people, rows[person] == F.col("__q"), "left")
    label = F.when(F.col(person).isNull(), "no_person").when(F.col("__pair"), "matched").when(F.col("__person"), "other_course").otherwise("absent")
    return j.groupBy(label.alias("coverage")).agg(F.sum("n").alias("n"))


def join_sources(master: DataFrame, sources: dict[str, DataFrame], key: list[str], identity: list[list[str]] = (), order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(joined, report)``: each source joined to the master on the key, collapsed to a row per key first where the key repeats
    (``order`` decides between texts), or on the first identity key that is unique; what fits neither way is left out.
    The report has a row (source, accepted, basis, reason) for each.
    """
    told = []
    for name, df in sources.items():
        try:
            if all(c in df.columns and c in master.columns for c in key):
                n, d = key_facts(df, key)
                basis = "key" if n == d else "collapsed"
                if n > d and (order is None or order not in df.columns):
                    raise Blocked("the key repeats and nothing orders its rows")
                # The collapsed table is written once: the guard's counts and the join read it, not the source.
                master, _ = guarded_join(master, df if n == d else written(collapse(df, key, order)), key, name)
            else:
                found = identity_key(master, df, list(identity))
                basis = "identity:" + ",".join(found)
                master, _ = guarded_join(master, df, found, name)
            told.append((name, True, basis, None))
        except Blocked as why:
            told.append((name, False, None, str(why)))
    return master, master.sparkSession.createDataFrame(told, "source string, accepted boolean, basis string, reason string")


def union_quality(parts: dict[str, DataFrame], key: list[str]) -> DataFrame:
    """One row on the union of a roster's parts (``union_partitions``): rows read, kept, dropped as less advanced than another status
    of their key, keys that contradict, and rows without a key.
    """
    stacked = union_partitions(parts, key)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    read = reduce(lambda a, b: a.unionByName(b), [df.agg(F.count(F.lit(1)).alias("n")) for df in parts.values()]).agg(F.sum("n").alias("rows_read"))
    kept = stacked.agg(F.count(F.lit(1)).alias("rows_kept"), F.count_distinct(F.when(F.col("lifecycle_conflict"), F.struct(*key))).alias("contradicting_keys"), F.count_if(~known).alias("rows_without_key"))
    return read.join(kept).withColumn("rows_dropped", F.col("rows_read") - F.col("rows_kept"))


def master(sources: dict[str, tuple[DataFrame, str]], attributes: list[str], status: str = "completion_status") -> DataFrame:
    """One row per id over several sources (name -> (table, id column)), in their order: found_in, each attribute from the first source
    that has it, and the most advanced status ('Unknown' where no source has one). Sources lack columns freely; one shuffle.
    """
    frames = []
    for rank, (name, (df, id_col)) in enumerate(sources.items()):
        cols = [(F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in [*attributes, status]]
        frames.append(df.select(F.col(id_col).alias("id"), F.lit(name).alias("src"), F.lit(rank).alias("__k"), *cols))
    rows = reduce(lambda a, b: a.unionByName(b), frames).where("id is not null")
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct("__k", F.col(c).alias("v")))).alias(c) for c in attributes]
    best = F.min(F.when(F.col(status).isNotNull(), F.struct(precedence(F.col(status)).alias("__k"), F.col(status).alias("v")))).alias(status)
    g = rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("found_in"), *first, best)
    return g.select("id", "found_in", *[F.col(f"{c}.v").alias(c) for c in attributes], F.coalesce(F.col(f"{status}.v"), F.lit("Unknown")).alias(status))


def repair_enquiries(enquiries: DataFrame, followups: DataFrame, converted: DataFrame, students: DataFrame, enquiry_id: str, mobile: str, student_id: str, name: str) -> tuple[DataFrame, DataFrame]:
    """``(enquiries, followups)``: follow-ups get the id of the enquiry with their mobile (the least id of a mobile), enquiries the id of the
    student with theirs; converted rows are appended as enquiries, flagged, not merged, where an enquiry has their name.
    """
    one = lambda df, c: df.where(F.col(mobile).isNotNull()).groupBy(mobile).agg(F.min(c).alias(c))
    calls = followups.drop(enquiry_id).join(one(enquiries, enquiry_id), mobile, "left")
    both = enquiries.withColumn("source_sheet", F.lit("enquiries")).unionByName(converted.withColumn("source_sheet", F.lit("converted")), allowMissingColumns=True)
    plain = F.trim(F.lower(F.col(name)))
    seen = enquiries.select(plain.alias("__name")).where("__name <> ''").distinct().withColumn("__seen", F.lit(True))
    out = both.drop(student_id).join(one(students, student_id), mobile, "left").join(seen, plain == F.col("__name"), "left")
    flag = (F.col("source_sheet") == "converted") & F.coalesce("__seen", F.lit(False))
    return out.withColumn("possible_duplicate", flag).drop("__name", "__seen"), calls
