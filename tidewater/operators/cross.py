"""Two-factor crossing of one metric: margins, cells, additive expectation, and tests of each cell against its row and
column. Grouping sets give all levels in one shuffle; the rest of a row or column is its margin minus the cell.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import tables as T
from tidewater.functions.statistics import two_means, two_proportions, two_sided
from tidewater.operators.metrics import Blocked, Metric, interval, sums, value
from tidewater.operators.roles import reporting_column
from tidewater.operators.stats import benjamini_hochberg, chi2_independence

MIN_CELL, LEVELS = 30, 12
_CLAUSE = re.compile(r"^\s*([\w ]+?)\s*(!=|>=|<=|=|>|<|\bnot in\b|\bin\b)\s*(.+?)\s*$", re.I)


def parse_filter(text: str) -> tuple[str, str, list[str]]:
    """``field op value``; in and not in take a comma list. ValueError if it does not read."""
    m = _CLAUSE.match(text)
    if not m:
        raise ValueError(f"cannot read the filter: {text}")
    op = m[2].lower()
    values = [v.strip().strip("'\"") for v in m[3].strip("()[]").split(",")] if op.endswith("in") else [m[3].strip("'\"")]
    return m[1], op, values


def filter_mask(field: Column, op: str, values: list[str]) -> Column:
    """Equality on trimmed lower-case text, order on numbers or else dates. Nulls pass only != and not in."""
    text = F.trim(F.lower(field.cast("string")))
    wanted = [v.strip().lower() for v in values]
    if op in ("=", "in"):
        return F.coalesce(text.isin(wanted), F.lit(False))
    if op in ("!=", "not in"):
        return ~F.coalesce(text.isin(wanted), F.lit(False))
    try:
        left, right = field.cast("string").try_cast("double"), F.lit(float(values[0]))
    except ValueError:
        left, right = field.cast("string").try_cast("timestamp"), F.lit(values[0]).try_cast("timestamp")
    test = {">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[op]
    return F.coalesce(test, F.lit(False))


def apply_filters(df: DataFrame, filters: list[str]) -> tuple[DataFrame, DataFrame]:
    """The filtered rows and one report row per filter (filter, known, rows_before, rows_after), from a single aggregation."""
    masks, report = F.lit(True), []
    counts = [F.count(F.lit(1)).alias("c0")]
    for k, text in enumerate(filters):
        field, op, values = parse_filter(text)
        name = next((c for c in df.columns if c.lower() == field.lower()), None)
        if name:
            masks = masks & filter_mask(F.col(name), op, values)
        counts.append(F.count_if(masks).alias(f"c{k + 1}"))
        report.append(F.struct(F.lit(text).alias("filter"), F.lit(name is not None).alias("known"), F.col(f"c{k}").alias("rows_before"), F.col(f"c{k + 1}").alias("rows_after")))
    told = df.agg(*counts).select(F.explode(F.array(*report)).alias("r")).select("r.*") if report else df.sparkSession.createDataFrame([], "filter string, known boolean, rows_before long, rows_after long")
    return df.where(masks), told


def trim_levels(df: DataFrame, dim: str, keep: int = LEVELS) -> DataFrame:
    """Rows of the ``keep`` most frequent levels (ties: the smaller value)."""
    top = df.where(F.col(dim).isNotNull()).groupBy(dim).count().orderBy(F.desc("count"), dim).limit(keep).select(dim)
    return df.join(F.broadcast(top), dim, "left_semi")  # `keep` rows


def crosstab(df: DataFrame, m: Metric, rows: str, cols: str, min_cell: int = MIN_CELL, levels: int = LEVELS, alpha: float = 0.05) -> DataFrame:
    """Rows (level, row, col, n, value, ci_low, ci_high, sd, expected, residual, suppressed, row_z, row_q, col_z, col_q,
    interaction): intervals for rates and means, sd for means; level is overall, row, column or cell. Cells under ``min_cell`` rows are suppressed: listed
    without a value. An interaction beats both its row's and its column's rest after correction.
    """
    if rows == cols:
        raise Blocked("a column cannot be crossed with itself")
    known = df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull())
    if m.kind == "rate" and not m.null_is_false:
        known = known.where(F.col(m.num).isNotNull())
    known = trim_levels(trim_levels(known, rows, levels), cols, levels)
    base = known.withColumn("__r", F.col(rows).cast("string")).withColumn("__c", F.col(cols).cast("string"))
    cube = base.groupingSets([[], ["__r"], ["__c"], ["__r", "__c"]], "__r", "__c").agg(F.grouping_id().alias("g"), *sums(m))
    # Read once: the cube has (levels + 1) squared rows at most, and is used for cells and all margins.
    cube = df.sparkSession.createDataFrame(cube.collect(), cube.schema)
    keep = ("n", "sy", "sy2", "sx")
    low, high = interval(m) if m.kind in ("rate", "mean") else (F.lit(None).cast("double"),) * 2
    spread = F.sqrt(F.greatest(F.try_divide(F.col("sy2") - F.col("sy") * F.col("sy") / F.col("n"), F.col("n") - 1), F.lit(0.0))) if m.kind == "mean" else F.lit(None).cast("double")
    part = lambda g, tag: cube.where(F.col("g") == g).select(*([F.col("__r").alias("row")] if g in (0, 1) else []), *([F.col("__c").alias("col")] if g in (0, 2) else []), *[F.col(c).alias(f"{tag}_{c}") for c in keep], value(m).alias(f"{tag}_v"), low.alias(f"{tag}_low"), high.alias(f"{tag}_high"), spread.alias(f"{tag}_sd"))
    cells = part(0, "c").join(part(1, "r"), "row").join(part(2, "k"), "col").join(F.broadcast(part(3, "o")))
    shown = F.col("c_n") >= min_cell

    def against(tag: str) -> Column:
        n, y, y2 = (F.col(f"{tag}_{c}") - F.col(f"c_{c}") for c in ("n", "sy", "sy2"))
        if m.kind == "rate":
            z = two_proportions(F.col("c_sy"), F.col("c_n"), y, n)["z"]
        elif m.kind == "mean":
            var = lambda s, q, k: F.greatest(F.try_divide(q - s * s / k, k - 1), F.lit(0.0))
            z = two_means(F.col("c_v"), var(F.col("c_sy"), F.col("c_sy2"), F.col("c_n")), F.col("c_n"), F.try_divide(y, n), var(y, y2, F.nullif(n, F.lit(0))), n)["z"]
        else:
            return F.lit(None).cast("double")
        return F.when(shown & (n >= min_cell), z)

    tested = cells.withColumn("row_z", against("r")).withColumn("col_z", against("k"))
    for tag in ("row", "col"):
        with_p = tested.withColumn("__p", two_sided(F.col(f"{tag}_z"))).withColumn("__t", F.col(f"{tag}_z").isNotNull())
        done = benjamini_hochberg(with_p, "__p", ["__t"], alpha, few=True)  # cells of a cube that is bounded
        tested = done.withColumn(f"{tag}_q", F.when(F.col("__t"), F.col("q"))).drop("__p", "__t", "q", "significant")
    expected = F.col("r_v") + F.col("k_v") - F.col("o_v")
    hit = F.coalesce((F.col("row_q") <= alpha) & (F.col("col_q") <= alpha), F.lit(False))
    cell = tested.select(F.lit("cell").alias("level"), "row", "col", F.col("c_n").alias("n"), F.when(shown, F.col("c_v")).alias("value"), F.when(shown, F.col("c_low")).alias("ci_low"), F.when(shown, F.col("c_high")).alias("ci_high"), F.when(shown, F.col("c_sd")).alias("sd"), F.when(shown, expected).alias("expected"), F.when(shown, F.col("c_v") - expected).alias("residual"), (~shown).alias("suppressed"), "row_z", "row_q", "col_z", "col_q", hit.alias("interaction"))
    name = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "row").otherwise("column")
    none = F.lit(None).cast("double")
    margins = cube.where("g > 0").select(name.alias("level"), F.col("__r").alias("row"), F.col("__c").alias("col"), "n", value(m).alias("value"), low.alias("ci_low"), high.alias("ci_high"), spread.alias("sd"), *[none.alias(c) for c in ("expected", "residual")], F.lit(False).alias("suppressed"), *[none.alias(c) for c in ("row_z", "row_q", "col_z", "col_q")], F.lit(False).alias("interaction"))
    return margins.unionByName(cell)


def grid_independence(df: DataFrame, m: Metric, rows: str, cols: str, levels: int = LEVELS) -> DataFrame:
    """Chi-square over the grid: for a rate, cells against success and failure; for the rest, rows against columns. One row as
    ``chi2_independence`` gives it.
    """
    known = df.where(F.col(rows).isNotNull() & F.col(cols).isNotNull())
    known = trim_levels(trim_levels(known, rows, levels), cols, levels)
    if m.kind != "rate":
        return chi2_independence(known.groupBy(rows, cols).agg(F.count(F.lit(1)).alias("k")), rows, cols, "k")
    y = F.col(m.num)
    if m.null_is_false:
        y = F.coalesce(y, F.lit(False))
    cell = F.concat_ws("\0", F.col(rows).cast("string"), F.col(cols).cast("string"))
    counts = known.select(cell.alias("cell"), y.cast("boolean").alias("hit")).where("hit is not null").groupBy("cell", "hit").agg(F.count(F.lit(1)).alias("k"))
    return chi2_independence(counts, "cell", "hit", "k")


def suggest_pairs(df: DataFrame, roles: dict[str, str], pairs: list[tuple[str, str]] = T.CROSS_PAIRS) -> list[tuple[str, str]]:
    """Pairs of columns worth crossing: of the registry's roles those that stand for two columns with two values or more each."""
    used = sorted({c for pair in pairs for r in pair if (c := reporting_column(r, roles, df.columns))})
    if not used:
        return []
    many = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in used]).first()
    found = [(reporting_column(a, roles, df.columns), reporting_column(b, roles, df.columns)) for a, b in pairs]
    return [(a, b) for a, b in found if a and b and a != b and many[a] and many[b]]


def auto_cross(df: DataFrame, m: Metric, roles: dict[str, str], most: int = 3) -> DataFrame:
    """Interactions of a rate over the first ``most`` pairs that the table offers: rows (rows, cols, row, col, n, value, expected, residual).
    Only rates are comparable across cells of different sizes.
    """
    if m.kind != "rate":
        raise Blocked("only a rate is comparable across cells of different sizes")
    pairs = suggest_pairs(df, roles)[:most]
    if not pairs:
        raise Blocked("no two dimensions with two levels or more")
    out = None
    for a, b in pairs:
        hit = crosstab(df, m, a, b).where("level = 'cell' and interaction").select(F.lit(a).alias("rows"), F.lit(b).alias("cols"), "row", "col", "n", "value", "expected", "residual")
        out = hit if out is None else out.unionByName(hit)
    return out


def cross_notes(cells: DataFrame, independence: DataFrame, kind: str, alpha: float = 0.05) -> DataFrame:
    """Rows (topic, note) on a crosstab and its grid test: what the test says, whether any cell stands out, what is suppressed."""
    told = F.when(~F.col("valid"), "The grid is too thin for a test.")
    if kind == "rate":
        told = told.when(F.col("p") > alpha, "The rate looks independent of the combination.").otherwise("The rate depends on the combination: some cell differs from what its margins predict.")
    else:
        told = told.when(F.col("p") > alpha, "The dimensions are evenly crossed: margins are comparable.").otherwise("The dimensions are unevenly crossed: margins cover different populations.")
    grid = independence.select(F.lit("independence").alias("topic"), told.alias("note"))
    c = cells.where("level = 'cell'").agg(F.count_if("interaction").alias("hits"), F.count_if("suppressed").alias("hidden"), F.coalesce(F.sum(F.when(F.col("suppressed"), F.col("n"))), F.lit(0)).alias("hidden_rows"))
    plain = F.when((F.col("hits") == 0) & F.lit(kind in ("rate", "mean")), F.struct(F.lit("interactions").alias("topic"), F.lit("No cell beats both of its margins after correction.").alias("note")))
    thin = F.when(F.col("hidden") > 0, F.struct(F.lit("suppressed").alias("topic"), F.format_string("%d cells with %d rows are too small to show.", "hidden", "hidden_rows").alias("note")))
    rest = c.select(F.explode(F.filter(F.array(plain, thin), lambda x: x.isNotNull())).alias("x")).select("x.*")
    return grid.unionByName(rest)
