"""Nothing personal leaves: masks for columns that no role claims, a leak report that withholds, an audit against a safe space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import tables as T
from tidewater.operators.flags import EMAIL, mask
from tidewater.operators.roles import column_kinds

#: A run of digits with the separators of phone numbers, ten digits alone, and a decimal number that is neither.
RUN, BARE, DECIMAL = r"\+?\d[\d\s().\-]{8,14}\d", r"\b\d{10}\b", r"(^|[^\d.])[-+]?\d+\.\d+($|[^\d.])"
#: Bits of the filter that is asked before the safe space itself, and how many of them a value sets.
FILTER_BITS, FILTER_HASHES = 1 << 18, 3


class Leak(Exception):
    """A table shows what must not be shown; it is withheld."""


def personal_columns(df: DataFrame, roles: dict[str, str], discover: bool = False) -> dict[str, str]:
    """Column -> why: its role is personal, its header says so, or (``discover``) its values look like phones or e-mail addresses. The last takes one aggregation over the text columns left."""
    out = {c: r for r, c in roles.items() if r in T.PII_ROLES and c in df.columns}
    for c in df.columns:
        if c not in out and any(w in c.strip().lower() for w in T.PII_HEADERS):
            out[c] = "header"
    text = [f.name for f in df.schema if f.dataType.typeName() == "string" and f.name not in out]
    if discover and text:
        out |= {r["column"]: "values" for r in column_kinds(df, text).where("kind = 'pii'").select("column").collect()}  # a row a column
    return out


def mask_personal(df: DataFrame, columns: dict[str, str], salt: str) -> DataFrame:
    """The named columns as salted hashes of 16 digits; nulls stay null."""
    return df.withColumns({c: mask(F.col(f"`{c}`"), salt) for c in columns}) if columns else df


def shows_phone(c: Column) -> Column:
    """Ten digits alone, or 10 to 13 digits of which some are parted by a separator; a plain decimal number is not a phone."""
    plain = F.regexp_replace(F.regexp_replace(c, DECIMAL, "$1 # $2"), DECIMAL, "$1 # $2")  # twice: neighbours share a blank
    size = lambda x: F.length(F.regexp_replace(x, r"\D", ""))
    runs = F.exists(F.regexp_extract_all(plain, F.lit(RUN), F.lit(0)), lambda x: size(x).between(10, 13) & x.rlike(r"[ +().\-]"))
    return F.coalesce(plain.rlike(BARE) | runs, F.lit(False))


def leak_report(df: DataFrame, row_id: str) -> DataFrame:
    """Rows (column, row_id, kind) of text cells that show a phone or an e-mail address; one pass over all columns."""
    text = [f.name for f in df.schema if f.dataType.typeName() == "string" and f.name != row_id]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, row_id string, kind string")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("v")) for c in text]))
    kinds = F.filter(F.array(F.when(shows_phone(F.col("x.v")), "phone"), F.when(F.col("x.v").rlike(EMAIL), "email")), lambda k: k.isNotNull())
    return df.select(F.col(f"`{row_id}`").cast("string").alias("row_id"), cells.alias("x")).select("x.column", "row_id", F.explode(kinds).alias("kind"))


def withheld_if_leaking(df: DataFrame, row_id: str) -> DataFrame:
    """``df`` itself if it shows nothing; else Leak, naming the columns. Stops at the first finding."""
    first = leak_report(df, row_id).select("column", "kind").first()
    if first:
        raise Leak(f"{first['column']} shows a {first['kind']}")
    return df


def _filter(safe: DataFrame, value: str) -> list[int]:
    """The bits that the safe space sets, in words of 32: a table of a fixed size, whatever the space."""
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), F.col(value)), F.lit(FILTER_BITS)) for k in range(FILTER_HASHES)])).alias("at")
    words = safe.where(F.col(value).isNotNull()).select(at).groupBy((F.col("at") / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 32).cast("int"))).alias("bits"))
    out = [0] * (FILTER_BITS // 32)
    for w, bits in words.collect():
        out[w] = bits
    return out


def outside_safe_space(df: DataFrame, columns: list[str], safe: DataFrame) -> DataFrame:
    """Rows (column, value, n) of values of pseudonymised columns that are not in the space (column, value) from which pseudonyms are drawn.

    Distinct values are first asked for in a filter of fixed size: a value whose bits are not all set is outside for sure. The others are looked up in the space itself.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    values = df.select(cells.alias("x")).select("x.*").where("value is not null and trim(value) <> ''").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    space = safe.select("column", "value").distinct()
    keyed = space.select(F.concat_ws("\0", "column", "value").alias("k"))
    bits = F.lit(_filter(keyed, "k"))
    key = F.concat_ws("\0", "column", "value")
    sure = None
    for k in range(FILTER_HASHES):
        at = F.pmod(F.xxhash64(F.lit(k), key), F.lit(FILTER_BITS))
        unset = F.call_function("shiftright", F.element_at(bits, (at / 32).cast("int") + 1), (at % 32).cast("int")).bitwiseAND(F.lit(1)) == 0
        sure = unset if sure is None else sure | unset
    told = values.withColumn("__out", sure)
    maybe = told.where("not __out").join(space, ["column", "value"], "left_anti")
    return told.where("__out").unionByName(maybe).drop("__out")


def audit(df: DataFrame, columns: list[str], safe: DataFrame) -> None:
    """Leak if a value lies outside the safe space."""
    first = outside_safe_space(df, columns, safe).select("column", "n").first()
    if first:
        raise Leak(f"{first['column']} holds values that are no pseudonyms")
