"""Who a row is about: an identity planned from what the columns cover."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import canon
from tidewater.operators.metrics import Blocked
from tidewater.operators.ranking import free

#: Roles that tell people of one name apart, in the order in which they enter the key.
DISCRIMINATORS = {"student_mobile": canon.phone, "dob": canon.date_digits, "email": canon.email}


@dataclass(frozen=True)
class Identity:
    """``basis``: the roles that make the key, name first; ``coverage``: the share of rows with a usable value of each discriminator that has a column."""

    basis: tuple[str, ...]
    coverage: dict[str, float]
    columns: dict[str, str]

    @property
    def separates(self) -> bool:
        """Whether namesakes are told apart, so that person-grain results may be given."""
        return len(self.basis) > 1

    @property
    def ignored(self) -> list[str]:
        return [r for r in self.coverage if r not in self.basis]

    def key(self, salt: str) -> Column:
        """The salted key of 16 hexadecimal digits; null without a name."""
        name = canon.person_name(F.col(self.columns["name"]))
        parts = [name, *(DISCRIMINATORS[r](F.col(self.columns[r])) for r in self.basis[1:])]
        return F.when(name != "", F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.concat_ws("|", *parts)), 256), 1, 16))


def plan_identity(df: DataFrame, roles: dict[str, str], least: float = 0.8) -> Identity:
    """Name and each discriminator that ``least`` of the rows have: one that few have would split a person in two. One aggregation."""
    columns = {r: c for r, c in roles.items() if c in df.columns}
    if "name" not in columns:
        raise Blocked("no column names the person")
    have = [r for r in DISCRIMINATORS if r in columns]
    shares = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg((DISCRIMINATORS[r](F.col(columns[r])) != "").cast("double")).alias(r) for r in have]).first()
    coverage = {r: shares[r] or 0.0 for r in have}
    return Identity(("name", *(r for r in have if coverage[r] >= least)), coverage, columns)


def identify(df: DataFrame, identity: Identity, salt: str = "") -> DataFrame:
    """Adds person_id and person_enrollment_count (null without a name), and is_repeat_enrollment only if the identity separates namesakes.

    Persons are counted with partial sums and only those of several rows are joined back, so neither nameless rows nor one
    frequent person gather in a task.
    """
    p, n = free(df, "p", "n")
    keyed = df.withColumn("person_id", identity.key(salt))
    often = keyed.where("person_id is not null").groupBy(F.col("person_id").alias(p)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1)
    out = keyed.join(often, F.col("person_id") == F.col(p), "left").withColumn("person_enrollment_count", F.when(F.col("person_id").isNotNull(), F.coalesce(F.col(n), F.lit(1))))
    if identity.separates:
        out = out.withColumn("is_repeat_enrollment", F.col(n).isNotNull())
    return out.drop(p, n)


def namesakes(df: DataFrame, identity: Identity) -> DataFrame:
    """One row (n_names, n_rows_merged, withheld): how many names there are, rows of names that repeat, and whether person-grain flags are withheld for that."""
    per = df.select(canon.person_name(F.col(identity.columns["name"])).alias("name")).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("n_names"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("n_rows_merged")).withColumn("withheld", F.lit(not identity.separates))
