"""Canonical values of human-typed text, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewater.functions import tables as T


def squeezed(c: Column) -> Column:
    """Lower case, trimmed, single spaces."""
    return F.trim(F.regexp_replace(F.lower(c.cast("string")), r"\s+", " "))


def categorical(c: Column) -> Column:
    """Squeezed text; 'nan', 'none' and '' become null."""
    s = squeezed(c)
    return F.when(~s.isin("nan", "none", ""), s)


def first_rule(c: Column, rules: list[tuple[str, str]], default: Column | None = None) -> Column:
    """The value of the first pattern that the text holds."""
    out = None
    for pattern, value in rules:
        out = F.when(c.rlike(pattern), value) if out is None else out.when(c.rlike(pattern), value)
    return out.otherwise(default if default is not None else F.lit(None).cast("string"))


def lookup(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), default if default is not None else F.lit(None).cast("string"))


def branch(c: Column, aliases: dict[str, str] = T.BRANCH_ALIASES) -> Column:
    """Closed-set branch: blanks to null, aliases resolved, other values unchanged (squeezed)."""
    s = squeezed(c)
    return F.when(~s.isin(T.BLANKS), lookup(s, aliases, s))


def is_known_branch(c: Column, branches: list[str] = T.BRANCHES, aliases: dict[str, str] = T.BRANCH_ALIASES) -> Column:
    """Whether the canonical value is one of the closed set."""
    return F.coalesce(branch(c, aliases).isin(branches), F.lit(False))


def branch_of_locality(c: Column, localities: dict[str, str] = T.LOCALITY_BRANCH, aliases: dict[str, str] = T.BRANCH_ALIASES) -> Column:
    """The branch that serves a locality written in its place, else null."""
    return lookup(branch(c, aliases), localities)


def faculty(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """Without honorifics and stray punctuation; aliases are applied to the whole name only."""
    bare = F.regexp_replace(F.lower(c), r"\b(?:sir|mam|ma'am|madam|miss)\b\.?", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\s+", " "), r"^[ .,\-]+|[ .,\-]+$", "")
    return F.when(bare == "", F.trim(c)).otherwise(lookup(bare, aliases, bare) if aliases else bare)


def course_text(c: Column) -> Column:
    s = squeezed(c)
    for pattern, fix in T.COURSE_SPELLING:
        s = F.regexp_replace(s, pattern, fix)
    return s


def course_module(c: Column) -> Column:
    """The first module suffix found, else null."""
    s = course_text(c)
    return F.coalesce(*[F.nullif(F.trim(F.regexp_extract(s, p, 1)), F.lit("")) for p in T.COURSE_MODULES])


def course_family(c: Column) -> Column:
    """The first family rule that holds once the module suffix is gone, else the cleaned text."""
    s = course_text(c)
    base = None
    for p in T.COURSE_MODULES:
        base = F.when(s.rlike(p), F.regexp_replace(s, p, " ")) if base is None else base.when(s.rlike(p), F.regexp_replace(s, p, " "))
    base = F.trim(F.regexp_replace(base.otherwise(s), r"\s+", " "))
    return first_rule(base, T.COURSE_FAMILIES, F.nullif(base, F.lit("")))


def course_category(raw: Column, family: Column) -> Column:
    """One of eight closed buckets; anchors in the raw text decide first; blank stays null."""
    s = squeezed(raw)
    return F.when(s != "", first_rule(s, T.CATEGORY_ANCHORS, lookup(family, T.FAMILY_CATEGORY, F.lit("Other"))))


def lead_source(c: Column) -> Column:
    """struct(bucket, basis): blank, rule, explicit other, or a referrer's name."""
    s = F.coalesce(squeezed(c), F.lit(""))
    ruled = first_rule(s, T.LEAD_SOURCES)
    return (
        F.when(s.isin(T.LEAD_BLANKS), F.struct(F.lit("Walk-in").alias("bucket"), F.lit("blank").alias("basis")))
        .when(s.isin(T.EXPLICIT_OTHER), F.struct(F.lit(None).cast("string").alias("bucket"), F.lit("other").alias("basis")))
        .when(ruled.isNotNull(), F.struct(ruled.alias("bucket"), F.lit("rule").alias("basis")))
        .otherwise(F.struct(F.lit("Referral").alias("bucket"), F.lit("named-referrer").alias("basis")))
    )


def occupation(c: Column) -> Column:
    s = squeezed(c)
    return F.when(s.isNull() | s.isin(T.LEAD_BLANKS), F.lit(None).cast("string")).when(s.isin(T.EXPLICIT_OTHER) | s.rlike(r"^free\s*lanc\w*$"), "Other").when(s.rlike(r"free\s*lanc"), "Business / Job").otherwise(first_rule(s, T.OCCUPATIONS, F.lit("Other")))


def payment_channel(c: Column) -> Column:
    return first_rule(F.lower(c), T.PAYMENT_CHANNELS)


def is_refund(c: Column) -> Column:
    return F.coalesce(F.lower(c).rlike("refund"), F.lit(False))


def name_markers(c: Column) -> Column:
    """struct(name, enrollment_status, is_cancelled, is_fast_track) of a name with notes in brackets."""
    chunks = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\(([^)]*)\)"), F.lit(1))
    marks = F.transform(chunks, lambda x: first_rule(F.lower(x), T.STATUS_MARKS))
    inner = F.get(F.filter(marks, lambda x: x.isNotNull()), F.lit(0))
    outside = F.regexp_replace(F.coalesce(c, F.lit("")), r"\([^)]*\)", " ")
    bare = F.when(F.lower(outside).rlike(rf"\b(?:{T.CANCEL_MARK})\b"), "cancelled")
    fast = F.exists(chunks, lambda x: F.lower(x).rlike(T.FAST_TRACK_MARK)) | F.lower(outside).rlike(r"fast\s*track")
    status = F.coalesce(inner, bare, F.lit("active"))
    # Only marked chunks are taken out of the name; others stay.
    every = "|".join([*(p for p, _ in T.STATUS_MARKS), T.FAST_TRACK_MARK, T.NOTE_MARK])
    name = F.regexp_replace(c, rf"(?i)\((?=[^)]*(?:{every}))[^)]*\)", " ")
    name = F.regexp_replace(name, rf"(?i)\b(?:{T.CANCEL_MARK})\b|fast\s*track", " ")
    name = F.regexp_replace(F.regexp_replace(name, r"\s+\d{1,2}[/-]\d{1,2}\s*$", ""), r"\s+", " ")
    return F.struct(F.trim(name).alias("name"), status.alias("enrollment_status"), status.isin("cancelled", "refunded").alias("is_cancelled"), fast.alias("is_fast_track"))


def person_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9 ]+", " "), " +", " "))


def phone(c: Column) -> Column:
    """Last ten digits (a trailing .0 is dropped), else ''."""
    digits = F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\.0$", ""), r"\D", "")
    return F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise("")


def date_digits(c: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\D", "")
    return F.when(F.length(digits) >= 6, digits).otherwise("")


def email(c: Column) -> Column:
    s = F.replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s", ""), F.lit(","), F.lit("."))
    return F.when(s.rlike(r"^[^@]+@[^@]+\.[^@.]+$"), s).otherwise("")


def composite_key(*parts: Column) -> Column:
    """Trimmed lower-case parts joined by '|'; null where all parts are null or empty."""
    clean = [F.nullif(F.trim(F.lower(p.cast("string"))), F.lit("")) for p in parts]
    return F.when(F.coalesce(*clean).isNotNull(), F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in clean]))
