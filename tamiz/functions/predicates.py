"""Value and name predicates as Column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed


def strip(c: Column) -> Column:
    """Drop leading and trailing Unicode whitespace."""
    # Most texts start and end with a visible ASCII character, which two
    # comparisons find out; only the others are walked through.
    def edge(end: Column) -> Column:
        return (end < "!") | (end >= "\x7f")

    return F.when(edge(c) | edge(F.right(c, F.lit(1))), F.btrim(c, F.lit(fixed.WHITESPACE))).otherwise(c)


def is_semantic_null(c: Column) -> Column:
    # A long text can only be one when it is hardly more than blanks.
    short = (F.octet_length(c) <= 64) | c.rlike(fixed.SHORT_CORE)
    return short & strip(F.lower(c)).isin(fixed.SEMANTIC_NULLS)


def is_numeric_text(c: Column) -> Column:
    return strip(F.translate(c, ",", ".")).rlike(fixed.NUMERIC_PATTERN)


def has_decimal_mark(c: Column) -> Column:
    return c.contains(".") | c.contains(",")


def is_date_text(c: Column) -> Column:
    return strip(c).rlike(fixed.DATE_TEXT_PATTERN)


def is_boolean_text(c: Column) -> Column:
    return strip(F.lower(c)).isin(fixed.BOOLEAN_WORDS)


def has_date_name(name: Column) -> Column:
    return F.lower(name).rlike(fixed.DATE_NAME_PATTERN)


def is_rut(c: Column) -> Column:
    return strip(c).rlike(fixed.RUT_PATTERN)


def is_email(c: Column) -> Column:
    return strip(c).rlike(fixed.EMAIL_PATTERN)


def is_phone(c: Column) -> Column:
    return strip(c).rlike(fixed.PHONE_PATTERN)


def is_date_like(c: Column) -> Column:
    return strip(c).rlike(fixed.DATE_LIKE_PATTERN)


def pii_by_name(name: Column) -> Column:
    """Kind of personal data a column name announces; null when none does."""
    folded = F.translate(F.lower(name), " -", "__")
    return F.coalesce(
        *[F.when(folded.contains(word), F.lit(kind)) for word, kind in fixed.PII_NAME_KEYWORDS]
    )


def is_not_digits(c: Column) -> Column:
    """True when something other than digits is left without '.' and '-'."""
    return ~F.translate(c, ".-", "").rlike(r"^[0-9]+$")


def table_name_of(path: Column) -> Column:
    """File stem of a path; a plain table name stays as it is."""
    base = F.regexp_extract(path, r"([^/\\]*)[/\\]*$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    return F.when(path.rlike(r"[/\\]"), stem).otherwise(path)


def client_ip(forwarded: Column, host: Column) -> Column:
    """First forwarded address, else the peer address, else 'unknown'."""
    listed = F.when(forwarded != "", strip(F.split(forwarded, ",").getItem(0)))
    return F.coalesce(listed, host, F.lit("unknown"))


def similarity_score(similarity: Column) -> Column:
    return F.bround(similarity, 4)


def clamp_score(score: Column) -> Column:
    """Whole score between 1 and 5."""
    return F.greatest(F.lit(1), F.least(F.lit(5), score.cast("int")))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """part / whole in percent, rounded half to even; 0.0 for an empty whole."""
    return F.when(whole > 0, F.bround(part / whole * 100, digits)).otherwise(F.lit(0.0))


def whole_percent(pct: Column) -> Column:
    """Percentage as text without decimals."""
    return F.bround(pct, 0).cast("bigint").cast("string")
