"""Columns that turn untrusted text into typed values, or null when it is not one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Gregorian year used for exact ages.
DAYS_PER_YEAR = 365.2425
DEFAULT_DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd", "MM/dd/yyyy")


def present(text: Column) -> Column:
    """True for text that is neither null nor blank."""
    return text.isNotNull() & (F.length(F.trim(text)) > 0)


def whole_number(text: Column) -> Column:
    """``"125.0"`` becomes 125; anything that is not an integer value becomes null."""
    value = F.trim(text).try_cast("double")
    return F.when(value == F.floor(value), value.try_cast("bigint"))


def first_date(text: Column, formats: Sequence[str] = DEFAULT_DATE_FORMATS) -> Column:
    """Date from the first format that parses the whole text."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def innings_to_outs(text: Column) -> Column:
    """Innings notation, where the digit after the point counts thirds: ``"12.2"`` is 38 outs.

    Only .0, .1 and .2 (or no fraction) are legal; other text gives null.
    """
    pattern = r"^\s*(\d+)(?:\.([0-2]))?\s*$"
    whole = F.regexp_extract(text, pattern, 1).try_cast("bigint")
    thirds = F.regexp_extract(text, pattern, 2)
    return whole * 3 + F.when(thirds == "", F.lit(0)).otherwise(thirds.try_cast("bigint"))


def payload_hash(*columns: str) -> Column:
    """Content identity of a row: SHA-256 over ``name=value`` pairs in name order.

    The order the columns are passed in does not matter; null differs from every text.
    """
    pairs = [F.concat(F.lit(f"{name}="), F.coalesce(F.to_json(F.struct(F.col(name))), F.lit("{}"))) for name in sorted(columns)]
    return F.sha2(F.concat_ws("\x1f", *pairs), 256)


def hash_fold(identifier: Column, folds: int = 5) -> Column:
    """Fold from the first eight hex digits of SHA-256 over the decimal text of an integer id."""
    digits = F.substring(F.sha2(identifier.cast("bigint").cast("string"), 256), 1, 8)
    return F.conv(digits, 16, 10).cast("bigint") % folds


def exact_age(year: Column, month: Column, day: Column, as_of: Column) -> tuple[Column, Column]:
    """(age in years, status) at a date from possibly missing or impossible birth parts."""
    complete = year.isNotNull() & month.isNotNull() & day.isNotNull()
    born = F.try_to_timestamp(
        F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")),
        F.lit("yyyy-MM-dd"),
    ).cast("date")
    status = (
        F.when(year.isNull() & month.isNull() & day.isNull(), F.lit("missing_birth_date"))
        .when(~complete, F.lit("partial_birth_date"))
        .when(born.isNull(), F.lit("invalid_birth_date"))
        .when(born > as_of, F.lit("birth_after_as_of"))
        .otherwise(F.lit("exact_birth_date"))
    )
    age = F.when(status == "exact_birth_date", F.datediff(as_of, born) / F.lit(DAYS_PER_YEAR))
    return age, status
