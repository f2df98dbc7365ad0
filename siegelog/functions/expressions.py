"""Column expressions shared by the plans. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a CSV reader of the source data treats as missing.
MISSING_WORDS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Spellings of a missing coordinate, compared in lower case.
MISSING_NUMBERS = ("nan", "none", "", "null")

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_double(c: Column | str) -> Column:
    """Text to DOUBLE; missing words and anything that is not a number give NULL."""
    text = F.trim(as_column(c))
    usable = ~F.lower(text).isin(*MISSING_NUMBERS) & text.rlike(_NUMBER)
    return F.when(usable, text.try_cast("double"))


def whole_number_or_zero(c: Column | str) -> Column:
    """Text to BIGINT by way of DOUBLE (``22.7`` is 22); bad or missing text is 0."""
    number = safe_double(c).try_cast("bigint")
    return F.coalesce(number, F.lit(0).cast("bigint"))


def text_or(c: Column | str, missing_text: str | None) -> Column:
    """Text with the missing words replaced by ``missing_text`` (None: by NULL)."""
    text = as_column(c)
    return F.when(
        text.isNull() | text.isin(*MISSING_WORDS), F.lit(missing_text).cast("string")
    ).otherwise(text)


def present(c: Column | str, *sentinels: str) -> Column:
    """Neither NULL nor one of the sentinel texts."""
    text = as_column(c)
    return text.isNotNull() & ~text.isin(*sentinels) if sentinels else text.isNotNull()


def absent(c: Column | str, *sentinels: str) -> Column:
    """NULL or one of the sentinel texts."""
    return ~present(c, *sentinels)


def round_half_up(c: Column | str, digits: int) -> Column:
    """Round a DOUBLE, halves away from zero, on the binary value.

    ``F.round`` goes through the decimal text of the number, other engines do
    not; scaling and flooring gives one answer everywhere.
    """
    value, scale = as_column(c), float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def percent(part: Column | str, whole: Column | str) -> Column:
    """100 * part / whole as DOUBLE; NULL where whole is 0 or NULL."""
    part, whole = as_column(part).cast("double"), as_column(whole).cast("double")
    return F.when(whole != 0, F.lit(100.0) * part / whole)


def change_pct_from_one(value: Column, previous: Column) -> Column:
    """Percent change for the summaries: a previous value of 0 counts as 1."""
    value, previous = value.cast("double"), previous.cast("double")
    return F.when(previous == 0, (value - F.lit(1.0)) * F.lit(100.0)).otherwise(
        (value - previous) / previous * F.lit(100.0)
    )


def change_pct_or_zero(value: Column, previous: Column) -> Column:
    """Percent change for the volatility tables: 0 unless the previous value is positive."""
    value, previous = value.cast("double"), previous.cast("double")
    return F.when(previous > 0, (value - previous) * F.lit(100.0) / previous).otherwise(
        F.lit(0.0)
    )


def day_text(c: Column | str) -> Column:
    return as_column(c).cast("string")
