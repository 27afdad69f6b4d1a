"""Label text: dashes, cohort names and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratarates.functions.nulls import as_col, once

EN_DASH = "–"
# An en dash whose UTF-8 bytes were read as Windows-1252.
BROKEN_EN_DASH = "â€“"


def hyphen_to_en_dash(c: Column | str) -> Column:
    return F.replace(as_col(c), F.lit("-"), F.lit(EN_DASH))


def mend_en_dash(c: Column | str) -> Column:
    return F.replace(as_col(c), F.lit(BROKEN_EN_DASH), F.lit(EN_DASH))


def first_word(c: Column | str) -> Column:
    return F.split_part(as_col(c), F.lit(" "), F.lit(1))


def before(c: Column | str, separator: str) -> Column:
    """Text up to the first occurrence of a literal separator, else all of it."""
    return F.substring_index(as_col(c), separator, 1)


def has_star(c: Column | str) -> Column:
    return as_col(c).contains("*")


def drop_trailing_star(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), r"\*$", "")


def round_half_even(c: Column | str, digits: int) -> Column:
    """Round a DOUBLE to ``digits`` decimals (0 to 12): to the nearer decimal of its exact
    value, and a tie of that, as 0.125 is one, to the even digit.

    A printed tie is seldom one: 2.675 is a little less than it says and gives 2.67.  So the
    exact value is taken apart as ``m / 2**s`` with whole m, and ``m * 10**digits``
    is divided by ``2**s`` in whole numbers, with a remainder to compare with one half.
    """
    if not 0 <= digits <= 12:
        raise ValueError("digits must be between 0 and 12")
    def power(bits: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), bits).cast("decimal(19,0)")

    def fraction(size: Column, shift: Column) -> Column:
        mantissa = (size * F.pow(F.lit(2.0), shift.cast("double"))).cast("bigint")
        divisor = power(F.least(shift, F.lit(60))) * power(F.greatest(shift - 60, F.lit(0)))
        scaled = mantissa.cast("decimal(19,0)") * F.lit(10**digits).cast("decimal(19,0)")
        return F.struct(scaled.alias("scaled"), divisor.alias("divisor"))

    def divided(f: Column) -> Column:
        return F.struct(
            F.call_function("div", f["scaled"], f["divisor"]).alias("quotient"),
            ((f["scaled"] % f["divisor"]) * F.lit(2).cast("decimal(1,0)")).alias("twice"),
            f["divisor"].alias("divisor"),
        )

    def nearer(d: Column) -> Column:
        up = (d["twice"] > d["divisor"]) | ((d["twice"] == d["divisor"]) & (d["quotient"] % 2 == 1))
        return (d["quotient"] + up.cast("int")).cast("double") / 10.0**digits

    def rounded(size: Column) -> Column:
        # one bit more than needed, should the logarithm be off at a power of two
        shift = (F.lit(53) - F.floor(F.log2(size))).cast("int")
        parts = once(shift, lambda s: fraction(size, s))
        return once(once(parts, divided), nearer)

    def signed(x: Column) -> Column:
        size = F.abs(x)
        return (
            # from there on doubles lie further apart than the decimals: x is the nearest
            F.when(F.isnan(x) | (size >= 2.0**53 / 10**digits), size)
            .when(size < 0.25 / 10**digits, F.lit(0.0))
            .otherwise(rounded(size))
        ) * F.signum(x)

    return once(as_col(c).cast("double"), signed)


def fixed_decimals(c: Column | str, digits: int) -> Column:
    """Rounded number with exactly ``digits`` decimals; NULL stays NULL."""
    # adding 0.0 turns -0.0 into 0.0, so no label reads "-0.00"
    return once(
        round_half_even(c, digits),
        lambda rounded: F.when(
            rounded.isNotNull(), F.format_string(f"%.{digits}f", rounded + F.lit(0.0))
        ),
    )


def short_decimals(c: Column | str, digits: int) -> Column:
    """Rounded number without trailing zeros (1.20 -> 1.2, 10.0 -> 10)."""
    return F.regexp_replace(
        F.regexp_replace(fixed_decimals(c, digits), r"(\.\d*?)0+$", "$1"), r"\.$", ""
    )
