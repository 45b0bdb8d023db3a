"""Amount parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Strings shaped like a number (or nan / inf), checked before casting: a failed
# string -> double cast costs an exception per value, the regex check does not.
NUMBER_SHAPE = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf|infinity)\s*$"


def to_double(s: Column) -> Column:
    """``try_cast(s as double)`` that only attempts number-shaped strings."""
    return F.when(s.rlike(NUMBER_SHAPE), s.try_cast("double"))


# The same without nan: 'NaN' text is missing, not a number.
_AMOUNT_SHAPE = NUMBER_SHAPE.replace("nan|", "")


def _num(s: Column) -> Column:
    return F.when(s.rlike(_AMOUNT_SHAPE), s.try_cast("double"))


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once. Filters and CASE branches repeat what an expression names
    twice, so a chain of regexes doubles at each step there."""
    return F.get(F.transform(F.array(value), f), 0)


def clean_amount(col, mode: str = "basic") -> Column:
    """Text -> DOUBLE.

    basic:    strip ``$`` and ``,`` then parse, else NULL (P5).
    unsigned: also strip parentheses, so ``(99.00)`` reads as 99 (P6).
    robust:   parentheses or a leading minus give a negative value; currency symbols,
              USD/EUR/GBP (any case), commas, blanks and stray signs are removed (P7).
    """
    s = _c(col).cast("string")
    if mode == "basic":
        return _num(F.translate(s, "$,", ""))
    if mode == "unsigned":
        return _num(F.translate(s, "$,()", ""))
    if mode != "robust":
        raise ValueError(f"unknown mode {mode!r}")
    text = F.translate(F.regexp_replace(F.trim(s), r"(?i)(usd|eur|gbp|[$€£])", ""), ", \t\n\x0b\f\r", "")

    def signed(t: Column) -> Column:
        minus = (t.startswith("(") & t.rlike(r"^\(.*\)$")) | F.translate(t, "()", "").startswith("-")
        # no sign is left in the digits, so the number is not negative
        return let(F.translate(t, "()+-", ""), _num) * F.when(minus, F.lit(-1.0)).otherwise(F.lit(1.0))

    return let(text, signed)


def amount_invalid(col) -> Column:
    """True when a non-blank text does not parse under the robust rule."""
    s = _c(col).cast("string")
    return F.coalesce(F.trim(s) != "", F.lit(False)) & clean_amount(s, "robust").isNull()


def clean_amount_column(df: DataFrame, col: str = "amount") -> DataFrame:
    """P7 on a frame: parse in place, keep ``<col>_original`` and add ``<col>_invalid``."""
    return df.withColumns({
        f"{col}_original": F.col(col),
        col: clean_amount(F.col(col), "robust"),
        f"{col}_invalid": amount_invalid(F.col(col)),
    })
