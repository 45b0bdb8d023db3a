"""Calendar and sign features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def derive_calendar(df: DataFrame, date: str = "date", amount: str = "amount") -> DataFrame:
    """Month, quarter, year, day_of_week (Monday = 0), is_weekend, is_inflow,
    is_outflow, abs_amount. Month/quarter are the first day of the period."""
    d = F.col(date)
    return df.withColumns({
        "month": F.trunc(d, "MM"),
        "quarter": F.trunc(d, "quarter"),
        "year": F.year(d),
        "day_of_week": F.weekday(d),
        "is_weekend": F.weekday(d).isin(5, 6),
        "is_inflow": F.col(amount) > 0,
        "is_outflow": F.col(amount) < 0,
        "abs_amount": F.abs(F.col(amount)),
    })
