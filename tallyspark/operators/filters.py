"""Filters and predicates (F1-F9) and null handling / type coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.fixed_values import CATEGORIES, NEEDS_VENDOR
from .common import with_scalars
from .quantiles import exact_quantiles


def drop_incomplete(df: DataFrame, cols=("vendor", "amount")) -> DataFrame:
    """drop rows missing any of ``cols``, but only if every column holds some data.

    The "holds some data" test is one aggregate attached to the rows (lazy, no action)."""
    present = [c for c in cols if c in df.columns]
    if len(present) < len(cols):
        return df
    has = df.agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(f"_has_{i}") for i, c in enumerate(cols)])
    all_have = " AND ".join(f"_has_{i} = 1" for i in range(len(cols)))
    complete = " AND ".join(f"`{c}` IS NOT NULL" for c in cols)
    j = with_scalars(df, has)
    return j.filter(F.expr(f"NOT ({all_have}) OR ({complete})")).drop(*[f"_has_{i}" for i in range(len(cols))])


def positive_amounts(df: DataFrame, amount: str = "amount") -> DataFrame:
    """amount > 0."""
    return df.filter(F.col(amount) > 0)


def not_canonical_category(col="category") -> Column:
    """value not in the 33 canonical category names (NULL counts as not canonical)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(~c.isin(*CATEGORIES), F.lit(True))


def needs_text(col) -> Column:
    """NULL, '', unknown, n/a or none (any case) -> needs a value (vendor or memo)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | F.lower(c.cast("string")).isin(*NEEDS_VENDOR)


def inflows(df: DataFrame, amount: str = "amount") -> DataFrame:
    """amount > 0."""
    return df.filter(F.col(amount) > 0)


def outflows(df: DataFrame, amount: str = "amount") -> DataFrame:
    """amount < 0."""
    return df.filter(F.col(amount) < 0)


def negative_balances(df: DataFrame, balance: str = "balance") -> DataFrame:
    """balance < 0."""
    return df.filter(F.col(balance) < 0)


def zero_balances(df: DataFrame, balance: str = "balance") -> DataFrame:
    """balance == 0."""
    return df.filter(F.col(balance) == 0)


def drop_null_dates_amounts(df: DataFrame, date: str = "date", amount: str = "amount") -> DataFrame:
    """F8: drop rows with a NULL date or amount."""
    return df.dropna(subset=[date, amount])


def rlike_accounts(col: str, pattern: str) -> Column:
    """case-insensitive regex on account names."""
    return F.col(col).rlike("(?i)" + pattern)


# ---- N1-N5 -----------------------------------------------------------------------------------
def fill_nulls(df: DataFrame, strategy: str = "median") -> tuple[DataFrame, DataFrame]:
    """Numeric columns -> 0 when all NULL, else the column median (strategy 'median');
    string columns -> 'Unknown'; other all-NULL columns -> ''.

    One aggregation computes every null count and one pass every median; the fill values are attached
    as scalars. Returns (filled frame, report of filled columns)."""
    fields = df.schema.fields
    aggs = []
    for i, f in enumerate(fields):
        aggs.append(F.count(F.col(f.name)).alias(f"_n{i}"))
        aggs.append(F.count_if(F.col(f.name).isNull()).alias(f"_z{i}"))
    medians = {f"_m{i}": (F.col(f"`{f.name}`"), 0.5) for i, f in enumerate(fields) if isinstance(f.dataType, NumericType)}
    stats = df.agg(*aggs)
    if medians and strategy == "median":
        stats = with_scalars(stats, exact_quantiles(df, medians))
    j = with_scalars(df, stats)
    cols, report = [], []
    for i, f in enumerate(fields):
        c, n, z = F.col(f.name), F.col(f"_n{i}"), F.col(f"_z{i}")
        if isinstance(f.dataType, NumericType):
            fill = F.when(n == 0, F.lit(0.0))
            if strategy == "median":
                fill = fill.otherwise(F.col(f"_m{i}"))
            cols.append(F.coalesce(c, fill.cast(f.dataType)).alias(f.name))
            filled = (n == 0) | ((z > 0) & F.col(f"_m{i}").isNotNull()) if strategy == "median" else (n == 0)
        elif isinstance(f.dataType, StringType):
            cols.append(F.coalesce(c, F.lit("Unknown")).alias(f.name))
            filled = z > 0
        else:
            cols.append(c.alias(f.name))   # typed column kept; all-NULL is reported only
            filled = n == 0
        report.append(F.when(filled, F.lit(f.name)))
    out = j.select(*cols)
    rep = stats.select(F.explode(F.filter(F.array(*report), lambda x: x.isNotNull())).alias("filled_column")) \
        if report else stats.select(F.lit(None).cast("string").alias("filled_column")).limit(0)
    return out, rep


def coerce_types(df: DataFrame, spec: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``try_cast`` each column of ``spec`` to its type; failures are the rows whose
    raw value was non-null but did not convert: (coerced frame, (column, value, n))."""
    out = df.select(*[F.col(c).try_cast(spec[c]).alias(c) if c in spec else F.col(c) for c in df.columns])
    fails = []
    for c, t in spec.items():
        bad = df.filter(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull())
        fails.append(bad.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"))
                     .withColumn("column", F.lit(c)))
    from functools import reduce
    failures = reduce(DataFrame.unionByName, fails) if fails else None
    return out, failures


def convert_data_types(df: DataFrame) -> DataFrame:
    """Columns named date* -> DATE, amount/total/sum -> DOUBLE, the rest -> STRING."""
    cols = []
    for c in df.columns:
        lc = c.lower()
        if lc.startswith("date"):
            from ..functions.dates import coerce_date
            cols.append(coerce_date(F.col(c)).alias(c))
        elif any(k in lc for k in ("amount", "total", "sum")):
            from ..functions.amounts import to_double
            cols.append(to_double(F.col(c).cast("string")).alias(c))
        else:
            cols.append(F.col(c).cast("string").alias(c))
    return df.select(*cols)


def finalize_types(df: DataFrame) -> DataFrame:
    """Numeric NULL -> 0, everything else as STRING."""
    return df.select(*[F.coalesce(F.col(f.name), F.lit(0).cast(f.dataType)).alias(f.name)
                       if isinstance(f.dataType, NumericType) else F.col(f.name).cast("string").alias(f.name)
                       for f in df.schema.fields])


def replace_values(df: DataFrame, col: str, mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Exact-value replacement (e.g. vendor aliases) and the number of rows changed."""
    c = F.col(col)
    new = c
    for k, v in mapping.items():
        new = F.when(c == k, F.lit(v)).otherwise(new)
    out = df.withColumn(col, new)
    changed = df.agg(F.count_if(c.isin(*mapping.keys())).alias("rows_affected"))
    return out, changed
