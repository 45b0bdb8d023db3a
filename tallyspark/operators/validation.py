"""Validation (V1-V6). Each check is an aggregate (``count_if``) over the whole column.
V7 (mapping checks) lives with the mapping operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from .common import with_scalars
from .quantiles import exact_quantiles

LEDGER_SCHEMA = {"date": "timestamp", "vendor": "string", "amount": "double", "category": "string",
                 "description": "string", "memo": "string"}


def _checked(df: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """One row a check of the named columns: (column, check, passed, valid, invalid), all from one aggregate.

    ``fields`` pairs a column with ``numeric``, ``date`` or ``text``. The quartiles of all numeric columns come
    from one more pass (``exact_quantiles``); a column without a value passes its range check."""
    numbers = [c for c, kind in fields if kind == "numeric"]
    if numbers:
        quartiles = exact_quantiles(df, {f"_{q}_{i}": (F.col(f"`{c}`").cast("double"), p) for i, c in enumerate(numbers)
                                         for q, p in (("lo", 0.25), ("hi", 0.75))})
        df = with_scalars(df, quartiles)
    aggs, rows = [], []

    def check(column: str, name: str, valid, total) -> None:
        i = len(rows)
        aggs.extend([valid.alias(f"v{i}"), total.alias(f"n{i}")])
        v, n = F.col(f"v{i}"), F.col(f"n{i}")
        rows.append(F.struct(F.lit(column).alias("column"), F.lit(name).alias("check"), (v == n).alias("passed"),
                             v.alias("valid"), (n - v).alias("invalid")))

    for c, kind in fields:
        x, everything = F.col(f"`{c}`"), F.count(F.lit(1))
        if kind == "numeric":
            x, i = x.cast("double"), numbers.index(c)
            lo, hi = F.col(f"_lo_{i}"), F.col(f"_hi_{i}")
            reach = 1.5 * (hi - lo)
            check(c, "all_positive", F.count_if(x > 0), F.count(x))
            check(c, "iqr_range", F.count_if((x >= lo - reach) & (x <= hi + reach)), F.count(x))
        elif kind == "date":
            check(c, "not_null", F.count(x), everything)
        else:
            check(c, "non_empty", F.count_if(F.coalesce(F.trim(x.cast("string")) != "", F.lit(False))), everything)
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def validate_numeric(df: DataFrame, col: str) -> DataFrame:
    """V1: all-positive check and IQR range check (Q1 - 1.5 IQR .. Q3 + 1.5 IQR)."""
    return _checked(df, [(col, "numeric")])


def validate_date(df: DataFrame, col: str) -> DataFrame:
    """V2: non-null check."""
    return _checked(df, [(col, "date")])


def validate_text(df: DataFrame, col: str) -> DataFrame:
    """V3: non-empty per row (trimmed)."""
    return _checked(df, [(col, "text")])


def validate_table(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V4: per-column checks (numeric -> V1, date/timestamp -> V2, text -> V3; other types have none) and
    the overall score = passed / total checks. Returns (checks, score)."""
    fields = []
    for f in df.schema.fields:
        if isinstance(f.dataType, NumericType):
            fields.append((f.name, "numeric"))
        elif isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            fields.append((f.name, "date"))
        elif isinstance(f.dataType, StringType):
            fields.append((f.name, "text"))
    checks = _checked(df, fields)
    score = checks.agg(F.count("*").alias("total_checks"), F.count_if("passed").alias("passed_checks")) \
        .withColumn("score", F.col("passed_checks") / F.col("total_checks"))
    return checks, score


def validation_history(runs: DataFrame) -> DataFrame:
    """V5: over a results table (run_id, run_ts, score, columns_validated): runs, latest
    and average score, columns validated in the latest run."""
    return runs.agg(F.count("*").alias("runs"), F.max_by("score", "run_ts").alias("latest_score"),
                    F.avg("score").alias("average_score"),
                    F.max_by("columns_validated", "run_ts").alias("columns_validated"))


def validate_schema(df: DataFrame, schema: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """V6: cast to the typed, nullable ledger schema; rows where a non-null raw value
    fails its cast go to quarantine (with the failing columns), the rest are valid."""
    schema = schema or LEDGER_SCHEMA
    cols = [c for c in schema if c in df.columns]
    casted = {c: F.col(c).cast("string").try_cast(schema[c]) if schema[c] != "string" else F.col(c).cast("string")
              for c in cols}
    bad = F.filter(F.array(*[F.when(F.col(c).isNotNull() & casted[c].isNull(), F.lit(c)) for c in cols]),
                   lambda x: x.isNotNull())
    x = df.select(*[casted[c].alias(c) for c in cols], bad.alias("_bad"))
    valid = x.filter(F.size("_bad") == 0).drop("_bad")
    quarantine = x.filter(F.size("_bad") > 0).withColumnRenamed("_bad", "failed_columns")
    return valid, quarantine
