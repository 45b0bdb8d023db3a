"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def with_scalars(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row of ``df`` as scalar subqueries.

    ``stats`` is a global aggregate (exactly one row). Each of its columns becomes an
    uncorrelated scalar subquery: Spark merges them into one aggregate job and inlines
    the values, so no join (nested-loop or otherwise) and no driver round trip is
    involved, and the whole thing stays one lazy plan."""
    return df.withColumns({c: stats.select(F.col(f"`{c}`")).scalar() for c in stats.columns})


def rnd(c: Column, digits: int = 2) -> Column:
    """Round half away from zero after scaling (``round(x * 10^d) / 10^d``): exact
    halves such as a mean of .xx5 round the same way as in other SQL engines."""
    m = float(10 ** digits)
    return F.round(c * m) / m


def r2(c: Column) -> Column:
    return rnd(c, 2)


def money_mean(c: Column, digits: int = 2) -> Column:
    """Exact mean of a money column rounded to ``digits`` (half away from zero).

    The sum is taken in DECIMAL(38,4), so it is exact and independent of summation
    order, and the rounding uses exact integral division: a double mean can land
    either side of a half cent depending on the order rows were added.
    """
    s = F.sum(c.cast("decimal(38,4)"))
    n = F.count(c)
    scaled = F.call_function("div", F.abs(s) * (2 * 10 ** digits) + n, n * 2)
    return (F.signum(s) * scaled / float(10 ** digits)).cast("double")


def money_sum(c: Column, digits: int = 2) -> Column:
    """Exact sum of a money column rounded to ``digits`` (half away from zero)."""
    s = F.sum(c.cast("decimal(38,4)"))
    scaled = F.call_function("div", F.abs(s) * (2 * 10 ** digits) + 1, F.lit(2))
    return (F.signum(s) * scaled / float(10 ** digits)).cast("double")


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 or NULL."""
    return F.when(den != 0, num / den)


def slope(y: str | Column, x: str | Column) -> Column:
    """Least-squares slope of y on x (numpy polyfit degree 1 equivalent)."""
    y = F.col(y) if isinstance(y, str) else y
    x = F.col(x) if isinstance(x, str) else x
    return F.regr_slope(y, x)


def prepared(df: DataFrame, date: str = "date", amount: str = "amount") -> DataFrame:
    """Rows usable for analysis: non-null date and amount, plus calendar columns."""
    from ..functions.calendar import derive_calendar
    return derive_calendar(df.filter(F.col(date).isNotNull() & F.col(amount).isNotNull()), date, amount)


#: No group of probe rows that meets one row in ``spread_join`` is larger than this or a 4096th of all.
SPREAD_ROWS, SPREAD_SHARES = 10_000, 4096


def spread_join(probe: DataFrame, build: DataFrame, keys: list[str], how: str = "left", rows: str = "n") -> DataFrame:
    """Join ``probe`` with ``build`` (one row a key; ``rows`` counts how often the key stands in ``probe``) so that
    no key fills a task. A key above ``limit`` rows is dealt over numbered parts by the hash of its rows'
    other columns, and its row of ``build`` is repeated once a part. ``limit`` is at least a 4096th of all rows, so
    fewer than 4,096 keys lie above it: their part counts are broadcast, a table of proven size.
    ``build`` is read three times: pass a checkpointed or otherwise cheap frame."""
    total = build.agg(F.sum(rows)).first()[0] or 0
    limit = max(SPREAD_ROWS, -(-total // SPREAD_SHARES))
    parts = F.ceil(F.col(rows) / F.lit(limit)).cast("int")
    hot = build.filter(F.col(rows) > limit).select(*keys, parts.alias("_parts"))
    others = [c for c in probe.columns if c not in keys]
    dealt = (probe.join(F.broadcast(hot), keys, "left")
             .withColumn("_part", F.when(F.col("_parts").isNull(), F.lit(0))
                         .otherwise(F.pmod(F.xxhash64(*others), "_parts").cast("int"))).drop("_parts"))
    copies = build.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(rows)
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")
