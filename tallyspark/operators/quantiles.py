"""Exact quantiles of whole columns without a task that sees all values.

Values are counted, range-partitioned, and the totals of the partitions give each one its first
rank; only the partitions that hold a wanted rank are sorted, and the values at the ranks are picked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row with the quantile ``p`` of a numeric expression for each ``name: (expression, p)``.

    Linear interpolation between the two nearest ranks, as ``percentile`` and ``quantile_cont`` do. NULLs are left
    out; a column without a value gives NULL. NaN counts as the largest value. All expressions share one
    scan. Equal values are summed in the map tasks; the number of partitions bounds what is sorted
    together and the table of their totals, which is broadcast.
    """
    names, exprs = list(wanted), {}
    for e, _ in wanted.values():
        exprs.setdefault(str(e), (len(exprs), e))
    which = {n: exprs[str(e)][0] for n, (e, _) in wanted.items()}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), e.cast("double").alias("v"))
                                         for i, e in exprs.values()])).alias("x")).select("x.*").filter("v is not null")
    # written once: the ranges must be the same for the totals and for the ranks
    counts = cut_lineage(long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("c", "v")
                         .withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (counts.groupBy("c", "part").agg(F.sum("n").alias("rows"))
              .withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
              .withColumn("all", F.sum("rows").over(Window.partitionBy("c"))))

    def place(name: str) -> Column:
        return (F.col("all") - 1) * F.lit(float(wanted[name][1]))

    ends = {(n, side): (f(place(n)).cast("long")) for n in names for side, f in (("lo", F.floor), ("hi", F.ceil))}
    holds = F.lit(False)
    for (n, _), rank in ends.items():
        holds = holds | ((F.col("c") == which[n]) & (rank >= F.col("start")) & (rank < F.col("start") + F.col("rows")))
    run = Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (counts.join(F.broadcast(totals.filter(holds)), ["c", "part"])
              .withColumn("end", F.col("start") + F.sum("n").over(run)))
    at = {k: (F.col("c") == which[k[0]]) & (rank < F.col("end")) & (rank >= F.col("end") - F.col("n")) for k, rank in ends.items()}
    picked = ranked.agg(*[F.max(F.when(at[n, side], F.col("v"))).alias(f"{side}{i}") for i, n in enumerate(names) for side in ("lo", "hi")],
                        *[F.max(F.when(at[n, "lo"], place(n) - ends[n, "lo"])).alias(f"f{i}") for i, n in enumerate(names)])
    # equal neighbours are returned as they are: no rounding, and infinities stay
    return picked.select(*[F.when(F.col(f"lo{i}") == F.col(f"hi{i}"), F.col(f"lo{i}"))
                           .otherwise(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}")).alias(n)
                           for i, n in enumerate(names)])
