"""Lookups, caches, similarity joins and model hooks.

Registries and taxonomies are small fixed tables and are broadcast; fuzzy matching runs
on DISTINCT values only and is joined back, never per row.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions import fixed_values as FV
from ..functions.similarity import token_sort_ratio
from ..functions.text import dedup_key
from .vector_join import neighbours, transfer


# ---- J9 decision cache --------------------------------------------------------------------
def reuse_cached_decisions(df: DataFrame, cache: DataFrame, decide, vendor: str = "vendor",
                           amount: str = "amount", date: str = "date", category: str = "category"
                           ) -> tuple[DataFrame, DataFrame]:
    """Look rows up in a decision cache (key = md5 of vendor_amount_date); rows not
    found get ``decide(frame) -> Column`` and become new cache entries.

    Returns (rows with category, new cache rows to append)."""
    keyed = df.withColumn("_key", dedup_key(vendor, amount, date))
    hits = keyed.join(cache.select(F.col("key").alias("_key"), F.col("category").alias("_cached")), "_key", "left")
    out = hits.withColumn(category, F.coalesce(F.col("_cached"), decide(hits))) \
        .withColumn("cache_hit", F.col("_cached").isNotNull())
    new = (out.filter(~F.col("cache_hit")).groupBy("_key").agg(
        F.min_by(F.struct(F.col(vendor).cast("string").alias("vendor"), F.col(amount).cast("double").alias("amount"),
                          F.col(date).cast("string").alias("date"), F.col(category).alias("category")),
                 F.col(category)).alias("_r"))
           .select(F.col("_key").alias("key"), "_r.*", F.current_timestamp().alias("cached_at")))
    return out.drop("_key", "_cached"), new


# ---- J10 nearest-neighbour label transfer --------------------------------------------------
def similar_label_transfer(df: DataFrame, threshold: float = 0.8, k: int = 5, id_col: str = "vec_id",
                           vec: str = "embedding", label: str = "label", pivots: int | None = None,
                           block_rows: int | None = None) -> DataFrame:
    """For each row, the neighbours (self excluded) with inner product > threshold,
    top-k by similarity, ties by id; the best neighbour's label is transferred.

    Exact for vectors of any length: a metric index (``vector_join``) leaves out only what the triangle
    inequality rules out. ``pivots`` defaults to four times the root of the number of distinct vectors, bounded by
    ``PIVOTS_MOST``. Pruning is strong for clustered vectors; vectors without structure meet all others, in
    blocks of ``block_rows`` (by default, what 8 MB hold), and are copied once a block and not once a pivot. Rows whose vector is NULL, holds a NULL or non-finite entry, or is shorter than the
    longest have no neighbours; rows are known by their id."""
    near = neighbours(df, id_col, vec, label, threshold, k, pivots, block_rows)
    return transfer(df, id_col, vec, near, k)


# ---- J11 semantic duplicates ------------------------------------------------------------------
def semantic_duplicates(df: DataFrame, vendor: str = "vendor", memo: str = "memo", amount: str = "amount",
                        date: str = "date", row_id: str = "row_id", least_jaccard: float = 0.5) -> DataFrame:
    """J11 re-aimed: a later row is dropped when an earlier row has a similar text '<vendor> <memo>' (Jaccard
    index of the word sets of at least ``least_jaccard``; NULL reads 'nan') and meets the J5 amount/date rule.

    Exact (``similar_rows``): rows meet at the first word that they share, the rarest words coming first, and rows whose
    texts are similar by a common memo alone are settled by cells of date and amount, so pairs of texts are
    never listed, as a memo that all vendors use makes all of their texts similar. Texts without a word match nothing."""
    from .dedup import _drop_rows, _probe_base
    from .similar_rows import earlier_similar
    text = F.lower(F.concat_ws(" ", F.coalesce(F.col(vendor).cast("string"), F.lit("nan")),
                               F.coalesce(F.col(memo).cast("string"), F.lit("nan"))))
    base = _probe_base(df, block=F.lit("all"), row_id=row_id, date=date, amount=amount, vname=text)
    words = F.array_distinct(F.filter(F.split("vlow", r"\s+"), lambda x: x != ""))
    dropped = earlier_similar(base.withColumn("toks", words), least=least_jaccard, days=3, tol=0.05)
    return _drop_rows(df, dropped, row_id)


# ---- J12, J13, J14, P18 --------------------------------------------------------------------------
def vendor_registry(spark: SparkSession) -> DataFrame:
    rows = [(c, c.lower()) for c, _ in FV.VENDOR_REGISTRY] + \
           [(c, a.lower()) for c, aliases in FV.VENDOR_REGISTRY for a in aliases]
    return spark.createDataFrame(rows, "canonical string, alias_lower string")


def normalize_vendor(df: DataFrame, vendor: str = "vendor", threshold: float = 80,
                     out: str = "canonical_vendor") -> DataFrame:
    """Exact canonical/alias match (any case), else the canonical name with the best
    token-sort similarity when >= threshold; NULL otherwise. Fuzzy scoring runs on the
    distinct unmatched vendor strings against the registry (fixed size, broadcast)."""
    spark = df.sparkSession
    reg = F.broadcast(vendor_registry(spark))
    names = df.select(F.col(vendor).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    exact = names.join(reg, F.lower("_v") == F.col("alias_lower")).groupBy("_v").agg(F.min("canonical").alias("_c1"))
    order = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (c, _) in enumerate(FV.VENDOR_REGISTRY)])
    fuzzy = (names.join(exact, "_v", "left_anti").withColumn("_r", F.explode(order))
             .withColumn("_s", token_sort_ratio(F.col("_v"), F.col("_r.c")))
             .groupBy("_v").agg(F.min_by(F.struct("_r.c", "_s"), F.struct(-F.col("_s"), F.col("_r.i"))).alias("_b"))
             .select("_v", F.when(F.col("_b._s") >= threshold, F.col("_b.c")).alias("_c2")))
    m = exact.join(fuzzy, "_v", "full").select("_v", F.coalesce("_c1", "_c2").alias(out))
    return df.join(m, F.col(vendor) == F.col("_v"), "left").drop("_v")


def normalize_category(df: DataFrame, vendor: str = "canonical_vendor", category: str = "category",
                       out: str = "canonical_category", threshold: float = 75) -> DataFrame:
    """Exact (vendor, category) registry pair, else the best of that vendor's
    registry categories by token-sort similarity when >= 75."""
    spark = df.sparkSession
    reg = F.broadcast(spark.createDataFrame([(v, c, i) for i, (v, c, _, _) in enumerate(FV.CATEGORY_REGISTRY)],
                                            "_rv string, _rc string, _ri int"))
    pairs = df.select(F.col(vendor).alias("_v"), F.col(category).alias("_k")).filter(
        F.col("_v").isNotNull() & F.col("_k").isNotNull()).distinct()
    cand = pairs.join(reg, F.col("_v") == F.col("_rv")).withColumn(
        "_s", F.when(F.col("_k") == F.col("_rc"), F.lit(1000.0)).otherwise(token_sort_ratio(F.col("_k"), F.col("_rc"))))
    best = cand.groupBy("_v", "_k").agg(F.min_by(F.struct("_rc", "_s"), F.struct(-F.col("_s"), F.col("_ri"))).alias("_b"))
    m = best.select("_v", "_k", F.when(F.col("_b._s") >= threshold, F.col("_b._rc")).alias(out))
    return df.join(m, (F.col(vendor) == F.col("_v")) & (F.col(category) == F.col("_k")), "left").drop("_v", "_k")


def template_memos(df: DataFrame, vendor: str = "vendor", category: str = "category", out: str = "template_memo"
                   ) -> DataFrame:
    """P18: '<canonical vendor> <descriptor>' when both vendor and category resolve."""
    from ..functions.text import template_memo
    spark = df.sparkSession
    reg = F.broadcast(spark.createDataFrame([(v, c, d) for v, c, _, d in FV.CATEGORY_REGISTRY],
                                            "_tv string, _tc string, _td string"))
    x = normalize_category(normalize_vendor(df, vendor, out="_cv"), vendor="_cv", category=category, out="_cc")
    x = x.join(reg, (F.col("_cv") == F.col("_tv")) & (F.col("_cc") == F.col("_tc")), "left")
    return x.withColumn(out, template_memo(F.col("_cv"), F.col("_td"))).drop("_cv", "_cc", "_tv", "_tc", "_td")


def canonicalize_category(df: DataFrame, category: str = "category", threshold: float = 80) -> DataFrame:
    """Lower-case, '-'/'_' -> space; exact canonical name, else best token-sort match
    >= threshold, else 'Other'; blank -> NULL. Scored on distinct values x 33 names."""
    norm = F.replace(F.replace(F.lower(F.trim(F.col(category))), F.lit("-"), F.lit(" ")), F.lit("_"), F.lit(" "))
    vals = df.select(F.col(category).alias("_raw"), norm.alias("_n")).filter(
        F.col("_raw").isNotNull() & (F.trim("_raw") != "")).distinct()
    names = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(c.lower()).alias("l"))
                      for i, c in enumerate(FV.CATEGORIES)])
    sc = vals.withColumn("_t", F.explode(names)).withColumn(
        "_s", F.when(F.col("_n") == F.col("_t.l"), F.lit(1000.0)).otherwise(token_sort_ratio(F.col("_n"), F.col("_t.l"))))
    best = sc.groupBy("_raw").agg(F.min_by(F.struct("_t.c", "_s"), F.struct(-F.col("_s"), F.col("_t.i"))).alias("_b"))
    m = best.select("_raw", F.when(F.col("_b._s") >= threshold, F.col("_b.c")).otherwise(F.lit("Other")).alias("_canon"))
    return df.join(m, F.col(category) == F.col("_raw"), "left").withColumn(category, F.col("_canon")) \
        .drop("_raw", "_canon")


# ---- J15-J18 ---------------------------------------------------------------------------------
def semi_filter(df: DataFrame, selected: DataFrame, vendor: str = "vendor", keep: bool = True) -> DataFrame:
    """Rows whose vendor is (keep=True) or is not in ``selected``."""
    return df.join(selected.select(vendor).distinct(), vendor, "left_semi" if keep else "left_anti")


def attach_vendor_risk(df: DataFrame, risk: DataFrame, vendor: str = "vendor") -> DataFrame:
    """Vendor -> risk level (one row per vendor), default 'Unknown'."""
    r = risk.groupBy(vendor).agg(F.first("risk_level").alias("_rl"))
    return df.join(r, vendor, "left").withColumn("vendor_risk", F.coalesce("_rl", F.lit("Unknown"))).drop("_rl")


def lookup_vendor_frequency(df: DataFrame, vendor: str = "vendor") -> DataFrame:
    """Rows per vendor attached to each row (aggregate + join: a vendor with a third
    of the rows is pre-aggregated, not windowed in one task)."""
    c = df.filter(F.col(vendor).isNotNull()).groupBy(vendor).agg(F.count("*").alias("vendor_frequency"))
    return df.join(c, vendor, "left").withColumn("vendor_frequency", F.coalesce("vendor_frequency", F.lit(0)))


def quality_diff(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows removed and columns added / removed between two versions."""
    o = original.agg(F.count("*").alias("original_rows"))
    c = cleaned.agg(F.count("*").alias("cleaned_rows"))
    from .common import with_scalars
    added = sorted(set(cleaned.columns) - set(original.columns))
    removed = sorted(set(original.columns) - set(cleaned.columns))
    return with_scalars(o, c).select(
        "original_rows", "cleaned_rows", (F.col("original_rows") - F.col("cleaned_rows")).alias("rows_removed"),
        F.lit(", ".join(added)).alias("columns_added"), F.lit(", ".join(removed)).alias("columns_removed"))


def row_diff(original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """J18 row level: rows of ``original`` missing from ``cleaned`` (multiset difference)."""
    common = [c for c in original.columns if c in cleaned.columns]
    return original.select(*common).exceptAll(cleaned.select(*common))


# ---- X4, X5 ---------------------------------------------------------------------------------------
def score_in_batches(df: DataFrame, fn, out_col: str, fallback: Column, batch: int = 20, out_type: str = "string",
                     allowed: list[str] | None = None, other: str = "Other", name: str | None = None
                     ) -> tuple[DataFrame, Observation]:
    """Call ``fn(pandas.DataFrame) -> sequence``, the pluggable model hook, on batches of ``batch`` rows
    inside each partition (Arrow batches, no driver round trip). The hook is what costs: deal rows that come from few
    files or blocks over more partitions first.

    A batch whose call raises, or returns another number of values than rows, keeps the deterministic
    ``fallback``; values outside ``allowed`` become ``other``. ``<out_col>_from`` tells ``model`` or ``fallback``
    by row. Returns the scored frame and an observation that the next action on it fills: ``batches``, ``failed_batches``, ``wrong_lengths``, ``fallback_rows``, ``other_values``, ``rows``."""
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType, _parse_datatype_string
    x = df.withColumn("_fallback", fallback.cast(out_type))
    marks = ("_batch", "_failed", "_wrong", "_other")
    schema = StructType([*x.schema.fields, StructField(out_col, _parse_datatype_string(out_type), True),
                         StructField(out_col + "_from", StringType(), False), *[StructField(m, IntegerType(), False) for m in marks]])

    def run(it):
        for pdf in it:
            body, defaults = pdf.drop(columns=["_fallback"]), pdf["_fallback"].tolist()
            values, source, marked = [], [], {m: [0] * len(pdf) for m in marks}
            for start in range(0, len(pdf), batch):
                chunk = body.iloc[start:start + batch]
                marked["_batch"][start] = 1
                try:
                    got = list(fn(chunk))
                    problem = "_wrong" if len(got) != len(chunk) else None
                except Exception:  # noqa: BLE001 - whatever the hook raises, the batch falls back and is counted
                    problem = "_failed"
                if problem:
                    marked[problem][start] = 1
                    got = defaults[start:start + batch]
                elif allowed is not None:
                    for k, v in enumerate(got):
                        if v not in allowed:
                            got[k], marked["_other"][start + k] = other, 1
                values += got
                source += ["fallback" if problem else "model"] * len(chunk)
            yield pdf.assign(**{out_col: pd.Series(values, index=pdf.index, dtype=object), out_col + "_from": source, **marked})

    counts = Observation(name or f"scored-{out_col}-{uuid.uuid4().hex}")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    out = x.mapInPandas(run, schema).observe(
        counts, total("_batch").alias("batches"), total("_failed").alias("failed_batches"), total("_wrong").alias("wrong_lengths"),
        F.count_if(F.col(out_col + "_from") == "fallback").alias("fallback_rows"), total("_other").alias("other_values"),
        F.count(F.lit(1)).alias("rows"))
    return out.drop("_fallback", *marks), counts


def parse_model_json(col, schema: str) -> Column:
    """Parse a model response: as is, from a fenced block, from the first [...] span,
    or from the text between the outermost brackets."""
    c = F.col(col) if isinstance(col, str) else col
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    arr = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    brace = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    # a strategy counts where its text is valid JSON; from_json alone gives a struct of NULLs for any text
    valid = lambda t: F.when(F.get_json_object(t, "$").isNotNull(), F.from_json(t, schema))
    return F.coalesce(*[valid(t) for t in (c, fenced, arr, brace)])
