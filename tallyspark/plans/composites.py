"""Composite cleaning paths (P20-P26, X9-X14) built from the operators. Each returns
``(cleaned frame, dict of report frames)`` and is one lazy plan until written; the
fan-out points (after de-duplication) are checkpointed to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from ..functions import fixed_values as FV
from ..functions.amounts import clean_amount, clean_amount_column
from ..functions.dates import normalize_dates, standardize_date, standardize_dates
from ..functions.text import capitalize_memo, capitalize_vendor, clean_text, digits_only, email_valid, fill_memo, \
    title_case
from ..operators import categorize as C
from ..operators import dedup as D
from ..operators import enrich as E
from ..operators import filters as FL
from ..operators import mapping as H
from ..operators.aggregates import quality_report
from .registry import RuleRegistry


def _cols_with(df: DataFrame, words: list[str]) -> list[str]:
    return [c for c in df.columns if any(w in c.lower() for w in words)]


def _text_cols(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


# ---- per-kind cleaners (P20-P24) -----------------------------------------------------------
def clean_customers(df: DataFrame) -> DataFrame:
    """P20: exact de-dup, names title case, email check column, phone digits, date and
    amount columns by header keyword."""
    out = df.dropDuplicates()
    repl = {}
    for c in _cols_with(out, ["name", "first", "last"]):
        repl[c] = title_case(F.col(f"`{c}`").cast("string"))
    for c in _cols_with(out, ["email"]):
        repl[f"{c}_valid"] = email_valid(F.col(f"`{c}`"))
    for c in _cols_with(out, ["phone"]):
        repl[c] = digits_only(F.col(f"`{c}`"))
    for c in _cols_with(out, ["date", "created", "updated", "purchase"]):
        repl[c] = standardize_date(F.col(f"`{c}`"))
    for c in _cols_with(out, ["spend", "amount", "total"]):
        repl[c] = clean_amount(F.col(f"`{c}`"), "basic")
    return out.withColumns(repl)


def clean_vendors(df: DataFrame) -> DataFrame:
    """Exact de-dup, names title case, date columns parsed."""
    out = df.dropDuplicates()
    repl = {c: title_case(F.col(f"`{c}`").cast("string")) for c in _cols_with(out, ["name"])}
    repl.update({c: standardize_date(F.col(f"`{c}`")) for c in _cols_with(out, ["date", "created", "last_order"])})
    return out.withColumns(repl)


def clean_inventory(df: DataFrame) -> DataFrame:
    """Exact de-dup, names title case, quantity / price columns numeric."""
    out = df.dropDuplicates()
    repl = {c: title_case(F.col(f"`{c}`").cast("string")) for c in _cols_with(out, ["name"])}
    repl.update({c: clean_amount(F.col(f"`{c}`"), "basic") for c in _cols_with(out, ["quantity", "qty", "price",
                                                                                       "cost"])})
    return out.withColumns(repl)


def clean_accounts(df: DataFrame) -> DataFrame:
    """Exact de-dup, balance / amount / total columns as unsigned numbers."""
    out = df.dropDuplicates()
    return out.withColumns({c: clean_amount(F.col(f"`{c}`"), "unsigned")
                            for c in _cols_with(out, ["balance", "amount", "total"])})


def clean_generic(df: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Exact de-dup; text columns that look like dates (date regex on > 30 % of
    values, from the H0 profile) are parsed."""
    out = df.dropDuplicates()
    text = _text_cols(out)
    if not text:
        return out
    prof = profile if profile is not None else H.profile_columns(out.select(*[f"`{c}`" for c in text]),
                                                                 exact_distinct=False)
    datey = [r.column for r in prof.filter(H.is_date_column()).select("column").collect()]  # column names only
    return out.withColumns({c: standardize_date(F.col(f"`{c}`")) for c in datey if c in text})


def clean_transactions(df: DataFrame, row_id: str = "row_id") -> tuple[DataFrame, dict[str, DataFrame]]:
    """P25: canonical columns (H3), dates (P1), amounts (P5), text (P8), exact de-dup (J1),
    categories for rows that need one (C1)."""
    std, prov, dropped = H.standardize_columns(df, keep=(row_id,))
    out = standardize_dates(std, {"date": "date"}).withColumns({
        "amount": clean_amount(F.col("amount"), "basic"),
        "vendor": clean_text(F.col("vendor")), "category": clean_text(F.col("category")),
        "memo": clean_text(F.col("memo"))})
    out = D.drop_exact_duplicates(out, row_id) if row_id in out.columns else out.dropDuplicates()
    out = C.apply_simple(out)
    return out, {"provenance": prov, "dropped_columns": dropped, "quality": quality_report(df, out)}


def bulk_clean(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Global exact de-dup, title-cased text, unsigned amounts, date columns (by
    name) parsed, as one plan over the whole table."""
    out = D.drop_exact_duplicates(df, row_id) if row_id in df.columns else df.dropDuplicates()
    repl = {}
    out = standardize_dates(out, {f.name: f.name for f in out.schema.fields if "date" in f.name.lower()})
    for f in out.schema.fields:
        lc = f.name.lower()
        c = F.col(f"`{f.name}`")
        if "date" in lc:
            continue
        elif lc in ("amount", "balance", "total") or "amount" in lc:
            repl[f.name] = clean_amount(c, "unsigned")
        elif isinstance(f.dataType, StringType):
            repl[f.name] = title_case(c)
    return out.withColumns(repl)


# ---- X12, X13, X11, X14 ----------------------------------------------------------------------------
def core_clean(df: DataFrame, row_id: str = "row_id", fuzzy_threshold: float = 90,
               dedup_columns=("date", "amount", "description")) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Snake-case names -> dates (P3) -> nulls (N1) -> strings (P9) -> amount (P7) ->
    key de-dup (J2) -> adjacent fuzzy de-dup (J4) -> category (J14) -> vendor (P14) ->
    memo (P15)."""
    from ..functions.text import normalize_string
    from ..session import cut_lineage
    x = H.snake_case_columns(df)
    if "date" in x.columns:
        x = normalize_dates(x, "date")
    x, filled = FL.fill_nulls(x)
    x = x.select(*[normalize_string(F.col(f"`{f.name}`")).alias(f.name)
                   if isinstance(f.dataType, StringType) and f.name not in ("date_original",) else F.col(f"`{f.name}`")
                   for f in x.schema.fields])
    if "amount" in x.columns:
        x = clean_amount_column(x, "amount")
    # J4 reads its input four times: written once, so that parsing and J2 run once
    x = cut_lineage(D.drop_key_duplicates(x, dedup_columns, row_id))
    text = "description" if "description" in x.columns else ("memo" if "memo" in x.columns else None)
    if text and "date" in x.columns and "amount" in x.columns:
        x = D.fuzzy_adjacent_dedup(x, text=text, threshold=fuzzy_threshold, row_id=row_id)
    if "category" in x.columns:
        x = E.canonicalize_category(x)
    if "vendor" in x.columns:
        x = x.withColumn("vendor", capitalize_vendor(F.col("vendor")))
    if "memo" in x.columns:
        x = x.withColumn("memo", capitalize_memo(F.col("memo")))
    return x, {"filled_columns": filled}


def dream_clean(df: DataFrame, row_id: str = "row_id", cache: DataFrame | None = None,
                labelled: DataFrame | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Required columns (H20), exact de-dup (J1), drop incomplete (F1), title case,
    positive amounts (F2), cached decisions (J9) else rule category (C1), schema split
    (V6)."""
    from ..operators.validation import validate_schema
    x = H.ensure_columns(df)
    x = D.drop_exact_duplicates(x, row_id) if row_id in x.columns else x.dropDuplicates()
    x = FL.drop_incomplete(x, ("vendor", "amount"))
    x = x.withColumns({"vendor": title_case(F.col("vendor")), "category": title_case(F.col("category"))})
    x = FL.positive_amounts(x)
    reports = {}
    if cache is not None:
        x, new = E.reuse_cached_decisions(x, cache, lambda f: C.categorize_simple("vendor"))
        reports["new_cache_rows"] = new
    else:
        x = x.withColumn("category", F.when(C.needs_category("category"), C.categorize_simple("vendor"))
                         .otherwise(F.col("category")))
    valid, quarantine = validate_schema(x.withColumn("description", F.col("memo")))
    reports["quarantine"] = quarantine
    return valid, reports


def clean_ledger(df: DataFrame, row_id: str = "row_id", checkpoint: bool = True
                 ) -> tuple[DataFrame, dict[str, DataFrame]]:
    """X11: kind of data (H22) and column mapping (H9-H18) where canonical columns are missing, then dates,
    amounts, de-dup chain (J8), categories (C10), memos (P19), then risk (R16) and insights (K13)
    over the cleaned, checkpointed table. Reports ``detection`` and ``mapping`` tell what was found."""
    from ..operators import insights as K
    from ..operators import risk as R
    found = {"detection": H.detect_accounting({"input": df})}
    if not {"date", "amount", "vendor", "category", "memo"} <= set(df.columns):
        mapping = H.map_columns_enhanced({"input": df.drop(row_id)})
        taken = set(df.columns)
        for r in mapping.orderBy("position").collect():         # a handful of fields
            if r.field not in taken:
                df = df.withColumnRenamed(r.column, r.field)
                taken = taken - {r.column} | {r.field}
        df = H.ensure_columns(df)
        found["mapping"] = mapping
    x = standardize_dates(df, {"date": "date"}).withColumn("amount", clean_amount(F.col("amount"), "robust"))
    x, rep = D.advanced_dedup(x, row_id, checkpoint=checkpoint)
    x = C.categorize_enhanced(x)
    x = x.withColumn("memo", fill_memo())
    if checkpoint:
        from ..session import written
        x = written(x)
    reports = {**rep, **found}
    reports.update({f"risk_{k}": v for k, v in R.assess_risk(x).items()})
    reports.update({f"insights_{k}": v for k, v in K.business_insights(x).items()})
    return x, reports


def clean_any(df: DataFrame, source: str = "input") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Classify the table from its header (H21) and dispatch to the per-kind cleaner."""
    hdr = H.header_table(df.sparkSession, {source: df})
    kind_row = H.classify_table(hdr).collect()          # one row per file
    kind, conf = (kind_row[0].kind, kind_row[0].confidence) if kind_row else ("generic", 0.0)
    if conf == 0:
        kind = "generic"
    cleaners = {"customers": clean_customers, "vendors": clean_vendors, "inventory": clean_inventory,
                "accounts": clean_accounts, "generic": clean_generic}
    if kind == "transactions":
        out, rep = clean_transactions(df)
    else:
        out, rep = cleaners[kind](df), {}
    info = df.sparkSession.createDataFrame([(kind, float(conf))], "kind string, confidence double")
    rep["classification"] = info
    return out, rep


# ---- X9, X10 ----------------------------------------------------------------------------------
def standard_registry() -> RuleRegistry:
    """The standard rule set: standardize columns, convert types, remove duplicates,
    vendor aliases."""
    reg = RuleRegistry()
    reg.register("standardize_columns", lambda d: H.standardize_columns(d)[0], desc="canonical headers")
    reg.register("convert_data_types", FL.convert_data_types, desc="types by header")
    reg.register("remove_duplicates", lambda d: d.dropDuplicates(), desc="exact duplicates")
    reg.register("vendor_alias", lambda d: FL.replace_values(d, "vendor", FV.VENDOR_ALIASES)[0],
                 desc="vendor alias normalisation")
    return reg


HISTORY = "run string, step string, rows_before long, rows_after long, batches long, failed_batches long, wrong_lengths long, " \
          "fallback_rows long"


def hybrid_pipeline(df: DataFrame, model_fn=None, run: str = "run", history: DataFrame | None = None
                    ) -> tuple[DataFrame, dict]:
    """Standard rules, optional model scoring of categories (X4, with the rule category as fallback), the
    before/after diff (J18) and the history: a row a step with its row counts and, for the model step, the
    counts of its batches, appended to ``history`` of earlier runs.

    The cleaned table is checkpointed, so rules and hook run once, whatever reads the result."""
    from ..session import cut_lineage
    reg = standard_registry()
    out, prov = reg.apply_chain(df, reg.names())
    out = cut_lineage(out)
    before, after = df.count(), out.count()
    rows = [(run, "standard_cleaning", before, after, None, None, None, None)]
    if model_fn is not None:
        out, counts = E.score_in_batches(out, model_fn, "model_category", C.categorize_basic("vendor"), allowed=FV.CATEGORIES)
        scored = cut_lineage(out)
        seen = counts.get if after else {}
        rows.append((run, "model_scoring", after, scored.count(), *[seen.get(k, 0) for k in (
            "batches", "failed_batches", "wrong_lengths", "fallback_rows")]))
        out = scored
    new = df.sparkSession.createDataFrame(rows, HISTORY)
    return out, {"provenance": prov, "diff": E.quality_diff(df, out),
                 "history": new if history is None else history.unionByName(new)}


def hybrid_full(df: DataFrame, row_id: str = "row_id") -> tuple[DataFrame, dict]:
    """Bulk clean (P26) -> patterns of the whole cleaned table -> vendor risk attached.

    The table itself is the one sample of M8, so no pattern rests on a capped sample."""
    from ..operators import insights as K
    from ..operators import sampling as M
    cleaned = bulk_clean(df, row_id)
    scaled = M.scale_patterns(K.spending_patterns(cleaned).withColumn("sample_name", F.lit("all")), samples=1)
    rel = K.vendor_relationships(cleaned)
    out = E.attach_vendor_risk(cleaned, rel.select(F.col("vendor_name").alias("vendor"), "risk_level"))
    return out, {"scaled_patterns": scaled, "vendor_relationships": rel}
