"""Table classification and header mapping.

Input of the header operators is a header table ``(source_file, position, column)``
with one row per column per file, so mapping thousands of files is one Spark job;
alias, keyword and pattern lists are small broadcast tables. Content tests (H10-H15)
are predicates on one profiling aggregation (H0), not one scan per test. Only the
final mapping (a handful of rows per file) is ever collected, to build a ``select``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from ..functions import fixed_values as FV
from ..functions.similarity import sequence_ratio
from ..session import cut_lineage


# ---- header table helpers -------------------------------------------------------------------
def header_table(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """Header table of several DataFrames: (source_file, position, column)."""
    rows = [(name, i, c) for name, df in frames.items() for i, c in enumerate(df.columns)]
    return spark.createDataFrame(rows, "source_file string, position int, column string")


def _expand(h: DataFrame, table: dict[str, list[str]], value: str = "pattern") -> DataFrame:
    """Each header row paired with every rule of a small fixed table, as a generator
    (explode of a literal array): bounded fan-out, no join."""
    rules = F.array(*[F.struct(F.lit(fi).alias("field_order"), F.lit(field).alias("field"),
                               F.lit(pi).alias("pattern_order"), F.lit(p).alias(value))
                      for fi, (field, pats) in enumerate(table.items()) for pi, p in enumerate(pats)])
    return h.withColumn("_rule", F.explode(rules)).select("*", "_rule.*").drop("_rule")


def normalise_header(col) -> Column:
    """H1: strip, lower-case, drop non-word characters."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(F.trim(c)), r"\W+", "")


def alias_table(spark: SparkSession) -> DataFrame:
    """Normalised alias -> canonical field (later lists win on duplicates; each canonical
    name maps to itself)."""
    import re
    norm = {}
    for canon, aliases in FV.HEADER_ALIASES.items():
        for a in aliases:
            norm[re.sub(r"\W+", "", a.strip().lower())] = canon
        norm[canon] = canon
    return F.broadcast(spark.createDataFrame(sorted(norm.items()), "alias string, field string"))


def canonicalise_headers(headers: DataFrame) -> DataFrame:
    """H2: header table + canonical field (NULL when no alias matches)."""
    al = alias_table(headers.sparkSession)
    return headers.withColumn("_norm", normalise_header("column")).join(al, F.col("_norm") == F.col("alias"), "left") \
        .drop("_norm", "alias")


# ---- H3, H4, H19, H20 -------------------------------------------------------------------------
def standardize_columns(df: DataFrame, source: str = "input", keep: tuple[str, ...] = ()
                        ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """H3: rename by alias, drop unknown columns, memo fallback (memo-like columns joined
    with '; '), missing canonical columns = 'UNRESOLVED', canonical order.

    Returns (clean frame, provenance (rule, old, new, note, method), dropped columns)."""
    spark = df.sparkSession
    kept = [c for c in keep if c in df.columns]
    body = df.drop(*kept) if kept else df
    mapped = canonicalise_headers(header_table(spark, {source: body})).orderBy("position").collect()  # per column
    col_map, meta, dropped = {}, [], []
    for r in mapped:
        if r.column in FV.STANDARD_COLUMNS:
            canon = r.column
        else:
            canon = r.field
        if canon:
            col_map[r.column] = canon
            meta.append(("standardize_columns", r.column, canon, None, "alias_map"))
        else:
            dropped.append((r.column,))
            meta.append(("standardize_columns", r.column, None, "dropped", "unmapped"))
    chosen = {}
    for raw, canon in col_map.items():
        chosen.setdefault(canon, raw)
    cols = {canon: F.col(f"`{raw}`") for canon, raw in chosen.items()}
    if "memo" not in cols:
        import re
        memo_aliases = set(FV.HEADER_ALIASES["memo"])
        like = [c for c in body.columns if re.sub(r"\W+", "", c.strip().lower()) in memo_aliases and c not in col_map]
        if like:
            cols["memo"] = F.concat_ws("; ", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")) for c in like])
            meta.append(("standardize_columns", ", ".join(like), "memo", "fallback_concat", "memo_fallback"))
    for canon in FV.STANDARD_COLUMNS:
        if canon not in cols:
            cols[canon] = F.lit(FV.UNRESOLVED)
            meta.append(("standardize_columns", None, canon, "added_missing", "missing_canonical"))
    clean = df.select(*kept, *[cols[c].alias(c) for c in FV.STANDARD_COLUMNS])
    prov = spark.createDataFrame(meta, "rule string, old string, new string, note string, method string")
    drops = spark.createDataFrame(dropped, "name string")
    return clean, prov, drops


def snake_case_columns(df: DataFrame, style: str | None = "snake") -> DataFrame:
    """H4: column names in lower / upper / snake case."""
    import re
    if style is None:
        return df

    def conv(c: str) -> str:
        if style == "lower":
            return c.lower()
        if style == "upper":
            return c.upper()
        s = re.sub(r"([A-Z]+)", r"_\1", c)
        s = re.sub(r"[^0-9a-zA-Z]+", "_", s).lower()
        return re.sub(r"_+", "_", s).strip("_")
    return df.toDF(*[conv(c) for c in df.columns])


def preserve_columns(headers: DataFrame) -> DataFrame:
    """Header rows to keep next to the canonical ones (ids, refs, currency, ...)."""
    return headers.filter(F.col("column").rlike(FV.PRESERVE_PATTERN))


def ensure_columns(df: DataFrame) -> DataFrame:
    """Add missing canonical columns with defaults (date NULL, amount 0.0, vendor '',
    category 'Other', memo '')."""
    defaults = {"date": F.lit(None).cast("date"), "amount": F.lit(0.0), "vendor": F.lit(""),
                "category": F.lit("Other"), "memo": F.lit("")}
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


# ---- header scoring: H5-H9, H16, H23 -------------------------------------------------------------
def map_fallback(headers: DataFrame) -> DataFrame:
    """H5: per column the first field (field order) with a keyword contained in the header;
    each field is kept for its first column only. -> (source_file, column, field)."""
    h = headers.withColumn("_low", F.lower("column"))
    hits = _expand(h, FV.FALLBACK_KEYWORDS, "kw").filter(F.col("_low").contains(F.col("kw")))
    per_col = hits.groupBy("source_file", "position", "column").agg(F.min_by("field", "field_order").alias("field"))
    w = Window.partitionBy("source_file", "field").orderBy("position")
    return per_col.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("source_file", "column", "field")


def map_keyword_count(headers: DataFrame, data_type: str = "transactions") -> DataFrame:
    """H6: per column the field with the most keyword hits (first field on ties)."""
    h = headers.withColumn("_low", F.lower(F.trim("column")))
    counts = _expand(h, FV.KEYWORD_COUNT_FIELDS[data_type], "kw").filter(F.col("_low").contains(F.col("kw"))).groupBy("source_file", "position", "column", "field",
                                                                     "field_order").agg(F.count("*").alias("hits"))
    return counts.groupBy("source_file", "position", "column").agg(
        F.min_by("field", F.struct(-F.col("hits"), F.col("field_order"))).alias("field"))\
        .select("source_file", "column", "field")


def map_rule_scored(headers: DataFrame, data_type: str = "transactions") -> DataFrame:
    """H7: per field, the best column: score len(pattern), +10 exact, +5 prefix (earliest
    column / pattern on ties); a column chosen by several fields keeps the last field."""
    h = headers.withColumn("_low", F.lower("column"))
    sc = _expand(h, FV.RULE_PATTERNS[data_type]).filter(F.col("_low").contains(F.col("pattern"))).withColumn(
        "score", F.length("pattern") + F.when(F.col("pattern") == F.col("_low"), 10)
        .when(F.col("_low").startswith(F.col("pattern")), 5).otherwise(0))
    best = sc.groupBy("source_file", "field", "field_order").agg(
        F.min_by(F.struct("position", "column"), F.struct(-F.col("score"), F.col("position"), F.col("pattern_order")))
        .alias("_b"))
    per_col = best.groupBy("source_file", "_b.position", "_b.column").agg(
        F.max_by("field", "field_order").alias("field"))
    return per_col.select("source_file", "column", "field")


def map_regex_fuzzy(headers: DataFrame) -> DataFrame:
    """H8: per column: regex hit scores len(pattern), else sequence ratio > 0.8 scores
    int(10 * ratio); best field per column, each field for its first column only."""
    h = headers.withColumn("_low", F.lower("column"))
    j = _expand(h, FV.REGEX_FIELD_PATTERNS)
    ratio = sequence_ratio(F.col("pattern"), F.col("_low"))
    score = F.greatest(F.when(F.call_function("rlike", F.col("_low"), F.col("pattern")), F.length("pattern")).otherwise(0),
                       F.when(ratio > 0.8, F.floor(ratio * 10).cast("int")).otherwise(0))
    sc = j.withColumn("score", score).filter("score > 0")
    per_col = sc.groupBy("source_file", "position", "column").agg(
        F.min_by("field", F.struct(-F.col("score"), F.col("field_order"), F.col("pattern_order"))).alias("field"))
    w = Window.partitionBy("source_file", "field").orderBy("position")
    return per_col.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("source_file", "column", "field")


def map_pattern_coverage(headers: DataFrame) -> DataFrame:
    """H9: regex hits scored by coverage len(pattern) / len(header); best field per column
    when coverage > 0.3 (first field / pattern on ties)."""
    h = headers.withColumn("_low", F.lower("column"))
    sc = _expand(h, FV.MAPPER_PATTERNS).filter(F.call_function("rlike", F.col("_low"), F.col("pattern"))).withColumn(
        "score", F.length("pattern") / F.length("_low"))
    best = sc.groupBy("source_file", "position", "column").agg(
        F.min_by(F.struct("field", "score"), F.struct(-F.col("score"), F.col("field_order"), F.col("pattern_order")))
        .alias("_b"))
    return best.filter(F.col("_b.score") > 0.3).select("source_file", "column", F.col("_b.field").alias("field"),
                                                       F.col("_b.score").alias("score"))


def map_semantic(headers: DataFrame) -> DataFrame:
    """Sequence ratio > 0.6 against standard names; an exact name wins."""
    h = headers.withColumn("_low", F.lower("column"))
    sim = F.when(F.col("_low") == F.col("name"), F.lit(2.0)).otherwise(sequence_ratio(F.col("_low"), F.col("name")))
    sc = _expand(h, FV.STANDARD_FIELD_NAMES, "name").withColumn("sim", sim).filter("sim > 0.6")
    best = sc.groupBy("source_file", "position", "column").agg(
        F.min_by(F.struct("field", "sim"), F.struct(-F.col("sim"), F.col("field_order"), F.col("pattern_order")))
        .alias("_b"))
    return best.select("source_file", "column", F.col("_b.field").alias("field"),
                       F.least(F.col("_b.sim"), F.lit(1.0)).alias("score"))


def suggest_mappings(headers: DataFrame) -> DataFrame:
    """Per file and canonical column, headers containing or contained in an alias."""
    h = headers.withColumn("_low", F.lower("column"))
    j = _expand(h, FV.SUGGEST_ALIASES, "alias").filter(
        F.col("_low").contains(F.col("alias")) | F.col("alias").contains(F.col("_low")))
    return j.groupBy("source_file", "field").agg(F.array_sort(F.collect_set("column")).alias("suggestions"))


# ---- H0 profile and content predicates H10-H15 -------------------------------------------------
#: A value that may be a date: digits with a date's separators, or a month name. Plain numbers are not dates.
_DATE_SHAPE = r"(?i)^\s*(\d{1,4}[-/. ]\s*\d{1,2}[-/. ]|\d{1,2}[- ]?[a-z]{3}|[a-z]{3,9}\.? \d)"


def profile_columns(df: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """H0: one pass over the table; one output row per column with counts, rates and moments of the text, of
    its numeric reading (``$`` and ``,`` taken out) and of its plain numbers (``plain_``).

    The table is unpivoted to (position, column, value). With ``exact_distinct`` equal values of a column are
    counted first, in the map tasks and then by a shuffle, and all tests run once a distinct value; without, they run
    on every cell and distinct values are estimated, which needs no shuffle of values. Where a rule tests a list of
    symbols or patterns each on its own, the rate is the largest of the single rates."""
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                               F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(df.columns)])
    long = df.select(F.explode(pairs).alias("p")).select("p.*")
    if exact_distinct:
        long, distinct = long.groupBy("position", "column", "v").agg(F.count(F.lit(1)).alias("n")), F.count("v")
    else:
        long, distinct = long.withColumn("n", F.lit(1).cast("long")), F.approx_count_distinct("v")
    from ..functions.amounts import to_double
    from ..functions.dates import standardize_date
    s, n, low = F.col("v"), F.col("n"), F.lower("v")
    plain, num = to_double(s), to_double(F.regexp_replace(s, r"[$,]", ""))
    known = F.coalesce(F.sum(F.when(s.isNotNull(), n)), F.lit(0))
    rows = F.sum("n")

    def rate(cond: Column) -> Column:
        return F.when(known > 0, F.coalesce(F.sum(F.when(cond, n)), F.lit(0)) / known).otherwise(F.lit(0.0))

    def most(conds: list[Column]) -> Column:
        return F.greatest(*[rate(c) for c in conds])

    def mean(x: Column) -> Column:
        return F.sum(x * n) / F.sum(F.when(x.isNotNull(), n))

    def std(x: Column, centre: str) -> Column:
        m = F.sum(F.when(x.isNotNull(), n))
        off = x - F.col(centre)
        return F.when(m > 1, F.sqrt(F.sum(off * off * n) / (m - 1)))

    # values are centred before they are squared: one row a column is broadcast, the counted values are shuffled once
    centres = long.groupBy(F.col("position").alias("_p")).agg(mean(num).alias("_num"), mean(plain).alias("_plain"))
    long = long.join(F.broadcast(centres), F.col("position") == F.col("_p"))

    words = lambda t: F.size(F.split(t, r"\s+")).cast("double")
    is_date = F.when(plain.isNull() & s.rlike(_DATE_SHAPE), standardize_date(s).isNotNull()).otherwise(F.lit(False))
    months = list(dict.fromkeys(FV.CONTENT_MONTH_NAMES))
    return long.groupBy("position", "column").agg(
        rows.alias("rows"), known.alias("non_null"), (rows - known).alias("null_count"),
        F.when(rows > 0, (rows - known) / rows).otherwise(F.lit(0.0)).alias("null_pct"), distinct.alias("distinct"),
        rate(plain.isNotNull()).alias("numeric_rate"),
        most([s.rlike(p) for p in FV.NUMBER_PATTERNS]).alias("number_pattern_rate"),
        most([s.contains(x) for x in FV.CURRENCY_SYMBOLS]).alias("currency_rate"),
        most([low.rlike(p) for p in FV.CONTENT_DATE_REGEXES]).alias("date_pattern_rate"),
        most([low.contains(m) for m in months]).alias("month_name_rate"), rate(is_date).alias("date_parse_rate"),
        mean(F.length(s).cast("double")).alias("avg_len"), mean(words(F.trim(s))).alias("avg_words"),
        mean(words(s)).alias("avg_word_gaps"),
        F.min(F.abs(num)).alias("min_abs"), F.max(F.abs(num)).alias("max_abs"), mean(num).alias("mean"), std(num, "_num").alias("std"),
        F.min(F.abs(plain)).alias("plain_min_abs"), F.max(F.abs(plain)).alias("plain_max_abs"),
        mean(plain).alias("plain_mean"), std(plain, "_plain").alias("plain_std"),
        most([low.contains(x) for x in FV.BUSINESS_INDICATORS]).alias("business_rate"),
        most([low.contains(x) for x in FV.COMMON_VENDORS]).alias("known_vendor_rate"))


def is_date_column() -> Column:
    """H11 on a profile row: all values parse as dates; or one date regex on > 30 % or one month name on > 10 % of
    the values. A column of plain numbers is no date, though a parser may read them as epochs."""
    return ((F.col("non_null") > 0) & (F.col("date_parse_rate") == 1.0)) | (F.col("date_pattern_rate") > 0.3) \
        | (F.col("month_name_rate") > 0.1)


def is_amount_column() -> Column:
    """Numeric > 80 % with 0.01 < |x| < 1e6; or one currency symbol on > 30 %; or one number
    pattern on > 50 %."""
    return (((F.col("numeric_rate") > 0.8) & (F.col("plain_max_abs") < 1e6) & (F.col("plain_min_abs") > 0.01))
            | (F.col("currency_rate") > 0.3) | (F.col("number_pattern_rate") > 0.5))


def is_vendor_column() -> Column:
    """One business suffix on > 10 %, one known vendor on > 5 %, or more than 1.5 words (gaps and one) on average."""
    return (F.col("business_rate") > 0.1) | (F.col("known_vendor_rate") > 0.05) | (F.col("avg_word_gaps") > 1.5)


def is_memo_column() -> Column:
    """Average length > 20 or less than 30 % numeric."""
    return (F.col("avg_len") > 20) | (F.col("numeric_rate") < 0.3)


def _text_only(text_columns: list[str] | None) -> Column:
    return F.col("column").isin(*text_columns) if text_columns is not None else F.lit(True)


def map_by_content(profile: DataFrame, text_columns: list[str] | None = None) -> DataFrame:
    """First content test that holds, in the order date, amount, vendor, memo.
    Vendor and memo tests only apply to text columns (``text_columns``); columns without a value have no field."""
    txt = _text_only(text_columns)
    field = F.when(F.col("non_null") > 0, F.when(is_date_column(), "date").when(is_amount_column(), "amount")
                   .when(txt & is_vendor_column(), "vendor").when(txt & is_memo_column(), "memo"))
    return profile.select("column", field.alias("field")).filter(F.col("field").isNotNull())


def map_by_statistics(profile: DataFrame, text_columns: list[str] | None = None) -> DataFrame:
    """Date if unique ratio > .8, null ratio < .1 and all values parse; amount if more than 80 % of the
    rows are numbers, std > 0, mean > 0 and std < 10 * mean; vendor if a text column's unique ratio is in (.3, .9)."""
    uniq = F.col("distinct") / F.greatest(F.col("non_null"), F.lit(1))
    field = (F.when((uniq > 0.8) & (F.col("null_pct") < 0.1) & (F.col("date_parse_rate") == 1.0), "date")
             .when((F.col("numeric_rate") * F.col("non_null") > 0.8 * F.col("rows")) & (F.col("plain_std") > 0)
                   & (F.col("plain_mean") > 0) & (F.col("plain_std") < 10 * F.col("plain_mean")), "amount")
             .when(_text_only(text_columns) & (uniq > 0.3) & (uniq < 0.9), "vendor"))
    return profile.select("column", field.alias("field")).filter(F.col("field").isNotNull())


# ---- H17, H18, H21, H22, H24, V7 -------------------------------------------------------------------
#: The mapping methods in the order in which their votes are taken.
MAPPING_METHODS = ("pattern", "content", "statistics", "semantic")


def mapping_votes(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Votes (source_file, position, column, field, method) of H9, H10, H15 and H16 on the columns of real
    tables, and the tables' profiles with (source_file, is_text)."""
    spark = next(iter(tables.values())).sparkSession
    hd = header_table(spark, tables)
    profiles, votes = [], [map_pattern_coverage(hd).select("source_file", "column", "field").withColumn("method", F.lit("pattern")),
                           map_semantic(hd).select("source_file", "column", "field").withColumn("method", F.lit("semantic"))]
    for name, df in tables.items():
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
        p = cut_lineage(profile_columns(df))        # one row a column, read by both methods and by H18
        profiles.append(p.withColumn("source_file", F.lit(name)).withColumn("is_text", _text_only(text)))
        for method, fields in (("content", map_by_content(p, text)), ("statistics", map_by_statistics(p, text))):
            votes.append(fields.select(F.lit(name).alias("source_file"), "column", "field").withColumn("method", F.lit(method)))
    return reduce(DataFrame.unionByName, votes).join(hd, ["source_file", "column"]), reduce(DataFrame.unionByName, profiles)


def combine_mappings(votes: DataFrame, keep: float = 0.4) -> DataFrame:
    """Per column the field with most votes, ties to the one voted first in the order of
    ``MAPPING_METHODS``. Confidence = its votes / all votes for the column, plus a bonus where the header tells:
    reference and number: +0.5 for reference, else -0.3; memo, notes or comment: +0.3 for memo, else -0.2;
    description: +0.2 for memo, else -0.1. Kept from 0.4."""
    order = F.array_position(F.array(*map(F.lit, MAPPING_METHODS)), F.col("method"))
    per = votes.groupBy("source_file", "position", "column", "field").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = per.groupBy("source_file", "position", "column").agg(
        F.sum("n").alias("cast"), F.min("first").alias("method_order"),
        F.min_by(F.struct("field", "n"), F.struct(-F.col("n"), F.col("first"))).alias("b"))
    low, field = F.lower("column"), F.col("b.field")
    told = lambda f, yes, no: F.when(field == f, yes).otherwise(no)
    bonus = (F.when(low.contains("reference") & low.contains("number"), told("reference", 0.5, -0.3))
             .when(low.contains("memo") | low.contains("notes") | low.contains("comment"), told("memo", 0.3, -0.2))
             .when(low.contains("description"), told("memo", 0.2, -0.1)).otherwise(0.0))
    return (best.select("source_file", "position", "column", field.alias("field"), "method_order",
                        (F.col("b.n") / F.col("cast") + bonus).alias("confidence")).filter(F.col("confidence") >= keep - 1e-12))


def field_score(profile: DataFrame) -> DataFrame:
    """H18's score of each (source_file, column) of a profile for each field: content (date: all values parse, 1.0;
    amount: more than 80 % of the rows are numbers, 1.0; vendor: text with a business word on > 10 %, 0.5) plus
    0.3 if a header pattern of the field matches."""
    content = {"date": F.when((F.col("non_null") > 0) & (F.col("date_parse_rate") == 1.0), 1.0),
               "amount": F.when(F.col("numeric_rate") * F.col("non_null") > 0.8 * F.col("rows"), 1.0),
               "vendor": F.when(F.col("is_text") & (F.col("business_rate") > 0.1), 0.5)}
    low = F.lower("column")
    scores = [F.struct(F.lit(f).alias("field"), (F.coalesce(content.get(f, F.lit(None).cast("double")), F.lit(0.0)) + F.when(
        reduce(lambda a, b: a | b, [low.rlike(p) for p in pats]), 0.3).otherwise(0.0)).alias("score")) for f, pats in FV.MAPPER_PATTERNS.items()]
    return profile.select("source_file", "column", F.explode(F.array(*scores)).alias("s")).select("source_file", "column", "s.*")


def resolve_mapping(mapping: DataFrame, scores: DataFrame) -> DataFrame:
    """One column a field of ``mapping(source_file, position, column, field, method_order)``. Where several
    columns have a field, the one with the highest score above 0 stays, the first of equal ones in the
    order in which they were mapped; if none scores, the field is left open. A field of one column keeps it."""
    known = mapping.join(scores, ["source_file", "column", "field"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by = ["source_file", "field"]
    several = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "method_order", "position"))
    return (known.withColumn("_n", several).withColumn("_r", rank).filter("_r = 1 and (_n = 1 or score > 0)")
            .select("source_file", "position", "column", "field", "score"))


def map_columns_enhanced(tables: dict[str, DataFrame]) -> DataFrame:
    """The whole mapper: votes of four methods (H9, H10, H15, H16), combined (H17) and resolved."""
    votes, profiles = mapping_votes(tables)
    return resolve_mapping(combine_mappings(votes), field_score(profiles))


def classify_table(headers: DataFrame) -> DataFrame:
    """Per file, the kind whose required patterns are most often present in some
    header (share of patterns hit; first kind in list order wins ties)."""
    hits = (_expand(headers.withColumn("_low", F.lower("column")), FV.TABLE_KINDS)
            .filter(F.call_function("rlike", F.col("_low"), F.col("pattern")))
            .select("source_file", F.col("field").alias("kind"), "pattern_order").distinct()
            .groupBy("source_file", "kind").agg(F.count("*").alias("_hit")))
    kinds = F.array(*[F.struct(F.lit(ki).alias("kind_order"), F.lit(k).alias("kind"), F.lit(len(p)).alias("_np"))
                      for ki, (k, p) in enumerate(FV.TABLE_KINDS.items())])
    grid = headers.select("source_file").distinct().withColumn("_k", F.explode(kinds)).select("source_file", "_k.*")
    sc = grid.join(hits, ["source_file", "kind"], "left").withColumn(
        "score", F.coalesce(F.col("_hit"), F.lit(0)) / F.col("_np"))
    best = sc.groupBy("source_file").agg(
        F.min_by(F.struct("kind", "score"), F.struct(-F.col("score"), F.col("kind_order"))).alias("_b"))
    return best.select("source_file", F.col("_b.kind").alias("kind"), F.col("_b.score").alias("confidence"))


def detect_accounting(tables: dict[str, DataFrame], order: dict[str, list[str]] | None = None) -> DataFrame:
    """Per table, accounting data (chart of accounts, trial balance) or transactions.

    Each header term counts its weight once. A column named ``date``: at most 5 different dates on more than 10 rows
    speak for accounting (+2), different dates on more than half of the rows for transactions (+2); without such a
    column accounting gets +3. At least 3 account names among the first 10 values (by ``order[table]``) of
    the first text column: accounting +2. Confidence min(0.95, 0.5 + 0.05 * score of the winner); a tie is
    transactions. One row a table; a table is read by one aggregate and one top-10."""
    from ..functions.dates import coerce_date
    spark, facts = next(iter(tables.values())).sparkSession, []
    names = reduce(lambda a, b: a | b, [F.lower(F.coalesce("v", F.lit("nan"))).contains(x) for x in FV.ACCOUNT_NAME_TERMS])
    for name, df in tables.items():
        dates = [f for f in df.schema.fields if "date" in f.name.lower()]
        text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
        named = any(c.lower().strip() == "date" for c in df.columns)
        day = F.lit(None).cast("date")
        if named:
            day = coerce_date(F.col(f"`{dates[0].name}`")) if isinstance(dates[0].dataType, StringType) else F.col(f"`{dates[0].name}`")
        fact = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(day).alias("days"))
        like = F.lit(0).cast("long")
        if text:
            first = df.orderBy(*[F.col(f"`{c}`") for c in (order or {}).get(name, [])]) if (order or {}).get(name) else df
            like = first.select(F.col(f"`{text[0]}`").alias("v")).limit(10).agg(F.count_if(names)).scalar()
        facts.append(fact.select(F.lit(name).alias("source_file"), F.lit(named).alias("named"), "rows", "days", like.alias("alike")))
    low = F.trim(F.lower("column"))
    weigh = lambda terms: reduce(lambda a, b: a + b, [F.max(F.when(low.contains(t), w).otherwise(0)) for t, w in terms.items()])
    heads = header_table(spark, tables).groupBy("source_file").agg(
        weigh(FV.ACCOUNTING_TERMS).alias("a"), weigh(FV.TRANSACTION_TERMS).alias("t"))
    x = reduce(DataFrame.unionByName, facts).join(heads, "source_file")
    few = F.col("named") & (F.col("days") <= 5) & (F.col("rows") > 10)
    many = F.col("named") & ~few & (F.col("days") > 0.5 * F.col("rows"))
    a = F.col("a") + F.when(few, 2).when(~F.col("named"), 3).otherwise(0) + F.when(F.col("alike") >= 3, 2).otherwise(0)
    x = x.select("source_file", a.alias("accounting_score"), (F.col("t") + F.when(many, 2).otherwise(0)).alias("transactions_score"))
    won = F.greatest("accounting_score", "transactions_score")
    kind = F.when(F.col("accounting_score") > F.col("transactions_score"), "accounting").otherwise("transactions")
    conf = F.least(F.lit(0.95), 0.5 + won * 0.05)
    return x.select("source_file", kind.alias("detected_type"), conf.alias("confidence"), "accounting_score", "transactions_score",
                    F.when(conf > 0.7, F.concat(F.lit("Process as "), kind, F.lit(" data"))).otherwise("Manual review recommended").alias("recommendation"))


def mapping_strategy(headers: DataFrame, data_type: str = "transactions") -> DataFrame:
    """H7, then H8 for fields still open, then H5; one column per field."""
    h7 = map_rule_scored(headers, data_type).withColumn("method", F.lit("rule_scored")).withColumn("prio", F.lit(1))
    h8 = map_regex_fuzzy(headers).withColumn("method", F.lit("regex_fuzzy")).withColumn("prio", F.lit(2))
    h5 = map_fallback(headers).withColumn("method", F.lit("fallback")).withColumn("prio", F.lit(3))
    allm = h7.unionByName(h8).unionByName(h5).join(headers, ["source_file", "column"])
    w = Window.partitionBy("source_file", "field").orderBy("prio", "position")
    first = allm.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    wc = Window.partitionBy("source_file", "column").orderBy("prio", "field")
    return (first.withColumn("_rc", F.row_number().over(wc)).filter("_rc = 1")
            .select("source_file", "position", "column", "field", "method"))


def mapping_checks(headers: DataFrame, mapping: DataFrame,
                   important: tuple[str, ...] = ("date", "amount", "vendor")) -> DataFrame:
    """V7: important headers left unmapped, and fields targeted by several columns."""
    low = F.lower("column")
    imp = reduce(lambda a, b: a | b, [low.contains(x) for x in important])
    unmapped = headers.filter(imp).join(mapping.select("source_file", "column"), ["source_file", "column"],
                                        "left_anti").select("source_file", F.col("column").alias("item"),
                                                            F.lit("important header unmapped").alias("issue"))
    dup = mapping.groupBy("source_file", "field").agg(F.count("*").alias("n")).filter("n > 1") \
        .select("source_file", F.col("field").alias("item"), F.lit("duplicate target").alias("issue"))
    return unmapped.unionByName(dup)
