"""Date parsing as pure Column expressions (P1-P4). No UDFs: every row stays in codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .fixed_values import DATE_FORMATS, EXCEL_EPOCH, EXCEL_SERIAL_RANGE, MONTH_TOKENS

_PY_TO_SPARK = [("%Y", "yyyy"), ("%m", "M"), ("%d", "d"), ("%y", "yy"), ("%H", "H"), ("%M", "m"), ("%S", "s"),
                ("%B", "MMMM"), ("%b", "MMM")]
# strptime forms with a literal T (and optional fraction / Z) are parsed after rewriting
# them to "date time"; they are adjacent in the list and mutually exclusive in shape.
_T_FORMATS = {f for f in DATE_FORMATS if "T" in f}
_ISO_T = r"(?i)^(\d{4}-\d{1,2}-\d{1,2})t(\d{1,2}:\d{1,2}:\d{1,2})(\.\d{1,6})?z?$"


def _is_american(fmt: str) -> bool:
    return any(s in fmt for s in ("%m/%d", "%m-%d", "%m.%d"))


def _is_european(fmt: str) -> bool:
    return any(s in fmt for s in ("%d/%m", "%d-%m", "%d.%m"))


def ordered_formats(prefer_american: bool = True) -> list[str]:
    """Trial order: preferred family first, the rest in list order."""
    first = [f for f in DATE_FORMATS if (_is_american(f) if prefer_american else _is_european(f))]
    return first + [f for f in DATE_FORMATS if f not in first]


def spark_pattern(fmt: str) -> str:
    """Translate a strptime format to a Spark datetime pattern (no-separator digit runs
    become fixed-width fields, which is how such strings are written)."""
    fixed = "%" in fmt and not any(c in fmt for c in "/-. ,:")
    out = fmt
    for py, sp in _PY_TO_SPARK:
        if fixed and py in ("%m", "%d"):
            sp = sp * 2
        out = out.replace(py, sp)
    return out


_SHAPE = {"%Y": r"\d{4}", "%m": r"\d{1,2}", "%d": r"\d{1,2}", "%y": r"\d{2}", "%H": r"\d{1,2}", "%M": r"\d{1,2}",
          "%S": r"\d{1,2}", "%B": "[A-Za-z]+", "%b": "[A-Za-z]+"}


def shape_regex(fmt: str) -> str:
    """A cheap regex every string parsed by ``fmt`` must match (used as a guard so a
    row only attempts the formats its shape allows)."""
    import re
    fixed = "%" in fmt and not any(c in fmt for c in "/-. ,:")
    out, i = "^", 0
    while i < len(fmt):
        tok = fmt[i:i + 2]
        if tok in _SHAPE:
            out += r"\d{2}" if fixed and tok in ("%m", "%d") else _SHAPE[tok]
            i += 2
        else:
            out += re.escape(fmt[i])
            i += 1
    return out + "$"


def format_signature(fmt: str) -> str:
    """Shape of strings a format can parse with digit runs written '9' and letter runs
    'A' ('%m/%d/%Y' -> '9/9/9', '%B %d, %Y' -> 'A 9, 9')."""
    import re
    x = re.sub(r"%[YmdyHMS]", "9", fmt)
    x = re.sub(r"%[Bb]", "A", x)
    x = re.sub(r"9+", "9", x)
    return x


def signature(s: Column) -> Column:
    """Shape of a string: digit runs -> '9', letter runs -> 'A'."""
    return F.regexp_replace(F.regexp_replace(s, r"[0-9]+", "9"), r"[A-Za-z]+", "A")


def _parse_one(s: Column, fmt: str, sig: Column | None = None) -> Column:
    if fmt in _T_FORMATS:
        return F.expr("NULL").cast("date")  # handled by the combined ISO-T branch
    guard = (sig == format_signature(fmt)) if sig is not None else s.rlike(shape_regex(fmt))
    d = F.when(guard, F.try_to_date(s, spark_pattern(fmt)))
    if "%y" in fmt:
        # strptime maps two-digit years 69-99 to 19xx; Spark's 'yy' maps all to 20xx.
        d = F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
    return d


def _iso_t(s: Column) -> Column:
    rewritten = F.regexp_replace(s, _ISO_T, "$1 $2")
    return F.when(s.rlike(_ISO_T), F.try_to_date(rewritten, "yyyy-M-d H:m:s"))


def preprocess(s: Column) -> Column:
    """Separator normalisation; strings holding a month name are only trimmed."""
    low = F.lower(F.trim(s))
    has_month = low.rlike("|".join(MONTH_TOKENS))
    x = F.regexp_replace(low, r"\s+", " ")
    x = F.regexp_replace(x, r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})", "$1/$2/$3")
    x = F.regexp_replace(x, r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2})$", "$1/$2/$3")
    x = F.regexp_replace(x, r"(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})", "$1-$2-$3")
    return F.when(has_month, F.trim(s)).otherwise(F.trim(x))


def excel_serial(s: Column) -> Column:
    """Excel serial day number (1..100000) counted from 1899-12-30, else NULL."""
    from .amounts import to_double
    num = to_double(F.trim(s))
    lo, hi = EXCEL_SERIAL_RANGE
    ok = (num >= lo) & (num <= hi)
    return F.when(ok, F.date_add(F.lit(EXCEL_EPOCH).cast("date"), F.floor(num).cast("int")))


def _fallback(pre: Column, prefer_american: bool) -> Column:
    """Last resort: drop ordinal suffixes, read 'Sept' as 'Sep', retry the name formats."""
    x = F.regexp_replace(pre, r"(?i)(\d+)(st|nd|rd|th)\b", "$1")
    x = F.regexp_replace(x, r"(?i)\bsept\b", "Sep")
    x = F.regexp_replace(x, r"\s+", " ")
    name_fmts = [f for f in ordered_formats(prefer_american) if "%B" in f or "%b" in f]
    iso_ts = F.when(pre.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[ tT]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$"),
                    F.to_date(F.try_to_timestamp(F.regexp_replace(pre, "[tT]", " "))))
    return F.coalesce(*[_parse_one(x, f) for f in name_fmts], iso_ts)


def _candidates(formats: list[str]) -> Column:
    """Literal map: shape signature -> ordered candidate formats (Spark pattern, whether
    it has a two-digit year)."""
    groups: dict[str, list[str]] = {}
    for f in formats:
        if f in _T_FORMATS:
            continue
        groups.setdefault(format_signature(f), []).append(f)
    kv = []
    for sig, fmts in groups.items():
        kv += [F.lit(sig), F.array(*[F.struct(F.lit(spark_pattern(f)).alias("fmt"),
                                              F.lit("%y" in f).alias("yy")) for f in fmts])]
    return F.create_map(*kv)


def _max_candidates(formats: list[str]) -> int:
    groups: dict[str, int] = {}
    for f in formats:
        if f not in _T_FORMATS:
            groups[format_signature(f)] = groups.get(format_signature(f), 0) + 1
    return max(groups.values()) if groups else 0


def _try_candidates(p: Column, cands: Column, width: int = 0) -> Column:
    """First candidate format (in order) that parses ``p``; NULL when none does.

    Folded with ``aggregate`` over the (at most a handful of) candidates of the row's
    signature. A fully unrolled form generates a method too large for the JIT and runs
    several times slower, so the fold is kept."""
    def step(acc, f):
        d = F.call_function("try_to_date", p, f["fmt"])
        d = F.when(f["yy"] & (F.year(d) >= 2069), F.add_months(d, -1200)).otherwise(d)
        return F.coalesce(acc, d)
    return F.aggregate(F.coalesce(cands, F.array().cast("array<struct<fmt:string,yy:boolean>>")),
                       F.lit(None).cast("date"), step)


def _standardize_from(s: Column, pre: Column, sig: Column, prefer_american: bool) -> Column:
    order = ordered_formats(prefer_american)
    by_format = _try_candidates(pre, F.element_at(_candidates(order), sig), _max_candidates(order))
    iso_t = _iso_t(pre)
    # last resort: ordinals dropped, 'Sept' read as 'Sep', month-name formats again,
    # then a plain ISO date-time
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(pre, r"(?i)(\d+)(st|nd|rd|th)\b", "$1"),
                                          r"(?i)\bsept\b", "Sep"), r"\s+", " ")
    names = [f for f in order if "%B" in f or "%b" in f]
    by_name = _try_candidates(x, F.element_at(_candidates(names), signature(x)), _max_candidates(names))
    iso_ts = F.when(pre.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[ tT]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$"),
                    F.to_date(F.try_to_timestamp(F.regexp_replace(pre, "[tT]", " "))))
    serial = excel_serial(s)
    return (F.when(s.isNull(), F.lit(None).cast("date"))
            .when(serial.isNotNull(), serial)
            .when(F.length(pre) < 6, F.lit(None).cast("date"))
            .otherwise(F.coalesce(by_format, iso_t, by_name, iso_ts)))


def standardize_date(col, prefer_american: bool = True) -> Column:
    """Text (or date/timestamp) -> DATE following the documented trial order.

    null -> NULL; Excel serial; separator normalisation; fewer than 6 chars -> NULL;
    formats in preference order; last-resort name parse. Only the formats whose shape
    signature equals the row's are attempted (a literal map from signature to the
    ordered candidate formats), which keeps the expression small enough to compile."""
    c = F.col(col) if isinstance(col, str) else col
    s = c.cast("string")
    pre = preprocess(s)
    return _standardize_from(s, pre, signature(pre), prefer_american)


def standardize_dates(df: DataFrame, cols: dict[str, str], prefer_american: bool = True) -> DataFrame:
    """P1 for whole columns, ``{output: input}``.

    A ledger has far fewer distinct date strings than rows, so each distinct string is
    parsed once and joined back on the raw text. The distinct side is an aggregate
    whose size AQE measures at run time: it is broadcast when small (the usual case, no
    shuffle of the rows) and shuffled otherwise; a hot date string is one row on that
    side, so skew cannot multiply rows."""
    for i, (out, src) in enumerate(cols.items()):
        k, raw, val = f"__dk{i}", f"__draw{i}", f"__dval{i}"
        df = df.withColumn(k, F.col(src).cast("string"))
        parsed = (df.select(F.col(k).alias(raw)).filter(F.col(raw).isNotNull()).distinct()
                  .withColumn(val, standardize_date(F.col(raw), prefer_american)))
        df = df.join(parsed, F.col(k) == F.col(raw), "left").withColumn(out, F.col(val)).drop(k, raw, val)
    return df


def coerce_date(col) -> Column:
    """Simple parse (ISO date, or ISO date and time), invalid -> NULL."""
    c = F.col(col) if isinstance(col, str) else col
    s = F.trim(c.cast("string"))
    return F.coalesce(F.try_to_date(s, "yyyy-M-d"), F.try_to_date(s, "yyyy-M-d H:m:s"))


def detect_date_format(df: DataFrame, col: str = "date") -> DataFrame:
    """One aggregation pass counting, per format, the non-null values it parses.

    Returns one row: format, confidence (= hits / non-null), american_likely, non_null.
    Counts cover the whole column rather than the first 100 values.
    """
    pre = preprocess(F.col(col).cast("string"))
    aggs = [F.count(F.col(col)).alias("_n")]
    for i, f in enumerate(DATE_FORMATS):
        hit = _iso_t(pre) if f in _T_FORMATS else _parse_one(pre, f)
        aggs.append(F.count_if(hit.isNotNull()).alias(f"_f{i}"))
    row = df.agg(*aggs)
    entries = F.array(*[F.struct(F.col(f"_f{i}").alias("hits"), F.lit(-i).alias("neg_pos"), F.lit(f).alias("fmt"))
                        for i, f in enumerate(DATE_FORMATS)])
    amer = sum((F.col(f"_f{i}") for i, f in enumerate(DATE_FORMATS)
                if ("%m/%d" in f or "%m-%d" in f)), F.lit(0))
    euro = sum((F.col(f"_f{i}") for i, f in enumerate(DATE_FORMATS)
                if not ("%m/%d" in f or "%m-%d" in f) and ("%d/%m" in f or "%d-%m" in f)), F.lit(0))
    best = F.array_max(entries)
    return row.select(
        F.when(best["hits"] > 0, best["fmt"]).otherwise(F.lit("unknown")).alias("format"),
        F.when(best["hits"] > 0, best["hits"] / F.col("_n")).otherwise(F.lit(0.0)).alias("confidence"),
        (amer >= euro).alias("american_likely"),
        F.col("_n").cast("long").alias("non_null"),
    )


def normalize_dates(df: DataFrame, col: str = "date", prefer_american: bool = True) -> DataFrame:
    """Parse ``col`` in place, keep ``<col>_original`` and add ``<col>_invalid``
    (distinct raw strings are parsed once, see ``standardize_dates``)."""
    raw = F.col(col).cast("string")
    x = df.withColumns({f"{col}_original": F.col(col), "__blank": raw.isNull() | (F.trim(raw) == ""),
                        "__stripped": F.regexp_replace(F.trim(raw), r"(\d+)(st|nd|rd|th)", "$1")})
    x = standardize_dates(x, {"__parsed": "__stripped"}, prefer_american)
    x = x.withColumns({col: F.col("__parsed"), f"{col}_invalid": (~F.col("__blank")) & F.col("__parsed").isNull()})
    return x.drop("__blank", "__parsed", "__stripped")
