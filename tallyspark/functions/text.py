"""Text cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from .fixed_values import BLANK_MEMO, BLANK_TEXT, EMAIL_PATTERN, VENDOR_PREFIXES


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col) -> Column:
    """Trim; 'nan', 'None', '' and 'null' become NULL."""
    t = F.trim(_c(col).cast("string"))
    return F.when(~t.isin(*BLANK_TEXT), t)


def normalize_string(col) -> Column:
    """P9 for one column: trim + lower; 'nan', 'none' and '' become NULL."""
    t = F.lower(F.trim(_c(col).cast("string")))
    return F.when(~t.isin("nan", "none", ""), t)


def normalize_strings(df: DataFrame) -> DataFrame:
    """Apply ``normalize_string`` to every string column."""
    return df.select(*[normalize_string(f.name).alias(f.name) if isinstance(f.dataType, StringType)
                       else F.col(f.name) for f in df.schema.fields])


def title_case(col) -> Column:
    """P10: capitalise each blank-separated word (``initcap``)."""
    return F.initcap(_c(col))


def email_valid(col) -> Column:
    """NULL for NULL input, else whether the address matches the pattern."""
    c = _c(col).cast("string")
    return F.when(c.isNotNull(), c.rlike(EMAIL_PATTERN))


def digits_only(col) -> Column:
    """Keep digits; empty result becomes NULL."""
    d = F.regexp_replace(_c(col).cast("string"), r"[^0-9]", "")
    return F.when(d != "", d)


def extract_vendor(col) -> Column:
    """First token after the last 'POS '/'PURCHASE '/'PAYMENT ' (checked in that
    order), else the first word, else 'Unknown'."""
    d = F.trim(_c(col).cast("string"))
    first_word = F.regexp_extract(d, r"^\s*(\S+)", 1)
    out = F.when(first_word != "", first_word).otherwise(F.lit("Unknown"))
    for p in reversed(VENDOR_PREFIXES):
        after = F.element_at(F.split(d, p), -1)
        tok = F.regexp_extract(after, r"^\s*(\S+)", 1)
        out = F.when(d.contains(p), F.when(tok != "", tok).otherwise(F.lit("Unknown"))).otherwise(out)
    return F.when(d.isNull(), F.lit("Unknown")).otherwise(out)


def _capitalize_words(words: Column, keep_upper: bool) -> Column:
    def cap(w):
        c = F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))
        if keep_upper:
            return F.when((w == F.upper(w)) & (w != F.lower(w)), w).otherwise(c)
        return c
    return F.array_join(F.transform(words, cap), " ")


def capitalize_vendor(col, canonical: Column | None = None) -> Column:
    """Canonical name if given, else capitalise words keeping ALL-CAPS words."""
    c = _c(col).cast("string")
    words = F.split(F.trim(c), r"\s+")
    cap = _capitalize_words(words, keep_upper=True)
    out = F.when(c.isNull() | (F.trim(c) == ""), c).otherwise(cap)
    return F.coalesce(canonical, out) if canonical is not None else out


def capitalize_memo(col) -> Column:
    """Trim, capitalise each word; empty and 'nan' become NULL."""
    c = F.trim(_c(col).cast("string"))
    cap = _capitalize_words(F.split(c, r"\s+"), keep_upper=False)
    return F.when(c.isNull() | (c == "") | (F.lower(c) == "nan"), F.lit(None).cast("string")).otherwise(cap)


def dedup_key(vendor="vendor", amount="amount", date="date") -> Column:
    """md5 of 'vendor_amount_date' (amount rendered as text, missing parts blank)."""
    parts = [F.coalesce(_c(x).cast("string"), F.lit("")) for x in (vendor, amount, date)]
    return F.md5(F.concat_ws("_", *parts))


def memo_is_blank(col) -> Column:
    """True for NULL memos and for the placeholder words (any case, trimmed)."""
    c = _c(col).cast("string")
    return c.isNull() | F.lower(F.trim(c)).isin(*BLANK_MEMO)


def fill_memo(memo="memo", vendor="vendor", category="category", amount="amount") -> Column:
    """Blank memo -> '<category> expense from <vendor>' when amount > 0, otherwise
    '<category> refund from <vendor>' (NULL amount counts as not > 0)."""
    v = F.coalesce(_c(vendor).cast("string"), F.lit("Unknown"))
    cat = F.coalesce(_c(category).cast("string"), F.lit("Other"))
    positive = F.coalesce(_c(amount) > 0, F.lit(False))
    generated = F.when(positive, F.concat(cat, F.lit(" expense from "), v)) \
                 .otherwise(F.concat(cat, F.lit(" refund from "), v))
    return F.when(memo_is_blank(memo), generated).otherwise(_c(memo))


def template_memo(vendor: Column, descriptor: Column) -> Column:
    """P18: '<vendor> <descriptor>' when a registry descriptor exists."""
    return F.when(descriptor.isNotNull(), F.concat_ws(" ", vendor, descriptor))
