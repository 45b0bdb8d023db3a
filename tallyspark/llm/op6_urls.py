"""Operator 6, URL filters: rules, then a character language-model ratio.

Two variable-order Markov models over the characters of URLs, one of accepted and one of
rejected URLs, are counted on every URL that a rule decides. A URL without a rule is judged by
the difference of the two log-likelihoods a character, against a calibrated cut. Counts are exact
and stay a distributed table that grows with the different grams of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import query, read_table, staged

#: (verdict, host, path prefix): a rule fits its host and all subdomains.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
ORDER = 5                   # longest context, in characters
KAPPA = 2.0                 # weight of the next shorter context (Witten-Bell like, fixed mass)
HOT = 1 << 18               # most grams looked up in a broadcast; the others are joined, with equal results
SCALE = 1 << 32             # scores are summed as whole multiples of 1 / SCALE, so that order doesn't matter
FOLDS = 5                   # one of so many folds of different URLs is held out for the calibration
BINS = 4096                 # bins of the calibration's histogram for a ratio of 1


def parts(url: str = "url") -> tuple:
    """(host, path) columns: host after the first ``://`` up to ``/``, ``?``, ``#``, lower-cased
    for A-Z; path then up to ``?`` or ``#``; both empty for null or no ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_rules(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """Append ``host``, ``path``, ``rule`` and ``rule_verdict`` (null without a rule). Of the
    rules that fit, the longest (host and path together) wins, ties by the text of the rule."""
    host, path = parts(url)
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "rule_verdict")]
    out = pages.select(*[F.col(f"`{c}`") for c in keep], host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):   # the longest is asked first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def _grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For all characters (bytes of UTF-8, and an end mark) of ``urls``: the index of the URL, and
    the character in the lowest byte of a long below the ORDER characters before it (start
    marks first). Every URL has one at least, and those of a URL are neighbours."""
    marked = [b"\x02" * ORDER + u.encode("utf-8", "replace") + b"\x03" for u in urls]
    flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.int64)
    lens = np.fromiter(map(len, marked), np.int64, len(marked))
    owner = np.repeat(np.arange(len(marked)), lens)
    starts = np.cumsum(lens) - lens
    at = np.flatnonzero(np.arange(len(flat)) - starts[owner] >= ORDER)
    gram = flat[at]
    for k in range(1, ORDER + 1):
        gram |= flat[at - k] << (8 * k)
    return owner[at], gram


def count_grams(rows: DataFrame) -> DataFrame:
    """(gram, a, b, n): how often each gram occurs in the allowed, the blocked and all rows of
    ``rows(text, label)`` (label allow, block or null). Batches send sums."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            owner, gram = _grams(b["text"].tolist())
            found, where = np.unique(gram, return_inverse=True)
            sums = {c: np.bincount(where, (b["label"] == label).to_numpy()[owner], len(found)).astype(np.int64)
                    for c, label in (("a", "allow"), ("b", "block"))}
            yield pd.DataFrame({"gram": found, **sums, "n": np.bincount(where, minlength=len(found))})

    return (rows.mapInPandas(partial, "gram long, a long, b long, n long")
            .groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n")))


def gram_scores(counts: DataFrame) -> DataFrame:
    """(gram, score, n): log-likelihood of the gram's last character under the accepted model less
    that under the rejected, in units of 1 / SCALE.

    From the shortest context to the longest, each order's counts are sums over the grams with
    the same end; a context has at most 256 of them, which is the largest window.
    """
    shorter = None
    for k in range(ORDER + 1):
        end = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        own = counts.groupBy(end.alias("gram")).agg(*[F.sum(c).alias(c) for c in ("a", "b", "n")])
        context = Window.partitionBy(F.shiftright("gram", 8))
        own = own.select("gram", "a", "b", "n", F.sum("a").over(context).alias("head_a"), F.sum("b").over(context).alias("head_b"))
        if shorter is None:
            own = own.withColumns({"back_a": F.lit(1 / 256), "back_b": F.lit(1 / 256)})
        else:
            own = own.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(shorter, "tail")
        p = {c: (F.col(c) + KAPPA * F.col("back_" + c)) / (F.col("head_" + c) + KAPPA) for c in ("a", "b")}
        if k < ORDER:
            shorter = own.select(F.col("gram").alias("tail"), p["a"].alias("back_a"), p["b"].alias("back_b"))
    return own.select("gram", F.round((F.log(p["a"]) - F.log(p["b"])) * SCALE).cast("long").alias("score"), "n")


def hot_from(scores: DataFrame) -> tuple[int, bool]:
    """The least count from which grams are broadcast, so that at most HOT are; whether all are.
    Counts are grouped by their number of bits."""
    bits = F.length(F.bin("n"))
    left = HOT
    for r in scores.groupBy(bits.alias("bits")).count().orderBy(F.desc("bits")).collect():
        left -= r["count"]
        if left < 0:
            return 1 << r["bits"], False
    return 1, True


def with_ratio(rows: DataFrame, scores: DataFrame, text: str = "__llm_seen") -> DataFrame:
    """Append ``lm_ratio``, the mean score a character, to ``rows``. ``scores`` has every gram of them.

    Of each text the frequent grams are looked up in a broadcast of at most HOT; the others,
    summed by text, are joined to ``scores``.
    """
    least, whole = hot_from(scores)
    hot = scores.where(F.col("n") >= least).select("gram", "score").toPandas().sort_values("gram")
    handle = rows.sparkSession.sparkContext.broadcast((hot["gram"].to_numpy(np.int64), hot["score"].to_numpy(np.int64)))

    def looked_up(gram):
        keys, values = handle.value
        if not len(keys):
            return np.zeros(len(gram), bool), np.zeros(len(gram), np.int64)
        at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
        known = keys[at] == gram
        return known, np.where(known, values[at], 0)

    @F.pandas_udf("long")
    def hot_sum(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            if not len(texts):
                yield pd.Series([], dtype="int64")
                continue
            owner, gram = _grams(texts.tolist())
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            yield pd.Series(np.add.reduceat(looked_up(gram)[1], starts))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            owner, gram = _grams(b["text"].tolist())
            cold = ~looked_up(gram)[0]
            pairs = pd.DataFrame({"id": b["id"].to_numpy()[owner[cold]], "gram": gram[cold]})
            yield pairs.groupby(["id", "gram"], sort=False).size().rename("times").reset_index()

    total = hot_sum.asNondeterministic()(text)
    if not whole:
        texts = staged(rows.select(F.col(text).alias("text")).distinct().withColumn("id", F.monotonically_increasing_id()), "urls")
        rest = (texts.mapInPandas(others, "id long, gram long, times long").join(scores.select("gram", "score"), "gram")
                .groupBy("id").agg(F.sum(F.col("score") * F.col("times")).alias("__llm_rest")))
        rest = staged(texts.join(rest, "id").select(F.col("text").alias(text), "__llm_rest"), "url_rest")
        rows = rows.join(rest, text, "left")
        total = total + F.coalesce("__llm_rest", F.lit(0))
    out = rows.withColumn("lm_ratio", total / F.lit(float(SCALE)) / (F.octet_length(text) + 1))
    return out.drop("__llm_rest")


def judge(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """Append ``host``, ``path``, ``rule``, ``lm_ratio`` double and ``verdict`` to ``pages``.

    The models learn from the rule-decided rows; the part of a URL that both see is the whole
    text after ``://`` with its scheme left out. The cut is chosen on a fold of the decided URLs, by the hash of
    their text, with models that have not seen them. A null URL counts as an empty one. If one class
    has no rows, its model is uniform; if both are empty, URLs without a rule are allowed
    (ratio 0 against cut 0). Equal URLs get equal verdicts; input columns of the appended
    names are replaced.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "lm_ratio", "verdict", "rule_verdict")]
    ruled = with_rules(pages.select(*[F.col(f"`{c}`") for c in keep]), rules, url)
    seen = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "^[^:/?#]*://", "")
    ruled = ruled.withColumn("__llm_seen", seen)
    held = F.pmod(F.xxhash64("__llm_seen"), F.lit(FOLDS)) == 0
    unseen = learned(ruled.withColumn("rule_verdict", F.when(~held, F.col("rule_verdict"))))
    cut = calibrated_cut(with_ratio(ruled.where(held & F.col("rule_verdict").isNotNull()), unseen))
    out = with_ratio(ruled, learned(ruled))
    verdict = F.coalesce("rule_verdict", F.when(F.col("lm_ratio") >= F.lit(cut), "allow").otherwise("block"))
    order = [*keep, "host", "path", "rule", "lm_ratio"]
    return out.select(*[F.col(f"`{c}`") for c in order], verdict.alias("verdict"))


def learned(ruled: DataFrame) -> DataFrame:
    """Scores of all grams of ``ruled(__llm_seen, rule_verdict)`` under the models of its decided rows."""
    counts = count_grams(ruled.select(F.col("__llm_seen").alias("text"), F.col("rule_verdict").alias("label")))
    return staged(gram_scores(staged(counts, "grams")), "gram_scores")


def calibrated_cut(out: DataFrame) -> float:
    """Cut with the fewest errors, equally weighted by class, on the rows of ``out`` that a rule decides; 0 if
    a class is missing. Cuts lie between the bins of a histogram (BINS for a ratio of 1), whose
    size doesn't depend on the number of rows, or at 0."""
    hist = (out.where("rule_verdict is not null").groupBy(F.floor(F.col("lm_ratio") * BINS).alias("bin"))
            .agg(F.count_if(F.col("rule_verdict") == "allow").alias("good"), F.count_if(F.col("rule_verdict") == "block").alias("bad"),
                 F.min("lm_ratio").alias("lo"), F.max("lm_ratio").alias("hi")).toPandas().sort_values("bin"))
    good, bad, lo, hi = (hist[c].to_numpy(float) for c in ("good", "bad", "lo", "hi"))
    if not good.sum() or not bad.sum():
        return 0.0
    cuts = np.concatenate([(hi[:-1] + lo[1:]) / 2, [0.0]])
    under = np.searchsorted(lo, cuts)       # bins below each cut
    good, bad = (np.concatenate([[0.0], np.cumsum(x)]) / x.sum() for x in (good, bad))
    wrong = good[under] + 1 - bad[under]
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    return float(cuts[best[np.abs(cuts[best]).argmin()]])


@query("op6_url_models")
def op6_url_models(spark, sf_dir):
    """Verdict on every page's URL: the rule's, else the models'."""
    out = judge(read_table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "lm_ratio")
