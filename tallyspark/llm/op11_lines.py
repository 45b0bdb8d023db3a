"""Operator 11, line deduplication across documents, with Spark's own functions only.

Lines are normalised, hashed and exploded; the documents of each hash are counted, lines of a hash
that reaches the threshold go, and the lines left are put together again by position. Texts
themselves move once, to meet the positions they lose; all that is counted and joined before
that are hashes of 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import query, read_table, spread_join, staged

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS = 1
LEAST_DOCS = 10


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """The key of each line: A-Z lower-cased, blanks stripped at both ends."""
    return F.transform(lines_of(F.translate(text, UPPER, LOWER)), lambda line: F.btrim(line, F.lit(BLANK)))


def _hashed(key: Column, chars: int) -> Column:
    """128 bits of a key as two longs; null for a key that is too short to count."""
    return F.when(F.char_length(key) >= chars, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")))


def frequent_lines(docs: DataFrame, text: str = "text", chars: int = LEAST_CHARS, least: int = LEAST_DOCS) -> DataFrame:
    """``(h1, h2, n)`` of the keys found in ``n >= least`` documents. A document gives a key once; a key
    of all documents is summed in the map tasks before it is shuffled."""
    one = F.transform(F.array_distinct(F.filter(line_keys(F.col(text)), lambda k: F.char_length(k) >= chars)),
                      lambda k: _hashed(k, chars))
    return (docs.select(F.explode(one).alias("k")).groupBy("k.h1", "k.h2").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least))


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: int = LEAST_CHARS,
               least: int = LEAST_DOCS, prefix: str = "l_") -> DataFrame:
    """Append ``n_lines``, ``n_dropped`` and ``kept`` (the text left), each name after ``prefix``, to ``docs``.

    Every row counts as a document, so repeated rows count each and get equal results; null ids are
    ids like others. A null or empty text is one empty line, which is kept, as are all blank lines
    while ``chars`` is above 0. Line ends of other systems (``\\r``) are blanks of a key and stay in lines kept.
    A text whose lines all go is the empty string. Texts of any length are taken whole, empty tables
    give empty results; a column with the name of an appended one is replaced.
    """
    names = {prefix + n for n in ("n_lines", "n_dropped", "kept")}
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    row = [F.xxhash64(F.col(doc_id), F.col(text)).alias("__llm_r1"), F.xxhash64(F.lit("row"), F.col(text), F.col(doc_id)).alias("__llm_r2")]
    own = docs.select(*keep, F.col(text).alias("__llm_text"), *row)
    often = staged(frequent_lines(docs, text, chars, least), "lines")
    at = F.transform(line_keys(F.col("__llm_text")), lambda k, i: F.struct(i.alias("pos"), _hashed(k, chars).alias("k")))
    lines = (own.select("__llm_r1", "__llm_r2", F.explode(at).alias("at")).where("at.k is not null")
             .select("__llm_r1", "__llm_r2", "at.pos", "at.k.h1", "at.k.h2"))
    gone = (spread_join(lines, often, ["h1", "h2"], "left_semi").groupBy("__llm_r1", "__llm_r2")
            .agg(F.collect_set("pos").alias("__llm_gone")))
    both = (own.join(gone, ["__llm_r1", "__llm_r2"], "left")
            .withColumn("__llm_lines", lines_of(F.col("__llm_text"))).withColumn("__llm_n", F.size("__llm_lines"))
            .withColumn("__llm_left", F.when(F.col("__llm_gone").isNotNull(), F.array_except(
                F.sequence(F.lit(0), F.col("__llm_n") - 1), "__llm_gone"))))
    left, lost = F.col("__llm_left"), F.col("__llm_left").isNotNull()
    kept = F.array_join(F.transform(left, lambda i: F.get("__llm_lines", i)), "\n")
    return both.select(*keep, F.col("__llm_n").cast("long").alias(prefix + "n_lines"),
                       F.when(lost, F.col("__llm_n") - F.size(left)).otherwise(F.lit(0)).cast("long").alias(prefix + "n_dropped"),
                       F.when(lost, kept).otherwise(F.coalesce("__llm_text", F.lit(""))).alias(prefix + "kept"))


SQL = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM cut),
keyed AS (SELECT *, trim(translate(line, '{UPPER}', '{LOWER}'),
                         ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines),
often AS (SELECT k FROM keyed WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
marked AS (SELECT keyed.*, often.k IS NOT NULL AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op11_line_dedup", SQL)
def op11_line_dedup(spark, sf_dir):
    """Per document: lines, lines dropped, and the digest of the text left."""
    out = drop_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("l_n_lines").alias("n_lines"), F.col("l_n_dropped").alias("n_dropped"),
                      F.sha2(F.col("l_kept"), 256).alias("kept_sha256"))
