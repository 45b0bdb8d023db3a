"""Operator 8, language identification by compression.

Each language has a zstandard raw-content dictionary cut from labelled training texts. A text
is compressed, block by block, once with every dictionary; the language whose dictionary
gives the fewest bytes wins, and a narrow margin is reported as a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, query, read_table, staged

WINDOW_CHARS = 256          # a training text is seen as windows of so many characters, side by side
WINDOWS_A_TEXT = 2          # of which so many, at hashed places, may enter the sample
SAMPLE_WINDOWS = 400        # bound of the different windows read to the driver, a language
GROUP_LANGS = 64            # dictionaries that a task holds at once; more languages take more passes
BLOCK = 4096                # bytes compressed at once, so that the dictionary keeps its weight
LEVEL, MIN_MATCH = 5, 3     # short matches, as words share endings rather than lines
MARGIN = 0.01               # relative lead under which a prediction counts as rejected


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """One raw-content dictionary a language, for all languages of rows with text and lang.

    Fitted on a bounded sample of labelled rows: of each language the ``SAMPLE_WINDOWS`` windows with
    the smallest hash. Windows come from hashed places of the whole texts and enter once, whatever the copies
    they stand in, so neither a header on every text nor a group of copies fills a dictionary. The
    number of languages is not bounded, what comes to the driver of one is. Equal windows meet in
    the map tasks, and the limit is a literal, which Spark applies before the shuffle too.
    """
    n = F.ceil(F.char_length("text") / WINDOW_CHARS)
    places = F.array(*[F.pmod(F.xxhash64(F.lit(k), "text"), n) for k in range(WINDOWS_A_TEXT)])
    rows = (docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
            .where("lang is not null and text is not null and text rlike '\\\\p{L}'")
            .withColumn("at", F.explode(F.array_distinct(places)))
            .select("lang", F.substring("text", (F.col("at") * WINDOW_CHARS + 1).cast("int"), F.lit(WINDOW_CHARS)).alias("part"))
            .where("part rlike '\\\\p{L}'").distinct())
    w = Window.partitionBy("lang").orderBy(F.xxhash64("part"), "part")
    sample = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= SAMPLE_WINDOWS)
    parts: dict[str, list[bytes]] = {}
    for r in sample.orderBy("lang", "k").collect():
        parts.setdefault(r.lang, []).append(r.part.lower().encode())
    return {name: b"\n".join(p) for name, p in sorted(parts.items())}


def predict(docs: DataFrame, model: dict[str, bytes], text: str = "text") -> DataFrame:
    """Append ``lang_pred`` string, ``lang_score`` double and ``lang_rejected`` boolean.

    The whole text counts, in blocks of ``BLOCK`` bytes. Null texts, texts without a letter and an
    empty model give ``und`` with score 0, rejected; input columns of these names are replaced. Repeated rows
    get equal results. Ties go to the first language by name. The score is the winner's share under softmax
    of the byte counts. A task holds the dictionaries of ``GROUP_LANGS`` languages; the sizes under further
    groups are added in passes over a staged table.
    """
    names = sorted(model)
    new = ("lang_pred", "lang_score", "lang_rejected")
    keep = [c for c in docs.columns if c not in new]
    out = bounded_batches(docs).withColumn("__llm_sizes", F.array().cast("array<int>"))
    for k in range(0, len(names), GROUP_LANGS):
        if k:
            out = staged(out, "sizes")
        sizes = _sizes_udf(docs, {n: model[n] for n in names[k:k + GROUP_LANGS]})
        out = out.withColumn("__llm_sizes", F.concat("__llm_sizes", sizes(F.col(text))))
    sizes = F.col("__llm_sizes")
    known, best, two = F.size(sizes) > 0, F.array_min(sizes), F.slice(F.array_sort(sizes), 1, 2)
    second = F.when(F.size(two) > 1, F.get(two, 1)).otherwise(2 * best)
    # a byte saved is eight bits of likelihood; damped, as blocks aren't independent
    share = 1 / F.aggregate(sizes, F.lit(0.0), lambda acc, s: acc + F.exp(-F.least(F.lit(700.0), (s - best) / 4)))
    at = F.array_position(sizes, best).cast("int") - 1
    return out.select(
        *[F.col(f"`{c}`") for c in keep],
        F.when(known, F.get(F.array(*map(F.lit, names)) if names else F.array(F.lit("und")), at)).otherwise(F.lit("und")).alias("lang_pred"),
        F.when(known, share).otherwise(F.lit(0.0)).alias("lang_score"),
        F.when(known, (second - best) < MARGIN * best).otherwise(F.lit(True)).alias("lang_rejected"))


def _sizes_udf(docs: DataFrame, model: dict[str, bytes]):
    """Bytes of a text under each dictionary of ``model``, by name; empty for a text without a letter."""
    handle = docs.sparkSession.sparkContext.broadcast(model)   # at most GROUP_LANGS dictionaries

    @F.pandas_udf("array<int>")
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import zstandard

        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        coders = []
        for _, content in sorted(handle.value.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=settings)
            coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=settings).compress)
        for texts in batches:
            yield pd.Series([_sizes_one(t, coders) for t in texts], dtype=object)
    return sizes.asNondeterministic()      # keeps the optimizer from evaluating it once per column


def _sizes_one(text: str | None, coders) -> list[int]:
    if not text or not any(map(str.isalpha, text)):
        return []
    raw = text.lower().encode("utf-8", "replace")     # as the dictionaries: letters without case
    blocks = [raw[k:k + BLOCK] for k in range(0, len(raw), BLOCK)]
    return [sum(len(squeeze(x)) for x in blocks) for squeeze in coders]


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    """Language of every document, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2,
                                                  F.lit(False)))
    model = learn(docs.where("not held_out"))
    out = predict(docs.select("doc_id", "text", "held_out"), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"),
                      F.col("lang_rejected").alias("rejected"))
