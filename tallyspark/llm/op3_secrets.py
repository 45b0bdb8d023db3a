"""Operator 3, secret scans: fixed patterns and a battery of randomness tests.

DataFrame functions only. Besides the pattern spans, long unbroken tokens are tested for randomness in
the alphabet of their inferred encoding: chi-squared uniformity, Wald-Wolfowitz runs and
lag-one serial correlation. Non-random tokens are those that a Benjamini-Hochberg procedure
finds in their class of encoding and length; what it leaves is reported as ``random``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import query, read_table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_GATE = "(?i)passw(?:or)?d|secret|token|api_?key"
ACCESS = "AKIA[A-Z0-9]{16,}"          # same as a run after AKIA, kept from 20 characters on
HEX = "[0-9a-f]{24,}"                 # same as a run, kept from 24 characters on
LONG_TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"    # "=" pads an end or precedes a value

KINDS = ["assign", "access", "hex", "random"]      # order of spans with the same start
#: Alphabets by inferred encoding, in the order of their digits (fixed values).
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "decimal": "0123456789",
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "base52": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
FDR = 0.05                            # share of random tokens among those called non-random
LENGTH_BANDS = [24, 32, 48, 64, 128]  # upper ends; longer tokens form the last band
FLOORS = [0.02, 0.01, 0.005, 0.002, 0.001, 0.0001]   # p-value, by band, under which a token is never random
BINS_A_DECADE, BINS = 20, 400

_SPAN = "struct<start:int,rank:int,end:int>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(steps: Column) -> Column:
    """Exclusive running sum of an int array, in blocks so that long arrays stay linear."""
    def run(a):
        zero = F.struct(F.lit(0).alias("s"), F.expr("cast(array() as array<int>)").alias("o"))
        return F.aggregate(a, zero, lambda acc, x: F.struct(
            (acc["s"] + x).alias("s"), F.concat(acc["o"], F.array(acc["s"])).alias("o")))["o"]

    def whole(steps):
        last = F.floor((F.greatest(F.size(steps), F.lit(1)) - 1) / 256).cast("int")
        return _let(F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(steps, b * 256 + 1, F.lit(256))), shifted)

    def shifted(blocks):
        sums = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v))
        return F.flatten(F.zip_with(F.transform(blocks, run), run(sums), lambda a, o: F.transform(a, lambda v: v + o)))

    return _let(steps, whole)


def matches(text: Column, pattern: str, gate: str | None = None) -> Column:
    """array<struct<start:int, found:string>> of the leftmost non-overlapping matches; starts in
    code points. The texts between matches give the starts."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"),
                    F.transform(F.split(text, pattern, -1), F.length).alias("gaps"))

    def located(x):
        # one running sum over gap and match lengths; the gap before a match is added to it
        before = _running(F.zip_with(F.slice(x["gaps"], F.lit(1), F.size(x["found"])), x["found"],
                                     lambda g, m: g + F.length(m)))
        parts = F.arrays_zip(before.alias("before"), F.slice(x["gaps"], F.lit(1), F.size(x["found"])).alias("gap"),
                             x["found"].alias("found"))
        return F.transform(parts, lambda z: F.struct((z["before"] + z["gap"]).alias("start"), z["found"].alias("found")))

    none = F.expr("cast(array() as array<struct<start:int,found:string>>)")
    return F.when(text.rlike(gate or pattern), _let(both, located)).otherwise(none)


def _spans(found: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"),
                                                 (m["start"] + F.length(m["found"])).alias("end")))


def base_spans(text: Column) -> tuple[Column, Column, Column]:
    """Spans of the kinds assign, access and hex."""
    assign = F.filter(matches(text, ASSIGN, ASSIGN_GATE),
                      lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 2)) >= 6)
    return _spans(assign, "assign"), _spans(matches(text, ACCESS), "access"), _spans(matches(text, HEX), "hex")


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (logistic form, error below 0.0002)."""
    z = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def _encoded(m: Column) -> Column:
    """struct(start, end, enc, s): a found token with its inferred encoding; padding and case or
    URL variants of the alphabet are normalised in ``s``."""
    def infer(s):
        mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
        enc = (F.when(mixed & s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
               .when(mixed & s.rlike("^([A-Z2-7]+|[a-z2-7]+)$"), "base32")
               .when(mixed & s.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), "base36").when(s.rlike("^[0-9]+$"), "decimal")
               .when(s.rlike("^([a-z]+|[A-Z]+)$"), "letters").when(s.rlike("^[A-Za-z]+$"), "base52")
               .when(s.rlike("^[A-Za-z0-9]+$"), "base62").otherwise("base64"))
        return F.struct(enc.alias("enc"), s.alias("s"))

    def placed(x):
        plain = (F.when(x["enc"].isin("hex", "base36", "letters"), F.lower(x["s"]))
                 .when(x["enc"] == "base32", F.upper(x["s"])).otherwise(F.translate(x["s"], "-_", "+/")))
        return F.struct(m["start"].alias("start"), (m["start"] + F.length(m["found"])).alias("end"),
                        x["enc"].alias("enc"), plain.alias("s"))

    return _let(_let(F.regexp_replace(m["found"], "=+$", ""), infer), placed)


def _measured(x: Column) -> Column:
    """The token's digits, symbol counts and runs, from which the tests are computed."""
    alphabet = halves = F.lit(None).cast("string")
    for name, a in ALPHABETS.items():
        bits = "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2)
        alphabet = F.when(x["enc"] == name, F.lit(a)).otherwise(alphabet)
        halves = F.when(x["enc"] == name, F.translate(x["s"], a, bits)).otherwise(halves)
    chars = F.filter(F.split(x["s"], ""), lambda c: c != "")

    def counted(y):
        n = F.length(x["s"])
        squares = F.aggregate(F.array_distinct(y["chars"]), F.lit(0.0), lambda acc, c: acc + F.pow(
            (n - F.length(F.replace(x["s"], c, F.lit("")))).cast("double"), F.lit(2)))
        runs = (F.size(F.filter(F.split(y["halves"], "0"), lambda z: z != ""))
                + F.size(F.filter(F.split(y["halves"], "1"), lambda z: z != "")))
        return F.struct(
            n.cast("double").alias("n"), F.length(y["alphabet"]).cast("double").alias("k"), squares.alias("squares"),
            F.length(F.replace(y["halves"], F.lit("0"), F.lit(""))).cast("double").alias("ones"),
            runs.cast("double").alias("runs"),
            F.transform(y["chars"], lambda c: F.instr(y["alphabet"], c).cast("double")).alias("v"))

    return _let(F.struct(alphabet.alias("alphabet"), halves.alias("halves"), chars.alias("chars")), counted)


def _battery(y: Column) -> Column:
    """p-value of the hypothesis that the token is random in its alphabet: the least of the three
    tests, times three."""
    n, k = y["n"], y["k"]
    # chi-squared; Wilson-Hilferty turns it into a normal deviate
    chi, df = k / n * y["squares"] - n, k - 1
    z_chi = (F.cbrt(chi / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # runs of the lower and upper half of the alphabet
    mean = 2 * y["ones"] * (n - y["ones"]) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    p_runs = F.when(var > 0, 2 * _tail(F.abs(y["runs"] - mean) / F.sqrt(var))).otherwise(F.lit(0.0))
    # serial correlation of neighbours
    last = F.size(y["v"]) - 1
    total = F.aggregate(y["v"], F.lit(0.0), lambda acc, x: acc + x)
    total2 = F.aggregate(y["v"], F.lit(0.0), lambda acc, x: acc + x * x)
    cross = F.aggregate(F.zip_with(F.slice(y["v"], F.lit(1), last), F.slice(y["v"], F.lit(2), last), lambda a, b: a * b),
                        F.lit(0.0), lambda acc, x: acc + x)

    def combined(t):
        centre = F.pow(t["total"] / n, F.lit(2))
        spread = t["total2"] / n - centre
        r = F.when(spread > 0, (t["cross"] / (n - 1) - centre) / spread).otherwise(F.lit(1.0))
        return F.least(F.lit(1.0), 3 * F.least(_tail(z_chi), p_runs, 2 * _tail(F.abs(r) * F.sqrt(n - 1))))

    return _let(F.struct(total.alias("total"), total2.alias("total2"), cross.alias("cross")), combined)


def tested_tokens(text: Column) -> Column:
    """array<struct<start, end, enc, band, bin>> of the long tokens of a text, with the bin of
    their p-value on a logarithmic scale."""
    def test(x):
        n = x["end"] - x["start"]
        band = F.lit(len(LENGTH_BANDS))
        for i in reversed(range(len(LENGTH_BANDS))):
            band = F.when(n <= LENGTH_BANDS[i], F.lit(i)).otherwise(band)
        p = F.greatest(_let(_measured(x), _battery), F.lit(1e-20))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["enc"].alias("enc"),
                        band.alias("band"), F.floor(-F.log10(p) * BINS_A_DECADE).cast("int").alias("bin"))
    return F.transform(F.transform(matches(text, LONG_TOKEN), _encoded), test)


def fdr_cuts(docs: DataFrame, text: str = "text") -> dict[tuple[str, int], int]:
    """By (encoding, length band): the first bin that Benjamini-Hochberg at level FDR over all
    tokens of the class calls non-random, no later than the class's floor.

    The table is a histogram of p-values, of at most 8 * 6 * (BINS + 1) rows whatever the corpus.
    """
    hist = (docs.select(F.explode(tested_tokens(F.coalesce(F.col(text), F.lit("")))).alias("t"))
            .groupBy("t.enc", "t.band", "t.bin").count().collect())
    cuts = {}
    for enc in ALPHABETS:
        for band, floor in enumerate(FLOORS):
            cls = sorted(((r.bin, r["count"]) for r in hist if (r.enc, r.band) == (enc, band)), reverse=True)
            m, below = sum(c for _, c in cls), 0
            cut = int(-math.log10(floor) * BINS_A_DECADE)
            for b, c in cls:
                below += c
                if 10 ** (-b / BINS_A_DECADE) <= FDR * below / m:
                    cut = min(cut, b)
            cuts[enc, band] = cut
    return cuts


def scan(docs: DataFrame, text: str = "text", cuts: dict | None = None) -> DataFrame:
    """Append ``n_assign``, ``n_access``, ``n_hex``, ``n_random`` (long), ``base_spans`` and ``spans``
    (array<struct<start:int,rank:int,end:int>>, sorted; rank indexes KINDS) to ``docs``.

    A null or empty text has no spans; the whole text is scanned; repeated rows get the same
    spans; input columns of the appended names are replaced. ``cuts`` come from
    :func:`fdr_cuts` over the same rows unless given.
    """
    new = ["n_assign", "n_access", "n_hex", "n_random", "base_spans", "spans"]
    cuts = fdr_cuts(docs, text) if cuts is None else cuts
    limits = F.create_map(*[F.lit(x) for (enc, band), cut in cuts.items() for x in (f"{enc}:{band}", cut)])
    t = F.coalesce(F.col(text), F.lit(""))
    assign, access, hexes = base_spans(t)
    rank = KINDS.index("random")
    rand = F.filter(F.col("__llm_tokens"), lambda x: x["bin"] < limits[F.concat_ws(":", x["enc"], x["band"])])
    rand = F.transform(rand, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new], assign.alias("__llm_assign"),
                      access.alias("__llm_access"), hexes.alias("__llm_hex"), tested_tokens(t).alias("__llm_tokens"))
    out = out.withColumn("__llm_random", rand)
    base = F.array_sort(F.concat("__llm_assign", "__llm_access", "__llm_hex"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new],
                      *[F.size("__llm_" + c[2:]).cast("long").alias(c) for c in new[:4]], base.alias("base_spans"),
                      F.array_sort(F.concat("__llm_assign", "__llm_access", "__llm_hex", "__llm_random")).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span (overlapping ones together) replaced by ``mask``; null stays null."""
    found = scan(docs.withColumn("__llm_text", F.col(text)), "__llm_text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        apart = s["start"] >= acc["at"]
        gap = F.substring(
            F.col("__llm_text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(apart, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", start, step,
                       lambda acc: F.concat(acc["out"], F.substring(F.col("__llm_text"), acc["at"] + 1, F.length("__llm_text"))))
    clean = F.when(F.size("spans") > 0, done).otherwise(F.col("__llm_text"))
    return found.withColumn("__llm_clean", clean)


@query("op3_randomness_battery")
def op3_randomness_battery(spark, sf_dir):
    """Spans of secrets in every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan(docs)
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "n_random",
                      F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"),
                      spans_text(F.col("spans")).alias("spans"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document stays; its secrets are masked and ``n_chars`` follows."""
    out = redact(docs.select(F.struct("*").alias("__llm_row"), "text"), "text")
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("__llm_clean").alias(c))
        elif c == "n_chars":
            old = F.col("__llm_row.n_chars")
            cols.append(F.when(F.size("spans") > 0, F.length("__llm_clean").cast(docs.schema[c].dataType)).otherwise(old).alias(c))
        else:
            cols.append(F.col("__llm_row").getField(c).alias(c))
    return out.select(*cols)
