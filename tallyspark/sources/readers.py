"""Sources and sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_ledger(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """Read a ledger file/folder. CSV is read with a header and every column as
    STRING (no inference pass); parquet/json keep their types. The source file of every
    row is kept in ``source_file``."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet" if path.endswith(".parquet")
                  else "json" if path.endswith(".json") else "csv")
    if fmt not in ("csv", "parquet", "json"):
        raise ValueError(f"unsupported format {fmt!r} (csv, parquet, json)")
    r = spark.read
    if fmt == "csv":
        r = r.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE")
    if schema:
        r = r.schema(schema)
    df = r.format(fmt).load(path)
    return df.withColumn("source_file", F.col("_metadata.file_path"))


BROKEN = "_corrupt_record"      # text of a row that does not fit its file's header or is no JSON, else NULL


def _format(path: str) -> str:
    end = path.rstrip("/").rsplit(".", 1)[-1].lower()
    return end if end in ("csv", "json", "parquet") else "csv"


def _problem(spark: SparkSession, path: str) -> str | None:
    """Why a path cannot be read, None if it can."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return "path not found"
    status = fs.getFileStatus(p)
    return "empty file" if status.isFile() and not status.getLen() else None


def header_groups(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The CSV files of ``paths`` by their header line: one job, a row a file. Empty files have no header."""
    lines = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start").filter("file_block_start = 0")
    first = lines.withColumn("at", F.monotonically_increasing_id()).groupBy("file_path").agg(F.min_by("value", "at").alias("header"))
    groups: dict[str, list[str]] = {}
    for r in first.orderBy("file_path").collect():
        groups.setdefault(r.header, []).append(r.file_path)
    return groups


def _csv_group(spark: SparkSession, header: str, files: list[str]) -> DataFrame:
    """All files with one header as one scan, every column as STRING."""
    names = spark.createDataFrame([(header,)], "h string").select(F.from_csv("h", ", ".join(
        f"c{k} string" for k in range(header.count(",") + 1))).alias("r")).select("r.*").first()
    seen: dict[str, int] = {}
    columns = []
    for k, n in enumerate(x for x in names if x is not None):
        n = n.strip() or f"_c{k}"
        seen[n] = seen.get(n, 0) + 1
        columns.append(n if seen[n] == 1 else f"{n}{seen[n] - 1}")
    schema = ", ".join(f"`{c}` string" for c in [*columns, BROKEN])
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
            .option("columnPruning", False).option("columnNameOfCorruptRecord", BROKEN).csv(files))


def read_many(spark: SparkSession, paths: list[str], standardize=None) -> tuple[DataFrame, DataFrame]:
    """Read several files or folders, map each kind of header to the canonical columns (``standardize`` takes a
    frame and returns a frame; it must keep ``_file`` and ``_broken``), and union by name (missing columns NULL; a
    column that has different types is STRING).

    Files of one format and header are one scan, however many they are; a row keeps its file in ``source_file`` and,
    where it does not fit, its text in ``_corrupt_record``. Paths that do not exist and files without
    a byte are reported; Parquet files that cannot be read are skipped and reported with 0 rows. Returns (combined, per-file info with the
    number of broken rows and a total)."""
    failed = {p: why for p in paths if (why := _problem(spark, p))}
    kinds: dict[str, list[str]] = {}
    for p in paths:
        if p not in failed:
            kinds.setdefault(_format(p), []).append(p)
    frames = []
    if "csv" in kinds:
        frames += [_csv_group(spark, h, files) for h, files in header_groups(spark, kinds["csv"]).items()]
    if "json" in kinds:
        frames.append(spark.read.option("columnNameOfCorruptRecord", BROKEN).json(kinds["json"]))
    for p in kinds.get("parquet", []):      # a path is one table with one schema; its part files are one scan
        try:
            frames.append(spark.read.option("ignoreCorruptFiles", True).parquet(p))
        except AnalysisException:
            failed[p] = "no schema can be read"
    if not frames:
        raise ValueError("no readable input")
    parts = []
    for df in frames:
        broken = F.col(BROKEN) if BROKEN in df.columns else F.lit(None).cast("string")
        marked = df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_broken", broken).drop(BROKEN)
        if standardize is not None:
            marked = standardize(marked)
        parts.append(marked.withColumnsRenamed({"_file": "source_file", "_broken": BROKEN}))
    types: dict[str, set[str]] = {}
    for df in parts:
        for c, kind in df.dtypes:
            types.setdefault(c, set()).add(kind)
    mixed = [c for c, kinds in types.items() if len(kinds) > 1]      # a column of several types is text
    parts = [df.withColumns({c: F.col(f"`{c}`").cast("string") for c in mixed if c in df.columns}) for df in parts]
    combined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # counted in the aggregate of all columns: the text of broken rows alone cannot be queried on raw files
    info = multi_file_summary(combined).withColumnRenamed(f"nonnull_{BROKEN}", "broken_rows")
    listed = [p for fmt in kinds.values() for p in fmt]
    files = spark.read.format("binaryFile").load(listed).select(F.col("_metadata.file_path").alias("source_file"))
    silent = files.join(info.select("source_file"), "source_file", "left_anti").select(
        "source_file", F.lit(0).cast("long").alias("rows"), F.lit("no rows, or not readable").alias("error"))
    info = info.unionByName(silent, allowMissingColumns=True)
    if failed:
        bad = spark.createDataFrame(sorted(failed.items()), "source_file string, error string")
        info = info.unionByName(bad, allowMissingColumns=True)
    return combined, info


def multi_file_summary(df: DataFrame, file_col: str = "source_file") -> DataFrame:
    """Rows and non-null counts per file plus a grand total row (rollup)."""
    cols = [c for c in df.columns if c != file_col]
    return df.rollup(file_col).agg(F.count("*").alias("rows"),
                                   *[F.count(F.col(f"`{c}`")).alias(f"nonnull_{c}") for c in cols]) \
        .withColumn(file_col, F.coalesce(F.col(file_col), F.lit("TOTAL")))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: cleaned table as CSV with a header (dates as ISO text)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_report(tables: dict[str, DataFrame], out_dir: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One sub-folder per table (cleaned data, summaries)."""
    for name, t in tables.items():
        t.write.mode(mode).format(fmt).option("header", True).save(f"{out_dir}/{name}")


def processing_summary(metrics: DataFrame) -> DataFrame:
    """A one-row metrics frame as (Metric, Value) rows (unpivot)."""
    cols = metrics.columns
    return metrics.select(F.explode(F.array(*[F.struct(F.lit(c).alias("Metric"), F.col(f"`{c}`").cast("string")
                                                       .alias("Value")) for c in cols])).alias("m")).select("m.*")


def filter_date_range(df: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """Rows with start <= date <= end (pushed down to the scan / partition pruning)."""
    return df.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def preview(df: DataFrame, n: int = 3, max_len: int = 100, order_by: list[str] | None = None) -> DataFrame:
    """First n rows (by ``order_by`` when given), dates as ISO text, strings cut to
    ``max_len`` characters."""
    from pyspark.sql.types import DateType, StringType, TimestampNTZType, TimestampType
    src = df.orderBy(*order_by) if order_by else df
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, StringType):
            c = F.substring(c, 1, max_len)
        cols.append(c.alias(f.name))
    return src.limit(n).select(*cols)
