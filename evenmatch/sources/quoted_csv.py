"""CSV with line breaks inside quoted fields, read in parallel within a file.

A CSV reader that allows line breaks in fields must read a file from its start, in one task. Here the
lines of all byte ranges are read at once. Whether a line begins a record depends only on the number
of quotes before it: each range counts its own, the counts of the ranges before it in the file (one
small row per range) give its starting parity, and inside a range the parity runs on from line to
line. Lines that begin a record and close all quotes are records by themselves; only the lines of the
others are brought together. Records then go through Spark's own CSV parser.

Quotes inside quoted fields are doubled (``escape`` is the quote), so they do not change the parity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

QUOTING = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST"}
RANGE = ["file", "block"]


def _lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """file, block (start of the byte range), line (rising within the range), value, odd (an odd number of quotes)."""
    raw = spark.read.options(lineSep="\n", **options).text(path)
    n_quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value",
        (n_quotes % 2).alias("odd"))


def quoted_records(spark: SparkSession, path: str, header: bool = True, **options) -> DataFrame:
    """(file, block, line, record): every record as text with its place; places order the records of a file.

    Blank lines between records are left out, and so is the first record of each file where it is the
    header. ``options`` go to the text reader (such as ``pathGlobFilter``).
    """
    lines = _lines(spark, path, **options)
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    ranges = lines.groupBy(*RANGE).agg(F.sum("odd").alias("_odd"), F.min("line").alias("_first"))
    ranges = ranges.select(*RANGE, "_first", (F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2).alias("_open"))
    running = W.partitionBy(*RANGE).orderBy("line")
    inside = F.coalesce(F.sum("odd").over(running.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    d = lines.join(ranges, RANGE).withColumn("begins", (F.col("_open") + inside) % 2 == 0).withColumn("line", F.col("line") - F.col("_first")).drop("_open", "_first")

    single = d.where("begins AND odd = 0").select(*RANGE, "line", "value")
    rest = d.where("NOT (begins AND odd = 0)")
    # an open line that begins no record in its own range continues the last one that an earlier range began
    place = F.struct("block", "line")
    own = F.max(F.when(F.col("begins"), place)).over(running.rowsBetween(W.unboundedPreceding, 0))
    last = d.groupBy(*RANGE).agg(F.max(F.when(F.col("begins"), place)).alias("_last"))
    last = last.select(*RANGE, F.max("_last").over(before).alias("_earlier"))
    owned = rest.withColumn("_own", own).join(last, RANGE).select("file", F.coalesce("_own", "_earlier").alias("_at"), "block", "line", "value")
    several = owned.groupBy("file", "_at").agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("_l")).select(
        "file", "_at.block", "_at.line", F.array_join("_l.value", "\n").alias("value"))
    out = single.unionByName(several).withColumn("record", F.regexp_replace("value", "\r$", "")).where(F.length("record") > 0)
    if header:
        out = out.where("NOT (block = 0 AND line = 0)")
    return out.select(*RANGE, "line", "record")


def parsed(record: Column, columns: list[str], **options) -> Column:
    """A record's fields as a struct of strings."""
    return F.from_csv(record, ", ".join(f"`{c}` string" for c in columns), QUOTING | options)


def header_of(spark: SparkSession, path: str, **options) -> list[str]:
    """Column names in the first line of the first file."""
    return spark.read.options(header=True, **{**QUOTING, **options}).csv(path).limit(0).columns
