"""Text forms of a reference dictionary: contigs and holes, ALT names; and where records are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """n (from 0), value of a small text file's lines."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "value"))
    return whole.withColumn("value", F.rtrim(F.regexp_replace("value", "\r$", ""))).filter("value != ''")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """contig, note, offset, length, n_holes by the dictionary's text: a head line, then two lines a contig."""
    rows = _numbered(spark, path).filter("n > 0").withColumn("k", F.floor((F.col("n") - 1) / 2))
    both = rows.groupBy("k").agg(F.min_by("value", "n").alias("a"), F.max_by("value", "n").alias("b"))
    name, numbers = F.split("a", " ", 3), F.split(F.trim("b"), r"\s+")
    return both.select(name[1].alias("contig"), F.coalesce(F.get(name, F.lit(2)), F.lit("")).alias("note"), numbers[0].cast("long").alias("offset"), numbers[1].cast("int").alias("length"), numbers[2].cast("int").alias("n_holes"))


def read_holes(spark: SparkSession, path: str) -> DataFrame:
    """offset, length, base of the runs of ambiguous bases: a head line, then a line a run."""
    f = F.split(F.trim("value"), r"\s+")
    return _numbered(spark, path).filter("n > 0").select(f[0].cast("long").alias("offset"), f[1].cast("int").alias("length"), f[2].alias("base"))


def read_alternates(spark: SparkSession, path: str) -> DataFrame:
    """contig: the first column of each line that is no header and not blank."""
    return spark.read.text(path).filter((F.col("value") != "") & ~F.startswith("value", F.lit("@"))).select(F.split("value", "\t")[0].alias("contig"))


def write_records(lines: DataFrame, path: str) -> None:
    """Writes records (one string column) by the path's suffix: .gz or .bgz compressed, .parquet as a table, else plain text."""
    if path.endswith((".bam", ".cram")):
        raise ValueError("binary alignment files are not written; use .gz, .parquet or text")
    if path.endswith(".parquet"):
        lines.write.parquet(path)
    else:
        lines.write.option("compression", "gzip" if path.endswith((".gz", ".bgz")) else "none").text(path)


def write_json(report: DataFrame, path: str) -> None:
    """A report of few rows as JSON lines."""
    report.coalesce(1).write.json(path)
