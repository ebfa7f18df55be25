"""FASTA and FASTQ text to DataFrames, and SAM text.

Lines are read with their place in the file, and records are put together by arithmetic on line numbers (FASTQ has four
lines a record) or by windows inside a file (FASTA), never by a split on a character that may also be a quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import comment, read_name


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (line number from 0), value. A line's number is its place among its file's bytes, counted a block at a time."""
    df = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    return df.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("block", "id")) - 1).select("file", "n", "value")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, name, seq, qual, comment. Compressed files are read by their suffix."""
    df = _lines(spark, path).filter((F.col("value") != "") | (F.col("n") % 4 != 0))
    parts = [F.max(F.when(F.col("n") % 4 == k, F.col("value"))).alias(f"_{k}") for k in range(4)]
    df = df.groupBy("file", F.floor(F.col("n") / 4).alias("ordinal")).agg(*parts)
    bad = ~F.startswith("_0", F.lit("@")) | ~F.startswith("_2", F.lit("+")) | (F.length("_1") != F.length("_3"))
    head = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.coalesce("_0", F.lit(""))))).otherwise(F.substring(F.col("_0"), F.lit(2), F.length("_0")))
    return df.select("file", "ordinal", read_name(head).alias("name"), F.col("_1").alias("seq"), F.col("_3").alias("qual"), comment(head).alias("comment"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal, name, comment, seq; text before the first header is ignored."""
    df = _lines(spark, path)
    w = Window.partitionBy("file").orderBy("n")
    df = df.withColumn("ordinal", F.sum(F.startswith("value", F.lit(">")).cast("int")).over(w) - 1).filter("ordinal >= 0")
    head = F.max(F.when(F.startswith("value", F.lit(">")), F.substring("value", 2, 1 << 20)))
    body = F.collect_list(F.when(~F.startswith("value", F.lit(">")), F.struct("n", F.regexp_replace("value", r"\s", "").alias("s"))))
    df = df.groupBy("file", "ordinal").agg(head.alias("_h"), body.alias("_b"))
    return df.select("file", "ordinal", F.regexp_extract("_h", r"^([^ \t]*)", 1).alias("name"), F.nullif(F.regexp_extract("_h", r"^[^ \t]*[ \t]+(.*)$", 1), F.lit("")).alias("comment"), F.array_join(F.transform(F.array_sort("_b"), lambda x: x["s"]), "").alias("seq"))


def pair_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """pair_id, mate, name, seq, qual, comment of two single-file reads in lockstep; an error if one is longer."""
    a, b = (df.select(F.col("ordinal").alias("pair_id"), F.struct("name", "seq", "qual", "comment").alias(n)) for df, n in ((first, "a"), (second, "b")))
    j = a.join(b, "pair_id", "full_outer")
    whole = F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("paired FASTQ files differ in length")).cast("bigint")).otherwise(F.col("pair_id"))
    return j.select(whole.alias("pair_id"), F.posexplode(F.array("a", "b")).alias("mate", "r")).select("pair_id", "mate", "r.*")


def pair_interleaved(reads: DataFrame) -> DataFrame:
    """pair_id, mate, name, seq, qual, comment of one file whose mates follow each other; an error if names differ or one is left."""
    df = reads.withColumns({"pair_id": F.floor(F.col("ordinal") / 2), "mate": (F.col("ordinal") % 2).cast("int")})
    w = Window.partitionBy("pair_id")
    bad = (F.count(F.lit(1)).over(w) != 2) | (F.min("name").over(w) != F.max("name").over(w))
    return df.withColumn("pair_id", F.when(bad, F.raise_error(F.lit("interleaved mates do not match")).cast("bigint")).otherwise(F.col("pair_id"))).select("pair_id", "mate", "name", "seq", "qual", "comment")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """ordinal, qname, flag, rname, pos, mapq, cigar of record lines."""
    df = _lines(spark, path).filter((F.col("value") != "") & ~F.startswith("value", F.lit("@"))).withColumn("_f", F.split("value", "\t"))
    return df.select(F.col("n").alias("ordinal"), F.col("_f")[0].alias("qname"), F.col("_f")[1].cast("int").alias("flag"), F.col("_f")[2].alias("rname"), F.col("_f")[3].cast("long").alias("pos"), F.col("_f")[4].cast("int").alias("mapq"), F.col("_f")[5].alias("cigar"))


def sam_header(contigs: DataFrame, user: str = "", program: str = "@PG\tID:strandloom\tPN:strandloom") -> str:
    """Header text: a dictionary of contigs (name, length, is_alt; few), the user's lines, the program."""
    rows = [] if "@SQ" in user else contigs.select("name", "length", "is_alt").collect()
    lines = [f"@SQ\tSN:{r['name']}\tLN:{r['length']}" + "\tAH:*" * bool(r["is_alt"]) for r in rows]
    return "\n".join([*lines, *([user] if user else []), program]) + "\n"
