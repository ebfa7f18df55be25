"""Interval analytics: unions, coverage, lookups, runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_length(df: DataFrame, by: Sequence[str], beg: str, end: str) -> DataFrame:
    """by, covered: bases that a group's intervals cover together."""
    w = Window.partitionBy(*by).orderBy(beg, end).rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(beg), F.coalesce(F.max(end).over(w), F.col(beg))))
    return df.withColumn("_fresh", fresh).groupBy(*by).agg(F.sum("_fresh").alias("covered"))


def chain_weight(seeds: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, weight: the smaller of the lengths covered on query (qbeg, qend) and reference (rbeg, rend)."""
    q = union_length(seeds, by, "qbeg", "qend").withColumnRenamed("covered", "_q")
    r = union_length(seeds, by, "rbeg", "rend").withColumnRenamed("covered", "_r")
    return q.join(r, list(by)).select(*by, F.least("_q", "_r", F.lit((1 << 30) - 1)).alias("weight"))


def repeat_fraction(intervals: DataFrame, max_occ: int) -> DataFrame:
    """read_id, frac_rep: share of the read (column length) under intervals with more than max_occ places (column n)."""
    many = union_length(intervals.filter(F.col("n") > max_occ), ["read_id"], "qbeg", "qend")
    reads = intervals.groupBy("read_id").agg(F.max("length").alias("length"))
    return reads.join(many, "read_id", "left").select("read_id", (F.coalesce("covered", F.lit(0)) / F.col("length")).cast("float").alias("frac_rep"))


def seed_coverage(regions: DataFrame, seeds: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each region (region_id, qb, qe, rb, re) with the summed lengths of seeds inside it on both axes."""
    j = regions.join(seeds, list(on), "left")
    inside = (F.col("qbeg") >= F.col("qb")) & (F.col("qend") <= F.col("qe")) & (F.col("rbeg") >= F.col("rb")) & (F.col("rend") <= F.col("re"))
    return j.groupBy(*on, "region_id").agg(F.coalesce(F.sum(F.when(inside, F.col("qend") - F.col("qbeg"))), F.lit(0)).cast("long").alias("seedcov"))


def contig_of(positions: DataFrame, contigs: DataFrame, pos: str = "pos") -> DataFrame:
    """Position in the concatenated text to contig and offset in it. contigs: contig, offset, length, few: a dictionary.

    A window over the union of both, in the order of position, carries the last contig's start; positions are dealt by
    bins, and each bin is given the contig that its first base lies in, so no task sees all rows.
    """
    size = 1 << 16
    spans = contigs.select("contig", "offset", "length", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.greatest(F.col("length"), F.lit(1)) - 1) / size))).alias("_bin"))
    df = positions.withColumn("_bin", F.floor(F.col(pos) / size)).join(spans, "_bin", "left")
    inside = (F.col(pos) >= F.col("offset")) & (F.col(pos) < F.col("offset") + F.col("length"))
    return df.filter(inside).select(*positions.columns, "contig", (F.col(pos) - F.col("offset")).alias("contig_pos"))


def runs(bases: DataFrame, by: Sequence[str], at: str, value: str) -> DataFrame:
    """by, value, beg, n: runs of equal values at consecutive places."""
    w = Window.partitionBy(*by, value).orderBy(at)
    return bases.withColumn("_g", F.col(at) - F.row_number().over(w)).groupBy(*by, value, "_g").agg(F.min(at).alias("beg"), F.count(F.lit(1)).alias("n")).drop("_g")


def contig_stats(ref: DataFrame) -> DataFrame:
    """contig, length, n_ambs (bases that are none of ACGT), n_holes (their runs)."""
    bad = ref.select("contig", F.length("seq").alias("length"), F.explode_outer(F.split(F.regexp_replace("seq", "([^ACGTacgt])(?!\\1)", "$1\x00"), "\x00")).alias("p"))
    tail = F.regexp_extract("p", "[^ACGTacgt]+$", 0)
    return bad.groupBy("contig").agg(F.max("length").cast("long").alias("length"), F.sum(F.length(tail)).cast("long").alias("n_ambs"), F.sum((tail != "").cast("long")).alias("n_holes"))


def base_histogram(texts: DataFrame) -> DataFrame:
    """base, n of column seq."""
    n = [F.sum(F.length("seq") - F.length(F.regexp_replace("seq", b, ""))).alias(b) for b in "ACGTN"]
    return texts.agg(*n).select(F.explode(F.array(*(F.struct(F.lit(b).alias("base"), F.coalesce(F.col(b), F.lit(0)).cast("long").alias("n")) for b in "ACGTN"))).alias("x")).select("x.*")


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
