"""Reads in batches of about a number of bases, and a file stream that aligns each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READS = T.StructType([T.StructField("read_id", T.LongType()), T.StructField("seq", T.StringType())])


def batch_ids(reads: DataFrame, bases: int, by: str = "file") -> DataFrame:
    """reads (file, ordinal, seq) with batch_id: a batch takes reads until it holds `bases`, the one that crosses included.

    Each file's lengths (8 bytes a read, no sequences) are folded in order, and only the places where batches begin are
    kept; files are independent.
    """
    sizes = reads.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.length("seq").alias("n")))).alias("r"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array(F.lit(0)).alias("begin"))

    def step(acc, x):
        full = acc["sum"] >= bases
        return F.struct((F.when(full, F.lit(0)).otherwise(acc["sum"]) + x["n"]).cast("long").alias("sum"), F.when(full, F.concat(acc["begin"], F.array(x["i"]))).otherwise(acc["begin"]).alias("begin"))

    placed = F.transform("r", lambda x, i: F.struct(x["n"].alias("n"), i.alias("i")))
    begins = sizes.select(by, "r", F.aggregate(placed, start, step)["begin"].alias("begin")).select(by, "r", "begin", F.posexplode("begin").alias("batch_id", "_a"))
    last = F.coalesce(F.get("begin", F.col("batch_id") + 1), F.size("r"))
    ids = begins.select(by, "batch_id", F.explode(F.slice("r", F.col("_a") + 1, last - F.col("_a"))).alias("x")).select(by, F.col("x.ordinal").alias("ordinal"), "batch_id")
    return reads.join(ids, [by, "ordinal"])


def stream_reads(spark: SparkSession, path: str, each: Callable[[DataFrame, int], None], checkpoint: str):
    """A file stream of Parquet reads; each(batch, id) sees every micro-batch once the checkpoint has it. Starts and returns the query."""
    source = spark.readStream.schema(READS).parquet(path)
    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
