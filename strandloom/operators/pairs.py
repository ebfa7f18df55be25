"""Paired ends: insert sizes by orientation, pairing by a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST = 10


def insert_stats(samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of samples (dir, size; by: more keys) for each direction: n, quartiles, mean and population deviation of inliers,
    the window for mapping, failed. Sizes are counted first, so ranks are taken over a histogram."""
    key = [*(by or []), "dir"]
    bins = samples.groupBy(*key, "size").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*key)
    bins = bins.withColumns({"_to": F.sum("c").over(w.orderBy("size")), "_n": F.sum("c").over(w)})
    rank: list[Column] = [F.floor(share * F.col("_n") + 0.499) for share in (0.25, 0.75)]
    q25, q75 = (F.min(F.when(F.col("_to") > r, F.col("size"))).over(w) for r in rank)
    bins = bins.withColumns({"p25": q25, "p75": q75})
    iqr = F.col("p75") - F.col("p25")
    low, high = F.greatest(F.lit(1), F.col("p25") - 2 * iqr), F.col("p75") + 2 * iqr
    inlier = F.col("size").between(low, high)
    total = F.sum(F.when(inlier, F.col("c")))
    mean = F.sum(F.when(inlier, F.col("c") * F.col("size"))) / total
    g = bins.groupBy(*key).agg(F.max("_n").alias("n"), F.max("p25").alias("p25"), F.max("p75").alias("p75"), mean.alias("mean"), (F.sum(F.when(inlier, F.col("c") * F.col("size") * F.col("size"))) / total).alias("_sq"))
    g = g.withColumn("std", F.sqrt(F.greatest(F.col("_sq") - F.col("mean") * F.col("mean"), F.lit(0.0))))
    iqr = F.col("p75") - F.col("p25")
    g = g.withColumns({
        "low": F.greatest(F.lit(1), F.least(F.col("p25") - 3 * iqr, F.floor(F.col("mean") - 4 * F.col("std") + 0.499))).cast("long"),
        "high": F.greatest(F.col("p75") + 3 * iqr, F.floor(F.col("mean") + 4 * F.col("std") + 0.499)).cast("long"),
    })
    most = F.max("n").over(Window.partitionBy(*(by or [F.lit(0)])))
    return g.withColumn("failed", (F.col("n") < LEAST) | (F.col("n") < 0.05 * most)).drop("_sq")


def range_pairs(first: DataFrame, second: DataFrame, low: int, high: int) -> DataFrame:
    """Regions of mate 1 and mate 2 (pair_id, contig, strand, pos, score) on opposite strands whose distance is in range."""
    a = first.select("pair_id", "contig", F.col("strand").alias("s1"), F.col("pos").alias("p1"), F.col("score").alias("c1"))
    b = second.select("pair_id", "contig", F.col("strand").alias("s2"), F.col("pos").alias("p2"), F.col("score").alias("c2"))
    return a.join(b, ["pair_id", "contig"]).filter((F.col("s1") != F.col("s2")) & F.abs(F.col("p2") - F.col("p1")).between(low, high)).withColumn("score", F.col("c1") + F.col("c2"))


def best_pairs(pairs: DataFrame, near: int) -> DataFrame:
    """pair_id, best, second (0 if none), n_sub: other pairs within near of the second."""
    order = [F.desc("score"), "contig", "p1", "p2"]
    w = Window.partitionBy("pair_id")
    df = pairs.withColumns({"_r": F.row_number().over(w.orderBy(*order)), "_second": F.max(F.col("score")).over(w)})
    df = df.withColumn("_second", F.max(F.when(F.col("_r") == 2, F.col("score"))).over(w))
    return df.groupBy("pair_id").agg(F.max("score").alias("best"), F.coalesce(F.max("_second"), F.lit(0)).alias("second"), F.count_if((F.col("_r") > 2) & (F.col("_second") - F.col("score") <= near)).alias("n_sub"))
