"""Contigs and reads derived from the driver's tables: the same rows in Spark and in SQL.

part gives the reference: 32 bases for each row by md5, in five contigs, with repeated units (p_size a multiple of 5) and
runs of N. orders gives the reads: 100 bases at a place with known strand, with a substitution or a deletion in a third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import revcomp
from strandloom.operators.cutting import pieces

#: Reads are cut from pieces of this many bases (and a read's length more); a substring walks from the begin of its piece.
PIECE = 512

CONTIGS, READ, HEX, BASES = 5, 100, "0123456789abcdef", "ACGTACGTACGTACGT"

REF_SQL = f"""ref AS (SELECT 'ctg' || (p_partkey % {CONTIGS}) AS contig, string_agg(CASE WHEN p_partkey % 97 = 0 THEN repeat('N', 32)
  ELSE translate(md5('ref-' || CAST(CASE WHEN p_size % 5 = 0 THEN p_partkey % 40 ELSE p_partkey END AS VARCHAR)), '{HEX}', '{BASES}') END, '' ORDER BY p_partkey) AS seq
  FROM part GROUP BY 1)"""
READS_SQL = f"""placed AS (SELECT o_orderkey, contig, (o_orderkey * 7919) % (length(seq) - 400) AS pos, o_custkey % 60 AS gap, seq FROM orders JOIN ref ON contig = 'ctg' || (o_custkey % {CONTIGS})),
cut AS (SELECT *, substr(seq, CAST(pos AS INT) + 1, 101) AS s FROM placed),
edited AS (SELECT *, CASE o_orderkey % 6 WHEN 1 THEN substr(s, 1, 50) || translate(substr(s, 51, 1), 'ACGT', 'CGTA') || substr(s, 52, 49)
  WHEN 2 THEN substr(s, 1, 70) || substr(s, 72, 30) ELSE substr(s, 1, 100) END AS e FROM cut),
reads AS (SELECT o_orderkey AS read_id, CASE WHEN o_orderkey % 2 = 1 THEN translate(reverse(e), 'ACGT', 'TGCA') ELSE e END AS seq,
  contig AS truth_contig, CAST(o_orderkey % 2 AS INT) AS truth_strand, pos AS truth_pos FROM edited)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession) -> int:
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("p_partkey") % 97 == 0, F.repeat(F.lit("N"), 32)).otherwise(
        F.translate(F.md5(F.concat(F.lit("ref-"), F.when(F.col("p_size") % 5 == 0, F.col("p_partkey") % 40).otherwise(F.col("p_partkey")).cast("string")).cast("binary")), HEX, BASES)
    )
    # Few rows of a small file are much text, so they are dealt to all tasks first.
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(_parts(spark)).select(F.concat(F.lit("ctg"), (F.col("p_partkey") % CONTIGS).cast("string")).alias("contig"), F.struct("p_partkey", unit.alias("s")).alias("u"))
    return rows.groupBy("contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list("u")), lambda u: u["s"]), "").alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = contigs(spark, sf_dir)
    cut = pieces(ref, ["contig"], PIECE, 0, READ + 1).select("contig", (F.col("start") / PIECE).cast("long").alias("block"), "piece")
    placed = table(spark, sf_dir, "orders").withColumn("contig", F.concat(F.lit("ctg"), (F.col("o_custkey") % CONTIGS).cast("string"))).join(F.broadcast(ref.select("contig", F.length("seq").alias("length"))), "contig")
    # All pieces are as large as the reference, so they are never sent to every task. Few bytes of orders become many bases, so tasks aren't joined by their bytes.
    placed = placed.withColumn("pos", F.col("o_orderkey") * 7919 % (F.col("length") - 400)).withColumn("block", F.floor(F.col("pos") / PIECE)).select("o_orderkey", "o_custkey", "contig", "pos", "block").repartition(_parts(spark), "contig", "block").join(cut.hint("merge"), ["contig", "block"])
    s = F.substring(F.col("piece"), (F.col("pos") % PIECE).cast("int") + 1, F.lit(101))
    cut = placed.select("o_orderkey", "contig", "pos", s.alias("s"))
    sub = lambda a, n: F.substring(F.col("s"), a, n)
    e = F.when(F.col("o_orderkey") % 6 == 1, F.concat(sub(1, 50), F.translate(sub(51, 1), "ACGT", "CGTA"), sub(52, 49))).when(F.col("o_orderkey") % 6 == 2, F.concat(sub(1, 70), sub(72, 30))).otherwise(sub(1, 100))
    seq = F.when(F.col("o_orderkey") % 2 == 1, revcomp(e)).otherwise(e)
    return cut.select(F.col("o_orderkey").alias("read_id"), seq.alias("seq"), F.col("contig").alias("truth_contig"), (F.col("o_orderkey") % 2).cast("int").alias("truth_strand"), F.col("pos").alias("truth_pos"))
