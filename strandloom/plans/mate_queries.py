"""Registered queries of the mate and record operators, and their SQL. Regions are derived from lineitem by one rule in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators import mates
from strandloom.plans.fixture import table

LENGTH = 10_000
#: Directions' windows: low, high, failed.
WINDOWS = ((10, 200, False), (100, 700, False), (50, 300, True), (20, 400, False))


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))


def regions(s: SparkSession, d: str) -> DataFrame:
    p, x = F.col("p"), F.col("s")
    df = _lines(s, d).select(F.col("l_orderkey").alias("pair_id"), (F.col("l_linenumber") % 2).cast("int").alias("mate"), F.col("l_linenumber").cast("long").alias("region_id"), (30 + p % 70).cast("int").alias("score"), (p % 60).cast("int").alias("qb"), (p % 60 + 20 + x % 40).cast("int").alias("qe"), ((p * 131 + x * 7) % 20_000).alias("rb"), (p % 11 == 0).alias("is_alt"), (p * 31 % 1000 - 500).alias("hash"))
    forward = F.when(F.col("rb") >= LENGTH, 2 * LENGTH - 1 - F.col("rb")).otherwise(F.col("rb"))
    return mates.rank_regions(df.withColumn("contig", F.when(forward < 6000, "a").otherwise("b")))


_LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL)"
REGIONS = f"""r0 AS (SELECT l_orderkey AS pair_id, CAST(l_linenumber % 2 AS INT) AS mate, CAST(l_linenumber AS BIGINT) AS region_id, CAST(30 + p % 70 AS INT) AS score, CAST(p % 60 AS INT) AS qb,
  CAST(p % 60 + 20 + s % 40 AS INT) AS qe, (p * 131 + s * 7) % 20000 AS rb, p % 11 = 0 AS is_alt, p * 31 % 1000 - 500 AS hash FROM {_LINES}),
r AS (SELECT *, CASE WHEN CASE WHEN rb >= 10000 THEN 19999 - rb ELSE rb END < 6000 THEN 'a' ELSE 'b' END AS contig,
  row_number() OVER (PARTITION BY pair_id, mate ORDER BY score DESC, is_alt, hash < 0, hash, region_id) AS rank FROM r0),
cs AS (SELECT a.*, coalesce((SELECT arg_min(b.score, b.rank) FROM r b WHERE b.pair_id = a.pair_id AND b.mate = a.mate AND b.rank > 1 AND least(a.qe, b.qe) > greatest(a.qb, b.qb)
  AND CAST(least(a.qe, b.qe) - greatest(a.qb, b.qb) AS FLOAT) >= CAST(least(a.qe - a.qb, b.qe - b.qb) AS FLOAT) * CAST(0.5 AS FLOAT)), 19) AS csub FROM r a WHERE rank = 1),
anchor AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY pair_id, mate) AS best FROM r) WHERE score >= best - 17 AND rank <= 50)"""


def _dir(a: str, b: str) -> tuple[str, str]:
    """Direction and distance of two places in the text of both strands."""
    same = f"({a} >= 10000) = ({b} >= 10000)"
    p2 = f"CASE WHEN {same} THEN {b} ELSE 19999 - {b} END"
    return f"xor(CASE WHEN {same} THEN 0 ELSE 1 END, CASE WHEN {p2} > {a} THEN 0 ELSE 3 END)", f"abs({p2} - {a})"


def _windows(s: SparkSession, d: str) -> DataFrame:
    r = regions(s, d)
    stats = s.createDataFrame([(k, *x) for k, x in enumerate(WINDOWS)], "dir int, low int, high int, failed boolean")
    contigs = s.createDataFrame([("a", 0, 6000), ("b", 6000, 4000)], "contig string, offset long, length long")
    return mates.rescue_windows(mates.anchors(r), r, stats, contigs, LENGTH, F.lit(100)).drop("contig")


def _records(s: SparkSession, d: str) -> DataFrame:
    p, x = F.col("p"), F.col("s")
    record = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    cigar = F.array(F.struct(F.lit("M").alias("op"), (p % 90 + 10).cast("int").alias("len")))
    return _lines(s, d).select(F.col("l_orderkey").alias("read_id"), record.alias("record"), F.when(p % 5 == 0, 0x100).otherwise(0).alias("flag"), F.concat(F.lit("ctg"), (x % 5).cast("string")).alias("contig"), (p * 37 % 10_000).alias("pos"), (p % 2 == 1).alias("is_rev"), cigar.alias("cigar"), (x % 61).cast("int").alias("mapq"), (p % 7).cast("int").alias("nm"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    p, x = F.col("p"), F.col("s")
    df = _lines(s, d).filter("l_linenumber <= 2")
    return df.select(F.col("l_orderkey").alias("pair_id"), (F.col("l_linenumber") - 1).cast("int").alias("mate"), F.concat(F.lit("ctg"), (x % 2).cast("string")).alias("contig"), (p * 37 % 10_000).alias("pos"), (p * 37 % 10_000 + 50 + x % 50).alias("end"), (p % 2 == 1).alias("is_rev"), (p % 9 != 0).alias("mapped"))


def _secondaries(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").cast("long").alias("region_id"), F.when(F.col("l_linenumber") > 1, F.lit(1).cast("long")).alias("primary"), (30 + F.col("p") % 70).cast("int").alias("score"), (F.col("p") % 11 == 0).alias("is_alt"))


def _sets(s: SparkSession, d: str, shift: int) -> DataFrame:
    o = table(s, d, "orders").filter(F.col("o_orderkey") % 11 != shift)
    return o.select(F.concat(F.lit("r"), (F.col("o_orderkey") / 2).cast("long").cast("string")).alias("qname"), (F.col("o_custkey") % 3).alias("flag"), (F.col("o_orderkey") * 7919 % 1000 + F.when(F.col("o_orderkey") % 7 == 0, shift).otherwise(0)).alias("pos"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    lines = lambda s, d: table(s, d, "lineitem")
    return {
        "region_rank": lambda s, d: regions(s, d).select("pair_id", "mate", "region_id", "rank"),
        "competitor_score": lambda s, d: mates.competitors(regions(s, d)).select("pair_id", "mate", "region_id", "csub"),
        "unique_pair_samples": lambda s, d: mates.insert_samples(regions(s, d), LENGTH),
        "rescued_union": lambda s, d: mates.with_rescued((r := regions(s, d)).filter("region_id % 3 <> 0"), r.filter("region_id % 3 = 0").withColumn("rank", F.col("region_id").cast("int"))).select("pair_id", "mate", "region_id", "rank"),
        "rescue_anchors": lambda s, d: mates.anchors(regions(s, d)).select("pair_id", "mate", "region_id", "score"),
        "rescue_windows": _windows,
        "supplementary_tags": lambda s, d: mates.supplementary_tags(_records(s, d)).select("read_id", "record", "sa"),
        "mate_fields": lambda s, d: mates.mate_fields(_pairs(s, d)).select("pair_id", "mate", "rnext", "pnext", "tlen"),
        "secondary_filter": lambda s, d: mates.kept_secondaries(_secondaries(s, d), every=True).select("read_id", "region_id", "score"),
        "record_diff": lambda s, d: mates.record_diff(_sets(s, d, 3), _sets(s, d, 4)),
        "id_shift": lambda s, d: table(s, d, "orders").select("o_orderkey", mates.id_shift(F.col("o_orderkey") * 5_000_011 % 16_777_216).alias("shifted")),
        "raw_mapq": lambda s, d: lines(s, d).select("l_orderkey", "l_linenumber", mates.raw_mapq(F.col("l_partkey") % 50, 1).alias("mapq")),
        "alt_share": lambda s, d: lines(s, d).select("l_orderkey", "l_linenumber", mates.alt_share((F.col("l_partkey") % 90 + 10).cast("int"), F.lit(128)).alias("pa")),
        "rescue_accepted": lambda s, d: regions(s, d).filter(mates.rescue_accepted(F.col("score") - 40, F.col("qb") - 5)).select("pair_id", "region_id"),
        "ignore_alt": lambda s, d: mates.ignore_alt(table(s, d, "supplier").select(F.concat(F.lit("ctg"), F.col("s_suppkey").cast("string")).alias("contig"), (F.col("s_suppkey") % 3 == 0).alias("is_alt"))),
        "pair_scores": lambda s, d: mates.pair_scores(lines(s, d).select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 100).cast("int").alias("score1"), (F.col("l_suppkey") % 100).cast("int").alias("score2"), (F.col("l_partkey") % 700).alias("dist"), F.lit(350.0).alias("mean"), F.lit(40.0).alias("std"))).select("l_orderkey", "l_linenumber", "score"),
    }


def oracle_sql() -> dict[str, str]:
    direction, size = _dir("a.rb", "b.rb")
    d2, size2 = _dir("a.rb", "m.rb")
    stats = ", ".join(f"({k}, {low}, {high})" for k, (low, high, failed) in enumerate(WINDOWS) if not failed)
    pos, flag = "p * 37 % 10000", "CASE WHEN p % 5 = 0 THEN 256 ELSE 0 END"
    sets = lambda n, k: f"{n} AS (SELECT 'r' || (o_orderkey // 2) AS qname, o_custkey % 3 AS flag, o_orderkey * 7919 % 1000 + CASE WHEN o_orderkey % 7 = 0 THEN {k} ELSE 0 END AS pos FROM orders WHERE o_orderkey % 11 <> {k})"
    return {
        "region_rank": f"WITH {REGIONS} SELECT pair_id, mate, region_id, CAST(rank AS INT) AS rank FROM r",
        "competitor_score": f"WITH {REGIONS} SELECT pair_id, mate, region_id, csub FROM cs",
        "unique_pair_samples": f"""WITH {REGIONS}, u AS (SELECT * FROM cs WHERE csub <= 0.8::DOUBLE * score),
x AS (SELECT a.pair_id, {direction} AS dir, {size} AS size FROM u a JOIN u b ON a.pair_id = b.pair_id AND a.mate = 0 AND b.mate = 1 AND a.contig = b.contig) SELECT * FROM x WHERE size > 0 AND size <= 10000""",
        "rescued_union": f"WITH {REGIONS} SELECT pair_id, mate, region_id, CAST(row_number() OVER (PARTITION BY pair_id, mate ORDER BY score DESC, region_id % 3 = 0, CASE WHEN region_id % 3 = 0 THEN region_id ELSE rank END) AS INT) AS rank FROM r",
        "rescue_anchors": f"WITH {REGIONS} SELECT pair_id, mate, region_id, score FROM anchor",
        "rescue_windows": f"""WITH {REGIONS}, st AS (SELECT * FROM (VALUES {stats}) t(dir, low, high)),
w AS (SELECT a.*, dir, dir IN (1, 2) AS reverse, greatest(0, CASE WHEN dir < 2 THEN rb + low ELSE rb - high END - CASE WHEN dir IN (1, 2) THEN 100 ELSE 0 END) AS b0,
  least(20000, CASE WHEN dir < 2 THEN rb + high ELSE rb - low END + CASE WHEN dir IN (1, 2) THEN 0 ELSE 100 END) AS e0 FROM anchor a, st
  WHERE NOT EXISTS (SELECT 1 FROM r m WHERE m.pair_id = a.pair_id AND m.mate = 1 - a.mate AND {d2} = dir AND {size2} BETWEEN low AND high)),
c AS (SELECT *, (b0 + e0) // 2 >= 10000 AS rv, CASE WHEN CASE WHEN (b0 + e0) // 2 >= 10000 THEN 19999 - (b0 + e0) // 2 ELSE (b0 + e0) // 2 END < 6000 THEN 'a' ELSE 'b' END AS held FROM w WHERE b0 < e0),
k AS (SELECT *, greatest(b0, CASE WHEN held = 'a' THEN CASE WHEN rv THEN 14000 ELSE 0 END ELSE CASE WHEN rv THEN 10000 ELSE 6000 END END) AS beg, least(e0, CASE WHEN held = 'a' THEN CASE WHEN rv THEN 20000 ELSE 6000 END ELSE CASE WHEN rv THEN 14000 ELSE 10000 END END) AS "end" FROM c)
SELECT pair_id, mate, region_id, dir, reverse, beg, "end" FROM k WHERE held = contig AND "end" - beg >= 19""",
        "supplementary_tags": f"""WITH x AS (SELECT l_orderkey AS read_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS record, {flag} AS flag,
  'ctg' || (s % 5) || ',' || ({pos} + 1) || ',' || CASE WHEN p % 2 = 1 THEN '-' ELSE '+' END || ',' || (p % 90 + 10) || 'M,' || (s % 61) || ',' || (p % 7) || ';' AS e FROM {_LINES})
SELECT a.read_id, CAST(a.record AS INT) AS record, CASE WHEN a.flag = 0 THEN string_agg(b.e, '' ORDER BY b.record) END AS sa FROM x a LEFT JOIN x b ON b.read_id = a.read_id AND b.record <> a.record AND b.flag = 0 GROUP BY a.read_id, a.record, a.flag""",
        "mate_fields": f"""WITH x AS (SELECT l_orderkey AS pair_id, CAST(l_linenumber - 1 AS INT) AS mate, 'ctg' || (s % 2) AS contig, {pos} AS pos, CASE WHEN p % 2 = 1 THEN {pos} + 49 + s % 50 ELSE {pos} END AS five, p % 9 <> 0 AS mapped FROM {_LINES} WHERE l_linenumber <= 2)
SELECT a.pair_id, a.mate, CASE WHEN NOT coalesce(b.mapped, false) THEN '*' WHEN a.contig = b.contig THEN '=' ELSE b.contig END AS rnext, CASE WHEN coalesce(b.mapped, false) THEN b.pos + 1 ELSE 0 END AS pnext,
CAST(CASE WHEN a.mapped AND coalesce(b.mapped, false) AND a.contig = b.contig THEN -(a.five - b.five + sign(a.five - b.five)) ELSE 0 END AS BIGINT) AS tlen FROM x a LEFT JOIN x b ON b.pair_id = a.pair_id AND b.mate = 1 - a.mate""",
        "secondary_filter": f"""WITH x AS (SELECT l_orderkey AS read_id, CAST(l_linenumber AS BIGINT) AS region_id, CAST(30 + p % 70 AS INT) AS score, p % 11 = 0 AS is_alt FROM {_LINES})
SELECT read_id, region_id, score FROM x a WHERE region_id = 1 OR NOT is_alt AND CAST(score AS FLOAT) >= (SELECT CAST(score AS FLOAT) * CAST(0.5 AS FLOAT) FROM x b WHERE b.read_id = a.read_id AND b.region_id = 1)""",
        "record_diff": f"WITH {sets('a', 3)}, {sets('b', 4)} SELECT *, 'expected' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'ours' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
        "id_shift": "WITH x AS (SELECT o_orderkey, o_orderkey * 5000011 % 16777216 * 256 AS v FROM orders) SELECT o_orderkey, CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END AS shifted FROM x",
        "raw_mapq": "SELECT l_orderkey, l_linenumber, CAST(trunc(6.02::DOUBLE * (l_partkey % 50) + 0.499::DOUBLE) AS INT) AS mapq FROM lineitem",
        "alt_share": "SELECT l_orderkey, l_linenumber, printf('%.3f', round_even((l_partkey % 90 + 10)::DOUBLE / 128 * 1000, 0) / 1000) AS pa FROM lineitem",
        "rescue_accepted": f"WITH {REGIONS} SELECT pair_id, region_id FROM r WHERE score - 40 >= 19 AND qb - 5 >= 0",
        "ignore_alt": "SELECT 'ctg' || s_suppkey AS contig, false AS is_alt FROM supplier",
    }
