"""Mates: rank of regions, uniqueness, anchors, rescue windows, pair scores, mate fields, tags.

Regions are rows of pair_id, mate (0 or 1), region_id, score, qb, qe, rb (in the text of both strands), contig, is_alt,
hash. Every window and join carries the pair, so a pair's regions meet in one task and nothing else does.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.sequence import cigar_text, mate_orientation, revcomp, template_length
from strandloom.operators.extension import slices
from strandloom.operators.lanes import local_many
from strandloom.options import Options

MIN_RATIO = 0.8


def rank_regions(regions: DataFrame) -> DataFrame:
    """regions with rank (from 1): higher scores first, then those not on an ALT contig, then by hash as an unsigned number."""
    w = Window.partitionBy("pair_id", "mate").orderBy(F.desc("score"), "is_alt", F.col("hash") < 0, "hash", "region_id")
    return regions.withColumn("rank", F.row_number().over(w))


def competitors(ranked: DataFrame, o: Options = Options()) -> DataFrame:
    """First regions with csub: the score of the best later region on the same part of the read, or that of a lone seed."""
    w = Window.partitionBy("pair_id", "mate")
    qb, qe = (F.max(F.when(F.col("rank") == 1, F.col(c))).over(w) for c in ("qb", "qe"))
    df = ranked.withColumns({"_b": F.greatest("qb", qb), "_e": F.least("qe", qe), "_short": F.least(F.col("qe") - F.col("qb"), qe - qb)})
    rival = (F.col("rank") > 1) & (F.col("_e") > F.col("_b")) & ((F.col("_e") - F.col("_b")).cast("float") >= F.col("_short").cast("float") * F.lit(o.mask_level).cast("float"))
    df = df.withColumn("_first", F.min(F.when(rival, F.struct("rank", "score"))).over(w)).filter("rank = 1")
    return df.select(*ranked.columns, F.coalesce("_first.score", F.lit(o.min_seed * o.match)).alias("csub"))


def insert_samples(ranked: DataFrame, length: int, o: Options = Options()) -> DataFrame:
    """pair_id, dir, size of pairs whose best regions are unique and on one contig: what insert sizes are estimated from."""
    best = competitors(ranked, o).filter(F.col("csub") <= MIN_RATIO * F.col("score"))
    a, b = (best.filter(F.col("mate") == m).select("pair_id", F.col("contig").alias(f"c{m}"), F.col("rb").alias(f"b{m}")) for m in (0, 1))
    direction, size = mate_orientation(F.col("b0"), F.col("b1"), F.lit(length))
    both = a.join(b, "pair_id").filter("c0 = c1").select("pair_id", direction.alias("dir"), size.alias("size"))
    return both.filter((F.col("size") > 0) & (F.col("size") <= o.max_insert))


def with_rescued(ranked: DataFrame, rescued: DataFrame) -> DataFrame:
    """Both (columns of ranked regions), ranked again: a rescued region stands behind all that score as much as it does.

    rescued: its rank is the order in which its pair's regions were rescued.
    """
    both = ranked.withColumn("_late", F.lit(0)).unionByName(rescued.withColumn("_late", F.lit(1)))
    w = Window.partitionBy("pair_id", "mate").orderBy(F.desc("score"), "_late", "rank", "region_id")
    return both.withColumn("rank", F.row_number().over(w)).drop("_late")


def anchors(ranked: DataFrame, o: Options = Options()) -> DataFrame:
    """Regions from which a mate is looked for: within the price of an unpaired mate of the best, max_rescue at most."""
    best = F.max("score").over(Window.partitionBy("pair_id", "mate"))
    return ranked.withColumn("_best", best).filter((F.col("score") >= F.col("_best") - o.unpaired) & (F.col("rank") <= o.max_rescue)).drop("_best")


def clamp(df: DataFrame, contigs: DataFrame, length: int, beg: str, end: str) -> DataFrame:
    """df with beg and end cut to the contig (in either strand) that holds their middle, as contig_at.

    contigs: contig, offset, length; a dictionary, so it is sent to every task.
    """
    mid = F.floor((F.col(beg) + F.col(end)) / 2)
    reverse = mid >= length
    spans = F.broadcast(contigs.select(F.col("contig").alias("contig_at"), F.col("offset").alias("_from"), (F.col("offset") + F.col("length")).alias("_to")))
    at = F.when(reverse, 2 * length - 1 - mid).otherwise(mid)
    df = df.withColumns({"_reverse": reverse, "_at": at}).join(spans, (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to")))
    low, high = F.when(F.col("_reverse"), 2 * length - F.col("_to")).otherwise(F.col("_from")), F.when(F.col("_reverse"), 2 * length - F.col("_from")).otherwise(F.col("_to"))
    return df.withColumns({beg: F.greatest(F.col(beg), low), end: F.least(F.col(end), high)}).drop("_reverse", "_at", "_from", "_to")


def rescue_windows(found: DataFrame, regions: DataFrame, stats: DataFrame, contigs: DataFrame, length: int, mate_length: Column, o: Options = Options()) -> DataFrame:
    """pair_id, mate (that of the anchor), region_id, contig, dir, reverse, beg, end: where the other mate of an anchor is searched.

    stats: dir, low, high, failed; four rows. A direction is left out where it failed, or where the anchor already has a
    region of the other mate at a distance within its window.
    """
    four = F.broadcast(stats.filter(~F.col("failed")).select("dir", "low", "high"))
    a = found.select("pair_id", "mate", "region_id", F.col("rb").alias("_rb"), F.col("contig").alias("_contig"), mate_length.alias("_len"))
    other = regions.select("pair_id", (1 - F.col("mate")).alias("mate"), F.col("rb").alias("_mb"))
    direction, distance = mate_orientation(F.col("_rb"), F.col("_mb"), F.lit(length))
    paired = a.join(other, ["pair_id", "mate"]).select("pair_id", "mate", "region_id", direction.alias("dir"), distance.alias("_d")).join(four, "dir").filter(F.col("_d").between(F.col("low"), F.col("high"))).select("pair_id", "mate", "region_id", "dir").distinct()
    df = a.withColumn("_s", F.explode(F.array(*(F.lit(r) for r in range(4))))).join(four, F.col("_s") == F.col("dir")).join(paired, ["pair_id", "mate", "region_id", "dir"], "left_anti")
    ahead, reverse = F.col("dir") < 2, F.col("dir").isin(1, 2)
    beg, end = F.when(ahead, F.col("_rb") + F.col("low")).otherwise(F.col("_rb") - F.col("high")), F.when(ahead, F.col("_rb") + F.col("high")).otherwise(F.col("_rb") - F.col("low"))
    df = df.withColumns({"reverse": reverse, "beg": F.greatest(beg - F.when(reverse, F.col("_len")).otherwise(0), F.lit(0)), "end": F.least(end + F.when(reverse, 0).otherwise(F.col("_len")), F.lit(2 * length))})
    cut = clamp(df.filter("beg < end"), contigs, length, "beg", "end")
    return cut.filter((F.col("contig_at") == F.col("_contig")) & (F.col("end") - F.col("beg") >= o.min_seed)).select("pair_id", "mate", "region_id", F.col("contig_at").alias("contig"), "dir", "reverse", "beg", "end")


def rescue(windows: DataFrame, reads: DataFrame, ref: DataFrame, contigs: DataFrame, length: int, o: Options = Options()) -> DataFrame:
    """pair_id, mate (the rescued one), anchor, contig, dir, score, csub, qb, qe, rb, re of the mates found in windows; rb, re in the text of both strands.

    reads: pair_id, mate, seq. A window's bases and the mate meet in one row; batches of rows are aligned together.
    """
    at = F.broadcast(contigs.select("contig", "offset", F.col("length").alias("_n")))
    df = windows.withColumn("mate", 1 - F.col("mate")).join(reads.select("pair_id", "mate", "seq"), ["pair_id", "mate"]).join(at, "contig")
    strand = (F.col("beg") >= length).cast("int")
    start = F.when(strand == 1, 2 * length - F.col("offset") - F.col("_n")).otherwise(F.col("offset"))
    jobs = df.select("pair_id", "mate", F.col("region_id").alias("anchor"), "contig", "dir", "reverse", F.length("seq").alias("_size"), F.when(F.col("reverse"), revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("_query"), F.col("beg").alias("_from"), strand.alias("strand"), (F.col("beg") - start).alias("beg"), (F.col("end") - start).alias("end"))
    jobs = slices(jobs.withColumn("job", F.xxhash64("pair_id", "mate", "anchor", "dir")), ref)
    keep = ["pair_id", "mate", "anchor", "contig", "dir", "reverse", "_size", "_from"]
    names = ("score", "_qb", "_qe", "_tb", "_te", "csub")
    schema = T.StructType([*(jobs.schema[c] for c in keep), *(T.StructField(n, T.IntegerType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = local_many(b.column("_query").to_pylist(), b.column("target").to_pylist(), o, o.min_seed * o.match)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, pa.int32()) for c in made.T)], names=schema.names)

    found = jobs.select(*keep, "_query", "target").mapInArrow(run, schema).filter(rescue_accepted(F.col("score"), F.col("_qb"), o))
    turned = lambda a, b: F.when(F.col("reverse"), a).otherwise(b)
    return found.select("pair_id", "mate", "anchor", "contig", "dir", "score", "csub", turned(F.col("_size") - F.col("_qe"), F.col("_qb")).alias("qb"), turned(F.col("_size") - F.col("_qb"), F.col("_qe")).alias("qe"), turned(2 * length - F.col("_from") - F.col("_te"), F.col("_from") + F.col("_tb")).alias("rb"), turned(2 * length - F.col("_from") - F.col("_tb"), F.col("_from") + F.col("_te")).alias("re"))


def rescue_accepted(score: Column, qb: Column, o: Options = Options()) -> Column:
    """Whether a rescued region counts: its score against the seed's length itself, not times a match."""
    return (score >= o.min_seed) & (qb >= 0)


def insert_log_likelihood(z: Column) -> Column:
    """Of a distance in standard deviations, in units of a match. Spark has no complementary error function: it runs on Arrow batches."""

    def of(z: pd.Series) -> pd.Series:
        return z.map(lambda x: 0.721 * math.log(p) if (p := 2 * math.erfc(abs(x) * math.sqrt(0.5))) > 0 else -1e9)

    return F.pandas_udf(of, "double")(z)


def pair_scores(pairs: DataFrame, o: Options = Options()) -> DataFrame:
    """pairs (score1, score2, dist, mean, std) with score: that of the pair, 0 at least."""
    z = (F.col("dist") - F.col("mean")) / F.col("std")
    return pairs.withColumn("score", F.greatest(F.lit(0), (F.col("score1") + F.col("score2") + insert_log_likelihood(z) * o.match + 0.499).cast("int")))


def raw_mapq(difference: Column, match: int = 1) -> Column:
    return (6.02 * difference / match + 0.499).cast("int")


def id_shift(pair_id: Column) -> Column:
    """An id moved up by eight bits as a signed 32-bit number."""
    return F.shiftleft(pair_id.cast("int"), 8).cast("long")


def alt_share(score: Column, alt_score: Column) -> Column:
    """Score over that of the best ALT hit, three decimals, half to even."""
    return F.format_string("%.3f", F.bround(score.cast("double") / alt_score * 1000, 0) / 1000)


def kept_secondaries(records: DataFrame, every: bool = False, o: Options = Options()) -> DataFrame:
    """Records (read_id, region_id, primary, score, is_alt) that are written: primaries; with `every` also close secondaries off ALT contigs."""
    primary = records.filter(F.col("primary").isNull())
    if not every:
        return primary
    scores = primary.select("read_id", F.col("region_id").alias("primary"), F.col("score").alias("_p"))
    near = records.filter(~F.col("is_alt")).join(scores, ["read_id", "primary"]).filter(F.col("score").cast("float") >= F.col("_p").cast("float") * F.lit(o.drop_ratio).cast("float"))
    return primary.unionByName(near.select(*records.columns))


def supplementary_tags(records: DataFrame, by: Sequence[str] = ("read_id",)) -> DataFrame:
    """records (by, record, flag, contig, pos from 0, is_rev, cigar array, mapq, nm) with sa: all other records of the read that aren't secondary, or null."""
    entry = F.concat(F.concat_ws(",", "contig", (F.col("pos") + 1).cast("string"), F.when(F.col("is_rev"), "-").otherwise("+"), cigar_text(F.col("cigar")), F.col("mapq").cast("string"), F.col("nm").cast("string")), F.lit(";"))
    plain = F.col("flag").bitwiseAND(0x100) == 0
    every = F.collect_list(F.when(plain, F.struct("record", entry.alias("e")))).over(Window.partitionBy(*by))
    others = F.filter(F.array_sort("_every"), lambda x: x["record"] != F.col("record"))
    text = F.array_join(F.transform(others, lambda x: x["e"]), "")
    return records.withColumn("_every", every).withColumn("sa", F.when(plain, F.nullif(text, F.lit("")))).drop("_every")


def mate_fields(records: DataFrame) -> DataFrame:
    """records (pair_id, mate, contig, pos, end, is_rev, mapped) with rnext, pnext (from 1), tlen, mc_len: those of the other mate.

    The length is that between 5' ends, and 0 unless both are mapped on one contig.
    """
    other = records.select("pair_id", (1 - F.col("mate")).alias("mate"), *(F.col(c).alias(f"_{c}") for c in ("contig", "pos", "end", "is_rev", "mapped")))
    five = lambda p, e, r: F.when(r, e - 1).otherwise(p)
    one = F.col("mapped") & F.col("_mapped") & (F.col("contig") == F.col("_contig"))
    tlen = F.when(one, template_length(five(F.col("pos"), F.col("end"), F.col("is_rev")), five(F.col("_pos"), F.col("_end"), F.col("_is_rev")))).otherwise(F.lit(0))
    df = records.join(other, ["pair_id", "mate"], "left")
    df = df.withColumns({"rnext": F.when(~F.coalesce("_mapped", F.lit(False)), "*").when(F.col("contig") == F.col("_contig"), "=").otherwise(F.col("_contig")), "pnext": F.when(F.coalesce("_mapped", F.lit(False)), F.col("_pos") + 1).otherwise(F.lit(0)), "tlen": F.coalesce(tlen, F.lit(0))})
    return df.drop("_contig", "_pos", "_end", "_is_rev", "_mapped")


def ignore_alt(contigs: DataFrame) -> DataFrame:
    return contigs.withColumn("is_alt", F.lit(False))


def record_diff(expected: DataFrame, ours: DataFrame) -> DataFrame:
    """Records that only one of two sets has, as often as it has them more: side (expected or ours) and their fields."""
    return expected.exceptAll(ours).withColumn("side", F.lit("expected")).unionByName(ours.exceptAll(expected).withColumn("side", F.lit("ours")))
