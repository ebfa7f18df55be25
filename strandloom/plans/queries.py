"""Registered queries of the alignment operators and their SQL. Inputs are derived from the driver's tables by the same rule in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequence as fs
from strandloom.functions.hashing import with_mix64
from strandloom.operators import intervals, minimizers, pairs, records, seeding
from strandloom.plans import align, line_queries, mate_queries
from strandloom.plans.fixture import READS_SQL, REF_SQL, contigs, reads, table

K = 19


def _seeds(s: SparkSession, d: str) -> DataFrame:
    """Intervals from lineitem: an order is a read (or chain), a line a seed."""
    q = (F.col("l_partkey") % 80).cast("int")
    r = (F.col("l_suppkey") % 90 + F.col("l_linenumber") * 7).cast("int")
    n = (F.col("l_quantity").cast("int") % 30 + 19).cast("int")
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("i"), q.alias("qbeg"), (q + n).alias("qend"), r.alias("rbeg"), (r + n).alias("rend"), ((F.col("l_partkey") * 31) % 1000).alias("n"), F.lit(150).alias("length"))


SEEDS_SQL = """seeds AS (SELECT l_orderkey AS read_id, l_linenumber AS i, CAST(l_partkey % 80 AS INT) AS qbeg, CAST(l_suppkey % 90 + l_linenumber * 7 AS INT) AS rbeg,
  CAST(floor(l_quantity) AS INT) % 30 + 19 AS len, (l_partkey * 31) % 1000 AS n FROM lineitem)"""


def _regions(s: SparkSession, d: str) -> DataFrame:
    """Scored regions from lineitem."""
    li = table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    score = (30 + F.col("l_partkey") % 40).cast("int")
    return li.select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").cast("long").alias("region_id"), score.alias("score"), (F.col("l_suppkey") % 6).alias("rb"), (F.col("l_partkey") % 3).cast("int").alias("qb"), (F.col("l_suppkey") % 61).cast("int").alias("mapq"), (F.col("l_partkey") % 11 == 0).alias("is_alt"), F.when(F.col("l_linenumber") > 1, F.lit(1).cast("long")).alias("primary"))


REGIONS_SQL = """regions AS (SELECT l_orderkey AS read_id, CAST(l_linenumber AS BIGINT) AS region_id, CAST(30 + l_partkey % 40 AS INT) AS score, l_suppkey % 6 AS rb, CAST(l_partkey % 3 AS INT) AS qb,
  CAST(l_suppkey % 61 AS INT) AS mapq, l_partkey % 11 = 0 AS is_alt, CASE WHEN l_linenumber > 1 THEN CAST(1 AS BIGINT) END AS prim
  FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL))"""


def _samples(s: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_custkey") % 3000 + 1).otherwise(300 + F.col("o_custkey") % 97)
    return table(s, d, "orders").select((F.col("o_orderkey") * F.col("o_custkey") % 23).alias("x"), size.alias("size")).select(F.when(F.col("x") < 20, 1).when(F.col("x") < 22, 2).otherwise(0).alias("dir"), "size")


def _sam(s: SparkSession, d: str, other: bool) -> DataFrame:
    """Records of orders; the other set moves every seventh, drops every eleventh, repeats every thirteenth."""
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    pos = k * 7919 % 100_000 + (F.when(k % 7 == 0, 3).otherwise(0) if other else 0)
    base = o.select((k * 2).alias("ordinal"), F.concat(F.lit("r"), (k / 2).cast("long").cast("string")).alias("qname"), F.when(k % 2 == 0, 0x41).otherwise(0x81).alias("flag"), F.concat(F.lit("ctg"), (F.col("o_custkey") % 5).cast("string")).alias("rname"), pos.alias("pos"), (k % 61).cast("int").alias("mapq"), F.lit("100M").alias("cigar"), k.alias("k"))
    extra = base.filter(k_ := F.col("k") % 13 == 0).withColumns({"ordinal": F.col("ordinal") + 1, "pos": F.col("pos") + 1})
    second = base.filter(F.col("k") % 17 == 0).withColumn("flag", F.col("flag").bitwiseOR(0x100))
    del k_
    return (base.filter(F.col("k") % 11 != 0).unionByName(extra) if other else base).unionByName(second).drop("k")


def _sam_sql(name: str, other: bool) -> str:
    move = "+ CASE WHEN o_orderkey % 7 = 0 THEN 3 ELSE 0 END" if other else ""
    cut = "WHERE k % 11 <> 0 UNION ALL SELECT k, ordinal + 1, qname, flag, rname, pos + 1, mapq FROM b WHERE k % 13 = 0" if other else ""
    return f"""{name} AS (WITH b AS (SELECT o_orderkey AS k, o_orderkey * 2 AS ordinal, 'r' || (o_orderkey // 2) AS qname, CASE WHEN o_orderkey % 2 = 0 THEN 65 ELSE 129 END AS flag,
  'ctg' || (o_custkey % 5) AS rname, (o_orderkey * 7919) % 100000 {move} AS pos, o_orderkey % 61 AS mapq FROM orders), c AS (SELECT * FROM b {cut})
  SELECT key, arg_max(flag, ordinal) AS flag, arg_max(rname, ordinal) AS rname, arg_max(pos, ordinal) AS pos, arg_max(mapq, ordinal) AS mapq
  FROM (SELECT *, qname || CASE WHEN flag & 128 <> 0 THEN '/2' ELSE '/1' END AS key FROM c) GROUP BY key)"""


def _mates(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    b1, b2 = F.col("o_orderkey") * 7919 % 20_000, F.col("o_custkey") * 104_729 % 20_000
    direction, dist = fs.mate_orientation(b1, b2, F.lit(10_000))
    return o.select("o_orderkey", direction.alias("dir"), dist.alias("dist"))


def _cigars(s: SparkSession, d: str) -> DataFrame:
    op = lambda o, n: F.struct(F.lit(o).alias("op"), n.cast("int").alias("len"))
    li = table(s, d, "lineitem")
    c = F.filter(F.array(op("S", F.col("l_linenumber") - 1), op("M", F.col("l_partkey") % 90 + 1), op("D", F.col("l_suppkey") % 3), op("M", F.col("l_quantity")), op("I", F.col("l_suppkey") % 2), op("S", F.col("l_partkey") % 4)), lambda x: x["len"] > 0)
    return li.select("l_orderkey", "l_linenumber", c.alias("c")).select("l_orderkey", "l_linenumber", fs.cigar_ref_length(F.col("c")).cast("long").alias("ref_len"), fs.cigar_text(F.col("c")).alias("soft"), fs.cigar_text(F.col("c"), F.col("l_linenumber") > 1).alias("mixed"))


def _contig_positions(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    ref = contigs(s, d).select("contig", F.length("seq").cast("long").alias("length"))
    ref = ref.withColumn("offset", F.sum("length").over(Window.orderBy("contig")) - F.col("length"))
    at = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 101).alias("x"))
    total = ref.agg(F.sum("length").alias("total"))
    at = at.join(F.broadcast(total)).select("l_orderkey", "l_linenumber", (F.col("x") % F.col("total")).alias("pos"))
    return intervals.contig_of(at, ref)


def _range_pairs(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.concat(F.lit("ctg"), (F.col("l_suppkey") % 2).cast("string")).alias("contig"), (F.col("l_partkey") % 2).alias("strand"), (F.col("l_partkey") * 37 % 1000).alias("pos"), (F.col("l_partkey") % 50).cast("int").alias("score"), (F.col("l_linenumber") % 2).alias("mate"))
    return pairs.best_pairs(pairs.range_pairs(li.filter("mate = 1").drop("mate"), li.filter("mate = 0").drop("mate"), 50, 600), 7)


def _mapq(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    span = (F.col("l_quantity").cast("int") + 60).cast("int")
    score = (span - F.col("l_partkey") % 40).cast("int")
    sub = F.when(F.col("l_suppkey") % 3 == 0, 0).otherwise(score - F.col("l_suppkey") % 30).cast("int")
    frac = (F.col("l_partkey") % 8) / F.lit(8.0)
    return li.select("l_orderkey", "l_linenumber", fs.mapq_se(score, sub, F.lit(0), (F.col("l_suppkey") % 4).cast("int"), span, span + 1, frac).alias("mapq"))


def _accuracy(s: SparkSession, d: str) -> DataFrame:
    r = reads(s, d)
    placed = placements(s, d).join(r.select("read_id", "truth_contig", "truth_pos"), "read_id")
    return records.accuracy(placed.withColumn("mapq", F.least(F.col("matched"), F.lit(60))))


def _mems(s: SparkSession, d: str) -> DataFrame:
    return seeding.mems(reads(s, d), contigs(s, d), K)


def _rounds(s: SparkSession, d: str, *wanted: int) -> DataFrame:
    return seeding.seeds(reads(s, d), contigs(s, d), K, 28, 10, K + 1, 20, wanted)


def placements(s: SparkSession, d: str) -> DataFrame:
    return seeding.placements(reads(s, d), contigs(s, d), K)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return mate_queries.queries() | line_queries.queries() | {
        "seed_union": lambda s, d: _rounds(s, d, 1, 2, 3).withColumns({c: F.col(c).cast("long") for c in ("qbeg", "qend")}),
        "seeds_round3": lambda s, d: _rounds(s, d, 3).drop("round"),
        "minimizer_index": lambda s, d: minimizers.minimizers(contigs(s, d), ["contig"]),
        "minimizer_places": lambda s, d: minimizers.placed(reads(s, d), contigs(s, d), 15, 5, 20),
        "concordance_json": lambda s, d: records.concordance(records.primary_records(_sam(s, d, False)), records.primary_records(_sam(s, d, True))).select(F.to_json(F.struct("compared", "only_expected", "only_ours", "all_equal")).alias("report")),
        "revcomp": lambda s, d: reads(s, d).select("read_id", fs.revcomp(F.col("seq")).alias("rc"), fs.nt4(F.lower("seq")).alias("nt4")),
        "nt4_histogram": lambda s, d: intervals.base_histogram(seeding.both_strands(contigs(s, d))),
        "contig_stats": lambda s, d: intervals.contig_stats(contigs(s, d)),
        "kmer_counts": lambda s, d: seeding.ref_kmers(contigs(s, d), K).groupBy("kmer").count().groupBy(F.col("count").alias("times")).agg(F.count(F.lit(1)).alias("n_kmers")),
        "mem_seeds": lambda s, d: _mems(s, d).select("read_id", "contig", "strand", "qbeg", "qend", "rbeg"),
        "smems_round1": lambda s, d: _rounds(s, d, 1).drop("round"),
        "smems_round2": lambda s, d: _rounds(s, d, 2).drop("round"),
        "seed_stride_sample": lambda s, d: seeding.sampled_mems(reads(s, d), contigs(s, d), K, 3).select("read_id", "contig", "strand", "qbeg", "qend", "rbeg"),
        "best_placement": placements,
        "accuracy_buckets": _accuracy,
        "chain_weight": lambda s, d: intervals.chain_weight(_seeds(s, d), ["read_id"]),
        "frac_rep": lambda s, d: intervals.repeat_fraction(_seeds(s, d), 500).withColumn("frac_rep", F.round(F.col("frac_rep").cast("double"), 4)),
        "seed_coverage": lambda s, d: intervals.seed_coverage(_seeds(s, d).filter("i = 1").select("read_id", F.lit(1).alias("region_id"), F.lit(5).alias("qb"), F.lit(90).alias("qe"), F.lit(10).alias("rb"), F.lit(120).alias("re")), _seeds(s, d).select("read_id", "qbeg", "qend", "rbeg", "rend"), ["read_id"]),
        "contig_lookup": _contig_positions,
        "alt_flag": lambda s, d: records.flag_alt(contigs(s, d).select("contig"), table(s, d, "supplier").select(F.concat(F.lit("ctg"), (F.col("s_suppkey") % 3 + 3).cast("string")).alias("contig"))),
        "mate_orientation": _mates,
        "insert_stats": lambda s, d: pairs.insert_stats(_samples(s, d)).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)}),
        "pair_top2": _range_pairs,
        "xa_groups": lambda s, d: records.xa_groups(_regions(s, d), 0.8, 3),
        "mapq_se": _mapq,
        "sam_concordance": lambda s, d: records.concordance(records.primary_records(_sam(s, d, False)), records.primary_records(_sam(s, d, True))),
        "exact_dup_regions": lambda s, d: records.drop_exact_duplicates(_regions(s, d)).select("read_id", "region_id", "score", "rb", "qb"),
        "first_record_caps": lambda s, d: records.flag_records(_regions(s, d)).select("read_id", "region_id", "record", "flag", "mapq"),
        "cigar_text": _cigars,
        "tlen": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", fs.template_length(F.col("l_partkey"), F.col("l_suppkey") * 3).alias("tlen")),
        "max_gap": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", fs.max_gap(F.col("l_quantity").cast("int") * 5).alias("max_gap"), fs.infer_band((F.col("l_partkey") % 90 + 10).cast("int"), (F.col("l_suppkey") % 90 + 10).cast("int"), (F.col("l_quantity").cast("int") % 10).cast("int"), 6, 1, 1).alias("band")),
        "read_names": lambda s, d: table(s, d, "customer").select("c_custkey", fs.read_name(n := F.concat("c_name", F.lit("/"), (F.col("c_custkey") % 10).cast("string"), F.lit("  "), "c_mktsegment")).alias("name"), fs.comment(n).alias("comment")),
        "hash64": lambda s, d: with_mix64(table(s, d, "orders").select("o_orderkey"), "o_orderkey"),
        "align_se": lambda s, d: align.align_se(reads(s, d), contigs(s, d), with_seq=False).drop("job", "primary"),
    }


_RC = "translate(reverse(seq), 'ACGTacgt', 'TGCATGCA')"
_MEMS = f"""{REF_SQL}, {READS_SQL},
texts AS (SELECT contig, 0 AS strand, seq FROM ref UNION ALL SELECT contig, 1, {_RC} FROM ref),
rk AS (SELECT contig, strand, i AS rpos, substr(seq, CAST(i + 1 AS INT), {K}) AS kmer FROM (SELECT *, unnest(generate_series(0, length(seq) - {K})) AS i FROM texts) WHERE substr(seq, CAST(i + 1 AS INT), {K}) NOT LIKE '%N%'),
qk AS (SELECT read_id, i AS qpos, substr(seq, CAST(i + 1 AS INT), {K}) AS kmer FROM (SELECT *, unnest(generate_series(0, length(seq) - {K})) AS i FROM reads) WHERE substr(seq, CAST(i + 1 AS INT), {K}) NOT LIKE '%N%'),
hits AS (SELECT read_id, contig, strand, rpos - qpos AS diag, qpos FROM qk JOIN rk USING (kmer)),
isl AS (SELECT *, qpos - row_number() OVER (PARTITION BY read_id, contig, strand, diag ORDER BY qpos) AS g FROM hits),
mems AS (SELECT read_id, contig, strand, diag, min(qpos) AS qbeg, max(qpos) + {K} AS qend, diag + min(qpos) AS rbeg FROM isl GROUP BY read_id, contig, strand, diag, g),
ivs AS (SELECT read_id, qbeg, qend, count(*) AS n FROM mems GROUP BY ALL),
smems AS (SELECT * FROM ivs a WHERE NOT EXISTS (SELECT 1 FROM ivs b WHERE b.read_id = a.read_id AND b.qbeg <= a.qbeg AND b.qend >= a.qend AND (b.qbeg < a.qbeg OR b.qend > a.qend))),
diags AS (SELECT read_id, contig, strand, diag, sum(qend - qbeg) AS matched FROM mems GROUP BY ALL),
best AS (SELECT * FROM diags QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY matched DESC, contig, strand, diag) = 1),
placed_best AS (SELECT b.read_id, b.contig, b.strand, CASE WHEN b.strand = 0 THEN diag ELSE length(ref.seq) - diag - length(reads.seq) END AS pos, matched FROM best b JOIN ref USING (contig) JOIN reads USING (read_id))"""


def _minimizers(name: str, source: str, by: str, w: int) -> str:
    """CTEs that end in name: minimizers of source."""
    k = 15
    number = lambda c: " + ".join(f"(instr('ACGT', substr({c}, {i + 1}, 1)) - 1) * {4 ** (k - 1 - i)}" for i in range(k))

    def mixed(table: str, column: str) -> str:
        """The integer hash, a step a level."""
        mask = (1 << 2 * k) - 1
        steps = (f"((-v - 1) + (v << 21)) & {mask}", "xor(v, v >> 24)", f"(v + (v << 3) + (v << 8)) & {mask}", "xor(v, v >> 14)", f"(v + (v << 2) + (v << 4)) & {mask}", "xor(v, v >> 28)", f"(v + (v << 31)) & {mask}")
        out = f"SELECT kmer, CAST({number(column)} AS BIGINT) AS v FROM {table}"
        for step in steps:
            out = f"SELECT kmer, {step} AS v FROM ({out})"
        return f"({out})"

    return f"""{name}_k AS (SELECT {by}, i AS pos, length(seq) - {k} + 1 AS n, substr(seq, CAST(i + 1 AS INT), {k}) AS kmer FROM (SELECT {by}, seq, unnest(generate_series(0, length(seq) - {k})) AS i FROM {source})),
{name}_d AS (SELECT DISTINCT kmer, translate(reverse(kmer), 'ACGT', 'TGCA') AS rc FROM {name}_k WHERE kmer NOT LIKE '%N%'),
{name}_h AS (SELECT kmer, least(f.v, r.v) AS hash, CAST(r.v < f.v AS INT) AS strand FROM {mixed(name + "_d", "kmer")} f JOIN {mixed(name + "_d", "rc")} r USING (kmer)),
{name}_m AS (SELECT {by}, pos, n, hash, strand, CASE WHEN pos <= greatest(n - {w}, 0) THEN min(hash) OVER (PARTITION BY {by} ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING) END AS low FROM {name}_k LEFT JOIN {name}_h USING (kmer)),
{name} AS (SELECT {by}, pos, strand, hash FROM (SELECT *, max(low) OVER (PARTITION BY {by} ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS top FROM {name}_m) WHERE hash = top)"""


def _union(beg: str, end: str, where: str = "") -> str:
    """Covered length by sweeping interval ends."""
    return f"""(SELECT read_id, sum(greatest(0, e - greatest(b, coalesce(p, b)))) AS c FROM (SELECT read_id, {beg} AS b, {end} AS e,
      max({end}) OVER (PARTITION BY read_id ORDER BY {beg}, {end} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM seeds {where}) GROUP BY read_id)"""


def oracle_sql() -> dict[str, str]:
    li = "CAST(floor(l_quantity) AS INT)"
    out = mate_queries.oracle_sql() | line_queries.oracle_sql() | {
        "revcomp": f"WITH {REF_SQL}, {READS_SQL} SELECT read_id, translate(reverse(seq), 'ACGT', 'TGCA') AS rc, seq AS nt4 FROM reads",
        "nt4_histogram": f"WITH {REF_SQL}, t AS (SELECT seq FROM ref UNION ALL SELECT {_RC} FROM ref), b AS (SELECT unnest(['A','C','G','T','N']) AS base) SELECT base, CAST(sum(length(seq) - length(replace(seq, base, ''))) AS BIGINT) AS n FROM t, b GROUP BY base",
        "contig_stats": f"WITH {REF_SQL} SELECT contig, length(seq) AS length, length(seq) - length(replace(seq, 'N', '')) AS n_ambs, CAST(len(regexp_extract_all(seq, 'N+')) AS BIGINT) AS n_holes FROM ref",
        "kmer_counts": f"WITH {_MEMS} SELECT times, count(*) AS n_kmers FROM (SELECT count(*) AS times FROM rk GROUP BY kmer) GROUP BY times",
        "mem_seeds": f"WITH {_MEMS} SELECT read_id, contig, strand, qbeg, qend, rbeg FROM mems",
        "smems_round1": f"WITH {_MEMS} SELECT read_id, qbeg, qend, n FROM smems",
        "smems_round2": f"""WITH {_MEMS}, long AS (SELECT read_id, qbeg AS sb, qend AS se, n AS sn, (qbeg + qend) // 2 AS mid FROM smems WHERE qend - qbeg >= 28 AND n <= 10),
ov AS (SELECT l.*, m.qbeg, m.qend FROM long l JOIN mems m ON m.read_id = l.read_id AND m.qbeg <= mid AND m.qend > mid),
c AS (SELECT DISTINCT a.read_id, a.sb, a.se, a.sn, a.qbeg AS b, z.qend AS e FROM ov a JOIN ov z ON a.read_id = z.read_id AND a.sb = z.sb AND a.se = z.se WHERE z.qend - a.qbeg >= {K}),
n AS (SELECT c.*, (SELECT count(*) FROM ov WHERE ov.read_id = c.read_id AND ov.sb = c.sb AND ov.se = c.se AND ov.qbeg <= c.b AND ov.qend >= c.e) AS n FROM c),
k AS (SELECT * FROM n WHERE n > sn)
SELECT read_id, b AS qbeg, e AS qend, n FROM k x WHERE NOT EXISTS (SELECT 1 FROM k y WHERE y.read_id = x.read_id AND y.sb = x.sb AND y.se = x.se AND y.b <= x.b AND y.e >= x.e AND (y.b < x.b OR y.e > x.e))""",
        "seed_stride_sample": f"""WITH {_MEMS}, o AS (SELECT *, row_number() OVER (PARTITION BY read_id, qbeg, qend ORDER BY contig, strand, rbeg) - 1 AS i, count(*) OVER (PARTITION BY read_id, qbeg, qend) AS n FROM mems)
SELECT read_id, contig, strand, qbeg, qend, rbeg FROM o WHERE i % (CASE WHEN n > 3 THEN n // 3 ELSE 1 END) = 0 AND i // (CASE WHEN n > 3 THEN n // 3 ELSE 1 END) < 3""",
        "best_placement": f"WITH {_MEMS} SELECT read_id, contig, strand, pos, CAST(matched AS BIGINT) AS matched FROM placed_best",
        "accuracy_buckets": f"""WITH {_MEMS}, a AS (SELECT p.*, truth_contig, truth_pos, least(matched, 60) AS mapq FROM placed_best p JOIN reads USING (read_id))
SELECT CASE WHEN mapq >= 60 THEN '60' WHEN mapq >= 30 THEN '30-59' WHEN mapq >= 10 THEN '10-29' WHEN mapq >= 1 THEN '1-9' ELSE '0' END AS bucket, count(*) AS n,
count(*) FILTER (WHERE NOT (contig = truth_contig AND abs(pos - truth_pos) <= 5)) AS wrong FROM a GROUP BY 1""",
        "chain_weight": f"WITH {SEEDS_SQL} SELECT q.read_id, CAST(least(q.c, r.c) AS BIGINT) AS weight FROM {_union('qbeg', 'qbeg + len')} q JOIN {_union('rbeg', 'rbeg + len')} r USING (read_id)",
        "frac_rep": f"WITH {SEEDS_SQL} SELECT read_id, round(CAST(CAST(coalesce(c, 0) AS DOUBLE) / 150 AS FLOAT)::DOUBLE, 4) AS frac_rep FROM (SELECT DISTINCT read_id FROM seeds) LEFT JOIN {_union('qbeg', 'qbeg + len', 'WHERE n > 500')} USING (read_id)",
        "seed_coverage": f"WITH {SEEDS_SQL}, r AS (SELECT read_id FROM seeds WHERE i = 1) SELECT r.read_id, 1 AS region_id, CAST(coalesce(sum(len) FILTER (WHERE qbeg >= 5 AND qbeg + len <= 90 AND rbeg >= 10 AND rbeg + len <= 120), 0) AS BIGINT) AS seedcov FROM r LEFT JOIN seeds USING (read_id) GROUP BY r.read_id",
        "contig_lookup": f"""WITH {REF_SQL}, c AS (SELECT contig, length(seq) AS length, sum(length(seq)) OVER (ORDER BY contig) - length(seq) AS off FROM ref),
p AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 7919 + l_linenumber * 101) % (SELECT sum(length) FROM c) AS pos FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(pos AS BIGINT) AS pos, contig, CAST(pos - off AS BIGINT) AS contig_pos FROM p ASOF JOIN c ON p.pos >= c.off""",
        "alt_flag": f"WITH {REF_SQL} SELECT contig, contig IN (SELECT 'ctg' || (s_suppkey % 3 + 3) FROM supplier) AS is_alt FROM ref",
        "mate_orientation": """WITH m AS (SELECT o_orderkey, (o_orderkey * 7919) % 20000 AS b1, (o_custkey * 104729) % 20000 AS b2 FROM orders),
p AS (SELECT *, (b1 >= 10000) = (b2 >= 10000) AS same, CASE WHEN (b1 >= 10000) = (b2 >= 10000) THEN b2 ELSE 19999 - b2 END AS p2 FROM m)
SELECT o_orderkey, xor(CASE WHEN same THEN 0 ELSE 1 END, CASE WHEN p2 > b1 THEN 0 ELSE 3 END) AS dir, abs(p2 - b1) AS dist FROM p""",
        "insert_stats": """WITH s AS (SELECT CASE WHEN x < 20 THEN 1 WHEN x < 22 THEN 2 ELSE 0 END AS dir, size FROM (SELECT o_orderkey * o_custkey % 23 AS x, CASE WHEN o_orderkey % 50 = 0 THEN o_custkey % 3000 + 1 ELSE 300 + o_custkey % 97 END AS size FROM orders)),
r AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY size) - 1 AS i, count(*) OVER (PARTITION BY dir) AS n FROM s),
q AS (SELECT dir, any_value(n) AS n, max(size) FILTER (WHERE i = floor(0.25 * n + 0.499)) AS p25, max(size) FILTER (WHERE i = floor(0.75 * n + 0.499)) AS p75 FROM r GROUP BY dir),
m AS (SELECT q.dir, q.n, p25, p75, avg(size) AS mean, stddev_pop(size) AS std FROM q JOIN s ON s.dir = q.dir AND size BETWEEN greatest(1, p25 - 2 * (p75 - p25)) AND p75 + 2 * (p75 - p25) GROUP BY ALL)
SELECT dir, n, p25, p75, round(mean, 6) AS mean, round(std, 6) AS std, CAST(greatest(1, least(p25 - 3 * (p75 - p25), floor(mean - 4 * std + 0.499))) AS BIGINT) AS low,
CAST(greatest(p75 + 3 * (p75 - p25), floor(mean + 4 * std + 0.499)) AS BIGINT) AS high, n < 10 OR n < 0.05 * max(n) OVER () AS failed FROM m""",
        "pair_top2": """WITH l AS (SELECT l_orderkey AS pair_id, l_suppkey % 2 AS contig, l_partkey % 2 AS strand, l_partkey * 37 % 1000 AS pos, CAST(l_partkey % 50 AS INT) AS score, l_linenumber % 2 AS mate FROM lineitem),
p AS (SELECT a.pair_id, a.score + b.score AS score, row_number() OVER (PARTITION BY a.pair_id ORDER BY a.score + b.score DESC, a.contig, a.pos, b.pos) AS r FROM l a JOIN l b ON a.pair_id = b.pair_id AND a.contig = b.contig AND a.strand <> b.strand AND a.mate = 1 AND b.mate = 0 AND abs(b.pos - a.pos) BETWEEN 50 AND 600),
t AS (SELECT *, max(CASE WHEN r = 2 THEN score END) OVER (PARTITION BY pair_id) AS sec FROM p)
SELECT pair_id, max(score) AS best, coalesce(max(sec), 0) AS second, count(*) FILTER (WHERE r > 2 AND sec - score <= 7) AS n_sub FROM t GROUP BY pair_id""",
        "xa_groups": f"""WITH {REGIONS_SQL}, c AS (SELECT s.read_id, s.prim, s.region_id, s.is_alt FROM regions s JOIN regions p ON p.read_id = s.read_id AND p.region_id = s.prim AND p.prim IS NULL WHERE CAST(s.score AS FLOAT) >= CAST(p.score AS FLOAT) * CAST(0.8 AS FLOAT))
SELECT read_id, prim AS "primary", count(*) AS n, string_agg(CAST(region_id AS VARCHAR), ';' ORDER BY region_id) AS hits FROM c GROUP BY ALL HAVING count(*) <= 3 OR (bool_or(is_alt) AND count(*) <= 200)""",
        "mapq_se": f"""WITH x AS (SELECT l_orderkey, l_linenumber, {li} + 60 AS span, {li} + 60 - l_partkey % 40 AS score, l_suppkey, l_partkey % 8 / 8.0::DOUBLE AS frac FROM lineitem),
y AS (SELECT *, CASE WHEN l_suppkey % 3 = 0 THEN 19 ELSE greatest(score - l_suppkey % 30, 0) END AS b0, CASE WHEN l_suppkey % 3 = 0 OR score - l_suppkey % 30 = 0 THEN 19 ELSE score - l_suppkey % 30 END AS b, CAST(span + 1 AS DOUBLE) AS l FROM x),
z AS (SELECT *, greatest(b, 0) AS best, 3 / ln(l) * pow(1 - (l - score) / 5 / l, 2) AS w FROM y),
q AS (SELECT *, trunc(6.02::DOUBLE * (score - best) * w * w + 0.499::DOUBLE) - CASE WHEN l_suppkey % 4 > 0 THEN trunc(4.343::DOUBLE * ln(l_suppkey % 4 + 1) + 0.499::DOUBLE) ELSE 0 END AS q FROM z)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN best >= score THEN 0 ELSE trunc(least(greatest(q, 0), 60) * (1 - frac) + 0.499::DOUBLE) END AS INT) AS mapq FROM q""",
        "sam_concordance": f"""WITH {_sam_sql("a", False)}, {_sam_sql("b", True)}
SELECT count(*) FILTER (WHERE a.key IS NOT NULL AND b.key IS NOT NULL) AS compared, count(*) FILTER (WHERE b.key IS NULL) AS only_expected, count(*) FILTER (WHERE a.key IS NULL) AS only_ours,
count(*) FILTER (WHERE a.flag = b.flag) AS flag_equal, count(*) FILTER (WHERE a.rname = b.rname) AS rname_equal, count(*) FILTER (WHERE a.pos = b.pos) AS pos_equal, count(*) FILTER (WHERE a.mapq = b.mapq) AS mapq_equal,
count(*) FILTER (WHERE a.key = b.key) AS cigar_equal, count(*) FILTER (WHERE a.flag = b.flag AND a.rname = b.rname AND a.pos = b.pos AND a.mapq = b.mapq) AS all_equal FROM a FULL JOIN b ON a.key = b.key""",
        "exact_dup_regions": f"WITH {REGIONS_SQL} SELECT read_id, min(region_id) AS region_id, score, rb, qb FROM regions GROUP BY read_id, score, rb, qb",
        "first_record_caps": f"""WITH {REGIONS_SQL}, r AS (SELECT *, row_number() OVER w AS record, first_value(mapq) OVER w AS f FROM regions WINDOW w AS (PARTITION BY read_id ORDER BY score DESC, rb, qb, region_id))
SELECT read_id, region_id, record, CASE WHEN record > 1 THEN 2048 ELSE 0 END AS flag, least(mapq, f) AS mapq FROM r""",
        "cigar_text": f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS s, l_partkey % 90 + 1 AS m, l_suppkey % 3 AS d, {li} AS m2, l_suppkey % 2 AS i, l_partkey % 4 AS t FROM lineitem),
x AS (SELECT *, CASE WHEN d > 0 THEN d || 'D' ELSE '' END || CASE WHEN m2 > 0 THEN m2 || 'M' ELSE '' END || CASE WHEN i > 0 THEN i || 'I' ELSE '' END AS mid FROM c)
SELECT l_orderkey, l_linenumber, CAST(m + d + m2 AS BIGINT) AS ref_len, CASE WHEN s > 0 THEN s || 'S' ELSE '' END || m || 'M' || mid || CASE WHEN t > 0 THEN t || 'S' ELSE '' END AS soft,
CASE WHEN s > 0 THEN s || 'H' ELSE '' END || m || 'M' || mid || CASE WHEN t > 0 THEN t || CASE WHEN l_linenumber > 1 THEN 'H' ELSE 'S' END ELSE '' END AS mixed FROM x""",
        "tlen": "SELECT l_orderkey, l_linenumber, -(l_partkey - l_suppkey * 3 + sign(l_partkey - l_suppkey * 3)) AS tlen FROM lineitem",
        "max_gap": f"""WITH x AS (SELECT l_orderkey, l_linenumber, {li} * 5 AS t, l_partkey % 90 + 10 AS a, l_suppkey % 90 + 10 AS b, {li} % 10 AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(least(greatest(1, trunc(t - 6 + 1)), 200) AS INT) AS max_gap, CAST(CASE WHEN a = b AND a - s < 12 THEN 0 ELSE greatest(trunc(least(a, b) - s - 6 + 2), abs(a - b)) END AS INT) AS band FROM x""",
        "read_names": "SELECT c_custkey, c_name AS name, c_mktsegment AS comment FROM customer",
    }
    out["seeds_round3"] = f"""WITH RECURSIVE {_MEMS}, spot AS (SELECT read_id, seq, unnest(generate_series(0, length(seq) - 1)) AS x FROM reads),
crowd AS (SELECT read_id, x, max(e) AS e FROM (SELECT i.read_id, x, i.qend AS e, sum(j.n) AS n FROM (SELECT DISTINCT s.read_id, x, qend FROM spot s JOIN ivs i ON i.read_id = s.read_id AND qbeg <= x AND qend > x) i
  JOIN ivs j ON j.read_id = i.read_id AND j.qbeg <= x AND j.qend >= i.qend GROUP BY ALL) WHERE n >= 20 GROUP BY ALL),
step AS (SELECT read_id, x, greatest(x + {K + 1}, coalesce(e, 0) + 1) AS e, CASE WHEN contains(substr(seq, CAST(x + 1 AS INT)), 'N') THEN x + instr(substr(seq, CAST(x + 1 AS INT)), 'N') - 1 ELSE length(seq) END AS stop FROM spot LEFT JOIN crowd USING (read_id, x)),
walk AS (SELECT * FROM step WHERE x = 0 UNION ALL SELECT s.* FROM walk w JOIN step s ON s.read_id = w.read_id AND s.x = CASE WHEN w.stop < w.e THEN w.stop + 1 ELSE w.e END)
SELECT w.read_id, CAST(x AS INT) AS qbeg, CAST(w.e AS INT) AS qend, CAST(sum(n) AS BIGINT) AS n FROM walk w JOIN ivs i ON i.read_id = w.read_id AND i.qbeg <= x AND i.qend >= w.e WHERE stop >= w.e GROUP BY ALL"""
    out["minimizer_index"] = f"WITH {REF_SQL}, {_minimizers('mz', 'ref', 'contig', 10)} SELECT * FROM mz"
    out["minimizer_places"] = f"""WITH {REF_SQL}, {READS_SQL}, {_minimizers('mr', 'ref', 'contig', 5)}, {_minimizers('mq', 'reads', 'read_id', 5)},
rare AS (SELECT * FROM mr QUALIFY count(*) OVER (PARTITION BY hash) <= 20),
hit AS (SELECT read_id, contig, CAST(q.strand <> r.strand AS INT) AS strand, CASE WHEN q.strand = r.strand THEN r.pos - q.pos ELSE r.pos + q.pos END AS d FROM mq q JOIN rare r USING (hash)),
c AS (SELECT read_id, contig, strand, CAST(floor(d / 64) AS BIGINT) - o AS band, count(*) AS n FROM hit, (VALUES (0), (1)) t(o) GROUP BY ALL)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY n DESC, contig, strand, band) = 1"""
    out["seed_union"] = f"SELECT *, 1 AS round FROM ({out['smems_round1']}) UNION ALL SELECT *, 2 AS round FROM ({out['smems_round2']}) UNION ALL SELECT *, 3 AS round FROM ({out['seeds_round3']})"
    out["concordance_json"] = f"""SELECT '{{"compared":' || compared || ',"only_expected":' || only_expected || ',"only_ours":' || only_ours || ',"all_equal":' || all_equal || '}}' AS report FROM ({out['sam_concordance']})"""
    return out
