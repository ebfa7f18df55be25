"""Registered queries of the record text, seed and region operators, and their SQL. Rows are derived from lineitem by one rule in both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.operators import lines, redundancy
from strandloom.plans.fixture import BASES, HEX, table

_LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(CAST(floor(l_quantity) AS INT)) AS q FROM lineitem GROUP BY ALL)"


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min(F.floor("l_quantity").cast("int")).alias("q"))


def records(s: SparkSession, d: str, single: bool) -> DataFrame:
    """Lines of an order as records of a pair (odd and even lines) or of one read; a read whose first record is unmapped has no other."""
    p, x = F.col("p"), F.col("s")
    mate = F.lit(None).cast("int") if single else (F.col("l_linenumber") % 2).cast("int")
    read = Window.partitionBy("l_orderkey", "mate")
    df = _lines(s, d).withColumn("mate", mate).withColumn("record", F.row_number().over(read.orderBy("l_linenumber")) - 1).withColumn("lost", (F.col("record") == 0) & (p % 13 == 0))
    df = df.withColumn("none", F.max("lost").over(read)).filter(F.col("lost") | ~F.col("none"))
    op = lambda o, n: F.struct(F.lit(o).alias("op"), n.cast("int").alias("len"))
    cigar = F.filter(F.array(op("S", p % 5), op("M", 32 - p % 5 - x % 4), op("S", x % 4)), lambda c: c["len"] > 0)
    end = F.lit(0) if single else F.when(F.col("mate") == 0, 64).otherwise(128)
    name = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.coalesce(F.col("mate").cast("string"), F.lit("-")))
    unless = lambda c, other: F.when(F.col("lost"), F.lit(other)).otherwise(c)
    return df.select(
        F.concat(F.lit("r"), F.col("l_orderkey").cast("string")).alias("qname"), "mate", "record", (end + F.when(F.col("record") == 0, 0).when(p % 7 == 0, 256).otherwise(2048)).cast("int").alias("flag"),
        F.when(~F.col("lost"), F.concat(F.lit("ctg"), (x % 3).cast("string"))).alias("contig"), (p * 37 % 10_000).alias("pos"), (~F.col("lost") & (p % 2 == 1)).alias("is_rev"), (p % 11 == 0).alias("is_alt"), unless((x % 61).cast("int"), 0).alias("mapq"),
        cigar.alias("cigar"), (p % 7).cast("int").alias("nm"), (32 - p % 5 - x % 4).cast("string").alias("md"), unless((p % 100).cast("int"), 0).alias("score"), unless((p % 50 - 1).cast("int"), 0).alias("sub"),
        unless(F.when(x % 4 == 0, x % 90 + 1).otherwise(0).cast("int"), 0).alias("alt_score"), F.when(~F.col("lost") & (x % 6 == 0), F.lit("ctg1,+5,32M,0;")).alias("xa"),
        F.translate(F.md5(F.concat(F.lit("read-"), name).cast("binary")), HEX, BASES).alias("seq"), F.md5(F.concat(F.lit("q-"), name).cast("binary")).alias("qual"), F.when(p % 3 == 0, F.lit("BC:Z:A")).alias("comment"),
    )


def _records_sql(single: bool) -> str:
    """The lines as text, in SQL."""
    mate, name = ("CAST(NULL AS INT)", "l_orderkey || '/-'") if single else ("CAST(l_linenumber % 2 AS INT)", "l_orderkey || '/' || mate")
    cigar = lambda a, hard: f"CASE WHEN {a}p % 5 > 0 THEN ({a}p % 5) || CASE WHEN {hard} THEN 'H' ELSE 'S' END ELSE '' END || (32 - {a}p % 5 - {a}s % 4) || 'M' || CASE WHEN {a}s % 4 > 0 THEN ({a}s % 4) || CASE WHEN {hard} THEN 'H' ELSE 'S' END ELSE '' END"
    five = lambda a: f"{a}pos + CASE WHEN {a}rev THEN 31 - {a}p % 5 - {a}s % 4 ELSE 0 END"
    hard = "r.record > 0 AND r.p % 11 <> 0"
    return f"""WITH n AS (SELECT *, {mate} AS mate FROM {_LINES}),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey, mate ORDER BY l_linenumber) - 1 AS INT) AS record FROM n),
l AS (SELECT *, record = 0 AND p % 13 = 0 AS lost FROM o), k AS (SELECT *, bool_or(lost) OVER (PARTITION BY l_orderkey, mate) AS none FROM l),
r AS (SELECT *, CASE WHEN NOT lost THEN 'ctg' || (s % 3) END AS contig, p * 37 % 10000 AS pos, NOT lost AND p % 2 = 1 AS rev, CASE WHEN record = 0 THEN 0 WHEN p % 7 = 0 THEN 256 ELSE 2048 END AS kind,
  translate(md5('read-' || {name}), '{HEX}', '{BASES}') AS seq, md5('q-' || {name}) AS qual FROM k WHERE lost OR NOT none),
sa AS (SELECT a.l_orderkey, a.mate, a.record, string_agg(b.contig || ',' || (b.pos + 1) || ',' || CASE WHEN b.rev THEN '-' ELSE '+' END || ',' || {cigar("b.", "false")} || ',' || (b.s % 61) || ',' || (b.p % 7) || ';', '' ORDER BY b.record) AS sa
  FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.mate IS NOT DISTINCT FROM b.mate AND a.record <> b.record AND b.kind <> 256 WHERE a.kind <> 256 GROUP BY ALL),
j AS (SELECT r.*, m.record IS NOT NULL AS paired, m.contig AS mc, m.pos AS mp, coalesce(m.rev, false) AS mr, coalesce(m.lost, false) AS ml, {cigar("m.", "r.record > 0 AND m.p % 11 <> 0")} AS mcigar, {five("m.")} AS m5,
  {cigar("r.", hard)} AS cig, {five("r.")} AS r5, {hard} AS hard, sa FROM r LEFT JOIN r m ON m.l_orderkey = r.l_orderkey AND m.mate = 1 - r.mate AND m.record = 0
  LEFT JOIN sa ON sa.l_orderkey = r.l_orderkey AND sa.mate IS NOT DISTINCT FROM r.mate AND sa.record = r.record),
e AS (SELECT *, coalesce(contig, mc) AS ec, CASE WHEN lost THEN mp ELSE pos END AS ep, CASE WHEN lost AND mc IS NOT NULL THEN mr ELSE rev END AS er, CASE WHEN paired THEN coalesce(mc, contig) END AS fc,
  CASE WHEN ml THEN pos ELSE mp END AS fp, CASE WHEN ml AND NOT lost THEN rev ELSE mr END AS fr,
  CASE WHEN hard AND NOT lost THEN CASE WHEN rev THEN s % 4 ELSE p % 5 END ELSE 0 END AS a, CASE WHEN hard AND NOT lost THEN CASE WHEN rev THEN p % 5 ELSE s % 4 END ELSE 0 END AS z FROM j),
c AS (SELECT *, substr(seq, CAST(a + 1 AS INT), CAST(32 - a - z AS INT)) AS cs, substr(qual, CAST(a + 1 AS INT), CAST(32 - a - z AS INT)) AS cq FROM e)
SELECT 'r' || l_orderkey AS qname, mate, record, concat_ws(chr(9), 'r' || l_orderkey,
  {"0" if single else "CASE WHEN mate = 0 THEN 64 ELSE 128 END"} + kind + paired::INT + 4 * lost::INT + 8 * ml::INT + 16 * er::INT + 32 * fr::INT,
  CASE WHEN ec IS NULL THEN concat_ws(chr(9), '*', 0, 0, '*') ELSE concat_ws(chr(9), ec, ep + 1, CASE WHEN lost THEN 0 ELSE s % 61 END, CASE WHEN lost THEN '*' ELSE cig END) END,
  CASE WHEN fc IS NULL THEN concat_ws(chr(9), '*', 0, 0) ELSE concat_ws(chr(9), CASE WHEN fc = ec THEN '=' ELSE fc END, fp + 1, CASE WHEN fc = ec AND NOT lost AND NOT ml THEN CAST(-(r5 - m5 + sign(r5 - m5)) AS BIGINT) ELSE 0 END) END,
  CASE WHEN kind = 256 THEN concat_ws(chr(9), '*', '*') WHEN er THEN concat_ws(chr(9), translate(reverse(cs), 'ACGT', 'TGCA'), reverse(cq)) ELSE concat_ws(chr(9), cs, cq) END,
  CASE WHEN NOT lost THEN 'NM:i:' || (p % 7) END, CASE WHEN NOT lost THEN 'MD:Z:' || (32 - p % 5 - s % 4) END, CASE WHEN paired AND NOT ml THEN 'MC:Z:' || mcigar END,
  'AS:i:' || CASE WHEN lost THEN 0 ELSE p % 100 END, CASE WHEN lost THEN 'XS:i:0' WHEN p % 50 > 0 THEN 'XS:i:' || (p % 50 - 1) END, 'RG:Z:g1', 'SA:Z:' || sa,
  CASE WHEN kind <> 256 AND NOT lost AND s % 4 = 0 THEN 'pa:f:' || printf('%.3f', round_even((p % 100)::DOUBLE / (s % 90 + 1) * 1000, 0) / 1000) END,
  CASE WHEN NOT lost AND s % 6 = 0 THEN 'XA:Z:ctg1,+5,32M,0;' END, CASE WHEN p % 3 = 0 THEN 'BC:Z:A' END) AS line FROM c"""


def _seeds(s: SparkSession, d: str) -> DataFrame:
    p, x = F.col("p"), F.col("s")
    return _lines(s, d).select(F.col("l_orderkey").alias("chain"), F.col("l_linenumber").alias("i"), (p % 12).cast("int").alias("qbeg"), (F.col("q") % 14 + 6).cast("int").alias("len"), (p % 12 + x % 2).alias("rbeg"))


def _ends(s: SparkSession, d: str) -> DataFrame:
    return _lines(s, d).select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").cast("int").alias("row"), (F.col("s") % 40).cast("int").alias("score"))


def _spans(s: SparkSession, d: str) -> DataFrame:
    rb = F.col("p") * 7919 % 40_000
    return _lines(s, d).select(F.col("l_orderkey").alias("read_id"), F.lit("a").alias("contig"), (F.col("s") % 2).cast("int").alias("strand"), F.col("l_linenumber").cast("long").alias("job"), rb.alias("rb"), (rb + 50 + F.col("q") * 40).alias("re"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pair_records": lambda s, d: lines.record_lines(records(s, d, False), group="g1"),
        "single_records": lambda s, d: lines.record_lines(records(s, d, True), group="g1"),
        "contained_seeds": lambda s, d: redundancy.flag_contained(_seeds(s, d), ["chain"]).select("chain", "i", "skip"),
        "second_best_end": lambda s, d: redundancy.second_best(_ends(s, d), 10, 20),
        "region_clusters": lambda s, d: redundancy.clusters(_spans(s, d)).select("read_id", "strand", "job", "cluster"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "pair_records": _records_sql(False),
        "single_records": _records_sql(True),
        "contained_seeds": f"""WITH x AS (SELECT l_orderkey AS chain, l_linenumber AS i, CAST(p % 12 AS INT) AS qbeg, q % 14 + 6 AS len, p % 12 + s % 2 AS rbeg FROM {_LINES})
SELECT chain, i, EXISTS (SELECT 1 FROM x b WHERE b.chain = a.chain AND b.len > a.len AND b.rbeg - b.qbeg = a.rbeg - a.qbeg AND a.qbeg >= b.qbeg AND a.qbeg + a.len <= b.qbeg + b.len)
AND NOT EXISTS (SELECT 1 FROM x b WHERE b.chain = a.chain AND b.i <> a.i AND b.len::DOUBLE >= a.len * 0.95::DOUBLE AND b.rbeg - b.qbeg <> a.rbeg - a.qbeg
  AND (a.qbeg <= b.qbeg AND a.qbeg + a.len - b.qbeg >= a.len // 4 OR b.qbeg <= a.qbeg AND b.qbeg + b.len - a.qbeg >= a.len // 4)) AS skip FROM x a""",
        "second_best_end": f"""WITH RECURSIVE x AS (SELECT l_orderkey AS job, CAST(l_linenumber AS INT) AS row_, CAST(s % 40 AS INT) AS score FROM {_LINES}),
y AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY row_) AS i FROM x WHERE score >= 10),
w AS (SELECT job, i, 1 AS e, score, row_ FROM y WHERE i = 1
  UNION ALL SELECT y.job, y.i, CASE WHEN w.row_ + 1 = y.row_ THEN e ELSE e + 1 END, CASE WHEN w.row_ + 1 = y.row_ THEN greatest(w.score, y.score) ELSE y.score END, CASE WHEN w.row_ + 1 = y.row_ AND w.score >= y.score THEN w.row_ ELSE y.row_ END
  FROM w JOIN y ON y.job = w.job AND y.i = w.i + 1),
kept AS (SELECT job, e, arg_max(score, i) AS score, arg_max(row_, i) AS row_ FROM w GROUP BY ALL),
best AS (SELECT job, score, row_ FROM x QUALIFY row_number() OVER (PARTITION BY job ORDER BY score DESC, row_) = 1),
far AS (SELECT k.* FROM kept k JOIN best b USING (job) WHERE abs(k.row_ - b.row_) > (b.score + 19) // 20 QUALIFY row_number() OVER (PARTITION BY k.job ORDER BY k.score DESC, k.row_) = 1)
SELECT b.job, b.score, b.row_ AS at, coalesce(f.score, -1) AS score2, coalesce(f.row_, -1) AS at2 FROM best b LEFT JOIN far f USING (job)""",
        "region_clusters": f"""WITH x AS (SELECT l_orderkey AS read_id, CAST(s % 2 AS INT) AS strand, CAST(l_linenumber AS BIGINT) AS job, p * 7919 % 40000 AS rb, p * 7919 % 40000 + 50 + q * 40 AS re FROM {_LINES}),
y AS (SELECT *, lag(re) OVER w AS before, min(rb) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reach FROM x WINDOW w AS (PARTITION BY read_id, strand ORDER BY re, rb, job))
SELECT read_id, strand, job, CAST(sum(CASE WHEN reach >= before + 10000 THEN 1 ELSE 0 END) OVER (PARTITION BY read_id, strand ORDER BY re, rb, job) AS BIGINT) AS cluster FROM y""",
    }
