"""Text of alignment records, with or without mates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import cigar_ref_length, cigar_text, revcomp, template_length
from strandloom.operators.mates import alt_share, supplementary_tags

CIGAR = "array<struct<op:string,len:int>>"
#: Flag bit of a further record that is to be written as a secondary one, with its bases.
AS_SECONDARY = 0x10000


def _clip(cigar: Column, place: int) -> Column:
    """Length of the clip at an end, 0 if there is none."""
    op = F.try_element_at(cigar, F.lit(place))
    return F.when(op["op"].isin("S", "H"), op["len"]).otherwise(F.lit(0))


def _tag(name: str, value: Column | str) -> Column:
    """The tag, or null if its value is."""
    return F.concat(F.lit(f"{name}:"), F.col(value).cast("string") if isinstance(value, str) else value.cast("string"))


def record_lines(records: DataFrame, soft: bool = False, group: str | None = None) -> DataFrame:
    """qname, mate, record, line.

    records: qname, mate (0, 1, or null for reads without mates), record (from 0 in a read, its best first), flag (bits that
    are settled: end of the pair, proper pair, secondary, supplementary), contig (null: unmapped), pos (from 0), is_rev,
    is_alt, mapq, cigar, nm, md, score, sub (-1: none), alt_score (0: none), xa, seq, qual (both as sequenced), comment.
    soft: clips of further records stay soft. group: read group id. An unmapped read stands at its mate's place, without a
    CIGAR. A secondary record has no bases.
    """
    none = F.lit(None).cast(CIGAR)
    records = records.withColumn("cigar", F.when(F.col("contig").isNotNull(), F.col("cigar")))
    # By the columns that the mates are joined by: records are shuffled once for both.
    named = supplementary_tags(records, ["qname", "mate"])
    first = records.filter("record = 0").select("qname", (1 - F.col("mate")).alias("mate"), F.struct("contig", "pos", "is_rev", "is_alt", "cigar").alias("_m"))
    df = named.join(first.hint("merge"), ["qname", "mate"], "left")
    paired, lost, mate_lost = F.col("_m").isNotNull(), F.col("contig").isNull(), F.col("_m").isNotNull() & F.col("_m.contig").isNull()
    # Each end that isn't mapped borrows the other's place.
    df = df.withColumns({
        "_paired": paired, "_lost": lost, "_mate_lost": mate_lost,
        "_contig": F.coalesce("contig", "_m.contig"), "_pos": F.when(lost, F.col("_m.pos")).otherwise(F.col("pos")), "_rev": F.when(lost & F.col("_m.contig").isNotNull(), F.col("_m.is_rev")).otherwise(F.col("is_rev")),
        "_ops": F.coalesce(F.when(lost, none).otherwise(F.col("cigar")), F.array().cast(CIGAR)), "_mate_ops": F.coalesce(F.when(mate_lost, none).otherwise(F.col("_m.cigar")), F.array().cast(CIGAR)),
    })
    df = df.withColumns({"_mate_contig": F.when(F.col("_paired"), F.coalesce("_m.contig", "_contig")), "_mate_pos": F.when(F.col("_mate_lost"), F.col("_pos")).otherwise(F.col("_m.pos")), "_mate_rev": F.when(F.col("_mate_lost") & ~F.col("_lost"), F.col("_rev")).otherwise(F.coalesce("_m.is_rev", F.lit(False)))})
    further = (F.col("record") != 0) & F.lit(not soft)
    hard, secondary = further & ~F.col("is_alt"), F.col("flag").bitwiseAND(0x100) != 0
    bit = lambda c, n: F.when(F.col(c), n).otherwise(0)
    flag = F.col("flag").bitwiseAND(0xFFFF).bitwiseOR(F.when(F.col("flag").bitwiseAND(AS_SECONDARY) != 0, 0x100).otherwise(0))
    for c, n in (("_paired", 1), ("_lost", 4), ("_mate_lost", 8), ("_rev", 16), ("_mate_rev", 32)):
        flag = flag.bitwiseOR(bit(c, n))
    ops, mate_ops = F.col("_ops"), F.col("_mate_ops")
    five = lambda pos, rev, c: pos + F.when(rev, cigar_ref_length(c) - 1).otherwise(0)
    both = (F.col("_contig") == F.col("_mate_contig")) & (F.size(ops) > 0) & (F.size(mate_ops) > 0)
    tlen = F.when(both, template_length(five(F.col("_pos"), F.col("_rev"), ops), five(F.col("_mate_pos"), F.col("_mate_rev"), mate_ops))).otherwise(F.lit(0))
    place = F.when(F.col("_contig").isNull(), F.lit("*\t0\t0\t*")).otherwise(F.concat_ws("\t", "_contig", (F.col("_pos") + 1).cast("string"), F.col("mapq").cast("string"), cigar_text(ops, hard)))
    mate = F.when(F.col("_mate_contig").isNull(), F.lit("*\t0\t0")).otherwise(F.concat_ws("\t", F.when(F.col("_contig") == F.col("_mate_contig"), "=").otherwise(F.col("_mate_contig")), (F.col("_mate_pos") + 1).cast("string"), tlen.cast("string")))
    # Clips are in the order of the reference, the bases in that of the read.
    lead, tail = (F.when(hard, F.when(F.col("_rev"), _clip(ops, b)).otherwise(_clip(ops, a))).otherwise(F.lit(0)) for a, b in ((1, -1), (-1, 1)))
    cut = lambda c: F.substring(F.col(c), lead + 1, F.length(c) - lead - tail)
    seq = F.when(F.col("_rev"), revcomp(cut("seq"))).otherwise(cut("seq"))
    qual = F.when(F.coalesce(F.length("qual"), F.lit(0)) == 0, "*").when(F.col("_rev"), F.reverse(cut("qual"))).otherwise(cut("qual"))
    mapped = F.size(ops) > 0
    tags = [
        F.when(mapped, _tag("NM:i", "nm")), F.when(mapped, _tag("MD:Z", "md")), F.when(F.size(mate_ops) > 0, _tag("MC:Z", cigar_text(mate_ops, further & ~F.col("_m.is_alt")))),
        F.when(F.col("score") >= 0, _tag("AS:i", "score")), F.when(F.col("sub") >= 0, _tag("XS:i", "sub")), F.lit(f"RG:Z:{group}" if group else None).cast("string"), _tag("SA:Z", "sa"),
        F.when(~secondary & (F.col("alt_score") > 0), _tag("pa:f", alt_share(F.col("score"), F.col("alt_score")))), _tag("XA:Z", "xa"), F.col("comment"),
    ]
    bases = F.when(secondary, F.lit("*\t*")).otherwise(F.concat_ws("\t", seq, qual))
    return df.select("qname", "mate", "record", F.concat_ws("\t", "qname", flag.cast("string"), place, mate, bases, *tags).alias("line"))
