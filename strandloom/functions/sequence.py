"""Columns over sequences, CIGARs, positions and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.options import Options


def nt4(seq: Column) -> Column:
    """Upper-case ACGT; anything else is N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def revcomp(seq: Column) -> Column:
    """Reverse complement in upper case; what is no base passes through."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCATGCA")


def read_name(name: Column) -> Column:
    """Up to the first white space, without a mate suffix if something of two characters or more stands before it."""
    return F.regexp_replace(F.regexp_extract(name, r"^(\S*)", 1), r"^(.+)/[0-9]$", "$1")


def comment(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^\S*\s+(.*)$", 1), F.lit(""))


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; empty for shorter sequences."""
    return F.when(F.length(seq) >= k, F.transform(F.sequence(F.lit(0), F.length(seq) - k), lambda i: F.substring(seq, i + 1, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def fold_position(pos: Column, length: Column) -> tuple[Column, Column]:
    """Of a position in the text of both strands: forward position, whether it is reverse."""
    rev = pos >= length
    return F.when(rev, 2 * length - 1 - pos).otherwise(pos), rev


def max_gap(tail: Column, o: Options = Options()) -> Column:
    """Longest gap that a tail of that length can pay for, within twice the band."""
    of = [((tail * o.match - go) / ge + 1).cast("int") for go, ge in zip(o.gap_open, o.gap_extend, strict=True)]
    return F.least(F.greatest(F.lit(1), *of), F.lit(2 * o.band))


def infer_band(a: Column, b: Column, score: Column, gap_open: int, gap_extend: int, match: int) -> Column:
    return F.when((a == b) & (a * match - score < 2 * (gap_open + gap_extend - match)), F.lit(0)).otherwise(
        F.greatest(((F.least(a, b) * match - score - gap_open) / gap_extend + 2).cast("int"), F.abs(a - b))
    )


def mapq_se(score: Column, sub: Column, csub: Column, sub_n: Column, read_span: Column, ref_span: Column, frac_rep: Column, o: Options = Options()) -> Column:
    """Mapping quality of a single region; int() cuts towards zero."""
    best = F.greatest(F.when(sub == 0, F.lit(o.min_seed * o.match)).otherwise(sub), csub)
    span = F.greatest(read_span, ref_span).cast("double")
    identity = 1 - (span * o.match - score) / (o.match + o.mismatch) / span
    weight = F.when(span < 50, F.lit(1.0)).otherwise(3 / F.ln(span)) * identity * identity
    q = (6.02 * (score - best) / o.match * weight * weight + 0.499).cast("int")
    q = q - F.when(sub_n > 0, (4.343 * F.ln(sub_n + 1) + 0.499).cast("int")).otherwise(0)
    q = F.least(F.greatest(q, F.lit(0)), F.lit(60))
    return F.when(best >= score, F.lit(0)).otherwise((q * (1 - frac_rep) + 0.499).cast("int"))


def mate_orientation(b1: Column, b2: Column, length: Column) -> tuple[Column, Column]:
    """Orientation (0 FF, 1 FR, 2 RF, 3 RR) and distance of two positions in the text of both strands."""
    same = (b1 >= length) == (b2 >= length)
    p2 = F.when(same, b2).otherwise(2 * length - 1 - b2)
    far = F.when(p2 > b1, F.lit(0)).otherwise(F.lit(3))
    return F.when(same, F.lit(0)).otherwise(F.lit(1)).bitwiseXOR(far), F.abs(p2 - b1)


def cigar_ref_length(cigar: Column) -> Column:
    """Reference bases that array<struct<op,len>> covers."""
    return F.aggregate(F.filter(cigar, lambda c: c["op"].isin("M", "D")), F.lit(0), lambda s, c: s + c["len"])


def cigar_text(cigar: Column, hard: Column | bool = False) -> Column:
    """SAM text; clips are hard ones where hard is true."""
    is_hard = F.lit(hard) if isinstance(hard, bool) else hard
    op = lambda c: F.when(c["op"].isin("S", "H"), F.when(is_hard, F.lit("H")).otherwise(F.lit("S"))).otherwise(c["op"])
    return F.when(F.size(cigar) == 0, F.lit("*")).otherwise(F.array_join(F.transform(cigar, lambda c: F.concat(c["len"].cast("string"), op(c))), ""))


def template_length(p0: Column, p1: Column) -> Column:
    """Signed length from the 5' ends of a record and its mate."""
    return -(p0 - p1 + F.signum((p0 - p1).cast("double")).cast("long"))
