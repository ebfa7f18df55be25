"""Minimizers of long texts: a map-only sketch, and placements of reads by the diagonals of shared ones.

Texts are cut into blocks that overlap by a window, so no row holds a contig's k-mers and nothing but the blocks is
shuffled. All places that hold the smallest hash of some window are kept, ties included. The hash is the published
invertible integer hash of 2k bits, of whichever of a k-mer and its reverse complement is smaller; k is odd, so they differ.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators import mapped
from strandloom.operators.cutting import pieces
from strandloom.sources.shared import new_path

#: References of more bases are looked up in files that workers map; bases of a file.
LARGE, FILE = 1 << 20, 1 << 22
BLOCK = 4096
#: Bases hashed at a time, and what stands for no hash.
AT_ONCE, NONE = 1 << 18, np.int64(1) << 62
CODES = np.full(256, 4, np.int64)
CODES[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def _hashed(v: np.ndarray, bits: int) -> np.ndarray:
    """Invertible hash of numbers of that many bits (30 at most), in place of a new array for each step."""
    mask = np.int64((1 << bits) - 1)
    v = (~v + (v << 21)) & mask
    v ^= v >> 24
    v = (v + (v << 3) + (v << 8)) & mask
    v ^= v >> 14
    v = (v + (v << 2) + (v << 4)) & mask
    v ^= v >> 28
    return (v + (v << 31)) & mask


def _chosen(data: np.ndarray, sizes: np.ndarray, lead: np.ndarray, start: np.ndarray, n: np.ndarray, k: int, w: int, size: int) -> tuple[np.ndarray, ...]:
    """Of pieces that lie behind each other in data: row, pos, strand and hash of their minimizers."""
    pad = k + w  # what is no base parts the pieces, so no window reaches another one
    ends = np.cumsum(sizes + pad)
    begins = ends - sizes - pad
    total = int(ends[-1])
    row = np.repeat(np.arange(len(sizes)), sizes + pad)
    within = np.arange(total) - begins[row]
    codes = np.full(total, 4, np.int64)
    codes[within < sizes[row]] = CODES[data]
    m = total - k + 1
    fore, back, bad = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, bool)
    for j in range(k):
        c = codes[j : j + m]
        bad |= c > 3
        c = c & 3
        fore = (fore << 2) | c
        back |= (3 - c) << (2 * j)
    code = np.minimum(_hashed(fore, 2 * k) * 2, _hashed(back, 2 * k) * 2 + 1)
    code[bad] = NONE
    row, within = row[:m], within[:m]
    place, own = lead[row] + within, within <= sizes[row] - k
    low = code.copy()
    for j in range(1, w):
        np.minimum(low[: m - j], code[j:], out=low[: m - j])
    low[~own | (low == NONE) | (place > np.maximum(n - w, 0)[row])] = -1
    low >>= 1
    top = low.copy()
    for j in range(1, w):
        np.maximum(top[j:], low[: m - j], out=top[j:])
    at = np.flatnonzero(own & (code != NONE) & (code >> 1 == top) & (place >= start[row]) & (place < start[row] + size))
    return row[at], place[at], (code[at] & 1).astype(np.int32), top[at]


def minimizers(texts: DataFrame, by: Sequence[str], k: int = 15, w: int = 10, size: int = BLOCK) -> DataFrame:
    """by, pos, strand (1: the reverse complement's hash is smaller), hash. texts: by, seq.

    A text of fewer than w k-mers is one window; null and shorter ones have none. k-mers with other letters count as
    places without a hash.
    """
    if k % 2 == 0 or not 1 <= k <= 15 or w < 1:
        raise ValueError("k is odd and at most 15, w at least 1")
    by = list(by)
    df = pieces(texts.filter(F.length("seq") >= k).select(*by, F.upper("seq").alias("seq")), by, size, w - 1, w + k - 2, k - 1)
    schema = T.StructType([*(df.schema[c] for c in by), T.StructField("pos", T.LongType()), T.StructField("strand", T.IntegerType()), T.StructField("hash", T.LongType())])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [s.encode("ascii", "replace") for s in b.column("piece").to_pylist()]
            sizes = np.array([len(s) for s in seqs], np.int64)
            group = np.cumsum(sizes) // AT_ONCE
            start, n = (b.column(c).to_numpy().astype(np.int64) for c in ("start", "length"))
            for g in np.unique(group):
                a, z = np.searchsorted(group, [g, g + 1])
                lead = np.maximum(start[a:z] - (w - 1), 0)
                row, pos, strand, top = _chosen(np.frombuffer(b"".join(seqs[a:z]), np.uint8), sizes[a:z], lead, start[a:z], n[a:z] - k + 1, k, w, size)
                at = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in by), pa.array(pos), pa.array(strand), pa.array(top)], names=schema.names)

    return df.mapInArrow(sketch, schema)


def minimizer_places(reads: DataFrame, index: DataFrame, most: int, band: int = 64) -> DataFrame:
    """read_id, contig, strand, band, n: the band of diagonals (2 * band wide, each half shared) with most shared minimizers.

    index: of minimizers. Hashes at more than most of its places are left out, as the method has it. Ties go to the first
    contig, strand and band.
    """
    # Spark takes the counts for small, because it sees the size of the texts' tables only, and would send all of them through the driver.
    rare = index.join(index.groupBy("hash").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") <= most).select("hash").hint("merge"), "hash")
    r = rare.select("hash", "contig", F.col("pos").alias("_r"), F.col("strand").alias("_s"))
    hits = reads.join(r.hint("merge"), "hash").select("read_id", "contig", (F.col("strand") != F.col("_s")).cast("int").alias("strand"), F.when(F.col("strand") == F.col("_s"), F.col("_r") - F.col("pos")).otherwise(F.col("_r") + F.col("pos")).alias("_d"))
    at = F.floor(F.col("_d") / band)
    counted = hits.withColumn("band", F.explode(F.array(at - 1, at))).groupBy("read_id", "contig", "strand", "band").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("read_id").agg(F.min_by(F.struct("contig", "strand", "band", "n"), F.struct(-F.col("n"), "contig", "strand", "band")).alias("b"))
    return best.select("read_id", "b.*")


def placed(reads: DataFrame, ref: DataFrame, k: int, w: int, most: int, band: int = 64) -> DataFrame:
    """minimizer_places of reads (read_id, seq) on ref (contig, seq).

    Over a large reference its rare minimizers are sorted into files of the shared folder and reads look them up where they
    are sketched, so neither their minimizers nor the hits are shuffled.
    """
    spark = reads.sparkSession
    lengths = sorted((r["contig"], r["n"]) for r in ref.filter("seq is not null").select("contig", F.length("seq").alias("n")).collect())
    total = sum(n for _, n in lengths)
    if total <= LARGE or not mapped.folder(spark):
        return minimizer_places(minimizers(reads, ["read_id"], k, w), minimizers(ref, ["contig"], k, w), most, band)
    names = [c for c, _ in lengths]
    number = {c: i for i, c in enumerate(names)}
    path = urlparse(new_path(spark, "minimizers")).path
    os.makedirs(path)
    bits = min(2 * k, max(6, (total // FILE).bit_length()))
    shift = 2 * k - bits

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = b.column("contig").dictionary_encode()
            contig = np.array([number[c] for c in kinds.dictionary.to_pylist()], np.int64)[kinds.indices.to_numpy()]
            code = (contig << 33) | (b.column("strand").to_numpy().astype(np.int64) << 32) | b.column("pos").to_numpy()
            h = b.column("hash").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((h >> shift).astype(np.int32)), pa.array(h.astype(np.int32)), pa.array(code)], names=["part", "hash", "code"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("hash").to_numpy(), b.column("code").to_numpy()) for b in batches if b.num_rows]
        if held:
            h, code = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((code, h))
            h, code = h[order], code[order]
            first = np.flatnonzero(np.diff(h, prepend=-1) != 0)
            size = np.diff(np.append(first, len(h)))
            rare = np.repeat(size <= most, size)
            h, code = h[rare], code[rare]
            for part in np.unique(h >> shift).tolist():
                a, z = np.searchsorted(h >> shift, [part, part + 1])
                h[a:z].tofile(f"{path}/hash-{part}")
                code[a:z].tofile(f"{path}/code-{part}")
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32())], names=["done"])

    parts = max(1 << bits, int(spark.conf.get("spark.sql.shuffle.partitions")))
    minimizers(ref, ["contig"], k, w).select("contig", "pos", "strand", "hash").mapInArrow(coded, "part int, hash int, code long").repartition(parts, "part").mapInArrow(written, "done int").collect()
    schema = T.StructType([reads.schema["read_id"], ref.schema["contig"], T.StructField("strand", T.IntegerType()), T.StructField("band", T.LongType()), T.StructField("n", T.LongType())])

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _files(path, 1 << bits)
        for b in batches:
            seqs = [s.encode("ascii", "replace") for s in b.column("seq").to_pylist()]
            sizes = np.array([len(s) for s in seqs], np.int64)
            group = np.cumsum(sizes) // AT_ONCE
            for g in np.unique(group):
                a, z = np.searchsorted(group, [g, g + 1])
                none, longest = np.zeros(z - a, np.int64), int(sizes[a:z].max())
                row, pos, strand, h = _chosen(np.frombuffer(b"".join(seqs[a:z]), np.uint8), sizes[a:z], none, none, sizes[a:z] - k + 1, k, w, longest)
                order = np.argsort(h, kind="stable")
                row, pos, strand, h = row[order], pos[order], strand[order], h[order]
                found: list[tuple[np.ndarray, ...]] = []
                ends = np.searchsorted(h >> shift, np.arange((1 << bits) + 1))
                for part in np.flatnonzero(np.diff(ends)).tolist():
                    if files[part] is None:
                        continue
                    s = slice(int(ends[part]), int(ends[part + 1]))
                    hashes, codes = files[part]
                    low, high = (np.searchsorted(hashes, h[s].astype(np.int32), side) for side in ("left", "right"))
                    n = high - low
                    i = np.repeat(np.arange(s.start, s.stop), n)
                    found.append((i, codes[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(i))]))
                if not found or not sum(len(x[0]) for x in found):
                    continue
                i, code = (np.concatenate(x) for x in zip(*found, strict=True))
                other = ((code >> 32) & 1) != strand[i]
                at = (code & ((1 << 32) - 1)) + np.where(other, pos[i], -pos[i])
                at = np.floor_divide(at, band)
                # No diagonal lies further before a text than a read is long.
                base = longest // band + 3
                key = (((row[i] * len(names) + (code >> 33)) * 2 + other) << 33) | (at + base)
                key, n = np.unique(np.concatenate([key, key - 1]), return_counts=True)
                which = (key >> 33) // (2 * len(names))
                best = np.lexsort((key, -n, which))
                best = best[np.diff(which[best], prepend=-1) != 0]
                key, n, which = key[best], n[best], which[best]
                contig = pa.array(names, pa.string()).take(pa.array((key >> 34) % len(names)))
                yield pa.RecordBatch.from_arrays([b.column("read_id").take(pa.array(which + a)), contig, pa.array(((key >> 33) & 1).astype(np.int32)), pa.array((key & ((1 << 33) - 1)) - base), pa.array(n.astype(np.int64))], names=schema.names)

    return reads.filter(F.length("seq") >= k).select("read_id", F.upper("seq").alias("seq")).mapInArrow(looked_up, schema)


@functools.lru_cache(2)
def _files(path: str, parts: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Hashes and codes of each part, mapped; None where it has none."""
    there = lambda p: os.path.exists(f"{path}/code-{p}")
    return [(np.asarray(np.memmap(f"{path}/hash-{p}", np.int32, "r")), np.asarray(np.memmap(f"{path}/code-{p}", np.int64, "r"))) if there(p) else None for p in range(parts)]
