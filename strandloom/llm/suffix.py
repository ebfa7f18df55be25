"""Operator 9, suffix-array dedup: a distributed difference cover, cut off at the match length.

A byte goes when a string of LENGTH bytes that covers it also starts earlier (order: document, then start). Only the
first LENGTH bytes of suffixes matter, so the difference-cover recursion ends after two rounds:

1. Sample. Suffixes whose start is in the cover COVER modulo PERIOD are sampled. For any two starts some shift below
   PERIOD takes both into the cover, so equal strings of LENGTH bytes hold an equal sampled tuple of
   LENGTH - PERIOD + 1 bytes at the same place. Tuples are sorted in buckets and named; names that occur once are done.
2. Merge. Only suffixes within PERIOD of a repeated name remain. Their LENGTH-byte prefixes are sorted in buckets, and of
   equal neighbours the earliest is the owner: the others are repeats.

Texts are kept in files of about CHUNK bytes in the shared folder, and only hashes (4 and 8 bytes, each value once a
chunk, so that a string that is everywhere meets itself once a chunk) and answers (a bit each) move. Copies of a whole
text are found by SHA-256 first and leave the windows to the first copy. Hashes are 64 bits: two different prefixes are
taken as equal with a chance of about n * n / 2^65 for n remaining prefixes.

Nulls: a null text is empty. A null doc_id comes before all others; rows that repeat an id are ordered by the digest of
the chunk that they fall into, then by text. Ids are whole numbers. A text of any length stays in one chunk, whose task has to
hold it. Texts under LENGTH bytes lose nothing. Empty input gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import new_path, stored
from strandloom.llm.warc import open_fs

LENGTH, CHUNK, BUCKET, SLICE = 100, 8 << 20, 16 << 20, 1 << 19
#: A perfect difference set, every residue is a difference of two members.
PERIOD, COVER = 57, (1, 6, 7, 9, 19, 38, 42, 49)
TUPLE = LENGTH - PERIOD + 1
_BASE = 0x9E3779B97F4A7C15 | 1
_FIRST = np.iinfo(np.int64).min


@functools.lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, and a random number for each byte."""
    n = SLICE + LENGTH + 1
    out = []
    for r in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(n, np.uint64)
        p[1:] = np.uint64(r)
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1], np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64)


def hashes(buf: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of the size bytes from each place; places rise."""
    power, inverse, byte = _powers()
    out = np.empty(len(at), np.uint64)
    a = 0
    while a < len(at):
        first = int(at[a])
        z = int(np.searchsorted(at, first + SLICE))
        local = at[a:z] - first
        part = buf[first : int(at[z - 1]) + size]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte[part] * power[: len(part)], out=sums[1:])
        h = (sums[local + size] - sums[local]) * inverse[local]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[a:z] = h ^ (h >> np.uint64(32))
        a = z
    return out


class Chunk:
    """A file's texts, in the order of their ids."""

    def __init__(self, path: str, folder: str, copies: list[int] | None):
        system, _ = open_fs(folder)
        with system.open_input_file(path) as f:
            table = pa.ipc.open_file(f).read_all()
        self.ids = table.column("doc_id").to_pylist()
        texts = table.column("text").to_pylist()
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64) if texts else self.sizes
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        self.copy = np.zeros(len(texts), bool)
        self.copy[copies or []] = True

    def own(self) -> Iterator[tuple[int, int, int]]:
        for k in np.flatnonzero((self.sizes >= LENGTH) & ~self.copy).tolist():
            yield k, int(self.starts[k]), int(self.sizes[k])

    def sampled(self) -> np.ndarray:
        most = int(self.sizes.max(initial=0))
        pattern = np.arange(most)
        pattern = pattern[np.isin(pattern % PERIOD, COVER)]
        parts = [pattern[: np.searchsorted(pattern, size - TUPLE, "right")] + start for _, start, size in self.own()]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        at = self.sampled()
        return at, hashes(self.buf, at, TUPLE)

    def remaining(self, at: np.ndarray, repeated: np.ndarray) -> np.ndarray:
        """Starts within PERIOD before a repeated name whose prefix lies in the text."""
        near = np.zeros(len(self.buf) + 1, np.int32)
        a = at[repeated]
        np.add.at(near, np.maximum(a - PERIOD + 1, 0), 1)
        near[a + 1] -= 1
        fits = np.zeros(len(self.buf) + 1, np.int8)
        for _, start, size in self.own():
            fits[start] += 1
            fits[start + size - LENGTH + 1] -= 1
        return np.flatnonzero((np.cumsum(near[:-1]) > 0) & (np.cumsum(fits[:-1]) > 0))


def _ask(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each value, and the values' order by bucket, then as they are."""
    bucket = ((values >> np.uint64(33)) % np.uint64(n)).astype(np.int64)
    return bucket, np.argsort(bucket, kind="stable")


def _name_keys(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names, their number in the chunk, the name of each place, and the bucket."""
    keys, at, count = np.unique(h, return_inverse=True, return_counts=True)
    return keys, count, at, _ask(keys, n)[0]


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has any, and the places of its values in their order: one sort, whatever the number of buckets."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)).tolist()
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[order[a]]), order[a:z]


def write_chunks(docs: DataFrame, folder: str) -> DataFrame:
    """chunk (a path), place, doc_id, sha, n_bytes for each text; texts go to files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_fs(folder)
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            held.sort(key=lambda x: (_FIRST if x[0] is None else x[0], x[1]))
            system.create_dir(top, recursive=True)
            # What a chunk holds comes first in its name, so that the order of repeated ids doesn't change from run to run.
            mark = hashlib.sha256(b"".join(hashlib.sha256(x[1]).digest() for x in held)).hexdigest()[:16]
            path = f"{top}/{mark}-{uuid.uuid4().hex}.arrow"
            table = pa.table({"doc_id": pa.array([x[0] for x in held], pa.int64()), "text": pa.array([x[1] for x in held], pa.large_binary())})
            with system.open_output_stream(path, compression=None) as f, pa.ipc.new_file(f, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            columns = [pa.array([path] * len(held)), pa.array(range(len(held)), pa.int32()), table.column("doc_id").combine_chunks(), pa.array([hashlib.sha256(x[1]).digest() for x in held], pa.binary()), pa.array([len(x[1]) for x in held], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "place", "doc_id", "sha", "n_bytes"])

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                held.append((i, (t or "").encode()))
                size += len(held[-1][1])
                if size >= CHUNK:
                    yield close()
                    size = 0
        if held:
            yield close()

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "chunk string, place int, doc_id long, sha binary, n_bytes long"), "suffix-texts")


def copies(texts: DataFrame) -> DataFrame:
    """chunk, copies: places of texts that a text before them equals."""
    long = texts.filter(F.col("n_bytes") >= LENGTH)
    key = F.struct(F.coalesce("doc_id", F.lit(_FIRST)).alias("d"), F.col("chunk"), F.col("place"))
    first = long.groupBy("sha").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return long.join(first, "sha").filter(key != F.col("_first")).groupBy("chunk").agg(F.collect_list("place").alias("copies"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each text."""
    spark = docs.sparkSession
    folder = new_path(spark, "suffix-chunks")
    texts = write_chunks(docs, folder)
    total, n_chunks = texts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count_distinct("chunk")).first()
    n_buckets, n_tasks = max(1, -(-total // BUCKET)), max(1, min(n_chunks, 20_000))
    chunks = stored(texts.select("chunk").distinct().join(copies(texts), "chunk", "left"), "suffix-copies")

    def rows(b: pa.RecordBatch) -> Iterator[dict]:
        yield from b.to_pylist()

    def answers(row: dict, name: str) -> dict[int, np.ndarray]:
        return {x["bucket"]: np.unpackbits(np.frombuffer(x["bits"], np.uint8), bitorder="little") for x in row[name] or []}

    def named(c: Chunk, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Places of the remaining prefixes."""
        at, h = c.names()
        keys, count, of, bucket = _name_keys(h, n_buckets)
        bits = answers(row, "names")
        repeated = count > 1
        for k, own in _by_bucket(bucket):
            repeated[own] |= bits[k][: len(own)].astype(bool)
        left = c.remaining(at, repeated[of])
        return left, hashes(c.buf, left, LENGTH)

    def firsts(h: np.ndarray) -> np.ndarray:
        """Of each distinct value the first place, in the order of places."""
        return np.sort(np.unique(h, return_index=True)[1])

    def ask_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows(b):
                keys, _, _, bucket = _name_keys(Chunk(row["chunk"], folder, row["copies"]).names()[1], n_buckets)
                for k, own in _by_bucket(bucket):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([row["chunk"]]), pa.array([keys[own].astype(np.uint32).tobytes()], pa.binary())], names=["bucket", "chunk", "names"])

    def answer_names(t: pa.Table) -> pa.Table:
        """A name's bit is set when another chunk has it as well. Names are cut to 32 bits: chance meetings only leave more to step 2."""
        parts = [np.frombuffer(x, np.uint32) for x in t.column("names").to_pylist()]
        every = np.concatenate(parts)
        keys, count = np.unique(every, return_counts=True)
        twice = keys[count > 1]
        bits = [np.packbits(np.isin(p, twice, assume_unique=False), bitorder="little").tobytes() for p in parts]
        return pa.table({"chunk": t.column("chunk"), "bucket": t.column("bucket"), "bits": pa.array(bits, pa.binary())})

    def ask_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows(b):
                c = Chunk(row["chunk"], folder, row["copies"])
                left, h = named(c, row)
                first = firsts(h)
                bucket, order = _ask(h[first], n_buckets)
                doc = np.searchsorted(c.starts, left[first], "right") - 1
                # Empty texts share a start with the one after them; the last of these is meant.
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    own = order[cuts[k] : cuts[k + 1]]
                    docs_, n = np.unique(doc[own], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int64()), pa.array([row["chunk"]]), pa.array([h[first][own].tobytes()], pa.binary()), pa.array([np.array([_FIRST if c.ids[d] is None else c.ids[d] for d in docs_.tolist()], np.int64).tobytes()], pa.binary()), pa.array([n.astype(np.int32).tobytes()], pa.binary())],
                        names=["bucket", "chunk", "prefixes", "ids", "counts"],
                    )

    def answer_prefixes(t: pa.Table) -> pa.Table:
        """A prefix's bit is set when another chunk has it in an earlier text."""
        chunk = t.column("chunk").to_pylist()
        order = sorted(range(len(chunk)), key=chunk.__getitem__)
        parts = [np.frombuffer(t.column("prefixes")[i].as_py(), np.uint64) for i in order]
        ids = [np.repeat(np.frombuffer(t.column("ids")[i].as_py(), np.int64), np.frombuffer(t.column("counts")[i].as_py(), np.int32)) for i in order]
        every = np.concatenate(parts)
        by = np.lexsort((np.concatenate(ids), every))  # stable: for one id the chunks' order
        later = np.zeros(len(every), bool)
        later[by[1:]] = every[by[1:]] == every[by[:-1]]
        ends = np.cumsum([len(p) for p in parts])
        bits = [np.packbits(later[e - len(p) : e], bitorder="little").tobytes() for p, e in zip(parts, ends.tolist(), strict=True)]
        return pa.table({"chunk": pa.array([chunk[i] for i in order]), "bucket": t.column("bucket").take(pa.array(order)), "bits": pa.array(bits, pa.binary())})

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in rows(b):
                c = Chunk(row["chunk"], folder, row["copies"])
                left, h = named(c, row)
                first = firsts(h)
                bucket, order = _ask(h[first], n_buckets)
                repeat = np.ones(len(h), bool)
                repeat[first] = False
                bits = answers(row, "prefixes")
                cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    own = order[cuts[k] : cuts[k + 1]]
                    repeat[first[own]] = bits[k][: len(own)].astype(bool)
                near = np.zeros(len(c.buf) + 1, np.int32)
                a = left[repeat]
                near[a] += 1
                near[a + LENGTH] -= 1
                gone = np.cumsum(near[:-1]) > 0
                out: list[list] = [[], [], [], []]
                for k, (start, size) in enumerate(zip(c.starts.tolist(), c.sizes.tolist(), strict=True)):
                    x = np.ones(size, bool) if c.copy[k] else gone[start : start + size]
                    spans = int(x[0]) + int(np.count_nonzero(x[1:] & ~x[:-1])) if size else 0
                    for column, v in zip(out, (size, int(x.sum()), spans, hashlib.sha256(c.buf[start : start + size][~x].tobytes()).hexdigest()), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c.ids, pa.int64()), *(pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def told(df: DataFrame, found: DataFrame, name: str) -> DataFrame:
        """Each chunk with its answers; as many tasks as chunks, since what a chunk costs isn't seen in its row's size."""
        return df.join(found.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias(name)), "chunk", "left").repartition(n_tasks, "chunk")

    answer = "chunk string, bucket long, bits binary"
    asked = chunks.repartition(n_tasks, "chunk").mapInArrow(ask_names, "bucket long, chunk string, names binary")
    names = stored(asked.groupBy("bucket").applyInArrow(answer_names, answer), "suffix-names")
    asked = told(chunks, names, "names").mapInArrow(ask_prefixes, "bucket long, chunk string, prefixes binary, ids binary, counts binary")
    prefixes = stored(asked.groupBy("bucket").applyInArrow(answer_prefixes, answer), "suffix-prefixes")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    last = chunks.join(names.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("names")), "chunk", "left")
    return told(last, prefixes, "prefixes").mapInArrow(remove, schema)
