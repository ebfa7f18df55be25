"""Operator 6 at a stated similarity: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more link.

At that similarity fingerprints differ in about 15% of their bits, too many to cut fingerprints into blocks that agree.
Shards are keyed by BANDS hashes of BAND min-hashes of the shingle set instead: a pair of similarity s misses all shards
with probability (1 - s ** BAND) ** BANDS, 2.5e-6 at 0.8, and one of 0.3 (texts that share a passage) meets in half a
shard. In a shard, BK-trees over fingerprints of 256 bits hold its parts (classes linked so far): one tree for each part
and one for all classes without a link. A search follows only edges within RADIUS, which is five standard deviations over
the mean distance at 0.8 even for texts of five shingles (seven for long ones; unrelated texts lie six beyond it), and
leaves a part at its first link. Whoever a search finds is compared by whole shingle sets: fingerprints choose whom to
compare and never link by themselves. A dense group so costs little more than a search a class, and emits fewer links
than it has classes. Components are closed over links.

Equal sets are one class, and only classes travel. Sets are hashed once, in the pass that marks the texts, and stored
with the marks (4 bytes a shingle, a class once a task), so no text is shuffled to be compared. Shards of the same classes
are searched once. A shard of over ROWS classes or BYTES of sets is dealt into blocks, and each pair of blocks is a task's
work, so none of its pairs is lost.

The rows that go are named by their ids. Up to FEW of them are sent to every task, so texts stay where they are; more
are joined by a shuffle. The same holds for shards and for classes that are compared, so sets of other classes stay where
they are. Tables that nothing reads any more are deleted.

Nulls: a null text is empty; texts without words are copies of each other; null ids rank last. Rows that repeat an id, or
have none, are told apart by their classes. Empty input gives an empty result. Texts of any length are hashed whole.
Columns of docs may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import as_row, discard, per_row, sent_if_small, stored, unused
from strandloom.llm.simhash import BKTree, components, majority, shingle_hashes

WORDS, SIMILARITY, BAND, BANDS, RADIUS = 5, 0.8, 3, 18, 80
#: Distance within which a link is likely: such fingerprints are looked at first.
LIKELY = 38
ROWS, BYTES, FEW = 16_000, 64 << 20, 1 << 21
#: Odd multipliers of the min-hashes.
FACTORS = np.array([xxhash.xxh64_intdigest(f"min-hash {i}") | 1 for i in range(BAND * BANDS)], np.uint64)
#: Odd multipliers that turn a shingle's hash into the four words of a 256-bit fingerprint.
WIDEN = np.array([xxhash.xxh64_intdigest(f"fingerprint word {i}") | 1 for i in range(4)], np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text, words))


def class_of(hashes: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(hashes.tobytes())


def wide(hashes: np.ndarray) -> bytes:
    """256-bit SimHash of a shingle set."""
    mixed = hashes * WIDEN[:, None]
    return np.array([majority(m) for m in mixed ^ (mixed >> np.uint64(32))], np.int64).tobytes()


def bands(hashes: np.ndarray) -> list[int]:
    """The shards of a shingle set; none for the empty one."""
    if not len(hashes):
        return []
    mins = np.array([(hashes * f).min() for f in FACTORS], np.uint64).reshape(BANDS, BAND)
    return [xxhash.xxh64_intdigest(m.tobytes(), k) - (1 << 63) for k, m in enumerate(mins)]


def near_size(a: int, b: int, similarity: float) -> bool:
    """Whether sets of these sizes can reach the similarity; with room for hashes that fall together when cut to 32 bits."""
    return 1.001 * min(a, b) + 1 >= similarity * max(a, b)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    every = np.concatenate((a, b))
    every.sort()
    both = np.count_nonzero(every[1:] == every[:-1])
    return both / max(1, len(a) + len(b) - both)


def _marks(words: int) -> Callable:
    """Class of each text, and what is known of the class where the task sees it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            rows: list[tuple] = []
            for t in b.column("text").to_pylist():
                h = shingle_set(t, words)
                node = class_of(h)
                if node in seen:
                    rows.append((node, None, None, None, None))
                else:
                    seen.add(node)
                    rows.append((node, len(h), bands(h), wide(h), np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes()))
            kinds = (pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "node", "n", "shards", "fp", "hashes"])

    return run


class Part:
    """A BK-tree of fingerprints with the classes that have them."""

    def __init__(self) -> None:
        self.tree: BKTree | None = None
        self.at: dict[int, list[int]] = {}

    def add(self, fp: int, e: int) -> None:
        if fp in self.at:
            self.at[fp].append(e)
            return
        self.at[fp] = [e]
        if self.tree:
            self.tree.add(fp)
        else:
            self.tree = BKTree(fp)

    def take(self, fp: int, e: int) -> None:
        """Takes a class out; its fingerprint stays as a branch of the tree."""
        self.at[fp].remove(e)

    def near(self, fp: int, radius: int) -> Iterator[int]:
        """Classes within the radius, likely ones first."""
        if self.tree:
            for low, r in ((-1, min(LIKELY, radius)), (LIKELY, radius)):
                for f in self.tree.within(fp, r):
                    if (f ^ fp).bit_count() > low:
                        yield from self.at[f]


class Shard:
    """The parts of a shard, with the sets of their classes."""

    def __init__(self, similarity: float = SIMILARITY, radius: int = RADIUS):
        self.similarity, self.radius = similarity, radius
        self.single, self.parts = Part(), list[Part]()
        self.nodes: list[bytes] = []
        self.fps: list[int] = []
        self.sets: list[np.ndarray] = []

    def alike(self, hashes: np.ndarray, e: int) -> bool:
        return near_size(len(hashes), len(self.sets[e]), self.similarity) and jaccard(hashes, self.sets[e]) >= self.similarity

    def links(self, node: bytes, fp: int, hashes: np.ndarray, search: bool = True, add: bool = True) -> list[bytes]:
        """Earlier classes that link to this one: one of each part, and all without a part."""
        found: list[int] = []
        if search:
            joined = []
            for part in self.parts:
                e = next((e for e in part.near(fp, self.radius) if self.alike(hashes, e)), None)
                if e is not None:
                    found.append(e)
                    joined.append(part)
            lone = [e for e in self.single.near(fp, self.radius) if self.alike(hashes, e)]
            if joined or lone and (add or len(lone) > 1):
                into = max(joined, key=lambda p: len(p.at), default=None)
                if into is None:
                    into = Part()
                    self.parts.append(into)
                for part in joined:
                    if part is not into:
                        self.parts.remove(part)
                        for f, es in part.at.items():
                            for e in es:
                                into.add(f, e)
                for e in lone:
                    self.single.take(self.fps[e], e)
                    into.add(self.fps[e], e)
                home = into
            else:
                home = self.single
            found += lone
        else:
            home = self.single
        if add:
            self.nodes.append(node)
            self.fps.append(fp)
            self.sets.append(hashes)
            home.add(fp, len(self.nodes) - 1)
        return [self.nodes[e] for e in found]


def _link(similarity: float) -> Callable:
    """Links within each run of rows of one shard and pair of blocks; side 0 comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, Shard(similarity)
        for batch in batches:
            found: list[tuple[bytes, bytes]] = []
            for s, i, j, side, node, fp, hashes in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if now != (s, i, j):
                    now, shard = (s, i, j), Shard(similarity)
                found += ((min(node, x), max(node, x)) for x in shard.links(node, int.from_bytes(fp, "little"), np.frombuffer(hashes, np.uint32), i == j or side == 1, i == j or side == 0) if x != node)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in range(2)], names=["a", "b"])

    return run


def _sizes(members: DataFrame) -> DataFrame:
    """Shards of two or more classes, one of those that hold the same ones. members: node, n, s."""
    each = members.groupBy("s").agg(F.count(F.lit(1)).alias("rows"), (4 * F.sum("n")).alias("bytes"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    each = each.filter("rows > 1").groupBy("rows", "x", "y").agg(F.min("s").alias("s"), F.first("bytes").alias("bytes"))
    return stored(each.select("s", "rows", "bytes", F.ceil(F.greatest(F.col("rows") / ROWS, F.col("bytes") / BYTES)).cast("int").alias("blocks")), "near-shards")


def work(classes: DataFrame) -> DataFrame:
    """node, s, i, j, side: the shards, and pairs of their blocks, that a class is compared in."""
    keys, zero = classes.select("node", "n", F.explode("shards").alias("s")), F.lit(0)
    dealt = keys.select("node", "s").join(sent_if_small(_sizes(keys), FEW), "s").withColumn("r", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    return dealt.select("node", "s", F.least("r", "o").alias("i"), F.greatest("r", "o").alias("j"), F.when(F.col("r") <= F.col("o"), 0).otherwise(1).alias("side"))


def near_links(marked: DataFrame, classes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b) between classes, enough to connect every component."""
    places = work(classes).groupBy("node").agg(F.collect_list(F.struct("s", "i", "j", "side")).alias("w"))
    compared = stored(places.join(classes.select("node", "fp"), "node"), "near-compared")
    # Each task's first row of a class has its set; one of these is sent on.
    wanted = sent_if_small(stored(compared.select("node"), "near-wanted"), FEW)
    sets = marked.filter("hashes IS NOT NULL").select("node", "hashes").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("hashes").alias("hashes"))
    rows = sets.join(compared, "node").select(F.explode("w").alias("w"), "node", "fp", "hashes").select("w.*", "node", "fp", "hashes")
    dealt = rows.repartition("s", "i", "j").sortWithinPartitions("s", "i", "j", "side", "node")
    return dealt.mapInArrow(_link(similarity), "a binary, b binary").distinct()


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """doc_id and node (its class) of each row; node, root and least row of each class. Both are stored tables."""
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("node binary, n long, shards array<long>, fp binary, hashes binary").fields])
    marked = stored(docs.select("doc_id", "text").mapInArrow(_marks(words), schema), "near-marked")
    known = (F.first(c, ignorenulls=True).alias(c) for c in ("n", "shards", "fp"))
    classes = stored(marked.drop("hashes").groupBy("node").agg(*known, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("d")), "near-classes")
    roots = components(near_links(marked, classes, similarity))
    roots = stored(classes.select("node", "d").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "near-roots")
    ids = stored(marked.select("doc_id", "node"), "near-ids")
    discard(marked)
    discard(classes)
    return ids, roots


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id; columns as they were."""
    marked, roots = groups(docs, words, similarity)
    kept = stored(roots.groupBy("root").agg(F.min(F.struct("d", "node")).alias("m")).select(F.col("m.d.doc_id").alias("id"), F.col("m.node").alias("node")), "near-kept")
    # An id of several rows, or none, doesn't name a row: such rows are told apart by class.
    several = stored(marked.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("id")), "near-several")
    out_of = marked.select(F.col("doc_id").alias("id")).filter("id IS NOT NULL").join(kept.select("id"), "id", "left_anti")
    gone = stored(out_of.unionByName(several.filter("id IS NOT NULL")).distinct(), "near-gone")
    named = sent_if_small(gone, FEW).withColumnRenamed("id", name := unused(docs, "gone"))
    plain = docs.filter(F.col("doc_id").isNotNull()).join(named, F.col("doc_id") == F.col(name), "left_anti")
    if several.isEmpty():
        return plain
    node = T.StructField("node", T.BinaryType())
    rest = docs.filter(F.col("doc_id").isNull()).unionByName(docs.join(several.withColumnRenamed("id", name), F.col("doc_id") == F.col(name), "left_semi"))
    rest = per_row(rest.select(as_row(docs), "text"), ["row"], [node], lambda b: [[class_of(shingle_set(t, words)) for t in b.column("text").to_pylist()]])
    rest = rest.withColumn("key", F.xxhash64("node", "row.doc_id")).join(kept.select(F.xxhash64("node", "id").alias("key"), F.col("node").alias("own"), "id"), "key")
    rest = rest.filter((F.col("node") == F.col("own")) & F.col("row.doc_id").eqNullSafe(F.col("id")))
    return plain.unionByName(rest.groupBy("node").agg(F.min_by("row", F.struct("row.text")).alias("row")).select("row.*"))
