"""Operator 6, SimHash near-duplicates by BK-trees.

A fingerprint has a bit for each of 64 positions, set where over half of the XXH64 hashes of the text's 3-word shingles
have it. Distinct fingerprints at RADIUS or fewer differing bits link; components are closed over links.

64 bits are cut into BLOCKS blocks. Two fingerprints that differ in 3 bits differ in at most 3 blocks, so they agree on
the other 3: each is sent to the 20 shards named by three of its blocks, and every link lies in some shard. A shard is a
BK-tree (children keyed by Hamming distance to the parent); a search follows only edges within the radius. Shard trees
live where the shuffle puts them and aren't broadcast, as their size has no bound. Links that join two parts of a shard
are kept (at most one fewer than its fingerprints), so a dense group never emits all its pairs. A shard of over
SHARD rows is dealt into blocks, and each pair of blocks is a task's work: one block's tree, the other's queries.

Components: alternating large and small stars over the kept links until they settle, each round written to the shared
folder and the one before it deleted.

Nulls: a null or empty text has fingerprint zero, linked like any other; a null doc_id keeps its row, and component_id
is the smallest id that isn't null. Repeated rows keep their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import LOWER, discard, field, per_row, stored

SHINGLE, RADIUS, SHARD = 3, 3, 20_000
BLOCKS = (11, 11, 11, 11, 10, 10)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle of the whole text, repeats included; none without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of shingle hashes."""
    bits = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        bits += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the whole text."""
    return majority(shingle_hashes(text, size))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with _fp."""
    return per_row(docs, docs.columns, [field("_fp", "long")], lambda b: [[fingerprint(t) for t in b.column("text").to_pylist()]])


class BKTree:
    """Integers by Hamming distance."""

    def __init__(self, first: int):
        self.root: tuple[int, dict] = (first, {})

    def add(self, x: int) -> None:
        at, children = self.root
        while True:
            d = (at ^ x).bit_count()
            if not d:
                return
            if d not in children:
                children[d] = (x, {})
                return
            at, children = children[d]

    def within(self, x: int, radius: int) -> Iterator[int]:
        todo = [self.root]
        while todo:
            at, children = todo.pop()
            d = (at ^ x).bit_count()
            if d <= radius:
                yield at
            if len(children) > 2 * radius:
                todo += [children[k] for k in range(max(1, d - radius), d + radius + 1) if k in children]
            else:
                todo += [child for k, child in children.items() if -radius <= k - d <= radius]


class Parts:
    """Union-find."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        a, b = self.top(x), self.top(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def shard_links(own: list[int], others: list[int] | None = None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join parts: within own, or between own (in the tree) and others. Values are unsigned."""
    parts, links, tree = Parts(), [], None
    for x in own if others is None else others:
        if others is None and tree is None:
            tree = BKTree(x)
            continue
        if tree is None:
            tree = BKTree(own[0])
            for y in own[1:]:
                tree.add(y)
        links += [(x, y) for y in tree.within(x, radius) if x != y and parts.join(x, y)]
        if others is None:
            tree.add(x)
    return links


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of rows with one shard; rows come sorted by shard, side, fingerprint."""
    names = ["c", "k", "i", "j", "side", "fp"]
    held: list[np.ndarray] = [np.zeros(0, np.int64) for _ in names]

    def runs(cols: list[np.ndarray], first: np.ndarray, last: int) -> Iterator[tuple[int, int]]:
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a > 1 and b <= last:
                yield a, b

    def links(cols: list[np.ndarray], a: int, b: int) -> list[tuple[int, int]]:
        fp = np.unique(cols[5][a:b]) if cols[2][a] == cols[3][a] else cols[5][a:b]
        values = fp.view(np.uint64).tolist()
        if cols[2][a] == cols[3][a]:
            return shard_links(values)
        side = cols[4][a:b]
        one, two = [v for v, s in zip(values, side, strict=True) if s == 0], [v for v, s in zip(values, side, strict=True) if s == 1]
        return shard_links(one, two) if one and two else []

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        x = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x.min(1)), pa.array(x.max(1))], names=["a", "b"])

    def work(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        n = len(held[0])
        if not n:
            return
        new = np.ones(n, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in held[:4]], axis=0)
        first = np.flatnonzero(new)
        last = n if final else int(first[-1])
        found = [x for a, b in runs(held, np.append(first, n), last) for x in links(held, a, b)]
        if found:
            yield out(found)
        held = [c[last:] for c in held]

    for b in batches:
        held = [np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
        yield from work(False)
    yield from work(True)


def _masks() -> list[int]:
    at, masks = 0, []
    for width in BLOCKS:
        masks.append(((1 << width) - 1) << at)
        at += width
    out = [sum(masks[i] for i in c) for c in combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints, enough to connect every component. distinct: _fp, each value once."""
    rows = distinct.select(F.col("_fp").alias("fp"), F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col("_fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(_masks())))).alias("s")).select("s.c", "s.k", "fp")
    large = stored(rows.groupBy("c", "k").count().filter(F.col("count") > SHARD), "simhash-large")
    zero = F.lit(0)
    plain = rows.select("c", "k", zero.alias("i"), zero.alias("j"), zero.alias("side"), "fp")
    if not large.isEmpty():
        blocks = F.ceil(F.col("count") / SHARD).cast("int")
        split = rows.join(large, ["c", "k"]).withColumn("r", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(zero, blocks - 1)))
        split = split.select("c", "k", F.least("r", "o").alias("i"), F.greatest("r", "o").alias("j"), F.when(F.col("r") <= F.col("o"), 0).otherwise(1).alias("side"), "fp")
        small = rows.join(large, ["c", "k"], "left_anti")
        plain = small.select("c", "k", zero.alias("i"), zero.alias("j"), zero.alias("side"), "fp").unionByName(split)
    dealt = plain.repartition("c", "k", "i", "j").sortWithinPartitions("c", "k", "i", "j", "side", "fp")
    return dealt.mapInArrow(_link, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges a < b."""
    edges = stored(edges, "simhash-links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b"), F.col("m").alias("a")).filter("a < b").distinct()
        low = star.groupBy("b").agg(F.min("a").alias("m"))
        small = star.join(low, "b").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m")), F.struct(F.col("b").alias("x"), F.col("m")))).alias("e")).select(F.col("e.m").alias("a"), F.col("e.x").alias("b")).filter("a < b").distinct()
        edges, old = stored(small, "simhash-stars"), edges
        discard(old)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        state = now


def component_map(marked: DataFrame) -> DataFrame:
    """_fp, component_id, of a stored table of doc_id and _fp."""
    groups = stored(marked.groupBy("_fp").agg(F.min("doc_id").alias("_least")), "simhash-groups")
    roots = components(links(groups.select("_fp")))
    groups = groups.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    groups = stored(groups, "simhash-roots")
    least = groups.groupBy("root").agg(F.min("_least").alias("component_id"))
    return groups.join(least, "root").select("_fp", "component_id")


def simhash_table(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    marked = stored(fingerprints(docs.select("doc_id", "text")).select("doc_id", "_fp"), "simhash-marked")
    df = marked.join(component_map(marked), "_fp")
    return df.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")

