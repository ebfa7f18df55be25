"""Operator 5, benchmark decontamination: one Aho-Corasick automaton over the items' word windows.

Items and texts are folded alike (A-Z lower-cased, words are runs of 0-9, a-z and anything beyond ASCII). The automaton's
alphabet is the items' words, so a text is scanned once, word by word, and a hit's words map back to characters of the
original text. No shuffle: the automaton is made once in each Python worker.

The benchmark is sent to every executor, so its size is checked: items are dealt by a hash into shards of about
SHARD_WORDS words (an automaton of 300,000 words takes 270 MB in a worker), and each shard is read and sent for one pass
of its own, whose hits are added to those before (written to the shared folder between passes; the driver holds one shard).

Texts of any length are scanned whole; repeated rows are judged each. Columns of docs may have any names.
Nulls: a null text or item has no words; a null item_id counts as an item with the id "null"; repeated items count once.
An empty benchmark hits nothing.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import FOLD, as_row, discard, field, per_row, stored

WINDOW = 10
SHARD_WORDS = 250_000


class Windows:
    """The automaton over all windows of some items: (item_id, text) pairs."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW):
        import ahocorasick

        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            words = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in text.encode().translate(FOLD).split())
            for i in range(max(1, len(words) - size + 1) if words else 0):
                found.setdefault(words[i : i + size], set()).add(name)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, names in found.items():
            self.automaton.add_word(window, (len(window), tuple(names)))
        if found:
            self.automaton.make_automaton()
        self.some = bool(found)

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words in the text, hit word ranges (merged, end exclusive), items."""
        words = text.encode().translate(FOLD).split()
        if not self.some or not words:
            return len(words), [], set()
        known = self.ids.get
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for end, (size, names) in self.automaton.iter(tuple([known(w, 0) for w in words])):
            items.update(names)
            first = end - size + 1
            while spans and spans[-1][1] >= first:
                first = min(first, spans.pop()[0])
            spans.append((first, end + 1))
        return len(words), spans, items


@functools.lru_cache(1)
def _windows(key: tuple, size: int) -> Windows:
    return Windows(list(key), size)


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as character ranges of the original text."""
    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]


def _shards(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """i (item_id), text, shard of the items, stored, and the number of shards."""
    rows = benchmark.filter(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").distinct()
    rows = stored(rows, "decontaminate-items")
    words = rows.agg(F.sum((F.length("text") / 2).cast("long") + 1)).first()[0] or 0  # at most
    n = max(1, -(-words // SHARD_WORDS))
    return rows.withColumn("shard", F.pmod(F.xxhash64("i", "text"), F.lit(n))), n


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def scan_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], size: int = WINDOW) -> DataFrame:
    """keep's columns of docs, n_words, hits (merged hit word ranges: int32 pairs), items (ids, \\x00-joined) and spans
    (the hits as start:end in characters of the original text, comma-joined). keep: none of these names, nor text."""
    spark = docs.sparkSession
    df = docs.select(*keep, "text").withColumns({"hits": F.lit(b""), "items": F.lit("")})
    rows, n = _shards(benchmark)
    fields = [field("n_words", "long"), field("hits", "binary"), field("items", "string"), field("spans", "string")]
    for k in range(n):
        sent = spark.sparkContext.broadcast(tuple((r["i"], r["text"]) for r in rows.filter(F.col("shard") == k).select("i", "text").collect()))

        def of(b: pa.RecordBatch, sent=sent) -> list:
            windows = _windows(sent.value, size)
            out: list[list] = [[], [], [], []]
            for text, old, names in zip(b.column("text").to_pylist(), b.column("hits").to_pylist(), b.column("items").to_pylist(), strict=True):
                count, hit, found = windows.scan(text or "")
                if old:
                    hit = _merged([*map(tuple, np.frombuffer(old, "<i4").reshape(-1, 2).tolist()), *hit])
                found |= set(names.split("\x00")) if names else set()
                chars = ",".join(f"{a}:{z}" for a, z in char_spans(text, hit)) if hit else ""
                for column, value in zip(out, (count, np.array(hit, "<i4").tobytes(), "\x00".join(sorted(found)), chars), strict=True):
                    column.append(value)
            return out

        last = k == n - 1
        found = per_row(df, keep if last else [*keep, "text"], fields, of)
        if not last:
            found = stored(found, "decontaminate")
            if k:
                discard(stage)
            stage, df = found, found.drop("n_words", "spans")
    return found


def _digest(b: pa.RecordBatch) -> list:
    hits, counts, digests = [], [], []
    for spans, items in zip(b.column("hits").to_pylist(), b.column("items").to_pylist(), strict=True):
        pairs = np.frombuffer(spans, "<i4").reshape(-1, 2)
        names = items.split("\x00") if items else []
        hits.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
        counts.append(len(names))
        digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
    return [hits, counts, digests]


def contamination_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (hit passages in characters of the text)."""
    df = scan_hits(docs, benchmark, ["doc_id"])
    df = per_row(df, ["doc_id", "n_words", "spans"], [field("n_hit", "long"), field("n_items", "long"), field("items_sha256", "string")], _digest)
    return df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark window; columns as they were."""
    return scan_hits(docs.select(as_row(docs), "text"), benchmark, ["row"]).filter("hits = X''").select("row.*")
