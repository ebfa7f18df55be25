"""Operator 1, best-fit packing by a configuration linear program.

Texts are tokenised in Arrow batches (public tokenizers that split words apart give a chunk its ids once
a worker), followed by id 0, and cut into pieces of at most LIMIT tokens. Only the histogram of piece lengths,
LIMIT numbers at most, goes to the driver. There the configuration LP (a variable for each multiset of lengths that fits
a sequence) is solved by multiplicative weights: a knapsack dynamic program prices the best configuration under the
lengths' weights, and the weights of covered lengths fall. Rounded down, the solution's configurations never use more
pieces than exist; what is left is packed from the histogram by best fit decreasing. Small counts round badly: of some
shares of the solution the one that ends in the fewest sequences is rounded. The weights also bound the program from
below: rounds end when the plan has no more sequences than that bound.

The plan gives each length runs of (rank, first sequence, offset). A piece's rank among those of its length is counted in
two steps, in salted groups of at most about GROUP rows, so that a length with a third of all pieces is never in one task.

Nulls: a null text is empty: one piece, id 0. Ids may be null or repeated; repeated rows are packed each. Empty input
gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import stored

LIMIT, ROUNDS, CHECK, RATE, GROUP = 2048, 300, 20, 0.3, 50_000
#: Shares of the LP solution that rounding tries (never none of it); the fewest sequences win.
SHARES = (1.0, 0.95, 0.9, 0.75, 0.5, 0.25, 0.1)
#: Chunks that a worker keeps, about 200 bytes each.
CACHE = 3 << 18


#: Chunks for which lower() and the pattern below are the tokenizer's own normaliser and splits: printable ASCII and Latin letters.
_SIMPLE = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ſ]+")
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^0-9a-zß-öø-ſ]+")
#: Byte-level alphabet: printable bytes stand for themselves, the others for 256 and up in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PRINTED)}


class Chunks:
    """Token ids of a text, as little-endian unsigned 32-bit bytes.

    A tokenizer that drops white space and splits words as _SPLIT does gives a text the ids of its chunks between spaces
    and line ends; a chunk's ids are kept, and so are its pieces'. Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        config = json.loads(t.to_str())
        names = [x["type"] for x in (config["normalizer"] or {}).get("normalizers", [])]
        splits = [x.get("pattern") for x in (config["pre_tokenizer"] or {}).get("pretokenizers", [])]
        added = t.get_added_tokens_decoder().values()
        self.apart = names == ["NFC", "Replace", "Lowercase"] and splits == [{"Regex": _SPLIT}, None] and not any(x.lstrip or x.rstrip or " " in x.content for x in added)
        self.marks = tuple({x.content[:2] for x in added})
        self.model = t.model
        self.known: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def piece(self, p: str) -> bytes:
        own = p if p.isascii() else p.encode().decode("latin-1").translate(_ALPHABET)
        self.pieces[p] = ids = b"".join([x.id.to_bytes(4, "little") for x in self.model.tokenize(own)])
        return ids

    def chunk(self, c: str) -> bytes:
        if not _SIMPLE.fullmatch(c) or any(m in c for m in self.marks):
            return self.whole(c)
        known = self.pieces
        return b"".join([known.get(p) or self.piece(p) for p in _PIECES.findall(c.lower())])

    def ids(self, text: str) -> bytes:
        if not self.apart:
            return self.whole(text)
        chunks = text.replace("\n", " ").split(" ")
        known = self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            for kept in (known, self.pieces):
                if len(kept) > CACHE:
                    kept.clear()
            known[""] = b""
            for c in chunks:
                if c not in known:
                    known[c] = self.chunk(c)
            return b"".join([known[c] for c in chunks])


@functools.lru_cache(2)
def _chunks(path: str) -> Chunks:
    return Chunks(path)


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _chunks(tokenizer)
        for b in batches:
            rows: list[int] = []
            piece: list[int] = []
            start: list[int] = []
            length: list[int] = []
            crc: list[int] = []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = of.ids(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                for k, a in enumerate(range(0, n, limit)):
                    z = min(n, a + limit)
                    rows.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(z - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * z]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _best_configuration(value: np.ndarray, most: np.ndarray, limit: int) -> tuple[dict[int, int], float]:
    """Bounded knapsack by dynamic programming: lengths that fit, each at most as often as it exists, and their worth.

    value: by length, 0 if absent. Copies of a length are dealt into powers of two, each taken or left once.
    """
    best = np.zeros(limit + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for size in np.flatnonzero(value > 0).tolist():
        left, copies = min(int(most[size]), limit // size), 1
        while left:
            copies = min(copies, left)
            weight = copies * size
            with_it = best[: limit + 1 - weight] + copies * value[size]
            better = with_it > best[weight:]
            best[weight:] = np.where(better, with_it, best[weight:])
            taken.append((size, copies, better))
            left, copies = left - copies, copies * 2
    out: dict[int, int] = {}
    w = limit
    for size, copies, better in reversed(taken):
        if w >= copies * size and better[w - copies * size]:
            out[size] = out.get(size, 0) + copies
            w -= copies * size
    return out, float(best[limit])


def solve(counts: dict[int, int], limit: int = LIMIT, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, number of such sequences), using each piece exactly once. counts: by length."""
    have = np.zeros(limit + 1, np.int64)
    for size, n in counts.items():
        have[size] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    if have[limit]:
        plan.append(((limit,), int(have[limit])))
        have[limit] = 0
    some = have > 0
    if some.any():
        # Covering by multiplicative weights: a configuration is taken in proportion to what it can cover at most.
        # The first weights are a little over proportional to size: full sequences of large pieces are priced first.
        weight, use = np.where(some, (np.arange(limit + 1) / limit) ** 1.05, 0.0), {}
        total = float((have * np.arange(limit + 1)).sum())
        bound, best = total / limit, None
        for k in range(1, rounds + 1):
            config, worth = _best_configuration(weight / weight.sum(), have, limit)
            # The weights over the worth of the best configuration are a solution of the dual program.
            bound = max(bound, float((have * weight).sum()) / weight.sum() / worth)
            key = tuple(sorted(config.items(), reverse=True))
            step = min(have[s] / n for s, n in config.items())
            use[key] = use.get(key, 0.0) + step
            for s, n in config.items():
                weight[s] *= 1 - RATE * n * step / have[s]
            if k % CHECK and k < rounds:
                continue
            scale = min(total / max(sum(n * sum(s * m for s, m in c) for c, n in use.items()), 1e-9), 1.0)
            order = sorted(use.items(), key=lambda x: (-sum(s * m for s, m in x[0]), -x[1], x[0]))
            found = min((_rounded(order, scale * share, have, limit) for share in SHARES), key=lambda rounded: sum(n for _, n in rounded))
            if best is None or sum(n for _, n in found) < sum(n for _, n in best):
                best = found
            if sum(n for _, n in best) <= np.ceil(bound - 1e-6):
                break  # no packing has fewer sequences
        plan += best
    return plan


def _rounded(order: list, share: float, have: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """The share of each configuration's use, rounded down, and best fit for what that leaves."""
    left, out = have.copy(), []
    for config, n in order:
        m = min(int(n * share), *(int(left[s]) // k for s, k in config))
        if m > 0:
            out.append((tuple(s for s, k in config for _ in range(k)), m))
            for s, k in config:
                left[s] -= m * k
    return out + best_fit(left, limit)


def best_fit(have: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing on a histogram: all open sequences with one filling are handled at once."""
    free: dict[int, list[list]] = {}  # free tokens -> [lengths, number] of open sequences
    done: list[tuple[tuple[int, ...], int]] = []
    rooms: list[int] = []

    def put(room: int, lengths: tuple[int, ...], n: int) -> None:
        if not room:
            done.append((lengths, n))
            return
        if room not in free:
            free[room] = []
            bisect.insort(rooms, room)
        free[room].append([lengths, n])

    for size in range(limit, 0, -1):
        n = int(have[size])
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                k = limit // size
                if n >= k:
                    put(limit - k * size, (size,) * k, n // k)
                if n % k:
                    put(limit - (n % k) * size, (size,) * (n % k), 1)
                n = 0
                break
            room = rooms[at]
            lengths, m = free[room][-1]
            k = min(room // size, n)
            used = min(m, n // k)
            n -= used * k
            if used == m:
                free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop(at)
            else:
                free[room][-1][1] = m - used
            put(room - k * size, lengths + (size,) * k, used)
    return done + [(lengths, n) for each in free.values() for lengths, n in each]


def runs(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks (rising), first sequences and offsets of the runs of pieces with that place."""
    out: dict[int, list[list[int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for lengths, n in plan:
        offset = 0
        for size in lengths:
            rank = ranks.get(size, 0)
            for column, x in zip(out.setdefault(size, [[], [], []]), (rank, sequence, offset), strict=True):
                column.append(x)
            ranks[size] = rank + n
            offset += size
        sequence += n
    return {size: tuple(np.array(x, np.int64) for x in columns) for size, columns in out.items()}


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """One row per piece with sequence_id and offset."""
    cut = stored(pieces(docs, tokenizer, limit), "packing-pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = docs.sparkSession.sparkContext.broadcast(runs(solve(counts, limit)))
    salts = max(1, -(-max(counts.values(), default=1) // GROUP))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    cut = cut.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = cut.groupBy("length", "_salt").count().withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).drop("count")
    ranked = cut.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                own = np.flatnonzero(length == size)
                first, base, at = places.value[size]
                k = np.searchsorted(first, rank[own], "right") - 1
                sequence[own], offset[own] = base[k] + rank[own] - first[k], at[k]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select(*names, "_rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
