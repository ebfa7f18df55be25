"""Operator 3, language ID: interpolated Kneser-Ney character models per language.

Training counts the 4-grams of letters (lower-cased, whatever is no letter is one space) of every labelled training text;
tasks count their own rows first, so the shuffle holds distinct 4-grams. Lower orders are continuation counts over all
of them. Each order is one sorted array of grams with a row of log probabilities for all languages; a text's score for a
language is its mean log probability, and the highest one (lowest length-normalised cross-entropy) wins.

The models are dealt to shards of about CELLS numbers by a 4-gram's third letter, which its lower orders and contexts
share (only single letters are in every shard); letters with more than that are dealt by the second one too. A shard is
sent to every worker, and each is one pass over the texts whose sums are added to those before (written to the shared
folder between passes), so nothing is cut and only a shard is held at a time. Languages are a dictionary: their names go to the driver.
Every document is scored once and its sums are stored. Rejection is calibrated on those of all training texts: score is a
softmax whose temperature scales the gap to the runner-up by its median, and rejected marks texts whose cross-entropy lies over REJECT_SD
standard deviations beyond their language's mean.

Nulls: a null text, or one without a letter, is und with score 0; null lang is not learned from; ids may be null (then
held_out is false) or repeated. Letters are what Unicode calls so: emoji, digits and signs are none. Texts of any length are
scored whole, in slices. With nothing to learn from every row is und.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import discard, field, per_row, stored

ORDER, REJECT_SD = 4, 6.0
#: Parts of a nat in which gaps between languages are counted.
GAPS = 1 << 12
CELLS = 1 << 24
DISCOUNT = 0.75
SLICE = 1 << 20
START, GAP, OTHER = 1, 32, 2  # before a text; no letter; a letter beyond 16 bits
POINTS = 0x110000


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Of each character its lower-case letter (OTHER beyond 16 bits), or GAP."""
    table = np.full(POINTS, GAP, np.uint16)
    for c in range(POINTS):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            table[c] = low if low < 1 << 16 else OTHER
    return table


def codes(text: str) -> np.ndarray:
    """A text's letters and gaps; empty if it has no letter."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = _letters()[c]
    gap = out == GAP
    if gap.all():
        return out[:0]
    out = out[~(gap & np.concatenate([[True], gap[:-1]]))]
    return out[:-1] if out[-1] == GAP else out


def padded(c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.full(ORDER - 1, START, np.uint16), [np.uint16(GAP)], c, [np.uint16(GAP)]]).astype(np.uint64)


def grams(c: np.ndarray) -> np.ndarray:
    """Each 4-gram of a padded text as 64 bits, the first character uppermost."""
    n = len(c) - ORDER + 1
    out = c[:n].copy()
    for k in range(1, ORDER):
        out = (out << np.uint64(16)) | c[k : k + n]
    return out


def last(keys: np.ndarray, order: int) -> np.ndarray:
    """The last `order` characters."""
    return keys & np.uint64((1 << 16 * order) - 1)


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of x in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(x), int), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


Layer = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # grams, their rows of log probabilities, contexts, their rows of log weights


def layer(order: int, j: np.ndarray, k: np.ndarray, n: np.ndarray, back: np.ndarray | Layer) -> Layer:
    """An order from languages, grams and counts (a pair once), and the order below or the floor."""
    lower = back if isinstance(back, tuple) else None
    size = lower[1].shape[1] if lower else len(back)
    keys, at = np.unique(k, return_inverse=True)
    contexts, of = np.unique(k >> np.uint64(16), return_inverse=True)
    cell, shape = of * size + j, (len(contexts), size)
    total = np.bincount(cell, n, len(contexts) * size).reshape(shape)
    kinds = np.bincount(cell, minlength=len(contexts) * size).reshape(shape)
    weight = np.divide(DISCOUNT * kinds, total, out=np.ones(shape), where=total > 0)
    p = weight[np.searchsorted(contexts, keys >> np.uint64(16))]
    if lower:
        p *= np.exp(lower[1][np.searchsorted(lower[0], last(keys, order - 1))])
    else:
        p *= np.exp(back)
    p[at, j] += (n - DISCOUNT) / total[of, j]
    return keys, np.log(p).astype(np.float32), contexts, np.log(weight).astype(np.float32)


def layers(j: np.ndarray, k: np.ndarray, n: np.ndarray, j2: np.ndarray, k2: np.ndarray, n2: np.ndarray, letters: Layer) -> list[Layer]:
    """Orders 2 to 4 of a shard: its 4-grams, and all pairs of letters that end some (with the number of letters before)."""
    two = layer(2, j2, k2, n2, letters)
    # One order down a gram counts once for each character seen before it.
    order = np.lexsort((last(k, 3), j))
    j3, k3 = j[order], last(k, 3)[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(k3)), bool), (j3[1:] != j3[:-1]) | (k3[1:] != k3[:-1])]))
    three = layer(3, j3[first], k3[first], np.diff(np.append(first, len(k3))), two)
    return [two, three, layer(4, j, k, n, three)]


class Models:
    """Languages, log probabilities of single letters, and of the shard in hand (sums over shards are the whole score)."""

    def __init__(self, langs: list[str], letters: tuple[np.ndarray, np.ndarray, np.ndarray], shards: int = 1, splits: dict[int, int] | None = None):
        """letters: languages' places, letters, numbers of letters before them. splits: into how many a third letter is dealt."""
        self.langs, self.shards, self.splits, self.shard = langs, shards, splits or {}, 0
        self.floor = np.full(len(langs), -np.log(max(len(np.unique(letters[1])), 1) + 1), np.float32)
        self.letters = layer(1, *letters, self.floor)
        self.orders: list[Layer] = []
        self.mean, self.sd, self.gap = np.full(len(langs), 3.0), np.full(len(langs), 1e9), 0.3

    def shard_of(self, g: np.ndarray) -> np.ndarray:
        c, b = (g >> np.uint64(16)).astype(np.int64) & 0xFFFF, (g >> np.uint64(32)).astype(np.int64) & 0xFFFF
        split = np.ones(1 << 16, np.int64)
        for letter, n in self.splits.items():
            split[letter] = n
        return ((c * 31 + b % split[c]) * 2654435761 >> 8) % self.shards

    def logs(self, g: np.ndarray) -> np.ndarray:
        """A row of log probabilities for each gram of the shard (others: 0): the longest known order, else back off with its context's weight."""
        out = np.zeros((len(g), len(self.langs)), np.float32)
        left = np.arange(len(g)) if self.shards == 1 else np.flatnonzero(self.shard_of(g) == self.shard)
        for order, (keys, rows, contexts, weights) in reversed([*enumerate([self.letters, *self.orders], 1)]):
            at, hit = find(keys, last(g[left], order))
            out[left[hit]] += rows[at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            at, known = find(contexts, last(g[left] >> np.uint64(16), order - 1))
            out[left[known]] += weights[at[known]]
        out[left] += self.floor
        return out

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text's grams in the shard by language, and its number of all grams (0: no letter)."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        held: list[np.ndarray] = []
        owners: list[int] = []

        def flush() -> None:
            if not held:
                return
            g, sizes = np.concatenate(held), np.array([len(x) for x in held])
            owner = np.repeat(np.array(owners), sizes)
            for a in range(0, len(g), SLICE):
                rows, own = self.logs(g[a : a + SLICE]), owner[a : a + SLICE]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                np.add.at(total, own[first], np.add.reduceat(rows, first, axis=0, dtype=np.float64))
            held.clear()
            owners.clear()

        for i, text in enumerate(texts):
            c = codes(text or "")
            if len(c):
                held.append(grams(padded(c)))
                owners.append(i)
                n[i] = len(held[-1])
                if sum(map(len, held)) >= SLICE:
                    flush()
        flush()
        return total, n

    def calibrate(self, typical: dict[str, tuple[int, float, float]], gap: float | None) -> None:
        """typical: of each language its number of training texts, mean and deviation of their cross-entropy. gap: median gap of all to the runner-up."""
        for j, lang in enumerate(self.langs):
            count, mean, sd = typical.get(lang, (0, 0.0, 0.0))
            if count > 4:
                self.mean[j], self.sd[j] = mean, max(sd, 0.05)
        if len(self.langs) > 1 and gap is not None:
            self.gap = max(gap, 1e-3)

    def predict(self, sums: np.ndarray, n: np.ndarray) -> list[list]:
        means = sums / np.maximum(n, 1)[:, None]
        langs, scores, rejected = [], [], []
        for m, size in zip(means, n, strict=True):
            if not size or not self.langs:
                langs.append("und")
                scores.append(0.0)
                rejected.append(True)
                continue
            j = int(m.argmax())
            # A text of typical gap is near 1; short ones with a small gap are not.
            p = np.exp((m - m[j]) * 5 / self.gap)
            langs.append(self.langs[j])
            scores.append(float(1 / p.sum()))
            rejected.append(bool(-m[j] > self.mean[j] + REJECT_SD * self.sd[j] * max(1.0, 30 / size) ** 0.5))
        return [langs, scores, rejected]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct grams and counts of each language in this task."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(lang: str, held: list[np.ndarray]) -> None:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        if lang in sums:
            keys, at = np.unique(np.concatenate([sums[lang][0], keys]), return_inverse=True)
            n = np.bincount(at, np.concatenate([sums[lang][1], n])).astype(np.int64)
        sums[lang] = (keys, n)

    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            c = codes(text or "")
            if len(c):
                held.setdefault(lang, []).append(grams(padded(c)))
                sizes[lang] = sizes.get(lang, 0) + len(c)
                if sizes[lang] > 2 * SLICE:
                    add(lang, held.pop(lang))
                    sizes[lang] = 0
    for lang, rest in held.items():
        add(lang, rest)
    for lang, (keys, n) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def _bits(c: Column, shift: int, n: int = 16) -> Column:
    return F.shiftrightunsigned(c, shift).bitwiseAND(F.lit((1 << n) - 1).cast("long"))


def _layers(t: pa.Table, models: Models) -> list[Layer]:
    """Of a shard's rows: order (4 or 2), lang, gram, n."""
    place = {x: i for i, x in enumerate(models.langs)}
    lang = t.column("lang").combine_chunks().dictionary_encode()
    if isinstance(lang, pa.ChunkedArray):
        lang = lang.combine_chunks()
    places = np.array([place[x] for x in lang.dictionary.to_pylist()], np.int64)
    j = places[lang.indices.to_numpy(zero_copy_only=False)] if len(places) else np.zeros(0, np.int64)
    k, n, four = t.column("gram").to_numpy().view(np.uint64), t.column("n").to_numpy(), t.column("ord").to_numpy() == 4
    return layers(j[four], k[four], n[four], j[~four], k[~four], n[~four], models.letters)


def train(rows: DataFrame) -> tuple[Models, Callable[[int], list[Layer]], int]:
    """rows: text and lang of the training documents. Returns models without a shard, the layers of each shard, and the number of 4-grams."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = stored(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    size = [(r["lang"], r["count"]) for r in counts.groupBy("lang").count().collect()]
    langs = sorted(x for x, _ in size)
    gram = F.col("gram")
    pairs = stored(counts.select("lang", _bits(gram, 0, 48).alias("gram")).distinct().groupBy("lang", _bits(gram, 0, 32).alias("gram")).count().withColumnRenamed("count", "n"), "language-pairs")
    ends = pairs.groupBy("lang", _bits(gram, 0).alias("gram")).count().collect()
    letters = np.array([langs.index(r["lang"]) for r in ends], np.int64), np.array([r["gram"] for r in ends], np.uint64), np.array([r["count"] for r in ends], np.int64)
    shards = max(1, -(-sum(n for _, n in size) * len(langs) // CELLS))
    splits: dict[int, int] = {}
    if shards > 1:
        heavy = counts.groupBy(_bits(gram, 16).alias("c")).count().filter(F.col("count") * len(langs) > CELLS).collect()
        splits = {r["c"]: -(-r["count"] * len(langs) // CELLS) for r in heavy}
    models = Models(langs, letters, shards, splits)
    split = F.coalesce(F.create_map(*(F.lit(x).cast("long") for kv in splits.items() for x in kv))[_bits(gram, 16)], F.lit(1).cast("long")) if splits else F.lit(1).cast("long")

    def shard(b: Column) -> Column:
        return (F.shiftright((_bits(gram, 16) * 31 + b) * F.lit(2654435761).cast("long"), 8) % shards).alias("shard")

    fours = counts.select(shard(_bits(gram, 32) % split), F.lit(4).alias("ord"), "lang", "gram", "n")
    twos = pairs.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), split - 1))).select(shard(F.col("_b")), F.lit(2).alias("ord"), "lang", "gram", "n").distinct()
    every = fours.unionByName(twos)
    if shards == 1:

        def of(k: int) -> list[Layer]:
            return _layers(every.drop("shard").toArrow(), models)
    else:

        def build(t: pa.Table) -> pa.Table:
            return pa.table({"shard": t.column("shard").slice(0, 1), "layers": pa.array([pickle.dumps(_layers(t, models))], pa.binary())})

        built = stored(every.groupBy("shard").applyInArrow(build, "shard long, layers binary"), "language-shards")

        def of(k: int) -> list[Layer]:
            found = built.filter(F.col("shard") == k).select("layers").collect()
            return pickle.loads(found[0][0]) if found else []

    return models, of, sum(n for _, n in size)


def _typical(b: pa.RecordBatch, langs: list[str]) -> list:
    """Of training texts their cross-entropy in their own language, and the gap to the runner-up in GAPS parts."""
    sums, n = _summed(b, len(langs))
    means = sums / np.maximum(n, 1)[:, None]
    own = [langs.index(x) if x in langs else -1 for x in b.column("lang").to_pylist()]
    two = np.sort(means, axis=1)[:, -2:]
    gaps = ((two[:, -1] - two[:, 0]) * GAPS).round().astype(np.int64).tolist()
    return [[float(-m[j]) if j >= 0 and size else None for m, j, size in zip(means, own, n, strict=True)], [g if size else None for g, size in zip(gaps, n, strict=True)]]


def _summed(b: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(b.column("_sums").to_pylist()), "<f8").reshape(b.num_rows, size), b.column("_n").to_numpy()


def calibrate(models: Models, scored: DataFrame) -> None:
    """Calibrates by all training texts: the rows of scored (lang, _sums, _n) that have a lang."""
    langs = models.langs
    if not langs:
        return
    rows = per_row(scored.filter(F.col("lang").isNotNull()), ["lang"], [field("h", "double"), field("gap", "long")], lambda b: _typical(b, langs))
    rows = rows.filter(F.col("h").isNotNull())
    own = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("h").alias("mean"), F.stddev_pop("h").alias("sd")).collect()
    typical = {r["lang"]: (r["n"], r["mean"], r["sd"]) for r in own}
    # A row for each gap: few, whatever the number of texts.
    total, gap, so_far = sum(r["n"] for r in own), None, 0
    for r in rows.groupBy("gap").count().orderBy("gap").collect():
        so_far += r["count"]
        if 2 * so_far >= total:
            gap = r["gap"] / GAPS
            break
    models.calibrate(typical, gap)


def language_table(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    models, of, _ = train(docs.filter(~held_out))
    df = docs.select("doc_id", held_out.alias("held_out"), F.when(~held_out & F.col("text").isNotNull(), F.col("lang")).alias("lang"), "text")
    spark, stage, size = docs.sparkSession, None, len(models.langs)
    for k in range(models.shards):
        models.shard, models.orders = k, of(k)
        sent = spark.sparkContext.broadcast(models)

        def scored(b: pa.RecordBatch, sent=sent, k=k) -> list:
            sums, n = sent.value.sums(b.column("text").to_pylist())
            if k:
                sums += _summed(b, size)[0]
            return [[x.tobytes() for x in sums.astype("<f8")], n]

        keep = ["doc_id", "held_out", "lang"]
        df = stored(per_row(df, keep if k == models.shards - 1 else [*keep, "text"], [field("_sums", "binary"), field("_n", "long")], scored), "language")
        if stage is not None:
            discard(stage)
        stage = df
    calibrate(models, df)
    models.orders = []
    return per_row(df, ["doc_id", "held_out"], [field("lang_pred", "string"), field("score", "double"), field("rejected", "boolean")], lambda b: models.predict(*_summed(b, size)))
