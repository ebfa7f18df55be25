"""Kernels against full dynamic programs, sources against written files, queries against DuckDB."""

from __future__ import annotations

import gzip
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions.hashing import lrand48, mix64
from strandloom.operators import extension as x
from strandloom.operators import pairs, seeding
from strandloom.options import Options, preset
from strandloom.plans import queries as q
from strandloom.sources import fastx
from tests import plain
from tests.conftest import SF

O = Options()  # noqa: E741


def dna(n, rng):
    return "".join(rng.choice("ACGT") for _ in range(n))


def test_fixed_values():
    assert mix64(np.array([0, 1])).tolist() == [7654268697807496793, 2320827452992767577]
    assert lrand48(4).tolist() == [1609868485, 1074594562, 470884846, 2128573038]
    assert lrand48(3, skip=5).tolist() == lrand48(8).tolist()[5:]


def test_options():
    assert O.split_length == 28 and O.scaled(2).min_score == 60 and O.scaled(2, frozenset({"mismatch"})).mismatch == 4
    assert preset("ont2d").min_seed == 14
    with pytest.raises(ValueError):
        Options(match=0)


def full_global(a, b):
    """Gotoh's full matrix."""
    low = -(10**9)
    n, m = len(a), len(b)
    h = [[low] * (m + 1) for _ in range(n + 1)]
    e, f = [r[:] for r in h], [r[:] for r in h]
    h[0][0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                e[i][j] = max(e[i - 1][j] - 1, h[i - 1][j] - 7)
            if j:
                f[i][j] = max(f[i][j - 1] - 1, h[i][j - 1] - 7)
            d = h[i - 1][j - 1] + x.score(a[i - 1], b[j - 1], O) if i and j else (0 if i == j == 0 else low)
            h[i][j] = max(d, e[i][j], f[i][j])
    return h[n][m]


def test_global_alignment_spells_both_sequences():
    rng = random.Random(1)
    for _ in range(60):
        t = dna(rng.randint(20, 50), rng)
        k = rng.randint(5, 15)
        s = t[:k] + dna(rng.randint(0, 3), rng) + t[k + rng.randint(0, 3) :]
        score, ops = x.align_global(s, t, O)
        assert sum(n for o, n in ops if o in "MI") == len(s) and sum(n for o, n in ops if o in "MD") == len(t)
        assert score == full_global(s, t)
        nm, md = x.describe(s, t, ops)
        assert nm >= 0 and md[0].isdigit()


def test_ungapped_equals_extension():
    rng = random.Random(2)
    some = 0
    for _ in range(300):
        t = dna(rng.randint(5, 60), rng)
        s = list(t[: rng.randint(3, len(t))])
        for _ in range(rng.randint(0, 2)):
            s[rng.randrange(len(s))] = rng.choice("ACGT")
        quick = x.ungapped("".join(s), t, 30, O, 5)
        if quick:
            some += 1
            assert plain.extend("".join(s), t, 30, O, 5)[:5] == quick[:5]
    assert some > 100


def test_seeds_are_all_maximal_matches(spark):
    rng = random.Random(3)
    unit = dna(60, rng)
    text = dna(40, rng) + unit + dna(30, rng) + unit[:45] + "N" * 5 + dna(40, rng)
    read = text[50:90] + "N" + text[120:150]
    ref = spark.createDataFrame([("c", text)], ["contig", "seq"])
    reads = spark.createDataFrame([(1, read), (2, "ACGT"), (3, None)], "read_id long, seq string")
    got = {(r["strand"], r["qbeg"], r["qend"], r["rbeg"]) for r in seeding.mems(reads, ref, 15).collect()}
    want = set()
    for strand, s in enumerate((text, text[::-1].translate(str.maketrans("ACGT", "TGCA")))):
        for i in range(len(read)):
            for j in range(len(s)):
                if i and j and read[i - 1] == s[j - 1] != "N":
                    continue
                n = 0
                while i + n < len(read) and j + n < len(s) and read[i + n] == s[j + n] != "N":
                    n += 1
                if n >= 15:
                    want.add((strand, i, i + n, j))
    assert got == want


def test_blocks_lose_no_kmer(spark):
    rng = random.Random(4)
    s = dna(500, rng)
    texts = spark.createDataFrame([("c", 0, s, len(s))], "contig string, strand int, seq string, length int")
    rows = seeding.blocks(texts, 19, 64).collect()
    assert all(s[r["start"] : r["start"] + len(r["seq"])] == r["seq"] for r in rows)
    assert {r["start"] + i for r in rows for i in range(min(64, len(r["seq"]) - 18))} == set(range(500 - 18))


def test_insert_stats_few_samples(spark):
    df = spark.createDataFrame([(1, 300 + i % 7) for i in range(50)] + [(2, 100)], "dir int, size long")
    got = {r["dir"]: r for r in pairs.insert_stats(df).collect()}
    assert got[2]["failed"] and not got[1]["failed"] and got[1]["low"] >= 1


def test_sources(spark, tmp_path):
    fq = "".join(f"@r{i}/1 note {i}\n{'ACGTN'[: 2 + i % 4]}\n+\n{'@IIII'[: 2 + i % 4]}\n" for i in range(9))
    (tmp_path / "a.fq").write_text(fq)
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write(fq)
    a, b = ([tuple(r)[1:] for r in fastx.read_fastq(spark, str(tmp_path / n)).orderBy("ordinal").collect()] for n in ("a.fq", "b.fq.gz"))
    assert a == b and a[3] == (3, "r3", "ACGTN", "@IIII", "note 3")
    (tmp_path / "r.fa").write_text("junk\n>c1 first one\nACG\nTT\n>c2\nGG G\n")
    assert [tuple(r)[1:] for r in fastx.read_fasta(spark, str(tmp_path / "r.fa")).orderBy("ordinal").collect()] == [(0, "c1", "first one", "ACGTT"), (1, "c2", None, "GGG")]
    one = fastx.read_fastq(spark, str(tmp_path / "a.fq"))
    assert fastx.pair_files(one, one).count() == 18
    with pytest.raises(Exception, match="differ in length"):
        fastx.pair_files(one, one.filter("ordinal < 8")).collect()
    with pytest.raises(Exception, match="do not match"):
        fastx.pair_interleaved(one).collect()


def test_batches(spark):
    from strandloom.streaming.batches import batch_ids

    reads = spark.createDataFrame([("f", i, "A" * n) for i, n in enumerate((4, 4, 4, 10, 1, 9, 1))], "file string, ordinal long, seq string")
    assert [r["batch_id"] for r in batch_ids(reads, 10).orderBy("ordinal").collect()] == [0, 0, 0, 1, 2, 2, 3]


def test_stream(spark, tmp_path):
    from strandloom.streaming.batches import stream_reads

    spark.createDataFrame([(1, "ACGT"), (2, "GG")], "read_id long, seq string").write.parquet(str(tmp_path / "in"))
    seen = []
    stream_reads(spark, str(tmp_path / "in"), lambda df, i: seen.append(df.count()), str(tmp_path / "ck")).awaitTermination()
    assert sum(seen) == 2


def rows(df):
    clean = lambda v: round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(clean(r[c]) for c in sorted(r)) for r in df), key=str)


@pytest.mark.parametrize("name", ["pair_records", "single_records", "contained_seeds", "second_best_end", "region_clusters", "nt4_histogram", "contig_stats", "mem_seeds", "smems_round1", "smems_round2", "seeds_round3", "seed_union", "minimizer_index", "minimizer_places", "rescued_union", "best_placement", "chain_weight", "frac_rep", "contig_lookup", "insert_stats", "pair_top2", "xa_groups", "mapq_se", "sam_concordance", "first_record_caps", "cigar_text"])
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "supplier", "customer"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(q.oracle_sql()[name])
    assert rows([r.asDict() for r in q.queries()[name](spark, SF).collect()]) == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()])


def plain_round_three(read, texts, least, most):
    """Every string is counted in the texts of both strands."""
    x = 0
    while x < len(read):
        for end in range(x + 1, len(read) + 1):
            if read[end - 1] == "N":
                break
            n = sum(t.startswith(read[x:end], i) for t in texts for i in range(len(t))) if end - x >= least else most
            if n < most:
                if n:
                    yield x, end, n
                break
        x = end


def test_round_three(spark):
    rng = random.Random(5)
    unit = dna(40, rng)
    ref = "".join(dna(15, rng) + unit[rng.randrange(8) : rng.randrange(28, 41)] for _ in range(8))
    reads = [(i, ref[s : s + 60]) for i, s in enumerate(range(0, len(ref) - 60, 17))] + [(90, unit), (91, unit[:20] + "N" + unit[20:]), (92, "N" * 30), (93, "ACG"), (94, unit + dna(30, rng)), (95, "")]
    df, r = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame([("c", ref)], "contig string, seq string")
    texts = [ref, ref[::-1].translate(str.maketrans("ACGT", "TGCA"))]
    for most in (2, 4, 20):
        got = seeding.round_three(seeding.mems(df, r, 11), df, 12, most).collect()
        assert sorted((x["read_id"], x["qbeg"], x["qend"], x["n"]) for x in got) == sorted((i, *x) for i, s in reads for x in plain_round_three(s, texts, 12, most))


def test_minimizers(spark):
    """Against every window of a text, over the edges of blocks, with other letters, ties, short and null texts."""
    from strandloom.operators import minimizers as mz

    rng = random.Random(6)
    texts = {"a": dna(300, rng), "b": "A" * 60 + "N" + dna(70, rng) + "AC" * 20, "c": dna(16, rng), "d": "ACG", "e": None, "f": "", "g": "N" * 40}
    k, w = 7, 5

    def code(v, bits=2 * k):
        m = (1 << bits) - 1
        v = (~v + (v << 21)) & m
        v ^= v >> 24
        v = (v + (v << 3) + (v << 8)) & m
        v ^= v >> 14
        v = (v + (v << 2) + (v << 4)) & m
        v ^= v >> 28
        return (v + (v << 31)) & m

    def plain(s):
        def value(x):
            if set(x) - set("ACGT"):
                return None
            a, b = (code(int("".join(str("ACGT".index(c)) for c in y), 4)) for y in (x, x[::-1].translate(str.maketrans("ACGT", "TGCA"))))
            return (min(a, b), int(b < a))

        h = [value(s[i : i + k]) for i in range(len(s) - k + 1)]
        out = set()
        for i in range(max(len(h) - w, 0) + 1):
            seen = [(j, x) for j, x in enumerate(h[i : i + w], i) if x]
            out |= {(j, x[1], x[0]) for j, x in seen if x[0] == min(y[0] for _, y in seen)}
        return out

    df = spark.createDataFrame(list(texts.items()), "contig string, seq string")
    got = [tuple(r) for r in mz.minimizers(df, ["contig"], k, w, size=16).select("contig", "pos", "strand", "hash").collect()]
    assert sorted(got) == sorted((n, *x) for n, s in texts.items() if s for x in plain(s))
    with pytest.raises(ValueError):
        mz.minimizers(df, ["contig"], 8, 5)


def test_shards_of_suffixes_find_the_same(spark, monkeypatch):
    """Repeats, ties and reads over the edges of pieces: shards add up to what one finds, and intervals to the matches."""
    from strandloom.operators import suffixes

    rng = random.Random(12)
    unit = dna(32, rng)
    ref = [("a", "".join(dna(rng.randrange(20, 60), rng) + unit for _ in range(60)) + "N" * 9 + dna(200, rng)), ("b", dna(700, rng) + unit * 3), ("c", "ACG")]
    reads = [(i, (s := rng.choice(ref[:2])[1])[(a := rng.randrange(len(s) - 100)) : a + rng.randrange(30, 100)]) for i in range(120)] + [(500, "ACGT"), (501, "N" * 40), (502, None)]
    reads = [(i, s[:20] + "A" + s[21:] if s and i % 3 == 0 else s) for i, s in reads]
    r, f = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(ref, "contig string, seq string")

    def found():
        m = seeding.mems(r, f, 19)
        every = sorted(map(tuple, m.collect()))
        assert sorted(map(tuple, seeding.intervals(r, f, 19).collect())) == sorted(map(tuple, m.groupBy("read_id", "qbeg", "qend").count().collect()))
        assert sorted(map(tuple, seeding.sampled_mems(r, f, 19, 3).collect())) == sorted(map(tuple, seeding.stride_sample(m, 3).collect()))
        best = sorted(map(tuple, seeding.best_placements(m, r, f).collect()))
        assert sorted(map(tuple, seeding.best_placements(seeding.best_diagonals(r, f, 19), r, f).collect())) == best
        return every, best

    one = found()
    assert len(one[0]) > 2000
    monkeypatch.setattr(suffixes, "SHARD", 1 << 12)
    monkeypatch.setattr(suffixes, "PIECE", 1 << 9)
    assert found() == one


@pytest.mark.parametrize("mapped_files", [True, False])
def test_reads_are_scanned_once_over_a_large_reference(spark, monkeypatch, mapped_files):
    """Over several shards' places files are mapped: one scan, rounds and placements in it. Where only Spark reads the folder, shards give the same rows."""
    from strandloom.operators import mapped, suffixes

    names = ("seed_union", "best_placement", "seed_stride_sample", "mem_seeds")
    rows = lambda n: sorted(map(tuple, q.queries()[n](spark, SF).collect()))
    want = {n: rows(n) for n in names}
    monkeypatch.setattr(suffixes, "SHARD", 1 << 12)
    for x, n in (("SLICE", 21 << 6), ("COUNTED", 1 << 10), ("SORTED", 1 << 10)):
        monkeypatch.setattr(mapped, x, n)
    if mapped_files:
        for n in ("seed_union", "best_placement"):
            plan = q.queries()[n](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("MapInArrow") == 1 and not [x for x in ("Join", "Window", "Aggregate", "Union", "Repartition") if x in plan]
    else:
        monkeypatch.setattr(mapped, "folder", lambda spark: None)
    assert {n: rows(n) for n in names} == want


def test_reads_inside_of_frequent_repeats_are_placed(spark):
    """A read whose whole match is frequent goes to its first place, not to that of a rare part."""
    rng = random.Random(8)
    unit = dna(80, rng)
    ref = spark.createDataFrame([("a", dna(50, rng) + unit[10:40] + dna(50, rng)), ("b", "".join(dna(30, rng) + unit for _ in range(25)))], "contig string, seq string")
    reads = spark.createDataFrame([(1, unit), (2, unit[5:60])], "read_id long, seq string")
    got = sorted(map(tuple, seeding.placements(reads, ref, 19).collect()))
    assert got == [(1, "b", 0, 30, 80), (2, "b", 0, 35, 55)]


def test_records_are_shuffled_once_for_tags_and_mates(spark):
    plan = q.queries()["pair_records"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    lines_ = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert sum("qname" in x and "mate" in x for x in lines_) == 2 and not any("read_id" in x for x in lines_)


def test_minimizer_joins_send_no_index(spark):
    """Neither the index nor its counts go through the driver, however small Spark takes them to be."""
    df = q.queries()["minimizer_places"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "hash#" in x] and "SortMergeJoin [hash#" in plan


def test_minimizers_of_a_large_reference_are_looked_up_without_shuffle(spark, monkeypatch):
    from strandloom.operators import minimizers as mz

    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(q.queries()["minimizer_places"](spark, SF))
    monkeypatch.setattr(mz, "LARGE", 0)
    monkeypatch.setattr(mz, "FILE", 1 << 9)
    df = q.queries()["minimizer_places"](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("MapInArrow")[0] and not [x for x in plan.splitlines() if "Join" in x and "hash#" in x]
    assert df.dtypes == [("read_id", "bigint"), ("contig", "string"), ("strand", "int"), ("band", "bigint"), ("n", "bigint")] and rows(df) == want and len(want) > 1000
    # Letters of both cases, reads before a text's begin, none, short and unknown ones.
    rng = random.Random(3)
    ref = [("a", dna(500, rng).lower() + "N" * 20 + dna(300, rng)), ("b", dna(400, rng))]
    reads = [(i, dna(rng.randrange(0, 90), rng) + (s := rng.choice(ref)[1])[(a := rng.randrange(0, 300)) : a + 60]) for i in range(60)] + [(90, None), (91, "ACG"), (92, "N" * 50)]
    r, f = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(ref, "contig string, seq string")
    assert rows(mz.placed(r, f, 15, 5, 20)) == rows(mz.minimizer_places(mz.minimizers(r, ["read_id"], 15, 5), mz.minimizers(f, ["contig"], 15, 5), 20))


def test_pieces_are_those_of_the_text(spark):
    from strandloom.operators.cutting import pieces

    rng = random.Random(8)
    texts = {"a": dna(130, rng), "b": dna(50, rng), "c": "", "d": None, "e": "é" * 60}
    got = {(r["by"], r["start"], r["length"], r["piece"]) for r in pieces(spark.createDataFrame(list(texts.items()), "by string, seq string"), ["by"], 50, 3, 7, 2).collect()}
    assert got == {(n, i, len(s), s[max(0, i - 3) : i + 57]) for n, s in texts.items() if s for i in range(0, len(s) - 2, 50)}


def test_reads_are_placed(spark):
    got = q.queries()["align_se"](spark, SF).filter("mapq > 0").select("read_id", "contig", "pos", "cigar", "nm")
    from strandloom.plans.fixture import reads

    both = got.join(reads(spark, SF), "read_id").collect()
    right = [r for r in both if r["contig"] == r["truth_contig"] and abs(r["pos"] - r["truth_pos"]) <= 5]
    assert len(both) > 500 and len(right) > 0.95 * len(both)
    assert any("D" in r["cigar"] for r in right) and any(r["nm"] == 1 for r in right)


def test_align_se_is_the_same_in_shards_and_without_shuffle(spark, monkeypatch):
    """Regions don't leave the batch of their read: nothing is joined or sorted behind the scan. Several shards give the same rows."""
    from strandloom.operators import suffixes

    whole = q.queries()["align_se"](spark, SF)
    behind = whole._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
    assert behind and not [x for x in ("Join", "Window", "Aggregate", "Sort", "Repartition") if x in behind]
    monkeypatch.setattr(suffixes, "SHARD", 1 << 12)
    rows = whole.collect()
    assert len(rows) == 1671 and sorted(rows) == sorted(q.queries()["align_se"](spark, SF).select(whole.columns).collect())


@pytest.mark.parametrize("staged", [False, True])
def test_align_se_merges_collinear_regions(spark, monkeypatch, staged):
    """A read over a deletion that is longer than the band makes two chains, whose regions become one; a read without it stays."""
    import re

    from strandloom.operators import mapped, suffixes
    from strandloom.plans import align

    rng = random.Random(4)
    text = dna(9000, rng)
    reads = spark.createDataFrame([(1, text[1000:3000] + text[3150:5150]), (2, text[6000:6500])], "read_id long, seq string")
    if staged:
        monkeypatch.setattr(suffixes, "SHARD", 1 << 13)
        monkeypatch.setattr(mapped, "folder", lambda spark: None)
    got = align.align_se(reads, spark.createDataFrame([("c", text)], "contig string, seq string")).select("read_id", "pos", "qb", "qe", "score", "cigar", "nm").collect()
    (one, two) = sorted(map(tuple, got))
    assert one[:5] == (1, 1000, 0, 4000, 4000 - 6 - 150) and one[6] == 150 and sum(int(n) for n in re.findall(r"(\d+)M", one[5])) == 4000 and "150D" in one[5]
    assert two == (2, 6000, 0, 500, 500, "500M", 0)


def test_regions_of_arrays_settle_like_those_of_rows():
    from strandloom.operators import alignment, redundancy, sides

    rng, o = random.Random(9), Options(band=10, max_chain_gap=60)
    text = dna(400, rng)
    reads = [text[(a := rng.randrange(0, 200)) : a + 60] + text[a + 64 : a + 120] for _ in range(60)]
    q, read, _ = alignment.joined(reads)
    t, start, _ = alignment.joined([text])
    rows = []
    for k, s in enumerate(reads):
        a = text.index(s[:60])
        for _ in range(rng.randrange(1, 7)):
            qb, size = rng.randrange(0, 70), rng.randrange(10, 46)
            rb = a + qb + (4 if qb > 60 else 0) + rng.choice([0, 0, 0, 1])
            rows.append((k, qb, min(len(s), qb + size), rb, rb + size + rng.choice([0, 0, 2]), size, len(rows)))
    row, qb, qe, rb, re_, score, job = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    at, r = alignment.settled(q, read[row], t, np.zeros(len(row), np.int64) + start[0], row, np.zeros(len(row), np.int64), sides.Regions(qb, qe, rb, re_, score), job, o)
    got = sorted(zip(*(x[at].tolist() for x in (row, job, *r)), strict=True))
    want = []
    for k, s in enumerate(reads):
        for x in redundancy.settle([dict(zip(("qb", "qe", "rb", "re", "score", "job"), y[1:], strict=True)) for y in rows if y[0] == k], s, text, 0, o):
            want.append((k, x["job"], x["qb"], x["qe"], x["rb"], x["re"], x["score"]))
    changed = {(x[6], x[1]) for x in rows}
    assert got == sorted(want) and len(want) < len(rows) and any((x[1], x[2]) not in changed for x in want)


def test_chains_of_arrays_are_those_of_rows(spark):
    import numpy as np

    from strandloom.operators import chaining
    from strandloom.plans import align

    rng = random.Random(21)
    seen = set()
    for _ in range(4000):
        b, n = rng.randrange(80), rng.choice([19, 20, 32, 45, 64, 90])
        seen.add((rng.randrange(60), rng.randrange(2), b, b + n, rng.choice([0, 300, 900, 40_000]) + rng.randrange(200) + b))
    rows = sorted(seen, key=lambda r: (r[0], r[2], r[3]))
    df = spark.createDataFrame([(r, "c", s, b, e, p, p - b) for r, s, b, e, p in rows], "read_id long, contig string, strand int, qbeg int, qend int, rbeg int, diag int")
    row, text, qbeg, qend, rbeg = (np.array(x) for x in zip(*rows, strict=True))
    got = chaining.chained(row, text, qbeg, qend, rbeg, O)
    want = align.chains(df, O)
    names = ["read_id", "strand", "chain", "qbeg", "qend", "rbeg", "cb", "ce", "weight"]
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(map(tuple, want.select(names).collect()))
    left = chaining.filtered(got, O)
    assert sorted(zip(*(x.tolist() for x in left), strict=True)) == sorted(map(tuple, align.filter_chains(want, O).select(names).collect()))
    assert 0 < len(left.row) < len(got.row)


def _jobs(rng, n):
    """read, seed's begin and end, its begin on the target, target: flanks that are random, alike, alike behind a difference, or hold N."""

    def changed(s):
        s = list(s)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randint(0, 3)] = dna(rng.randint(0, 3), rng)
        return "".join(s)

    for _ in range(n):
        left, seed, right = dna(rng.randint(0, 90), rng), dna(rng.randint(19, 80), rng), dna(rng.randint(0, 90), rng)
        before, behind = dna(rng.randint(0, 2 * len(left)), rng), dna(rng.randint(0, 2 * len(right)), rng)
        kind = rng.randrange(4)
        if kind == 1:
            before, behind = dna(len(left), rng) + changed(left), changed(right) + dna(len(right), rng)
        elif kind == 2:
            unit = dna(rng.randint(5, 40), rng)
            left, before, right, behind = left[:30] + unit + "A", before + unit + "CG"[: rng.randint(1, 2)], "T" + unit + right[:30], "GC"[: rng.randint(1, 2)] + unit + behind
        elif kind == 3:
            left, behind = left[: len(left) // 2] + "NNN" + left[len(left) // 2 :], behind[: len(behind) // 2] + "N" + behind[len(behind) // 2 :]
        yield left + seed + right, len(left), len(left) + len(seed), len(before), before + seed + behind


def _arrays(texts):
    import numpy as np

    from strandloom.operators import sides

    size = np.array([len(x) for x in texts])
    return sides.CODES[np.frombuffer("".join(texts).encode(), np.uint8)], np.cumsum(size) - size, size


def test_sides_without_program_equal_those_with_it(monkeypatch):
    """Most sides next to repeats need no dynamic program, and no region differs from the one by the program alone."""
    import numpy as np

    from strandloom.operators import sides

    jobs, calls = list(_jobs(random.Random(22), 3000)), []
    reads, qbeg, qend, rbeg, targets = zip(*jobs, strict=True)
    (codes, read, size), (t, start, n) = _arrays(reads), _arrays(targets)

    def program(queries, *rest):
        calls.append(len(queries))
        return x.banded(queries, *rest)

    def regions():
        calls.clear()
        r = sides.regions(codes, read, size, t, start, start + n, np.array(qbeg), np.array(qend), start + np.array(rbeg), O, program)
        return [a.tolist() for a in r]

    got, few = regions(), sum(calls)
    monkeypatch.setattr(sides, "screens", lambda o: False)
    assert got == regions() and 0 < few < 0.7 * sum(calls)


def test_spelling_of_many_equals_that_of_one():
    import numpy as np

    from strandloom.operators import lanes, spelling

    rng = random.Random(23)
    pairs = [(j[0][: rng.randint(1, 60)], j[4][: rng.randint(1, 70)]) for j in _jobs(rng, 300)]
    for _ in range(700):
        t = dna(rng.randint(4, 90), rng)
        k, n = rng.randrange(1, len(t)), rng.randint(0, 3)
        s = t[:k] + rng.choice(["", "", "A", "CA", "N"]) + t[k + n :]
        pairs.append((s[: len(s) // 3] + rng.choice("ACGT") + s[len(s) // 3 + 1 :], t) if rng.random() < 0.3 else (s, t))
    queries, targets = map(list, zip(*pairs, strict=True))
    for o in (O, Options(band=3)):
        for s, t, (back, width) in zip(queries, targets, lanes.global_many(queries, targets, o), strict=True):
            assert x.traced(back, len(s), len(t), width) == x.align_global(s, t, o)[1]
    (codes, qb, m), (t_codes, tb, n) = _arrays(queries), _arrays(targets)
    head, tail, strand = (np.array([rng.choice(c) for _ in pairs]) for c in ((0, 0, 5), (0, 7), (0, 1)))
    cigar, nm, md = spelling.spelled(codes, qb, m, t_codes, tb, n, head, tail, strand, O)
    for k, (s, t) in enumerate(pairs):
        ops = [("M", len(s))] if len(s) == len(t) and sum(a != b for a, b in zip(s, t, strict=True)) <= 1 else x.align_global(s, t, O)[1]
        assert (cigar[k], nm[k], md[k]) == (spelling.text_of(ops, head[k], tail[k], strand[k]), *x.describe(s, t, ops))


def test_array_hashes_are_sparks(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from strandloom.operators import alignment

    names = ["", "ctg1", "chr10_long", "a contig of more than thirty-two letters, é"]
    rows = [(i * 7919 - 9000, names[i % 4], i % 2, i // 3 + 1) for i in range(200)]
    df = spark.createDataFrame(rows, "read_id long, contig string, strand int, chain long").select("*", F.xxhash64("read_id").alias("h"), F.xxhash64("read_id", "contig", "strand", "chain").alias("job")).collect()
    got = alignment.job_ids(np.array([r["h"] for r in df]), names, np.array([names.index(r["contig"]) for r in df]), np.array([r["strand"] for r in df]), np.array([r["chain"] for r in df]))
    assert got.tolist() == [r["job"] for r in df]


def test_option_texts():
    from strandloom import options

    assert options.unescape(r"a\tb\nc\\d\qe") == "a\tb\nc\\de" and options.unescape("x\\") == "x\\"
    assert options.read_group(r"@RG\tID:foo\tSM:bar") == ("@RG\tID:foo\tSM:bar", "foo")
    for bad in ("RG", r"@RG\tSM:x", r"@RG\tID:" + "x" * 256):
        with pytest.raises(ValueError):
            options.read_group(bad)
    assert options.int_pair("6,5") == (6, 5) and options.int_pair("6.5x") == (6, 5) and options.int_pair("6,-2") == (6, None) and options.int_pair("-3") == (-3, None)
    with pytest.raises(ValueError):
        options.int_pair("x")
    assert options.insert_option("500") == (500.0, 50.0, 300, 700) and options.insert_option("300,20,400,250") == (300.0, 20.0, 250, 400) and options.insert_option("10,50")[2] == 1
    with pytest.raises(ValueError):
        options.insert_option("")


def test_reference_texts_and_sinks(spark, tmp_path):
    from strandloom.sources import index_text

    (tmp_path / "x.ann").write_text("30 2 11\n0 chr1 a long note\n0 20 1\n0 chr2 (null)\n20 10 0\n")
    (tmp_path / "x.amb").write_text("30 2 1\n5 3 N\n")
    (tmp_path / "x.alt").write_text("@HD\n\nchr2\t0\nchr9\n")
    assert sorted(map(tuple, index_text.read_contigs(spark, str(tmp_path / "x.ann")).collect())) == [("chr1", "a long note", 0, 20, 1), ("chr2", "(null)", 20, 10, 0)]
    assert [tuple(r) for r in index_text.read_holes(spark, str(tmp_path / "x.amb")).collect()] == [(5, 3, "N")]
    assert sorted(r[0] for r in index_text.read_alternates(spark, str(tmp_path / "x.alt")).collect()) == ["chr2", "chr9"]
    lines = spark.createDataFrame([("a\tb",), ("c",)], "line string")
    for name in ("o.sam", "o.sam.gz"):
        index_text.write_records(lines, str(tmp_path / name))
        assert sorted(r[0] for r in spark.read.text(str(tmp_path / name)).collect()) == ["a\tb", "c"]
    index_text.write_records(lines, str(tmp_path / "o.parquet"))
    assert spark.read.parquet(str(tmp_path / "o.parquet")).count() == 2
    index_text.write_json(lines, str(tmp_path / "o.json"))
    assert spark.read.json(str(tmp_path / "o.json")).count() == 2
    with pytest.raises(ValueError):
        index_text.write_records(lines, str(tmp_path / "o.bam"))


def test_pair_scores_equal_formula(spark):
    import math

    from strandloom.operators import mates

    rows = [(a, b, d, 350.0, 40.0) for a, b in ((90, 80), (0, 0), (30, 5)) for d in range(100, 900, 37)]
    for r in mates.pair_scores(spark.createDataFrame(rows, "score1 int, score2 int, dist long, mean double, std double")).collect():
        p = 2 * math.erfc(abs(r["dist"] - 350) / 40 / math.sqrt(2))
        assert r["score"] == (max(0, int(r["score1"] + r["score2"] + 0.721 * math.log(p) + 0.499)) if p else 0)


@pytest.mark.parametrize("step", [1, 2, 4, 8])
def test_sampled_seeds_are_the_same_at_any_step(spark, step):
    rng = random.Random(9)
    unit = dna(30, rng)
    ref = [("a", dna(60, rng) + unit * 4 + "NN" + dna(5000, rng)), ("b", unit + dna(40, rng).lower() + unit), ("c", "ACG")]
    reads = [(i, (s := rng.choice(ref[:2])[1])[(a := rng.randrange(max(1, len(s) - 70))) : a + 70]) for i in range(40)] + [(90, "ACGT"), (91, "N" * 40), (92, unit * 2)]
    r, f = spark.createDataFrame(reads, "read_id long, seq string"), spark.createDataFrame(ref, "contig string, seq string")
    got = {tuple(x) for x in seeding.mems(r, f, 19, step).select("read_id", "contig", "strand", "qbeg", "qend", "rbeg").collect()}
    want = set()
    for name, s in ref:
        s = s.upper()
        for strand, t in ((0, s), (1, s[::-1].translate(str.maketrans("ACGT", "TGCA")))):
            places = {}
            for p in range(len(t) - 18):
                places.setdefault(t[p : p + 19], []).append(p)
            for i, q in reads:
                q = q.upper()
                for b in range(len(q) - 18):
                    for p in places.get(q[b : b + 19], ()) if "N" not in q[b : b + 19] else ():
                        if b and p and q[b - 1] == t[p - 1] != "N":
                            continue
                        n = 0
                        while b + n < len(q) and p + n < len(t) and q[b + n] == t[p + n] != "N":
                            n += 1
                        want.add((i, name, strand, b, b + n, p))
    assert got == want


def test_lanes_equal_cells():
    """Batched extension and local alignment against the plain programs, with other letters, empty targets and narrow bands."""
    from strandloom.operators import lanes

    rng = random.Random(11)
    some = lambda n: "".join(rng.choice("ACGTN" if rng.random() < 0.02 else "ACGT") for _ in range(n))
    for o in (O, Options(gap_open=(1, 1), mismatch=1, gap_extend=(1, 2)), Options(z_drop=10, band=5)):
        jobs = []
        for _ in range(200):
            t = some(rng.randint(1, 120))
            s = list(t[: rng.randint(1, len(t))])
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(s))
                s[k : k + rng.randint(0, 2)] = some(rng.randint(1, 3))
            jobs.append(("".join(s), t if rng.random() < 0.95 else "", rng.randint(1, 60)))
        queries, targets, h0 = zip(*jobs, strict=True)
        for bonus, band in ((0, 3), (5, 100)):
            assert [tuple(r) for r in lanes.extend_many(queries, targets, h0, o, bonus, band).tolist()] == [plain.extend(*j, o, bonus, band) for j in jobs]
        for got, (s, t, _) in zip(lanes.local_many(queries, targets, o, 15).tolist(), jobs, strict=True):
            want = plain.align_local(s, t, o)
            assert got[0] == want[0] and (not want[0] or tuple(got[1:5]) == want[1:])
    assert lanes.extend_many([], [], [], O, 0, 100).shape == (0, 6) and lanes.local_many([], [], O, 15).shape == (0, 6)


def test_second_score():
    from strandloom.operators.lanes import second_best

    assert second_best([(0, 30), (1, 20), (2, 25), (40, 50)], 50, 40, 2) == 30
    assert second_best([(38, 30), (40, 50)], 50, 40, 1) == -1 and second_best([], 0, -1, 1) == -1


def test_regions_settle(spark):
    """Redundant regions go, collinear ones become one alignment, others stay."""
    from strandloom.operators import redundancy as rd

    rng = random.Random(12)
    ref = dna(400, rng) + dna(20_000, rng)
    read = ref[100:160] + ref[163:230]
    region = lambda job, qb, qe, rb, re_, score, read_id=1: (job, read_id, "c", 0, qb, qe, rb, re_, score, score)
    df = spark.createDataFrame(
        [region(1, 0, 60, 100, 160, 60), region(2, 60, 127, 163, 230, 67), region(3, 1, 60, 101, 160, 50), region(4, 0, 60, 15_000, 15_060, 55), region(5, 0, 60, 100, 160, 60, 2), region(6, 0, 60, 300, 360, 20, 3), region(7, 0, 60, 300, 360, 20, 3)],
        "job long, read_id long, contig string, strand int, qb int, qe int, rb long, re long, score int, truesc int",
    )
    reads = spark.createDataFrame([(1, read), (2, read), (3, read)], "read_id long, seq string")
    got = sorted(tuple(r) for r in rd.merge_regions(df, reads, spark.createDataFrame([("c", ref)], "contig string, seq string")).select("job", "qb", "qe", "rb", "re", "score").collect())
    assert got == [(2, 0, 127, 100, 230, 127 - 9), (4, 0, 60, 15_000, 15_060, 55), (5, 0, 60, 100, 160, 60), (7, 0, 60, 300, 360, 20)]
    assert rd.merge_regions(df.limit(0), reads, spark.createDataFrame([("c", ref)], "contig string, seq string")).count() == 0


def test_mates_are_rescued(spark):
    """Mates cut from a known place, on either strand, are found in their windows with coordinates of both strands."""
    from strandloom.operators import mates

    rng = random.Random(13)
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    a, b = dna(3000, rng), dna(2000, rng)
    length, text = 5000, a + b
    both = text + rc(text)
    regions, reads, want = [], [], set()
    for k in range(12):
        start = (500 + 60 * k) if k % 2 else 3400 + 60 * k
        frag = text[start : start + 300]
        rb, mate_rb, near, far = (start, 2 * length - start - 300, frag[:70], rc(frag)[:70]) if k % 3 else (2 * length - start - 300, start, rc(frag)[:70], frag[:70])
        assert both[rb : rb + 70] == near and both[mate_rb : mate_rb + 70] == far
        regions.append((k, 0, 1, 70, 0, 70, rb, "a" if start < 3000 else "b", False, 0))
        reads += [(k, 0, near), (k, 1, far[:30] + ("A" if far[30] != "A" else "C") + far[31:])]
        want.add((k, mate_rb, mate_rb + 70, 0, 70, 65))
    found = mates.rank_regions(spark.createDataFrame(regions, "pair_id long, mate int, region_id long, score int, qb int, qe int, rb long, contig string, is_alt boolean, hash long"))
    stats = spark.createDataFrame([(0, 0, 0, True), (1, 150, 450, False), (2, 0, 0, True), (3, 0, 0, True)], "dir int, low int, high int, failed boolean")
    contigs = spark.createDataFrame([("a", 0, 3000), ("b", 3000, 2000)], "contig string, offset long, length long")
    windows = mates.rescue_windows(mates.anchors(found), found, stats, contigs, length, F.lit(70))
    got = mates.rescue(windows, spark.createDataFrame(reads, "pair_id long, mate int, seq string"), spark.createDataFrame([("a", a), ("b", b)], "contig string, seq string"), contigs, length).collect()
    assert {(r["pair_id"], r["rb"], r["re"], r["qb"], r["qe"], r["score"]) for r in got} == want and all(r["mate"] == 1 for r in got)
