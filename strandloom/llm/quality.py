"""Operator 10, quality rules: robust multivariate outliers (native: DataFrame functions only).

Words are runs of anything but ASCII white space. A text fails the base rule with under 50 words, or when more than half
of its words lie in 3-word windows that the text has twice or more. The others are judged by four transformed statistics
(mean word length, symbols a word, repeated lines, repeated windows): for each language and source the
minimum-covariance-determinant estimate of centre and scatter is found by concentration steps, and a text is rejected
when its squared Mahalanobis distance is over CUTOFF.

A concentration step is one aggregation: moments are summed per group and distance bin, partial sums first, so that a
group with a third of all rows is never gathered in one task; of the bin that the group's share ends in, the part that is
wanted is taken. Two starts run side by side (medians with quartile ranges; plain mean and covariance), steps go on until
no group's log determinant falls by SETTLED (STEPS at most), and the smaller determinant wins. An estimate needs MIN_GROUP
rows, a parameter of the method: smaller groups are pooled by language, then over all languages, and their texts are
judged by the pool's estimate. A scatter gets FLOORS squared on its diagonal: constant statistics don't make it singular.

Nulls: a null text has no words (n_words 0, base_failed, not kept); null lang or source is a group of its own; ids may be
null or repeated, as no step joins on them. Texts of any length are counted whole, in their own row. Columns of docs may
have any names: a row travels as one struct. Empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import as_row, discard, let, stored

#: Quantile 1 - 1e-5 of chi squared with four degrees of freedom.
CUTOFF = 28.473
#: Share of a group that the determinant is taken over, and the factor that makes its scatter consistent for normal data.
SHARE, CONSISTENT = 0.75, 1.485
#: Least standard deviation of each statistic.
FLOORS = (0.1, 0.06, 0.15, 0.2)
MIN_GROUP, STEPS, SETTLED, P = 50, 12, 1e-3, 4
MIN_WORDS = 50
SPACE = " \t\n\x0b\f\r"
#: Windows are first compared by the upper 40 bits of a hash, with the place in the lower 24.
PLACE = 24
X = [f"_x{i}" for i in range(1, P + 1)]
M = [f"_m{i}" for i in range(1, P + 1)]
LOW = [(i, j) for i in range(1, P + 1) for j in range(1, i + 1)]


def n_repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more. Hashes find candidates, the windows themselves decide."""
    n = F.size(words)

    def at(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

    def twins(keys: Column, same) -> Column:
        return F.filter(keys, lambda x, j: F.coalesce(same(x, F.get(keys, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(keys, j + 1)), F.lit(False)))

    def exact(w: Column, places: Column) -> Column:
        keys = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *at(w, i)).alias("s"), i.alias("i"))))
        found = let(keys, lambda k: twins(k, lambda x, y: x["s"] == y["s"]))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def candidates(hashes: Column) -> Column:
        keys = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, PLACE), PLACE).bitwiseOR(i.cast("long"))))
        found = let(keys, lambda k: twins(k, lambda x, y: F.shiftrightunsigned(x, PLACE) == F.shiftrightunsigned(y, PLACE)))
        return F.transform(found, lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"))

    def count(w: Column, every: Column) -> Column:
        hashes = F.transform(every, lambda i: F.xxhash64(*at(w, i)))
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0))
            .when(F.size(h) >= (1 << PLACE), exact(w, every))
            .otherwise(let(candidates(h), lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(exact(w, c)))),
        )

    return F.when(n < 4, F.lit(0)).otherwise(let(words, lambda w: let(F.sequence(F.lit(0), F.size(w) - 3), lambda every: count(w, every)))).cast("long")


def text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the statistics; their columns begin with _q_ (and _x for the transformed ones)."""
    t = F.coalesce(F.col(text), F.lit(""))
    cut = F.btrim(t, F.lit(SPACE))
    df = docs.withColumn("_q_words", F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, r"[\x20\x09-\x0D]+")))
    df = df.withColumn("_q_lines", F.filter(F.split(t, "\n", -1), lambda s: F.btrim(s, F.lit(SPACE)) != ""))
    df = df.withColumns({
        "_q_n_words": F.size("_q_words").cast("long"),
        "_q_word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "_q_n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long"),
        "_q_n_lines": F.size("_q_lines").cast("long"),
        "_q_n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "_q_n_repeat_words": n_repeat_words(F.col("_q_words")),
    })
    n = F.greatest(F.col("_q_n_words"), F.lit(1)).cast("double")
    return df.drop("_q_words", "_q_lines").withColumns({
        "_q_base_failed": (F.col("_q_n_words") < MIN_WORDS) | (100 * F.col("_q_n_repeat_words") > 50 * F.col("_q_n_words")),
        X[0]: F.log(F.greatest(F.col("_q_word_chars"), F.lit(1)) / n),
        X[1]: F.sqrt(F.col("_q_n_symbols") / n),
        X[2]: F.sqrt(F.col("_q_n_dup_lines") / F.greatest(F.col("_q_n_lines"), F.lit(1))),
        X[3]: F.sqrt(F.col("_q_n_repeat_words") / n),
    })


def _keys(df: DataFrame) -> DataFrame:
    return df.withColumns({"_lang": F.coalesce(F.col("lang").cast("string"), F.lit("\x00")), "_source": F.coalesce(F.col("source").cast("string"), F.lit("\x00"))})


def _groups(rows: DataFrame) -> DataFrame:
    """_lang, _source, _group: small groups pooled by language, then over all."""
    sizes = rows.groupBy("_lang", "_source").count()
    sizes = sizes.withColumn("_group", F.when(F.col("count") >= MIN_GROUP, F.to_json(F.struct("_lang", "_source"))).otherwise(F.to_json(F.struct("_lang"))))
    pooled = F.sum("count").over(Window.partitionBy("_group"))
    return sizes.withColumn("_group", F.when(pooled >= MIN_GROUP, F.col("_group")).otherwise(F.lit("*"))).select("_lang", "_source", "_group")


def _distance(df: DataFrame) -> DataFrame:
    """_d2 by forward substitution with the Cholesky factor's columns."""
    for i in range(1, P + 1):
        rest = F.col(X[i - 1]) - F.col(M[i - 1])
        for j in range(1, i):
            rest = rest - F.col(f"_l{i}{j}") * F.col(f"_z{j}")
        df = df.withColumn(f"_z{i}", rest / F.col(f"_l{i}{i}"))
    return df.withColumn("_d2", sum((F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(1, P + 1)), F.lit(0.0))).drop(*(f"_z{i}" for i in range(1, P + 1)))


def _sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("_n"), *(F.sum(x).alias(f"_s{i}") for i, x in enumerate(X, 1)), *(F.sum(F.col(X[i - 1]) * F.col(X[j - 1])).alias(f"_s{i}{j}") for i, j in LOW)]


def _estimate(sums: DataFrame, factor: float, by: list[str]) -> DataFrame:
    """Centre, Cholesky factor and log determinant of factor times the covariance plus the floors."""
    df = sums.select(*by, *((F.col(f"_s{i}") / F.col("_n")).alias(M[i - 1]) for i in range(1, P + 1)), "_n", *(f"_s{i}{j}" for i, j in LOW))
    df = df.withColumns({f"_c{i}{j}": factor * (F.col(f"_s{i}{j}") / F.col("_n") - F.col(M[i - 1]) * F.col(M[j - 1])) + F.lit(FLOORS[i - 1] ** 2 if i == j else 0.0) for i, j in LOW})
    for j in range(1, P + 1):
        for i in range(j, P + 1):
            rest = F.col(f"_c{i}{j}")
            for k in range(1, j):
                rest = rest - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            df = df.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(rest, F.lit(FLOORS[i - 1] ** 2 / 4))) if i == j else rest / F.col(f"_l{j}{j}"))
    df = df.withColumn("_det", sum((F.log(f"_l{i}{i}") for i in range(1, P + 1)), F.lit(0.0)))
    return df.select(*by, "_det", *M, *(f"_l{i}{j}" for i, j in LOW))


def _medians(rows: DataFrame) -> DataFrame:
    """First start: medians and quartile ranges, from histograms of 1/256 wide bins."""
    bins = rows.select("_group", F.posexplode(F.array(*X)).alias("_j", "_v")).groupBy("_group", "_j", F.floor(F.col("_v") * 256).alias("_b")).count()
    w = Window.partitionBy("_group", "_j")
    bins = bins.withColumns({"_at": F.sum("count").over(w.orderBy("_b")), "_all": F.sum("count").over(w)})
    q = bins.groupBy("_group", "_j").agg(*(F.min(F.when(F.col("_at") >= share * F.col("_all"), (F.col("_b") + 0.5) / 256)).alias(name) for name, share in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))))
    q = q.groupBy("_group").agg(*(F.max(F.when(F.col("_j") == i, F.col("q2"))).alias(M[i]) for i in range(P)), *(F.max(F.when(F.col("_j") == i, F.greatest((F.col("q3") - F.col("q1")) / 1.349, F.lit(FLOORS[i])))).alias(f"_l{i + 1}{i + 1}") for i in range(P)))
    return q.select("_group", F.lit(0).alias("_start"), F.lit(0.0).alias("_det"), *M, *((F.col(f"_l{i}{j}") if i == j else F.lit(0.0)).alias(f"_l{i}{j}") for i, j in LOW))


def fit(stats: DataFrame) -> DataFrame:
    """_lang, _source and the estimate of their group. stats: of text_stats, best read from a stored table."""
    rows = _keys(stats.filter(~F.col("_q_base_failed"))).select("_lang", "_source", *X)
    groups = stored(_groups(rows), "quality-groups")
    rows = rows.join(groups, ["_lang", "_source"]).drop("_lang", "_source")
    plain = _estimate(rows.groupBy("_group").agg(*_sums()), 1.0, ["_group"]).withColumn("_start", F.lit(1))
    found = start = stored(_medians(rows).unionByName(plain), "quality-start")
    by = ["_group", "_start"]
    w = Window.partitionBy(*by)
    moments = ["_n", *(f"_s{i}" for i in range(1, P + 1)), *(f"_s{i}{j}" for i, j in LOW)]
    for step in range(STEPS):
        near = _distance(rows.join(found, "_group")).groupBy(*by, F.floor(16 * F.log2(1 + F.col("_d2"))).alias("_bin")).agg(*_sums())
        near = near.withColumns({"_before": F.sum("_n").over(w.orderBy("_bin")) - F.col("_n"), "_wanted": F.ceil(SHARE * F.sum("_n").over(w))}).filter("_before < _wanted")
        part = F.least(F.lit(1.0), (F.col("_wanted") - F.col("_before")) / F.col("_n"))
        sums = near.groupBy(*by).agg(*(F.sum(F.col(c) * part).alias(c) for c in moments))
        now = stored(_estimate(sums, CONSISTENT, by).join(found.select(*by, F.col("_det").alias("_last")), by), "quality-step")
        fell = now.agg(F.max(F.col("_last") - F.col("_det"))).first()[0]
        discard(start)
        start, found = now, now.drop("_last")
        if fell is None or step and fell < SETTLED:
            break
    best = found.groupBy("_group").agg(F.min_by(F.struct(*M, *(f"_l{i}{j}" for i, j in LOW)), F.struct("_det", "_start")).alias("_b")).select("_group", "_b.*")
    return groups.join(best, "_group").drop("_group")


def judge(stats: DataFrame, estimates: DataFrame) -> DataFrame:
    """stats with _d2 and _kept."""
    df = _distance(_keys(stats).join(estimates, ["_lang", "_source"], "left"))
    df = df.withColumn("_kept", ~F.col("_q_base_failed") & F.coalesce(F.col("_d2") <= CUTOFF, F.lit(True)))
    return df.drop("_lang", "_source", *M, *(f"_l{i}{j}" for i, j in LOW))


def quality_table(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the statistics, base_failed, kept, distance2."""
    wanted = ["_q_n_words", "_q_word_chars", "_q_n_symbols", "_q_n_dup_lines", "_q_n_repeat_words", "_q_base_failed"]
    stats = stored(text_stats(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "lang", "source", *wanted, *X), "quality-stats")
    return judge(stats, fit(stats)).select("doc_id", *(F.col(c).alias(c[3:]) for c in wanted), F.col("_kept").alias("kept"), F.col("_d2").alias("distance2"))


def keep_quality(docs: DataFrame) -> DataFrame:
    """docs without those that the rules reject; columns as they were. Statistics are stored beside the rows, once."""
    stats = stored(text_stats(docs.select(as_row(docs), "text", "lang", "source")).select("row", "lang", "source", "_q_base_failed", *X), "quality-rows")
    return judge(stats, fit(stats)).filter("_kept").select("row.*")
