"""Quality rules: fixed counts, and robust multivariate outliers per language and source. Native expressions only.

Four statistics of each text are transformed (logarithms and shares, shrunk towards a common value by a number of
imaginary words, so that short texts do not stand out by chance) and kept as whole numbers, which makes every sum exact
and the result the same in any order. Each group of language and source then gets its minimum-covariance-determinant
estimate. Three starts (medians with fixed widths, medians with interquartile widths, mean and covariance of all rows) go
through concentration steps: the KEEP share of rows nearest by Mahalanobis distance gives location and scatter anew, until
the determinant of the scatter stops falling. The start that ends with the least determinant is taken, and reweighted: the
rows within the TRIM quantile of its distances give the final location and scatter. A row whose squared distance to it
exceeds CUT is rejected.

A step is one aggregation to (group, start, distance bin): counts and moments per bin, summed up in the order of the bins,
of the last bin as large a fraction as completes the share. So a step shuffles groups times bins, whatever the number of
rows, and a hot group is added up where it lies.

Scatter has a floor (FLOOR, in units of the transformed statistics): where nearly all texts of a group agree, small
differences are no outliers. A group of fewer than LEAST rows is judged by the estimate of its language, and where that
has fewer too, by that of the whole table, whatever its size; so every row has a distance.

Defined cases: null, empty and blank texts have no words and fail the base rules; null language or source is a group of
its own; repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import SPACE, let, stored, text_or_empty, window_hashes

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UNIT = 1024
FLOOR = (0.06, 0.25, 0.06, 0.06)
SCALE = (0.12, 0.5, 0.12, 0.12)
KEEP, TRIM, LEAST = 0.75, 0.975, 50
#: Steps after which a start is given up as it stands; determinants can't rise, and fall by less each time.
STEPS = 30
#: Squared distance beyond which a text is an outlier: far above the 0.9999 quantile of chi-squared with 4 degrees (23.5).
CUT = 60.0
#: Groups up to which their estimates (15 numbers each) are broadcast; beyond, they are joined by shuffle.
BROADCAST_GROUPS = 100_000
P = 4
#: Name of the group of all rows; the others' names are digests.
WHOLE = ""


def _even_chi2(x: float, degrees: int) -> float:
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def _quantile(share: float) -> float:
    """Quantile of chi-squared with P degrees."""
    lo, hi = 0.0, 100.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _even_chi2(mid, P) < share else (lo, mid)
    return lo


def _consistency(share: float) -> float:
    """What makes the scatter of the nearest share of a normal sample that of the sample."""
    return share / _even_chi2(_quantile(share), P + 2)


def _without(text: Column, letters: str) -> Column:
    for c in letters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words that lie in windows of width words found at least twice. Texts without any leave after one hash set."""
    n = F.size(words)

    def covered(windows: Column) -> Column:
        tagged = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, k: ((k > 0) & same(x, F.greatest(k - 1, F.lit(0)))) | same(x, k + 1)), lambda x: x["i"]))

        total = lambda at: F.aggregate(at, F.struct(F.lit(0).alias("upto"), F.lit(0).alias("sum")), lambda acc, i: F.struct((i + width).alias("upto"), (acc["sum"] + i + width - F.greatest(i, acc["upto"])).alias("sum")))["sum"]
        return let(let(tagged, twice), total)

    def counted(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(covered(windows))

    return F.when(n > width, let(window_hashes(words, width), counted)).otherwise(F.lit(0)).cast("bigint")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document."""
    text = text_or_empty()
    bare = F.btrim(text, F.lit(WHITE))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE + "+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n"), repeated_words(w).alias("repeat")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    counts = docs.select("doc_id", "lang", "source", of_words.alias("w"), F.char_length(_without(text, WHITE)).cast("bigint").alias("word_chars"),
                         (F.char_length(text) - F.char_length(_without(text, SYMBOLS))).cast("bigint").alias("n_symbols"), of_lines.alias("l"))
    return counts.select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").cast("bigint").alias("n_dup_lines"), F.col("w.repeat").alias("n_repeat_words"), F.col("l.n").cast("bigint").alias("n_lines"))


def _vector() -> list[Column]:
    """The transformed statistics, in whole units."""
    n, col = F.col("n_words"), F.col
    parts = [
        F.log((col("word_chars") + 1000) / (n + 200)),
        F.log1p(50 * col("n_symbols") / (n + 50)),
        col("n_dup_lines") / (col("n_lines") + 10),
        col("n_repeat_words") / (n + 50),
    ]
    return [F.round(x * UNIT).cast("bigint").alias(f"x{i}") for i, x in enumerate(parts)]


def _distance() -> Column:
    """Squared Mahalanobis distance to the group's estimate: forward substitution with its Cholesky factor."""
    z: list[Column] = []
    for i in range(P):
        rest = (F.col(f"x{i}") / UNIT) - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * z[j]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MOMENTS = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS]]
ESTIMATE = [*[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS], "det"]


def _moments() -> list[Column]:
    sums = [F.sum(f"x{i}").cast("double").alias(f"s{i}") for i in range(P)]
    return [F.count("*").alias("n"), *sums, *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).cast("double").alias(f"q{i}{j}") for i, j in PAIRS]]


def _factor(scatter: Column) -> Column:
    """Cholesky factor of a scatter given as its lower triangle, row by row, with its floor: a fold over the triangle."""
    rows, columns = (F.lit([p[k] for p in PAIRS]) for k in range(2))
    at = lambda i, j: (i * (i + 1) / 2).cast("int") + j
    floors = F.array(*[F.lit(x**2) for x in FLOOR])

    def step(done: Column, k: Column) -> Column:
        i, j = F.get(rows, k), F.get(columns, k)
        before = F.when(j > 0, F.sequence(F.lit(0), j - 1)).otherwise(F.array().cast("array<int>"))
        rest = F.get(scatter, k) - F.aggregate(before, F.lit(0.0), lambda acc, m: acc + F.get(done, at(i, m)) * F.get(done, at(j, m)))
        return F.concat(done, F.array(F.when(i == j, F.sqrt(F.greatest(rest, F.get(floors, i)))).otherwise(rest / F.get(done, at(j, j)))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(PAIRS) - 1)), F.array().cast("array<double>"), step)


def _of_moments(rows: DataFrame, share: float, *names: str) -> DataFrame:
    """names and the estimate that the moments of the nearest share give."""
    factor = _consistency(share) if share < 1 else 1.0
    means = [(F.col(f"s{i}") / F.col("n") / UNIT).alias(f"m{i}") for i in range(P)]
    scatter = [(factor * (F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) / F.col("n") / UNIT**2) for i, j in PAIRS]
    factored = rows.select(*names, *means, _factor(F.array(*scatter)).alias("l"))
    lower = [F.get("l", k).alias(f"l{i}{j}") for k, (i, j) in enumerate(PAIRS)]
    spread = F.pow(F.get("l", 0) * F.get("l", 2) * F.get("l", 5) * F.get("l", 9), F.lit(2.0))
    return factored.select(*names, *[f"m{i}" for i in range(P)], *lower, spread.alias("det"))


def _measured(rows: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(estimates) if few else estimates, "group").withColumn("d2", _distance())


def _starts(rows: DataFrame) -> DataFrame:
    """group, all (its rows), start and the three starting estimates."""
    quartiles = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 10000).alias(f"p{i}") for i in range(P)]
    of = rows.groupBy("group").agg(*_moments(), *quartiles)
    medians = [(F.get(f"p{i}", 1) / UNIT).alias(f"m{i}") for i in range(P)]

    def diagonal(start: int, width) -> DataFrame:
        wide = [(width(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS]
        return of.select("group", F.col("n").alias("all"), F.lit(start).alias("start"), *medians, *wide, F.lit(float("inf")).alias("det"))

    fixed = diagonal(0, lambda i: F.lit(SCALE[i]))
    own = diagonal(1, lambda i: F.greatest((F.get(f"p{i}", 2) - F.get(f"p{i}", 0)) / UNIT / 1.349, F.lit(FLOOR[i])))
    plain = _of_moments(of.withColumn("all", F.col("n")).withColumn("start", F.lit(2)), 1.0, "group", "all", "start").withColumn("det", F.lit(float("inf")))
    return fixed.unionByName(own).unionByName(plain)


def _step(rows: DataFrame, now: DataFrame, few: bool) -> DataFrame:
    """group, all, start and the estimates that one concentration step from now gives."""
    bins = _measured(rows, now, few).groupBy("group", "all", "start", F.floor(8 * F.log1p("d2")).cast("int").alias("bin")).agg(*_moments())
    # added in the order of the bins, so that the last digits are the same each time
    gathered = bins.groupBy("group", "all", "start").agg(F.sort_array(F.collect_list(F.struct("bin", *MOMENTS))).alias("b"))
    wanted = F.ceil(F.col("all") * KEEP).cast("double")

    def add(acc: Column, x: Column) -> Column:
        part = F.least(x["n"].cast("double"), F.greatest(wanted - acc["n"], F.lit(0.0))) / x["n"]
        return F.struct(*[(acc[c] + part * x[c]).alias(c) for c in MOMENTS])

    total = F.aggregate("b", F.struct(*[F.lit(0.0).alias(c) for c in MOMENTS]), add)
    return _of_moments(gathered.select("group", "all", "start", total.alias("t")).select("group", "all", "start", "t.*"), KEEP, "group", "all", "start")


def estimates(rows: DataFrame) -> tuple[DataFrame, bool]:
    """group, all (its rows), location m, Cholesky factor l and determinant of every group of rows; whether they are few."""
    now = stored(_starts(rows), "estimates", "few")
    few = now.count() <= BROADCAST_GROUPS
    size = "few" if few else "small"
    old, done = now, None
    for _ in range(STEPS):
        new = _step(rows, now, few)
        both = new.join(old.select("group", "start", F.col("det").alias("was")), ["group", "start"])
        falling = stored(both.where(F.col("det") < F.col("was") * (1 - 1e-9)).drop("was"), "estimates", size)
        done = falling if done is None else done.unionByName(falling)
        old = now = falling
        if falling.isEmpty():
            break
    best = done.groupBy("group").agg(F.max("all").alias("all"), F.min(F.struct("det", "start", *ESTIMATE[:-1])).alias("e"))
    best = stored(best.select("group", "all", "e.*").drop("start"), "estimates", size)
    near = _measured(rows, best, few).where(F.col("d2") <= _quantile(TRIM)).groupBy("group", "all").agg(*_moments())
    # a group of which few rows lie so near is far from normal: there the raw estimate stays
    weighted = _of_moments(near.where(2 * F.col("n") >= F.col("all") * KEEP), TRIM, "group", "all")
    rest = best.join(weighted.select("group"), "group", "left_anti")
    return stored(weighted.unionByName(rest.select(weighted.columns)), "estimates", size), few


def outlier_distances(rows: DataFrame) -> DataFrame:
    """rows (group, language, x0 to x3, ...) with d2, the squared robust distance to the narrowest estimate of enough rows."""
    sizes = rows.groupBy("group", "language").agg(F.count("*").alias("n"))
    of_language = Window.partitionBy("language")
    sizes = sizes.withColumn("near", F.sum("n").over(of_language))
    seats = sizes.withColumn("seat", F.when(F.col("n") >= LEAST, F.col("group")).when(F.col("near") >= LEAST, F.col("language")).otherwise(F.lit(WHOLE)))
    seats = stored(seats.withColumn("lends", F.max((F.col("seat") == F.col("language")).cast("int")).over(of_language) == 1), "seats", "small")
    few = seats.count() <= BROADCAST_GROUPS
    whole = F.lit(not seats.where(F.col("seat") == WHOLE).isEmpty())
    levels = F.array_compact(F.array(F.when(F.col("n") >= LEAST, F.col("group")), F.when(F.col("lends"), F.col("language")), F.when(whole, F.lit(WHOLE))))
    feeds = seats.select("group", levels.alias("levels"))
    members = rows.select("group", *[f"x{i}" for i in range(P)]).join(F.broadcast(feeds) if few else feeds, "group")
    found, few = estimates(members.select(F.explode("levels").alias("group"), *[f"x{i}" for i in range(P)]))
    lent = seats.select("group", "seat").join(found.drop("all").withColumnRenamed("group", "seat"), "seat").drop("seat")
    return _measured(rows, lent, few)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept."""
    name = lambda *columns: F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    rows = stored(statistics(docs).withColumn("group", name("lang", "source")).withColumn("language", name("lang")).select("*", *_vector()), "statistics")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = outlier_distances(rows).withColumn("base_failed", failed)
    kept = ~F.col("base_failed") & (F.col("d2") <= CUT)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance"))
