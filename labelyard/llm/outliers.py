"""Quality rules and robust multivariate outliers, in DataFrame operations only.

Statistics of whole texts come from string and array functions. Their transformed vectors are
judged in each language and source by minimum-covariance-determinant estimates. All documents that
pass the base rules are counted in cells of a grid, so that the estimates work on cells with exact
integer sums, give the same on any layout, and cost no more than the grid allows. From several
starts, concentration steps take the mean and covariance of the three quarters of the rows with the
smallest distances until the determinant stops falling; the least determinant wins. A least spread
is added to each covariance, with which the steps still never raise the determinant. Small groups
lean on their language's estimate. A row fails whose squared Mahalanobis distance is beyond a
quantile of the chi-squared distribution.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hot import join_split
from ..operators.persist import cut, remove, written

#: A word is a run of other characters than these.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Coordinates of the transformed vector.
VECTOR = ("x1", "x2", "x3", "x4")
SHARE = 0.75
#: Cells of the grid in a unit of a coordinate.
GRID = 64
#: Concentration steps end when no determinant falls by this share. A determinant can't fall below
#: that of the least spreads, so they do end.
FALL = 1e-6
#: Bins of a distance in a unit, and the bin of all distances beyond.
BINS, MOST_BINS = 16, 4096
#: Squared distance beyond which a row fails: 4 degrees of freedom, probability 1e-6.
LIMIT = 33.38
#: 0.75 / P(chi2 with 6 degrees <= the 0.75 quantile of 4): makes the estimate consistent.
CONSISTENT = 1.479
#: Least spread of each coordinate, so that a constant one can't make a distance infinite.
LEAST_SPREAD = (0.35, 0.08, 0.08, 0.08)
#: Rows at which a group's estimate weighs as much as its language's (and that as much as all's).
LEAN = 60


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in a window of 5 words that the text has twice or more, from an array of words."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def again(s: Column) -> Column:
        near = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, j: near(x, j - 1) | near(x, j + 1)), lambda x: x["i"]))

    covered = lambda at: F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    placed = lambda h: F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    # most texts have no window twice, which needs no order
    count = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _let(F.array_sort(placed(h)), lambda s: covered(again(s)))).otherwise(0)
    return F.when(F.size(words) > WINDOW, _let(hashes, count)).otherwise(0).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """docs' doc_id, lang and source with n_words, word_chars, n_symbols, n_dup_lines and
    n_repeat_words. A null text has none of anything."""
    text = F.coalesce("text", F.lit(""))
    white = F.translate(text, WHITE[1:], " " * 5)
    words = F.filter(F.split(white, " +"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source",
        _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "lang", "source", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    parts = (F.log(n), F.log1p(F.col("word_chars") / n), F.log1p(10 * F.col("n_symbols") / n), F.log1p(10 * F.col("n_dup_lines") / n))
    return [x.alias(name) for x, name in zip(parts, VECTOR, strict=True)]


PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i + 1)]
MEAN, COVARIANCE, FACTOR = [f"m_{i}" for i in range(len(VECTOR))], [f"c_{i}{j}" for i, j in PAIRS], [f"l_{i}{j}" for i, j in PAIRS]
CELL = [f"q{i}" for i in range(len(VECTOR))]


def cells(good: DataFrame) -> DataFrame:
    """(key, cell, n): the rows of ``good`` in each cell of the grid, for their language and source
    ("narrow"), their language ("wide") and all."""
    at = [F.round(F.col(x) * GRID).cast("long").alias(q) for x, q in zip(VECTOR, CELL, strict=True)]
    fine = good.select("narrow", "wide", *at).groupBy("narrow", "wide", *CELL).agg(F.count(F.lit(1)).alias("n"))
    levels = [F.concat(F.lit("narrow "), "narrow"), F.concat(F.lit("wide "), "wide"), F.lit("all")]
    return fine.select(F.explode(F.array(*levels)).alias("key"), *CELL, "n").groupBy("key", *CELL).agg(F.sum("n").alias("n"))


def _factored(estimate: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_ij of the covariance, with the least spreads added, and the
    logarithm of the determinant."""
    out, d = estimate, len(VECTOR)
    for j in range(d):
        for i in range(j, d):
            c = F.col(f"c_{i}{j}") * CONSISTENT
            if i == j:
                c = c + LEAST_SPREAD[i] ** 2
            for k in range(j):
                c = c - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            out = out.withColumn(f"l_{i}{j}", F.sqrt(F.greatest(c, F.lit(1e-9))) if i == j else c / F.col(f"l_{j}{j}"))
    return out.withColumn("log_det", sum((2 * F.log(f"l_{i}{i}") for i in range(1, d)), 2 * F.log("l_00")))


def _distance(vector: list[Column]) -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    total, z = F.lit(0.0), []
    for i, x in enumerate(vector):
        x = x - F.col(f"m_{i}")
        for k in range(i):
            x = x - F.col(f"l_{i}{k}") * z[k]
        z.append(x / F.col(f"l_{i}{i}"))
        total = total + z[i] * z[i]
    return total


def _estimated(part: DataFrame, *keys: str) -> DataFrame:
    """Mean, covariance, factor and determinant of cells, each with ``take`` of its rows. The sums
    are of whole numbers, so that no order of rows changes a digit."""
    exact = lambda c: F.sum((F.col("take") * c).cast("decimal(38,0)"))
    rows = exact(F.lit(1)).cast("double")
    mean = [(exact(F.col(q)).cast("double") / rows / GRID).alias(m) for q, m in zip(CELL, MEAN, strict=True)]
    # n * sum(xy) - sum(x) * sum(y) in decimals would be exact, too, but this is as repeatable
    square = [(exact(F.col(f"q{i}") * F.col(f"q{j}")).cast("double") / rows / GRID**2).alias(f"s_{i}{j}") for i, j in PAIRS]
    out = part.groupBy(*keys).agg(*mean, *square)
    covariance = [F.col(f"s_{i}{j}") - F.col(f"m_{i}") * F.col(f"m_{j}") for i, j in PAIRS]
    return _factored(out.select(*keys, *MEAN, *[c.alias(n) for c, n in zip(covariance, COVARIANCE, strict=True)]))


def _nearest(grid: DataFrame, order: Column, *keys: str) -> DataFrame:
    """The cells with ``take``: of each key's rows the first three quarters by ``order``, which isn't
    negative, ties by cell; a cell may count in part.

    Rows are counted by bins of ``order`` first. Only the bin in which the quarter ends is put in
    order, so no window sees all cells of a key.
    """
    some = grid.withColumn("_o", order).withColumn("_b", F.least(F.floor(F.col("_o") * BINS), F.lit(MOST_BINS)).cast("int"))
    each, up = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_b")
    bins = some.groupBy(*keys, "_b").agg(F.sum("n").alias("_n")).withColumn("_c", F.sum("_n").over(up)).withColumn("_half", F.ceil(SHARE * F.sum("_n").over(each)))
    ends = bins.filter((F.col("_c") >= F.col("_half")) & (F.col("_c") - F.col("_n") < F.col("_half"))).select(*keys, F.col("_b").alias("_end"), (F.col("_half") - F.col("_c") + F.col("_n")).alias("_left"))
    near = some.join(ends, list(keys)).filter(F.col("_b") <= F.col("_end"))
    last = near.filter(F.col("_b") == F.col("_end")).withColumn("_before", F.sum("n").over(Window.partitionBy(*keys).orderBy("_o", *CELL)) - F.col("n"))
    own = grid.columns
    whole = near.filter(F.col("_b") < F.col("_end")).select(*own, F.col("n").alias("take"))
    return whole.unionByName(last.withColumn("take", F.least(F.col("n"), F.col("_left") - F.col("_before"))).filter("take > 0").select(*own, "take"))


def starts(grid: DataFrame) -> DataFrame:
    """(key, start, estimate): of the rows nearest to the medians by the largest and by the summed
    deviation in units of least spreads and median deviations, and of all rows."""

    def middle(rows: DataFrame, value: Column, name: str) -> DataFrame:
        """(key, name): the lower median of a coordinate of cells. A window sees its values."""
        some = rows.groupBy("key", value.alias("_v")).agg(F.sum("n").alias("n"))
        some = some.withColumn("_c", F.sum("n").over(Window.partitionBy("key").orderBy("_v"))).withColumn("_t", F.sum("n").over(Window.partitionBy("key")))
        return some.filter(2 * F.col("_c") >= F.col("_t")).groupBy("key").agg(F.min("_v").alias(name))

    off = grid
    for i, q in enumerate(CELL):
        off = off.join(middle(grid, F.col(q), f"a{i}"), "key")
        off = off.withColumn(f"a{i}", F.abs(F.col(q) - F.col(f"a{i}")))
    off = written(off)
    scaled = off
    for i in range(len(CELL)):
        scaled = scaled.join(middle(off, F.col(f"a{i}"), f"b{i}"), "key")
    apart = [F.col(f"a{i}") / F.greatest(1.4826 * F.col(f"b{i}"), F.lit(LEAST_SPREAD[i] * GRID)) for i in range(len(CELL))]
    scaled = written(scaled.select("key", *CELL, "n", F.greatest(*apart).alias("widest"), sum(apart[1:], apart[0]).alias("summed")))
    some = [_nearest(scaled, F.col(o), "key").withColumn("start", F.lit(k)) for k, o in enumerate(("widest", "summed"))]
    everything = scaled.withColumn("take", F.col("n")).withColumn("start", F.lit(2))
    parts = reduce(DataFrame.unionByName, [p.select("key", "start", *CELL, "take") for p in (*some, everything)])
    return written(_estimated(parts, "key", "start"))


def robust(grid: DataFrame) -> DataFrame:
    """(key, n, MEAN..., COVARIANCE..., log_det) of each key of ``cells``."""
    grid = written(grid)
    estimate = starts(grid)
    falls = True
    while falls:
        far = grid.join(estimate, "key")
        part = _nearest(far.select("key", "start", *CELL, "n", F.round(_distance([F.col(q) / GRID for q in CELL]), 9).alias("d")), F.col("d"), "key", "start")
        new = written(_estimated(part, "key", "start"))
        old = estimate.select("key", "start", F.col("log_det").alias("old"))
        falls = not new.join(old, ["key", "start"]).filter(F.col("log_det") < F.col("old") - FALL).isEmpty()
        remove(estimate)
        estimate = new
    best = estimate.groupBy("key").agg(F.min_by(F.struct(*MEAN, *COVARIANCE, "log_det"), F.struct("log_det", "start")).alias("e"))
    return best.join(grid.groupBy("key").agg(F.sum("n").alias("n")), "key").select("key", "n", "e.*")


def leaning(own: str, n: Column, on: list[Column]) -> list[Column]:
    """Mean and covariance in struct ``own`` of n rows, drawn towards those in ``on``."""
    share = F.coalesce(n / (n + LEAN), F.lit(0.0))
    return [F.coalesce(share * F.col(f"{own}.{c}"), F.lit(0.0)) + (1 - share) * other for c, other in zip((*MEAN, *COVARIANCE), on, strict=True)]


def chosen(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """(narrow, MEAN..., FACTOR...) for each group of ``rows`` that any estimate exists for."""
    parameters = [*MEAN, *COVARIANCE]
    base = estimates.filter("key = 'all'").first()
    groups = rows.select("narrow", "wide").distinct()
    if base is None:
        return _factored(groups.select("narrow", *[F.lit(0.0).alias(c) for c in parameters])).limit(0)
    struct = F.struct("n", *parameters)
    wide = estimates.select(F.col("key").alias("wide_key"), struct.alias("w"))
    narrow = estimates.select(F.col("key").alias("narrow_key"), struct.alias("own"))
    found = groups.join(wide, F.concat(F.lit("wide "), "wide") == F.col("wide_key"), "left").join(narrow, F.concat(F.lit("narrow "), "narrow") == F.col("narrow_key"), "left")
    of_language = leaning("w", F.col("w.n"), [F.lit(float(base[c])) for c in parameters])
    found = found.select("narrow", "own", *[c.alias(f"w_{p}") for c, p in zip(of_language, parameters, strict=True)])
    own = leaning("own", F.col("own.n"), [F.col(f"w_{p}") for p in parameters])
    return _factored(found.select("narrow", *[c.alias(p) for c, p in zip(own, parameters, strict=True)])).select("narrow", *MEAN, *FACTOR)


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    distance) for each row of ``docs``.

    Null texts have no words and fail. Null languages and sources are groups of their own.
    Estimates use the rows that pass the base rules. A group of n such rows weighs its own estimate
    by n / (n + LEAN) and its language's by the rest, and so does a language with that of all rows.
    With no rows that pass, none is kept.
    """
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = statistics(docs).withColumn("base_failed", base_failed())
    rows = cut(rows.select("*", *_vector(), name("lang").alias("wide"), F.to_json(F.struct(name("lang"), name("source"))).alias("narrow")).drop("lang", "source"))
    estimates = written(robust(cells(rows.filter("not base_failed"))))
    judged = join_split(rows, written(chosen(rows, estimates)), "narrow", by="doc_id", how="left").withColumn("distance", _distance([F.col(x) for x in VECTOR]))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= LIMIT, F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
