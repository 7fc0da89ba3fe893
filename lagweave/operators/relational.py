"""Operators on series in long form, as DataFrame plans alone: (series_id, t, value), t from 1 and
without holes unless stated. A row meets the cells of the trajectory matrix that stand for it by an
explode of offsets, so there is no range join, and sums combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(n: Column | int) -> Column:
    """An array 0, 1, ... n - 1."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)


def lengths(series: DataFrame) -> DataFrame:
    return series.groupBy("series_id").agg(F.max("t").alias("n"))


def embed(series: DataFrame, window: int) -> DataFrame:
    """(series_id, i, j, x): cells of the trajectory matrix, indices from 1; X[i, j] = F[i + j - 1]."""
    cells = series.join(lengths(series), "series_id").select("series_id", "n", "t", "value", F.explode(offsets(window)).alias("o"))
    cells = cells.select("series_id", (F.col("o") + 1).alias("i"), (F.col("t") - F.col("o")).alias("j"), F.col("value").alias("x"), "n")
    return cells.where((F.col("j") >= 1) & (F.col("j") <= F.col("n") - window + 1)).drop("n")


def lag_vectors(series: DataFrame, window: int) -> DataFrame:
    """(series_id, j, lag): each complete window as an array, by a frame over the sorted series."""
    frame = Window.partitionBy("series_id").orderBy("t").rowsBetween(0, window - 1)
    rows = series.withColumn("lag", F.collect_list("value").over(frame)).where(F.size("lag") == window)
    return rows.select("series_id", F.col("t").alias("j"), "lag")


def hankelize(matrix: DataFrame) -> DataFrame:
    """(series_id, t, value): diagonal averages of a matrix (series_id, i, j, x)."""
    return matrix.groupBy("series_id", (F.col("i") + F.col("j") - 1).alias("t")).agg(F.avg("x").alias("value"))


def rank_one(u: DataFrame, v: DataFrame) -> DataFrame:
    """Diagonal averages of u v': u (series_id, i, x), v (series_id, j, x)."""
    both = u.withColumnRenamed("x", "a").join(v.withColumnRenamed("x", "b"), "series_id")
    return hankelize(both.select("series_id", "i", "j", (F.col("a") * F.col("b")).alias("x")))


def hankel_product(series: DataFrame, window: int, v: DataFrame) -> DataFrame:
    """(series_id, i, value): the trajectory matrix times v (series_id, j, x)."""
    return embed(series, window).join(v.withColumnRenamed("x", "y"), ["series_id", "j"]).groupBy("series_id", "i").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def lag_products(series: DataFrame, window: int, circular: bool = False) -> DataFrame:
    """(series_id, k, value): mean product of values k apart, k = 0 to window - 1; the mean stays."""
    a = series.join(lengths(series), "series_id").select("series_id", "n", F.col("value").alias("a"), "t", F.explode(offsets(window)).alias("k"))
    to = F.col("t") + F.col("k")
    a = a.withColumn("t", F.pmod(to - 1, F.col("n")) + 1 if circular else to)
    sums = a.join(series.withColumnRenamed("value", "b"), ["series_id", "t"]).groupBy("series_id", "k", "n").agg(F.sum(F.col("a") * F.col("b")).alias("s"))
    return sums.select("series_id", "k", (F.col("s") / (F.col("n") if circular else F.col("n") - F.col("k"))).alias("value"))


def toeplitz_product(series: DataFrame, window: int, v: DataFrame) -> DataFrame:
    """(series_id, i, value): the matrix of lag products times v (series_id, j, x)."""
    c = lag_products(series, window)
    cells = v.select("series_id", "j", "x", F.explode(offsets(window)).alias("o")).select("series_id", "x", (F.col("o") + 1).alias("i"), F.abs(F.col("o") + 1 - F.col("j")).alias("k"))
    return cells.join(c, ["series_id", "k"]).groupBy("series_id", "i").agg(F.sum(F.col("x") * F.col("value")).alias("value"))


def hankel_weights(series: DataFrame, window: int) -> DataFrame:
    """(series_id, t, w): how many cells of the trajectory matrix stand for each value."""
    n, t = F.col("n"), F.col("t")
    return series.select("series_id", "t").join(lengths(series), "series_id").select("series_id", "t", F.least(t, F.lit(window).cast("long"), n - window + 1, n - t + 1).cast("long").alias("w"))


def complete_windows(series: DataFrame, window: int) -> DataFrame:
    """(series_id, j): begins of windows without a null. Absent rows count as nulls."""
    cells = series.where("value is not null").select("series_id", "t", F.explode(offsets(window)).alias("o")).select("series_id", (F.col("t") - F.col("o")).alias("j"))
    return cells.groupBy("series_id", "j").agg(F.count("*").alias("n")).where(F.col("n") == window).select("series_id", "j")


def field_weights(series: DataFrame, window: int) -> DataFrame:
    """(series_id, t, w): how many complete windows cover each cell; 0 for those that none does."""
    cover = complete_windows(series, window).select("series_id", "j", F.explode(offsets(window)).alias("o"))
    cover = cover.select("series_id", (F.col("j") + F.col("o")).alias("t")).groupBy("series_id", "t").agg(F.count("*").alias("w"))
    return series.select("series_id", "t").join(cover, ["series_id", "t"], "left").select("series_id", "t", F.coalesce("w", F.lit(0)).cast("long").alias("w"))


def weighted_norm(series: DataFrame, window: int) -> DataFrame:
    """(series_id, wnorm): norm of the trajectory matrix, from values and weights."""
    both = series.join(hankel_weights(series, window), ["series_id", "t"])
    return both.groupBy("series_id").agg(F.sqrt(F.sum(F.col("w") * F.col("value") * F.col("value"))).alias("wnorm"))


def weighted_correlations(series: DataFrame, window: int) -> DataFrame:
    """(g1, g2, wcor): weighted correlations between series that share their t."""
    both = series.join(hankel_weights(series, window), ["series_id", "t"]).select(F.col("series_id").alias("g"), "t", "value", "w")
    a, b = both.alias("a"), both.select("g", "t", "value").alias("b")
    dots = a.join(b, "t").groupBy(F.col("a.g").alias("g1"), F.col("b.g").alias("g2")).agg(F.sum(F.col("w") * F.col("a.value") * F.col("b.value")).alias("s"))
    norms = dots.where("g1 = g2").select("g1", F.col("s").alias("d"))
    dots = dots.join(norms, "g1").join(norms.select(F.col("g1").alias("g2"), F.col("d").alias("e")), "g2")
    out = F.when(F.col("g1") == F.col("g2"), 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s") / F.sqrt(F.col("d") * F.col("e")))))
    return dots.select("g1", "g2", out.alias("wcor"))


def gaps(series: DataFrame, windows: list[int]) -> DataFrame:
    """(series_id, L, gap_left, gap_right, pos, kind) for each window length.

    Missing cells at most L apart are one gap. series has a row for each t, null where missing.
    """
    n = lengths(series)
    missing = series.where("value is null").select("series_id", "t", F.explode(F.array(*[F.lit(int(w)).cast("long") for w in windows])).alias("L"))
    w = Window.partitionBy("series_id", "L").orderBy("t")
    first = F.coalesce((F.col("t") - F.lag("t").over(w) > F.col("L")).cast("int"), F.lit(1))
    missing = missing.withColumn("first", first).withColumn("c", F.sum("first").over(w))
    out = missing.groupBy("series_id", "L", "c").agg(F.min("t").alias("gap_left"), F.max("t").alias("gap_right"), F.count("*").alias("m")).join(n, "series_id")
    pos = F.when(F.col("gap_left") < F.col("L"), "left").when(F.col("gap_right") >= F.col("n") - F.col("L") + 1, "right").otherwise("internal")
    kind = F.when(F.col("m") == F.col("gap_right") - F.col("gap_left") + 1, "dense").otherwise("sparse")
    return out.select("series_id", "L", "gap_left", "gap_right", pos.alias("pos"), kind.alias("kind"))


def complete_share(series: DataFrame, windows: list[int]) -> DataFrame:
    """(series_id, L, percent): share of complete lag vectors for each window length.

    A known run of length m between missing cells has m - L + 1 complete windows, so no window is
    built."""
    w = Window.partitionBy("series_id").orderBy("t")
    runs = series.withColumn("run", F.sum(F.col("value").isNull().cast("int")).over(w)).where("value is not null")
    runs = runs.groupBy("series_id", "run").agg(F.count("*").alias("m"))
    each = runs.select("series_id", "m", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in windows])).alias("L"))
    each = each.groupBy("series_id", "L").agg(F.sum(F.greatest(F.lit(0), F.col("m") - F.col("L") + 1)).alias("c"))
    return each.join(lengths(series), "series_id").select("series_id", "L", (100.0 * F.col("c") / (F.col("n") - F.col("L") + 1)).alias("percent"))


def periodogram(series: DataFrame, bins: int | None = None) -> DataFrame:
    """(series_id, k, frequency, power): one-sided spectrum, inner frequencies doubled.

    Each value meets each frequency by an explode; N values make N (N / 2 + 1) terms, summed before
    the shuffle. Long series belong to the kernel's FFT instead."""
    rows = series.join(lengths(series), "series_id").select("series_id", "n", "t", "value", F.explode(offsets(F.floor(F.col("n") / 2) + 1)).alias("k"))
    angle = F.lit(2) * F.pi() * F.pmod(F.col("k") * (F.col("t") - 1), F.col("n")) / F.col("n")
    sums = rows.groupBy("series_id", "n", "k").agg(F.sum(F.col("value") * F.cos(angle)).alias("c"), F.sum(F.col("value") * F.sin(angle)).alias("s"))
    twice = F.when((F.col("k") > 0) & (2 * F.col("k") < F.col("n")), 2.0).otherwise(1.0)
    return sums.select("series_id", "k", (F.col("k") / F.col("n")).alias("frequency"), ((F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n") * twice).alias("power"))


def frequency_shares(series: DataFrame, bounds: list[float]) -> DataFrame:
    """(series_id, bin, share): energy between bounds (upper ones; the first bin reaches down), bins from 1."""
    p = periodogram(series)
    which = F.lit(None).cast("int")
    for i, b in reversed(list(enumerate(bounds, 1))):
        which = F.when(F.col("frequency") < b, i).otherwise(which)
    total = p.groupBy("series_id").agg(F.sum("power").alias("all"))
    part = p.withColumn("bin", which).where("bin is not null").groupBy("series_id", "bin").agg(F.sum("power").alias("part"))
    return part.join(total, "series_id").select("series_id", "bin", (F.col("part") / F.col("all")).alias("share"))


def continued(series: DataFrame, coefficients: list[float], length: int) -> DataFrame:
    """(series_id, t, value): new values by a linear recurrence (coefficients in time order)."""
    n = len(coefficients)
    c = F.array(*[F.lit(float(x)) for x in coefficients])
    last = series.join(lengths(series).withColumnRenamed("n", "end"), "series_id").where(F.col("t") > F.col("end") - n)
    tail = last.groupBy("series_id", "end").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda x: x["value"]).alias("tail"))
    step = lambda acc, _: F.concat(acc, F.array(F.aggregate(F.zip_with(F.slice(acc, -n, n), c, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))
    all_ = F.aggregate(F.sequence(F.lit(1), F.lit(length)), F.col("tail"), step)
    rows = tail.select("series_id", "end", F.posexplode(F.slice(all_, n + 1, length)).alias("p", "value"))  # p from 0
    return rows.select("series_id", (F.col("end") + F.col("p") + 1).alias("t"), "value")


def field_cover(field: DataFrame, rows: int, columns: int) -> DataFrame:
    """(field_id, i, j, w): how many rows x columns windows cover each cell of a full field."""
    size = field.groupBy("field_id").agg(F.max("i").alias("n"), F.max("j").alias("m"))
    one = lambda t, n, w: F.least(F.col(t), F.lit(w).cast("long"), F.col(n) - w + 1, F.col(n) - F.col(t) + 1)
    return field.select("field_id", "i", "j").join(size, "field_id").select("field_id", "i", "j", (one("i", "n", rows) * one("j", "m", columns)).cast("long").alias("w"))


def covariance(series: DataFrame, window: int) -> DataFrame:
    """(series_id, i, j, value): X X' of one series however long, as a distributed sum.

    Only i <= j is summed; the products of a window's cells meet by explode and equal t."""
    a = series.select("series_id", "t", F.col("value").alias("a"), F.explode(offsets(window)).alias("k"))
    pairs = a.withColumn("t2", F.col("t") + F.col("k")).join(series.select("series_id", F.col("t").alias("t2"), F.col("value").alias("b")), ["series_id", "t2"])
    pairs = pairs.join(lengths(series), "series_id")
    # The product of t and t + k is in cell (i, i + k) for each place i of t in a whole window.
    low = F.greatest(F.lit(1).cast("long"), F.col("t") - (F.col("n") - window))
    high = F.least(F.lit(window).cast("long") - F.col("k"), F.col("t"))
    cells = pairs.where(low <= high).select("series_id", F.explode(F.sequence(low, high)).alias("i"), "k", (F.col("a") * F.col("b")).alias("p"))
    upper = cells.groupBy("series_id", "i", "k").agg(F.sum("p").alias("value")).select("series_id", "i", (F.col("i") + F.col("k")).alias("j"), "value")
    return upper.union(upper.where("i < j").select("series_id", F.col("j").alias("i"), F.col("i").alias("j"), "value"))


ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)}


def arithmetic(left: DataFrame, right: DataFrame, sign: str) -> DataFrame:
    """(series_id, t, value): the values of two tables of (ragged) series, cell by cell.

    A cell that one table lacks, a null value or a division by zero gives null. Rows are joined on
    series_id and t; other columns are dropped.
    """
    if sign not in ARITHMETIC:
        raise ValueError(f"{sign!r} is not one of {' '.join(ARITHMETIC)}")
    a, b = (x.select("series_id", "t", F.col("value").alias(c)) for x, c in ((left, "a"), (right, "b")))
    return a.join(b, ["series_id", "t"], "full").select("series_id", "t", ARITHMETIC[sign](F.col("a"), F.col("b")).alias("value"))
