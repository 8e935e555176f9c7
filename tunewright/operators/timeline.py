"""Operators on time: intervals and grids, spans, runs, gaps, lags, bins and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def interval_grid(notes: DataFrame, step: float, steps: int | None = None) -> DataFrame:
    """key, step, midi, strength of notes(key, start, end, midi, confidence): the share of each grid step that a note
    covers, times its confidence; of several notes of one pitch the strongest.

    A bucketed range join: a note is exploded to the steps that it touches, so no range is compared with another.
    """
    first, last = F.floor(F.col("start") / step), F.ceil(F.col("end") / step) - 1
    if steps is not None:
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(steps - 1))
    rows = notes.where(F.col("end") > F.col("start")).withColumn("first", first).withColumn("last", last).where("last >= first")
    rows = rows.withColumn("step", F.explode(F.sequence("first", "last")))
    covered = (F.least("end", (F.col("step") + 1) * F.lit(step)) - F.greatest("start", F.col("step") * F.lit(step))) / step
    return rows.withColumn("w", F.col("confidence") * covered).where("w > 0").groupBy("key", "step", "midi").agg(F.max("w").alias("strength"))


def span_support(spans: DataFrame, frames: DataFrame, shifts: tuple[int, ...] = (-12, 0, 12), width: int = 16) -> DataFrame:
    """key, span, shift, support: mean strength of the frames of a span at its pitch moved by each shift.

    spans(key, span, first, last, midi), frames(key, frame, midi, strength). Spans are cut into buckets of `width` frames
    and joined on (key, bucket, pitch); a frame matches where it lies in the span.
    """
    moved = spans.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts]))).withColumn("at", F.col("midi") + F.col("shift"))
    cut = moved.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))))
    f = frames.select("key", "frame", F.col("midi").alias("at"), "strength", F.floor(F.col("frame") / width).alias("bucket"))
    hits = cut.join(f, ["key", "bucket", "at"]).where(F.col("frame").between(F.col("first"), F.col("last"))).groupBy("key", "span", "shift").agg(F.sum("strength").alias("sum"))
    return moved.select("key", "span", "shift", (F.col("last") - F.col("first") + 1).alias("frames")).join(hits, ["key", "span", "shift"], "left").select("key", "span", "shift", (F.coalesce("sum", F.lit(0.0)) / F.col("frames")).alias("support"))


def best_shift(support: DataFrame) -> DataFrame:
    """key, span, shift, support: the best supported shift; of equals the smallest in size, then the lower."""
    top = F.max_by(F.struct("shift", "support"), F.struct("support", -F.abs("shift"), -F.col("shift")))
    return support.groupBy("key", "span").agg(top.alias("b")).select("key", "span", "b.*")


def lag_products(series: DataFrame, lags: int) -> DataFrame:
    """key, lag, score of series(key, t, x): sum of x[t] * x[t - lag] over lags 1 .. `lags`, by a join on shifted time."""
    moved = series.withColumn("lag", F.explode(F.sequence(F.lit(1), F.lit(lags)))).select("key", (F.col("t") + F.col("lag")).alias("t"), "lag", F.col("x").alias("before"))
    return series.join(moved, ["key", "t"]).groupBy("key", "lag").agg(F.sum(F.col("x") * F.col("before")).alias("score"))


def best_lag(products: DataFrame) -> DataFrame:
    """key, lag, score: the lag with the highest product, of equals the shortest."""
    return products.groupBy("key").agg(F.max_by(F.struct("lag", "score"), F.struct("score", -F.col("lag"))).alias("b")).select("key", "b.*")


def runs(rows: DataFrame, key: str, order: list[str], same: Column, broken: Column | None = None) -> DataFrame:
    """rows with run: the number of the run of equal `same` (nulls are equal) they belong to; `broken` starts a new run anyway."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_s", same)
    new = (F.row_number().over(w) == 1) | ~F.col("_s").eqNullSafe(F.lag("_s").over(w))
    if broken is not None:
        new = new | F.coalesce(broken, F.lit(False))
    return marked.withColumn("_n", new.cast("int")).withColumn("run", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s", "_n")


def gap_islands(rows: DataFrame, key: str, t: str, gap: float) -> DataFrame:
    """key, island, first, last, n: stretches in which successive times are at most `gap` apart. Null times are left out."""
    w = Window.partitionBy(key).orderBy(t)
    marked = rows.where(F.col(t).isNotNull()).withColumn("_n", F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0)))
    placed = marked.withColumn("island", F.sum("_n").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return placed.groupBy(key, "island").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("n"))


def local_maxima(rows: DataFrame, key: str, t: str, x: str, least: float) -> DataFrame:
    """Rows whose x is at least `least`, above the one before and not below the one after."""
    w = Window.partitionBy(key).orderBy(t)
    return rows.withColumn("_a", F.lag(x).over(w)).withColumn("_b", F.lead(x).over(w)).where((F.col(x) >= least) & (F.coalesce(F.col(x) > F.col("_a"), F.lit(True))) & (F.coalesce(F.col(x) >= F.col("_b"), F.lit(True)))).drop("_a", "_b")


def bins(samples: DataFrame, count: int) -> DataFrame:
    """key, bin, low, high, peak of samples(key, i, x): `count` equal stretches of each key's samples. Sizes by an aggregate first."""
    size = samples.groupBy("key").agg((F.max("i") + 1).alias("size"))
    placed = samples.join(size, "key").withColumn("bin", F.floor(F.col("i") * F.least(F.lit(count), F.col("size")) / F.col("size")))
    return placed.groupBy("key", "bin").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.max(F.abs("x")).alias("peak"))


def silence(samples: DataFrame, block: int, per_step: int, share: float = 0.75, quiet: float = 0.005) -> DataFrame:
    """key, step, silent of samples(key, i, x): root mean square per block; a step of `per_step` blocks is silent if at least
    `share` of its blocks reach no more than `quiet` of the loudest block of the key."""
    rms = samples.groupBy("key", F.floor(F.col("i") / block).alias("block")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    peak = rms.groupBy("key").agg(F.max("rms").alias("peak"))
    return rms.join(peak, "key").groupBy("key", F.floor(F.col("block") / per_step).alias("step")).agg((F.avg((F.col("rms") <= quiet * F.col("peak")).cast("double")) >= share).alias("silent"))


def last_n(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in the given order, with their rank. The rank is limited before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def octave_fit(path: DataFrame, low: int = 60, high: int = 107) -> DataFrame:
    """key, t, midi of path(key, t, midi): moved by the multiple of 12 within four octaves that puts most notes in range (of
    equals the smallest move, then the lower), then folded into it note by note. A null stays null."""
    moves = F.explode(F.array(*[F.lit(12 * k) for k in range(-4, 5)]))
    fits = path.where("midi IS NOT NULL").groupBy("key", "midi").agg(F.count(F.lit(1)).alias("n")).withColumn("move", moves)
    fits = fits.groupBy("key", "move").agg(F.sum(F.when((F.col("midi") + F.col("move")).between(low, high), F.col("n")).otherwise(0)).alias("inside"))
    best = fits.groupBy("key").agg(F.max_by("move", F.struct("inside", -F.abs("move"), -F.col("move"))).alias("move"))
    moved = path.join(best, "key", "left").withColumn("m", F.col("midi") + F.coalesce("move", F.lit(0)))
    up = F.when(F.col("m") < low, F.col("m") + 12 * F.ceil((low - F.col("m")) / 12)).when(F.col("m") > high, F.col("m") - 12 * F.ceil((F.col("m") - high) / 12)).otherwise(F.col("m"))
    return moved.select("key", "t", up.cast("bigint").alias("midi"))
