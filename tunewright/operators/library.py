"""A library of songs: append with unique ids, merge of titles, the reference a model was trained on, overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunewright.operators.timeline import last_n


def appended(library: DataFrame, new: DataFrame, key: str, shelf: str, order: list[Column], most: int = 64) -> DataFrame:
    """The library and those new songs whose key it doesn't hold, the last `most` of each shelf. Of new songs with one key the
    first in the given order is kept. Columns must be equal; null keys never match and are kept."""
    fresh = new.join(library.select(key).distinct(), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    named, unnamed = fresh.where(F.col(key).isNotNull()), fresh.where(F.col(key).isNull())
    fresh = named.withColumn("_r", first).where("_r = 1").drop("_r").unionByName(unnamed)
    return last_n(library.unionByName(fresh), shelf, order, most)


def merged_titles(songs: DataFrame, titled: DataFrame, key: str, same: str) -> DataFrame:
    """songs with the title of titled(key, same, title) where key and the music's hash are the same; else their own name."""
    t = titled.where(F.col("title").isNotNull()).groupBy(key, same).agg(F.min("title").alias("title"))
    return songs.join(t, [key, same], "left").withColumn("merged", F.col("title").isNotNull()).withColumn("title", F.coalesce("title", "name"))


def training_reference(songs: DataFrame, trained: DataFrame, key: str, digest: str) -> DataFrame:
    """songs that the model was trained on (key in trained); fails when run if one of them has another content than then."""
    both = songs.join(trained.select(key, F.col(digest).alias("_was")).distinct(), key)
    checked = F.when(F.col(digest) == F.col("_was"), F.col(digest)).otherwise(F.raise_error(F.concat(F.lit("dataset differs at "), F.col(key).cast("string"))))
    return both.withColumn(digest, checked).drop("_was")


def stitched(samples: DataFrame, size: int, overlap: int, of: Column) -> DataFrame:
    """key, i, y of samples(key, i, x): windows of `size` samples that overlap by `overlap`, `of` applied to each window
    (an array of its samples in order), trimmed by half the overlap at inner edges and put together again.

    A window is one bounded group; a sample goes to the one or two windows that hold it.
    """
    hop, half = size - overlap, overlap // 2
    w = F.explode(F.sequence(F.greatest(F.floor((F.col("i") - size) / hop) + 1, F.lit(0)), F.floor(F.col("i") / hop)))
    placed = samples.withColumn("w", w)
    windows = placed.groupBy("key", "w").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    made = windows.withColumn("y", F.transform("s", lambda e: e["x"])).withColumn("y", of)
    flat = made.select("key", "w", F.explode(F.arrays_zip(F.transform("s", lambda e: e["i"]).alias("i"), F.col("y").alias("y"))).alias("p")).select("key", "w", "p.i", "p.y")
    # a sample belongs to the last window in which it isn't within half an overlap of the window's start
    begins = F.when(F.col("w") > 0, F.col("w") * hop + half).otherwise(0)
    return flat.where(F.col("i") >= begins).groupBy("key", "i").agg(F.max_by("y", "w").alias("y"))
