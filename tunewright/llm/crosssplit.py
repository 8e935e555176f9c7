"""Evaluation songs that stand, exactly or almost, in the training split.

Word n-grams of the evaluation melodies (five events to a word n-gram) are hashed and partitioned; the training
melodies are scanned for hits, the containment of the evaluation melody in the training melody bounds the candidates,
and an edit distance decides.

The scan is lossless. A pair of which the longer melody has L events is close within k = L div 10 edits, and L is at
most 10/9 of either length, so a training melody of n events cut into n div 9 + 1 disjoint pieces has one piece that no
edit touches. Each piece has five events or more (n >= 10), so its first n-gram stands verbatim in the evaluation
melody, at most k places away. Only those few n-grams of a training melody are shuffled, not all.

Copies are collapsed to one row per distinct melody first, so a melody that a third of all songs repeat is one row in
every join; records come back only when the pairs that were asked for are written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.llm.melodies import allowed, close_bpm, close_events, members
from tunewright.shared import materialize

NGRAM = 5
#: Shortest melody whose pieces all hold NGRAM events; below, pieces are hashed with SHORT events, or whole if no edit is allowed.
LONG, SHORT = 10, 4
PIECE = 9


def _gram(chars: Column, start: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), F.slice(chars, start + 1, F.lit(n)))


def _spots(n: int, starts: Column) -> Column:
    chars = F.split("mel", "")
    return F.transform(starts, lambda i: F.struct(_gram(chars, i, n).alias("gram"), i.cast("int").alias("at")))


def _whole() -> Column:
    return F.array(F.struct(F.xxhash64(F.lit(0), F.col("mel")).alias("gram"), F.lit(0).alias("at")))


def _none() -> Column:
    return F.array().cast("array<struct<gram:bigint,at:int>>")


def windows(classes: DataFrame) -> DataFrame:
    """Every n-gram of a melody with its place."""
    n = F.col("n")
    some = lambda size: _spots(size, F.sequence(F.lit(0), n - size))
    long = F.when(n >= LONG - 1, some(NGRAM)).otherwise(_none())
    short = F.when(n.between(PIECE, LONG + 1), some(SHORT)).when(n < PIECE, _whole()).otherwise(_none())
    return classes.select("cid", "n", F.explode(F.concat(long, short)).alias("s")).select("cid", "n", "s.gram", "s.at")


def pieces(classes: DataFrame) -> DataFrame:
    """The first n-gram of each of the disjoint pieces of which at least one survives all edits."""
    n = F.col("n")
    cuts = F.floor(n / PIECE).cast("int") + 1
    starts = F.transform(F.sequence(F.lit(0), cuts - 1), lambda j: F.floor(j * n / cuts).cast("int"))
    spots = F.when(n >= LONG, _spots(NGRAM, starts)).when(n == PIECE, _spots(SHORT, starts)).otherwise(_whole())
    return classes.select("cid", "n", F.explode(spots).alias("s")).select("cid", "n", "s.gram", "s.at")


def _grams(mel: str, n: str) -> str:
    """Distinct n-grams of a melody as an array of substrings; empty if it is too short."""
    return f"CASE WHEN {n} >= {NGRAM} THEN array_distinct(transform(sequence(0, {n} - {NGRAM}), i -> xxhash64(slice(split({mel}, ''), i + 1, {NGRAM})))) ELSE cast(array() AS array<bigint>) END"


def close_classes(classes: DataFrame, evaluation: Column, training: Column) -> DataFrame:
    """cid_e, cid_t, containment of all pairs of different melodies, one an evaluation and one a training melody, with close events."""
    ev, tr = classes.where(evaluation), classes.where(training)
    e, t = windows(ev).alias("e"), pieces(tr).alias("t")
    shift = allowed(F.greatest("e.n", "t.n"))
    hit = (F.col("e.gram") == F.col("t.gram")) & (F.abs(F.col("e.n") - F.col("t.n")) <= shift) & (F.abs(F.col("e.at") - F.col("t.at")) <= shift)
    pairs = e.join(t, hit & (F.col("e.cid") != F.col("t.cid"))).select(F.col("e.cid").alias("cid_e"), F.col("t.cid").alias("cid_t")).distinct()
    side = lambda df, x: df.select(F.col("cid").alias(f"cid_{x}"), F.col("mel").alias(f"mel_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.join(side(ev, "e"), "cid_e").join(side(tr, "t"), "cid_t")
    both = both.withColumn("grams_e", F.expr(_grams("mel_e", "n_e"))).withColumn("common", F.size(F.array_intersect("grams_e", F.expr(_grams("mel_t", "n_t")))))
    # an edit changes at most NGRAM n-grams, so fewer common ones than this rule closeness out
    both = both.where(F.col("common") >= F.size("grams_e") - NGRAM * allowed(F.greatest("n_e", "n_t")))
    both = both.withColumn("containment", F.when(F.size("grams_e") > 0, F.col("common") / F.size("grams_e")))
    return both.where(close_events("mel_e", "mel_t", "n_e", "n_t")).select("cid_e", "cid_t", "containment")


def _prepared(songs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their class, and pairs of classes (a class with itself included) that hold songs of both sides."""
    usable = songs.where(F.col("split").isin("train", "val", "test") & F.col("bpm").isNotNull())
    rows = materialize(members(usable, "bpm", "split", "source"), "p2_rows")
    grouped = rows.groupBy("mel").agg(F.min("rec_no").alias("cid"), F.max(F.col("split") == "train").alias("t"), F.max(F.col("split") != "train").alias("e"))
    classes = materialize(grouped.withColumn("n", F.length("mel")), "p2_classes")
    near = close_classes(classes, F.col("e"), F.col("t"))
    same = classes.where("e AND t").select(F.col("cid").alias("cid_e"), F.col("cid").alias("cid_t"), F.lit(1.0).alias("containment"))
    # only songs of a class that is in some pair go on
    pairs = materialize(near.unionByName(same), "p2_pairs")
    used = pairs.select(F.explode(F.array("cid_e", "cid_t")).alias("cid")).distinct()
    kept = materialize(classes.join(used, "cid", "left_semi").select("mel", "cid"), "p2_kept")
    return rows.join(kept, "mel").select("rec_no", "bpm", "split", "source", "cid"), pairs


def overlaps(songs: DataFrame) -> DataFrame:
    """rec_a < rec_b of every pair of songs, one in train, the other in val or test, with close events and close bpm.

    Songs with null or another split or without bpm take no part, nor do those that with_codes() leaves out. Repeated rows give repeated
    pairs. The result holds every pair of copies, as TESTDATA.md demands.
    """
    rows, pairs = _prepared(songs)
    e = rows.where("split != 'train'").select("cid", F.col("rec_no").alias("rec_e"), F.col("bpm").alias("bpm_e"))
    t = rows.where("split = 'train'").select("cid", F.col("rec_no").alias("rec_t"), F.col("bpm").alias("bpm_t"))
    found = pairs.join(e.withColumnRenamed("cid", "cid_e"), "cid_e").join(t.withColumnRenamed("cid", "cid_t"), "cid_t").where(close_bpm(F.col("bpm_e"), F.col("bpm_t")))
    found = found.select(F.least("rec_e", "rec_t").alias("rec_a"), F.greatest("rec_e", "rec_t").alias("rec_b"))
    return found.where("rec_a < rec_b")  # a number given twice, on both sides, is no pair


def links(songs: DataFrame) -> DataFrame:
    """rec_e, rec_t, containment: every pair of melodies with close events, one of an evaluation and one of a training song, each
    stood for by its smallest rec_no, and the share of the evaluation melody's n-grams that the training melody holds (null if
    it is too short for one). Copies aren't expanded; memberships() tells whose melody it is."""
    _, pairs = _prepared(songs)
    return pairs.select(F.col("cid_e").alias("rec_e"), F.col("cid_t").alias("rec_t"), "containment")


def memberships(songs: DataFrame) -> DataFrame:
    """rec_no, same_as (smallest rec_no with its melody), split, bpm of every song whose melody is in some pair of links()."""
    rows, _ = _prepared(songs)
    return rows.select("rec_no", F.col("cid").alias("same_as"), "split", "bpm")


def overlap_counts(songs: DataFrame) -> DataFrame:
    """Per evaluation split and source: songs, songs with an exact and with any overlap in training, and pairs.

    Copies are counted by (class, bpm), never expanded: a pair count is the product of two counts.
    """
    rows, pairs = _prepared(songs)
    e = rows.where("split != 'train'").groupBy(F.col("cid").alias("cid_e"), F.col("bpm").alias("bpm_e"), "split", "source").agg(F.count(F.lit(1)).alias("songs_e"))
    t = rows.where("split = 'train'").groupBy(F.col("cid").alias("cid_t"), F.col("bpm").alias("bpm_t")).agg(F.count(F.lit(1)).alias("songs_t"))
    linked = pairs.join(e, "cid_e").join(t, "cid_t").where(close_bpm(F.col("bpm_e"), F.col("bpm_t")))
    each = linked.groupBy("cid_e", "bpm_e", "split", "source").agg(
        F.max(F.when(F.col("cid_e") == F.col("cid_t"), F.col("songs_e")).otherwise(0)).alias("exact"), F.max("songs_e").alias("near"), F.sum(F.col("songs_e") * F.col("songs_t")).alias("pairs"), F.max("containment").alias("containment")
    )
    hits = each.groupBy("split", "source").agg(F.sum("exact").alias("exact_songs"), F.sum("near").alias("overlapping_songs"), F.sum("pairs").alias("pairs"), F.max("containment").alias("containment"))
    total = songs.where(F.col("split").isin("val", "test")).groupBy("split", "source").agg(F.count(F.lit(1)).alias("songs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return total.alias("a").join(hits.alias("b"), (F.col("a.split") == F.col("b.split")) & F.col("a.source").eqNullSafe(F.col("b.source")), "left").select("a.split", "a.source", "songs", zero("exact_songs"), zero("overlapping_songs"), zero("pairs"), F.col("containment").alias("greatest_containment"))
