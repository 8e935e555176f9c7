"""Queries that do the whole job, where an earlier form left part of it out."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import SONG, melody, table

from tunewright.operators import dedup, generation
from tunewright.operators import tokens as tk
from tunewright.plans import duplicates, library, model, timelines


def test_grid_reaches_the_end_of_a_song(spark):
    song = table(spark, [[(60, 4, False)] * 40 + [(62, 4, False)]])  # 41 x 32 ticks
    got = {(r.step, r.midi): r.strength for r in timelines._whole_grid(song).collect()}
    assert {s for s, _ in got} == set(range(55))
    assert got[39, 60] == 1.0 and got[54, 62] == 16 / 24


def test_repair_scores_with_every_count(spark):
    song = table(spark, [[(60, 4, False), (62, 4, False), (64, 8, False), (65, 8, False)]], ["val"])
    own = tk.ngram_counts(tk.sequences(song), 4)
    # 600,000 counts of other and more frequent contexts
    other = spark.range(600_000).select(F.array(F.lit(5), F.lit(6) + F.col("id").cast("int") % 800, F.lit(3) + (F.col("id") / 800).cast("int")).alias("context"), F.lit(tk.REST).alias("target"), F.lit(9).cast("bigint").alias("n"))
    got = generation.repaired(song, own.unionByName(other), 4, 4, 8).where("choice = 0").first()
    model = generation.Model([(tuple(r.context), r.target, r.n) for r in own.collect()], 4)
    want = sum(model.log_probabilities(got.ids[:i])[got.ids[i]] for i in range(1, len(got.ids)))
    assert got.score == pytest.approx(want)


def test_nearest_finds_numbers_divisible_by_20(spark, tmp_path):
    one, two = [(60, 4, False), (64, 8, False), (67, 4, False), (72, 2, False)], [(60, 8, False), (61, 8, True), (60, 2, False), (59, 4, False)]
    rows = [(20, "a", 100, "train", one), (40, "b", 100, "train", one), (60, "c", 100, "train", two), (61, "d", 100, "train", two[:3])]
    spark.createDataFrame(rows, SONG).write.parquet(f"{tmp_path}/songs.parquet")
    got = {r.rec_no: r for r in duplicates._nearest_training(spark, str(tmp_path)).collect()}
    assert (got[20].closest_no, got[40].closest_no, got[60].closest_no) == (40, 20, 61)
    assert got[20].exact_match and got[40].exact_match and not got[60].exact_match


def test_allowed_next_after_every_prefix(spark):
    got = {r.k: (r.low, r.high, r.eos) for r in model._legal_whole(table(spark, [[(60, 4, False)] * 130])).collect()}
    assert sorted(got) == list(range(264))
    assert got[16] == (879, 927, False) and got[18] == (879, 927, True) and got[258] == (2, 2, True) and got[263] == (None, None, None)


def test_leakage_by_family(spark):
    m = melody(random.Random(3), 60)
    near = [*m[:30], (m[30][0], 32, True), *m[31:]]
    songs = table(spark, [m, near], ["train", "test"])
    assert dedup.leakage(songs).count() == 0
    assert [(r.kind, r.splits, r.songs) for r in duplicates._family_leakage(songs).collect()] == [("family", 2, 2)]


def test_append_has_every_batch(spark):
    songs = spark.createDataFrame([("a", 1, "train", 1), ("b", 2, "train", None), ("c", 3, "train", 6), ("c", 4, "train", 9), ("d", 5, "train", 9), ("d", 6, "train", 9)], "id string, rec_no long, split string, batch_no int")
    assert sorted(r.rec_no for r in library._append_newest(songs).collect()) == [1, 2, 3, 6]
