"""What queries shuffle, hold and build up, on tables small enough for a test."""

import pytest
from pyspark.sql import functions as F

from tunewright.functions.transitions import shingles
from tunewright.operators import dedup, tokens


def songs(spark, n, length=40):
    """n melodies of random events, every tenth nearly the one before."""
    of = F.when(F.col("id") % 10 == 9, F.col("id") - 1).otherwise(F.col("id"))
    draw = lambda i, what, k: F.pmod(F.xxhash64("of", i, F.lit(what)), F.lit(k)).cast("int")
    pitch = F.when((F.col("id") % 10 == 9) & (F.col("i") == length - 2), F.lit(59)).otherwise(F.lit(60) + draw(F.col("i"), "p", 40))
    long = spark.range(n).withColumn("of", of).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    event = F.struct(pitch.alias("pitch"), F.element_at(F.array(F.lit(4), F.lit(8), F.lit(16)), draw(F.col("i"), "d", 3) + 1).alias("duration"), F.lit(False).alias("dotted"))
    made = long.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", event.alias("e")))).alias("x"))
    split = F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("id") % 3 + 1).cast("int"))
    return made.select((F.col("id") + 1).alias("rec_no"), F.lit(120).alias("bpm"), F.transform("x", lambda x: x["e"]).alias("events"), split.alias("split"))


def written(spark):
    """Bytes that all shuffles so far have written."""
    store = spark.sparkContext._jsc.sc().statusStore()
    return store.executorSummary("driver").totalShuffleWrite()


def shuffled(spark, f):
    before = written(spark)
    out = f()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, written(spark) - before


def test_near_candidates_shuffle_less_than_the_shingles(spark, tmp_path):
    songs(spark, 4000).write.parquet(f"{tmp_path}/songs")
    made = spark.read.parquet(f"{tmp_path}/songs")
    reps = dedup.representatives(made)
    got, size = shuffled(spark, lambda: {(min(r.a, r.b), max(r.a, r.b)) for r in dedup.near_candidates(reps).collect()})
    assert got == {(i, i + 1) for i in range(9, 4000, 10)}
    assert size < 4000 * 37 * 8


def test_near_candidates_are_all_pairs(spark):
    """Short melodies over few pitches: shingles that very many share, and every pair counted."""
    few = songs(spark, 300, 14).withColumn("events", F.transform("events", lambda e: F.struct((60 + e["pitch"] % 2).alias("pitch"), F.lit(4).alias("duration"), F.lit(False).alias("dotted"))))
    reps = dedup.representatives(few)
    able = reps.where((F.size("tokens") >= 12) & (F.size(F.array_distinct("tokens")) >= 4)).withColumn("g", shingles(F.col("tokens"), 4)).select("rec_no", "family", "g")
    a, b = able.alias("a"), able.alias("b")
    common = F.size(F.array_intersect("a.g", "b.g"))
    want = a.join(b, F.col("a.family") < F.col("b.family")).where(common / (F.size("a.g") + F.size("b.g") - common) >= 0.45).select("a.rec_no", "b.rec_no", common)
    got = dedup.near_candidates(reps).select("a", "b", "common")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.count() > 1000


WHOLE = {
    "near_dup_verify": lambda songs: dedup.near_verified(dedup.representatives(songs)),
    "families": dedup.families,
    "family_split": lambda songs: dedup.family_split(dedup.families(songs)),
    "leakage_three_keys": lambda songs: dedup.leakage(songs, True),
}


@pytest.mark.parametrize("name", WHOLE)
def test_what_uses_near_candidates_shuffles_no_more_than_twice_the_shingles(spark, tmp_path, name):
    songs(spark, 4000).write.parquet(f"{tmp_path}/songs")
    got, size = shuffled(spark, lambda: WHOLE[name](spark.read.parquet(f"{tmp_path}/songs")).collect())
    assert got and size < 2 * 4000 * 37 * 8


def test_audio_is_handed_on_in_small_batches(monkeypatch):
    """However many songs come at once, a batch ends after WAV_BYTES."""
    import pyarrow as pa

    from tunewright.sources import sinks

    caught = {}

    class Songs:
        schema = {"rec_no": type("field", (), {"dataType": type("kind", (), {"simpleString": staticmethod(lambda: "bigint")})})}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            caught["run"] = run

    sinks.rendered(Songs(), rate=8000)
    note = [{"pitch": 60, "duration": 1, "dotted": False}] * 20
    batch = pa.RecordBatch.from_pylist([{"rec_no": i, "bpm": 60, "events": note if i % 7 else None} for i in range(40)])
    out = list(caught["run"](iter([batch])))
    assert [k for b in out for k in b.column("rec_no").to_pylist()] == list(range(40))
    assert max(sum(len(w or b"") for w in b.column("wav").to_pylist()) for b in out) < (4 << 20) + (2 << 20)
    assert {len(w) for b in out for w in b.column("wav").to_pylist() if w} == {44 + 2 * 8000 * 80}


def test_lines_of_many_songs_are_those_of_one_and_need_no_shuffle(spark, tmp_path):
    import numpy as np

    from tunewright.operators import transcription

    songs(spark, 60, 25).withColumn("events", F.transform("events", lambda e, i: F.struct(F.when(e["pitch"] % 7 > 0, F.lit(60) + e["pitch"] % 13).alias("pitch"), (e["duration"] * F.when(i % 5 == 0, 2).otherwise(1)).alias("duration"), (i % 4 == 0).alias("dotted")))).write.parquet(f"{tmp_path}/songs")
    made = spark.read.parquet(f"{tmp_path}/songs")
    for kind, least in (("lead", 1), ("upper", 2)):
        df = transcription.paths(made, kind=kind, least=least)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        got = {r["clip"]: r["line"] for r in df.collect()}
        for r in made.collect():
            at, notes = 0, []
            for e in r["events"]:
                size = 128 // e["duration"] * (3 if e["dotted"] else 2) // 2
                notes += [(at, at + size, e["pitch"])] if e["pitch"] is not None else []
                at += size
            n = max(-(-b // 8) for _, b, _ in notes)
            strength, attack = np.full((n, 128), np.nan), np.full((n, 128), np.nan)
            for a, b, p in notes:
                attack[a // 8, p] = 0.9
                for t in range(a // 8, -(-b // 8)):
                    strength[t, p] = np.fmax(strength[t, p], 0.9 * ((min(b, (t + 1) * 8) - max(a, t * 8)) / 8))
            line = transcription.best_line(strength, attack) if kind == "lead" else transcription.top_line(strength, attack)
            line = transcription.cleaned(line, attack, least)
            assert got[r["rec_no"]] == [None if p == transcription.SILENT else p for p in line.tolist()]


def test_the_nearest_search_writes_every_song_once(spark, tmp_path, monkeypatch):
    from tunewright.operators import similarity

    songs(spark, 1200).write.parquet(f"{tmp_path}/songs")
    made = spark.read.parquet(f"{tmp_path}/songs").withColumn("name", F.lit("x"))
    few, many = made.where("rec_no % 2 = 0"), made.where("rec_no % 2 = 1")
    whole, once = shuffled(spark, lambda: similarity.nearest(few, many).orderBy("rec_no").collect())
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 50)
    monkeypatch.setattr(similarity, "BLOCK", 50)
    cut, size = shuffled(spark, lambda: similarity.nearest(few, many).orderBy("rec_no").collect())
    assert cut == whole and size < 2 * once


def test_a_token_alone_has_the_same_chance(spark):
    from tunewright.operators import generation
    from tunewright.operators import tokens as tk

    made = songs(spark, 40, 20)
    model = generation.stored_model(tk.ngram_counts(tk.sequences(made), 4), 4).open()
    for r in tk.sequences(made).select("ids").limit(5).collect():
        assert all(model.log_probability(r["ids"], i) == model.log_probabilities(r["ids"][:i])[r["ids"][i]] for i in range(1, len(r["ids"])))


def test_a_decoded_song_is_computed_once(spark):
    made = songs(spark, 3).select("bpm", "events", tokens.decoded(tokens.token_ids(F.col("bpm"), F.col("events"))).alias("back"))
    assert made.select("back")._jdf.queryExecution().optimizedPlan().toString().count("flatten(") == 1
    assert all(r.back.bpm == r.bpm and r.back.events == r.events for r in made.collect())
    assert spark.range(1).select(tokens.decoded(F.lit(None).cast("array<int>")).alias("x")).first().x is None


def test_long_songs_are_taken_fewer_at_a_time(monkeypatch):
    """However long the songs of a batch are, what is held of them at once has a bound, and the lines stay the same."""
    import pyarrow as pa

    from tunewright.operators import transcription

    shapes, made = [], transcription._slots
    monkeypatch.setattr(transcription, "_slots", lambda *x: shapes.append((out := made(*x))[0].shape) or out)
    song = lambda i: [{"pitch": 60 + (i * j) % 17, "duration": 1 if i % 3 else 16, "dotted": j % 4 == 0} for j in range(20 + i)]
    events = pa.array([song(i) for i in range(60)], pa.list_(pa.struct([("pitch", pa.int32()), ("duration", pa.int32()), ("dotted", pa.bool_())])))
    lines = lambda kind: [x.tolist() for x in transcription.played_lines(events, 8, 0.9, kind, 2)]
    want = lines("lead"), lines("upper")
    shapes.clear()
    monkeypatch.setattr(transcription, "CELLS", 1 << 13)
    assert (lines("lead"), lines("upper")) == want
    assert max(n * m for n, m, _ in shapes) <= 1 << 13 and len(shapes) > 10


@pytest.mark.parametrize("size", [64, 1 << 16])
def test_blocks_have_a_bound_and_change_nothing(spark, tmp_path, monkeypatch, size):
    """A table of one row group is read by one task; what that holds of its block has a bound all the same."""
    songs(spark, 1000).coalesce(1).write.parquet(f"{tmp_path}/songs")
    monkeypatch.setattr(dedup, "BLOCK_ROWS", size)
    reps = dedup.representatives(spark.read.parquet(f"{tmp_path}/songs"))
    blocks = {r["block"]: r["count"] for r in reps.groupBy("block").count().collect()}
    assert max(blocks.values()) <= size and sum(blocks.values()) == 1000
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in dedup.near_candidates(reps).collect()} == {(i, i + 1) for i in range(9, 1000, 10)}


def test_three_keys_hold_the_two(spark):
    """Songs without events, or without a split, count under three keys as they do under two."""
    made = songs(spark, 300)
    odd = made.where("rec_no % 10 < 4").withColumn("events", F.when(F.col("rec_no") % 2 == 0, F.filter("events", lambda e: F.lit(False)))).withColumn("rec_no", F.col("rec_no") + 1000)
    copies = made.where("rec_no % 7 = 0").withColumn("rec_no", F.col("rec_no") + 2000).withColumn("split", F.when(F.col("rec_no") % 3 > 0, F.lit("test")))
    every = made.unionByName(odd).unionByName(copies)
    two, three = ({tuple(r) for r in dedup.leakage(every, near).collect()} for near in (False, True))
    assert two and {r for r in three if r[0] != "family"} == two and any(r[0] == "family" for r in three)
