"""The preparation of a corpus, generation's rules and report, stored models, and transcription."""

import io
import itertools
import random
import time
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import SONG, melody, table

from tunewright.functions import music
from tunewright.operators import features, generation, heard, prepare, titles, transcription
from tunewright.operators import tokens as tk
from tunewright.plans import generating
from tunewright.sources import sinks
from tunewright.streaming import incremental

RAW = "rec_no long, source string, kind string, raw string"


def records(spark, melodies, bad=()):
    songs = table(spark, melodies)
    rows = songs.select("rec_no", F.lit("s").alias("source"), F.lit("rtttl").alias("kind"), F.concat("name", F.lit(":"), music.encoded(F.col("bpm"), F.col("events"))).alias("raw"))
    return rows.unionByName(spark.createDataFrame([(1000 + i, "s", "rtttl", r) for i, r in enumerate(bad)], RAW)) if bad else rows


def test_whole_preparation(spark, tmp_path):
    rng = random.Random(2)
    base = [melody(rng, 40) for _ in range(12)]
    near = [*base[0][:20], (61, 32, True), *base[0][21:]]
    path = str(tmp_path / "out")
    got = {r.what: r.value for r in prepare.prepared(records(spark, [*base, base[3], near], ["x", None]), path).collect()}
    assert (got["accepted"], got["retained"], got["rejected"]) == (14, 13, 2)
    assert sum(got.get(f"{s}_songs", 0) for s in ("train", "val", "test")) == 13 and sum(got.get(f"{s}_families", 0) for s in ("train", "val", "test")) == 12
    m = {r.rec_no: r for r in spark.read.json(f"{path}/manifest").collect()}
    assert m[13].retained_no == 4 and m[13].split == m[4].split and m[14].family_id == m[1].family_id and m[14].split == m[1].split
    assert spark.read.json(f"{path}/checksums").count() > 5
    with pytest.raises(Exception, match="exists"):
        prepare.prepared(records(spark, base), path)
    with pytest.raises(ValueError, match="three families"):
        prepare.prepared(records(spark, [base[0], base[1]]), str(tmp_path / "few"))


def test_augmentation_is_for_training(spark):
    songs = table(spark, [[(60, 4, False), (107, 4, False)], [(70, 4, False)], [(None, 4, False)], [(70, 4, False)]], ["train", "train", "train", "val"])
    made = {r.rec_no: r for r in prepare.augmented(songs).collect()}
    assert set(made) == {1, 2, 3} and made[1].shift == 0 and made[3].shift == 0
    assert made[2].events[0].pitch == 70 + made[2].shift and abs(made[2].shift) <= 5
    assert len({r.shift for e in range(8) for r in prepare.augmented(songs.where("rec_no = 2"), epoch=e).collect()}) > 2
    with pytest.raises(ValueError):
        prepare.with_tempo(songs, 10)


def test_prompts(spark):
    songs = table(spark, [[(60, 4, False)], [(60, 4, False)] * 9, [(60, 3, False)], [], [(50, 4, False)]])
    got = {r.rec_no: (r.error, r.ids) for r in prepare.prompts(songs, 8).collect()}
    assert got[1] == (None, [1, 98, 879, 932]) and [got[i][0] for i in (2, 3, 4, 5)] == ["too long", "event outside the model", "no events", "event outside the model"]


def test_model_is_stored(spark, tmp_path):
    counts = tk.ngram_counts(tk.sequences(table(spark, [melody(random.Random(1), 20)])), 4)
    generation.save_model(counts, str(tmp_path / "m"), 4)
    back, order, alpha = generation.load_model(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, counts.collect())) and (order, alpha) == (4, 0.1)
    spark.createDataFrame([(9, 4, 0.1, 940)], "format int, ngram_order int, alpha double, vocabulary int").write.mode("overwrite").parquet(str(tmp_path / "m" / "settings"))
    with pytest.raises(ValueError, match="format 9"):
        generation.load_model(spark, str(tmp_path / "m"))


def test_blocked_rules():
    rng, s = random.Random(4), generation.Sampling()
    for _ in range(400):
        h = [rng.randint(1, 3) for _ in range(rng.randint(0, 40))]
        want = {h[-1]} if len(h) >= 4 and len(set(h[-4:])) == 1 else set()
        for p in range(2, 17):
            tail = h[-3 * p :]
            if len(h) >= 3 * p and len(set(tail[:p])) > 1 and tail == tail[:p] * 3:
                want.add(tail[0])
        assert generation.blocked(h, s)[0] == want
    with pytest.raises(ValueError, match="temperature"):
        generation.Sampling(temperature=0)


def test_report(spark):
    rng = random.Random(7)
    base = [melody(rng, 30) for _ in range(6)]
    made = table(spark, [base[0], [(p and p + 1, d, x) for p, d, x in base[1]], melody(rng, 30), melody(rng, 30)]).select(F.col("rec_no").alias("id"), F.lit(True).alias("valid"), (F.col("rec_no") == 1).alias("forced"), "bpm", "events", *[F.lit(2).alias(c) for c in ("penalty_steps", "run_blocks", "motif_blocks")])
    got = {r.what: r.value for r in generation.full_metrics(made, table(spark, base)).collect()}
    assert got["exact_match_pct"] == 25 and got["transposed_match_pct"] >= 25 and got["valid_pct"] == 100 and got["duplicate_pct"] == 0 and got["forced_pct"] == 25
    assert got["score_max"] == 1 and got["run_blocks_mean"] == 2 and got["unique_pitches_count"] == 4
    none = {r.what: r.value for r in generation.full_metrics(made.where("false"), table(spark, base)).collect()}
    assert none["attempts"] == 0 and none["valid_pct"] is None and none["exact_match_pct"] is None


def test_comparison_of_a_corpus_with_itself(spark):
    songs = table(spark, [melody(random.Random(i), 25) for i in range(4)])
    rows = features.compared(songs, songs).collect()
    assert len(rows) == 16 and all(r.bits == pytest.approx(0) for r in rows if r.kind in features.CATEGORICAL)
    assert features.compared(songs.limit(0), songs.limit(0)).count() == 0


def test_csv_and_settings(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "what string, value int")
    sinks.append_csv(rows, str(tmp_path / "m"))
    sinks.append_csv(rows, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 2
    with pytest.raises(ValueError, match="columns"):
        sinks.append_csv(rows.withColumnRenamed("what", "x"), str(tmp_path / "m"))
    sinks.write_csv(rows, str(tmp_path / "one"))
    (tmp_path / "c.json").write_text('{"order": 3}')
    assert sinks.read_config(spark, str(tmp_path / "c.json")) == {"order": 3}


def test_tone():
    frames = np.frombuffer(wave.open(io.BytesIO(sinks.tone(120, [(69, 4, False), (None, 8, False), (60, 32, True)], 8000))).readframes(10**6), "<i2")
    assert len(frames) == 4000 + 2000 + 750
    want = 0.18 * np.sin(2 * np.pi * 440 * np.arange(1000, 2000) / 8000)
    assert np.abs(frames[1000:2000] / 32767 - want).max() < 1e-3
    assert not frames[3680:6000].any() and frames[0] == 0


def test_titles_from_character(spark):
    songs = table(spark, [[(90, 4, False), (91, 4, False)], [(60, 4, False), (72, 4, False)], [(60, 4, False), (61, 4, False)], [(None, 4, False)]])
    got = {r.rec_no: r.title.split() for r in titles.characteristic(songs).collect()}
    assert all(x[0] in titles.TEMPO_WORDS["middle"] for x in got.values())
    assert [got[i][-1] in titles.THING_WORDS[k] for i, k in ((1, "high"), (2, "wide"), (3, "near"), (4, "near"))] == [True] * 4


def test_a_record_that_does_not_parse_keeps_its_name():
    rows = [{"rtttl": "a-b:d=4,o=5,b=90:c", "name": "12", "valid": True}, {"rtttl": "x:d=4:zz", "name": "x", "valid": True}]

    def fails(r, used, seed):
        raise RuntimeError("no model")

    out, report = titles.name_batch(rows, fails)
    assert report == {"attempted": 2, "named": 0, "failed": 2, "disambiguated": 0, "skipped": 0}
    assert out[0]["rtttl"] == "a-b:d=4,o=5,b=90:c" and out[1]["rtttl"] == "x:d=4:zz" and out[1]["errors"]


def played(notes, seconds):
    return transcription.dense([dict(start=a, end=b, midi=m, strength=0.8, onset=0.8) for a, b, m in notes], seconds)


def pitches(events):
    return [(e["pitch"], e["duration"], e["dotted"]) for e in events]


def test_short_notes_survive():
    note, onset = played([(0, 2 / 3, 60), (2 / 3, 5 / 6, 62), (5 / 6, 1.5, 60)], 1.5)
    assert [p for _, _, p, _ in transcription.note_events(note, onset, 1.5)] == [60, 62, 60]
    first = transcription.candidates(note, onset, 1.5, 90)[0]
    assert pitches(first["events"]) == [(60, 4, False), (62, 16, False), (60, 4, False)]
    assert [a[0]["midi"] for a in first["alternatives"]][0] == 60


def test_a_note_struck_again_is_two():
    note, onset = played([(0, 0.5, 60), (0.5, 1.0, 60), (1.0, 1.5, 67)], 1.5)
    note[int(0.49 * 22050 / 256), 60] = 0.3
    found = transcription.note_events(note, onset, 1.5)
    assert [p for _, _, p, _ in found].count(60) == 2
    path = np.array([60] * 8 + [67] * 4)
    attack = np.full((12, 128), np.nan)
    attack[[0, 4, 8], [60, 60, 67]] = 0.8
    assert pitches(transcription.notes_of(path, attack, 16)) == [(60, 4, False), (60, 4, False), (67, 4, False)]
    assert pitches(transcription.notes_of(path, None, 16)) == [(60, 2, False), (67, 4, False)]


def test_silence_makes_rests():
    silent = np.ones(16, bool)
    silent[2:8] = silent[10:14] = False
    first = transcription.candidates(*played([(0, 2, 60)], 2), 2, 120, silent=silent)[0]
    assert pitches(first["events"]) == [(None, 8, False), (60, 4, True), (None, 8, False), (60, 4, False), (None, 8, False)]


def test_grid_keeps_short_notes_and_silence():
    strength, attack, _ = transcription.grid_of([(0.35, 0.99, 60, 0.8), (1.02, 1.16, 62, 0.8)], 1.5, 90, 16)
    assert len(strength) == 9 and np.isnan(strength[[0, 1, 7]]).all()
    assert attack[6, 62] == 0.8 and not np.isnan(strength[6, 62])


def test_lines():
    slots = [{60: s, 79: 0.9 if i == 1 else 0.1} for i, s in enumerate((0.8, 0.7, 0.8))]
    assert transcription.lead_path(slots, [{}] * 3, voice=0) == [60, 60, 60]
    # the line stays on 72, but 74 is struck as hard as anything and lies near
    assert transcription.upper_path([{72: 1.0}, {72: 1.0, 74: 0.3}], [{72: 0.8}, {74: 0.8}]) == [72, 74]
    none = np.full((5, 128), np.nan)
    assert transcription.cleaned(np.array([60, 62, 60, 64, 64]), none, 1).tolist() == [60, 60, 60, 64, 64]
    assert transcription.cleaned(np.array([60, 60, 62, 64, 64]), none, 2).tolist() == [60, 60, 60, 64, 64]
    assert transcription.folded(np.array([40, 128, 42])).tolist() == [64, 128, 66]
    assert transcription.folded(np.array([60, 107]), compact=True).tolist() == [60, 71]
    assert transcription.frame_seconds(0) == 0 and transcription.frame_seconds(172) == pytest.approx(172 * 256 / 22050 - 256 / 22050 * (172 - 43844 / 256) - 0.0018)


def test_tempo_of_a_pulse():
    _, onset = played([(i * 0.5, i * 0.5 + 0.1, 60) for i in range(20)], 10)
    assert transcription.tempo(onset, 10) == pytest.approx(120, abs=3)
    assert transcription.tempo(np.zeros((100, 128)), 1.0) == 120


def test_agreement():
    a = [{"pitch": 60, "duration": 4, "dotted": False}, {"pitch": None, "duration": 4, "dotted": False}, {"pitch": 64, "duration": 8, "dotted": False}]
    up = [e | {"pitch": e["pitch"] and e["pitch"] + 12} for e in a]
    assert transcription.agreement(a, a) == (1, 1, 1, pytest.approx(1))
    assert transcription.agreement(up, a) == (1, 1, 1, pytest.approx(1))
    other = [{"pitch": 61, "duration": 2, "dotted": True}]
    assert transcription.agreement(other, a)[0] < 0.5 and transcription.agreement([], []) == (0, 0, 1, pytest.approx(0.3))


def test_recency_over_batches(spark, tmp_path):
    schema = "user_id long, event_id long, ts timestamp, event_type string"
    for i, kinds in enumerate((["a", "a"], ["a", "b", "b"])):
        rows = [(1, 10 * i + j, None, k) for j, k in enumerate(kinds)]
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("event_id"))).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    got = [(r.event_type, r.run) for r in incremental.run_once(incremental.recency(stream)).collect()]
    assert sorted(got) == [("a", 2), ("b", 2)]


def seconds_of(f, times=5):
    """CPU seconds of the quickest of some calls."""
    took = []
    for _ in range(times):
        began = time.process_time()
        f()
        took.append(time.process_time() - began)
    return min(took)


def test_a_path_costs_what_is_there_and_not_all_pitches():
    strength, attack = np.full((400, 128), np.nan), np.full((400, 128), np.nan)
    strength[np.arange(400), 60 + np.arange(400) // 8 % 7] = 0.8
    attack[np.arange(0, 400, 8), 60 + np.arange(50) % 7] = 0.8
    moves = np.zeros((129, 129))
    assert transcription.best_line(strength, attack).tolist() == (60 + np.arange(400) // 8 % 7).tolist()
    assert seconds_of(lambda: transcription.best_line(strength, attack)) < seconds_of(lambda: [(moves + i).argmax(axis=0) for i in range(400)])


def test_best_line_of_many_and_of_few_pitches_is_the_best():
    r = np.random.default_rng(3)
    for few in (2, 6):  # up to 16 moves a step are made one by one
        strength, attack = np.full((4, 128), np.nan), np.full((4, 128), np.nan)
        strength[:, 60 : 60 + few] = r.random((4, few))
        attack[2, 60 : 60 + few] = r.random(few)
        strength[1] = np.nan

        def score(path):
            total, before = 0.0, transcription.SILENT
            for t, p in enumerate(path):
                struck, heard = not np.isnan(attack[t]).all(), p != transcription.SILENT
                if heard and before != transcription.SILENT:
                    total += (0.15 if struck else 0.42) if p == before else -0.14 - 0.055 * abs(p - before) + 0.24 * struck
                else:
                    total += -0.2 if heard or before != transcription.SILENT else 0.15
                total += 2.5 * strength[t, p] + 0.1 * (p - 60) + (0.7 * (0.5 + attack[t, p]) if struck else 0) if heard else 0
                before = p
            return total

        every = [range(60, 60 + few)] * 4
        every[1] = [transcription.SILENT]
        assert tuple(transcription.best_line(strength, attack)) == max(itertools.product(*every), key=score)


def test_a_note_is_sought_where_there_is_evidence_only():
    notes = [(i * 0.5, i * 0.5 + 0.4, 60 + i % 3) for i in range(50)]
    note, onset = played(notes, 29)
    assert [p for _, _, p, _ in transcription.note_events(note, onset, 29)] == [m for _, _, m in notes]
    assert seconds_of(lambda: transcription.note_events(note, onset, 29)) < seconds_of(lambda: [np.where(note < 0.5, i, note).max(axis=0) for i in range(8)])


SONGS = pa.schema([("rec_no", pa.int64()), ("bpm", pa.int32()), ("events", pa.list_(pa.struct([("pitch", pa.int32()), ("duration", pa.int32()), ("dotted", pa.bool_())])))])


def measured(songs):
    batch = pa.RecordBatch.from_pylist(songs, SONGS)
    return [tuple(r.values()) for r in heard.measured(*batch.columns).to_pylist()]


def one_by_one(songs):
    out = []
    for s in songs:
        length = [4 / e["duration"] * (1.5 if e["dotted"] else 1) * 60 / s["bpm"] for e in s["events"] or []]
        stop = list(itertools.accumulate(length))
        if not stop or stop[-1] > 30:
            continue
        play = [dict(start=b - x, end=b, midi=e["pitch"], strength=0.8, onset=0.8) for e, x, b in zip(s["events"], length, stop) if e["pitch"] is not None]
        made = transcription.candidates(*transcription.dense(play, stop[-1]), stop[-1], s["bpm"]) if play else []
        out.append((s["rec_no"], *transcription.agreement(made[0]["events"] if made else [], s["events"])))
    return out


def song(r, rec_no, bpm, pitches, durations, n=30):
    return {"rec_no": rec_no, "bpm": bpm, "events": [{"pitch": r.choice(pitches), "duration": r.choice(durations), "dotted": r.random() < 0.2} for _ in range(n)]}


def test_many_clips_at_once_are_heard_as_one_by_one(monkeypatch):
    r, songs = random.Random(7), []
    for i in range(240):  # trills, repeats and leaps, from a frame a note to seconds
        pitches = ([60, 61, 62], [60], [60, 60, 61, None], [60, 72, 84, 107], [*range(60, 108), None], [59, 60, 61])[i % 6]
        songs.append(song(r, i, r.choice((60, 120, 143, 200, 450, 900)), pitches, r.choice(((16, 32), (8, 16), (4, 8, 16, 32), (32,), (1, 2, 4)))))
    songs += [song(r, 500, 120, [None], (4,)), song(r, 501, 100, [64], (1,), 1), song(r, 502, 900, [64], (32,), 1), {"rec_no": 503, "bpm": 120, "events": []}]
    assert measured(songs) == (want := one_by_one(songs))
    monkeypatch.setattr(heard, "TOGETHER", 30_000)
    assert measured(songs) == want
    assert measured([{"rec_no": 1, "bpm": None, "events": songs[0]["events"]}, {"rec_no": 2, "bpm": 120, "events": None}]) == []


def test_notes_are_found_by_their_frames_as_in_the_matrices():
    r = random.Random(5)
    for _ in range(300):
        cut = list(itertools.accumulate(r.choice((0, 1, 3, 6, 9, 10, 11, 25)) for _ in range(25)))
        notes = [(a, b, r.choice((60, 61, 62, 64))) for a, b in zip(cut, cut[1:]) if r.random() < 0.8]
        n = cut[-1] + r.choice((0, 1)) or 1
        note, onset = np.zeros((n, 128), np.float32), np.zeros((n, 128), np.float32)
        for a, b, p in notes:
            note[a:b, p] = onset[min(a, n - 1), p] = 0.8
        seconds = n * 256 / 22050
        spans = [(max(0.0, float(transcription.frame_seconds(a))), min(seconds, float(transcription.frame_seconds(b))), p, own) for a, b, p, own in heard.note_spans(*map(list, zip(*notes)), n)]
        want = transcription.note_events(note, onset, seconds)
        assert sorted(x for x in spans if (x[1] - x[0]) * 1000 >= 100) == sorted(want)
        got = heard._found(np.zeros(len(notes), int), *map(np.array, zip(*notes)), np.array([n]), np.array([seconds]))
        assert sorted(zip(*(x.tolist() for x in got[1:]))) == sorted(want)


def test_a_clip_costs_little_and_nothing_is_shuffled(spark):
    r = random.Random(9)
    songs = [song(r, i, 120, [60, 62, 64, 65, 67], (4, 8, 16), 40) for i in range(200)]
    assert seconds_of(lambda: measured(songs), 2) < 0.25 * seconds_of(lambda: one_by_one(songs), 1)
    df = generating.queries()["transcription_accuracy"](spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
