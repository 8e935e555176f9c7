"""Operators against brute force and by metamorphic changes."""

import math
import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunewright.functions import music
from tunewright.functions.transitions import with_transitions
from tunewright.operators import dedup, features, generation, graph, similarity, timeline, titles, transcription
from tunewright.operators import tokens as tk

SONG = "rec_no long, name string, bpm int, split string, events array<struct<pitch:int,duration:int,dotted:boolean>>"


def melody(rng, n, low=66, high=90):
    return [(None if rng.random() < 0.1 else rng.randint(low, high), rng.choice([2, 4, 8, 16]), rng.random() < 0.15) for _ in range(n)]


def table(spark, melodies, splits=None, bpm=120):
    return spark.createDataFrame([(i + 1, f"s{i}", bpm, (splits or ["train"] * len(melodies))[i], m) for i, m in enumerate(melodies)], SONG)


def test_family_is_invariant(spark):
    m = [(60, 8, False), (64, 8, False), (None, 4, False), (67, 8, True), (72, 2, False)]
    faster = [(p, d * 2, dot) for p, d, dot in m]
    higher = [(p and p + 3, d, dot) for p, d, dot in m]
    rows = table(spark, [m, faster, higher, m[::-1]]).select("rec_no", music.family_fingerprint(F.col("events")).alias("f"), music.exact_fingerprint(F.col("bpm"), F.col("events")).alias("x")).collect()
    assert len({r.f for r in rows[:3]}) == 1
    assert len({r.x for r in rows}) == 4
    assert rows[3].f != rows[0].f


def test_near_duplicates_are_found_and_verified(spark):
    rng = random.Random(5)
    base = [melody(rng, 65) for _ in range(12)]
    changed = [list(b) for b in base[:4]]
    for c in changed:
        c[30] = (c[30][0] + 1 if c[30][0] else 70, *c[30][1:])
    songs = table(spark, base + changed + [base[5][:48], base[0]])
    reps = dedup.representatives(songs)
    tokens = {r.rec_no: r.tokens for r in with_transitions(songs, "rec_no").collect()}
    got = {(min(r.a, r.b), max(r.a, r.b)): r.similarity for r in dedup.verified(dedup.near_candidates(reps), reps).collect()}
    assert set(got) == {(1, 13), (2, 14), (3, 15), (4, 16), (6, 17)}
    family = {r.rec_no: r.family for r in reps.collect()}
    for (a, b), s in got.items():
        first, second = sorted((a, b), key=lambda x: family[x])
        blocks = SequenceMatcher(None, tokens[second], tokens[first], autojunk=False).get_matching_blocks()
        assert s == pytest.approx(2 * sum(m.size for m in blocks) / (len(tokens[a]) + len(tokens[b])))
    ids = {r.rec_no: r.family_id for r in dedup.families(songs).collect()}
    assert ids[1] == ids[13] == ids[18]
    assert len(set(ids.values())) == 12


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(1, 300), rng.randint(1, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("sizes", [[1] * 800 + [3] * 200, [20, 1, 1], [1], [5, 5]])
def test_family_split(spark, sizes):
    rows = [(i * 100 + j, f"f{i}") for i, n in enumerate(sizes) for j in range(n)]
    a = dedup.family_split(spark.createDataFrame(rows, "rec_no long, family_id string")).collect()
    b = dedup.family_split(spark.createDataFrame(rows[::-1], "rec_no long, family_id string")).collect()
    assert {(r.family_id, r.split) for r in a} == {(r.family_id, r.split) for r in b}
    assert sum(r.size for r in a) == sum(sizes)
    count = Counter()
    for r in a:
        count[r.split] += r.size
    if len(sizes) >= 3:
        assert set(count) == {"train", "validation", "test"}
    if len(sizes) == 1000:
        assert abs(count["train"] - 1120) <= 3
    if sizes[0] == 20:
        assert count["train"] == 20


def test_nearest_equals_brute_force(spark):
    rng = random.Random(9)
    base = [melody(rng, rng.randint(1, 30)) for _ in range(40)]
    asked = [base[3], [(p and p + 2, d, x) for p, d, x in base[4]], base[7][:-2] + melody(rng, 3), melody(rng, 20), [(None, 32, True)] * 2]
    songs = table(spark, base)
    q = spark.createDataFrame([(100 + i, "q", 90, "val", m) for i, m in enumerate(asked)], SONG)
    got = {r.rec_no: r for r in similarity.nearest(q, songs).collect()}
    tokens = {r.rec_no: r.tokens for r in with_transitions(songs.unionByName(q), "rec_no").collect()}

    def sets(t):
        cut = lambda x: {tuple(x[i : i + 3]) for i in range(max(1, len(x) - 2))}
        return cut(t), cut([v >> 20 for v in t]), cut([v % (1 << 20) for v in t])

    for i in range(len(asked)):
        best = (0.0, 1)
        for r in range(1, len(base) + 1):
            s = sum(w * len(a & b) / len(a | b) for w, a, b in zip((0.55, 0.30, 0.15), sets(tokens[100 + i]), sets(tokens[r]), strict=True))
            if s > best[0] + 1e-12:
                best = (s, r)
        row = got[100 + i]
        if row.exact_match or row.invariant_match:
            assert row.score == 1.0
        else:
            assert (row.score, row.closest_no) == (pytest.approx(best[0]), best[1])
    assert got[100].exact_match and got[100].closest_no == 4 and got[100].label == "exact training match"
    assert got[101].invariant_match and not got[101].exact_match
    none = similarity.nearest(q, songs.limit(0)).collect()
    assert {r.label for r in none} == {"no training reference"}


def test_repetition_goldens(spark):
    n = lambda p: (p, 8, False)
    intro = [n(60), n(62), n(65), n(69), n(64)]
    run = intro + [(75, 8 if i % 2 else 16, False) for i in range(8)]
    motif = intro + [n(p) for p in (70, 72) * 4]
    rests = [(None, d, False) for d in (1, 2, 4, 8, 16, 32, 1, 2)]
    got = {r.rec_no: r for r in features.repetition(table(spark, [run, motif, rests, [n(60)]])).collect()}
    assert (got[1].longest_pitch_run, got[1].longest_event_run) == (8, 1)
    assert got[1].max_pitch_motif_repeats == 0
    assert got[2].max_pitch_motif_repeats == 4
    assert (got[3].longest_pitch_run, got[3].unique_pitches, got[3].repeated_pitch_ngram_fraction) == (8, 0, pytest.approx(0.8))
    flags = {r.rec_no: r.flags for r in features.flags(table(spark, [run, motif, rests, [n(60)]])).collect()}
    assert "local_pitch_run_at_least_8" in flags[1] and "repeated_pitch_motif_at_least_4" in flags[2] and "all_rests" in flags[3] and flags[4] == []


def test_model_probabilities_sum_to_one(spark):
    rows = [([], 3, 2), ([], 4, 1), ([], 2, 2), ([1], 3, 2), ([1, 3], 4, 1), ([1, 3], 2, 1)]
    counts = spark.createDataFrame(rows, "context array<int>, target int, n long")
    pairs = spark.createDataFrame([(c, t, 1) for c in ([1, 3], [9, 9], []) for t in range(8)], "context array<int>, target int, n long")
    made = tk.log_probabilities(pairs, counts, 3, 0.1, 8).groupBy("context").agg(F.sum("p").alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in made)
    model = generation.Model([(tuple(c), t, n) for c, t, n in rows], 3)
    assert np.exp(model.log_probabilities([1, 3])).sum() == pytest.approx(1.0)


def test_windows_hold_every_target_once(spark):
    rng = random.Random(1)
    seqs = tk.sequences(table(spark, [melody(rng, n) for n in (1, 7, 8, 43)]))
    whole = Counter(t for r in seqs.collect() for t in r.ids[1:])
    wins = tk.windows(seqs, 16).collect()
    assert Counter(t for r in wins for t in r.targets if t != tk.PAD) == whole
    assert all(len(r.inputs) == len(r.targets) == 16 for r in wins)


def test_generation_is_repeatable_and_legal(spark):
    rng = random.Random(2)
    counts = tk.ngram_counts(tk.sequences(table(spark, [melody(rng, 40) for _ in range(20)])), 3)
    plan = generation.plan(spark, 10, profile="mixed")
    s = generation.Sampling(min_events=4, max_events=20)
    a, b = (sorted(generation.generated(plan, counts, 3, s).select("id", "ids").collect()) for _ in range(2))
    assert a == b
    rows = generation.generated(plan, counts, 3, s)
    m = generation.metrics(rows).first()
    assert m.attempts == 10 and m.valid == 10
    for r in rows.collect():
        history = r.ids[2:-1:2]
        assert not any(len(set(history[i : i + 5])) == 1 for i in range(len(history) - 4))
    shorter = {r.id: r.profile for r in generation.plan(spark, 4, profile="mixed").collect()}
    longer = {r.id: r.profile for r in plan.collect()}
    assert all(longer[i] == p for i, p in shorter.items())
    assert Counter(longer.values()) == dict.fromkeys(generation.PROFILES, 2)


def test_grid_and_lag(spark):
    notes = spark.createDataFrame([(1, 0.0, 1.0, 60, 0.5), (1, 0.5, 2.0, 60, 0.9), (1, 1.9, 2.1, 64, 1.0)], "key long, start double, end double, midi long, confidence double")
    got = {(r.step, r.midi): r.strength for r in timeline.interval_grid(notes, 1.0).collect()}
    assert got == {(0, 60): pytest.approx(0.5), (1, 60): pytest.approx(0.9), (1, 64): pytest.approx(0.1), (2, 64): pytest.approx(0.1)}
    series = spark.createDataFrame([(1, t, 1 if t % 4 == 0 else 0) for t in range(40)], "key long, t long, x long")
    assert timeline.best_lag(timeline.lag_products(series, 10)).first().lag == 4


def test_paths():
    slots = [{60: 0.9}, {60: 0.5, 72: 0.55}, {60: 0.9}]
    assert transcription.lead_path(slots, [{60: 0.9}, {}, {}], voice=0.0) == [60, 60, 60]
    assert transcription.lead_path([{}, {}], [{}, {}]) == [None, None]
    assert transcription.duration_parts(6, 16) == [(4, True)]
    assert sum(16 / d * (1.5 if x else 1) for d, x in transcription.duration_parts(13, 16)) == 13
    assert transcription.spans(np.array([0, 1, 1, 0, 1, 0, 0, 0]), 0.5, 2, 2) == [(1, 5)]
    assert transcription.upper_path([{60: 1.0, 72: 0.5}, {60: 1.0, 72: 0.9}]) == [60, 72]


def test_titles():
    assert titles.sanitize("Title: “Paper Rockets”") == ("Paper Rockets", None)
    for bad, why in ((None, "no text"), ("12 34", "no letters"), ("a\nb", "control characters"), ("<b>x</b>", "punctuation"), ("one two three four five six seven", "too many words"), ("Here is Dawn", "prose"), ("x" * 61, "length")):
        assert titles.sanitize(bad) == (None, why)
    assert [x for x, _ in titles.unique(["Dawn", "dawn", "DAWN"], 4, "")] == ["Dawn", "daw2", "DAW3"]
    records = [{"rtttl": f"n{i}:d=4,o=5,b=90:c", "name": f"n{i}", "valid": i != 2} for i in range(4)]
    out, report = titles.name_batch(records, lambda r, used, seed: "Amber Tides")
    assert report == {"attempted": 3, "named": 3, "failed": 0, "disambiguated": 2, "skipped": 1}
    assert out[1]["rtttl"].endswith(":d=4,o=5,b=90:c") and out[2] == records[2]


def test_divergence_and_entropy(spark):
    h = lambda d: spark.createDataFrame([("k", float(v), n) for v, n in d.items()], "kind string, value double, n long")
    assert features.divergence(h({1: 2, 2: 2}), h({1: 1, 2: 1})).first().bits == pytest.approx(0.0)
    assert features.divergence(h({1: 1}), h({2: 5})).first().bits == pytest.approx(1.0)
    assert features.divergence(h({1: 1}), h({}) if False else h({1: 1}).limit(0)).first().bits is None
    two = features.entropies(table(spark, [[(60, 4, False), (62, 4, False)]])).where("kind = 'pitch'").first().bits
    assert math.isclose(two, 1.0)


def test_empty_tables(spark):
    none = table(spark, [[(60, 4, False)]]).limit(0)
    for f in (dedup.exact_duplicates, features.repetition, features.flags, features.description, features.distribution, dedup.families, lambda s: similarity.nearest(s, s), dedup.leakage):
        assert f(none).count() == 0
    assert dedup.dedup_report(none).first().songs == 0
