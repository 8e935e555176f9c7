"""Operators of the llm package against brute force on whole small tables, and on odd rows."""

import random
from collections import Counter, defaultdict
from functools import reduce
from math import gcd

import numpy as np
import pandas as pd
import pytest
from compare import FOLDER, compare
from pyspark.sql import functions as F

from tunewright.llm import crosssplit, encoding, evalleak, forest, merkle, mixture, queries, spans, splits, truncation

EVENTS = "array<struct<pitch:int,duration:int,dotted:boolean>>"
SONG = f"rec_no long, source string, bpm int, split string, batch_no int, events {EVENTS}, mel string, cid long, label string, n int"
MANIFEST = "rec_no long, source string, kind string, raw string, leaf string, root_a long"


@pytest.fixture(scope="module")
def songs(spark):
    return spark.read.parquet(f"{FOLDER}/songs.parquet")


@pytest.fixture(scope="module")
def rows():
    s = pd.read_parquet(f"{FOLDER}/songs.parquet")
    s["m"] = [tuple((None if e["pitch"] is None or e["pitch"] != e["pitch"] else int(e["pitch"]), int(e["duration"]), bool(e["dotted"])) for e in ev) for ev in s.events]
    return s


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def close(a, b, x, y):
    k = max(len(a), len(b)) // 10
    return abs(len(a) - len(b)) <= k and abs(x - y) * 10 <= max(x, y) and distance(a, b) <= k


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    assert compare(spark, FOLDER, queries.queries()[name], queries.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, name):
    assert queries.queries()[name](spark, FOLDER).count() >= 0


def test_overlaps_equal_brute_force(songs, rows):
    want = set()
    known = rows[rows.split.notna()]
    for a in known[known.split == "train"].itertuples():
        for b in known[known.split != "train"].itertuples():
            if close(a.m, b.m, a.bpm, b.bpm):
                want.add((min(a.rec_no, b.rec_no), max(a.rec_no, b.rec_no)))
    assert {tuple(r) for r in crosssplit.overlaps(songs).collect()} == want
    per = Counter()
    for a, b in want:
        per[rows.set_index("rec_no").split[a if rows.set_index("rec_no").split[a] != "train" else b]] += 1
    got = Counter()
    for r in crosssplit.overlap_counts(songs).collect():
        got[r.split] += r.pairs
    assert got == per


def test_short_melodies_of_all_lengths(spark):
    """Edits at every place of melodies of 1 to 24 events: the pieces lose no pair."""
    rng, made = random.Random(4), []
    for n in range(1, 25):
        base = [(rng.randint(60, 107), rng.choice([1, 2, 4, 8]), False) for _ in range(n)]
        for i in range(n):
            other = (rng.randint(60, 107), 16, True)
            made += [("train", base), ("val", base[:i] + [other] + base[i + 1 :]), ("test", base[:i] + base[i + 1 :]), ("val", base[:i] + [other] + base[i:])]
    table = [(i + 1, "s", 100, s, 1, m, "x", 0, "y", 0) for i, (s, m) in enumerate(made) if m]
    got = {tuple(r) for r in crosssplit.overlaps(spark.createDataFrame(table, SONG)).collect()}
    train = [r for r in table if r[3] == "train"]
    want = {tuple(sorted((a[0], b[0]))) for a in train for b in table if b[3] != "train" and close(a[5], b[5], 100, 100)}
    assert got == want


@pytest.fixture(scope="module")
def repeated(songs):
    return {r.rec_no for r in forest.repeats(songs).collect()}


def test_forest_recall(songs, rows, repeated, spark):
    by = defaultdict(list)
    for r in rows.itertuples():
        by[r.batch_no].append(r)
    want = {b.rec_no for b in rows.itertuples() for a in rows.itertuples() if a.batch_no < b.batch_no and close(a.m, b.m, a.bpm, b.bpm)}
    got = repeated
    assert got <= want
    assert len(got) >= 0.95 * len(want)
    store, one_by_one = forest.HashForest(spark), set()
    store.MERGE_AT = 3
    for batch in sorted(by):
        part = songs.where(F.col("batch_no") == batch)
        one_by_one |= {r.rec_no for r in store.check(part).collect()}
        store.accept()
    assert len(store.runs) < 3
    assert one_by_one == got
    assert forest.recall_at(forest.WIDEST, 0.74) > 0.99


def test_forest_opened_again(songs, repeated, spark, tmp_path):
    """A second session on the folder finds what the first accepted, and a batch accepted is found by an object that never saw it."""
    path, newest = str(tmp_path / "forest"), songs.agg(F.max("batch_no")).first()[0]
    first = forest.HashForest(spark, path)
    first.check(songs.where(F.col("batch_no") < newest))
    first.accept()
    store = forest.HashForest(spark, path)
    assert store.version == first.version and store.runs == first.runs
    batch = songs.where(F.col("batch_no") == newest)
    assert {r.rec_no for r in store.check(batch).collect()} == repeated & {r.rec_no for r in batch.collect()}
    store.accept()
    again = forest.HashForest(spark, path)
    assert len(again.runs) == 2
    again.vacuum()
    assert again.check(batch.where("bpm IS NOT NULL")).count() == batch.where("bpm IS NOT NULL").count()


def test_forest_reads_parts(songs, spark, tmp_path, monkeypatch):
    """The entries that a fixed batch makes the forest read stay as many when the history is four times as large."""
    monkeypatch.setattr(forest.HashForest, "PART", 40)
    rng, read = random.Random(1), []
    made = lambda n, first: spark.createDataFrame([(first + i, "s", 100, "train", 1, [(rng.randint(60, 107), rng.choice([4, 8]), False) for _ in range(20)], "", 0, "", 0) for i in range(n)], SONG)
    for n in (600, 2400):
        store = forest.HashForest(spark, f"{tmp_path}/{n}")
        store.check(made(n, 0))
        store.accept()
        store.check(made(3, 10_000))
        asked = store._open(store.staged, "entries")
        read.append((store._entries(asked, store.runs).count(), store._open(store.runs[0], "entries").count()))
    (small, _), (large, whole) = read
    assert whole == 2400 * forest.TREES and large < 1.5 * small and large < 0.15 * whole


def test_shared_spans_equal_brute_force(songs, rows):
    at = defaultdict(set)
    for r in rows.itertuples():
        for i in range(len(r.m) - 23):
            at[r.m[i : i + 24]].add(r.rec_no)
    want = {(a, b) for s in at.values() for a in s for b in s if a < b}
    assert {tuple(r) for r in spans.shared_pairs(songs).collect()} == want
    covered = {r.rec_no: r.shared for r in spans.coverage(songs).collect()}
    for r in rows.itertuples():
        mask = np.zeros(len(r.m), bool)
        for i in range(len(r.m) - 23):
            if len(at[r.m[i : i + 24]]) > 1:
                mask[i : i + 24] = True
        assert covered[r.rec_no] == mask.sum()
    melody = dict(zip(rows.rec_no, rows.m, strict=True))
    for r in spans.shared_spans(songs).collect():
        a, b = melody[r.rec_a][r.at_a :], melody[r.rec_b][r.at_b :]
        assert a[: r.span] == b[: r.span] and r.span >= 24 and (len(a) == r.span or len(b) == r.span or a[r.span] != b[r.span])


def test_saturated_sketch_loses_nothing(songs):
    _, classes, windows = spans._prepared(songs, 24)
    few = spans.repeated_windows(classes, 24, max_cells=1 << 16)
    real = {tuple(r) for r in spans._shared(windows).select("ha", "hb").collect()}
    assert real == {tuple(r) for r in spans._shared(few).select("ha", "hb").collect()}
    assert few.count() >= windows.count()


def test_groups_and_splits(songs, rows, spark):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in rows.itertuples():
        first = next((p for p, _, _ in r.m if p is not None), 0)
        t = [128 // d * (3 if q else 2) // 2 for _, d, q in r.m]
        form = tuple((None if p is None else p - first, x // reduce(gcd, t)) for (p, _, _), x in zip(r.m, t, strict=True))
        for other in (("s", r.source), ("m", form)):
            parent[find(other)] = find(("r", r.rec_no))
    group = defaultdict(list)
    for r in rows.itertuples():
        group[find(("r", r.rec_no))].append(r)
    want = {(r.rec_no, min(x.rec_no for x in g)) for g in group.values() if len({x.source for x in g}) > 1 for r in g}
    assert {tuple(r) for r in splits.linked_groups(songs).collect()} == want
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split string, target_share double")
    made = splits.assign(songs, targets).collect()
    assert len(made) == len(rows) and all(len({r.split for r in made if r.group_no == g}) == 1 for g in {r.group_no for r in made})


def test_differencing():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 100, 500).astype(float)
    where, sums = splits.differencing(w, 10)
    assert sorted(np.bincount(where, w, 10)) == sorted(sums) and sums.max() - sums.min() <= 2
    assert splits.allocate([(0, 80), (1, 10), (2, 10)], [("train", 0.8), ("val", 0.1), ("test", 0.1)])[0] == (0, "train")


def test_bins_over_many_chunks(spark):
    groups = spark.range(3000).select(F.col("id").alias("item"), (F.col("id") % 17 + 1).alias("weight"))
    made = splits.bins_of(groups, bins=10, chunk=100).join(groups, "item").groupBy("bin").agg(F.sum("weight").alias("w")).collect()
    assert len(made) == 10 and max(r.w for r in made) - min(r.w for r in made) < 0.02 * sum(r.w for r in made)
    assert splits.bins_of(groups, bins=10, chunk=100).count() == 3000


def test_collapse_odd_rows(spark):
    same = ["A B:d=4,o=5:c,d.", "ab:O=5, d=4,:C,.d,,", " a-b!:o=5,d=4:c , d .", "a:b:d=4,o=5:c,d."]
    other = ["ab:o=5:c,d.", "ab:d=4,o=5:c,d", "ab:d=4,o=5:4c,d.", "ab:d=4,d=4,o=5:c,d.", "é:d=4,o=5:c,d."]
    bad = [None, "", "x", "a:b", "a:d=4:", "a:d=4: , ,"]
    rows = [(i + 1, "s", "rtttl", r, "x", 5) for i, r in enumerate(same + other + bad)] + [(1, "s", "rtttl", same[0], None, None), (50, None, "empty", same[0], None, None), (51, None, None, same[0], None, None), (None, "s", "rtttl", same[0], None, None)]
    made = merkle.collapse(spark.createDataFrame(rows, MANIFEST)).collect()
    assert {(r.rec_no, r.keep_no) for r in made if r.rec_no <= 4} == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert {r.copies for r in made if r.keep_no == 1} == {5}
    assert all(r.rec_no == r.keep_no for r in made if r.rec_no > 4) and len(made) == 10


def final_plan(df):
    """The plan that ran, with what adaptive execution made of it."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_skew(spark):
    """Thresholds at which adaptive execution splits partitions of a few kilobytes, and no broadcast."""
    own = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_hot_record_is_split(spark, small_skew):
    rows = spark.range(40_000).repartition(8).select(F.col("id").alias("rec_no"), F.lit("s").alias("source"), F.lit("rtttl").alias("kind"), F.when(F.col("id") % 3 == 0, "hot:d=4:c").otherwise(F.concat(F.lit("n"), (F.col("id") / 2).cast("int").cast("string"), F.lit(":d=4:c"))).alias("raw"))
    df = merkle.copies(rows)
    assert "skew=true" in final_plan(df)
    assert df.where("copies > 10000").count() == 13_334


def test_digest_collisions_are_split(spark, monkeypatch):
    real = merkle.digests
    monkeypatch.setattr(merkle, "digests", lambda m: real(m).withColumn("root_a", F.lit(1)).withColumn("root_b", F.lit(1)))
    rows = [(i, "s", "rtttl", f"n:d=4:{'c' if i % 2 else 'd'}", None, None) for i in range(1, 7)]
    made = {(r.rec_no, r.keep_no) for r in merkle.collapse(spark.createDataFrame(rows, MANIFEST)).collect()}
    assert made == {(i, 1 if i % 2 else 2) for i in range(1, 7)}


def odd_songs(spark):
    long = [(60 + i % 40, 8, i % 7 == 0) for i in range(30)]
    rows = [
        (1, "a", 100, "train", 1, long), (2, None, 100, "val", 2, long), (2, None, 100, "val", 2, long), (3, "a", None, "train", 1, long), (4, "b", 100, None, None, long), (5, "b", 100, "test", 3, None), (6, "b", 100, "val", 3, []),
        (7, "c", 100, "val", 3, [None, (60, 8, None)]), (8, "c", 100, "val", 3, [(20, 8, False)] * 30), (9, "c", 100, "val", 3, [(None, 8, None)] * 3), (None, "c", 100, "train", 1, long), (10, "d", 104, "val", 4, long[:15] + long[16:]), (11, "e", 100, "other", 4, [(60, 3, False)] * 30),
    ]
    return spark.createDataFrame([(*r, "clash", 99, "clash", 99) for r in rows], SONG)


def test_odd_songs(spark):
    s = odd_songs(spark)
    assert {tuple(r) for r in crosssplit.overlaps(s).collect()} == {(1, 2), (1, 10)}
    assert {r.rec_no for r in forest.repeats(s).collect()} == {2, 10}
    assert {tuple(r) for r in spans.shared_pairs(s).collect()} >= {(1, 2), (1, 3), (1, 4), (3, 4)}
    assert {r.rec_no for r in spans.coverage(s).collect()} == {1, 2, 3, 4, 9, 10}
    assert {(r.rec_no, r.group_no) for r in splits.linked_groups(s).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)}
    assert splits.assign(s, spark.createDataFrame([], "split string, target_share double")).where("split IS NOT NULL").count() == 0


def test_empty_tables(spark):
    s = odd_songs(spark).limit(0)
    m = spark.createDataFrame([], MANIFEST)
    d = spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")
    e = spark.createDataFrame([], "item_id long, split string, lang string, text string")
    for f in (crosssplit.overlaps, crosssplit.overlap_counts, forest.repeats, spans.shared_pairs, spans.shared_spans, spans.coverage, splits.linked_groups):
        assert f(s).count() == 0
    assert merkle.collapse(m).count() == 0
    assert encoding.damaged(encoding.texts_of(m, "rec_no", F.col("raw"), "raw"), "rec_no").count() == 0
    assert evalleak.leaks(d, e).count() == 0 and truncation.judged(d).count() == 0
    chosen, report = mixture.plan(d, spark.createDataFrame([("x", 1.0, 2)], "source string, target_share double, max_repeats int"))
    assert chosen.count() == 0 and report.first().actual_share == 0


def test_hot_group(spark, monkeypatch):
    """A third of all songs are one melody and another third one family: all are found, none is lost."""
    rng = random.Random(8)
    base = [(rng.randint(60, 107), 8, False) for _ in range(40)]
    rows = []
    for i in range(300):
        m = list(base)
        if i % 3 == 1:
            m[rng.randrange(40)] = (rng.randint(60, 107), 4, True)
        elif i % 3 == 2:
            m = [(rng.randint(60, 107), rng.choice([4, 8]), False) for _ in range(40)]
        rows.append((i + 1, f"s{i % 5}", 100, "train" if i % 4 else "val", i // 50 + 1, m, "", 0, "", 0))
    s = spark.createDataFrame(rows, SONG)
    want = {tuple(sorted((a[0], b[0]))) for a in rows for b in rows if a[3] == "train" and b[3] == "val" and close(a[5], b[5], 100, 100)}
    assert {tuple(r) for r in crosssplit.overlaps(s).collect()} == want
    repeat = {b[0] for b in rows if any(a[4] < b[4] and close(a[5], b[5], 100, 100) for a in rows)}
    monkeypatch.setattr(forest.HashForest, "FULL", 3)  # the family's ranges count as full
    assert {r.rec_no for r in forest.repeats(s).collect()} == repeat


def test_encodings(spark):
    good = ["Süßer Nebel", "Там снег", "Où va la fée", "Ðagur Hop", "SÃO NUVENS", "½ Tempo", "Niño del río"]
    rows = [(i, "s", f"{t}:d=4:c") for i, t in enumerate(good * 30)]
    garble = {1000: "Süßer Nebel".encode().decode("cp1252"), 1001: "Niño del río".encode().decode("mac_roman"), 1002: "Süßer Nebel".encode("cp1252").decode("cp1251"), 1003: "Где снег".encode("cp1251").decode("cp1252"), 1004: "Où va la fée".encode().decode("latin1").encode().decode("latin1"), 1005: "S�ßer"}
    rows += [(k, "s", f"{t}:d=4:c") for k, t in garble.items()] + [(2000, None, None), (2001, "s", ""), (2002, "s", "plain:d=4:c"), (2003, None, "Süßer:d=4:c")]
    m = spark.createDataFrame(rows, "rec_no long, source string, raw string")
    made = {r.rec_no: r.restored for r in encoding.damaged(encoding.texts_of(m, "rec_no", F.col("raw"), "raw", keep=True), "rec_no", repair=True).collect()}
    assert set(made) == set(garble)
    assert made[1000] == "Süßer Nebel:d=4:c" and made[1001] == "Niño del río:d=4:c" and made[1002] == "Süßer Nebel:d=4:c" and made[1004] == "Où va la fée:d=4:c" and made[1005] is None


def test_automaton_equals_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(6)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, "val", "en", text(rng.randint(0, 30))) for i in range(20)] + [(50, "test", None, None), (51, "test", "en", "")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (102, items[3][3] + "! " + items[4][3].upper()), (102, items[3][3])]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, split string, lang string, text string")
    for n in (2, 3, 5):
        grams = lambda t: {tuple(t.lower().replace("!", "").split()[i : i + n]) for i in range(len((t or "").replace("!", "").split()) - n + 1)}  # noqa: B023, E731
        want = {(a, b) for a, t in docs for b, _, _, u in items if t and u and grams(t) & grams(u)}
        assert {tuple(r) for r in evalleak.leaks(d, e, n).collect()} == want
    cut = {r.doc_id: r for r in evalleak.cleaned(d, e, 5, 1.0).collect()}
    assert all(not evalleak.Automaton([(1, evalleak.words(u))], 5).items or r.removed_words >= 5 for r in cut.values() for _, _, _, u in items[:1] if u)
    want = sorted(map(tuple, evalleak.spans(d, e, 5).collect()))
    monkeypatch.setattr(evalleak, "MAX_WORDS", 50)
    assert len(evalleak._groups(e, 50)) > 3
    assert sorted(map(tuple, evalleak.spans(d, e, 5).collect())) == want


@pytest.mark.parametrize(
    ("text", "open_"),
    [
        ("A whole sentence.", False), ("Is it? (Yes.)", False), ("„Ganz gut.“", False), ("It stops in the mid", True), ("It stops after ", True), ("It trails off…", True), ("Text.\n- one\n- two", False), ("Text.\n— the crew", False),
        ("Text.\nTags: a, b c", False), ("Text.\nTune:d=4,o=5,b=90:c,d#,8p.,e6", False), ("Text.\nTune:d=4,o=5,b=90:c,d#,e,,", False), ("Text.\nTune:d=4,o=5,b=90:c,d#,1", True), ("Half a byte s�", True), ("Text.\n\nThe ne", True), ("A tag <a hre", True), ("Escape \\u00", True),
    ],
)
def test_endings(text, open_):
    assert truncation.ending(text)[0] == open_


def test_source_style(spark):
    loose = [(i, f"no stop in text {'x' * i}", "loose") for i in range(40)]
    strict = [(100 + i, "All is well." + " More." * i, "strict") for i in range(40)] + [(200, "It was cu", "strict"), (201, None, "strict"), (202, "  ", None), (203, "cut of", None)]
    limit = [(300 + i, f"{i}" + "y" * 79, "loose") for i in range(6)]  # copies of one text would be no evidence
    d = spark.createDataFrame(loose + strict + limit, "doc_id long, text string, source string")
    made = {r.doc_id: r.reason for r in truncation.judged(d).collect()}
    assert {k for k, v in made.items() if v} == {200, 203} | set(range(300, 306))
    assert made[300] == "field limit" and made[200] == "no terminator" and 201 not in made


@pytest.mark.parametrize("n", [200, 20_000, 100_000])
def test_loose_source_has_no_limit(spark, n):
    """Whole texts that end in the open, a third of them copies of one text: none is cut, however many there are."""
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("the same words again and again")).otherwise(F.concat(F.lit("word "), F.repeat(F.lit("x"), (F.xxhash64("id") % 40 + 41).cast("int")), F.col("id").cast("string"))).alias("text"), F.lit("loose").alias("source"))
    assert truncation.judged(rows).where("truncated").count() == 0


def test_limit_in_bytes(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeüé") for _ in range(rng.randint(2, 9)))
    text = lambda: " ".join(word() for _ in range(rng.randint(10, 60)))
    rows = [(i, text(), "loose") for i in range(400)]
    cut = [(i, t.encode()[:200].decode(errors="ignore"), s) if len(t.encode()) > 200 else (i, t, s) for i, t, s in rows]
    d = spark.createDataFrame(cut, "doc_id long, text string, source string")
    got = {r.doc_id for r in truncation.judged(d).where("reason = 'field limit'").collect()}
    want = {i for i, t, _ in rows if len(t.encode()) > 200}
    assert want <= got and len(got - want) <= 3


def test_mixture(spark):
    rng = random.Random(3)
    docs = [(i, "word " * rng.randint(1, 40), ["big", "small", "hot"][0 if i < 200 else 1 if i < 220 else 2], "en", 1) for i in range(600)] + [(700, None, "big", None, None), (701, "", "big", None, None), (702, "stray", "none", None, None), (703, "x" * 5000, "big", None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long")
    t = spark.createDataFrame([("big", 0.3, 1), ("small", 0.4, 3), ("hot", 0.3, 2), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixture.plan(d, t, total=3000)
    rows, shares = chosen.collect(), {r.source: r for r in report.collect()}
    assert all(r.copies <= {"big": 1, "small": 3, "hot": 2}[r.source] for r in rows)
    assert sum(r.copies * r.tokens for r in rows) <= 3000
    assert shares["gone"].actual_share == 0 and shares["big"].actual_share == pytest.approx(shares["hot"].actual_share, abs=0.06)
    per = Counter()
    for r in rows:
        per[r.source] += r.copies * r.tokens
    assert all(shares[s].tokens == n for s, n in per.items())
    again, _ = mixture.plan(d.repartition(7), t, total=3000)
    assert sorted(again.collect()) == sorted(rows)
    assert mixture.budgets([("a", 0.5, 1), ("b", 0.5, 4)], {"a": 10, "b": 100}, 100.0) == {"a": 10.0, "b": 90.0}


def test_a_replay_of_more_batches_makes_no_more_jobs(songs, spark):
    """Batches that fit together are staged and looked up by the same jobs: the driver holds no more plans for eight than for two."""
    scheduler, jobs = spark.sparkContext._jsc.sc().dagScheduler(), []
    for n in (2, 8):
        before = scheduler.numTotalJobs()
        assert forest.repeats(songs.withColumn("batch_no", (F.col("rec_no") % n).cast("int"))).count() > 0
        jobs.append(scheduler.numTotalJobs() - before)
    assert jobs[1] < 1.5 * jobs[0]
