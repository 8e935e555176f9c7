"""From audited records to a prepared corpus: copies, families, splits, the leakage check, augmentation, and a seeded corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunewright.functions import music
from tunewright.functions.events import DURATIONS, MAX_PITCH, MIN_PITCH
from tunewright.functions.parse import BPM
from tunewright.operators import audit, dedup, features
from tunewright.operators import tokens as tk
from tunewright.shared import materialize
from tunewright.sources import files, sinks


def manifest(songs: DataFrame, near: bool = True, seed: int = 42) -> DataFrame:
    """rec_no, retained_no, family_id, split of every song with events: copies (events and bpm) take the place of the one that is
    kept, whole families go to one split, by the sizes of the families without copies. Without near a family is a fingerprint.
    """
    songs = songs.where(F.size("events") > 0)
    kept = materialize(dedup.exact_duplicates(songs).select("rec_no", F.col("retained").alias("retained_no")), "prepare_kept")
    families = dedup.families(songs) if near else songs.select("rec_no", music.family_fingerprint(F.col("events")).alias("family_id"))
    families = materialize(families, "prepare_families")
    retained = families.join(kept.where("rec_no = retained_no").select("rec_no"), "rec_no", "left_semi")
    placed = materialize(dedup.family_split(retained, seed).select("family_id", "split"), "prepare_splits")
    split = F.when(F.col("split") == "validation", "val").otherwise(F.col("split")).alias("split")
    return kept.join(families.join(placed, "family_id"), "rec_no").select("rec_no", "retained_no", "family_id", split)


def prepared(records: DataFrame, path: str, seed: int = 42) -> DataFrame:
    """The whole preparation of raw records (rec_no, source, kind, raw): audit, round trips, copies, families, splits, leakage
    check, written to path, a new folder: audit, train, val, test, manifest, summary, checksums. Returns the summary (what, value).

    Fails, with the audit written, if no record is accepted, if a song doesn't survive its canonical text or its tokens, if
    there are fewer than three families, or if a melody stands in two splits.
    """
    spark = records.sparkSession
    made = audit.audited(records, "rec_no", "source")
    made.write.mode("errorifexists").parquet(f"{path}/audit")
    audited = spark.read.parquet(f"{path}/audit")
    songs = audited.where("status <> 'rejected'").select("rec_no", "name", "bpm", "events")
    text = F.concat(F.lit("Generated:"), music.encoded(F.col("bpm"), F.col("events")))
    same = F.xxhash64("bpm", "events")
    again = audit.audited(songs.select("rec_no", F.lit("plain").alias("source"), F.lit("rtttl").alias("kind"), text.alias("raw"), same.alias("before")), "rec_no", "before")
    lost = again.where(~F.coalesce(same == F.col("before"), F.lit(False))).limit(1).count()
    survives = lambda back: F.coalesce((back["bpm"] == F.col("bpm")) & (F.xxhash64(back["events"]) == F.xxhash64("events")), F.lit(False))
    lost += songs.where(~tk.once(tk.decoded(tk.token_ids(F.col("bpm"), F.col("events"))), survives)).limit(1).count()
    if lost:
        raise ValueError("a song doesn't survive its canonical text or its tokens")
    places = materialize(manifest(songs, seed=seed), "prepare_manifest")
    if places.select("family_id").distinct().limit(3).count() < 3:
        raise ValueError("fewer than three families; see the audit")
    kept = places.where("rec_no = retained_no").select("rec_no", "family_id", "split")
    rows = materialize(songs.join(kept, "rec_no"), "prepare_songs")
    if dedup.leakage(rows).limit(1).count() or rows.groupBy("family_id").agg(F.countDistinct("split").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("a melody or a family stands in more than one split")
    for s in ("train", "val", "test"):
        sinks.write_json(rows.where(F.col("split") == s), f"{path}/{s}")
    sinks.write_json(places, f"{path}/manifest")
    per = rows.groupBy("split").agg(F.count(F.lit(1)).alias("songs"), F.countDistinct("family_id").alias("families"), F.sum(F.size("events")).alias("events"))
    each = per.select(F.inline(F.array(*[F.struct(F.concat("split", F.lit(f"_{c}")).alias("what"), F.col(c).cast("bigint").alias("value")) for c in ("songs", "families", "events")])))
    count = lambda df, what: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(what).alias("what"), "value")
    summary = each.unionByName(count(songs, "accepted")).unionByName(count(audited.where("status = 'rejected'"), "rejected")).unionByName(count(rows, "retained"))
    sinks.write_json(summary, f"{path}/summary")
    sums = sinks.checksums(files.read_tree(spark, path))
    sinks.write_json(sums, f"{path}/checksums")
    return spark.read.schema("what string, value bigint").json(f"{path}/summary")


def augmented(songs: DataFrame, most: int = 5, seed: int = 42, epoch: int = 0) -> DataFrame:
    """rec_no, shift, bpm, events of the training songs, moved by a shift that the hash of (seed, epoch, rec_no) picks among those
    within `most` semitones that keep all pitches in range. Songs of another split are left out, never changed."""
    shifts = music.legal_shifts(F.col("events"), -most, most)
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), F.col("rec_no").cast("string"))), 1, 8), 16, 10).cast("bigint")
    made = songs.where("split = 'train'").select("rec_no", "bpm", "events", shifts.alias("shifts")).where(F.size("shifts") > 0)
    made = made.withColumn("shift", F.element_at("shifts", (F.pmod(h, F.size("shifts")) + 1).cast("int")))
    return made.select("rec_no", "shift", "bpm", music.transposed(F.col("events"), F.col("shift")).alias("events"))


def with_tempo(songs: DataFrame, bpm: int) -> DataFrame:
    """songs with another tempo; one out of range is refused."""
    if not BPM[0] <= bpm <= BPM[1]:
        raise ValueError(f"tempo {bpm} out of range")
    return songs.withColumn("bpm", F.lit(bpm))


def promptable(bpm: Column, events: Column, most: int) -> Column:
    """Why a melody can't be a prompt of at most `most` events for the model, or null: nothing is rounded or cut to make it fit."""
    legal = F.forall(events, lambda e: e["duration"].isin(*DURATIONS) & (e["pitch"].isNull() | e["pitch"].between(MIN_PITCH, MAX_PITCH)))
    return F.when(events.isNull() | (F.size(events) == 0), "no events").when(~F.coalesce(bpm.between(*BPM), F.lit(False)), "tempo").when(F.size(events) > most, "too long").when(~F.coalesce(legal, F.lit(False)), "event outside the model")


def prompts(songs: DataFrame, most: int) -> DataFrame:
    """rec_no, error, ids: the tokens of each melody that a model goes on from, without the end; null where it can't be a prompt."""
    error = promptable(F.col("bpm"), F.col("events"), most)
    ids = tk.token_ids(F.col("bpm"), F.col("events"))
    return songs.select("rec_no", error.alias("error"), F.when(error.isNull(), F.slice(ids, F.lit(1), F.size(ids) - 1)).alias("ids"))


def seeded_corpus(spark: SparkSession, songs: int = 128, seed: int = 42) -> DataFrame:
    """rec_no, name, bpm, events, split: small melodies in C major that the hash of (seed, song, place) makes, for demonstrations."""
    h = lambda *of: F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 20)).cast("int")
    scale = F.array(*[F.lit(60 + x) for x in (0, 2, 4, 5, 7, 9, 11, 12, 14, 16)])
    event = lambda i: F.struct(F.when(h("id", i, F.lit("rest")) % 12 > 0, F.element_at(scale, h("id", i, F.lit("p")) % 10 + 1)).alias("pitch"), F.element_at(F.array(F.lit(4), F.lit(8), F.lit(16)), h("id", i, F.lit("d")) % 3 + 1).alias("duration"), (h("id", i, F.lit("dot")) % 8 == 0).alias("dotted"))
    n = h("id", F.lit("n")) % 17 + 16
    split = F.when(h("id", F.lit("split")) % 10 < 8, "train").when(h("id", F.lit("split")) % 10 == 8, "val").otherwise("test")
    return spark.range(songs).select((F.col("id") + 1).alias("rec_no"), F.concat(F.lit("Demo"), (F.col("id") + 1).cast("string")).alias("name"), (h("id", F.lit("bpm")) % 81 + 80).alias("bpm"), F.transform(F.sequence(F.lit(1), n), event).alias("events"), split.alias("split"))


def comparison(songs: DataFrame) -> DataFrame:
    """Training songs against those held out."""
    return features.compared(songs.where("split = 'train'"), songs.where("split IN ('val', 'test')"))
