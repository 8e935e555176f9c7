"""Records that differ only in spelling, found by bottom-up hashing of their structure.

A record `name:settings:melody` is a tree: the name is a leaf, the settings are an unordered node over texts, the
melody is an ordered node over notes. Leaves are normalised and hashed, the children of the unordered node are sorted
by digest, and the record's root digest is that of its three children. Rows are grouped by root digest with map-side
combine; each group carries the least and the greatest normal form, so equality of the two confirms the whole group
structurally without shipping every row's text. Groups whose forms differ (a digest collision) are split by form.

Normal forms are cheap to make, so they are never stored: the groups are written, and a second pass makes the digests
again and joins them to the groups that have copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.shared import materialize

#: White space as Python understands it, for java.util.regex.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]+"
#: Two colons, and after the last one more than white space and commas. Asked of raw: a condition on notes would be pushed below what makes them.
RECORD = r":[^:]*:[^:]*[^:,\s\p{Z}\x1c-\x1f\x85][^:]*\z"


def sections(raw: Column) -> tuple[Column, Column, Column]:
    """Name, settings and melody: the text before the last but one colon, between the last two, and after the last."""
    tail = F.substring_index(raw, ":", -2)
    name = F.substring(raw, F.lit(1), F.length(raw) - F.length(tail) - 1)
    return name, F.substring_index(tail, ":", 1), F.substring_index(tail, ":", -1)


def normal_leaves(rows: DataFrame, *keep: str) -> DataFrame:
    """rows(raw) with leaf (the name's letters and digits), texts (array of settings, sorted) and notes (the melody with
    each note's dots at its end). One step per projection, so that no step is computed again by the next."""
    name, settings, melody = sections(F.col("raw"))
    bare = lambda c: F.lower(F.regexp_replace(c, SPACE, ""))
    cut = rows.select(*keep, F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "").alias("leaf"), F.split(bare(settings), ",").alias("texts"), bare(melody).alias("notes"))
    made = cut.select(*keep, "leaf", F.sort_array(F.array_remove("texts", "")).alias("texts"), F.regexp_replace("notes", ",+$", "").alias("notes"))
    # only melodies with a dot before a note's end need the walk over their notes
    dots = lambda t: F.repeat(F.lit("."), F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))))
    moved = F.array_join(F.transform(F.split("notes", ","), lambda t: F.concat(F.replace(t, F.lit("."), F.lit("")), dots(t))), ",")
    return made.select(*keep, "leaf", "texts", F.when(F.rlike("notes", F.lit(r"\.[^,.]")), moved).otherwise(F.col("notes")).alias("notes"))


def digests(manifest: DataFrame) -> DataFrame:
    """rec_no, root digest (two 64-bit halves) and normal form of every row that is a candidate.

    Rows of another kind, without rec_no or raw, with fewer than two colons or without a note have no record and are left out.
    """
    rows = normal_leaves(manifest.where(F.col("rec_no").isNotNull() & (F.col("kind") == "rtttl") & F.rlike(F.col("raw"), F.lit(RECORD))), "rec_no")
    node = lambda seed: F.xxhash64(F.lit(seed), F.xxhash64(F.lit(seed), "leaf"), F.sort_array(F.transform("texts", lambda t: F.xxhash64(F.lit(seed), t))), F.xxhash64(F.lit(seed), "notes"))
    form = F.concat_ws("\x1f", "leaf", F.array_join("texts", "\x1e"), "notes")
    return rows.select("rec_no", node(1).alias("root_a"), node(2).alias("root_b"), form.alias("form"))


def groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records: root digest, keep_no and copies of every group of equal forms; and the digests under which forms differ.

    One row a record comes out, whatever the number of its copies: they are combined before the shuffle.
    """
    each = rows.groupBy("root_a", "root_b").agg(
        F.min("rec_no").alias("keep_no"), F.count(F.lit(1)).alias("copies"), F.min("form").alias("least"), F.max("form").alias("greatest")
    )
    made = materialize(each.select("root_a", "root_b", "keep_no", "copies", (F.col("least") == F.col("greatest")).alias("sound")).where("copies > 1 OR NOT sound"), "p1_groups")
    return made.where("sound").drop("sound"), made.where("NOT sound").select("root_a", "root_b")


def _by_form(rows: DataFrame, broken: DataFrame) -> DataFrame:
    """Records under a digest that different forms share: root digest, form, keep_no, copies. Hardly ever any."""
    split = rows.join(broken, ["root_a", "root_b"], "left_semi")
    return materialize(split.groupBy("root_a", "root_b", "form").agg(F.min("rec_no").alias("keep_no"), F.count(F.lit(1)).alias("copies")), "p1_split")


def _members(rows: DataFrame, sound: DataFrame, broken: DataFrame) -> DataFrame:
    """rec_no, keep_no, copies of the rows under the digests of groups()."""
    own = rows.select("rec_no", "root_a", "root_b").join(sound, ["root_a", "root_b"]).select("rec_no", "keep_no", "copies")
    if not broken.take(1):
        return own
    return own.unionByName(rows.join(_by_form(rows, broken), ["root_a", "root_b", "form"]).select("rec_no", "keep_no", "copies"))


def copies(manifest: DataFrame) -> DataFrame:
    """rec_no, keep_no, copies of the rows whose record has several: the smallest rec_no of it and how many rows it has.

    Only digests are shuffled here, and against a table: a record that a third of all rows repeat is split by AQE.
    """
    rows = digests(manifest)
    return _members(rows, *groups(rows)).where("copies > 1")


def records(manifest: DataFrame) -> DataFrame:
    """rec_no (the smallest of the record), copies: one row per record, straight from the aggregate."""
    rows = digests(manifest)
    each = rows.groupBy("root_a", "root_b").agg(F.min("rec_no").alias("rec_no"), F.count(F.lit(1)).alias("copies"), F.min("form").alias("least"), F.max("form").alias("greatest"))
    made = materialize(each.select("root_a", "root_b", "rec_no", "copies", (F.col("least") == F.col("greatest")).alias("sound")), "p1_records")
    sound = made.where("sound").select("rec_no", "copies")
    broken = made.where("NOT sound").select("root_a", "root_b")
    if not broken.take(1):
        return sound
    return sound.unionByName(_by_form(rows, broken).select(F.col("keep_no").alias("rec_no"), "copies"))


def collapse(manifest: DataFrame) -> DataFrame:
    """One row per row of the manifest: rec_no, keep_no (the smallest of its record) and copies (rows of the record).

    Repeated rows count as copies of one another. An empty table gives no rows.
    """
    rows = digests(manifest)
    sound, broken = groups(rows)
    single = rows.join(sound.select("root_a", "root_b").unionByName(broken), ["root_a", "root_b"], "left_anti")
    return _members(rows, sound, broken).unionByName(single.select("rec_no", F.col("rec_no").alias("keep_no"), F.lit(1).cast("bigint").alias("copies")))
