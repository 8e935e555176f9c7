"""Queries on a library of songs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunewright.operators import library
from tunewright.plans.corpus import Query, on, table
from tunewright.plans.timelines import _SAMPLES, _samples


def _append_newest(songs: DataFrame) -> DataFrame:
    """The newest batch appended to all songs before it and those without a batch, one shelf per split, the newest 64 of each."""
    newest = songs.agg(F.max("batch_no").alias("newest"))
    marked = songs.select("id", "rec_no", "split", "batch_no").join(F.broadcast(newest))  # one row
    fresh, cols = F.coalesce(F.col("batch_no") == F.col("newest"), F.lit(False)), ["id", "rec_no", "split"]
    made = library.appended(marked.where(~fresh).select(*cols), marked.where(fresh).select(*cols), "id", "split", [F.desc("rec_no")])
    return made.select("id", "rec_no", "split", F.col("rank").cast("bigint").alias("rank"))


_APPEND_NEWEST = """
    WITH m AS (SELECT max(batch_no) AS newest FROM songs), old AS (SELECT id, rec_no, split FROM songs, m WHERE batch_no IS DISTINCT FROM newest OR newest IS NULL), new AS (
      SELECT id, rec_no, split FROM (SELECT s.*, row_number() OVER (PARTITION BY id ORDER BY rec_no DESC) AS r FROM songs s, m WHERE batch_no = newest AND NOT EXISTS (SELECT 1 FROM old WHERE old.id = s.id)) WHERE r = 1 OR id IS NULL),
    a AS (SELECT * FROM old UNION ALL SELECT * FROM new)
    SELECT id, rec_no, split, rank FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY rec_no DESC) AS rank FROM a) WHERE rank <= 64"""


def _merge(spark: SparkSession, folder: str) -> DataFrame:
    """Titles of songs into the manifest, by id and source hash."""
    m = table(spark, folder, "manifest").where("kind = 'rtttl'").select("rec_no", "id", "source_sha256", F.lit("untitled").alias("name"))
    t = table(spark, folder, "songs").select("id", "source_sha256", F.col("name").alias("title"))
    return library.merged_titles(m, t, "id", "source_sha256").select("rec_no", "title", "merged")


_MERGE = """
    WITH t AS (SELECT id, source_sha256, min(name) AS title FROM songs GROUP BY 1, 2)
    SELECT rec_no, coalesce(title, 'untitled') AS title, title IS NOT NULL AS merged FROM manifest m LEFT JOIN t USING (id, source_sha256) WHERE kind = 'rtttl'"""


def _reference(spark: SparkSession, folder: str) -> DataFrame:
    songs = table(spark, folder, "songs")
    made = library.training_reference(songs.select("rec_no", "id", "split", "source_sha256"), songs.where("split = 'train'").select("rec_no", "source_sha256"), "rec_no", "source_sha256")
    return made.select("rec_no", "id", "split")


def _stitched(events: DataFrame) -> DataFrame:
    """Window maxima, which tell from which window a sample was taken."""
    top = F.transform("y", lambda v: F.array_max("y"))
    return library.stitched(_samples(events), 16, 4, top).select("key", F.col("i").cast("bigint").alias("i"), "y")


_STITCHED = f"""
    WITH {_SAMPLES}, w AS (SELECT key, i, x, unnest(range(CAST(greatest(floor((i - 16) / 12) + 1, 0) AS BIGINT), CAST(floor(i / 12) + 1 AS BIGINT))) AS w FROM sa),
    m AS (SELECT *, max(x) OVER (PARTITION BY key, w) AS y FROM w)
    SELECT key, CAST(i AS BIGINT) AS i, arg_max(y, w) AS y FROM m WHERE i >= CASE WHEN w > 0 THEN w * 12 + 2 ELSE 0 END GROUP BY key, i"""


def queries() -> dict[str, Query]:
    return {"library_append": on("songs", _append_newest), "merge_titles": _merge, "training_reference": _reference, "stitched_windows": on("events", _stitched)}


def oracle_sql() -> dict[str, str]:
    return {"library_append": _APPEND_NEWEST, "merge_titles": _MERGE, "training_reference": "SELECT rec_no, id, split FROM songs WHERE split = 'train'", "stitched_windows": _STITCHED}
