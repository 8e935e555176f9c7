"""Queries on names, titles and the web dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunewright.functions import music, web
from tunewright.operators import titles
from tunewright.plans.corpus import Query, on
from tunewright.plans.melodies import EV


def _web(manifest: DataFrame) -> DataFrame:
    made = manifest.where("kind = 'rtttl'").select("rec_no", web.parsed(F.col("raw")).alias("p"))
    return made.select("rec_no", "p.error", "p.name", F.col("p.bpm").cast("bigint").alias("bpm"), F.size("p.events").cast("bigint").alias("events"), "p.seconds")


def _web_roundtrip(songs: DataFrame) -> DataFrame:
    """Canonical text of every song read by the web dialect; seconds and events agree with the song's."""
    text = F.concat(F.lit("Tune:"), music.encoded(F.col("bpm"), F.col("events")))
    made = songs.select("rec_no", "events", web.parsed(text).alias("p"))
    return made.select("rec_no", F.col("p.error").alias("error"), (F.col("p.events") == F.col("events")).alias("same"), F.col("p.seconds").alias("seconds"))


def _titles(songs: DataFrame) -> DataFrame:
    return songs.select("rec_no", titles.sanitized(F.col("name")).alias("t"), titles.ascii_name(F.col("name")).alias("header")).select("rec_no", "t.title", "t.reason", "header")


def _named(songs: DataFrame) -> DataFrame:
    return songs.where("name IS NOT NULL").select(F.col("rec_no").alias("id"), F.col("name").alias("title"))


def _repeats(songs: DataFrame) -> DataFrame:
    return titles.near_repeats(_named(songs))


_REPEATS = r"""
    WITH w AS (SELECT rec_no AS id, list_filter(regexp_extract_all(lower(name), '\p{L}+'), lambda x: x NOT IN ('a','an','the','of','and','in','on','at','by','to','for')) AS ws FROM songs WHERE name IS NOT NULL),
    d AS (SELECT id, len(ws) AS n, unnest(list_distinct(ws)) AS t FROM w), k AS (
      SELECT id, '=' || array_to_string(ws, ' ') AS key FROM w WHERE len(ws) > 0
      UNION SELECT a.id, a.t || ' ' || b.t FROM d a JOIN d b ON a.id = b.id AND a.t < b.t),
    f AS (SELECT key, min(id) AS earlier FROM k GROUP BY key)
    SELECT id, min(earlier) AS earlier FROM k JOIN f USING (key) WHERE earlier < id GROUP BY id"""


def _avoid(songs: DataFrame) -> DataFrame:
    return titles.words_to_avoid(_named(songs))


def _numbered(songs: DataFrame) -> DataFrame:
    return titles.numbered(songs.where("name IS NOT NULL").select(F.col("rec_no").alias("id"), "name"))


def _tonics(songs: DataFrame) -> DataFrame:
    """Every word of every name read as a note name."""
    words = songs.select(F.explode(F.split("name", " ")).alias("written")).distinct()
    return words.select("written", titles.tonic(F.col("written")).alias("tonic"))


_AVOID = f"""
    WITH r AS (SELECT rec_no, name FROM songs WHERE name IS NOT NULL ORDER BY rec_no DESC LIMIT 10),
    c AS (SELECT rec_no, list_filter(string_split_regex(regexp_replace(name, '[^A-Za-z0-9 ]', ' ', 'g'), '\\s+'), lambda x: x <> '')[1:4] AS w FROM r),
    u AS (SELECT DISTINCT rec_no, unnest(string_split(lower(trim(substr(array_to_string(w, ' '), 1, 32))), ' ')) AS word FROM c),
    n AS (SELECT word, count(*) AS n FROM u WHERE regexp_matches(word, '^[a-z]{{3,}}$') AND word NOT IN ({", ".join(f"'{w}'" for w in titles.STOP_WORDS)}) GROUP BY word HAVING count(*) >= 2)
    SELECT rank, word, n FROM (SELECT row_number() OVER (ORDER BY n DESC, word) AS rank, word, n FROM n) WHERE rank <= 8"""


_TONICS = """
    WITH c AS (SELECT DISTINCT unnest(string_split(name, ' ')) AS written FROM songs), t AS (SELECT written, trim(replace(replace(written, '♯', '#'), '♭', 'b')) AS t FROM c),
    n AS (SELECT written, CASE upper(substr(t, 1, 1)) WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 WHEN 'B' THEN 11 END + CASE substr(t, 2) WHEN '' THEN 0 WHEN '#' THEN 1 WHEN 'b' THEN -1 END AS k FROM t)
    SELECT written, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][((k % 12) + 12) % 12 + 1] AS tonic FROM n"""


def queries() -> dict[str, Query]:
    return {
        "web_dialect": on("manifest", _web),
        "web_roundtrip": on("songs", _web_roundtrip),
        "title_sanitizer": on("songs", _titles),
        "title_repeats": on("songs", _repeats),
        "avoid_words": on("songs", _avoid),
        "numbered_names": on("songs", _numbered),
        "tonic_names": on("songs", _tonics),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "web_roundtrip": f"WITH {EV} SELECT rec_no, CAST(NULL AS VARCHAR) AS error, true AS same, sum(beats * 60.0 / bpm) AS seconds FROM ev GROUP BY rec_no",
        "title_repeats": _REPEATS,
        "avoid_words": _AVOID,
        "numbered_names": "SELECT rec_no AS id, name, row_number() OVER (PARTITION BY lower(name) ORDER BY rec_no) AS place FROM songs WHERE name IS NOT NULL",
        "tonic_names": _TONICS,
    }
