"""Queries on sources: inventory, records in text, statistics of the audit, and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunewright.functions import music
from tunewright.operators import audit
from tunewright.plans.corpus import Query, on, table
from tunewright.plans.melodies import EV
from tunewright.sources import files, sinks
from tunewright.streaming import incremental


def _kinds(inv: DataFrame) -> DataFrame:
    """Entries and bytes by kind as classified anew from path and size."""
    again = files.kind(F.col("source"), F.col("size_bytes"), F.endswith(F.col("source"), F.lit("/")))
    return inv.groupBy(F.col("kind").alias("reported"), again.alias("kind")).agg(F.count(F.lit(1)).alias("entries"), F.sum("size_bytes").alias("bytes"))


_KINDS = r"""
    SELECT kind AS reported, CASE WHEN source LIKE '%/' THEN 'directory' WHEN regexp_matches(source, '(^|/)(__MACOSX(/|$)|\._|\.DS_Store$)') THEN 'metadata' WHEN size_bytes = 0 THEN 'empty'
      WHEN lower(regexp_extract(source, '[^/.][^/]*\.([^./]+)$', 1)) IN ('txt', 'rtttl', 'rtl', 'rtx') THEN 'text' ELSE 'unsupported' END AS kind, count(*) AS entries, CAST(sum(size_bytes) AS BIGINT) AS bytes
    FROM source_inventory GROUP BY 1, 2"""


def _metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Records, bytes and hash agreement per kind of source: the lookup of file metadata per record."""
    m, inv = table(spark, folder, "manifest"), table(spark, folder, "source_inventory")
    per = m.groupBy("source", "source_sha256").agg(F.count(F.lit(1)).alias("records"))
    both = per.join(inv, "source", "left").withColumn("same", F.col("sha256") == F.col("source_sha256"))
    return both.groupBy(F.col("kind")).agg(F.count(F.lit(1)).alias("sources"), F.sum("records").alias("records"), F.sum(F.col("same").cast("bigint")).alias("same_hash"))


_METADATA = """
    SELECT i.kind, count(*) AS sources, CAST(sum(records) AS BIGINT) AS records, CAST(sum(CASE WHEN sha256 = source_sha256 THEN 1 WHEN sha256 <> source_sha256 THEN 0 END) AS BIGINT) AS same_hash
    FROM (SELECT source, source_sha256, count(*) AS records FROM manifest GROUP BY 1, 2) m LEFT JOIN source_inventory i USING (source) GROUP BY i.kind"""


def _ids(manifest: DataFrame) -> DataFrame:
    """Identity of every record computed anew from source, line and text."""
    h = F.sha2("raw", 256)
    return manifest.select("rec_no", F.substring(F.sha2(F.concat_ws("\n", "source", F.col("line").cast("string"), h), 256), 1, 20).alias("id"), h.alias("record_sha256"))


def _audit_counts(manifest: DataFrame) -> DataFrame:
    """kind of count, key, n: errors, warnings and encodings of the audited rows, in one scan."""
    one = lambda kind, c: F.when(c.isNotNull(), F.array(F.struct(F.lit(kind).alias("what"), c.alias("key")))).otherwise(F.array().cast("array<struct<what:string,key:string>>"))
    warned = F.when(F.col("status") != "rejected", F.transform("warnings", lambda w: F.struct(F.lit("warning").alias("what"), w.alias("key")))).otherwise(F.array().cast("array<struct<what:string,key:string>>"))
    encoding = F.when(F.col("kind") == "rtttl", F.col("encoding"))
    long = manifest.where("status IS NOT NULL").select(F.inline(F.concat(one("error", F.col("error")), one("status", F.col("status")), one("encoding", encoding), warned)))
    return long.groupBy("what", "key").agg(F.count(F.lit(1)).alias("n"))


_AUDIT_COUNTS = """
    WITH m AS (SELECT * FROM manifest WHERE status IS NOT NULL)
    SELECT what, key, count(*) AS n FROM (
      SELECT 'error' AS what, error AS key FROM m UNION ALL SELECT 'status', status FROM m UNION ALL SELECT 'encoding', encoding FROM m WHERE kind = 'rtttl'
      UNION ALL SELECT 'warning', unnest(warnings) FROM m WHERE status <> 'rejected') WHERE key IS NOT NULL GROUP BY what, key"""


def _inherited(manifest: DataFrame) -> DataFrame:
    """Notes of accepted records that take their length or octave from the settings."""
    notes = F.split(F.lower(F.regexp_replace(F.regexp_replace(F.substring_index("raw", ":", -1), r"\s+", ""), "^,+|,+$", "")), ",")
    tail = lambda t: F.regexp_replace(F.regexp_replace(t, r"^\d+", ""), r"\.", "")
    length = F.size(F.filter(notes, lambda t: ~F.rlike(t, F.lit(r"^\d"))))
    octave = F.size(F.filter(notes, lambda t: ~F.contains(tail(t), F.lit("p")) & ~F.rlike(tail(t), F.lit(r"\d"))))
    return manifest.where("status IN ('accepted', 'accepted_with_normalization')").agg(F.sum(length).alias("durations"), F.sum(octave).alias("octaves"), F.sum(F.size(notes)).alias("notes"))


_INHERITED = r"""
    WITH t AS (SELECT unnest(string_split(lower(trim(regexp_replace(string_split(raw, ':')[-1], '\s+', '', 'g'), ',')), ',')) AS t FROM manifest WHERE status IN ('accepted', 'accepted_with_normalization')),
    u AS (SELECT t, regexp_replace(regexp_replace(t, '^\d+', ''), '\.', '', 'g') AS tail FROM t)
    SELECT count(*) FILTER (WHERE NOT regexp_matches(t, '^\d')) AS durations, count(*) FILTER (WHERE tail NOT LIKE '%p%' AND NOT regexp_matches(tail, '\d')) AS octaves, count(*) AS notes FROM u"""


def _distinct(songs: DataFrame) -> DataFrame:
    """Distinct melodies with and without tempo; rests count as values."""
    keyed = songs.select(music.exact_fingerprint(F.col("bpm"), F.col("events")).alias("a"), music.exact_fingerprint(F.col("bpm"), F.col("events"), False).alias("b"))
    return keyed.agg(F.countDistinct("a").alias("with_tempo"), F.countDistinct("b").alias("without_tempo"), F.count(F.lit(1)).alias("songs"))


def _split_summary(songs: DataFrame) -> DataFrame:
    return songs.groupBy("split").agg(F.count(F.lit(1)).alias("songs"), F.countDistinct(F.xxhash64(music.normal_form(F.col("events")))).alias("families"), F.sum(F.size("events")).alias("events"))


_SPLIT_SUMMARY = f"""
    WITH {EV}, n AS (SELECT rec_no, arg_min(pitch, pos) FILTER (WHERE pitch IS NOT NULL) AS f, min(ticks & -ticks) * (CASE WHEN bool_and(ticks % 3 = 0) THEN 3 ELSE 1 END) AS u FROM ev GROUP BY rec_no),
    k AS (SELECT rec_no, string_agg(coalesce(CAST(pitch - f AS VARCHAR), 'r') || '/' || CAST(ticks // u AS VARCHAR), ',' ORDER BY pos) AS k, count(*) AS c FROM ev JOIN n USING (rec_no) GROUP BY rec_no)
    SELECT split, count(*) AS songs, count(DISTINCT k) AS families, CAST(sum(c) AS BIGINT) AS events FROM k JOIN songs USING (rec_no) GROUP BY split"""


def _codec(songs: DataFrame) -> DataFrame:
    """Songs through JSON and back."""
    cols = ["name", "bpm", "events", "default_duration", "default_octave", "warnings"]
    kind = songs.select(F.struct(*cols).alias("s")).schema["s"].dataType.simpleString()
    back = F.from_json(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), kind)
    made = songs.select("rec_no", back.alias("s"))
    return made.select("rec_no", "s.name", F.col("s.bpm").cast("bigint").alias("bpm"), F.size("s.events").cast("bigint").alias("events"), F.array_join("s.warnings", ",").alias("warnings"))


def _sessionize(documents: DataFrame) -> DataFrame:
    """The lines of the documents as records."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    made = files.sessionized(lines, "doc_id", "line", "text")
    return made.select("doc_id", (F.col("first_line") + 1).cast("bigint").alias("first_line"), F.md5("raw").alias("raw"), "joined")


_SESSIONIZE = """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    b AS (SELECT *, CASE WHEN t LIKE '%:%' OR row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1 THEN 1 ELSE 0 END AS b FROM l WHERE trim(t) <> ''),
    r AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY n) AS r FROM b)
    SELECT doc_id, min(n) AS first_line, md5(string_agg(t, chr(10) ORDER BY n)) AS raw, count(*) > 1 AS joined FROM r GROUP BY doc_id, r"""


def _inventory(spark: SparkSession, folder: str) -> DataFrame:
    """The folder's own files as a tree."""
    return files.inventory(files.read_tree(spark, folder))


def _roundtrip(manifest: DataFrame) -> DataFrame:
    """Accepted songs through their canonical text: parsed again, tempo and events are the same."""
    made = audit.audited(manifest.where("status <> 'rejected'"), "rec_no", "source")
    text = F.concat(F.lit("Generated:"), music.encoded(F.col("bpm"), F.col("events")))
    again = made.select("rec_no", F.lit("plain").alias("source"), F.lit("rtttl").alias("kind"), text.alias("raw"), F.xxhash64("bpm", "events").alias("before"))
    back = audit.audited(again, "rec_no", "before")
    return back.select("rec_no", (F.xxhash64("bpm", "events") == F.col("before")).alias("same"))


def _waves(songs: DataFrame) -> DataFrame:
    return sinks.rendered(songs, rate=8000).select("rec_no", F.length("wav").cast("bigint").alias("bytes"), "seconds")


def _first_seen(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "songs").schema
    rows = incremental.stream(spark, f"{folder}/songs.parquet*", schema)
    return incremental.run_once(incremental.first_seen(rows)).select("rec_no", "fp")


def _windowed(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    rows = incremental.stream(spark, f"{folder}/events.parquet*", schema)
    return incremental.run_once(incremental.windowed_counts(rows), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def _recency(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    rows = incremental.stream(spark, f"{folder}/events.parquet*", schema)
    return incremental.run_once(incremental.recency(rows))


_RECENCY = """
    WITH c AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS last FROM events),
    o AS (SELECT user_id, min(back) AS other FROM c WHERE event_type IS DISTINCT FROM last GROUP BY user_id)
    SELECT user_id, any_value(last) AS event_type, coalesce(any_value(other) - 1, count(*)) AS run FROM c LEFT JOIN o USING (user_id) GROUP BY user_id"""


def queries() -> dict[str, Query]:
    return {
        "source_kinds": on("source_inventory", _kinds),
        "file_metadata": _metadata,
        "record_ids": on("manifest", _ids),
        "audit_counts": on("manifest", _audit_counts),
        "inherited_counts": on("manifest", _inherited),
        "distinct_sequences": on("songs", _distinct),
        "split_summary": on("songs", _split_summary),
        "json_codec": on("songs", _codec),
        "record_sessionize": on("documents", _sessionize),
        "file_inventory": _inventory,
        "parse_roundtrip": on("manifest", _roundtrip),
        "wav_render": on("songs", _waves),
        "stream_first_seen": _first_seen,
        "stream_windowed_counts": _windowed,
        "stream_recency": _recency,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "source_kinds": _KINDS,
        "file_metadata": _METADATA,
        "record_ids": "SELECT rec_no, sha256(raw) AS record_sha256, substr(sha256(source || chr(10) || line || chr(10) || sha256(raw)), 1, 20) AS id FROM manifest",
        "audit_counts": _AUDIT_COUNTS,
        "inherited_counts": _INHERITED,
        "distinct_sequences": f"""WITH {EV}, k AS (SELECT rec_no, min(bpm) AS bpm, string_agg(concat_ws('/', coalesce(CAST(pitch AS VARCHAR), 'r'), duration, dotted), ',' ORDER BY pos) AS k FROM ev GROUP BY rec_no)
            SELECT count(DISTINCT bpm || ':' || k) AS with_tempo, count(DISTINCT k) AS without_tempo, count(*) AS songs FROM k""",
        "split_summary": _SPLIT_SUMMARY,
        "json_codec": "SELECT rec_no, name, CAST(bpm AS BIGINT) AS bpm, CAST(len(events) AS BIGINT) AS events, coalesce(array_to_string(warnings, ','), '') AS warnings FROM songs",
        "record_sessionize": _SESSIONIZE,
        "parse_roundtrip": "SELECT rec_no, true AS same FROM manifest WHERE status <> 'rejected'",
        # the sizes of notes are rounded half to even, as the writer does
        "wav_render": f"""WITH {EV} SELECT rec_no, CAST(CASE WHEN sum(beats * 60.0 / min_bpm) <= 300 THEN 44 + 2 * sum(greatest(1, round_even(beats * 60.0 / min_bpm * 8000, 0))) END AS BIGINT) AS bytes, sum(beats * 60.0 / min_bpm) AS seconds
            FROM (SELECT *, bpm AS min_bpm FROM ev) GROUP BY rec_no""",
        "stream_recency": _RECENCY,
        "stream_windowed_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2",
    }
