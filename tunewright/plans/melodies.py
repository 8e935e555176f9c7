"""Queries over songs and their events: views, fingerprints, features, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunewright.functions import music
from tunewright.operators import features
from tunewright.plans.corpus import Query, on, table

#: Long form of the songs' events, for the SQL of these queries.
EV = """ev AS (
  SELECT rec_no, bpm, split, i - 1 AS pos, e.pitch AS pitch, e.duration AS duration, coalesce(e.dotted, false) AS dotted,
         CAST(floor(floor(128 / e.duration) * (CASE WHEN e.dotted THEN 3 ELSE 2 END) / 2) AS INT) AS ticks,
         4.0 / e.duration * (CASE WHEN e.dotted THEN 1.5 ELSE 1.0 END) AS beats
  FROM (SELECT rec_no, bpm, split, unnest(events) AS e, generate_subscripts(events, 1) AS i FROM songs)),
so AS (SELECT *, row_number() OVER (PARTITION BY rec_no ORDER BY pos) AS k FROM ev WHERE pitch IS NOT NULL),
iv AS (SELECT * FROM (SELECT rec_no, split, pos, pitch - lag(pitch) OVER (PARTITION BY rec_no ORDER BY pos) AS step FROM so) WHERE step IS NOT NULL)"""


def _melody_event(spark: SparkSession, folder: str) -> DataFrame:
    """The events table read as melodies: users are songs, their rows in time order are events."""
    e = table(spark, folder, "events")
    e.createOrReplaceTempView("_events")
    return spark.sql("""
        SELECT user_id AS song_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos,
               CAST(CASE WHEN event_type <> 'error' THEN 60 + pmod(CAST(floor(value) AS BIGINT), 48) END AS BIGINT) AS pitch,
               CAST(pow(2, pmod(event_id, 6)) AS BIGINT) AS duration, event_id % 5 = 0 AS dotted, 25 + (user_id * 37) % 876 AS bpm
        FROM _events""")


_MELODY_EVENT = """
    SELECT user_id AS song_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
           CAST(CASE WHEN event_type <> 'error' THEN 60 + ((CAST(floor(value) AS BIGINT) % 48) + 48) % 48 END AS BIGINT) AS pitch,
           CAST(1 << CAST(event_id % 6 AS INT) AS BIGINT) AS duration, event_id % 5 = 0 AS dotted, 25 + (user_id * 37) % 876 AS bpm
    FROM events"""


def _fingerprints(songs: DataFrame) -> DataFrame:
    ev = F.col("events")
    return songs.select("rec_no", music.exact_fingerprint(F.col("bpm"), ev).alias("exact"), music.exact_fingerprint(F.col("bpm"), ev, False).alias("tempo_free"), music.normal_form(ev).alias("normal_form"), music.family_fingerprint(ev).alias("family"))


_FINGERPRINTS = f"""
    WITH {EV}, g AS (
      SELECT rec_no, min(bpm) AS bpm, arg_min(pitch, pos) FILTER (WHERE pitch IS NOT NULL) AS first,
             min(ticks & -ticks) * (CASE WHEN bool_and(ticks % 3 = 0) THEN 3 ELSE 1 END) AS unit FROM ev GROUP BY rec_no),
    t AS (
      SELECT ev.rec_no, min(g.bpm) AS bpm,
             '[' || string_agg('[' || coalesce(CAST(pitch AS VARCHAR), 'null') || ',' || duration || ',' || (CASE WHEN dotted THEN 'true' ELSE 'false' END) || ']', ',' ORDER BY pos) || ']' AS j,
             '[' || string_agg('[' || coalesce(CAST(pitch - first AS VARCHAR), 'null') || ',' || CAST(ticks // unit AS VARCHAR) || ']', ',' ORDER BY pos) || ']' AS normal_form
      FROM ev JOIN g USING (rec_no) GROUP BY ev.rec_no)
    SELECT rec_no, sha256('[' || bpm || ',' || j || ']') AS exact, sha256('[null,' || j || ']') AS tempo_free, normal_form, sha256(normal_form) AS family FROM t"""


def _length_summary(songs: DataFrame) -> DataFrame:
    """min, median, mean, linear 90th percentile and maximum of lengths and tempi; nulls where there is nothing."""
    one = lambda kind, c: songs.select(F.lit(kind).alias("kind"), c.cast("double").alias("x"))
    both = one("event_length", F.size("events")).unionByName(one("bpm", F.col("bpm")))
    return both.groupBy("kind").agg(F.min("x").alias("min"), F.expr("percentile(x, 0.5)").alias("median"), F.avg("x").alias("mean"), F.expr("percentile(x, 0.9)").alias("p90"), F.max("x").alias("max"))


_LENGTH_SUMMARY = """
    SELECT kind, min(x) AS min, quantile_cont(x, 0.5) AS median, avg(x) AS mean, quantile_cont(x, 0.9) AS p90, max(x) AS max
    FROM (SELECT 'event_length' AS kind, CAST(len(events) AS DOUBLE) AS x FROM songs UNION ALL SELECT 'bpm', CAST(bpm AS DOUBLE) FROM songs) GROUP BY kind"""


def _song_shape(songs: DataFrame) -> DataFrame:
    ev = F.col("events")
    p, n = music.sounded(ev), F.size("events")
    return songs.select("rec_no", n.cast("bigint").alias("event_length"), ((n - F.size(p)) / F.greatest(n, F.lit(1))).alias("rest_fraction"), (F.size(F.filter("events", lambda e: e["dotted"])) / F.greatest(n, F.lit(1))).alias("dotted_fraction"), F.coalesce(F.array_max(p) - F.array_min(p), F.lit(0)).cast("bigint").alias("note_range"))


_SONG_SHAPE = f"""
    WITH {EV} SELECT rec_no, count(*) AS event_length, count(*) FILTER (WHERE pitch IS NULL) / count(*) AS rest_fraction,
      count(*) FILTER (WHERE dotted) / count(*) AS dotted_fraction, CAST(coalesce(max(pitch) - min(pitch), 0) AS BIGINT) AS note_range FROM ev GROUP BY rec_no"""

_HISTOGRAMS = f"""hist AS (
      SELECT side, kind, value, count(*) AS n FROM (
        SELECT split AS side, 'pitch' AS kind, CAST(pitch AS DOUBLE) AS value FROM ev WHERE pitch IS NOT NULL
        UNION ALL SELECT split, 'interval', step FROM iv UNION ALL SELECT split, 'duration_beats', beats FROM ev
        UNION ALL SELECT split, 'bpm', bpm FROM songs UNION ALL SELECT split, 'event_length', len(events) FROM songs
        UNION ALL SELECT split, 'note_range', r FROM (SELECT rec_no, any_value(split) AS split, coalesce(max(pitch) - min(pitch), 0) AS r FROM ev GROUP BY rec_no))
      GROUP BY side, kind, value)"""

_DISTRIBUTION = f"WITH {EV}, {_HISTOGRAMS} SELECT kind, value, CAST(sum(n) AS BIGINT) AS n FROM hist GROUP BY kind, value"


def _divergence(songs: DataFrame) -> DataFrame:
    side = lambda *s: features.distribution(songs.where(F.col("split").isin(*s)))
    return features.divergence(side("train"), side("val", "test"))


_DIVERGENCE = f"""
    WITH {EV}, {_HISTOGRAMS}, ab AS (
      SELECT kind, value, sum(CASE WHEN side = 'train' THEN n ELSE 0 END) AS a, sum(CASE WHEN side IN ('val', 'test') THEN n ELSE 0 END) AS b
      FROM hist WHERE side IS NOT NULL GROUP BY kind, value),
    pq AS (SELECT kind, a / sum(a) OVER (PARTITION BY kind) AS p, b / sum(b) OVER (PARTITION BY kind) AS q FROM ab)
    SELECT kind, sum((CASE WHEN p > 0 THEN 0.5 * p * log2(2 * p / (p + q)) ELSE 0 END) + (CASE WHEN q > 0 THEN 0.5 * q * log2(2 * q / (p + q)) ELSE 0 END)) AS bits
    FROM pq GROUP BY kind"""

_ENTROPY = f"""
    WITH {EV}, c AS (
      SELECT 'pitch' AS kind, CAST(pitch AS VARCHAR) AS k, count(*) AS n FROM ev WHERE pitch IS NOT NULL GROUP BY k
      UNION ALL SELECT 'event', concat_ws('/', coalesce(CAST(pitch AS VARCHAR), 'r'), duration, dotted) AS k, count(*) FROM ev GROUP BY k)
    SELECT kind, -sum(n / t * log2(n / t)) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY kind) AS t FROM c) GROUP BY kind"""

_REPETITION_CTE = f"""{EV},
    run AS (
      SELECT rec_no, max(a) AS longest_pitch_run, max(b) AS longest_event_run FROM (
        SELECT rec_no, count(*) OVER (PARTITION BY rec_no, ga) AS a, count(*) OVER (PARTITION BY rec_no, gb) AS b FROM (
          SELECT *, sum(CASE WHEN pa THEN 0 ELSE 1 END) OVER w AS ga, sum(CASE WHEN pb THEN 0 ELSE 1 END) OVER w AS gb FROM (
            SELECT rec_no, pos, pos > 0 AND pitch IS NOT DISTINCT FROM lag(pitch) OVER w AS pa,
                   pos > 0 AND pitch IS NOT DISTINCT FROM lag(pitch) OVER w AND duration = lag(duration) OVER w AND dotted = lag(dotted) OVER w AS pb
            FROM ev WINDOW w AS (PARTITION BY rec_no ORDER BY pos)) WINDOW w AS (PARTITION BY rec_no ORDER BY pos))) GROUP BY rec_no),
    lagged AS (
      SELECT rec_no, k AS period, pos, coalesce(pitch, -1) AS p, lag(coalesce(pitch, -1), k) OVER (PARTITION BY rec_no, k ORDER BY pos) AS q,
             count(*) OVER (PARTITION BY rec_no, k) AS n FROM ev, (SELECT unnest(range(2, 17)) AS k)),
    island AS (
      SELECT *, sum(CASE WHEN p = q THEN 0 ELSE 1 END) OVER (PARTITION BY rec_no, period ORDER BY pos) AS g FROM lagged WHERE pos >= period AND n >= 2 * period),
    motif AS (
      SELECT i.rec_no, max((m + i.period) // i.period) AS max_pitch_motif_repeats FROM (
        SELECT rec_no, period, pos, p, q, row_number() OVER (PARTITION BY rec_no, period, g ORDER BY pos) - (CASE WHEN min(p = q) OVER (PARTITION BY rec_no, period, g) THEN 0 ELSE 1 END) AS m FROM island) i
      WHERE p = q AND (m + i.period) // i.period >= 2
        AND EXISTS (SELECT 1 FROM ev e WHERE e.rec_no = i.rec_no AND e.pos > i.pos - i.period AND e.pos <= i.pos AND coalesce(e.pitch, -1) <> i.p)
      GROUP BY i.rec_no),
    four AS (
      SELECT rec_no, count(*) AS n, count(DISTINCT g) AS d FROM (
        SELECT rec_no, concat_ws(',', coalesce(pitch, -1), coalesce(lead(pitch, 1) OVER w, -1), coalesce(lead(pitch, 2) OVER w, -1), coalesce(lead(pitch, 3) OVER w, -1)) AS g, lead(pos, 3) OVER w AS last
        FROM ev WINDOW w AS (PARTITION BY rec_no ORDER BY pos)) WHERE last IS NOT NULL GROUP BY rec_no),
    u AS (SELECT rec_no, count(DISTINCT pitch) AS unique_pitches, count(*) AS n, count(pitch) AS s FROM ev GROUP BY rec_no),
    rep AS (
      SELECT u.rec_no, longest_pitch_run, longest_event_run, unique_pitches, coalesce(max_pitch_motif_repeats, 0) AS max_pitch_motif_repeats,
             coalesce((four.n - four.d) / four.n, 0.0) AS repeated_pitch_ngram_fraction, u.n, u.s
      FROM u JOIN run USING (rec_no) LEFT JOIN motif USING (rec_no) LEFT JOIN four USING (rec_no))"""

_REPETITION = f"WITH {_REPETITION_CTE} SELECT * EXCLUDE (n, s) FROM rep"

_FLAGS = f"""
    WITH {_REPETITION_CTE},
    dom AS (SELECT rec_no, max(c) AS c FROM (SELECT rec_no, count(*) AS c FROM ev GROUP BY rec_no, pitch, duration, dotted) GROUP BY rec_no),
    sm AS (
      SELECT rec_no, max(f) AS f FROM (
        SELECT a.rec_no, k, avg(CASE WHEN a.pitch IS NOT DISTINCT FROM b.pitch AND a.duration = b.duration AND a.dotted = b.dotted THEN 1.0 ELSE 0.0 END) AS f
        FROM ev a CROSS JOIN (SELECT unnest(range(1, 5)) AS k) JOIN ev b ON a.rec_no = b.rec_no AND b.pos = a.pos % k GROUP BY a.rec_no, k) GROUP BY rec_no)
    SELECT rec_no, concat_ws(',', CASE WHEN s = 0 THEN 'all_rests' END, CASE WHEN s >= 8 AND unique_pitches = 1 THEN 'single_pitch' END,
      CASE WHEN n >= 8 AND c / n >= 0.9 THEN 'dominant_event_at_least_90pct' END, CASE WHEN n >= 12 AND f >= 0.9 THEN 'short_repeated_motif' END,
      CASE WHEN longest_pitch_run >= 8 THEN 'local_pitch_run_at_least_8' END, CASE WHEN max_pitch_motif_repeats >= 4 THEN 'repeated_pitch_motif_at_least_4' END) AS flags
    FROM rep JOIN dom USING (rec_no) JOIN sm USING (rec_no)"""

_NAME = "upper(['c','c#','d','d#','e','f','f#','g','g#','a','a#','b'][CAST({0} % 12 AS INT) + 1]) || CAST({0} // 12 - 1 AS VARCHAR)"

_DESCRIPTION = f"""
    WITH {EV}, a AS (
      SELECT rec_no, min(bpm) AS bpm, count(*) AS n, count(pitch) AS k, sum(beats) AS total, sum(beats) FILTER (WHERE pitch IS NOT NULL) AS sb, sum(pitch * beats) AS pb,
             min(pitch) AS lo, max(pitch) AS hi, count(DISTINCT pitch) AS up, arg_min(pitch, pos) FILTER (WHERE pitch IS NOT NULL) AS p0, arg_max(pitch, pos) FILTER (WHERE pitch IS NOT NULL) AS p1,
             count(*) FILTER (WHERE dotted) AS dn, count(*) FILTER (WHERE beats < 1) AS sn, count(*) FILTER (WHERE beats = 1) AS qn, count(*) FILTER (WHERE beats > 1) AS ln FROM ev GROUP BY rec_no),
    b AS (SELECT rec_no, count(*) AS m, count(*) FILTER (WHERE step = 0) AS r, count(*) FILTER (WHERE abs(step) BETWEEN 1 AND 2) AS st, count(*) FILTER (WHERE abs(step) > 2) AS lp,
                 count(*) FILTER (WHERE step > 0) AS up, count(*) FILTER (WHERE step < 0) AS dn FROM iv GROUP BY rec_no)
    SELECT a.rec_no, CASE WHEN bpm < 90 THEN 'slow' WHEN bpm < 140 THEN 'moderate' ELSE 'fast' END AS tempo, n AS event_count, total * 60.0 / bpm AS seconds, (n - k) / n AS rest_fraction,
      (total - coalesce(sb, 0)) / total AS rest_time_fraction, {_NAME.format("lo")} AS pitch_low, {_NAME.format("hi")} AS pitch_high, CAST(floor(pb / sb / 12) - 1 AS BIGINT) AS register_octave,
      a.up AS unique_pitches, CAST(coalesce(hi - lo, 0) AS BIGINT) AS pitch_range_semitones, coalesce(m, 0) AS interval_count, coalesce(r / m, 0.0) AS repeat_fraction, coalesce(st / m, 0.0) AS step_fraction,
      coalesce(lp / m, 0.0) AS leap_fraction, CASE WHEN k = 0 THEN 'no_notes' WHEN coalesce(m, 0) = 0 THEN 'single_note' WHEN b.up + b.dn = 0 THEN 'level' WHEN b.dn = 0 THEN 'rising' WHEN b.up = 0 THEN 'falling' ELSE 'mixed' END AS contour,
      CAST(p1 - p0 AS BIGINT) AS net_semitones, total / n AS mean_event_beats, a.dn / n AS dotted_fraction, sn / n AS short_fraction, qn / n AS quarter_fraction, ln / n AS long_fraction,
      k / (total * 60.0 / bpm) AS notes_per_second
    FROM a LEFT JOIN b USING (rec_no)"""


def _intervals(songs: DataFrame) -> DataFrame:
    steps = songs.select(F.explode(music.successive(music.sounded(F.col("events")))).alias("step"))
    return steps.groupBy(F.col("step").cast("bigint").alias("step")).agg(F.count(F.lit(1)).alias("n"))


def _encoded(songs: DataFrame) -> DataFrame:
    return songs.select("rec_no", music.encoded(F.col("bpm"), F.col("events")).alias("text"))


_ENCODED = f"""
    WITH {EV}, md AS (SELECT rec_no, duration AS d FROM (SELECT rec_no, duration, row_number() OVER (PARTITION BY rec_no ORDER BY count(*) DESC, min(pos)) AS r FROM ev GROUP BY rec_no, duration) WHERE r = 1),
    mo AS (SELECT rec_no, o FROM (SELECT rec_no, pitch // 12 - 1 AS o, row_number() OVER (PARTITION BY rec_no ORDER BY count(*) DESC, min(pos)) AS r FROM ev WHERE pitch IS NOT NULL GROUP BY rec_no, pitch // 12 - 1) WHERE r = 1)
    SELECT ev.rec_no, 'd=' || min(d) || ',o=' || min(coalesce(o, 6)) || ',b=' || min(bpm) || ':' || string_agg(
      (CASE WHEN duration = d THEN '' ELSE CAST(duration AS VARCHAR) END) ||
      (CASE WHEN pitch IS NULL THEN 'p' ELSE ['c','c#','d','d#','e','f','f#','g','g#','a','a#','b'][CAST(pitch % 12 AS INT) + 1] || (CASE WHEN pitch // 12 - 1 = coalesce(o, 6) THEN '' ELSE CAST(pitch // 12 - 1 AS VARCHAR) END) END) ||
      (CASE WHEN dotted THEN '.' ELSE '' END), ',' ORDER BY pos) AS text
    FROM ev JOIN md USING (rec_no) LEFT JOIN mo USING (rec_no) GROUP BY ev.rec_no"""


def _shifts(songs: DataFrame) -> DataFrame:
    ev = F.col("events")
    legal = music.legal_shifts(ev, -5, 6)
    up = music.transposed(ev, F.array_max(legal))
    return songs.select("rec_no", F.array_join(F.transform(legal, lambda x: x.cast("string")), ",").alias("shifts"), F.array_join(F.transform(music.sounded(up), lambda x: x.cast("string")), ",").alias("highest"))


_SHIFTS = f"""
    WITH {EV}, r AS (SELECT rec_no, min(pitch) AS lo, max(pitch) AS hi FROM ev GROUP BY rec_no),
    s AS (SELECT rec_no, lo, hi, k FROM r, (SELECT unnest(range(-5, 7)) AS k) WHERE CASE WHEN lo IS NULL THEN k = 0 ELSE lo + k >= 60 AND hi + k <= 107 END),
    t AS (SELECT rec_no, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS shifts, max(k) AS top FROM s GROUP BY rec_no)
    SELECT r.rec_no, coalesce(shifts, '') AS shifts, (SELECT string_agg(CAST(pitch + top AS VARCHAR), ',' ORDER BY pos) FROM so WHERE so.rec_no = r.rec_no) AS highest FROM r LEFT JOIN t USING (rec_no)"""


def _edited(songs: DataFrame) -> DataFrame:
    """Five edits of the same range, chained: up a third, a rest, notes again, quarter notes, dotted."""
    ev = F.col("events")
    for action, value, a, b in (("transpose", -2, 2, 5), ("rest", None, 4, 7), ("note", None, 5, 6), ("duration", 4, 0, 3), ("dot", 1, 8, 12)):
        songs = songs.withColumn("events", music.edited(ev, a, b, action, value))
    return songs.select("rec_no", F.coalesce(music.json_events(F.col("events")), F.lit("none")).alias("events"))


_EDITED = f"""
    WITH {EV}, a AS (SELECT rec_no, pos, CASE WHEN pos BETWEEN 2 AND 4 THEN pitch - 2 ELSE pitch END AS pitch, duration, dotted FROM ev),
    bad AS (SELECT rec_no FROM a GROUP BY rec_no HAVING min(pitch) < 60 OR count(*) < 12),
    b AS (SELECT rec_no, pos, CASE WHEN pos = 5 THEN 72 WHEN pos IN (4, 6) THEN NULL ELSE pitch END AS pitch, CASE WHEN pos < 3 THEN 4 ELSE duration END AS duration, dotted OR pos BETWEEN 8 AND 11 AS dotted FROM a)
    SELECT rec_no, CASE WHEN rec_no IN (SELECT rec_no FROM bad) THEN 'none' ELSE
      '[' || string_agg('[' || coalesce(CAST(pitch AS VARCHAR), 'null') || ',' || duration || ',' || (CASE WHEN dotted THEN 'true' ELSE 'false' END) || ']', ',' ORDER BY pos) || ']' END AS events
    FROM b GROUP BY rec_no"""


def _cursor(songs: DataFrame) -> DataFrame:
    """Onset in seconds and frequency of every event of a song. Beats are dyadic, so their running sum is exact."""
    parts = F.arrays_zip(F.transform("events", music.beats).alias("beats"), F.transform("events", lambda e: music.frequency(e["pitch"])).alias("hz"))
    long = songs.select("rec_no", "bpm", F.posexplode(parts)).select("rec_no", "bpm", F.col("pos").cast("bigint").alias("pos"), "col.beats", "col.hz")
    w = Window.partitionBy("rec_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return long.select("rec_no", "pos", (F.coalesce(F.sum("beats").over(w), F.lit(0.0)) * 60.0 / F.col("bpm")).alias("onset"), "hz")


_CURSOR = f"""
    WITH {EV} SELECT rec_no, pos, coalesce(sum(beats) OVER (PARTITION BY rec_no ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) * 60.0 / bpm AS onset,
      440.0 * pow(2.0, (pitch - 69) / 12.0) AS hz FROM ev"""


def _flags(songs: DataFrame) -> DataFrame:
    return features.flags(songs).select("rec_no", F.array_join("flags", ",").alias("flags"))


def queries() -> dict[str, Query]:
    return {
        "melody_event": _melody_event,
        "fingerprints": on("songs", _fingerprints),
        "length_summary": on("songs", _length_summary),
        "song_shape": on("songs", _song_shape),
        "distribution": on("songs", features.distribution),
        "entropy_bits": on("songs", features.entropies),
        "js_divergence": on("songs", _divergence),
        "repetition_statistics": on("songs", features.repetition),
        "degeneracy_flags": on("songs", _flags),
        "song_description": on("songs", features.description),
        "intervals": on("songs", _intervals),
        "encode_text": on("songs", _encoded),
        "transpose_legal": on("songs", _shifts),
        "edit_selection": on("songs", _edited),
        "time_cursor": on("songs", _cursor),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "melody_event": _MELODY_EVENT,
        "fingerprints": _FINGERPRINTS,
        "length_summary": _LENGTH_SUMMARY,
        "song_shape": _SONG_SHAPE,
        "distribution": _DISTRIBUTION,
        "entropy_bits": _ENTROPY,
        "js_divergence": _DIVERGENCE,
        "repetition_statistics": _REPETITION,
        "degeneracy_flags": _FLAGS,
        "song_description": _DESCRIPTION,
        "intervals": f"WITH {EV} SELECT CAST(step AS BIGINT) AS step, count(*) AS n FROM iv GROUP BY step",
        "encode_text": _ENCODED,
        "transpose_legal": _SHIFTS,
        "edit_selection": _EDITED,
        "time_cursor": _CURSOR,
    }
