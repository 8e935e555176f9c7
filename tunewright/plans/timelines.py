"""Queries on time, over the events table and over songs laid out in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunewright.functions import music
from tunewright.operators import timeline
from tunewright.plans.corpus import Query, on
from tunewright.plans.melodies import EV

big = lambda c: F.col(c).cast("bigint").alias(c)


def _seconds(events: DataFrame) -> DataFrame:
    """key, t (whole seconds), x of the events table."""
    return events.select(F.col("user_id").alias("key"), "event_id", F.unix_timestamp("ts").alias("t"), F.col("value").alias("x"), "event_type")


def _notes(songs: DataFrame) -> DataFrame:
    """Notes of each song in ticks: key, n (number of the event), start, end, midi."""
    long = songs.select(F.col("rec_no").alias("key"), F.posexplode(F.transform("events", lambda e: F.struct(e["pitch"].alias("midi"), music.ticks(e).alias("ticks")))).alias("n", "e"))
    w = Window.partitionBy("key").orderBy("n")
    placed = long.select("key", "n", "e.midi", "e.ticks").withColumn("end", F.sum("ticks").over(w))
    return placed.select("key", "n", (F.col("end") - F.col("ticks")).cast("double").alias("start"), F.col("end").cast("double").alias("end"), "midi")


NOTES = f"""{EV}, no AS (SELECT rec_no AS key, pos AS n, sum(ticks) OVER w - ticks AS a, sum(ticks) OVER w AS b, pitch AS midi FROM ev WINDOW w AS (PARTITION BY rec_no ORDER BY pos))"""


def _whole_grid(songs: DataFrame) -> DataFrame:
    """The grid over the whole duration of every song."""
    notes = _notes(songs).where("midi IS NOT NULL").withColumn("confidence", F.lit(1.0))
    return timeline.interval_grid(notes, 24.0).select("key", big("step"), big("midi"), "strength")


_WHOLE_GRID = f"""
    WITH {NOTES}, nn AS (SELECT key, a, b, midi, unnest(range(CAST(floor(a / 24) AS BIGINT), CAST(ceil(b / 24) AS BIGINT))) AS step FROM no WHERE midi IS NOT NULL)
    SELECT key, step, CAST(midi AS BIGINT) AS midi, max((least(b, (step + 1) * 24) - greatest(a, step * 24)) / 24.0) AS strength FROM nn GROUP BY key, step, midi"""


def _support(songs: DataFrame) -> DataFrame:
    """Support of each note by the grid of its own song moved by octaves: the best shift."""
    notes = _notes(songs).where("midi IS NOT NULL")
    grid = timeline.interval_grid(notes.withColumn("confidence", F.lit(1.0)), 24.0).select("key", F.col("step").alias("frame"), "midi", "strength")
    spans = notes.select("key", F.col("n").alias("span"), F.floor(F.col("start") / 24).alias("first"), (F.ceil(F.col("end") / 24) - 1).alias("last"), "midi")
    made = timeline.best_shift(timeline.span_support(spans, grid))
    return made.select("key", big("span"), big("shift"), "support")


_SUPPORT = f"""
    WITH {NOTES}, nn AS (SELECT key, n, a, b, midi, CAST(floor(a / 24) AS BIGINT) AS f, CAST(ceil(b / 24) AS BIGINT) - 1 AS l FROM no WHERE midi IS NOT NULL),
    gr AS (SELECT key, step, midi, max((least(b, (step + 1) * 24) - greatest(a, step * 24)) / 24.0) AS s FROM (SELECT *, unnest(range(f, l + 1)) AS step FROM nn) GROUP BY key, step, midi),
    sh AS (SELECT *, unnest([-12, 0, 12]) AS shift FROM nn),
    su AS (SELECT sh.key, n AS span, shift, coalesce(sum(s), 0) / (l - f + 1) AS support FROM sh LEFT JOIN gr ON gr.key = sh.key AND gr.midi = sh.midi + shift AND step BETWEEN f AND l GROUP BY sh.key, n, shift, l, f)
    SELECT key, span, CAST(shift AS BIGINT) AS shift, support FROM (SELECT *, row_number() OVER (PARTITION BY key, span ORDER BY support DESC, abs(shift), shift) AS r FROM su) WHERE r = 1"""


def _autocorrelation(events: DataFrame) -> DataFrame:
    hourly = events.groupBy(F.col("event_type").alias("key"), F.floor(F.unix_timestamp("ts") / 3600).alias("t")).agg(F.count(F.lit(1)).alias("x"))
    return timeline.lag_products(hourly, 48).select("key", big("lag"), "score")


_AUTO = """
    WITH h AS (SELECT event_type AS key, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS t, count(*) AS x FROM events GROUP BY 1, 2)
    SELECT a.key, a.t - b.t AS lag, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM h a JOIN h b ON a.key = b.key AND a.t - b.t BETWEEN 1 AND 48 GROUP BY a.key, a.t - b.t"""


def _tempo(events: DataFrame) -> DataFrame:
    return timeline.best_lag(_autocorrelation(events))


def _islands(events: DataFrame) -> DataFrame:
    return timeline.gap_islands(_seconds(events), "key", "t", 3600 * 6).select("key", big("island"), "first", "last", "n")


_ISLANDS = """
    WITH s AS (SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
    g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t) > 21600 THEN 1 ELSE 0 END AS new FROM s),
    i AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g)
    SELECT key, CAST(island AS BIGINT) AS island, min(t) AS first, max(t) AS last, count(*) AS n FROM i GROUP BY key, island"""


def _runs(events: DataFrame) -> DataFrame:
    """Runs of one event type per user in time order; a purchase always starts a new one."""
    rows = _seconds(events)
    made = timeline.runs(rows, "key", ["t", "event_id"], F.col("event_type"), F.col("event_type") == "purchase")
    return made.groupBy("key", F.col("run").cast("bigint").alias("run")).agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


_RUNS = """
    WITH s AS (SELECT user_id AS key, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, event_type FROM events),
    g AS (SELECT *, CASE WHEN event_type = 'purchase' OR event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM s WINDOW w AS (PARTITION BY key ORDER BY t, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM g)
    SELECT key, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM i GROUP BY key, run"""


def _samples(events: DataFrame) -> DataFrame:
    w = Window.partitionBy("key").orderBy("t", "event_id")
    return _seconds(events).withColumn("i", F.row_number().over(w) - 1).select("key", "i", "x")


_SAMPLES = "sa AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) - 1 AS i, value AS x FROM events)"


def _bins(events: DataFrame) -> DataFrame:
    return timeline.bins(_samples(events), 20).select("key", big("bin"), "low", "high", "peak")


_BINS = f"""
    WITH {_SAMPLES}, z AS (SELECT key, count(*) AS n FROM sa GROUP BY key)
    SELECT key, CAST(i * least(20, n) // n AS BIGINT) AS bin, min(x) AS low, max(x) AS high, max(abs(x)) AS peak FROM sa JOIN z USING (key) GROUP BY key, bin"""


def _silence(events: DataFrame) -> DataFrame:
    return timeline.silence(_samples(events), 2, 4, 0.5, 0.3).select("key", big("step"), "silent")


_SILENCE = f"""
    WITH {_SAMPLES}, r AS (SELECT key, i // 2 AS block, sqrt(avg(x * x)) AS rms FROM sa GROUP BY key, i // 2), p AS (SELECT key, max(rms) AS peak FROM r GROUP BY key)
    SELECT key, CAST(block // 4 AS BIGINT) AS step, avg(CASE WHEN rms <= 0.3 * peak THEN 1.0 ELSE 0.0 END) >= 0.5 AS silent FROM r JOIN p USING (key) GROUP BY key, block // 4"""


def _maxima(events: DataFrame) -> DataFrame:
    return timeline.local_maxima(_samples(events), "key", "i", "x", 20.0).select("key", big("i"), "x")


_MAXIMA = f"""
    WITH {_SAMPLES}, l AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM sa WINDOW w AS (PARTITION BY key ORDER BY i))
    SELECT key, CAST(i AS BIGINT) AS i, x FROM l WHERE x >= 20 AND coalesce(x > a, true) AND coalesce(x >= b, true)"""


def _retention(events: DataFrame) -> DataFrame:
    kept = timeline.last_n(events.select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 64)
    return kept.select("user_id", "event_id", big("rank"))


def _octaves(songs: DataFrame) -> DataFrame:
    path = _notes(songs).select("key", F.col("n").alias("t"), F.col("midi").cast("bigint").alias("midi"))
    return timeline.octave_fit(path, 64, 76).select("key", big("t"), "midi")


_OCTAVES = f"""
    WITH {EV}, c AS (SELECT rec_no, pitch, count(*) AS c FROM ev WHERE pitch IS NOT NULL GROUP BY rec_no, pitch),
    f AS (SELECT rec_no, k * 12 AS move, coalesce(sum(c) FILTER (WHERE pitch + k * 12 BETWEEN 64 AND 76), 0) AS n FROM (SELECT *, unnest(range(-4, 5)) AS k FROM c) GROUP BY rec_no, k),
    b AS (SELECT rec_no, move FROM (SELECT *, row_number() OVER (PARTITION BY rec_no ORDER BY n DESC, abs(move), move) AS r FROM f) WHERE r = 1),
    m AS (SELECT rec_no AS key, pos AS t, pitch + coalesce(move, 0) AS m FROM ev LEFT JOIN b USING (rec_no))
    SELECT key, t, CAST(CASE WHEN m < 64 THEN m + 12 * ceil((64 - m) / 12) WHEN m > 76 THEN m - 12 * ceil((m - 76) / 12) ELSE m END AS BIGINT) AS midi FROM m"""


def queries() -> dict[str, Query]:
    return {
        "interval_grid_join": on("songs", _whole_grid),
        "span_support": on("songs", _support),
        "autocorrelation": on("events", _autocorrelation),
        "tempo_lag": on("events", _tempo),
        "gap_islands": on("events", _islands),
        "rle_runs": on("events", _runs),
        "waveform_bins": on("events", _bins),
        "silence_blocks": on("events", _silence),
        "local_maxima": on("events", _maxima),
        "retention": on("events", _retention),
        "octave_fit": on("songs", _octaves),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "interval_grid_join": _WHOLE_GRID,
        "span_support": _SUPPORT,
        "autocorrelation": _AUTO,
        "tempo_lag": f"SELECT key, lag, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, lag) AS r FROM ({_AUTO})) WHERE r = 1",
        "gap_islands": _ISLANDS,
        "rle_runs": _RUNS,
        "waveform_bins": _BINS,
        "silence_blocks": _SILENCE,
        "local_maxima": _MAXIMA,
        "retention": "SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 64",
        "octave_fit": _OCTAVES,
    }
