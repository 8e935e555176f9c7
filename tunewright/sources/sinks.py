"""Writers: JSON lines, batches of generated songs, checksums, audio."""

from __future__ import annotations

import hashlib
import html
import io
import json
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the audition tone: amplitude, sounded share of a note, ramp in seconds.
AMPLITUDE, GATE, RAMP = 0.18, 0.92, 0.008
#: Bytes of audio after which a batch is handed on.
WAV_BYTES = 4 << 20


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; refuses a path that exists."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def read_json(spark, path: str, schema: str) -> DataFrame:
    """JSON lines under a fixed schema; blank lines are skipped, a line that isn't JSON ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_batch(records: DataFrame, path: str) -> dict:
    """All attempts as JSON lines, the valid ones as text, and their counts."""
    write_json(records, f"{path}/attempts")
    records.where("valid").select("rtttl").write.mode("errorifexists").text(f"{path}/songs")
    row = records.agg(F.count(F.lit(1)).alias("attempts"), F.coalesce(F.sum(F.col("valid").cast("bigint")), F.lit(0)).alias("valid")).first()
    return row.asDict()


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows of flat columns as CSV with a header; refuses a path that exists."""
    rows.write.mode("errorifexists").option("header", True).csv(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """More rows of metrics behind those in path, which is made if it isn't there; columns must be those of the rows there."""
    spark = rows.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        there = spark.read.option("header", True).csv(path).columns
        if there != rows.columns:
            raise ValueError(f"columns {rows.columns} behind {there}")
    rows.write.mode("append").option("header", True).csv(path)


def read_config(spark, path: str) -> dict:
    """Settings of a YAML or JSON file, read on the driver; YAML needs PyYAML."""
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError as e:
        raise ValueError("PyYAML isn't installed; write the settings as JSON") from e
    return yaml.safe_load(text) or {}


def checksums(files: DataFrame) -> DataFrame:
    """source, sha256 of files(source, content, directory)."""
    return files.where("NOT directory").select("source", F.sha2("content", 256).alias("sha256"))


def verify(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """source, problem (missing, unexpected, changed) of the files that don't match."""
    a, e = actual.select("source", F.col("sha256").alias("is")), expected.select("source", F.col("sha256").alias("want"))
    both = a.join(e, "source", "full")
    return both.select("source", F.when(F.col("is").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("is") != F.col("want"), "changed").alias("problem")).where("problem IS NOT NULL")


def dataset_fingerprint(df: DataFrame) -> str:
    """SHA-256 that depends on the rows and not on their order: sums of two 64-bit row hashes, and the count."""
    cols = [F.to_json(F.struct(*df.columns))]
    n, a, b = df.select(F.xxhash64(*cols).cast("decimal(38,0)").alias("a"), F.xxhash64(F.lit(1), *cols).cast("decimal(38,0)").alias("b")).agg(F.count(F.lit(1)), F.sum("a"), F.sum("b")).first()
    return hashlib.sha256(f"{n}:{a}:{b}".encode()).hexdigest()


def tone(bpm: int, events: list[tuple[int | None, int, bool]], rate: int) -> bytes:
    """Mono 16-bit WAV of one melody: one oscillator, note by note, each faded in and out over its first and last samples."""
    length = np.array([240 / bpm / d * (1.5 if dot else 1) for _, d, dot in events])
    size = np.maximum(np.rint(length * rate).astype(int), 1)
    held = np.maximum(np.rint(size * GATE).astype(int), 1)
    edge = np.minimum(round(rate * RAMP), held // 2)
    if not edge.any():  # too few samples a second to fade, or to end a note before the next
        held = size
    start = np.cumsum(size) - size
    hertz = 440 * 2 ** ((np.array([np.nan if p is None else p for p, _, _ in events], float) - 69) / 12)
    sound = np.zeros(size.sum(), "<i2")
    for f, at, n, e in zip(hertz.tolist(), start.tolist(), held.tolist(), edge.tolist(), strict=True):
        if f == f:
            sound[at : at + n] = _note(f, n, e, rate)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, rate, len(sound), "NONE", "not compressed"))
        w.writeframes(sound.tobytes())
    return out.getvalue()


@lru_cache(maxsize=1024)
def _note(hertz: float, n: int, edge: int, rate: int) -> np.ndarray:
    """n samples of a note that fades over `edge` samples at its ends. Melodies repeat their notes, so those used last are kept."""
    place = np.arange(n)
    loud = np.clip(np.minimum(place, n - 1 - place) / max(edge - 1, 1), 0, 1) if edge else np.ones(n)
    sound = AMPLITUDE * loud * np.sin(2 * np.pi * hertz * place / rate)
    return (np.clip(sound, -1, 1) * 32767).astype("<i2")


def rendered(songs: DataFrame, key: str = "rec_no", rate: int = 22050, max_seconds: float = 300.0) -> DataFrame:
    """key, wav, seconds of every song; a song longer than max_seconds or without events has a null wav. Whatever a batch of
    songs holds, no more than WAV_BYTES and one song's audio is in memory."""
    kind = songs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, wavs, secs, done, held = batch.column(key), [], [], 0, 0
            for i, (bpm, events) in enumerate(zip(batch.column("bpm").to_pylist(), batch.column("events").to_pylist(), strict=True)):
                notes = [(e["pitch"], e["duration"], bool(e["dotted"])) for e in events or []]
                s = sum(240 / bpm / d * (1.5 if dot else 1) for _, d, dot in notes) if bpm else 0.0
                secs.append(s)
                wavs.append(tone(bpm, notes, rate) if notes and 0 < s <= max_seconds else None)
                held += len(wavs[-1] or b"")
                if held >= WAV_BYTES or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([keys.slice(done, len(secs)), pa.array(wavs, pa.binary()), pa.array(secs, pa.float64())], names=[key, "wav", "seconds"])
                    wavs, secs, done, held = [], [], i + 1, 0

    return songs.select(key, "bpm", "events").mapInArrow(run, f"{key} {kind}, wav binary, seconds double")


def listening_page(rows: list[dict], title: str = "Listening batch") -> str:
    """A page for a handful of songs (title, rtttl, file of each), all text escaped."""
    items = "\n".join(f'<li><b>{html.escape(r["title"])}</b> <audio controls src="{html.escape(r["file"])}"></audio><pre>{html.escape(r["rtttl"])}</pre></li>' for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><ol>\n{items}\n</ol><script type=application/json>{json.dumps([r['file'] for r in rows])}</script>"
