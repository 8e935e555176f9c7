"""What the operators on songs share: distinct melodies, closeness, and its check."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.functions.events import DURATIONS, FIRST_CHAR, MAX_PITCH, MIN_PITCH


def allowed(n: Column) -> Column:
    """Single-event changes allowed between two melodies of which the longer has n events: a tenth."""
    return F.floor(n / 10).cast("int")


def close_bpm(a: Column, b: Column) -> Column:
    """The difference is at most a tenth of the larger."""
    return F.abs(a - b) * 10 <= F.greatest(a, b)


def close_events(a: str, b: str, na: str, nb: str) -> Column:
    """Edit distance of the melody columns a and b within allowed(); the distance is cut off at that bound."""
    k = f"cast(floor(greatest({na}, {nb}) / 10) AS int)"
    return F.expr(f"abs({na} - {nb}) <= {k} AND levenshtein({a}, {b}, {k}) >= 0")


def _codes(events: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Event codes of all songs in a row, offsets of each song, and which songs can be compared."""
    off = events.offsets.to_numpy().astype(np.int64)
    flat = events.values.slice(off[0], off[-1] - off[0])
    off = off - off[0]
    pitch, duration, dotted = (flat.field(x) for x in ("pitch", "duration", "dotted"))
    rest = pitch.is_null().to_numpy(zero_copy_only=False)
    p = pc.fill_null(pitch, MIN_PITCH - 1).to_numpy()
    d = pc.fill_null(duration, 0).to_numpy()
    exponent = np.full(64, -1)
    exponent[list(DURATIONS)] = np.arange(len(DURATIONS))
    x = exponent[np.where((d >= 0) & (d < 64), d, 0)]
    legal = (x >= 0) & (rest | (p >= MIN_PITCH) & (p <= MAX_PITCH)) & flat.is_valid().to_numpy(zero_copy_only=False)
    code = np.where(legal, ((p - (MIN_PITCH - 1)) * len(DURATIONS) + x) * 2 + pc.fill_null(dotted, False).to_numpy(zero_copy_only=False), 0)
    wrong = np.concatenate([[0], np.cumsum(~legal)])
    ok = (np.diff(off) > 0) & (wrong[off[1:]] == wrong[off[:-1]]) & events.is_valid().to_numpy(zero_copy_only=False)
    return code.astype(np.int32), off, ok


def spelled(code: np.ndarray, off: np.ndarray) -> pa.Array:
    """The melody strings of the codes: every character takes two bytes of UTF-8."""
    c = code + FIRST_CHAR
    raw = np.empty(2 * len(c), np.uint8)
    raw[0::2], raw[1::2] = 0xC0 | c >> 6, 0x80 | c & 0x3F
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer((2 * off).astype(np.int32)), pa.py_buffer(raw))


def with_codes(songs: DataFrame, columns: list[str], made: str, make: Callable[[np.ndarray, np.ndarray], list[pa.Array]]) -> DataFrame:
    """The columns of the songs that can be compared, and those that make() derives from their event codes.

    Songs without events, with a null event or with one outside the model's domain (pitch 60..107 or rest; lengths 1,
    2, 4, .. 32) can't be compared and are left out. A null dot is no dot.
    """
    schema = ", ".join(f"`{c}` {songs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, off, ok = _codes(batch.column("events"))
                if not ok.all():
                    keep = np.repeat(ok, np.diff(off))
                    code, off = code[keep], np.concatenate([[0], np.cumsum(np.diff(off)[ok])])
                    batch = batch.filter(pa.array(ok))
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + make(code, off), names=[*columns, *re.findall(r"(\w+) \w+", made)])

    return songs.select(*columns, "events").mapInArrow(run, f"{schema}, {made}")


def members(songs: DataFrame, *columns: str) -> DataFrame:
    """rec_no, the given columns and mel of the songs that with_codes() keeps. A song without rec_no can't be named and is left out."""
    return with_codes(songs.where("rec_no IS NOT NULL"), ["rec_no", *columns], "mel string", lambda code, off: [spelled(code, off)])
