"""Rows that parse and rows that don't: every raw record gets a status, and a reason if it is rejected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.functions.parse import events_array, parse

SCHEMA = (
    "status string, error string, detail string, warnings array<string>, event_count int, name string, bpm int, "
    "events array<struct<pitch:int,duration:int,dotted:boolean>>, default_duration int, default_octave int"
)


def underscore_is_sharp(source: Column) -> Column:
    """The folder convention: below a folder (or in a file) named rtttl3 `_` stands for `#`."""
    return F.coalesce(F.rlike(source, F.lit(r"(?:^|/)rtttl3(?:/|$)")), F.lit(False))


def audited(rows: DataFrame, *keep: str, with_songs: bool = True) -> DataFrame:
    """The columns `keep` of rows(kind, source, raw, ..) and what the parser says of each row.

    Rows of kind empty or unsupported are rejected without a look at raw, with the code of their kind; a null kind is
    taken for rtttl. A null raw is an empty record. If rows has the reader's own warnings (reader_warnings), they come
    first in the warnings of accepted rows and alone stand with rejected ones. with_songs=False leaves the song's
    columns (from event_count on) null, for callers that want only the verdict.
    """
    has_own = "reader_warnings" in rows.columns
    kinds = F.coalesce(F.col("kind"), F.lit("rtttl"))
    used = [F.col(c) for c in keep] + [kinds.alias("_kind"), F.col("raw").alias("_raw"), underscore_is_sharp(F.col("source")).alias("_sharp")]
    if has_own:
        used.append(F.col("reader_warnings").alias("_own"))
    prefix = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    other = {"empty": "empty_file", "unsupported": "unsupported_file_format"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column("_kind").to_pylist()
            p = parse(batch.column("_raw").to_pylist(), batch.column("_sharp").to_numpy(zero_copy_only=False))
            own = batch.column("_own").to_pylist() if has_own else [None] * len(kind)
            foreign = np.array([k != "rtttl" for k in kind])
            for i in np.flatnonzero(foreign):
                p.error[i] = p.detail[i] = other.get(kind[i], "unsupported_file_format")
            p.ok &= ~foreign
            said = [list(dict.fromkeys([*(o or []), *(w if ok else [])])) for o, w, ok in zip(own, p.warnings, p.ok, strict=True)]
            status = ["rejected" if not ok else "accepted_with_normalization" if w else "accepted" for ok, w in zip(p.ok, said, strict=True)]
            columns = [pa.array(status), pa.array(p.error, pa.string()), pa.array(p.detail, pa.string()), pa.array(said, pa.list_(pa.string()))]
            if with_songs:
                bad = ~p.ok
                number = lambda x: pa.array(x.astype(np.int32), mask=bad)  # noqa: B023, E731
                events = events_array(p) if p.ok.any() else pa.nulls(len(kind), events_array(p).type)
                columns += [number(np.diff(p.offsets)), pa.array([x if ok else None for x, ok in zip(p.name, p.ok, strict=True)], pa.string()), number(p.values[:, 2]), events, number(p.values[:, 0]), number(p.values[:, 1])]
            names = [x.split(" ")[0] for x in SCHEMA.replace("array<struct<pitch:int,duration:int,dotted:boolean>>", "e").split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, names=[*keep, *names[: len(columns)]])

    schema = SCHEMA if with_songs else "status string, error string, detail string, warnings array<string>"
    return rows.select(*used).mapInArrow(run, f"{prefix}, {schema}")


def pending(manifest: DataFrame) -> DataFrame:
    """Rows that are not audited yet, with the reader's warnings that can be told from the row itself."""
    return manifest.where(F.col("status").isNull())


def rejects(manifest: DataFrame) -> DataFrame:
    """rec_no, error, detail of the rows not yet audited that the parser rejects, of any kind."""
    return audited(pending(manifest), "rec_no", with_songs=False).where("status = 'rejected'").select("rec_no", "error", "detail")


def newly_accepted(manifest: DataFrame) -> DataFrame:
    """The rows not yet audited that parse, as songs."""
    keep = ("rec_no", "id", "source", "line", "source_sha256", "batch_no", "received_at")
    made = audited(pending(manifest), *keep).where("status <> 'rejected'")
    return made.select("rec_no", "id", "source", "line", "source_sha256", "name", "bpm", "events", "default_duration", "default_octave", "warnings", "batch_no", "received_at")
