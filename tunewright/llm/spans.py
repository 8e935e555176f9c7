"""Long exact spans that songs share, with a count-min prefilter.

Two melodies share a span of at least `length` events exactly if they share a window of that length. The windows' hashes
are cut into slices by their highest bits, and every slice has a count-min sketch of its own, of a fixed size, so the
number of cells follows the number of windows and no task, nor the driver, ever holds more than one slice's. Every
partition sends each slice what it adds to the sketch: 32 bits of a window's hash, from which its cells follow, once or
twice and never the window itself. The slice adds these partial counts up and answers each block of melodies which of
its windows may be repeated; a count is never underestimated. A second pass over the melodies ships only those windows
with what belongs to them, and they are grouped exactly. A window that occurs once is shipped only if all its cells
collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunewright.functions.events import CODES
from tunewright.llm.forest import codes_of
from tunewright.llm.melodies import members
from tunewright.shared import materialize

LENGTH = 24
#: Rows of a sketch; windows to a slice, least number of slices, most cells of a row; windows of which a task sends the counts at once.
ROWS, PER_SLICE, MIN_SLICES, MAX_CELLS, FLUSH = 2, 1 << 20, 16, 1 << 22, 1 << 22


def _tables() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(7)
    return r.integers(1, 2**63, (2, CODES), dtype=np.uint64), r.integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1)


def _windows(code: np.ndarray, off: np.ndarray, length: int, table: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, song index and place of every window of `length` events."""
    n = np.diff(off)
    count = np.maximum(n - length + 1, 0)
    song = np.repeat(np.arange(len(n)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = off[:-1][song] + at
    h = table[code]
    # windows of 1, 2, 4, .. events are put together to one of `length`: log(length) passes instead of length
    acc, have, power, piece, size = None, 0, base, h, 1
    while True:
        if length & size:
            acc, have = (piece.copy(), size) if acc is None else (_joined(piece, acc, size, have, base), have + size)
        if size * 2 > length:
            break
        piece, size = _joined(piece, piece, size, size, base), size * 2
    del power
    return acc[start], song, at


def _joined(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, base: np.uint64) -> np.ndarray:
    """Hash of a's window followed by b's; entries near the end of the array are of no use and never read."""
    out = a * np.uint64(pow(int(base), size_b, 1 << 64))
    out[: len(a) - size_a] += b[size_a:]
    return out


def _keys(h: np.ndarray, mix: np.ndarray, bits: int) -> np.ndarray:
    """The highest 32 + bits bits of the mixed hash: slice, and 32 bits that tell windows of a slice apart."""
    return ((h ^ h >> np.uint64(31)) * mix[0]) >> np.uint64(32 - bits)


def _cells(rest: np.ndarray, mix: np.ndarray, cells: int) -> list[np.ndarray]:
    return [(rest.astype(np.uint64) * m >> np.uint64(65 - int(cells).bit_length())).astype(np.int64) for m in mix[:ROWS]]


def _partial(classes: DataFrame, length: int, bits: int) -> DataFrame:
    """slice, block, rests: what each block of melodies adds to each slice's sketch, a window of several melodies twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, _), mix = _tables()
        held: dict[int, list[np.ndarray]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                keys = np.repeat(keys, np.minimum(n, 2))
                at = np.flatnonzero(np.diff(keys >> np.uint64(32), prepend=np.uint64(2**63)))
                rests = [x.tobytes() for x in np.split(keys.astype(np.uint32), at[1:])]
                yield pa.record_batch([pa.array((keys[at] >> np.uint64(32)).astype(np.int64)), pa.array(np.full(len(at), block), pa.int64()), pa.array(rests, pa.binary())], names=["slice", "block", "rests"])
            held.clear()

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h, song, _ = _windows(*codes_of(batch.column("mel")), length, table, mix[2])
            keys, blocks = _keys(h, mix, bits), batch.column("block").to_numpy()
            order = np.lexsort((keys, song))  # a window counts once a melody
            keys, song = keys[order], song[order]
            first = np.ones(len(keys), bool)
            first[1:] = (keys[1:] != keys[:-1]) | (song[1:] != song[:-1])
            keys, of = keys[first], blocks[song[first]]
            for block in np.unique(of):
                held.setdefault(int(block), []).append(keys[of == block])
            size += len(keys)
            if size >= FLUSH:
                yield from flushed()
                size = 0
        yield from flushed()

    return classes.select("block", "mel").mapInArrow(run, "slice bigint, block bigint, rests binary")


def _answers(partial: DataFrame, cells: int) -> DataFrame:
    """slice, block, rests: of what was added to each slice's sketch, that which its merged counts don't rule out as repeated."""

    def run(batch: pa.Table) -> pa.Table:
        _, mix = _tables()
        rests = [np.frombuffer(x, np.uint32) for x in batch.column("rests").to_pylist()]
        each = _cells(np.concatenate(rests), mix, cells)
        repeated = np.ones(len(each[0]), bool)
        for cell in each:
            repeated &= np.bincount(cell, minlength=cells)[cell] >= 2
        kept = [np.unique(x[k]).tobytes() for x, k in zip(rests, np.split(repeated, np.cumsum([len(x) for x in rests])[:-1]), strict=True)]
        out = pa.table([batch.column("slice"), batch.column("block"), pa.array(kept, pa.binary())], names=["slice", "block", "rests"])
        return out.filter(pa.array([bool(k) for k in kept]))

    return partial.groupBy("slice").applyInArrow(run, "slice bigint, block bigint, rests binary")


def repeated_windows(classes: DataFrame, length: int = LENGTH, max_cells: int = MAX_CELLS) -> DataFrame:
    """ha, hb (the window's 128-bit hash), cid, at, before (code of the event before it, -1 at the start) of every
    window that the sketch doesn't rule out. classes: cid, mel, block (melodies that are asked about together).

    max_cells: most cells of a row of a slice's sketch; with fewer the filter lets more through, and loses none.
    """
    total = classes.select(F.sum(F.greatest(F.length("mel") - (length - 1), F.lit(0)))).first()[0] or 0
    bits = max(-(-total // PER_SLICE), MIN_SLICES).bit_length()
    cells = min(max(1 << int(4 * total >> bits).bit_length(), 1 << 12), max_cells)
    answers = _answers(_partial(classes, length, bits), cells)

    def run(key: tuple, melodies: pa.Table, said: pa.Table) -> pa.Table:
        (ta, tb), mix = _tables()
        keys = [np.uint64(s) << np.uint64(32) | np.frombuffer(x, np.uint32) for s, x in zip(said.column("slice").to_pylist(), said.column("rests").to_pylist(), strict=True)]
        repeated = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
        out = []
        for batch in melodies.combine_chunks().to_batches(max_chunksize=20_000) if len(repeated) else []:
            code, off = codes_of(batch.column("mel"))
            h, song, at = _windows(code, off, length, ta, mix[2])
            keys = _keys(h, mix, bits)
            seen = repeated[np.minimum(np.searchsorted(repeated, keys), len(repeated) - 1)] == keys
            hb, _, _ = _windows(code, off, length, tb, mix[3])
            song, at = song[seen], at[seen]
            before = np.where(at > 0, code[np.maximum(off[:-1][song] + at - 1, 0)], -1)
            cid = batch.column("cid").to_numpy()[song]
            out.append(pa.record_batch([h[seen].view(np.int64), hb[seen].view(np.int64), cid, at.astype(np.int32), before.astype(np.int32)], names=["ha", "hb", "cid", "at", "before"]))
        kinds = pa.schema([("ha", pa.int64()), ("hb", pa.int64()), ("cid", pa.int64()), ("at", pa.int32()), ("before", pa.int32())])
        return pa.Table.from_batches(out, kinds)

    return classes.select("block", "cid", "mel").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "ha bigint, hb bigint, cid bigint, at int, before int")


def _prepared(songs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = materialize(members(songs).where(F.length("mel") >= length), "p4_rows")
    grouped = rows.groupBy("mel").agg(F.min("rec_no").alias("cid"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(grouped.withColumn("block", F.spark_partition_id().cast("bigint")), "p4_classes")  # a block is what one task wrote
    return rows, classes, materialize(repeated_windows(classes, length), "p4_windows")


def _key() -> list:
    """128-bit hash of the melody: what joins songs to classes ships it instead of the melody."""
    return [F.xxhash64("mel").alias("ka"), F.xxhash64(F.lit(1), "mel").alias("kb")]


def _shared(windows: DataFrame) -> DataFrame:
    """ha, hb of the windows that really stand in two melodies or more; branching: the events before them differ, or a melody
    begins there. Written, so that joins with it are between tables and a window of very many melodies is split by AQE."""
    groups = windows.groupBy("ha", "hb").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.min("before").alias("b_lo"), F.max("before").alias("b_hi"))
    return materialize(groups.where(F.col("lo") < F.col("hi")).select("ha", "hb", ((F.col("b_lo") < F.col("b_hi")) | (F.col("b_lo") < 0)).alias("branching")), "p4_shared")


def _starts(windows: DataFrame) -> DataFrame:
    """cid_a < cid_b, at_a, at_b: where a common span of two melodies begins.

    A pair is made only at a window before which the melodies differ or begin, so a span makes one pair, not one per
    window; windows that the same event precedes everywhere are dropped by an aggregate before any join.
    """
    w = materialize(windows.join(_shared(windows).where("branching"), ["ha", "hb"], "left_semi"), "p4_branching")
    side = lambda x: w.select("ha", "hb", F.col("cid").alias(f"cid_{x}"), F.col("at").alias(f"at_{x}"), F.col("before").alias(f"before_{x}"))
    pairs = side("a").join(side("b"), ["ha", "hb"]).where((F.col("cid_a") < F.col("cid_b")) & ((F.col("before_a") != F.col("before_b")) | (F.col("before_a") < 0)))
    return pairs.select("cid_a", "at_a", "cid_b", "at_b").distinct()


def shared_pairs(songs: DataFrame, length: int = LENGTH) -> DataFrame:
    """rec_a < rec_b of every pair of songs that share at least `length` consecutive events.

    Songs that with_codes() leaves out and songs of fewer events share nothing. Copies of one melody are joined only as
    one row; the result then holds every pair of their songs, as TESTDATA.md demands.
    """
    rows, classes, windows = _prepared(songs, length)
    pairs = _starts(windows).select("cid_a", "cid_b").distinct()
    pairs = materialize(pairs.unionByName(classes.where("copies > 1").select(F.col("cid").alias("cid_a"), F.col("cid").alias("cid_b"))), "p4_pairs")
    used = classes.join(pairs.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).distinct(), "cid", "left_semi").select("cid", *_key())
    of = materialize(rows.select("rec_no", *_key()).join(used, ["ka", "kb"]).select("cid", "rec_no"), "p4_songs")
    both = pairs.join(of.select(F.col("cid").alias("cid_a"), F.col("rec_no").alias("a")), "cid_a").join(of.select(F.col("cid").alias("cid_b"), F.col("rec_no").alias("b")), "cid_b")
    return both.where((F.col("cid_a") != F.col("cid_b")) | (F.col("a") < F.col("b"))).select(F.least("a", "b").alias("rec_a"), F.greatest("a", "b").alias("rec_b"))


def shared_spans(songs: DataFrame, length: int = LENGTH) -> DataFrame:
    """rec_a < rec_b, at_a, at_b, span: the maximal runs that two different melodies share, each melody stood for by its
    smallest rec_no. Copies are not expanded; coverage() gives each song's representative."""
    _, classes, windows = _prepared(songs, length)
    side = lambda x: classes.select(F.col("cid").alias(f"cid_{x}"), F.col("mel").alias(f"mel_{x}"))
    both = _starts(windows).join(side("a"), "cid_a").join(side("b"), "cid_b")
    rest = lambda x: F.split(F.substring(F.col(f"mel_{x}"), F.col(f"at_{x}") + 1, F.length(f"mel_{x}")), "")
    # zip_with pads the shorter side with nulls, so the first place that isn't equal ends the run
    differs = F.zip_with(rest("a"), rest("b"), lambda x, y: ~F.coalesce(x == y, F.lit(False)))
    n = F.least(F.length("mel_a") - F.col("at_a"), F.length("mel_b") - F.col("at_b"))
    first = F.array_position(differs, F.lit(True))
    span = F.least(n, F.when(first > 0, first - 1).otherwise(n))
    return both.select(F.col("cid_a").alias("rec_a"), "at_a", F.col("cid_b").alias("rec_b"), "at_b", span.cast("bigint").alias("span"))


def coverage(songs: DataFrame, length: int = LENGTH) -> DataFrame:
    """rec_no, same_as (smallest rec_no with its melody), events, shared, share: how much of each song stands in another one.

    A song of at least `length` events with a copy is covered wholly. Otherwise the windows found in another melody are
    laid over each other; no pairs are made. Shorter songs have share 0; songs that with_codes() leaves out don't appear.
    """
    rows, classes, windows = _prepared(songs, length)
    w = windows.join(_shared(windows).select("ha", "hb"), ["ha", "hb"], "left_semi").select("cid", "at").distinct()
    before = F.lag("at").over(Window.partitionBy("cid").orderBy("at"))
    covered = w.withColumn("new", F.least(F.lit(length), F.coalesce(F.col("at") - before, F.lit(length)))).groupBy("cid").agg(F.sum("new").alias("covered"))
    each = classes.join(covered, "cid", "left").select(*_key(), "cid", F.when(F.col("copies") > 1, F.length("mel")).otherwise(F.coalesce("covered", F.lit(0))).cast("bigint").alias("shared"))
    long = rows.select("rec_no", *_key(), F.length("mel").alias("n")).join(each, ["ka", "kb"]).select("rec_no", F.col("cid").alias("same_as"), F.col("n").cast("bigint").alias("events"), "shared")
    short = members(songs).where(F.length("mel") < length).select("rec_no", F.col("rec_no").alias("same_as"), F.length("mel").cast("bigint").alias("events"), F.lit(0).cast("bigint").alias("shared"))
    return long.unionByName(short).withColumn("share", F.col("shared") / F.col("events"))
