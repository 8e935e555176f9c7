"""Splits that keep songs of one source and songs with one melody together.

Groups are connected components over sources: two sources are linked if a melody, free of key and tempo, stands in both.
Only sources are nodes and only melodies in several sources make edges, so the graph is far smaller than the songs.
Components are found by alternating large-star and small-star steps, each an aggregate and a join, written to the
shared folder between rounds.

Balance is largest differencing: the weights of the groups are put into many equal bins by repeatedly combining the two
partial solutions with the most extreme spread, first within chunks of groups, then among the chunks' bins; whole bins
then go to the splits by target share.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunewright.functions.events import DURATIONS
from tunewright.llm.melodies import with_codes
from tunewright.operators.graph import components
from tunewright.shared import materialize

#: Bins that the groups are balanced into, groups to a chunk, and chunks whose bins are combined in one task.
BINS, CHUNK, FAN_IN = 200, 20_000, 50


def _normal_hashes(code: np.ndarray, off: np.ndarray) -> list[pa.Array]:
    """128-bit hash of each melody with pitches relative to the first sounded one and lengths over their common divisor."""
    steps, dotted = code // (2 * len(DURATIONS)), code % 2
    length = 128 // np.array(DURATIONS)[code // 2 % len(DURATIONS)] * (2 + dotted) // 2
    n = np.diff(off)
    sounded = np.where(steps > 0, np.arange(len(code)), len(code))
    first = np.minimum.reduceat(sounded, off[:-1])
    base = np.where(first < off[1:], steps[np.minimum(first, len(code) - 1)], 0)
    unit = np.gcd.reduceat(length, off[:-1])
    value = np.where(steps > 0, steps - np.repeat(base, n) + 64, 0) * 256 + length // np.repeat(unit, n)
    out = []
    for seed in (11, 12):
        table = np.random.default_rng(seed).integers(1, 2**63, (1 << 15), dtype=np.uint64)
        # the place goes into each term, the terms are summed: position-dependent and free of a loop over events
        place = (np.arange(len(code)) - np.repeat(off[:-1], n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
        x = table[value] ^ place
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
        total = np.add.reduceat(x ^ x >> np.uint64(31), off[:-1]) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out.append(pa.array(total.view(np.int64)))
    return out


def grouped(songs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Songs (rec_no, place) with their source's key, and sources: place, node (smallest rec_no of the source), group_no
    (smallest rec_no of the group), sources (how many the group has).

    A song without rec_no is left out. A song without source counts as a source of its own. A song that with_codes() leaves out has no melody and belongs
    to its source's group only.
    """
    songs = songs.where("rec_no IS NOT NULL")
    place = F.coalesce(F.concat(F.lit("s"), "source"), F.concat(F.lit("r"), F.col("rec_no").cast("string"))).alias("place")
    all_rows = songs.select("rec_no", place)
    heads = materialize(all_rows.groupBy("place").agg(F.min("rec_no").alias("node")), "p5_heads")
    # one row per melody and source, before any join
    hashed = with_codes(songs.select("rec_no", place, "events"), ["place"], "ha bigint, hb bigint", _normal_hashes).distinct()
    placed = materialize(hashed.join(heads, "place").select("ha", "hb", "node"), "p5_melodies")
    least = placed.groupBy("ha", "hb").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("ha", "hb", "least")
    edges = placed.join(least, ["ha", "hb"]).select(F.col("node").alias("a"), F.col("least").alias("b"))
    linked = components(edges)
    labelled = heads.join(linked, "node", "left").select("place", "node", F.coalesce("label", "node").alias("group_no"))
    labelled = materialize(labelled, "p5_labels")
    sizes = labelled.groupBy("group_no").agg(F.count(F.lit(1)).alias("sources"))
    return all_rows, labelled.join(sizes, "group_no")


def linked_groups(songs: DataFrame) -> DataFrame:
    """rec_no, group_no of the songs whose group has two sources or more."""
    rows, places = grouped(songs)
    return rows.join(places.where("sources > 1").select("place", "group_no"), "place").select("rec_no", "group_no")


def differencing(weights: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each weight, and the bins' sums: Karmarkar and Karp's differencing into `bins` parts.

    A partial solution is a tuple of bin sums; the two with the greatest spread are combined, the fullest bin of one
    with the emptiest of the other. Of equal spreads the one made first is taken.
    """
    if not len(weights):
        return np.zeros(0, int), np.zeros(bins)
    # the largest weights are combined a whole tuple at a time: bins of one weight each
    order = np.argsort(-weights, kind="stable")
    heap, parts = [], []
    for start in range(0, len(order), bins):
        ids = order[start : start + bins]
        sums = np.zeros(bins)
        sums[: len(ids)] = weights[ids]
        heapq.heappush(heap, (-(sums[0] - sums[-1]), len(parts)))
        parts.append((sums, [[(int(i))] for i in ids] + [[] for _ in range(bins - len(ids))]))
    while len(heap) > 1:
        (_, x), (_, y) = heapq.heappop(heap), heapq.heappop(heap)
        (a, in_a), (b, in_b) = parts[x], parts[y]
        parts[x] = parts[y] = None
        sums, held = a + b[::-1], [p + q for p, q in zip(in_a, reversed(in_b), strict=True)]
        by = np.argsort(-sums, kind="stable")
        sums = sums[by]
        heapq.heappush(heap, (-(sums[0] - sums[-1]), len(parts)))
        parts.append((sums, [held[i] for i in by]))
    sums, held = parts[heap[0][1]]
    out = np.zeros(len(weights), int)
    for b, ids in enumerate(held):
        out[ids] = b
    return out, sums


def _level(items: DataFrame, bins: int) -> DataFrame:
    """item, chunk, weight -> item, chunk, bin, weight: differencing within each chunk."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "item"], ascending=[False, True])
        pdf["bin"], _ = differencing(pdf["weight"].to_numpy(float), bins)
        return pdf[["item", "chunk", "bin", "weight"]]

    return items.groupBy("chunk").applyInPandas(run, "item bigint, chunk bigint, bin bigint, weight bigint")


def bins_of(groups: DataFrame, bins: int = BINS, chunk: int = CHUNK) -> DataFrame:
    """item, bin of groups(item, weight). A chunk holds about `chunk` groups, whatever their number."""
    chunks = max(1, -(-groups.count() // chunk))
    level = materialize(_level(groups.select("item", F.pmod(F.xxhash64("item"), F.lit(chunks)).alias("chunk"), "weight"), bins), "p5_bins")
    where = level.select("item", (F.col("chunk") * bins + F.col("bin")).alias("bin"))
    while chunks > 1:  # the bins of FAN_IN chunks are the items of one chunk of the next level
        items = level.groupBy((F.col("chunk") * bins + F.col("bin")).alias("item"), F.floor(F.col("chunk") / FAN_IN).alias("chunk")).agg(F.sum("weight").alias("weight"))
        chunks = -(-chunks // FAN_IN)
        level = materialize(_level(items, bins), "p5_bins")
        up = level.select(F.col("item").alias("bin"), (F.col("chunk") * bins + F.col("bin")).alias("up"))
        where = where.join(up, "bin").select("item", F.col("up").alias("bin"))
    return where


def allocate(sums: list[tuple[int, int]], targets: list[tuple[str, float]]) -> list[tuple[int, str]]:
    """Split of each bin (bin, weight): the heaviest bin first, each to the split that is farthest below its target."""
    total = sum(w for _, w in sums)
    share = sum(t for _, t in targets) or 1
    have = {s: 0.0 for s, _ in targets}
    want = {s: total * t / share for s, t in targets}
    out = []
    for b, w in sorted(sums, key=lambda x: (-x[1], x[0])):
        s = max(want, key=lambda s: (want[s] - have[s], s))
        have[s] += w
        out.append((b, s))
    return out


def assign(songs: DataFrame, targets: DataFrame, bins: int = BINS) -> DataFrame:
    """rec_no, group_no, split of every song. Only the bins, of which there are `bins`, reach the driver.

    With no target every split is null. A group heavier than a bin fills one alone; a group heavier than a split's
    share makes the shares miss their targets by that much, as it can't be parted.
    """
    spark = songs.sparkSession
    rows, places = grouped(songs)
    placed = materialize(rows.join(places.select("place", "group_no"), "place").select("rec_no", "group_no"), "p5_songs")
    weights = materialize(placed.groupBy(F.col("group_no").alias("item")).agg(F.count(F.lit(1)).alias("weight")), "p5_weights")
    where = materialize(bins_of(weights, bins), "p5_where")
    sums = [(r[0], r[1]) for r in where.join(weights, "item").groupBy("bin").agg(F.sum("weight")).collect()]
    shares = [(r[0], float(r[1])) for r in targets.where("split IS NOT NULL AND target_share > 0").orderBy("split").select("split", "target_share").collect()]
    table = spark.createDataFrame(allocate(sums, shares) if shares else [], "bin bigint, split string")
    named = where.join(F.broadcast(table), "bin", "left").select(F.col("item").alias("group_no"), "split")
    return placed.join(named, "group_no").select("rec_no", "group_no", "split")


def shares(songs: DataFrame, targets: DataFrame) -> DataFrame:
    """split, songs, groups, actual_share, target_share: what assign() gave each target; one row per target."""
    made = assign(songs, targets)
    per = made.groupBy("split", "group_no").agg(F.count(F.lit(1)).alias("n")).groupBy("split").agg(F.sum("n").alias("songs"), F.count(F.lit(1)).alias("groups"))
    total = per.agg(F.sum("songs").alias("total"))  # one row
    wanted = targets.where("split IS NOT NULL").groupBy("split").agg(F.sum("target_share").alias("target_share"))
    both = wanted.join(per, "split", "left").join(F.broadcast(total))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return both.select("split", zero("songs"), zero("groups"), F.coalesce(F.col("songs") / F.col("total"), F.lit(0.0)).alias("actual_share"), "target_share")
