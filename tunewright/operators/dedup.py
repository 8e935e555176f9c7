"""Exact and near duplicates of melodies, families, splits by family, and the leakage check."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunewright.functions import music
from tunewright.functions.transitions import shingles, with_transitions
from tunewright.operators.graph import components
from tunewright.shared import block_rows, by_block, materialize

#: Fixed values of the near-duplicate rule.
MIN_TOKENS, MIN_DISTINCT, SHINGLE = 12, 4, 4
LENGTH_RATIO, JACCARD, SIMILAR, CONTAINED, CONTAINED_MIN = 0.65, 0.45, 0.94, 0.98, 24


def exact_duplicates(songs: DataFrame, tempo: bool = True) -> DataFrame:
    """rec_no, retained (smallest rec_no with the same events and, with tempo, bpm), is_copy.

    The smallest number is found by an aggregate with map-side combine; the groups that have copies are written and joined
    back, so that a melody of very many songs is split by AQE. The 128-bit hash of a melody stands for it in the shuffle.
    A song without events or, with tempo, without bpm is a copy of none.
    """
    text = F.concat_ws(":", F.col("bpm").cast("string"), music.json_events(F.col("events"))) if tempo else music.json_events(F.col("events"))
    known = F.col("events").isNotNull() & (F.col("bpm").isNotNull() | F.lit(not tempo))
    keyed = songs.select("rec_no", F.when(known, F.xxhash64(text)).alias("ka"), F.when(known, F.xxhash64(F.lit(1), text)).alias("kb"))
    return _first_of(keyed, "ka", "kb").select("rec_no", "retained", (F.col("rec_no") != F.col("retained")).alias("is_copy"))


def _first_of(keyed: DataFrame, *key: str) -> DataFrame:
    """keyed(rec_no, key) with retained, the smallest rec_no of the key; a null key is one of its own."""
    several = keyed.groupBy(*key).agg(F.min("rec_no").alias("retained"), F.count(F.lit(1)).alias("copies")).where("copies > 1").dropna()
    return keyed.join(materialize(several, "first_of"), list(key), "left").withColumn("retained", F.coalesce("retained", "rec_no"))


#: Songs in a block at most.
BLOCK_ROWS = 1 << 16


def _block() -> Column:
    """Number of a row's block: at most BLOCK_ROWS rows that one task handles, so that what a task holds of a block has a bound
    even where a table is one large row group. Blocks of one number count as one."""
    at = F.monotonically_increasing_id()
    within = F.least(F.shiftright(at.bitwiseAND((1 << 33) - 1), BLOCK_ROWS.bit_length() - 1), F.lit(4095))
    return (F.spark_partition_id() * 4096 + within).cast("int")


def _keyed(songs: DataFrame, *keep: str) -> DataFrame:
    """rec_no, family (32 bytes), tokens, block of the songs with events, as a table."""
    keyed = songs.where(F.size("events") > 0).select("rec_no", "events", F.unhex(music.family_fingerprint(F.col("events"))).alias("family"), *keep)
    return materialize(with_transitions(keyed, "rec_no", "family", *keep).withColumn("block", _block()), "family_songs")


def _members(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """The rows of a table(rec_no, block, ..) that ids(rec_no, block) names, as a table. Only the ids are shuffled."""
    path = by_block(ids.select("rec_no", "block"), f"{name}_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, pa.Array] = (None, None)
        for batch in batches:
            for block in pc.unique(batch.column("block")).to_pylist():
                if held[0] != block:
                    found = block_rows(path, block)
                    held = (block, found.column("rec_no").combine_chunks() if found is not None else pa.array([], pa.int64()))
                yield batch.filter(pc.and_(pc.equal(batch.column("block"), block), pc.is_in(batch.column("rec_no"), value_set=held[1])))

    return materialize(rows.mapInArrow(run, rows.schema), name)


def _first_of_families(keyed: DataFrame) -> DataFrame:
    first = keyed.groupBy("family").agg(F.min(F.struct("rec_no", "block")).alias("m")).select("m.*")
    return _members(keyed.select("rec_no", "family", "tokens", "block"), first, "family_reps")


def representatives(songs: DataFrame) -> DataFrame:
    """One song (the smallest rec_no) per family fingerprint: rec_no, family, tokens, block, grams."""
    return _first_of_families(_keyed(songs)).withColumn("family", F.lower(F.hex("family"))).withColumn("grams", shingles(F.col("tokens"), SHINGLE))


#: Hashes in a slice of the counts, and least number of slices; hashes of which a task sends the counts at once.
PER_SLICE, MIN_SLICES, FLUSH = 1 << 20, 16, 1 << 22


def _hashes(tokens: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Mixed hash and song index of the distinct shingles of every song of a batch, by song."""
    off = tokens.offsets.to_numpy().astype(np.int64)
    flat = tokens.values.to_numpy()[off[0] : off[-1]].astype(np.uint64)
    off = off - off[0]
    count = np.maximum(np.diff(off) - SHINGLE + 1, 0)
    song = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + off[:-1][song]
    h = np.zeros(len(at), np.uint64)
    for i, m in enumerate(np.random.default_rng(11).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
        h = h * m + flat[at + i]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    order = np.lexsort((h, song))
    h, song = h[order], song[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (song[1:] != song[:-1])
    return h[first], song[first]


def _frequencies(able: DataFrame) -> tuple[str, int]:
    """Folder of block, slice, rests, df of the shingles that several melodies share, for the blocks that have them, and the number
    of bits of a slice.

    A shingle stands for itself by the highest 32 + bits bits of its hash: the slice, and 32 bits that are sent there once a block,
    with their number. Hashes that agree so far are counted together: a count is never too small, one is exact.
    """
    total = able.select(F.sum(F.size("tokens") - (SHINGLE - 1))).first()[0] or 0
    bits = max(-(-total // PER_SLICE), MIN_SLICES).bit_length()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                at = np.flatnonzero(np.diff(keys >> np.uint64(32), prepend=np.uint64(2**63)))
                rests = [x.tobytes() for x in np.split(keys.astype(np.uint32), at[1:])]
                counts = [x.tobytes() for x in np.split(np.minimum(n, 65535).astype(np.uint16), at[1:])]
                yield pa.record_batch([pa.array((keys[at] >> np.uint64(32)).astype(np.int64)), pa.array(np.full(len(at), block), pa.int32()), pa.array(rests, pa.binary()), pa.array(counts, pa.binary())], names=["slice", "block", "rests", "df"])
            held.clear()

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h, song = _hashes(batch.column("tokens"))
            keys, of = h >> np.uint64(32 - bits), batch.column("block").to_numpy()[song]
            for block in np.unique(of):
                held.setdefault(int(block), []).append(keys[of == block])
            size += len(keys)
            if size >= FLUSH:
                yield from flushed()
                size = 0
        yield from flushed()

    def several(rows: pa.Table) -> pa.Table:
        rests = [np.frombuffer(x, np.uint32) for x in rows.column("rests").to_pylist()]
        counts = [np.frombuffer(x, np.uint16) for x in rows.column("df").to_pylist()]
        _, at = np.unique(np.concatenate(rests), return_inverse=True)
        df = np.minimum(np.bincount(at, np.concatenate(counts)), 65535).astype(np.uint16)[at]
        each = np.split(df, np.cumsum([len(x) for x in rests])[:-1])
        out = [[x[d > 1].tobytes() for x, d in zip(rests, each, strict=True)], [d[d > 1].tobytes() for d in each]]
        made = pa.table([rows.column("slice"), rows.column("block"), *(pa.array(x, pa.binary()) for x in out)], names=["slice", "block", "rests", "df"])
        return made.filter(pa.array([bool(x) for x in out[0]]))

    schema = "slice bigint, block int, rests binary, df binary"
    return by_block(able.select("block", "tokens").mapInArrow(partial, schema).groupBy("slice").applyInArrow(several, schema), "near_rarity"), bits


def _prefixes(able: DataFrame) -> DataFrame:
    """g, rec_no, n, k, block: of the melodies' shingles in one order, the rarest first, those that must hold one in common with a
    melody of enough likeness, unless it is of one melody only. As a table, so that one of very many melodies is split in a join."""
    path, bits = _frequencies(able)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, np.ndarray, np.ndarray] = (None, np.zeros(0, np.uint64), np.zeros(0, np.uint16))
        for batch in batches:
            for block in pc.unique(batch.column("block")).to_pylist():
                if held[0] != block:
                    found = block_rows(path, block)
                    keys = [np.uint64(s) << np.uint64(32) | np.frombuffer(x, np.uint32) for s, x in zip(found.column("slice").to_pylist(), found.column("rests").to_pylist(), strict=True)] if found else []
                    df = [np.frombuffer(x, np.uint16) for x in found.column("df").to_pylist()] if found else []
                    keys, df = (np.concatenate(keys), np.concatenate(df)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.uint16))
                    order = np.argsort(keys, kind="stable")
                    held = (block, keys[order], df[order])
                _, keys, df = held
                if not len(keys):
                    continue
                part = batch.filter(pc.equal(batch.column("block"), block))
                h, song = _hashes(part.column("tokens"))
                k = np.bincount(song, minlength=part.num_rows)
                own = h >> np.uint64(32 - bits)
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                seen = keys[at] == own
                h, song, often = h[seen], song[seen], df[at[seen]]
                order = np.lexsort((h, often, song))
                h, song = h[order], song[order]
                shared = np.bincount(song, minlength=part.num_rows)
                rank = np.arange(len(h)) - np.repeat(np.cumsum(shared) - shared, shared) + 1
                keep = k - np.ceil(k * JACCARD).astype(int) + 1
                use = rank + (k - shared)[song] <= keep[song]
                h, song = h[use], song[use]
                yield pa.record_batch([pa.array(h.view(np.int64)), part.column("rec_no").take(pa.array(song)), pa.array(np.diff(part.column("tokens").offsets.to_numpy())[song].astype(np.int32)), pa.array(k[song].astype(np.int32)), pa.array(np.full(len(h), block), pa.int32())], names=["g", "rec_no", "n", "k", "block"])

    return materialize(able.select("rec_no", "tokens", "block").mapInArrow(run, "g bigint, rec_no bigint, n int, k int, block int"), "near_prefixes")


def _near(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b, common, jaccard of near_candidates(), and rec_no, family, tokens of the melodies in them, as tables."""
    if "block" not in reps.columns:
        reps = materialize(reps.select("rec_no", "family", "tokens").withColumn("block", _block()), "near_reps")
    able = reps.where((F.size("tokens") >= MIN_TOKENS) & (F.size(F.array_distinct("tokens")) >= MIN_DISTINCT)).select("rec_no", "family", "tokens", "block")
    prefix = _prefixes(able)
    a, b = prefix.alias("a"), prefix.alias("b")
    ratio = F.least("a.n", "b.n") / F.greatest("a.n", "b.n") >= LENGTH_RATIO
    # overlap of at least J / (1 + J) of both sizes is needed for the Jaccard gate
    sizes = F.least("a.k", "b.k") >= JACCARD * F.greatest("a.k", "b.k")
    met = a.join(b, (F.col("a.g") == F.col("b.g")) & (F.col("a.rec_no") < F.col("b.rec_no")) & ratio & sizes)
    pairs = materialize(met.select(F.col("a.rec_no").alias("x"), F.col("a.block").alias("bx"), F.col("b.rec_no").alias("y"), F.col("b.block").alias("by")).distinct(), "near_met")
    ids = pairs.select(F.inline(F.array(F.struct(F.col("x").alias("rec_no"), F.col("bx").alias("block")), F.struct(F.col("y").alias("rec_no"), F.col("by").alias("block"))))).distinct()
    sides = _members(able, ids, "near_sides").drop("block")
    side = lambda x: sides.select(F.col("rec_no").alias(x), F.col("family").alias(f"family_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").withColumn("gx", shingles(F.col("tokens_x"), SHINGLE)).withColumn("gy", shingles(F.col("tokens_y"), SHINGLE))
    both = both.select("x", "y", "family_x", "family_y", F.size(F.array_intersect("gx", "gy")).alias("common"), (F.size("gx") + F.size("gy")).alias("both"))
    both = both.withColumn("jaccard", F.col("common") / (F.col("both") - F.col("common"))).where(F.col("jaccard") >= JACCARD)
    first = F.col("family_x") < F.col("family_y")
    made = both.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"), F.col("common").cast("bigint").alias("common"), "jaccard")
    return materialize(made, "near_pairs"), sides


def near_candidates(reps: DataFrame) -> DataFrame:
    """a, b, common, jaccard of representatives (family of a below that of b) that pass the length and Jaccard gates.

    Lossless prefix filter: with shingles in one global order, two sets with Jaccard >= J share one of their first
    |S| - ceil(J |S|) + 1. The order is rarest first, so a shingle that very many melodies share is never joined on
    unless it is all they have. Melodies stay where they are: of their shingles 32 bits are shuffled to be counted, the counts
    of those that several melodies share come back, and only what is left of the prefixes is joined.
    """
    return _near(reps)[0]


def near_verified(reps: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """verified() of all near_candidates(); only the melodies that are in one are read for it."""
    return verified(*_near(reps), threshold)


def verified(pairs: DataFrame, reps: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """a, b, similarity, containment, length_ratio, jaccard of the candidate pairs whose ordered tokens match.

    Matching blocks depend on the order of the arguments; the later family (b) comes first. Only candidates that passed
    the gates get here.
    """
    side = lambda x: reps.select(F.col("rec_no").alias(x), F.col("tokens").alias(f"tokens_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "jaccard", "tokens_a", "tokens_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            keep = []
            for x, y in zip(batch.column("tokens_b").to_pylist(), batch.column("tokens_a").to_pylist(), strict=True):
                matched = sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
                short, long = sorted((len(x), len(y)))
                out[0].append(2 * matched / (len(x) + len(y)))
                out[1].append(matched / short)
                out[2].append(short / long)
                keep.append(out[0][-1] >= threshold or (short >= CONTAINED_MIN and out[1][-1] >= CONTAINED))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b", "jaccard")] + [pa.array(o, pa.float64()) for o in out], names=["a", "b", "jaccard", "similarity", "containment", "length_ratio"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint, jaccard double, similarity double, containment double, length_ratio double")


def families(songs: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """rec_no, family_id: "family_" and 20 digits of the smallest fingerprint of the song's component.

    Songs of one fingerprint are one node; near edges between representatives join nodes. Songs without events are left out.
    A fingerprint without near edges is its own least, so only those of larger components are joined back.
    """
    return _named(_keyed(songs), threshold).select("rec_no", "family_id")


def _named(keyed: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """_keyed() songs, or groups of them, with family_id."""
    pairs, sides = _near(_first_of_families(keyed))
    linked = materialize(components(verified(pairs, sides, threshold).select("a", "b")), "family_linked")
    named = materialize(sides.select("rec_no", "family").join(linked, F.col("rec_no") == F.col("node")).select("family", "label"), "family_names")
    least = named.groupBy("label").agg(F.min("family").alias("least"))
    changed = materialize(named.join(least, "label").where("family <> least").select("family", "least"), "family_least")
    text = F.lower(F.hex(F.substring(F.coalesce("least", "family"), 1, 10)))
    return keyed.drop("tokens", "block").join(changed, "family", "left").withColumn("family_id", F.concat(F.lit("family_"), text)).drop("family", "least")


def dedup_report(songs: DataFrame) -> DataFrame:
    """One row of counts: songs, distinct melodies, copies, groups with copies, invariant identities and groups of them."""
    keyed = songs.select(music.exact_fingerprint(F.col("bpm"), F.col("events")).alias("x"), music.family_fingerprint(F.col("events")).alias("f"))
    group = lambda c: keyed.groupBy(c).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("songs"), F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum((F.col("n") > 1).cast("bigint")), F.lit(0)).alias("groups"), F.max("n").alias("largest"))
    x, f = group("x"), group("f")
    one = x.select(F.coalesce("songs", F.lit(0)).alias("songs"), F.col("distinct").alias("unique_exact"), F.coalesce(F.col("songs") - F.col("distinct"), F.lit(0)).alias("copies"), F.col("groups").alias("copy_groups"))
    two = f.select(F.col("distinct").alias("unique_invariant"), F.col("groups").alias("invariant_groups"), F.col("largest").alias("largest_invariant"))
    return one.join(F.broadcast(two))  # one row and one row


def hash_order(key: Column, seed: int = 42) -> Column:
    """A place in a seeded shuffle that any engine can compute."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def family_split(members: DataFrame, seed: int = 42, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """family_id, size, split of members(rec_no, family_id): whole families, in hash order, cut at the ratios of the songs.

    A family goes where its midpoint falls. The running sum has two levels: sums of 4096 ranges of the hash, then within
    each range, so no task sees all families. A split that stays empty gets the family whose move leaves the least squared
    error, from a split that has more than one.
    """
    names = ("train", "validation", "test")
    sizes = members.groupBy("family_id").agg(F.count(F.lit(1)).alias("size")).withColumn("h", hash_order(F.col("family_id"), seed)).withColumn("range", F.substring("h", 1, 3))
    sizes = materialize(sizes, "family_sizes")
    ranges = sizes.groupBy("range").agg(F.sum("size").alias("in_range"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 4096 rows at most
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    within = F.coalesce(F.sum("size").over(Window.partitionBy("range").orderBy("h", "family_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mid = F.col("before") + within + F.col("size") / 2
    cut = F.when(mid < total * ratios[0], names[0]).when(mid < total * ratios[0] + total * ratios[1], names[1]).otherwise(names[2])
    placed = sizes.join(F.broadcast(ranges), "range").select("family_id", "size", cut.alias("split"))
    counts = {r["split"]: (r["n"], r["families"]) for r in placed.groupBy("split").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("families")).collect()}
    have = {n: list(counts.get(n, (0, 0))) for n in names}
    if sum(f for _, f in have.values()) >= 3:
        want = {n: total * r for n, r in zip(names, ratios, strict=True)}
        for empty in [n for n in names if have[n][1] == 0]:
            donors = [n for n in names if have[n][1] > 1]
            error = lambda d: sum((F.lit(float(have[n][0])) + (F.col("size") if n == empty else -F.col("size") if n == d else 0) - want[n]) ** 2 for n in names)  # noqa: B023, E731
            best = placed.where(F.col("split").isin(donors)).select("family_id", "size", "split", F.coalesce(*[F.when(F.col("split") == d, error(d)) for d in donors]).alias("e")).orderBy("e", "family_id").first()
            placed = placed.withColumn("split", F.when(F.col("family_id") == best["family_id"], empty).otherwise(F.col("split")))
            have[best["split"]] = [have[best["split"]][0] - best["size"], have[best["split"]][1] - 1]
            have[empty] = [have[empty][0] + best["size"], have[empty][1] + 1]
    return placed


def leakage(songs: DataFrame, near: bool = False) -> DataFrame:
    """kind, key, splits, songs: melodies (tempo-free and invariant, with `near` also families) that stand in more than one
    split. Null splits don't count."""
    exact = F.struct(F.lit("exact").alias("kind"), F.unhex(music.exact_fingerprint(F.col("bpm"), F.col("events"), False)).alias("key"))
    invariant = F.struct(F.lit("invariant").alias("kind"), F.unhex(music.family_fingerprint(F.col("events"))).alias("key"))
    known = songs.where("split IS NOT NULL")
    if not near:
        return _spread(known.select("split", F.inline(F.array(exact, invariant)))).withColumn("key", F.lower(F.hex("key")))
    keyed = _keyed(songs, "split")  # has the fingerprints of songs with events
    long = known.select("split", F.inline(F.array(exact))).unionByName(keyed.where("split IS NOT NULL").select("split", F.lit("invariant").alias("kind"), F.col("family").alias("key")))
    long = long.unionByName(known.where(~F.coalesce(F.size("events") > 0, F.lit(False))).select("split", F.inline(F.array(invariant))))
    out, members = _spread(long).withColumn("key", F.lower(F.hex("key"))), _named(keyed).where("split IS NOT NULL")
    return out.unionByName(_spread(members.select("split", F.lit("family").alias("kind"), F.col("family_id").alias("key"))))


def _spread(long: DataFrame) -> DataFrame:
    """kind, key, splits, songs of the keys that stand in more than one split. Distinct splits are counted as the few that occur,
    after partial aggregation by (key, split)."""
    per = long.groupBy("kind", "key", "split").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("splits"), F.sum("n").alias("songs")).where("splits > 1")


def sampled(songs: DataFrame, per_split: dict[str, int], seed: int = 42) -> DataFrame:
    """The first n songs of each split in hash order (rec_no, split). The rank is limited before the shuffle."""
    limit = F.coalesce(*[F.when(F.col("split") == s, F.lit(n)) for s, n in per_split.items()], F.lit(0))
    rank = F.row_number().over(Window.partitionBy("split").orderBy(hash_order(F.col("rec_no"), seed), "rec_no"))
    ranked = songs.where(F.col("split").isin(*per_split)).select("rec_no", "split").withColumn("rank", rank).where(F.col("rank") <= max(per_split.values()))
    return ranked.where(F.col("rank") <= limit).select("rec_no", "split")
