"""New batches against all history: a forest of prefix trees over sorted signatures, kept in a folder.

A melody's signature in a tree is a label of DEPTH min-hash values over its n-grams of events; a label is one 64-bit
number (tree, then DEPTH digits), so a run of the forest is a table sorted by label and the melodies under a prefix are
a range of it. A run is stored in parts of consecutive labels; a lookup opens only the parts that hold a range of the
batch. It takes the deepest prefix first, verifies one melody of the range by edit distance, and widens the prefix for
what is still unresolved, down to the depth at which the recall target is met; there whole ranges are searched.

A batch is appended as a run of its own. Runs of one size are merged when there are FAN_IN of them, so an entry is
rewritten a logarithmic number of times over the forest's life, and a lookup opens a logarithmic number of runs. The
runs are listed in a manifest, a new version of which is one small file: a forest opened again is as it was left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunewright.functions.events import CODES, FIRST_CHAR
from tunewright.llm.melodies import close_bpm, close_events, members
from tunewright.shared import _delete, drop, materialize, new_path

TREES, DEPTH, DIGIT, NGRAM = 12, 3, 20, 3
#: Recall that a lookup must reach for pairs whose n-gram sets have the least similarity that closeness allows: an edit
#: changes NGRAM n-grams of either side and a tenth of the events may be edited, which leaves 0.7 of 1.3.
RECALL, WORST = 0.95, 0.53


def recall_at(depth: int, similarity: float, trees: int = TREES) -> float:
    """Probability that two melodies whose n-gram sets have this Jaccard similarity share a prefix in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(target: float, similarity: float = WORST) -> int:
    """The deepest prefix that still reaches the recall target; the whole forest is scanned at depth 1 at worst."""
    return next((d for d in range(DEPTH, 1, -1) if recall_at(d, similarity) >= target), 1)


#: Lookups widen to this prefix.
WIDEST = depth_for(RECALL)


def _mixers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240501)
    draw = lambda n: r.integers(1, 2**63, n, dtype=np.uint64)
    return draw(CODES), draw(TREES * DEPTH) | np.uint64(1), draw(TREES * DEPTH)


def codes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Event codes of all melodies in a row, and offsets (in events) of each. Every character has two bytes."""
    strings = strings.cast(pa.large_string()).combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    off = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    code = ((raw[0::2].astype(np.int32) & 0x1F) << 6 | (raw[1::2] & 0x3F)) - FIRST_CHAR
    return code, (off - off[0]) // 2


def _labels(batch: pa.RecordBatch, hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """TREES labels per melody. A melody shorter than an n-gram counts as one n-gram."""
    code, off = codes_of(batch.column("mel"))
    h = hashes[code]
    gram = h.copy()
    for j in range(1, NGRAM):  # n-grams that run over the end of their melody are masked below
        gram[: len(gram) - j] = gram[: len(gram) - j] * np.uint64(0x9E3779B97F4A7C15) + h[j:]
    n = np.diff(off)
    ends = np.repeat(off[1:], n)
    masked = (np.arange(len(code)) > ends - NGRAM) & (np.arange(len(code)) != np.repeat(off[:-1], n))
    out = np.zeros((len(n), TREES), np.int64)
    for t in range(TREES):
        label = np.full(len(n), t, np.uint64)
        for d in range(DEPTH):
            x = gram * a[t * DEPTH + d] + b[t * DEPTH + d]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x >>= np.uint64(16)
            x[masked] = np.uint64(2**63)
            least = np.minimum.reduceat(x, off[:-1])
            label = label << np.uint64(DIGIT) | least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - DIGIT)
        out[:, t] = label.view(np.int64)
    return out


def entries(classes: DataFrame) -> DataFrame:
    """label, cid, run: one row per melody class (columns cid, mel, run) and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mix = _mixers()
        for batch in batches:
            if batch.num_rows:
                labels = _labels(batch, *mix)
                yield pa.record_batch([labels.ravel(), *(np.repeat(batch.column(c).to_numpy(), TREES) for c in ("cid", "run"))], names=["label", "cid", "run"])

    return classes.select("cid", "mel", "run").mapInArrow(run, "label bigint, cid bigint, run int")


def prefix(depth: int) -> Column:
    return F.shiftright("label", DIGIT * (DEPTH - depth))


def class_number(mel: str = "mel", bpm: str = "bpm") -> Column:
    """Number of a class: a hash, so the same class has the same number in every batch and a batch accepted twice changes nothing."""
    return F.xxhash64(mel, bpm)


def classes_of(rows: DataFrame) -> DataFrame:
    """cid, mel, bpm, run: one row per distinct (melody, bpm, run) of rows(mel, bpm, run)."""
    return rows.groupBy("mel", "bpm", "run").agg(F.count(F.lit(1)).alias("n")).select(class_number().alias("cid"), "mel", "bpm", "run")


def _side(classes: DataFrame, p: str) -> DataFrame:
    return classes.select(F.col("cid").alias(f"{p}cid"), F.col("run").alias(f"{p}run"), F.col("mel").alias(f"{p}mel"), F.length("mel").alias(f"{p}n"), F.col("bpm").alias(f"{p}bpm"))


def verified(pairs: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """The cid, run of the pairs (cid, run of new, old_cid, old_run of old) with close events and bpm. All sides are tables, so a
    class that is in very many pairs is split by AQE."""
    both = pairs.join(_side(new, ""), ["cid", "run"]).join(_side(old, "old_"), ["old_cid", "old_run"]).where(close_bpm(F.col("bpm"), F.col("old_bpm")))
    return both.where(close_events("mel", "old_mel", "n", "old_n")).select("cid", "run").distinct()


def _steps(c: Column) -> Column:
    """Places on a scale of tenths: values of which the smaller is at least nine tenths of the larger are one place apart at most."""
    return F.floor(F.log(F.greatest(c, F.lit(1))) / F.lit(float(np.log(10 / 9)))).cast("int")


class HashForest:
    """The forest in a folder. check() looks a batch up and stages its run, accept() makes the run part of the forest.

    path/manifest/NNNNNNNN.json lists the runs; path/runs/<name>/{entries,classes}/part=P are their parts: entries by the
    highest bits of the label, classes by those of their number, PART rows to a part; a run of one part is one. Every row has in
    `run` the number of the batch that it came with, which grows from batch to batch and outlives merges. What a batch costs depends on its own
    entries: it opens at most one part per entry and run, of bounded size, whatever the history holds.
    """

    FAN_IN, PART = 4, 1_000_000
    #: Up to so many ranges or numbers of classes are sent to the history's scan (8 bytes each); more are joined with it.
    BROADCAST_KEYS = 500_000
    #: A range with more entries of the history than that is searched by length and tempo.
    FULL = 200
    #: Bits of a label below its tree, of which the highest tell the part.
    LABEL = DEPTH * DIGIT

    def __init__(self, spark: SparkSession, path: str | None = None, recall: float = RECALL) -> None:
        self.spark, self.path, self.widest = spark, path or new_path(spark, "forest"), depth_for(recall)
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._file = lambda name: self._jpath(f"{self.path}/{name}")
        self.version, self.runs = 0, []
        if self._fs.exists(self._file("manifest")):
            names = sorted(f.getPath().getName() for f in self._fs.listStatus(self._file("manifest")) if f.getPath().getName().endswith(".json"))
            if names:
                self.version = int(names[-1][:8])
                self.runs = json.loads(spark.read.text(f"{self.path}/manifest/{names[-1]}", wholetext=True).first()[0])
        self.staged: dict | None = None

    def _commit(self, runs: list[dict]) -> None:
        """Write the next version of the manifest; it fails if another session wrote it first."""
        out = self._fs.create(self._file(f"manifest/{self.version + 1:08d}.json"), False)
        out.write(bytearray(json.dumps(runs).encode()))
        out.close()
        self.version, self.runs = self.version + 1, runs

    @staticmethod
    def _bits(rows: int, part: int) -> int:
        return max(0, (-(-rows // part) - 1).bit_length())

    def _label_part(self, bits: int) -> Column:
        """Part of a label: its tree and the highest bits of its digits."""
        return F.shiftright("label", self.LABEL - bits)

    @staticmethod
    def _class_part(bits: int) -> Column:
        return F.shiftrightunsigned("cid", 64 - bits) if bits else F.lit(0).cast("bigint")

    @staticmethod
    def _named(level: int, number: int) -> dict:
        """A new run, of the batches up to this number."""
        return {"name": uuid.uuid4().hex[:16], "level": level, "class_bits": 0, "entry_bits": 0, "last": number}

    def _next(self) -> int:
        return 1 + max((r.get("last", 0) for r in self.runs), default=0)

    def _write(self, classes: DataFrame, made: DataFrame | None, level: int, number: int) -> dict:
        """A run of the classes and their entries (by default those derived from the classes), sorted. Equal labels in large
        numbers fill several files of a part."""
        run = self._named(level, number)
        at = f"{self.path}/runs/{run['name']}"
        classes.select("cid", "mel", "bpm", "run").write.parquet(f"{at}/classes/part=0")
        size = run["classes"] = self._open(run, "classes").count()
        run["entry_bits"] = self._bits(size, self.PART)
        if size > self.PART:  # more than one part: dealt out anew
            run["class_bits"] = self._bits(size, self.PART)
            own = self._open(run, "classes").withColumn("part", self._class_part(run["class_bits"]))
            own.repartitionByRange(-(-size // self.PART), "cid").sortWithinPartitions("cid").write.partitionBy("part").parquet(f"{at}/parted")
            _delete(self.spark, f"{at}/classes")
            self._fs.rename(self._file(f"runs/{run['name']}/parted"), self._file(f"runs/{run['name']}/classes"))
        files = -(-size * TREES // self.PART)
        by = (entries(self._open(run, "classes")) if made is None else made).withColumn("part", self._label_part(run["entry_bits"]))
        by = by.repartitionByRange(files, "label", "cid") if files > 1 else by.repartition(1)
        by.sortWithinPartitions("label", "cid").write.partitionBy("part").parquet(f"{at}/entries")
        return run

    def _open(self, runs: list[dict] | dict, what: str, asked: DataFrame | None = None) -> DataFrame:
        """Entries or classes of the runs, as one scan. With asked, which has their key, only the parts that its keys fall in are read:
        which parts these are is metadata, at most as many rows as a run has parts. A run of one part is read whole."""
        paths = []
        for run in [runs] if isinstance(runs, dict) else runs:
            at, bits = f"runs/{run['name']}/{what}", run["entry_bits" if what == "entries" else "class_bits"]
            if asked is None or not bits:
                paths.append(f"{self.path}/{at}")
                continue
            part = self._label_part(bits) if what == "entries" else self._class_part(bits)
            wanted = {f"part={r[0]}" for r in asked.select(part.alias("part")).distinct().collect()}
            paths += [f"{self.path}/{at}/{n}" for f in self._fs.listStatus(self._file(at)) if (n := f.getPath().getName()) in wanted]
        schema = "label bigint, cid bigint, run int" if what == "entries" else "cid bigint, mel string, bpm int, run int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        opened = self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(*paths)
        return opened.withColumn("run", F.coalesce("run", F.lit(0)))  # a forest written before rows had it

    def _entries(self, made: DataFrame, runs: list[dict]) -> DataFrame:
        """Entries of the history in the parts that the batch's entries fall in."""
        return self._open(runs, "entries", made)

    def _classes(self, wanted: DataFrame, runs: list[dict]) -> DataFrame:
        """The classes of the runs that the table wanted(old_cid) names, read from the parts that their numbers fall in."""
        numbers = wanted.select(F.col("old_cid").alias("cid")).distinct()
        own = self._open(runs, "classes", numbers)
        return own.join(F.broadcast(numbers) if numbers.count() <= self.BROADCAST_KEYS else numbers, "cid", "left_semi")

    def lookup(self, staged: list[dict], runs: list[dict]) -> DataFrame:
        """cid, run of the classes of staged runs for which a class of an earlier batch is close: of the given runs, an earlier state
        of the forest, or of the staged runs before its own.

        From the deepest prefix to the widest, an entry is held against one entry of its range: as many candidates as
        entries, however full a range is. Only what that leaves is held against whole ranges, and there a pair is made only
        if lengths and tempi allow it; in a full range both are parts of the join's key.
        """
        new, made, wide = self._open(staged, "classes"), self._open(staged, "entries"), prefix(self.widest)
        few = sum(r["classes"] for r in staged) * TREES <= self.BROADCAST_KEYS
        sent = F.broadcast if few else lambda df: df
        every = made
        if runs:
            every = made.unionByName(self._entries(made, runs).join(sent(made.select(wide.alias("range")).distinct()), wide == F.col("range"), "left_semi"))
        # most ranges are those of one batch: nothing of an earlier one is in them
        ranges = materialize(every.groupBy(wide.alias("range")).agg(F.min("run").alias("first"), F.max("run").alias("last")).where("first < last").select("range", "first"), "forest_ranges")
        near = materialize(every.join(sent(ranges), wide == F.col("range")).select("range", "label", "cid", "run", "first"), "forest_near")
        # one row per distinct label, the earliest, so a label that very many melodies share is one row from here on
        firsts = materialize(near.groupBy("label").agg(F.min(F.struct("run", "cid")).alias("old")), "forest_firsts")
        asked = near.where((F.col("run") >= min(r["last"] for r in staged)) & (F.col("first") < F.col("run"))).select("range", "label", "cid", "run")
        earlier = lambda met: met.where(F.col("old.run") < F.col("run")).select("cid", "run", F.col("old.cid").alias("old_cid"), F.col("old.run").alias("old_run"))
        pairs = earlier(asked.join(firsts, "label"))
        for depth in range(DEPTH - 1, self.widest - 1, -1):
            first = firsts.groupBy(prefix(depth).alias("range")).agg(F.min("old").alias("old"))
            own = asked.select(prefix(depth).alias("range"), "cid", "run")
            pairs = pairs.unionByName(earlier(own.join(first if few else materialize(first, "forest_firsts"), "range")))
        pairs = materialize(pairs.distinct(), "forest_pairs")
        whole = [*runs, *staged] if len(staged) > 1 else runs
        done = materialize(verified(pairs, new, self._classes(pairs, whole)), "forest_found")
        open_ = materialize(asked.join(sent(done), ["cid", "run"], "left_anti"), "forest_open")
        hits = materialize(near.join(sent(open_.groupBy("range").agg(F.max("run").alias("last"))), "range").where("run < last").select("range", F.col("cid").alias("old_cid"), F.col("run").alias("old_run")), "forest_hits")
        old = self._classes(hits, whole)
        gates = lambda c, p: c.select(F.col("cid").alias(f"{p}cid"), F.col("run").alias(f"{p}run"), F.length("mel").alias(f"{p}n"), F.col("bpm").alias(f"{p}bpm"), _steps(F.length("mel")).alias("size"), _steps(F.col("bpm")).alias("pace"))
        around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias(c)
        fits = (F.col("old_run") < F.col("run")) & close_bpm(F.col("bpm"), F.col("old_bpm")) & (F.abs(F.col("n") - F.col("old_n")) * 10 <= F.greatest("n", "old_n"))
        pair = ("cid", "run", "old_cid", "old_run")
        asks = open_.select("range", "cid", "run").join(gates(new, ""), ["cid", "run"])
        held = hits.join(gates(old, "old_"), ["old_cid", "old_run"])
        full = materialize(hits.groupBy("range").agg(F.count(F.lit(1)).alias("in_range")).where(F.col("in_range") > self.FULL).select("range"), "forest_full")
        crowded = bool(full.take(1))
        pairs_b = (asks.join(full, "range", "left_anti") if crowded else asks).drop("size", "pace").join(held.drop("size", "pace"), "range").where(fits).select(*pair)
        if crowded:  # in a full range only lengths and tempi that fit meet
            dense = asks.join(full, "range", "left_semi").select("range", "cid", "run", "n", "bpm", around("size"), "pace").select("range", "cid", "run", "n", "bpm", "size", around("pace"))
            pairs_b = pairs_b.unionByName(dense.join(held.join(full, "range", "left_semi"), ["range", "size", "pace"]).where(fits).select(*pair))
        pairs_b = pairs_b.distinct()
        found = done.unionByName(materialize(verified(pairs_b, new, old), "forest_found"))
        for t in (ranges, near, firsts, pairs, open_, hits, full):
            drop(t)
        return found

    def check(self, batch: DataFrame) -> DataFrame:
        """rec_no of the batch's songs that repeat a song of the history; songs without bpm take no part. Nothing about the
        history is computed anew. The batch's own run is written now and serves the lookup; accept() makes it part of the forest."""
        self._forget()
        rows = materialize(members(batch.where("bpm IS NOT NULL"), "bpm").withColumn("run", F.lit(self._next())), "forest_rows")
        self.staged = self.stage(rows, self._next())
        return self.repeated(rows, [self.staged], self.runs)

    def stage(self, rows: DataFrame, number: int) -> dict:
        """The run of a batch's rows(rec_no, mel, bpm, run), which isn't part of the forest yet."""
        return self._write(classes_of(rows), None, 0, number)

    def stage_together(self, rows: DataFrame, numbers: list[int]) -> list[dict]:
        """The runs of several batches, of PART rows at most in all, each a run as stage() makes it; rows' run tells them apart. All
        are written by the same three jobs."""
        runs = {n: self._named(0, n) for n in numbers}
        at = f"{self.path}/staged/{uuid.uuid4().hex[:16]}"

        def moved(what: str, to: str) -> None:
            for n, run in runs.items():
                self._fs.mkdirs(self._file(f"runs/{run['name']}/{what}"))
                self._fs.rename(self._jpath(f"{at}/{what}/batch={n}"), self._file(f"runs/{run['name']}/{what}/{to}"))

        classes_of(rows).withColumn("batch", F.col("run")).write.partitionBy("batch").parquet(f"{at}/classes")
        moved("classes", "part=0")
        classes = self._open([*runs.values()], "classes")
        for r in classes.groupBy("run").count().collect():  # as many rows as batches
            runs[r["run"]]["classes"] = r["count"]
        entries(classes).withColumn("batch", F.col("run")).sortWithinPartitions("batch", "label", "cid").write.partitionBy("batch").parquet(f"{at}/entries")
        moved("entries", "part=0")
        _delete(self.spark, at)
        return [*runs.values()]

    def repeated(self, rows: DataFrame, staged: list[dict], runs: list[dict]) -> DataFrame:
        """rec_no of the rows of staged runs that repeat a song of an earlier batch, in the given runs or the staged."""
        if not ((runs or len(staged) > 1) and any(r["classes"] for r in staged)):
            return rows.select("rec_no").where("false")
        return rows.select("rec_no", class_number().alias("cid"), "run").join(self.lookup(staged, runs), ["cid", "run"]).select("rec_no")

    def accept(self, run: dict | None = None, merge: bool = True) -> None:
        """Append a run, by default that of the batch checked last, and merge runs where FAN_IN of one level have come together.
        Merged runs stay in the folder for lookups that have begun, until vacuum()."""
        if run is None:
            run, self.staged = self.staged, None
        self._commit([*self.runs, run])
        level = 0
        while merge and len(same := [r for r in self.runs if r["level"] == level]) >= self.FAN_IN:
            merged = self._write(self._open(same, "classes"), self._open(same, "entries"), level + 1, max(r.get("last", 0) for r in same))
            self._commit([*[r for r in self.runs if r["level"] != level], merged])
            level += 1

    def vacuum(self) -> None:
        """Delete runs that the manifest doesn't list. No lookup or stage may be under way."""
        known = {r["name"] for r in [*self.runs, *([self.staged] if self.staged else [])]}
        if self._fs.exists(self._file("runs")):
            for f in self._fs.listStatus(self._file("runs")):
                if f.getPath().getName() not in known:
                    self._fs.delete(f.getPath(), True)

    def _forget(self) -> None:
        """Delete a run that was staged and not accepted."""
        if self.staged:
            _delete(self.spark, f"{self.path}/runs/{self.staged['name']}")
            self.staged = None


def repeats(songs: DataFrame, store: HashForest | None = None) -> DataFrame:
    """rec_no of every song for which a song of an earlier batch has close events and bpm: the batches are accepted in turn and
    looked up in the forest, each in what came before it. Songs without batch or bpm take no part.

    Batches of PART songs together at most are staged and looked up by the same jobs, so a replay of many batches costs the driver
    no more plans than one of few. A forest made for the replay alone isn't merged.
    """
    spark = songs.sparkSession
    path = new_path(spark, "p3_rows")
    members(songs.where(F.col("batch_no").isNotNull() & F.col("bpm").isNotNull()), "bpm", "batch_no").write.partitionBy("batch_no").parquet(path)
    rows = spark.read.schema("rec_no bigint, bpm int, mel string, batch_no int").parquet(path)
    own, out = store is None, rows.select("rec_no").where("false")
    store = store or HashForest(spark)
    groups: list[list[int]] = []
    for b, n in sorted(tuple(r) for r in rows.groupBy("batch_no").count().collect()):
        if not groups or size + n > store.PART:
            groups, size = [*groups, []], 0
        groups[-1].append(b)
        size += n
    for group in groups:
        numbers = [store._next() + i for i in range(len(group))]
        which = F.element_at(F.create_map(*(F.lit(x) for pair in zip(group, numbers, strict=True) for x in pair)), F.col("batch_no"))
        part = rows.where(F.col("batch_no").isin(group)).select("rec_no", "mel", "bpm", which.alias("run"))
        staged = store.stage_together(part, numbers) if len(group) > 1 else [store.stage(part, numbers[0])]
        out = out.unionByName(store.repeated(part, staged, list(store.runs)))
        for run in staged:
            store.accept(run, merge=not own)
    if not own:
        store.vacuum()
    return out


def kinds(songs: DataFrame, manifest: DataFrame) -> DataFrame:
    """rec_no, kind of every repeat: record (the raw text's hash came with an earlier batch), exact (events and bpm did), near.

    A text repeated in a folder with another convention of signs counts as record though its events differ.
    """

    def again(keyed: DataFrame, *key: str) -> DataFrame:
        """rec_no of keyed(rec_no, batch_no, key) whose key came with an earlier batch."""
        first = keyed.groupBy(*key).agg(F.min("batch_no").alias("b0"), F.max("batch_no").alias("b1")).where("b0 < b1").select(*key, "b0")
        return keyed.join(materialize(first, "p3_first"), list(key)).where("b0 < batch_no").select("rec_no").distinct()

    hashed = songs.select("rec_no", "batch_no").join(manifest.select("rec_no", "record_sha256"), "rec_no").where("batch_no IS NOT NULL AND record_sha256 IS NOT NULL")
    record = again(hashed, "record_sha256").withColumn("record", F.lit(True))
    rows = members(songs.where(F.col("batch_no").isNotNull() & F.col("bpm").isNotNull()), "bpm", "batch_no")
    exact = again(rows.select("rec_no", "batch_no", class_number().alias("ka"), F.xxhash64(F.lit(1), "mel", "bpm").alias("kb")), "ka", "kb").withColumn("exact", F.lit(True))
    both = repeats(songs).distinct().join(exact, "rec_no", "left").join(record, "rec_no", "full")
    return both.select("rec_no", F.when(F.col("record"), "record").when(F.col("exact"), "exact").otherwise("near").alias("kind"))
