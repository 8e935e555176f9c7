"""A mixture of sources to target shares of its size in tokens.

Sizes are counted with a public byte-level BPE vocabulary whose path is a parameter. A source's budget is its share of
the total; one that can't fill it within its cap gives what is missing to the others in proportion to their shares.
Within a source complete epochs come first. What remains is filled by weighted sampling without replacement after
Efraimidis and Spirakis: documents in descending order of u ** (1 / weight), u uniform and a hash of the document, are
taken while their running sum of tokens stays within the budget. The order is that of -ln(u) / weight, ascending, which
is what is stored, as keys near 1 would be told apart by rounding only.

The running sum needs no sort of a source. Sums of tokens over BINS equal ranges of keys tell the one range of a source in
which its budget ends; that range is cut again, and so on until it holds few documents, whatever the weights make of the
keys' distribution. Only the documents of that last range are ordered.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunewright.shared import materialize

VOCABULARY = os.environ.get("TUNEWRIGHT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Published splitting pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most documents that are put in order at once, and ranges of keys that a pass over the open ones sums up.
RANGE, BINS = 100_000, 1024
#: mix_targets is read to the driver; it may have so many rows at most.
MAX_TARGETS = 100_000


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents with tokens BIGINT, as the tokenizer counts the whole text; a null or empty text has 0."""
    with open(vocabulary, "rb") as f:  # under 1 MB, whatever the corpus
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        encoding = tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(text)) if text else 0 for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("weight"), pa.array(counts, pa.int64())], names=["doc_id", "source", "weight", "tokens"])

    return documents.select("doc_id", "source", "weight", "text").mapInArrow(run, "doc_id bigint, source string, weight double, tokens bigint")


def quality() -> Column:
    """Default weight of a document: one half each for a declared length that holds and for a known language, 0.25 at least."""
    holds = F.coalesce(F.col("n_chars") == F.length("text"), F.lit(False))
    return F.greatest(F.lit(0.25), F.when(holds, 0.5).otherwise(0.0) + F.when(F.col("lang").isNotNull(), 0.5).otherwise(0.0))


def budgets(targets: list[tuple[str, float, int]], available: dict[str, int], total: float) -> dict[str, float]:
    """Tokens per source: the shares of the total, each cut at its cap, what is cut given to the others by their shares."""
    cap = {s: available.get(s, 0) * float(r) for s, _, r in targets}
    open_, out, left = {s: t for s, t, _ in targets if t > 0 and cap[s] > 0}, {s: 0.0 for s, _, _ in targets}, total
    while open_ and left > 0:
        share = sum(open_.values())
        full = [s for s, t in open_.items() if left * t / share >= cap[s]]
        if not full:
            out |= {s: left * t / share for s, t in open_.items()}
            break
        for s in full:
            out[s] = cap[s]
            left -= cap[s]
            del open_[s]
    return out


def _ends(sized: DataFrame, rest: dict[str, float]) -> dict[str, tuple[float, float, float]]:
    """low, high, before per source: its budget ends among the documents with low <= key < high, before which `before` tokens
    lie; they are RANGE at most, or as many as have one key. low = high where the budget holds the whole source or nothing.

    Each pass sums up BINS ranges of what is still open, so the driver sees BINS rows per source however large it is.
    """
    spark, done = sized.sparkSession, {}
    top = {r["source"]: (r["lo"], r["hi"], r["tokens"]) for r in sized.groupBy("source").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("tokens").alias("tokens")).collect()}
    open_ = {}
    for s, (lo, hi, tokens) in top.items():
        if rest.get(s, 0) <= 0:
            done[s] = (-math.inf, -math.inf, 0.0)
        elif tokens <= rest[s]:
            done[s] = (math.inf, math.inf, 0.0)
        else:
            open_[s] = (lo, math.nextafter(hi, math.inf), 0.0)
    while open_:
        table = spark.createDataFrame([(s, *x) for s, x in open_.items()], "source string, lo double, hi double, before double")
        within = sized.join(F.broadcast(table), "source").where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi")))
        at = F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int")
        sums: dict[str, list] = {s: [] for s in open_}
        for r in within.groupBy("source", at.alias("bin")).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect():
            sums[r["source"]].append(r)
        following = {}
        for s, found in sums.items():
            before = open_[s][2]
            for r in sorted(found, key=lambda r: r["bin"]):
                if before + r["tokens"] > rest[s]:
                    x = (r["lo"], math.nextafter(r["hi"], math.inf), before)
                    (done if r["n"] <= RANGE or r["lo"] == r["hi"] else following)[s] = x
                    break
                before += r["tokens"]
        open_ = following
    return done


def plan(documents: DataFrame, targets: DataFrame, total: float | None = None, vocabulary: str = VOCABULARY, weight: Column | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The mixture (doc_id, source, copies, tokens of one copy) and its report (source, target_share, actual_share, tokens, budget,
    available, epochs), one row per target. A source stays below its budget by less than the text at which its prefix ends.

    total: tokens of the mixture; by default all tokens of the targeted sources. Documents without tokens or without a
    targeted source are left out; repeated rows are documents of their own. A target without documents, with a null or
    non-positive share or with max_repeats under 1 has actual share 0. The order of ties is that of doc_id.
    """
    spark = documents.sparkSession
    rows = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("t"), F.min("max_repeats").alias("r")).orderBy("source").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    wanted = [(r["source"], float(r["t"] or 0), max(int(r["r"] or 0), 0)) for r in rows]
    names = spark.createDataFrame([(s,) for s, _, _ in wanted], "source string")
    known = documents.join(F.broadcast(names), "source", "left_semi").withColumn("weight", F.coalesce(weight if weight is not None else quality(), F.lit(1.0)))
    sized = token_counts(known, vocabulary).where("tokens > 0")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    sized = materialize(sized.select("doc_id", "source", "tokens", (-F.log(u) / F.greatest("weight", F.lit(1e-6))).alias("key")), "p9_sized")
    sums = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()  # one row per target at most
    available = {r["source"]: r["tokens"] for r in sums}
    budget = budgets(wanted, available, float(total if total is not None else sum(available.values())))
    epochs = {s: min(int(budget[s] // available[s]), r) if available.get(s) else 0 for s, _, r in wanted}
    rest = {s: budget[s] - epochs[s] * available.get(s, 0) if epochs[s] < r else 0.0 for s, _, r in wanted}
    ends = _ends(sized, rest)
    per = spark.createDataFrame([(s, epochs[s], rest[s], *ends.get(s, (0.0, 0.0, 0.0))) for s, _, _ in wanted], "source string, epochs int, rest double, lo double, hi double, before double")
    marked = sized.join(F.broadcast(per), "source")
    sure = marked.where((F.col("key") < F.col("lo")) | (F.col("key") >= F.col("hi"))).select("doc_id", "source", "tokens", "epochs", (F.col("key") < F.col("lo")).cast("int").alias("extra"))
    # rows that are the same document are one row with a number here, so what is ordered is bounded by RANGE
    last = marked.where((F.col("key") >= F.col("lo")) & (F.col("key") < F.col("hi"))).groupBy("source", "key", "doc_id", "tokens", "epochs", "rest", "before").agg(F.count(F.lit(1)).alias("m"))
    upto = F.col("before") + F.coalesce(F.sum(F.col("tokens") * F.col("m")).over(Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fit = F.greatest(F.least(F.floor((F.col("rest") - F.col("upto")) / F.col("tokens")), F.col("m")), F.lit(0)).cast("int")
    last = last.withColumn("upto", upto).withColumn("fit", fit)
    # the first that doesn't fit ends the prefix
    stop = F.min(F.when(F.col("fit") < F.col("m"), F.struct("key", "doc_id"))).over(Window.partitionBy("source"))
    last = last.withColumn("stop", stop).withColumn("fit", F.when(F.col("stop").isNull() | (F.struct("key", "doc_id") <= F.col("stop")), F.col("fit")).otherwise(0))
    each = F.explode(F.concat(F.array_repeat(F.lit(1), F.col("fit")), F.array_repeat(F.lit(0), (F.col("m") - F.col("fit")).cast("int")))).alias("extra")
    chosen = sure.unionByName(last.select("doc_id", "source", "tokens", "epochs", each)).select("doc_id", "source", (F.col("epochs") + F.col("extra")).cast("bigint").alias("copies"), "tokens").where("copies > 0")
    chosen = materialize(chosen, "p9_mixture")
    used = chosen.groupBy("source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("tokens"))
    table = spark.createDataFrame([(s, t, budget[s], available.get(s, 0), epochs[s]) for s, t, _ in wanted], "source string, target_share double, budget double, available bigint, epochs int")
    report = table.join(used, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    grand = chosen.agg(F.sum(F.col("copies") * F.col("tokens"))).first()[0] or 0
    return chosen, report.withColumn("actual_share", F.col("tokens") / F.lit(float(grand or 1)))
