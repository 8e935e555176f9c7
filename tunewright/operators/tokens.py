"""Token sequences of songs, training windows, and the interpolated n-gram model over them.

Ids are arithmetic: PAD 0, BOS 1, EOS 2, then tempi 25..900, pitches 60..107, the rest, and lengths with and without dot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunewright.functions.events import DURATIONS, MAX_PITCH, MIN_PITCH, event_code
from tunewright.functions.parse import BPM
from tunewright.shared import materialize

PAD, BOS, EOS = 0, 1, 2
BPM_0 = 3
PITCH_0 = BPM_0 + BPM[1] - BPM[0] + 1
REST = PITCH_0 + MAX_PITCH - MIN_PITCH + 1
DURATION_0 = REST + 1
VOCABULARY = DURATION_0 + 2 * len(DURATIONS)


def token_ids(bpm: Column, events: Column) -> Column:
    """BOS, tempo, two tokens an event, EOS; null if the tempo or an event is outside the vocabulary or there is no event."""
    pair = lambda e: F.array(F.coalesce(e["pitch"] - MIN_PITCH + PITCH_0, F.lit(REST)), event_code(e) % (2 * len(DURATIONS)) + DURATION_0)
    legal = bpm.between(*BPM) & (F.size(events) > 0) & F.forall(events, lambda e: event_code(e).isNotNull())
    return F.when(legal, F.concat(F.array(F.lit(BOS), bpm - BPM[0] + BPM_0), F.flatten(F.transform(events, pair)), F.array(F.lit(EOS))))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once a row, however often f names it, inside of lambdas too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def decoded(ids: Column) -> Column:
    """STRUCT<bpm, events> of a token sequence, padding at its end stripped; null where the grammar is broken."""
    return once(ids, lambda x: once(_stripped(x), _decoded))


def _stripped(ids: Column) -> Column:
    last = F.size(F.filter(F.transform(ids, lambda x, i: F.when(x != PAD, i)), lambda x: x.isNotNull()))
    # padding stands only at the end of a legal sequence, so the number of other tokens is its length
    return F.slice(ids, 1, F.greatest(last, F.lit(0)))


def _decoded(body: Column) -> Column:
    n = F.size(body)
    pairs = F.when((n >= 5) & (n % 2 == 1), F.transform(F.sequence(F.lit(3), F.greatest(n - 2, F.lit(3)), F.lit(2)), lambda i: F.struct(F.element_at(body, i).alias("p"), F.element_at(body, i + 1).alias("d"))))
    return once(pairs, lambda x: _song(body, n, x))


def _song(body: Column, n: Column, pairs: Column) -> Column:
    ok = (F.get(body, F.lit(0)) == BOS) & (F.element_at(body, -1) == EOS) & F.get(body, F.lit(1)).between(BPM_0, PITCH_0 - 1)
    ok &= F.forall(pairs, lambda x: x["p"].between(PITCH_0, REST) & x["d"].between(DURATION_0, VOCABULARY - 1))
    length = F.array(*[F.lit(d) for d in DURATIONS])
    event = lambda x: F.struct(F.when(x["p"] < REST, x["p"] - PITCH_0 + MIN_PITCH).cast("int").alias("pitch"), F.element_at(length, F.floor((x["d"] - DURATION_0) / 2).cast("int") + 1).alias("duration"), ((x["d"] - DURATION_0) % 2 == 1).alias("dotted"))
    return F.when(F.coalesce((n >= 5) & (n % 2 == 1) & ok, F.lit(False)), F.struct((F.get(body, F.lit(1)) - BPM_0 + BPM[0]).alias("bpm"), F.transform(pairs, event).alias("events")))


def allowed_next(ids: Column, min_events: int = 1, max_events: int | None = None) -> Column:
    """Least and greatest legal next token and whether EOS is legal too, of a legal prefix: STRUCT<low, high, eos>."""
    return allowed_after(F.size(ids), F.element_at(ids, -1), min_events, max_events)


def allowed_after(n: Column, last: Column, min_events: int = 1, max_events: int | None = None) -> Column:
    """allowed_next() of a prefix of which only the length and the last token are known; null after EOS."""
    done = F.floor((n - 2) / 2)
    rng = lambda a, b, eos: F.struct(F.lit(a).alias("low"), F.lit(b).alias("high"), eos.alias("eos"))
    yes, no = F.lit(True), F.lit(False)
    full = done >= (max_events if max_events is not None else 2**31 - 1)
    return (
        F.when(n == 0, rng(BOS, BOS, no)).when(last == EOS, F.lit(None)).when(n == 1, rng(BPM_0, PITCH_0 - 1, no))
        .when((n - 2) % 2 == 1, rng(DURATION_0, VOCABULARY - 1, no)).when(full, rng(EOS, EOS, yes)).otherwise(F.struct(F.lit(PITCH_0).alias("low"), F.lit(REST).alias("high"), (done >= min_events).alias("eos")))
    )


def sliding_context(ids: Column, length: int) -> Column:
    """BOS, tempo and the longest suffix that begins with an event, at most `length` tokens in all."""
    body = F.slice(ids, 3, F.greatest(F.size(ids) - 2, F.lit(0)))
    start = F.greatest(F.size(body) - (length - 2), F.lit(0))
    start = start + start % 2
    return F.when(F.size(ids) <= length, ids).otherwise(F.concat(F.slice(ids, 1, 2), F.slice(body, start + 1, F.greatest(F.size(body) - start, F.lit(0)))))


def sequences(songs: DataFrame) -> DataFrame:
    """rec_no, split, ids."""
    return songs.select("rec_no", "split", token_ids(F.col("bpm"), F.col("events")).alias("ids")).where("ids IS NOT NULL")


def windows(seqs: DataFrame, context: int) -> DataFrame:
    """rec_no, chunk, inputs, targets, each padded to `context` tokens: whole events per window, every window headed by BOS
    and tempo, the tempo a target only in the first and EOS only in the last, so every token is a target once."""
    if context < 4:
        raise ValueError("context must be at least 4")
    per = (context - 2) // 2
    n = F.floor((F.size("ids") - 3) / 2).cast("int")
    cut = seqs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / per).cast("int"))))
    stop = F.least((F.col("chunk") + 1) * per, n)
    events = F.slice("ids", 3 + 2 * per * F.col("chunk"), 2 * (stop - per * F.col("chunk")))
    whole = F.concat(F.slice("ids", 1, 2), events, F.when(stop == n, F.array(F.lit(EOS))).otherwise(F.array().cast("array<int>")))
    cut = cut.withColumn("seq", whole).withColumn("m", F.size("seq") - 1)
    pad = lambda a: F.concat(a, F.array_repeat(F.lit(PAD), F.lit(context) - F.col("m")))
    first = F.when(F.col("chunk") > 0, F.lit(PAD)).otherwise(F.element_at("seq", 2))
    return cut.select("rec_no", "split", "chunk", pad(F.slice("seq", 1, F.col("m"))).alias("inputs"), pad(F.concat(F.array(first), F.slice("seq", 3, F.col("m") - 1))).alias("targets"))


#: Bits of a token in a packed context; a BIGINT holds a leading one and six tokens.
BITS, MOST = 10, 6


def _packed(context: Column | str) -> Column:
    """A context of at most MOST tokens as one number, a one before its first token: equal exactly for equal contexts."""
    return F.aggregate(context, F.lit(1).cast("bigint"), lambda a, x: a * (1 << BITS) + x)


def _unpacked(packed: Column, k: Column) -> Column:
    """The k tokens of a packed context, k >= 1."""
    digit = lambda i: F.call_function("shiftright", packed, ((k - i) * BITS).cast("int")).bitwiseAND((1 << BITS) - 1).cast("int")
    return F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), digit)


def _check_order(order: int) -> None:
    if not 1 <= order <= MOST + 1:
        raise ValueError(f"an order from 1 to {MOST + 1}")


def ngram_counts(seqs: DataFrame, order: int = 5) -> DataFrame:
    """context ARRAY<INT>, target, n for contexts of 0 .. order - 1 tokens; BOS is never a target. Counted with map-side
    combine, contexts packed into one number each."""
    _check_order(order)
    at = F.explode(F.sequence(F.lit(2), F.size("ids")))
    placed = seqs.where(F.size("ids") > 1).select("ids", at.alias("i"))
    each = placed.select(F.element_at("ids", F.col("i")).alias("target"), F.explode(F.transform(F.sequence(F.lit(0), F.least(F.lit(order - 1), F.col("i") - 1)), lambda k: F.struct(k.alias("k"), _packed(F.slice("ids", F.col("i") - k, k)).alias("c")))).alias("s"))
    counted = each.groupBy("s.k", "s.c", "target").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.when(F.col("k") == 0, F.array().cast("array<int>")).otherwise(_unpacked(F.col("c"), F.col("k"))).alias("context"), "target", "n")


def context_totals(counts: DataFrame) -> DataFrame:
    """context, total, kinds (distinct followers)."""
    return counts.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))


def scored_targets(wins: DataFrame, order: int) -> DataFrame:
    """context (the last order - 1 tokens before it), target, n of every target of the windows: equal pairs are one row."""
    at = F.explode(F.sequence(F.lit(1), F.size("targets")))
    each = wins.select("inputs", "targets", at.alias("i")).where(F.element_at("targets", F.col("i")) != PAD)
    take = F.least(F.lit(order - 1), F.col("i"))
    return each.select(F.slice("inputs", F.col("i") - take + 1, take).alias("context"), F.element_at("targets", F.col("i")).alias("target")).groupBy("context", "target").agg(F.count(F.lit(1)).alias("n"))


def log_probabilities(pairs: DataFrame, counts: DataFrame, order: int, alpha: float = 0.1, vocabulary: int = VOCABULARY) -> DataFrame:
    """pairs(context, target, n) with p, the Witten-Bell interpolated probability.

    From the empty context to the longest: a context that was seen mixes its own share with what the shorter ones gave, by
    the number of its distinct followers; one that wasn't leaves it unchanged and the next longer is still asked.

    All orders are asked at once: a pair becomes one row per suffix of its context, two joins bring the suffix's totals and
    the target's count after it, and an aggregate puts the orders together. The empty context's counts, one a token, are broadcast.
    """
    _check_order(order)
    counts = materialize(counts.select(F.size("context").alias("k"), _packed(F.col("context")).alias("c"), "target", "n"), "ngram_counts")
    totals = materialize(counts.groupBy("c").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")), "ngram_totals")
    keyed = pairs.withColumn("_id", _packed("context"))
    if order > 1:
        size = F.least(F.size("context"), F.lit(order - 1))
        suffix = F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda k: F.struct(k.alias("k"), _packed(F.slice("context", F.size("context") - k + 1, k)).alias("c")))
        asked = keyed.where(F.size("context") > 0).select("_id", "target", "context").distinct().select("_id", "target", F.explode(suffix).alias("s")).select("_id", "target", "s.k", "s.c")
        seen = asked.join(totals, "c").join(counts.select("c", "target", "n"), ["c", "target"], "left")
        folded = seen.groupBy("_id", "target").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("n", F.lit(0)).alias("n"), "total", "kinds"))).alias("orders"))  # order - 1 entries
        keyed = keyed.join(folded, ["_id", "target"], "left")
    else:
        keyed = keyed.withColumn("orders", F.array().cast("array<struct<k:int,n:bigint,total:bigint,kinds:bigint>>"))
    empty = counts.where("k = 0").select("target", F.col("n").alias("_n"))  # a row per token of the vocabulary at most
    all_ = counts.where("k = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))
    base = keyed.join(F.broadcast(empty), "target", "left").join(F.broadcast(all_)).withColumn("_p", (F.coalesce("_n", F.lit(0)) + F.lit(alpha)) / (F.col("_all") + F.lit(alpha * vocabulary)))
    p = F.aggregate(F.coalesce("orders", F.array().cast("array<struct<k:int,n:bigint,total:bigint,kinds:bigint>>")), F.col("_p"), lambda p, o: (o["n"] + o["kinds"] * p) / (o["total"] + o["kinds"]))
    return base.withColumn("p", p).select(*pairs.columns, "p")


def cross_entropy(scored: DataFrame) -> DataFrame:
    """targets, nats, perplexity of scored(n, p), weighted by n; null if there are no targets."""
    nats = -F.sum(F.col("n") * F.log("p")) / F.sum("n")
    return scored.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("targets"), nats.alias("nats")).withColumn("perplexity", F.when(F.col("nats") < 700, F.exp("nats")))


def top_filter(scores: DataFrame, by: str, item: str, weight: str, k: int, p: float) -> DataFrame:
    """Of each `by` the k items of most weight (of equals the smaller), then those before which less than or exactly p of
    their weight has been used; rank, share. The rank is limited before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(weight), item)
    kept = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    total = F.sum(weight).over(Window.partitionBy(by))
    before = F.coalesce(F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.withColumn("share", F.col(weight) / total).withColumn("before", before / total).where((F.col("rank") == 1) | (F.col("before") <= p)).drop("before")
