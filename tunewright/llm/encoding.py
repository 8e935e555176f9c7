"""Text decoded with the wrong encoding: found and restored by expectation-maximisation over latent encoding chains.

What happened to a text is a latent chain: nothing, UTF-8 bytes read as some single-byte code page (once or twice), or
bytes of one code page read as another. A chain is undone by encoding and decoding the other way round. A text's words
are each either garbled by the chain or intact, and an intact word is generated by a model of character pairs. Weak
evidence is pooled: each source and field has its own distribution over chains, with the corpus's as its prior, and the
pair model is fitted to the restored text. EM alternates between the posterior of every distinct text's chain in every
source and the re-estimation of both, until the likelihood stays; the repair of a record is the one of its most probable
chain. What each chain makes of a text doesn't change, so chains are undone once and stored; a round scores the words, as
vectors over whole batches.

Everything is aggregated before it is shuffled: rows with the same damaged words in one source and field are one unit.
The pair model is a table of a fixed number of hashed counters, so what is broadcast doesn't grow with the corpus. The
chains' distributions per source stay in a table. The claimed encoding isn't used.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunewright.shared import drop, materialize

#: Code pages of the chains (names as Python's codecs have them). Bytes that a page leaves undefined stand for themselves,
#: as C1 control characters, which is how readers treat them; cp1252 so covers latin-1 as well.
PAGES = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r")
#: Pairs (written in, read as) of single-byte pages.
CROSSED = (("cp1252", "cp1251"), ("cp1251", "cp1252"), ("cp1250", "cp1252"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp1252", "cp850"), ("cp850", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"))
#: A chain is a list of steps (written in, read as), the last one done last; the empty chain is intact text.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    (),
    *((("utf-8", p),) for p in PAGES),
    *((("utf-8", p), ("utf-8", p)) for p in PAGES[:5]),
    *((c,) for c in CROSSED),
    (("utf-8", "cp1252"),) * 3,
)
CELLS = 1 << 16
_RUN = re.compile(r"[^\x00-\x7f]+")
#: Share of a damaged text's words that are damaged; start of the share of intact texts; weight of the corpus's
#: distribution in a source's, in texts; posterior from which a text counts as damaged.
GARBLED, INTACT, PRIOR, THRESHOLD = 0.9, 0.6, 10.0, 0.5
#: EM ends when the log-likelihood changes by no more than this share of it; after MAX_ROUNDS it is given up as not converging.
TOLERANCE, MAX_ROUNDS = 1e-4, 50

#: A word is a run of letters around at least one character outside ASCII. Digits, punctuation and white space of ASCII end it.
WORD = r"[A-Za-z']*[^\x00-\x7F\x{FEFF}][A-Za-z'\x{80}-\x{FEFE}\x{FF00}-\x{10FFFF}]*"
#: The same for Python's re.
_PYTHON_WORD = r"[A-Za-z']*[^\x00-\x7F\uFEFF][A-Za-z'\x80-\uFEFE\uFF00-\U0010FFFF]*"


def _tables() -> dict[str, dict[str, int]]:
    out = {}
    for page in PAGES:
        back: dict[str, int] = {chr(b): b for b in range(128)}
        for b in range(128, 256):
            try:
                back[bytes([b]).decode(page)] = b
            except UnicodeDecodeError:
                pass
        for b in range(128, 160):
            back.setdefault(chr(b), b)
        out[page] = back
    return out


def _step(word: str, written: str, read: str, tables: dict[str, dict[str, int]]) -> str | None:
    back = tables[read]
    if written != "utf-8" and "\xa0" in word:  # a no-break space is as good as any space: no letter is made of it
        parts = [_step(p, written, read, tables) if p else p for p in word.split("\xa0")]
        return None if None in parts else "\xa0".join(parts)
    try:
        raw = bytes([back[c] for c in word])
        return raw.decode("utf-8") if written == "utf-8" else "".join(bytes([b]).decode(written) if b > 127 else chr(b) for b in raw)
    except (KeyError, UnicodeDecodeError):
        return None


def undo(word: str, chain: tuple[tuple[str, str], ...], tables: dict[str, dict[str, int]]) -> str | None:
    """The word before the chain, or None if the chain can't have made any of it.

    If the word as a whole can't be undone, its runs of characters outside ASCII are undone one by one: a damaged word
    may be cut, be run together with an intact one, or hold a no-break space that isn't part of the damage.
    """

    def whole(text: str) -> str | None:
        for written, read in reversed(chain):
            text = _step(text, written, read, tables)
            if text is None:
                return None
        return text

    made = whole(word)
    if made is not None or chain[0][0] != "utf-8":
        return made
    done = False

    def run(m: re.Match) -> str:
        nonlocal done
        for part in (m.group(), *([] if "\xa0" not in m.group() else [m.group().strip("\xa0")])):
            if part and (x := whole(part)) is not None:
                done = True
                return m.group().replace(part, x)
        return m.group()

    mended = _RUN.sub(run, word)
    return mended if done else None


def _cells(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all character pairs of the words, of their first and of their second characters; where each word's pairs
    begin; C1 control characters per word. Case counts: a capital within a word of small letters is a mark of damage."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    single = ((codes * np.uint64(0x9E3779B1) + np.uint64(0x1234567)) >> np.uint64(7)) % np.uint64(CELLS)
    pair = ((codes[:-1] * np.uint64(0x9E3779B1) + codes[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)) % np.uint64(CELLS)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(size)
    inner = np.ones(len(codes), bool)
    inner[ends - 1] = False  # the end of a word and the start of the next aren't a pair
    begins = ends - size - np.arange(len(words))
    control = np.add.reduceat(((codes >= 0x80) & (codes <= 0x9F)).astype(np.int64), ends - size) if len(words) else np.zeros(0, np.int64)
    return pair[inner[:-1]].astype(np.int64), single[:-1][inner[:-1]].astype(np.int64), single[1:][inner[:-1]].astype(np.int64), begins, control


class PairModel:
    """log P(word) under hashed counts: counts[0] of pairs, counts[1] of characters. A pair's probability falls back on
    that of its second character, so that characters seen nowhere else are unlikely wherever they stand."""

    #: CONTROL: log-probability that goes with each C1 control character, which intact text has no use for.
    BACK, UNSEEN, CONTROL = 5.0, 0.01, -12.0

    def __init__(self, counts: np.ndarray) -> None:
        self.pair, self.first = counts[0].astype(float), counts[1].astype(float)
        self.total = float(self.first.sum()) + self.UNSEEN * CELLS

    def scores(self, words: list[str]) -> np.ndarray:
        """log P of every word."""
        if not words:
            return np.zeros(0)
        pair, first, own, begins, control = _cells(words)
        each = np.log((self.pair[pair] + self.BACK * (self.first[own] + self.UNSEEN) / self.total) / (self.first[first] + self.BACK))
        return np.add.reduceat(each, begins) + self.CONTROL * control


def repair(word: str, chain: tuple[tuple[str, str], ...], tables: dict[str, dict[str, int]]) -> str | None:
    """undo(), or None where that repairs nothing: a change of case alone leaves an intact spelling intact, and undoing a
    mix-up of single-byte pages, which any text allows, must not turn letters or digits into signs."""
    made = undo(word, chain, tables)
    if made is None or made.lower() == word.lower():
        return None
    if chain[0][0] != "utf-8" and sum(map(str.isalnum, made)) < sum(map(str.isalnum, word)):
        return None
    return made


def texts_of(rows: DataFrame, key: str, text: Column, field: str, keep: bool = False) -> DataFrame:
    """key, source, field, sig: the words of each text that hold a character outside ASCII. Other texts drop out."""
    sig = F.array_join(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), " ").alias("sig")
    kept = [text.alias("text")] if keep else []
    return rows.where(F.rlike(text, F.lit(r"[^\x00-\x7F]"))).select(F.col(key), "source", F.lit(field).alias("field"), *kept, sig).where("sig != ''")


def undone(sigs: DataFrame) -> DataFrame:
    """sig, n, chains, at, made: the words that each chain repairs (which chain, which word of the text, what it becomes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, seen = _tables(), {}
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for sig in batch.column("sig").to_pylist():
                own: tuple[list, list, list] = ([], [], [])
                for i, w in enumerate(sig.split(" ")):
                    if w not in seen:
                        if len(seen) > 50_000:
                            seen.clear()
                        seen[w] = [(c, b) for c, chain in enumerate(CHAINS) if c and (b := repair(w, chain, tables)) is not None]
                    for c, b in seen[w]:
                        for column, x in zip(own, (c, i, b), strict=True):
                            column.append(x)
                for column, x in zip(out, own, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("sig"), batch.column("n"), pa.array(out[0], pa.list_(pa.int32())), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.string()))], names=["sig", "n", "chains", "at", "made"])

    return sigs.select("sig", "n").mapInArrow(run, "sig string, n bigint, chains array<int>, at array<int>, made array<string>")


class _Batch:
    """The words of a batch of texts and what the chains make of them, with the log-likelihood of every chain of every text."""

    def __init__(self, batch: pa.RecordBatch, model: PairModel) -> None:
        words = [s.split(" ") for s in batch.column("sig").to_pylist()]
        n = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(n) - n
        made = batch.column("made")
        self.words, self.alternatives = [w for own in words for w in own], made.flatten().to_pylist()
        self.text = np.repeat(np.arange(len(words)), n)
        sizes = np.diff(made.offsets.to_numpy())
        self.of = np.repeat(np.arange(len(words)), sizes)
        self.chain = batch.column("chains").flatten().to_numpy()
        self.word = first[self.of] + batch.column("at").flatten().to_numpy()
        own, restored = model.scores(self.words), model.scores(self.alternatives)
        kept, there = np.log(1 - GARBLED) + own, np.log(GARBLED) + restored
        self.taken = there > kept[self.word]  # whether the word is more likely to be what the chain makes of it
        self.ll = np.full((len(words), len(CHAINS)), -np.inf)
        self.ll[self.of, self.chain] = 0.0
        np.add.at(self.ll, (self.of, self.chain), np.logaddexp(there, kept[self.word]) - kept[self.word])
        self.ll += np.bincount(self.text, kept, len(words))[:, None]
        self.ll[:, 0] = np.bincount(self.text, own, len(words))


def _scored(texts: DataFrame, model: np.ndarray) -> DataFrame:
    """sig, ll: log-likelihood per chain, null where the chain can't have made any word."""
    sent = texts.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = PairModel(sent.value)
        for batch in batches:
            if batch.num_rows:
                ll = _Batch(batch, pairs).ll
                flat = pa.array(ll.ravel(), mask=np.isneginf(ll.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.ListArray.from_arrays(np.arange(0, ll.size + 1, len(CHAINS), dtype=np.int32), flat)], names=["sig", "ll"])

    return texts.select("sig", "chains", "at", "made").mapInArrow(run, "sig string, ll array<double>")


def _fitted(weighted: DataFrame, model: np.ndarray) -> np.ndarray:
    """Pair counts of the restored text. weighted: undone() with weights (expected number of texts per chain). At most
    2 * CELLS rows come back."""
    sent = weighted.sparkSession.sparkContext.broadcast(model.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, total = PairModel(sent.value), np.zeros((2, CELLS))
        for batch in batches:
            if not batch.num_rows:
                continue
            b = _Batch(batch, pairs)
            weights = batch.column("weights").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(CHAINS))
            weights = np.where(np.isneginf(b.ll) | (weights <= 1e-3), 0.0, weights)
            taken = weights[b.of, b.chain] * b.taken
            own = weights.sum(axis=1)[b.text] - np.bincount(b.word, taken, len(b.words))
            for words, w in ((b.words, np.maximum(own, 0)), (b.alternatives, taken)):
                used = np.flatnonzero(w)
                if len(used):
                    pair, first, second, begins, _ = _cells([words[i] for i in used])
                    each = np.repeat(w[used], np.diff(begins, append=len(pair)))
                    total[0] += np.bincount(pair, each, CELLS)
                    total[1] += np.bincount(first, each, CELLS) + np.bincount(second[np.append(begins[1:], len(pair)) - 1], w[used], CELLS)  # and the ends of the words
        at = np.nonzero(total.ravel())[0]
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], names=["cell", "n"])

    out = np.zeros(2 * CELLS)
    for cell, n in weighted.select("sig", "chains", "at", "made", "weights").mapInArrow(run, "cell bigint, n double").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(2, CELLS)


def fit(units: DataFrame) -> tuple[DataFrame, np.ndarray, list[float]]:
    """units(source, field, sig, n) -> their posterior (ARRAY, one entry per chain) when EM has converged, the pair model, and
    the log-likelihood after each round."""
    k = len(CHAINS)
    texts = materialize(undone(units.groupBy("sig").agg(F.sum("n").alias("n"))), "p7_undone")
    start = F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(k)])
    model = _fitted(texts.withColumn("weights", F.transform(start, lambda x: x * F.col("n"))), np.zeros((2, CELLS)))
    corpus, prior, said = [INTACT] + [(1 - INTACT) / (k - 1)] * (k - 1), None, []
    while True:
        shares = F.array(*[F.lit(float(x)) for x in corpus])
        joined = units.join(_scored(texts, model), "sig")
        if prior is None:
            joined = joined.withColumn("share", shares)
        else:
            joined = joined.join(prior, ["source", "field"], "left").withColumn("share", F.coalesce("share", shares))
        raw = F.zip_with("ll", "share", lambda l, s: F.coalesce(F.exp(l - F.col("top")) * s, F.lit(0.0)))
        posterior = joined.withColumn("top", F.array_max("ll")).withColumn("raw", raw).withColumn("sum", F.aggregate("raw", F.lit(0.0), lambda a, x: a + x))
        posterior = posterior.select("source", "field", "sig", "n", F.transform("raw", lambda x: x / F.col("sum")).alias("posterior"), (F.col("n") * (F.col("top") + F.log("sum"))).alias("fit"))
        posterior = materialize(posterior, "p7_posterior")
        expected = [F.sum(F.col("n") * F.col("posterior")[i]).alias(f"c{i}") for i in range(k)]
        *total, likelihood = posterior.agg(*expected, F.sum("fit")).first()
        said.append(likelihood or 0.0)
        if len(said) > 1 and abs(said[-1] - said[-2]) <= TOLERANCE * abs(said[-1]) or not said[-1]:
            return posterior, model, said
        if len(said) == MAX_ROUNDS:
            raise RuntimeError(f"no convergence in {MAX_ROUNDS} rounds: {said[-3:]}")
        per = posterior.groupBy("source", "field").agg(*expected)
        whole = sum(x or 0 for x in total) or 1
        corpus = [((x or 0) + 1 / k) / (whole + 1) for x in total]
        counts = F.array(*[F.col(f"c{i}") for i in range(k)])
        base = F.array(*[F.lit(float(x)) for x in corpus])
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        prior = materialize(per.select("source", "field", F.zip_with(counts, base, lambda c, b: (c + PRIOR * b) / (size + PRIOR)).alias("share")), "p7_prior")
        model = _fitted(texts.join(posterior.groupBy("sig").agg(*expected).select("sig", counts.alias("weights")), "sig"), model)
        drop(posterior)


def mended(word: str, chain: int, tables: dict[str, dict[str, int]], pairs: PairModel) -> str:
    """The word as the chain of its text restores it, or itself if that is more likely."""
    made = repair(word, CHAINS[chain], tables) if chain else None
    if made is None:
        return word
    own, restored = pairs.scores([word, made])
    return made if math.log(GARBLED) + restored > math.log(1 - GARBLED) + own else word


def damaged(texts: DataFrame, key: str, repair: bool = False) -> DataFrame:
    """key, field of the texts that are damaged; with repair also restored, the text (which texts then needs as a column)
    with its damaged words restored, null where the original is lost (replacement characters).

    A null or empty text, and one without characters outside ASCII, is intact. Texts without source share the corpus's
    distribution of chains. Repeated rows repeat the result.
    """
    keyed = materialize(texts.withColumn("source", F.coalesce("source", F.lit("\x01none"))), "p7_texts")
    units = materialize(keyed.groupBy("source", "field", "sig").agg(F.count(F.lit(1)).alias("n")), "p7_units")
    posterior, model, _ = fit(units)
    best = F.expr("array_position(posterior, array_max(posterior)) - 1").cast("int").alias("chain")
    hit = posterior.where(F.contains(F.col("sig"), F.lit("�")) | (F.col("posterior")[0] < 1 - THRESHOLD)).select("source", "field", "sig", best)
    found = keyed.join(hit, ["source", "field", "sig"])
    if not repair:
        return found.select(key, "field")
    sent = texts.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, pairs, pattern = _tables(), PairModel(sent.value), re.compile(_PYTHON_WORD)
        for batch in batches:
            out = []
            for text, sig, chain in zip(*(batch.column(c).to_pylist() for c in ("text", "sig", "chain")), strict=True):
                if "�" in sig:
                    out.append(None)
                    continue
                out.append(pattern.sub(lambda m: mended(m.group(), chain, tables, pairs), text))  # noqa: B023
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("field"), pa.array(out, pa.string())], names=[key, "field", "restored"])

    return found.select(key, "field", "text", "sig", "chain").mapInArrow(run, f"{key} {kind}, field string, restored string")


def titles(rows: DataFrame, key: str, text: Column, field: str) -> DataFrame:
    """texts_of() the rows, with the text itself."""
    return texts_of(rows, key, text, field, keep=True)


def convergence(texts: DataFrame) -> DataFrame:
    """round, log_likelihood of the fit of texts_of() rows."""
    units = texts.withColumn("source", F.coalesce("source", F.lit("\x01none"))).groupBy("source", "field", "sig").agg(F.count(F.lit(1)).alias("n"))
    _, _, said = fit(materialize(units, "p7_units"))
    return texts.sparkSession.createDataFrame(list(enumerate(said, 1)), "round bigint, log_likelihood double")
