"""Titles: normalisation, sanitising with reasons, near-repeats, words to avoid, and unique names."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunewright.functions.music import json_events, sounded, successive
from tunewright.functions.parse import parse
from tunewright.shared import materialize

#: Words that carry no content, and phrases of a model that explains instead of naming.
STOP_WORDS = "a an and as at be by for from in into is it its my of on or our the to up we with your".split()
TITLE_STOP_WORDS = "a an the of and in on at by to for".split()
PROSE = (
    "ignore previous", "ignore all", "ignore the", "system prompt", "system message", "user prompt", "user message", "assistant prompt", "assistant message", "here is", "here's", "this is",
    "the title is", "i suggest", "i recommend", "i would", "based on", "could be named", "call it", "instruction", "instructions",
)
SHARPS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
MAX_TITLE, MAX_WORDS, MAX_NAME, RECENT, AVOID = 60, 6, 11, 10, 8

_PROSE = re.compile(r"\b(?:" + "|".join(map(re.escape, PROSE)) + r")\b", re.I)
_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}


def tonic(name: Column) -> Column:
    """Canonical sharp spelling of a note name with at most one accidental, # or b or their signs; null if it isn't one."""
    t = F.translate(F.trim(name), "♯♭", "#b")
    letter = F.upper(F.substring(t, 1, 1))
    natural = F.when(letter == "C", 0).when(letter == "D", 2).when(letter == "E", 4).when(letter == "F", 5).when(letter == "G", 7).when(letter == "A", 9).when(letter == "B", 11)
    rest = F.substring(t, F.lit(2), F.length(t))
    shift = F.when(rest == "", 0).when(rest == "#", 1).when(rest == "b", -1)
    return F.when(natural.isNotNull() & shift.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in SHARPS]), F.pmod(natural + shift, F.lit(12)) + 1))


def compact(value: str | None) -> str:
    """At most eleven letters and digits of ASCII."""
    plain = unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode()
    return re.sub(r"[^A-Za-z0-9]", "", plain)[:MAX_NAME] or "Untitled"


def header_name(value: str | None) -> str:
    """Name of a text record: ASCII letters, digits, blanks, _ and -, eleven at most."""
    plain = unicodedata.normalize("NFKD", value or "").encode("ascii", "ignore").decode()
    return re.sub(r"[^A-Za-z0-9 _-]", "", plain).strip()[:MAX_NAME] or "Generated"


def sanitize(value: str | None) -> tuple[str | None, str | None]:
    """Title and None, or None and the reason why the text is no title."""
    if value is None:
        return None, "no text"
    t = re.sub(r"(?i)\Atitle:\s*", "", unicodedata.normalize("NFKC", value).strip())
    if len(t) > 1 and _QUOTES.get(t[0]) == t[-1]:
        t = t[1:-1].strip()
    checks: list[tuple[str, Callable[[str], bool]]] = [
        ("control characters", lambda s: any(unicodedata.category(c)[0] == "C" for c in s)),
        ("length", lambda s: not 0 < len(" ".join(s.split())) <= MAX_TITLE),
        ("no letters", lambda s: not any(c.isalpha() for c in s)),
        ("punctuation", lambda s: not all(c.isalnum() or c in " '-’&" for c in " ".join(s.split()))),
        ("too many words", lambda s: len(s.split()) > MAX_WORDS),
        ("prose", lambda s: bool(_PROSE.search(s))),
    ]
    for reason, wrong in checks:
        if wrong(t):
            return None, reason
    return " ".join(t.split()), None


def sanitized(values: Column) -> Column:
    """STRUCT<title, reason>; Unicode categories need Python, batches of it."""

    def run(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sanitize(x) for x in v], columns=["title", "reason"])

    return F.pandas_udf(run, "struct<title:string,reason:string>")(values)


def ascii_name(values: Column) -> Column:
    def run(v: pd.Series) -> pd.Series:
        return v.map(header_name)

    return F.pandas_udf(run, "string")(values)


def content_words(title: Column) -> Column:
    """Lower-cased runs of letters without the title stop words."""
    return F.filter(F.regexp_extract_all(F.lower(title), F.lit(r"\p{L}+"), F.lit(0)), lambda w: ~w.isin(*TITLE_STOP_WORDS))


def near_repeats(titles: DataFrame) -> DataFrame:
    """id, earlier of titles(id, title): titles that repeat an earlier one, in all words or in two or more of them.

    Not all pairs are formed: titles meet on their pairs of content words, or on all words if they have fewer than two.
    The smallest earlier id is kept, by an aggregate.
    """
    words = titles.select("id", content_words(F.col("title")).alias("all"))
    distinct = F.array_sort(F.array_distinct("all"))
    pairs = F.flatten(F.transform(distinct, lambda a, i: F.transform(F.filter(distinct, lambda b: b > a), lambda b: F.concat_ws(" ", a, b))))
    keys = F.concat(F.array(F.concat(F.lit("="), F.array_join("all", " "))), F.when(F.size("all") >= 2, pairs).otherwise(F.array().cast("array<string>")))
    long = words.where(F.size("all") > 0).select("id", F.explode(F.array_distinct(keys)).alias("key"))
    several = long.groupBy("key").agg(F.min("id").alias("earlier"), F.max("id").alias("last")).where("earlier < last").select("key", "earlier")
    first = materialize(several, "repeat_keys")  # a table, so that a key of very many titles is split in the join
    return long.join(first, "key").where(F.col("earlier") < F.col("id")).groupBy("id").agg(F.min("earlier").alias("earlier"))


def words_to_avoid(titles: DataFrame) -> DataFrame:
    """rank, word, n of titles(id, title): content words in two or more of the last ten titles, the commonest eight, of equals
    in alphabetical order. Each title counts a word once, and only its first four words."""
    recent = titles.orderBy(F.desc("id")).limit(RECENT)
    clean = F.filter(F.split(F.regexp_replace("title", r"[^A-Za-z0-9 ]", " "), r"\s+"), lambda w: w != "")
    short = F.trim(F.substring(F.array_join(F.slice(clean, 1, 4), " "), 1, 32))
    words = F.array_distinct(F.split(F.lower(short), " "))
    long = recent.select(F.explode(words).alias("word")).where(F.rlike("word", F.lit("^[a-z]{3,}$")) & ~F.col("word").isin(*STOP_WORDS))
    counted = long.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "word"))  # forty words at most
    return counted.withColumn("rank", rank).where(F.col("rank") <= AVOID).select(F.col("rank").cast("bigint").alias("rank"), "word", "n")


def unique(values: Iterable[str], limit: int, separator: str, used: set[str] | None = None) -> Iterator[tuple[str, bool]]:
    """Each value cut to limit, with a number behind it if it, case ignored, was there before; and whether it was changed.

    Uniqueness depends on all earlier names, so this runs on one batch of names in order, on the driver. Where a name stood
    before, the search goes on behind the number that it got last.
    """
    used, reached = set() if used is None else used, Counter()
    for own in (v[:limit] for v in values):
        spellings = ((own[: limit - len(end)].rstrip() + end, k) for k in count(max(reached[own.casefold()] + 1, 2)) for end in [f"{separator}{k}"])
        made, reached[own.casefold()] = next((x, k) for x, k in chain([(own, 1)], spellings) if x.casefold() not in used)
        used.add(made.casefold())
        yield made, made != own


def numbered(names: DataFrame) -> DataFrame:
    """id, name, place of names(id, name) for tables of any size: the how-manieth its name is, by id. Hot names sort within
    their own partition only; numbers instead of a search keep it free of a fold over all names."""
    w = Window.partitionBy(F.lower("name")).orderBy("id")
    return names.select("id", "name", F.row_number().over(w).cast("bigint").alias("place"))


def _proposals(namer: Callable[[dict, list[str], int], str], record: dict, titles: list[str], seeds: Iterable[int]) -> Iterator[tuple[str | None, str | None]]:
    """What the namer suggests, one seed after the other: a title, or none and why; a failure of the namer is the last one."""
    for seed in seeds:
        try:
            said = namer(record, list(titles), seed)
        except Exception as e:  # a model may raise anything
            yield None, f"{type(e).__name__}: {e}"
            return
        title, why = sanitize(said)
        yield title, why or ("duplicate" if title.casefold() in {t.casefold() for t in titles} else None)


def name_batch(records: list[dict], namer: Callable[[dict, list[str], int], str], seed: int = 42, retries: int = 1) -> tuple[list[dict], dict]:
    """Titles for a batch of at most a few hundred records (rtttl, name, valid), in order.

    namer(record, used titles, seed) suggests one; an unusable or repeated one is asked for again with another seed, then a
    number is added. If the namer fails, the record keeps its own name, and its header as it is if that is a short one of
    ASCII. A record that doesn't parse fails and stays as it is. Only the name section of the text changes.
    """
    usable = [i for i, r in enumerate(records) if r.get("valid")]
    parsed = parse([records[i]["rtttl"] for i in usable], np.zeros(len(usable), bool)) if usable else None
    broken = {i: e for i, e in zip(usable, parsed.error, strict=True) if e} if usable else {}
    out, titles, taken, headers, kinds = [dict(r) for r in records], [], set(), set(), Counter(attempted=len(usable), skipped=len(records) - len(usable), failed=len(broken))
    for i, error in broken.items():
        out[i] |= {"source": "original", "errors": [error]}
    for i in (i for i in usable if i not in broken):
        asked = []
        for title, why in _proposals(namer, records[i], titles, range(seed + i, seed + i + (retries + 1) * len(records), len(records))):
            asked.append((title, why))
            if why is None:
                break
        ended = asked[-1][0] is None and ":" in (asked[-1][1] or "")  # the namer itself failed
        title = None if ended else next((t for t, _ in reversed(asked) if t), None)
        header, settings, melody = records[i]["rtttl"].rsplit(":", 2)
        own = sanitize(records[i].get("name"))[0] or compact(records[i].get("name"))
        (full, numbered_title), = unique([title or own], MAX_TITLE, " ", taken)
        kept = header if title is None and re.fullmatch(r"[A-Za-z0-9 _-]{1,%d}" % MAX_NAME, header) else compact(full)
        (short, numbered_name), = unique([kept], MAX_NAME, "", headers)
        titles.append(full)
        kinds.update({"named": title is not None, "failed": title is None, "disambiguated": numbered_title or numbered_name})
        out[i] |= {"title": full, "name": short, "rtttl": f"{short}:{settings}:{melody}", "source": "original" if title is None else "model", "errors": [w for _, w in asked if w]}
    return out, {k: int(kinds[k]) for k in ("attempted", "named", "failed", "disambiguated", "skipped")}


#: Words of titles from measured character (fixed values): by tempo (below 90, from 140, between), by register and by leaps.
TEMPO_WORDS = {
    "slow": "Quiet Drifting Velvet Distant Gentle Silver Hushed Tender".split(),
    "fast": "Electric Dancing Restless Swift Spiraling Flying Flashing Bright".split(),
    "middle": "Amber Wandering Golden Rolling Shimmering Glowing Winding Open".split(),
}
THING_WORDS = {
    "high": "Sparks Stars Lanterns Fireflies Kites Comets Bells Feathers".split(),
    "wide": "Flight Horizons Summits Bridges Arches Canyons Wings Heights".split(),
    "near": "Tides Footsteps Paths Ripples Rivers Gardens Waves Trails".split(),
}
TIMES = ("", "Morning ", "Evening ", "Midnight ")
HIGH_PITCH, WIDE_STEP, SLOW, FAST = 84, 5, 90, 140


def characteristic(songs: DataFrame) -> DataFrame:
    """rec_no, title of songs(rec_no, bpm, events): a title from tempo, register and leaps, of which the song's hash picks one of 256."""
    p = sounded(F.col("events"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(a), F.lit(0))
    words = lambda table, key: F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), key)
    pace = F.when(F.col("bpm") < SLOW, "slow").when(F.col("bpm") >= FAST, "fast").otherwise("middle")
    thing = F.when(mean(p) >= HIGH_PITCH, "high").when(mean(F.transform(successive(p), F.abs)) >= WIDE_STEP, "wide").otherwise("near")
    made = songs.select("rec_no", pace.alias("pace"), thing.alias("thing"), F.conv(F.substring(F.md5(F.concat_ws(":", "bpm", json_events(F.col("events")))), 1, 4), 16, 10).cast("int").alias("h"))
    pick = lambda a, i: F.element_at(a, (i + 1).cast("int"))
    return made.select("rec_no", F.concat(pick(words(TEMPO_WORDS, F.col("pace")), F.col("h") % 8), F.lit(" "), pick(F.array(*map(F.lit, TIMES)), F.floor(F.col("h") / 64) % 4), pick(words(THING_WORDS, F.col("thing")), F.floor(F.col("h") / 8) % 8)).alias("title"))
