"""Scalar functions of events and songs as column expressions; all stay inside the JVM and need no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunewright.functions.events import MAX_PITCH, MIN_PITCH

#: Names of the twelve pitch classes (fixed values).
PITCH_NAMES = ("c", "c#", "d", "d#", "e", "f", "f#", "g", "g#", "a", "a#", "b")


def bound(value: Column, f) -> Column:
    """f(value) with value computed once per row. A lambda evaluates what it refers to from outside again for every entry;
    as the entry of a one-element array it is computed before."""
    return F.element_at(F.transform(F.array(value), f), 1)


def beats(e: Column) -> Column:
    """Length in quarter-note beats."""
    return F.lit(4.0) / e["duration"] * F.when(e["dotted"], 1.5).otherwise(1.0)


def seconds(e: Column, bpm: Column) -> Column:
    return beats(e) * 60.0 / bpm


def ticks(e: Column) -> Column:
    """Length in 128ths of a whole note."""
    return F.floor(F.floor(F.lit(128) / e["duration"]) * F.when(e["dotted"], 3).otherwise(2) / 2).cast("int")


def common_unit(values: Column) -> Column:
    """Greatest common divisor of an array of ticks. Ticks are 2**p or 3 * 2**p, so it is the least power of two among
    their factors, times three if three divides them all."""
    power = F.array_min(F.transform(values, lambda t: t.bitwiseAND(-t)))
    return power * F.when(F.forall(values, lambda t: t % 3 == 0), 3).otherwise(1)


def divisor(a: Column, b: Column) -> Column:
    """Greatest common divisor of two tick counts."""
    return common_unit(F.array(a, b))


def pitch_name(pitch: Column) -> Column:
    """C4 for 60; null for null."""
    names = F.array(*[F.lit(n.upper()) for n in PITCH_NAMES])
    return F.concat(F.element_at(names, pitch % 12 + 1), (F.floor(pitch / 12) - 1).cast("string"))


def frequency(pitch: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (pitch - 69) / F.lit(12.0))


def sounded(events: Column) -> Column:
    """Pitches of the notes that sound, in order."""
    return F.transform(F.filter(events, lambda e: e["pitch"].isNotNull()), lambda e: e["pitch"])


def successive(values: Column) -> Column:
    """Differences of successive entries; empty for fewer than two."""
    n = F.size(values)
    return F.when(n < 2, F.array().cast("array<int>")).otherwise(F.zip_with(F.slice(values, 2, F.greatest(n - 1, F.lit(0))), F.slice(values, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a))


def legal_shifts(events: Column, low: int, high: int) -> Column:
    """Transpositions between low and high that keep every pitch in range; [0] if nothing sounds."""
    p = sounded(events)
    fits = lambda r: F.filter(F.sequence(F.lit(low), F.lit(high)), lambda s: (r["lo"] + s >= MIN_PITCH) & (r["hi"] + s <= MAX_PITCH))
    return F.when(F.size(p) == 0, F.array(F.lit(0))).otherwise(bound(F.struct(F.array_min(p).alias("lo"), F.array_max(p).alias("hi")), fits))


def transposed(events: Column, shift: Column) -> Column:
    """Events moved by shift semitones; null if a pitch would leave the range."""
    p = sounded(events)
    ok = (F.size(p) == 0) | ((F.array_min(p) + shift >= MIN_PITCH) & (F.array_max(p) + shift <= MAX_PITCH))
    moved = lambda by: F.transform(events, lambda e: F.struct((e["pitch"] + by).cast("int").alias("pitch"), e["duration"].alias("duration"), e["dotted"].alias("dotted")))
    return F.when(ok, bound(shift, moved))


def edited(events: Column, start: int, stop: int, action: str, value: int | None = None) -> Column:
    """Events with the half-open range [start, stop) edited: transpose (by value), rest, note (rests become 72), duration
    (to value), dot (switched on or off by value). Null if the range is empty or leaves the melody."""

    def change(e: Column) -> Column:
        pitch, duration, dotted = e["pitch"], e["duration"], e["dotted"]
        if action == "transpose":
            pitch = (pitch + value).cast("int")
        elif action == "rest":
            pitch = F.lit(None).cast("int")
        elif action == "note":
            pitch = F.coalesce(pitch, F.lit(72))
        elif action == "duration":
            duration = F.lit(value)
        elif action == "dot":
            dotted = F.lit(bool(value))
        else:
            raise ValueError(action)
        return F.struct(pitch.alias("pitch"), duration.alias("duration"), dotted.alias("dotted"))

    made = F.transform(events, lambda e, i: F.when((i >= start) & (i < stop), change(e)).otherwise(F.struct(e["pitch"].alias("pitch"), e["duration"].alias("duration"), e["dotted"].alias("dotted"))))
    legal = F.forall(made, lambda e: e["pitch"].isNull() | e["pitch"].between(MIN_PITCH, MAX_PITCH))
    return F.when((F.size(events) >= stop) & F.lit(0 <= start < stop) & legal, made)


def json_events(events: Column) -> Column:
    """[[60,8,false],[null,4,true],..] without white space, as Python's json.dumps writes it."""
    one = lambda e: F.concat(F.lit("["), F.coalesce(e["pitch"].cast("string"), F.lit("null")), F.lit(","), e["duration"].cast("string"), F.lit(","), e["dotted"].cast("string"), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(events, one), ","), F.lit("]"))


def exact_fingerprint(bpm: Column, events: Column, tempo: bool = True) -> Column:
    """SHA-256 of the canonical JSON of (bpm, events)."""
    head = bpm.cast("string") if tempo else F.lit("null")
    return F.sha2(F.concat(F.lit("["), head, F.lit(","), json_events(events), F.lit("]")), 256)


def normal_form(events: Column) -> Column:
    """Pitches relative to the first that sounds and ticks over their common divisor, as canonical JSON."""
    first = F.coalesce(F.get(sounded(events), F.lit(0)), F.lit(0))
    head = F.struct(common_unit(F.transform(events, ticks)).alias("unit"), first.alias("first"))

    def text(h: Column) -> Column:
        one = lambda e: F.concat(F.lit("["), F.coalesce((e["pitch"] - h["first"]).cast("string"), F.lit("null")), F.lit(","), F.floor(ticks(e) / h["unit"]).cast("string"), F.lit("]"))
        return F.concat(F.lit("["), F.array_join(F.transform(events, one), ","), F.lit("]"))

    return bound(head, text)


def family_fingerprint(events: Column) -> Column:
    """SHA-256 of the normal form: the same for every transposition and uniform change of speed."""
    return F.sha2(normal_form(events), 256)


def modal(values: Column) -> Column:
    """Most frequent entry of a short array; of equals the one met first. Null if there is none."""
    kinds = F.array_distinct(values)
    counted = F.transform(kinds, lambda v, i: F.struct(F.size(F.filter(values, lambda x: x == v)).alias("n"), (-i).alias("first"), v.alias("v")))
    return F.array_max(counted)["v"]


def encoded(bpm: Column, events: Column) -> Column:
    """Settings and melody of the canonical text: the modal duration and octave are the defaults."""
    octave = lambda p: F.floor(p / 12).cast("int") - 1
    d = modal(F.transform(events, lambda e: e["duration"]))
    o = F.coalesce(modal(F.transform(sounded(events), octave)), F.lit(6))
    names = F.array(*[F.lit(n) for n in PITCH_NAMES])

    def text(s: Column) -> Column:
        def one(e: Column) -> Column:
            length = F.when(e["duration"] == s["d"], "").otherwise(e["duration"].cast("string"))
            own = F.when(octave(e["pitch"]) == s["o"], "").otherwise(octave(e["pitch"]).cast("string"))
            tone = F.when(e["pitch"].isNull(), F.lit("p")).otherwise(F.concat(F.element_at(names, e["pitch"] % 12 + 1), own))
            return F.concat(length, tone, F.when(e["dotted"], ".").otherwise(""))

        return F.concat(F.lit("d="), s["d"].cast("string"), F.lit(",o="), s["o"].cast("string"), F.lit(",b="), bpm.cast("string"), F.lit(":"), F.array_join(F.transform(events, one), ","))

    return bound(F.struct(d.alias("d"), o.alias("o")), text)


def longest_run(keys: Column) -> Column:
    """Longest run of equal entries; nulls are equal to each other. One pass, without an intermediate array."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when((a["run"] > 0) & a["last"].eqNullSafe(x), a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(keys, start, step, lambda a: a["best"])
