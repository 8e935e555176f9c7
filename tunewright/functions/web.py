"""The stricter web dialect of the text format: 64ths and the letter h are known, prefix sharps, warnings and guesses are not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunewright.functions.events import DURATIONS, MAX_PITCH, MIN_PITCH
from tunewright.functions.parse import BPM, OCTAVES

#: Fixed values of the dialect: longest text, name, melody (events) and song (seconds); its own default duration.
MAX_TEXT, MAX_NAME, MAX_EVENTS, MAX_SECONDS, DEFAULT_DURATION = 65536, 256, 2048, 300, 8
WEB_DURATIONS = (*DURATIONS, 64)
_NOTE = r"^(\d*)([a-ghp])(#?)(\.?)([4-7]?)(\.?)$"
_SETTING = r"^\s*([dobDOB])\s*=\s*(\d+)\s*$"


def parsed(raw: Column) -> Column:
    """STRUCT<error, name, bpm, events, seconds>; error is null for a legal text. Pure expressions, one pass over the notes.

    Checks go in the order text size, sections, settings, ranges, notes, length; the first that fails is the error.
    """
    text = F.regexp_replace(raw, r"^\x{FEFF}?\s*|\s*$", "")
    tail = F.substring_index(text, ":", -2)
    head = F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(tail) - 1), r"^\s+|\s+$", "")
    name = F.when(head == "", "Untitled").otherwise(head)
    cells = F.when(F.trim(F.substring_index(tail, ":", 1)) == "", F.array().cast("array<string>")).otherwise(F.split(F.substring_index(tail, ":", 1), ","))
    keys = F.transform(cells, lambda c: F.lower(F.regexp_extract(c, _SETTING, 1)))
    value = lambda c: F.regexp_extract(c, _SETTING, 2).try_cast("int")
    # a number too large for an int counts as out of range
    pick = lambda k, default: F.coalesce(F.try_element_at(F.transform(F.filter(cells, lambda c: F.lower(F.regexp_extract(c, _SETTING, 1)) == k), lambda c: F.coalesce(value(c), F.lit(-1))), F.lit(1)), F.lit(default))
    tokens = F.split(F.lower(F.regexp_replace(F.regexp_replace(F.substring_index(tail, ":", -1), r"\s+", ""), ",+$", "")), ",")
    state = F.struct(text.alias("text"), name.alias("name"), cells.alias("cells"), keys.alias("keys"), pick("d", 4).alias("d"), pick("o", 6).alias("o"), pick("b", 63).alias("b"), tokens.alias("tokens"))

    def build(s: Column) -> Column:
        def event(t: Column) -> Column:
            letter, sharp = F.regexp_extract(t, _NOTE, 2), F.regexp_extract(t, _NOTE, 3) == "#"
            length, octave = F.regexp_extract(t, _NOTE, 1), F.regexp_extract(t, _NOTE, 5)
            duration = F.when(length == "", s["d"]).otherwise(length.try_cast("int"))
            semitone = F.when(letter == "c", 0).when(letter == "d", 2).when(letter == "e", 4).when(letter == "f", 5).when(letter == "g", 7).when(letter == "a", 9).when(letter.isin("b", "h"), 11)
            pitch = F.when(letter != "p", 12 * (F.when(octave == "", s["o"]).otherwise(octave.try_cast("int")) + 1) + semitone + sharp.cast("int"))
            dots = F.length(F.concat(F.regexp_extract(t, _NOTE, 4), F.regexp_extract(t, _NOTE, 6)))
            why = (
                F.when(~F.rlike(t, F.lit(_NOTE)) | (dots > 1), "invalid_note").when(~F.coalesce(duration.isin(*WEB_DURATIONS), F.lit(False)), "invalid_duration")
                .when((letter == "p") & sharp, "sharp_rest").when(pitch > MAX_PITCH, "pitch_out_of_range")
            )
            return F.struct(why.alias("why"), pitch.cast("int").alias("pitch"), duration.alias("duration"), (dots > 0).alias("dotted"))

        events = F.transform(s["tokens"], event)
        return F.struct(s.alias("s"), events.alias("e"))

    def judge(x: Column) -> Column:
        s, e = x["s"], x["e"]
        seconds = F.aggregate(e, F.lit(0.0), lambda a, v: a + F.coalesce(F.lit(240.0) / s["b"] / v["duration"] * F.when(v["dotted"], 1.5).otherwise(1.0), F.lit(0.0)))
        first = F.try_element_at(F.filter(F.transform(e, lambda v: v["why"]), lambda w: w.isNotNull()), F.lit(1))
        colons = F.length(s["text"]) - F.length(F.replace(s["text"], F.lit(":"), F.lit("")))
        error = (
            F.when(F.length(raw) > MAX_TEXT, "too_large").when(colons < 2, "missing_sections").when((colons > 2) & F.rlike(s["name"], F.lit(r"(?i)[dob]\s*=")), "concatenated_records")
            .when(F.length(s["name"]) > MAX_NAME, "long_name").when(F.exists(s["cells"], lambda c: ~F.rlike(c, F.lit(_SETTING))), "malformed_default")
            .when(F.size(F.array_distinct(s["keys"])) < F.size(s["keys"]), "duplicate_default").when(~F.coalesce(s["d"].isin(*WEB_DURATIONS), F.lit(False)), "invalid_default_duration")
            .when(~F.coalesce(s["o"].between(*OCTAVES), F.lit(False)), "invalid_default_octave").when(~F.coalesce(s["b"].between(*BPM), F.lit(False)), "invalid_bpm")
            .when(F.element_at(s["tokens"], 1) == "", "empty_melody").when(F.size(s["tokens"]) > MAX_EVENTS, "too_many_events").when(first.isNotNull(), first).when(seconds > MAX_SECONDS, "too_long")
        )
        ok = error.isNull()
        events = F.transform(e, lambda v: F.struct(v["pitch"].alias("pitch"), v["duration"].alias("duration"), v["dotted"].alias("dotted")))
        return F.struct(error.alias("error"), F.when(ok, s["name"]).alias("name"), F.when(ok, s["b"]).alias("bpm"), F.when(ok, events).alias("events"), F.when(ok, seconds).alias("seconds"))

    built = F.transform(F.array(state), build)
    return F.element_at(F.transform(built, judge), 1)


def encodable(bpm: Column, events: Column) -> Column:
    """True if the web dialect can hold the song: lengths known to it, pitches in range, not too many events."""
    legal = F.forall(events, lambda e: e["duration"].isin(*WEB_DURATIONS) & (e["pitch"].isNull() | e["pitch"].between(MIN_PITCH, MAX_PITCH)))
    return bpm.between(*BPM) & (F.size(events) > 0) & (F.size(events) <= MAX_EVENTS) & legal
