"""Vectorised parser of `name:settings:melody` records, run on Arrow batches.

Structure, cells and values are three passes over columns. The structural pass is pyarrow's CSV reader with `:` as
delimiter: rows with another number of columns go to its invalid-row callback, which tells records without sections
from records with colons in their name. Settings and notes are then columns of strings; each distinct cell is examined
once, its numbers are cast as a vector, and the cells that fail carry a code. The first failing cell of a record, in
the order in which the format's checks apply, gives the record's error.
"""

from __future__ import annotations

import io
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv

from tunewright.functions.events import DURATIONS, MAX_PITCH

#: Fixed values of the format: defaults, ranges, semitones of the letters.
DEFAULTS = {"d": 4, "o": 6, "b": 63}
OCTAVES, BPM = (4, 7), (25, 900)
SEMITONES = {"c": 0, "d": 2, "e": 4, "f": 5, "g": 7, "a": 9, "b": 11}
KEYS = ("d", "o", "b")

#: Error codes of settings and of notes, in the order of their checks (fixed values).
SETTING_ERRORS = ("", "malformed_default", "unsupported_default", "duplicate_default", "nonnumeric_default")
NOTE_ERRORS = ("", "empty_event", "ambiguous_underscore", "multiple_dots", "invalid_note_syntax", "invalid_duration", "sharp_rest", "invalid_octave", "pitch_out_of_range")
#: Warnings of notes, in the order in which one note raises them (fixed values).
NOTE_WARNINGS = ("underscore_interpreted_as_sharp", "dot_position_normalized", "prefix_sharp_normalized", "post_octave_sharp_normalized", "rest_octave_ignored", "enharmonic_sharp_normalized")

# what Arrow would read as the end of a line stays inside a field
_ESCAPES = str.maketrans({"\n": " ", "\r": " ", "\x00": " "})
_ENDS = re.compile(r"[\n\r\x00]")
_SETTING = re.compile(r"\s*([a-zA-Z0-9]+)\s*=\s*(.*?)\s*")
_BPM_SUFFIX = re.compile(r"(\d+)\s*bpm", re.I)
_CONCATENATED = re.compile(r"[dob]\s*=", re.I)
_NOTE = re.compile(r"(?P<len>\d*)(?:(?P<pre>#)(?P<l1>[a-g])(?P<o1>\d*)|(?P<l2>[a-g])(?P<o2>\d+)(?P<post>#)|(?P<l3>[a-gp])(?P<mid>#?)(?P<o3>\d*))")


@dataclass
class Parsed:
    """One entry per record of the batch; events are flattened with offsets."""

    error: list[str | None]
    detail: list[str | None]
    warnings: list[list[str]]
    name: list[str | None]
    values: np.ndarray  # d, o, b per record
    offsets: np.ndarray
    pitch: np.ndarray  # -1 for a rest
    duration: np.ndarray
    dotted: np.ndarray
    ok: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


def structure(texts: list[str]) -> tuple[list[tuple[str, str, str] | None], list[int]]:
    """Sections of each text, None where there are fewer than two colons; and how many columns each text has."""
    rows: list[tuple[str, str, str] | None] = [None] * len(texts)
    columns = [3] * len(texts)

    def invalid(row: csv.InvalidRow) -> str:
        i = int(row.text.partition(":")[0])
        columns[i] = row.actual_columns - 1
        if row.actual_columns > 4:  # the last two colons separate; the others belong to the name
            rows[i] = tuple(texts[i].rsplit(":", 2))
        return "skip"

    body = "\n".join(f"{i}:{t.translate(_ESCAPES)}" for i, t in enumerate(texts)).encode("utf-8", "replace") + b"\n"
    if texts:
        read = csv.read_csv(
            io.BytesIO(body),
            csv.ReadOptions(use_threads=False, block_size=len(body) + 1, column_names=["i", "name", "settings", "melody"]),
            csv.ParseOptions(delimiter=":", quote_char=False, escape_char=False, newlines_in_values=False, ignore_empty_lines=False, invalid_row_handler=invalid),
            csv.ConvertOptions(column_types={c: pa.string() if c != "i" else pa.int64() for c in ("i", "name", "settings", "melody")}, strings_can_be_null=False),
        )
        for i, *fields in zip(*(c.to_pylist() for c in read.columns), strict=True):
            rows[i] = tuple(fields) if not _ENDS.search(texts[i]) else tuple(texts[i].rsplit(":", 2))
    return rows, columns


def _digits(text: str) -> bool:
    return re.fullmatch(r"\d+", text) is not None


def _setting(cell: str) -> tuple[int, int, int, bool, str]:
    """Key (-1 if none), error, value (-1 if it isn't an int32), suffix removed, detail."""
    m = _SETTING.fullmatch(cell)
    if not m:
        return -1, 1, -1, False, repr(cell)
    key, value = m[1].lower(), m[2]
    if key not in KEYS:
        return -1, 2, -1, False, f"{key}={value}"
    suffix = _BPM_SUFFIX.fullmatch(value) if key == "b" else None
    if suffix:
        value = suffix[1]
    if not _digits(value):
        return KEYS.index(key), 4, -1, bool(suffix), f"{key}={value}"
    return KEYS.index(key), 0, min(int(value), 2**31 - 1), bool(suffix), value


def _number(digits: str, missing: int) -> int:
    return min(int(digits), 2**31 - 1) if digits else missing


def _note(token: str, underscore: bool) -> tuple[int, int, int, int, bool, int]:
    """error, duration (0 = default), semitone with sharp (-1 = rest), octave (-1 = default), dotted, warning bits."""
    fail = lambda code: (NOTE_ERRORS.index(code), 0, -1, -1, False, 0)
    if not token:
        return fail("empty_event")
    bits = 0
    if "_" in token:
        if not underscore:
            return fail("ambiguous_underscore")
        token, bits = token.replace("_", "#"), 1
    dots = token.count(".")
    if dots > 1:
        return fail("multiple_dots")
    if dots and token[-1] != ".":
        bits |= 2
    m = _NOTE.fullmatch(token.replace(".", ""))
    if not m:
        return fail("invalid_note_syntax")
    letter, sharp = m["l1"] or m["l2"] or m["l3"], bool(m["pre"] or m["post"] or m["mid"])
    octave = m["o1"] or m["o2"] or m["o3"] or ""
    if m["post"] and letter == "p":
        return fail("invalid_note_syntax")
    bits |= (4 if m["pre"] else 0) | (8 if m["post"] else 0)
    duration = _number(m["len"], 0)
    if m["len"] and duration not in DURATIONS:
        return fail("invalid_duration")
    if letter == "p" and sharp:
        return fail("sharp_rest")
    if octave and not OCTAVES[0] <= int(octave) <= OCTAVES[1]:
        return fail("invalid_octave")
    if letter == "p":
        return 0, duration, -1, -1, bool(dots), bits | (16 if octave else 0)
    return 0, duration, SEMITONES[letter] + sharp, _number(octave, -1), bool(dots), bits | (32 if sharp and letter in "be" else 0)


def _cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Offsets of each text's comma-separated cells, text of each cell, distinct cells, and each cell's distinct number."""
    split = pc.split_pattern(pa.array(texts, pa.large_string()), ",")
    off = split.offsets.to_numpy().astype(np.int64)
    flat = split.flatten()
    coded = flat.dictionary_encode()
    return off, np.repeat(np.arange(len(texts)), np.diff(off)), coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _first(rows: np.ndarray, bad: np.ndarray, n: int) -> np.ndarray:
    """Index of the first bad cell of each row, -1 if there is none."""
    out = np.full(n, -1, np.int64)
    at = np.flatnonzero(bad)[::-1]
    out[rows[at]] = at
    return out


def parse(texts: list[str | None], underscore: np.ndarray) -> Parsed:
    """Parse a batch. A null text counts as an empty record. underscore: where `_` may stand for `#`."""
    n = len(texts)
    trimmed = [(t or "").strip().lstrip("\ufeff") for t in texts]
    sections, _ = structure(trimmed)
    error: list[str | None] = [None] * n
    detail: list[str | None] = [None] * n
    warnings: list[list[str]] = [[] for _ in range(n)]
    names: list[str | None] = [None] * n

    def fail(i: int, code: str, why: str) -> None:
        error[i], detail[i] = code, why

    alive = []
    for i, s in enumerate(sections):
        if not trimmed[i]:
            fail(i, "empty_record", "record contains no RTTTL")
        elif s is None:
            fail(i, "missing_sections", "expected name:defaults:melody")
        else:
            name = s[0].strip()
            if ":" in name:
                if _CONCATENATED.search(name):
                    fail(i, "concatenated_records", "multiple RTTTL headers in one record")
                    continue
                warnings[i].append("colon_in_name")
            if not name:
                name = "Untitled"
                warnings[i].append("empty_name_replaced")
            if len(name) > 11:
                warnings[i].append("long_name_preserved_in_metadata")
            if not name.isascii():
                warnings[i].append("unicode_name_preserved_in_metadata")
            names[i] = name
            alive.append(i)

    # settings: one vector of keys, one of values, one of codes over all cells
    values = np.tile(np.array([DEFAULTS[k] for k in KEYS], np.int64), (n, 1))
    found = np.zeros((n, 3), bool)
    some = [i for i in alive if sections[i][1].strip()]
    if some:
        off, row, distinct, code = _cells([sections[i][1] for i in some])
        known = [_setting(c) for c in distinct]
        key, bad, value = (np.array([k[j] for k in known], np.int64)[code] for j in range(3))
        slot = np.where(key >= 0, row * 3 + key, -1)
        repeat = np.zeros(len(slot), bool)
        held = np.flatnonzero(slot >= 0)
        _, first = np.unique(slot[held], return_index=True)
        repeat[held] = True
        repeat[held[first]] = False
        bad = np.where(repeat, 3, bad)
        hit = _first(row, bad > 0, len(some))
        for j in np.flatnonzero(hit >= 0):
            c = known[code[hit[j]]]
            fail(some[j], SETTING_ERRORS[bad[hit[j]]], KEYS[c[0]] if bad[hit[j]] == 3 else c[4])
        good = held[first][bad[held[first]] == 0]
        at = np.array(some)[row[good]]
        values[at, key[good]] = value[good]
        found[at, key[good]] = True
        cut = np.array([k[3] for k in known])[code]
        for j in sorted(set(row[cut].tolist())):
            if hit[j] < 0:
                warnings[some[j]].append("bpm_suffix_removed")
    alive = [i for i in alive if error[i] is None]
    for i in alive:
        d, o, b = (int(x) for x in values[i])
        for j, k in enumerate(KEYS):
            if not found[i, j]:
                warnings[i].append(f"missing_default_{k}_resolved_{values[i, j]}")
        if d not in DURATIONS:
            fail(i, "invalid_default_duration", str(d))
        elif not OCTAVES[0] <= o <= OCTAVES[1]:
            fail(i, "invalid_default_octave", str(o))
        elif not BPM[0] <= b <= BPM[1]:
            fail(i, "invalid_bpm", str(b))

    # notes
    alive = [i for i in alive if error[i] is None]
    melodies = []
    for i in alive:
        raw = sections[i][2].strip()
        bare = "".join(raw.split())
        if len(bare) != len(raw):
            warnings[i].append("melody_whitespace_removed")
        bare = bare.lower()
        if bare.endswith(","):
            bare = bare.rstrip(",")
            warnings[i].append("trailing_comma_removed")
        if not bare:
            fail(i, "empty_melody", "no events")
        else:
            melodies.append((i, bare))
    counts = np.zeros(n, np.int64)
    pitch = duration = np.zeros(0, np.int64)
    dotted = np.zeros(0, bool)
    if melodies:
        at = np.array([i for i, _ in melodies])
        off, row, distinct, code = _cells([m for _, m in melodies])
        # a cell means something else where `_` stands for `#`; only cells with `_` are examined twice
        opted = underscore[at][row]
        plain, sharp = [_note(t, False) for t in distinct], [_note(t, True) if "_" in t else None for t in distinct]
        table = np.array(plain + [s or p for s, p in zip(sharp, plain, strict=True)], np.int64)
        cell = table[code + opted * len(distinct)]
        bad, duration, semitone, octave, dot, bits = cell.T
        duration = np.where(duration > 0, duration, values[at, 0][row])
        octave = np.where(octave >= 0, octave, values[at, 1][row])
        pitch = np.where(semitone >= 0, 12 * (octave + 1) + semitone, -1)
        bad = np.where((bad == 0) & (pitch > MAX_PITCH), len(NOTE_ERRORS) - 1, bad)
        hit = _first(row, bad > 0, len(melodies))
        for j in np.flatnonzero(hit >= 0):
            fail(int(at[j]), NOTE_ERRORS[bad[hit[j]]], f"event {hit[j] - off[j] + 1}: {distinct[code[hit[j]]]}")
        seen = [(_first(row, (bits >> w & 1) > 0, len(melodies)), w) for w in range(len(NOTE_WARNINGS))]
        some = np.flatnonzero(np.any([f >= 0 for f, _ in seen], axis=0) & (hit < 0))
        for j in some:
            warnings[at[j]].extend(NOTE_WARNINGS[w] for _, w in sorted((f[j], w) for f, w in seen if f[j] >= 0))
        keep = (hit < 0)[row]
        pitch, duration, dotted = pitch[keep], duration[keep], dot[keep] > 0
        counts[at[hit < 0]] = np.diff(off)[hit < 0]
    ok = np.array([e is None for e in error], bool)
    return Parsed(error, detail, warnings, names, values, np.concatenate([[0], np.cumsum(counts)]), pitch, duration, dotted, ok)


EVENT = pa.struct([("pitch", pa.int32()), ("duration", pa.int32()), ("dotted", pa.bool_())])


def events_array(p: Parsed) -> pa.Array:
    """Events of each record as a list column; null where the record was rejected."""
    rest = pa.array(p.pitch.astype(np.int32), mask=p.pitch < 0)
    flat = pa.StructArray.from_arrays([rest, pa.array(p.duration.astype(np.int32)), pa.array(p.dotted)], fields=list(EVENT))
    offsets = pa.array(p.offsets.astype(np.int32), mask=np.concatenate([~p.ok, [False]]))
    return pa.ListArray.from_arrays(offsets, flat)
