"""The parser: error codes, normalisations, warnings, and nulls."""

import numpy as np
import pytest

from tunewright.functions.parse import parse
from tunewright.operators import audit

#: text and the code that it must get (fixed values of the format)
ERRORS = [
    ("", "empty_record"), ("  \n ", "empty_record"), (None, "empty_record"), ("abc", "missing_sections"), ("a:b", "missing_sections"), ("x:d=4:c\ny:d=4,o=5,b=100:c", "concatenated_records"),
    ("a:d:c", "malformed_default"), ("a:d=4,:c", "malformed_default"), ("a:x=1:c", "unsupported_default"), ("a:d=4,d=8:c", "duplicate_default"), ("a:b=fast:c", "nonnumeric_default"),
    ("a:d=3:c", "invalid_default_duration"), ("a:o=8:c", "invalid_default_octave"), ("a:b=24:c", "invalid_bpm"), ("a:b=99999999999999999999:c", "invalid_bpm"), ("a::", "empty_melody"), ("a::,,", "empty_melody"),
    ("a::c,,d", "empty_event"), ("a::c_", "ambiguous_underscore"), ("a::c..", "multiple_dots"), ("a::c?", "invalid_note_syntax"), ("a::3c", "invalid_duration"), ("a::p#", "sharp_rest"), ("a::p9", "invalid_octave"),
    ("a::c8", "invalid_octave"), ("a:o=7:b#", "pitch_out_of_range"), ("a::c##", "invalid_note_syntax"), ("a::#p", "invalid_note_syntax"),
]


@pytest.mark.parametrize(("text", "code"), ERRORS)
def test_error(text, code):
    p = parse([text], np.array([False]))
    assert p.error == [code]
    assert not p.ok[0]


def test_batch_equals_single():
    texts = [t for t, _ in ERRORS] + ["n:d=8,o=5,b=120bpm:c, d#.,4#e,8g6#,p5,e#", 'q"uo:te:o=5:c\r\nd']
    both = parse(texts, np.zeros(len(texts), bool))
    for i, t in enumerate(texts):
        assert parse([t], np.array([False])).error[0] == both.error[i]


def test_normalisations():
    p = parse(["Name:d=8,o=5,b=120 BPM: c , d.#,4#e,8g6#,p5,e#,,"], np.array([False]))
    assert p.error == [None]
    assert p.pitch.tolist() == [72, 75, 77, 92, -1, 77]
    assert p.duration.tolist() == [8, 8, 4, 8, 8, 8]
    assert p.dotted.tolist() == [False, True, False, False, False, False]
    assert p.warnings[0] == [
        "bpm_suffix_removed", "melody_whitespace_removed", "trailing_comma_removed", "dot_position_normalized", "prefix_sharp_normalized", "enharmonic_sharp_normalized", "post_octave_sharp_normalized", "rest_octave_ignored",
    ]


def test_underscore_where_opted_in():
    p = parse(["a:o=5:c_", "a:o=5:c_"], np.array([True, False]))
    assert p.error == [None, "ambiguous_underscore"]
    assert p.pitch.tolist() == [73]


def test_colons_belong_to_the_name():
    p = parse(["Part 1: Intro:d=4,o=5,b=90:c"], np.array([False]))
    assert p.name == ["Part 1: Intro"]
    assert "colon_in_name" in p.warnings[0]


def test_all_events_round_trip(spark):
    from pyspark.sql import functions as F

    from tunewright.functions import music
    from tunewright.functions.events import DURATIONS

    events = [(p, d, dot) for p in [None, *range(60, 108)] for d in DURATIONS for dot in (False, True)]
    song = spark.createDataFrame([(1, 120, events)], "rec_no long, bpm int, events array<struct<pitch:int,duration:int,dotted:boolean>>")
    text = song.select("rec_no", F.lit("x").alias("source"), F.lit("rtttl").alias("kind"), F.concat(F.lit("t:"), music.encoded(F.col("bpm"), F.col("events"))).alias("raw"))
    row = audit.audited(text, "rec_no").first()
    assert row.error is None
    assert [tuple(e) for e in row.events] == events


def test_audit_of_odd_rows(spark):
    schema = "rec_no long, source string, kind string, raw string, status string, form string"
    rows = [(1, None, "rtttl", None, None, "x"), (2, "a/rtttl3/b.txt", "rtttl", "a:o=5:c_", None, None), (3, "b", "empty", "", None, None), (4, "b", "unsupported", None, None, None), (5, "b", None, "a:o=5:c", None, None), (5, "b", None, "a:o=5:c", None, None), (6, "b", "rtttl", "bad", "rejected", None)]
    made = {(r.rec_no, r.error) for r in audit.rejects(spark.createDataFrame(rows, schema)).collect()}
    assert made == {(1, "empty_record"), (3, "empty_file"), (4, "unsupported_file_format")}
    assert audit.rejects(spark.createDataFrame([], schema)).count() == 0
    both = audit.audited(spark.createDataFrame(rows, schema), "rec_no", "form").where("status <> 'rejected'")
    assert sorted(r.rec_no for r in both.collect()) == [2, 5, 5]
