"""Column functions over events ARRAY<STRUCT<pitch INT, duration INT, dotted BOOLEAN>>; a null pitch is a rest.

The melody of a song is also handled as a string with one character per event. Two melodies are equal exactly if the
strings are, and edit distance, substrings and grouping then run inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model: lowest and highest pitch, note lengths as parts of a whole note.
MIN_PITCH, MAX_PITCH = 60, 107
DURATIONS = (1, 2, 4, 8, 16, 32)

CODES = (MAX_PITCH - MIN_PITCH + 2) * len(DURATIONS) * 2
#: First character of the melody alphabet; all CODES characters from here take two bytes of UTF-8.
FIRST_CHAR = 0x100


def event_code(e: Column) -> Column:
    """0 .. CODES - 1: pitch (0 is the rest), then duration, then dot. A null dot is no dot; null outside the domain."""
    exponent = F.when(e["duration"] == DURATIONS[0], F.lit(0))
    for i, d in enumerate(DURATIONS[1:], 1):
        exponent = exponent.when(e["duration"] == d, F.lit(i))
    step = F.when(e["pitch"].isNull(), F.lit(0)).when(e["pitch"].between(MIN_PITCH, MAX_PITCH), e["pitch"] - (MIN_PITCH - 1))
    return (step * len(DURATIONS) + exponent) * 2 + F.coalesce(e["dotted"].cast("int"), F.lit(0))

