"""Texts that were cut off: a structural completeness check against a baseline of each source.

Every text is read once by a stack automaton over its quotes, brackets, tags and escapes; the automaton also looks at
how the text ends: with a sentence's terminator, with a block that needs none (tune, list, signature line, tag line),
or in the open. Sources differ in style: where nearly all texts of a source end in the open, that alone says nothing,
and a text of it counts as cut only with further evidence: something unclosed or broken, or the source's field limit.

A field limit is a length, in characters or in bytes, at which texts pile up: several times as many different texts
break off there as at any length near it, and a good part of the texts that get that far end there. Both tests are
ratios, so they say the same of a source of any size, and copies of one text are no evidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tunewright.shared import materialize

#: From this share of open endings on a source's style is to leave the terminator out; the corpus's share weighs as much as PRIOR texts.
OPEN_STYLE, PRIOR = 0.9, 5
#: A field limit has STANDS_OUT times the open texts of any length within NEAR of it, and HELD of the texts that reach it end there.
STANDS_OUT, NEAR, HELD = 3, 32, 0.2
#: Bytes by which a text may fall short of a limit in bytes, as a cut may leave out a begun character.
SHORT = 3

_PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "„": "“"}
_MARKS = re.compile(r"[()\[\]{}“”«»„]|</?[A-Za-z][^<>]*>|<[A-Za-z/][^<>]*\Z|`{3}")
_END = re.compile(r"[.!?。！？؟।]['\"”’»“)\]}*_`]*\Z")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.|\[…\]|\[\.\.\.\])['\"”’»)\]]*\Z")
_LIST = re.compile(r"(?:[-*•·]|\d+[.)])\s+\S.*\Z")
_SIGNATURE = re.compile(r"(?:—|–|--|~)\s*\S.*\Z")
_TAGS = re.compile(r"(?:[^\W\d_]+:\s*\S.*[^\s,;:]|(?:#\w+\s*)+)\Z")
_SETTING = re.compile(r"\s*[A-Za-z]+\s*=[^=]*\Z")
_NOTE = re.compile(r"\d*[#_.]*[a-hp][#_.]*\d*[#_.]*\Z", re.I)
_ESCAPE = re.compile(r"(?:\\(?:x[0-9A-Fa-f]?|u[0-9A-Fa-f]{0,3})?|%[0-9A-Fa-f]?|&#?\w{0,8})\Z")
_VOID = {"br", "hr", "img", "input", "meta", "link", "p", "li", "td", "tr"}


def unclosed(text: str) -> bool:
    """True if the stack isn't empty at the end of the text, or the text ends inside a tag or a code fence."""
    stack: list[str] = []
    for m in _MARKS.finditer(text):
        x = m.group()
        if x[0] == "<":
            if x[-1] != ">":
                return True
            tag = re.match(r"</?([A-Za-z][\w-]*)", x)[1].lower()
            if x[1] == "/":
                if f"<{tag}" in stack:  # what the end tag skips was left open by style, not by a cut
                    del stack[len(stack) - 1 - stack[::-1].index(f"<{tag}") :]
            elif x[-2] != "/" and tag not in _VOID:
                stack.append(f"<{tag}")
        elif x == "```":
            stack.pop() if stack and stack[-1] == x else stack.append(x)
        elif stack and stack[-1] in _PAIRS and (x == _PAIRS[stack[-1]] or (stack[-1] == "„" and x == "”")):
            stack.pop()
        elif x in _PAIRS:
            stack.append(x)
    return bool(stack)


def whole_block(text: str) -> bool:
    """True if the last line is a whole list item, signature, tag line or tune, which end without a terminator.

    A list item, signature or tag line counts only below another line: a text that is nothing but such a line is read as prose.
    """
    head, newline, last = text.rpartition("\n")
    last = last.strip()
    if newline and (_LIST.match(last) or _SIGNATURE.match(last)):
        return True
    if newline and _TAGS.match(last) and "=" not in last:
        return ("," in last or last[0] == "#") or len(last) < 60
    before, _, melody = text.rpartition(":")  # a tune may be wrapped over any number of lines
    _, colon, settings = before.rpartition(":")
    if colon and all(map(_SETTING.match, settings.rstrip(", \n").split(","))):
        notes = re.sub(r"\s+", "", melody).rstrip(",").split(",")  # commas at the end are a spelling, not a cut
        return len(notes) > 1 and bool(_NOTE.match(notes[-1])) and sum(bool(_NOTE.match(n)) for n in notes) >= 0.8 * len(notes)
    return False


def ending(text: str) -> tuple[bool, bool, bool]:
    """open (neither terminator nor whole block), broken (cut mark, half a character, escape or tag), unclosed."""
    end = text.rstrip()
    broken = bool(_ELLIPSIS.search(end)) or end.endswith("�") or bool(_ESCAPE.search(end))
    whole = not broken and (bool(_END.search(end)) or whole_block(end))
    left = unclosed(end)
    return not whole, broken, left and not whole


def endings(documents: DataFrame) -> DataFrame:
    """doc_id, source, chars, bytes, open, broken, unclosed, digest of the text. Null and blank texts have no ending and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            flags = [ending(t) for t in texts]
            made = [pa.array([len(t) for t in texts], pa.int32()), pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int32())]
            made += [pa.array([f[i] for f in flags], pa.bool_()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *made, batch.column("digest")], names=["doc_id", "source", "chars", "bytes", "open", "broken", "unclosed", "digest"])

    rows = documents.where(F.col("text").isNotNull() & (F.trim("text") != "")).select("doc_id", "source", "text", F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(run, "doc_id bigint, source string, chars int, bytes int, open boolean, broken boolean, unclosed boolean, digest bigint")


def field_limits(rows: DataFrame) -> DataFrame:
    """source, unit (chars or bytes), length of the field limits in rows of endings().

    Copies are reduced to one row per text first; what is ordered afterwards is one row per source and length.
    """
    texts = rows.groupBy("source", "chars", "bytes", "digest").agg(F.max("open").alias("open"))
    each = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("length")) for u in ("chars", "bytes")])).alias("u")
    counted = texts.select("source", "open", each).groupBy("source", "u.unit", "u.length").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("open").cast("bigint")).alias("k"))
    w = Window.partitionBy("source", "unit").orderBy("length")
    around = F.greatest(*[F.coalesce(F.max("k").over(w.rangeBetween(a, b)), F.lit(0)) for a, b in ((-NEAR, -1), (1, NEAR))])
    longer = F.coalesce(F.sum("n").over(w.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    marked = counted.select("source", "unit", "length", "k", around.alias("around"), longer.alias("longer"))
    return marked.where((F.col("k") >= STANDS_OUT * (F.col("around") + 1)) & (F.col("k") >= HELD * (F.col("k") + F.col("longer")))).select("source", "unit", "length")


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, source, truncated, reason of every document with a text. Documents without source share one baseline."""
    rows = materialize(endings(documents), "p10_endings")
    style = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("open").cast("bigint")).alias("k"))
    corpus = rows.agg((F.sum(F.col("open").cast("bigint")) / F.count(F.lit(1))).alias("share"))  # one row
    share = (F.col("k") + PRIOR * F.col("share")) / (F.col("n") + PRIOR)
    style = style.join(F.broadcast(corpus)).select("source", (share >= OPEN_STYLE).alias("loose"))
    limits = materialize(field_limits(rows), "p10_limits")
    chars = limits.where("unit = 'chars'").select("source", F.col("length").alias("chars"), F.lit(True).alias("limit"))
    bytes_ = limits.where("unit = 'bytes'").select("source", F.explode(F.sequence(F.col("length") - SHORT, "length")).alias("bytes"), F.lit(True).alias("limit")).distinct()
    # open endings only are few; all else is decided without a join
    cut, same = rows.where("open").alias("x"), lambda t: F.col("x.source").eqNullSafe(F.col(f"{t}.source"))
    x = cut.join(style.alias("s"), same("s"), "left").join(chars.alias("c"), same("c") & (F.col("x.chars") == F.col("c.chars")), "left").join(bytes_.alias("b"), same("b") & (F.col("x.bytes") == F.col("b.bytes")), "left")
    at_limit = F.coalesce("c.limit", "b.limit", F.lit(False))
    reason = F.when(F.col("broken"), "broken").when(F.col("unclosed"), "unclosed").when(at_limit, "field limit").when(~F.coalesce("s.loose", F.lit(False)), "no terminator")
    found = x.select("doc_id", "x.source", reason.alias("reason"))
    rest = rows.where("NOT open").select("doc_id", "source", F.lit(None).cast("string").alias("reason"))
    return found.unionByName(rest).select("doc_id", "source", F.col("reason").isNotNull().alias("truncated"), "reason")


def rates(documents: DataFrame) -> DataFrame:
    """source, documents, truncated, rate."""
    n = F.sum(F.col("truncated").cast("bigint"))
    return judged(documents).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), n.alias("truncated"), (n / F.count(F.lit(1))).alias("rate"))
