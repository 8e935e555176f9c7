"""Evaluation texts inside training text, by a generalised suffix automaton over words.

The items' words are counted where they lie. Up to MAX_WORDS of them make one automaton, which is built on the driver, as
flat arrays, and sent to the executors; more items are dealt out to several automata, each of bounded size, through which
the corpus streams one after the other. The corpus goes through an automaton word by word: its state is the longest run of
words ending here that also stands in some item. Where that run reaches the given length, the items are those of the state
whose class holds the run's last `length` words. Documents are never shuffled, and a document of any length is read in one
pass.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunewright.shared import materialize

LENGTH = 12
#: Words of the items in one automaton, which has at most two states and three transitions a word, of 4 bytes each: 20 MB.
MAX_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters or digits, lower-cased."""
    return _WORD.findall(text.lower())


class Automaton:
    """Generalised suffix automaton of items (id, words), kept as flat arrays.

    The transitions of state s are words[first[s]:first[s + 1]], sorted, and the states they lead to; link and len are a
    state's suffix link and longest run. at[s] is the state that stands for the last `length` words of a match that ends in
    s, or -1; the items of the n-th such state are held[begins[n]:begins[n + 1]].
    """

    def __init__(self, items: list[tuple[int, list[str]]], length: int) -> None:
        self.ids: dict[str, int] = {}
        self._next: list[dict[int, int]] = [{}]
        self.link, self.len = array("i", [-1]), array("i", [0])
        ends: list[tuple[int, int]] = []
        for item, text in items:
            last = 0
            for w in text:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                ends.append((last, item))
        held: list[set[int]] = [set() for _ in self.link]
        for state, item in ends:
            held[state].add(item)
        by_length = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        for state in reversed(by_length):
            if self.len[self.link[state]] >= length:  # classes of shorter runs are never asked for
                held[self.link[state]] |= held[state]
        stands = [-1] * len(self.len)
        for state in by_length:
            if self.len[state] >= length:
                up = self.link[state]
                stands[state] = stands[up] if self.len[up] >= length else state
        number = {s: n for n, s in enumerate(sorted({s for s in stands if s >= 0}))}
        self.at = array("i", (number.get(s, -1) for s in stands))
        self.held, self.begins = array("q"), array("i", [0])
        for s in number:
            self.held.extend(sorted(held[s]))
            self.begins.append(len(self.held))
        self.first, self.words, self.to = array("i", [0]), array("i"), array("i")
        for own in self._next:
            for w in sorted(own):
                self.words.append(w)
                self.to.append(own[w])
            self.first.append(len(self.words))
        del self._next

    @classmethod
    def of(cls, parts: dict) -> Automaton:
        """An automaton from the vars() of another, which are what is broadcast."""
        self = cls.__new__(cls)
        vars(self).update(parts)
        return self

    @property
    def items(self) -> dict[int, list[int]]:
        return {n: list(self.held[self.begins[n] : self.begins[n + 1]]) for n in range(len(self.begins) - 1)}

    def _extend(self, last: int, c: int) -> int:
        if c in self._next[last]:
            q = self._next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        new = len(self.len)
        self._next.append({})
        self.link.append(0)
        self.len.append(self.len[last] + 1)
        p = last
        while p >= 0 and c not in self._next[p]:
            self._next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self._next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = len(self.len)
        self._next.append(dict(self._next[q]))
        self.link.append(self.link[q])
        self.len.append(self.len[p] + 1)
        self.link[q] = copy
        while p >= 0 and self._next[p].get(c) == q:
            self._next[p][c] = copy
            p = self.link[p]
        return copy

    def spans(self, text: list[str], length: int) -> Iterator[tuple[int, int, int]]:
        """item, first word, words: the maximal runs of the text that stand in an item. Runs of several items may overlap."""
        state = n = 0
        get, first, known, to, link, size, at = self.ids.get, self.first, self.words, self.to, self.link, self.len, self.at
        hits: list[tuple[int, int, int]] = []
        for i, w in enumerate(text):
            c = get(w)
            if c is None:
                state = n = 0
                continue
            while True:
                a, b = first[state], first[state + 1]
                k = a if b - a == 1 else bisect_left(known, c, a, b)
                if k < b and known[k] == c:
                    state, n = to[k], n + 1
                    break
                if not state:
                    n = 0
                    break
                state = link[state]
                n = size[state]
            if n >= length:
                # the match may be shorter than its state's longest run, but its last `length` words lie in at[state]
                own = at[state]
                hits.extend((item, i - length + 1, i + 1) for item in self.held[self.begins[own] : self.begins[own + 1]])
        hits.sort()
        for item, own in groupby(hits, key=lambda x: x[0]):
            first_word = end = None
            for _, a, b in own:
                if first_word is not None and a == end - length + 1:
                    end = b
                else:
                    if first_word is not None:
                        yield item, first_word, end - first_word
                    first_word, end = a, b
            yield item, first_word, end - first_word


def _groups(items: DataFrame, most: int) -> list[DataFrame]:
    """The items in groups of about `most` words, counted where they lie. A text alone may have more."""
    own = items.where("text IS NOT NULL").select("item_id", "text")
    total = own.agg(F.sum(F.size(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))).first()[0] or 0
    n = max(1, -(-total // most))
    return [own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g) for g in range(n)] if n > 1 else [own]


def _sent(group: DataFrame, length: int):
    rows = [(r[0], words(r[1])) for r in group.orderBy("item_id").collect()]  # a group's words are bounded
    return group.sparkSession.sparkContext.broadcast(vars(Automaton(rows, length)))


def spans(documents: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, digest (of the text), item_id, first_word, words, doc_words: the passages of at least `length` words that a document shares with an item.

    Null and empty texts share nothing; an item shorter than `length` words is never found. Repeated rows repeat the result.
    """
    groups = _groups(items, MAX_WORDS)
    out = None
    for group in groups:
        sent = _sent(group, length)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = Automaton.of(sent.value)
            for batch in batches:
                out: list[tuple[int, int, int, int, int, int]] = []
                for doc, digest, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "digest", "text")), strict=True):
                    if text:
                        found = words(text)
                        out.extend((doc, digest, item, first, n, len(found)) for item, first, n in automaton.spans(found, length))
                columns = np.array(out, np.int64).reshape(-1, 6).T
                yield pa.record_batch([pa.array(c) for c in columns], names=["doc_id", "digest", "item_id", "first_word", "words", "doc_words"])

        made = documents.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, "doc_id bigint, digest bigint, item_id bigint, first_word bigint, words bigint, doc_words bigint")
        if len(groups) > 1:  # one automaton at a time is held
            made = materialize(made, "p8_spans")
            sent.destroy()
        out = made if out is None else out.unionByName(made)
    return out


def leaks(documents: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, item_id of every document and item that share a passage."""
    return spans(documents, items, length).select("doc_id", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """item_id, split, documents, longest, coverage (greatest share of a document's words in passages of the item)."""
    each = spans(documents, items, length).groupBy("doc_id", "digest", "item_id", "doc_words").agg(F.max("words").alias("longest"), F.sum("words").alias("words"))
    found = each.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("longest").alias("longest"), F.max(F.col("words") / F.col("doc_words")).alias("coverage"))
    return found.join(items.select("item_id", "split"), "item_id")


def cleaned(documents: DataFrame, items: DataFrame, length: int = LENGTH, max_coverage: float = 0.5) -> DataFrame:
    """doc_id, text, removed_words of the documents that leak: the passages are taken out, and the text is null if more
    than max_coverage of its words had to go.

    Passages come from spans(); only documents that leak are read again. Repeated rows of a document repeat the result.
    """
    found = spans(documents, items, length).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("first_word", "words")).alias("passages"))  # of one document, bounded by its text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str | None, int]] = []
            for doc, text, passages in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "passages")), strict=True):
                low = (text or "").lower()
                at = [m.span() for m in _WORD.finditer(low)]
                gone = np.zeros(len(at), bool)
                for p in passages:
                    gone[p["first_word"] : p["first_word"] + p["words"]] = True
                if gone.any():
                    keep, last, base = [], 0, text if len(low) == len(text) else low
                    for dropped, own in groupby(range(len(at)), key=lambda i: bool(gone[i])):  # noqa: B023
                        if dropped:
                            own = list(own)
                            keep.append(base[last : at[own[0]][0]])
                            last = at[own[-1]][1]
                    out.append((doc, None if gone.mean() > max_coverage else "".join([*keep, base[last:]]), int(gone.sum())))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.int64())], names=["doc_id", "text", "removed_words"])

    return documents.select("doc_id", F.xxhash64("text").alias("digest"), "text").join(found, ["doc_id", "digest"]).select("doc_id", "text", "passages").mapInArrow(run, "doc_id bigint, text string, removed_words bigint")
