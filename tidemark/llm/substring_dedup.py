"""Substring dedup over words with suffix automata of reference shards.

A shard's reference passages go, smallest doc_id first, into one suffix automaton over words; each state
keeps the doc_id of the passage that made it, which is the smallest that has any of its strings. Passages are
then streamed through it for matching statistics: at each word the state of the longest match is shortened
along suffix links to the one that holds the last ``window`` words, and that state's doc_id says which
document had the window first. Sending every automaton to every document would cost the product of both, so
shards and the passages streamed through them are brought together by anchor instead (see ``repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.repeats import Unit, covered, keyed, repeated_windows, word_cut, word_symbols
from tidemark.llm.shared import text_slices, trim


class SuffixAutomaton:
    """Of several sequences; ``first`` of a state is what was given with the sequence that made it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length: int, moves: dict, first) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        self.first.append(first)
        return len(self.next) - 1

    def _split(self, p: int, symbol, q: int) -> int:
        """The state that holds q's strings no longer than p's plus one."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.first[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, symbols: list, first) -> None:
        nxt, link, length = self.next, self.link, self.length
        last = 0
        for s in symbols:
            q = nxt[last].get(s)
            if q is not None:  # known already: no new state, at most a split
                last = q if length[q] == length[last] + 1 else self._split(last, s, q)
                continue
            new = self._state(length[last] + 1, {}, first)
            p = last
            while p >= 0 and s not in nxt[p]:
                nxt[p][s] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][s]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, s, q)
            last = new

    def windows(self, symbols: list, window: int) -> Iterator[tuple[int, object]]:
        """Streams a sequence: for each place where the last ``window`` symbols occur in the automaton, the
        first symbol's place and the ``first`` of the state that holds exactly those symbols."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = size = 0
        for at, s in enumerate(symbols):
            while state and s not in nxt[state]:
                state = link[state]
                size = length[state]
            if s in nxt[state]:
                state, size = nxt[state][s], size + 1
            while state and length[link[state]] >= window:
                state = link[state]
                size = length[state]
            if size >= window:
                yield at - window + 1, first[state]


def shard_firsts(unit: Unit, rows: list[tuple]) -> tuple[list, list, list, list]:
    """Runs of windows with one first document, for each segment of a shard."""
    split = {sd: seg.split() for _, sd, seg, _, _ in rows}
    automaton = SuffixAutomaton()
    for _, sd, _, _, first in sorted((r for r in rows if r[4] is not None), key=lambda r: (r[4], r[1])):
        automaton.add(split[sd], first)
    out: tuple[list, list, list, list] = ([], [], [], [])
    for sd, symbols in split.items():
        begun = before = held = None
        for at, first in automaton.windows(symbols, unit.window):
            if begun is None or at != before + 1 or first != held:
                if begun is not None:
                    for c, x in zip(out, (sd, begun, before - begun + 1, held), strict=True):
                        c.append(x)
                begun, held = at, first
            before = at
        if begun is not None:
            for c, x in zip(out, (sd, begun, before - begun + 1, held), strict=True):
                c.append(x)
    return out


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = 12) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, text) of the documents, and (doc_id, key, spans) of those that lose words."""
    rows = keyed(docs, id_col, text_col)
    unit = Unit(window, min(k, window), word_symbols, word_cut)
    found = repeated_windows(rows, unit, shard_firsts, across=True, shard_bytes=1 << 18)
    own = found.withColumn("runs", F.filter("runs", lambda r: r["first"] < F.col("doc_id"))).filter(F.size("runs") > 0)
    return rows, own.groupBy("doc_id", "key").agg(F.flatten(F.collect_set("runs")).alias("spans"))


def kept_words(text: str, spans: list[dict] | None, window: int) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the kept words joined by one space."""
    tokens = text.encode().split()
    if spans is None or not len(spans):
        return len(tokens), 0, b" ".join(tokens)
    keep, at, removed = [], 0, 0
    for a, b in covered(np.array([s["start"] for s in spans]), np.array([s["n"] for s in spans]), window):
        keep += tokens[at:a]
        at, removed = b, removed + b - a
    return len(tokens), removed, b" ".join(keep + tokens[at:])


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, k: int = 12, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and key, kept) per row.

    A word goes if a window of ``window`` words that covers it also starts in a document with a smaller
    doc_id; windows are judged on the input. Null texts have no words; rows with a null doc_id neither lose
    words nor count as references; repeated rows are treated alike; an empty table gives no rows.
    """
    rows, spans = repeated_spans(docs, id_col=id_col, text_col=text_col, window=window, k=k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            got = [kept_words(t, s, window) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            cols = [batch.column("doc_id"), batch.column("key"), *(pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)), pa.array([hashlib.sha256(g[2]).hexdigest() for g in got], pa.string())]
            names = ["doc_id", "key", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                cols, names = [*cols, pa.array([g[2].decode() for g in got], pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        trim()

    schema = "doc_id long, key long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    joined = rows.join(spans.withColumnRenamed("doc_id", "own"), (rows.key == spans.key) & F.col("doc_id").eqNullSafe(F.col("own")), "left")
    out = joined.select(F.col("doc_id"), rows.key, "text", "spans").mapInArrow(run, schema)
    return out if keep_text else out.drop("key")


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", window: int = 50, k: int = 12) -> DataFrame:
    """``docs``, all columns, with repeated words taken out of the texts; rows left without a word go.

    A text that loses nothing stays as it was; of the others the kept words are joined by one space, and
    ``chars_col``, if there is one, is counted anew.
    """
    rows, spans = repeated_spans(docs, id_col=id_col, text_col=text_col, window=window, k=k)

    @F.arrow_udf("string")
    def rest(texts: pa.Array, found: pa.Array) -> pa.Array:
        kept = (kept_words(t.as_py(), s.as_py(), window)[2].decode() for t, s in zip(texts, found, strict=True))
        return pa.array(kept, pa.string())

    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    spans = spans.select(F.col("doc_id").alias("__own"), F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    joined = docs.withColumn("__of", key).join(spans, (F.col("__of") == F.col("__key")) & F.col(id_col).cast("long").eqNullSafe(F.col("__own")), "left")
    whole = joined.filter("__spans is null").select(*(F.col(c) for c in docs.columns))
    cut = joined.filter("__spans is not null").withColumn(text_col, rest(F.col(text_col), F.col("__spans"))).filter(F.length(text_col) > 0)
    if chars_col in docs.columns:
        cut = cut.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType))
    return whole.unionByName(cut.select(*(F.col(c) for c in docs.columns)))
