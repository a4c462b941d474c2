"""Suffix-array dedup over bytes with a run-length index.

For a shard's segments the Burrows-Wheeler transform is built from their suffixes, sorted by as many bytes as a
window needs, and kept by its runs: the byte and first row of each, with suffix-array samples at both sides of
every run border and the match length across it. Positions whose whole sorted context occurs again are kept as
saturated. Inside a run a suffix's match with its neighbour is one shorter per byte, so streaming the text
from sample to sample gives every position's matching statistic, the longest match with any other place in
the shard, up to the sorted depth. The samples are as few as the runs, and repetitive text has few. Positions
whose statistic reaches the window's length are marked. Patterns are counted by backward search over the runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.repeats import Unit, byte_cut, byte_symbols, covered, keyed, repeated_windows
from tidemark.llm.shared import text_slices, trim

FIRST = 7  # bytes of a position that the first sort takes


class RunLengthIndex:
    """Of a list of byte strings; no match crosses a string's end. Matches are told up to ``depth`` bytes, which
    is the least FIRST * 2**n from ``least`` on."""

    def __init__(self, texts: list[bytes], least: int = 200):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.n = n = len(self.text)
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        self.left = self.starts[self.owner + 1] - np.arange(n)  # bytes from each position to its string's end
        self.depth = FIRST
        while self.depth < least:
            self.depth *= 2
        order, fresh, levels = self._sorted()
        # Runs: a string's first byte has a mark of its own before it.
        before = np.where(order == self.starts[self.owner[order]], 256 + self.owner[order], self.text[order - 1].astype(np.int64))
        borders = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.run_row = np.concatenate([[0], borders]) if n else borders
        self.run_byte = before[self.run_row]
        self.below, self.above = order[borders], order[borders - 1]
        self.match = self._common(self.below, self.above, fresh[borders], levels)
        self.saturated = order[~fresh | ~np.append(fresh[1:], True)]

    @property
    def runs(self) -> int:
        return len(self.run_row)

    def _packed(self) -> np.ndarray:
        """The next FIRST bytes of each position, each plus one, zero after the string's end."""
        out = np.zeros(self.n, np.uint64)
        for i in range(FIRST):
            out *= np.uint64(257)
            if i >= self.n:
                continue
            b = self.text[i:].astype(np.uint64) + np.uint64(1)
            b[self.left[: self.n - i] <= i] = 0
            out[: self.n - i] += b
        return out

    def _sorted(self) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """Positions by their first ``depth`` bytes; where a row differs from the one above; the ranks of each
        width below that. Widths double, and only rows that still tie are sorted again."""
        n, levels, width = self.n, [], FIRST
        key = self._packed()
        order = np.argsort(key, kind="stable")
        key = key[order]
        fresh = np.ones(n, bool)
        fresh[1:] = key[1:] != key[:-1]
        bits, rows = max(1, (n + len(self.starts)).bit_length()), np.arange(n)
        while width < self.depth:
            group = np.maximum.accumulate(np.where(fresh, rows, 0))  # rank: where its group begins
            rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
            rank[order] = group
            levels.append((width, rank))
            tied = np.flatnonzero(~fresh | ~np.append(fresh[1:], True))
            if len(tied):
                at, g = order[tied], group[tied]
                further = np.where(self.left[at] > width, rank[np.minimum(at + width, n - 1)] + len(self.starts), self.owner[at])
                if 3 * bits <= 64:  # group, further and place in one number
                    packed = np.sort(((g << bits | further) << bits).view(np.uint64) | np.arange(len(tied), dtype=np.uint64))
                    by = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
                else:
                    by = np.lexsort((further, g))
                order[tied] = at[by]
                further, g = further[by], g[by]
                fresh[tied[1:]] = (g[1:] != g[:-1]) | (further[1:] != further[:-1])
            width *= 2
        return order, fresh, levels

    def _common(self, a: np.ndarray, b: np.ndarray, differ: np.ndarray, levels: list) -> np.ndarray:
        """Length of the common beginning of the suffixes at a and b within their strings; ``depth`` if they tie.
        One shorter than ``depth`` is a sum of each smaller width at most once, and some bytes."""
        most, length, last = np.minimum(self.left[a], self.left[b]), np.zeros(len(a), np.int64), self.n - 1
        for width, rank in reversed(levels):
            same = (length + width <= most) & (rank[np.minimum(a + length, last)] == rank[np.minimum(b + length, last)])
            length[same] += width
        for _ in range(FIRST):
            same = (length < most) & (self.text[np.minimum(a + length, last)] == self.text[np.minimum(b + length, last)])
            length[same] += 1
        return np.minimum(np.where(differ, length, self.depth), most)

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match with another, up to ``depth``, streamed from the samples."""
        reach = np.zeros(self.n, np.int64)
        reach[self.below] = self.below + self.match
        reach[self.above] = np.maximum(reach[self.above], self.above + self.match)
        reach[self.saturated] = self.saturated + np.minimum(self.left[self.saturated], self.depth)
        return np.minimum(np.maximum.accumulate(reach) - np.arange(self.n), self.depth)

    @cached_property
    def _search(self) -> tuple[dict, np.ndarray, np.ndarray]:
        """Runs of each byte with the rows of that byte before each; first rows by byte; strings that end in it."""
        sizes = np.diff(np.append(self.run_row, self.n))
        runs = {}
        for c in range(256):
            own = np.flatnonzero(self.run_byte == c)
            runs[c] = own, np.concatenate([[0], np.cumsum(sizes[own])])
        first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=256))])
        filled = self.starts[1:][self.starts[1:] > self.starts[:-1]]
        return runs, first, np.bincount(self.text[filled - 1], minlength=256)

    def count(self, pattern: bytes) -> int:
        """Occurrences of a pattern of 1 to ``depth`` bytes, by backward search over the runs."""
        if not 1 <= len(pattern) <= self.depth:
            raise ValueError("a pattern has 1 to depth bytes")
        runs, first, ends = self._search
        low, high = int(first[pattern[-1]]), int(first[pattern[-1] + 1])
        for c in reversed(pattern[:-1]):
            own, sums = runs[c]

            def rank(row: int) -> int:
                at = int(np.searchsorted(self.run_row, row, "right")) - 1
                k = int(np.searchsorted(own, at))
                inside = row - int(self.run_row[at]) if k < len(own) and own[k] == at else 0
                return int(sums[k]) + inside

            low, high = (int(first[c] + ends[c]) + rank(row) if row else int(first[c] + ends[c]) for row in (low, high))
            if low >= high:
                return 0
        return high - low


def shard_repeats(unit: Unit, rows: list[tuple]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that occur twice or more, for each segment of a shard."""
    index = RunLengthIndex([r[2] for r in rows], unit.window)
    often = np.array([r[3] > 1 for r in rows])
    marked = (index.left >= unit.window) & ((index.matching_statistics() >= unit.window) | often[index.owner])
    owner = np.where(marked, index.owner, -1)
    edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    stop = np.append(edge[1:], index.n)
    keep = owner[edge] >= 0
    edge, stop = edge[keep], stop[keep]
    whose = index.owner[edge]
    return [rows[i][1] for i in whose], edge - index.starts[whose], stop - edge, np.zeros(len(edge), np.int64)


def byte_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 200, k: int = 64, keep_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept) per row.

    A byte goes if a ``window``-byte string that covers it also starts anywhere else, in this row or another;
    overlaps count, all copies go, and strings are judged on the input. Null texts are empty; a null doc_id
    is a document like others; repeated rows repeat each other; an empty table gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    unit = Unit(window, min(k, window), byte_symbols, byte_cut)
    found = repeated_windows(rows, unit, shard_repeats, across=False)
    spans = found.groupBy("doc_id", "key").agg(F.flatten(F.collect_set("runs")).alias("spans")).withColumnRenamed("doc_id", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            made: list[tuple] = []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, keep, at, removed = text.encode(), [], 0, 0
                gone = covered(np.array([s["start"] for s in own]), np.array([s["n"] for s in own]), window) if own else []
                for a, b in gone:
                    keep.append(raw[at:a])
                    at, removed = b, removed + b - a
                kept = b"".join([*keep, raw[at:]])
                made.append((len(raw), removed, len(gone), hashlib.sha256(kept).hexdigest(), kept))
            cols = [batch.column("doc_id"), *(pa.array([m[i] for m in made], pa.int64()) for i in range(3)), pa.array([m[3] for m in made], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_bytes:
                cols, names = [*cols, pa.array([m[4] for m in made], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        trim()

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    joined = rows.join(spans, (rows.key == spans.key) & F.col("doc_id").eqNullSafe(F.col("own")), "left")
    return joined.select("doc_id", "text", "spans").mapInArrow(run, schema)
