"""Finding repeated windows of fixed length in a corpus: anchors, segments, shards.

Every window (so many bytes, or words) is routed by the smallest hash of its k-grams: equal windows have
equal anchors. Runs of windows with one anchor form a segment. Anchors seen only once in the corpus are
dropped at once (most are), the remaining segments are collapsed by content, and all segments of an anchor
meet in one shard, whose index (a callable of the operator) gives for each window what its other
occurrences are. An anchor with more than ``SPLIT`` distinct segments would make a shard large: its segments
are cut where they leave one of them, and what is common still by longer grams, step by step up to whole
windows, so that each of its windows goes to the shard of a rarer anchor. All windows are judged by the shards' index; a task sees bounded groups whatever the
skew, and copies only raise a counter before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, materialize, text_slices, trim

SPLIT = 500  # distinct segments of an anchor that one shard takes
MANY = 20000  # distinct segments of an anchor from which three symbols tell too few apart
NEVER = 1 << 30
PIECE = 1024  # windows of a segment at most
SPANS = "sd binary, runs array<struct<off int, n int, first long>>"
FINER = {"anchor": pa.int64(), "sd": pa.binary(), "seg": pa.binary(), "cnt": pa.int64(), "first": pa.int64(), "up": pa.binary(), "at": pa.list_(pa.int32()), "times": pa.int64()}
ODD = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * MIX
        x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k-gram of 64-bit symbols (polynomial, then mixed)."""
    n = len(symbols)
    if n < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols * _powers(ODD, n), out=total[1:])
        return _mixed((total[k:] - total[:-k]) * _powers(INVERSE, n - k + 1))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours: minima from the left and from the right within blocks of w."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


@dataclass(frozen=True)
class Unit:
    """What windows are made of. ``symbols`` gives a document's 64-bit symbols and what ``cut`` needs to give
    the bytes of symbols a..b; ``split`` cuts a segment's bytes into symbols that ``==`` tells apart."""

    window: int
    k: int
    symbols: Callable[[bytes], tuple[np.ndarray, object]]
    cut: Callable[[bytes, object, int, int], bytes]

    @property
    def longer(self) -> Unit | None:
        """The same windows with anchors of longer grams: most of the way to the window, at last the window itself.
        What a common passage leaves are windows over its ends; each step goes through them again, so steps are few."""
        if self.k >= self.window:
            return None
        further = self.window - (self.window - self.k) // 8
        return replace(self, k=further if self.window - further > self.window // 24 else self.window)

    def runs(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, first window and number of windows of each run; and the hash of every k-gram."""
        grams = gram_hashes(symbols, self.k)
        least = sliding_min(grams, self.window - self.k + 1)
        if not len(least):
            return least, np.empty(0, np.int64), np.empty(0, np.int64), grams
        starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        return least[starts], starts, np.diff(np.append(starts, len(least))), grams


TABLE = _mixed(np.arange(1, 257, dtype=np.uint64) * ODD)


def byte_symbols(raw: bytes) -> tuple[np.ndarray, None]:
    return TABLE[np.frombuffer(raw, np.uint8)], None


def byte_cut(raw: bytes, _: object, a: int, b: int) -> bytes:
    return raw[a:b]


def word_symbols(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    tokens = raw.split()
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(t) for t in tokens], np.uint64), tokens


def word_cut(_: bytes, tokens: list[bytes], a: int, b: int) -> bytes:
    return b" ".join(tokens[a:b])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text): rows of one doc_id are told apart by ``key``, a digest of their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _twice(anchors: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct anchors, and 1 or 2 as each is once or more often among the grams."""
    own = np.unique(anchors)
    at = np.searchsorted(own, grams)
    hit = own[np.minimum(at, len(own) - 1)] == grams
    return own, np.minimum(2, np.bincount(at[hit], minlength=len(own)))


def _anchors(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found, times, place = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                anchors, _, _, grams = unit.runs(unit.symbols(text.encode())[0])
                if len(anchors):
                    own, n = _twice(anchors, grams)
                    found.append(own)
                    times.append(n)
                    place.append(np.full(len(own), i))
            if found:
                at = pa.array(np.concatenate(place))
                cols = [pa.array(np.concatenate(found).view(np.int64)), batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(np.concatenate(times).astype(np.int8))]
                yield pa.RecordBatch.from_arrays(cols, names=["anchor", "doc_id", "key", "times"])
        trim()

    return run


def _segments(unit: Unit):
    names = ["anchor", "sd", "seg", "doc_id", "key", "start", "n"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 4 << 20):
            cols: list[list] = [[] for _ in names]
            size = 0
            for doc_id, key, text, wanted in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
                raw = text.encode()
                symbols, how = unit.symbols(raw)
                anchors, starts, counts, _ = unit.runs(symbols)
                wanted = wanted.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for i in np.flatnonzero(np.isin(anchors, wanted)):
                    for at in range(0, int(counts[i]), PIECE):
                        n = min(PIECE, int(counts[i]) - at)
                        a = int(starts[i]) + at
                        seg = unit.cut(raw, how, a, a + n + unit.window - 1)
                        for c, x in zip(cols, (int(anchors[i].view(np.int64)), xxhash.xxh3_128_digest(seg), seg, doc_id, key, a, n), strict=True):
                            c.append(x)
                        size += len(seg)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
                    cols, size = [[] for _ in names], 0
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
        trim()

    return run


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _beside(unit: Unit):
    """Distinct segments of an anchor cut where they leave the anchor's reference, laid over it at the gram.

    A window goes by where it first differs from the reference, right of the gram or else left of it, and by the
    next symbols there: one, three if the window holds as many, or eight if so many segments have the anchor that
    three would be common still (``MANY``); by the anchor alone if it does not differ; and apart if it holds the
    gram twice. All of that is the window's own, so equal windows still meet. A segment over one end of a common
    passage makes three or four rows, whatever the number of its windows.
    """
    slack = unit.window - unit.k

    def parts(anchor: int, n: int, symbols: np.ndarray, left: np.ndarray, right: np.ndarray, steps: tuple) -> Iterator[tuple[int, int, bytes]]:
        """First window, end and name of each part."""
        at = np.flatnonzero(gram_hashes(symbols, unit.k) == np.uint64(anchor))
        windows = np.arange(n)
        low = np.searchsorted(at, windows)
        place = np.where(np.searchsorted(at, windows + slack, "right") - low > 1, -1, at[low])
        edges = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), n]
        for x, y in zip(edges, edges[1:], strict=False):
            p = int(place[x])
            if p < 0:
                yield x, y, b"twice"
                continue
            back, ahead = _alike(symbols[:p][::-1], left), _alike(symbols[p + unit.k :], right)
            b = p + unit.k + ahead  # the first symbol that differs on the right; windows from ``out`` on hold it
            a, out = p - back, b - unit.window + 1
            for q, to in reversed(steps):
                if (u := max(x, a + 1 - to)) < (v := min(y, out, a + 1 - q)):
                    yield u, v, b"l%d,%d," % (back, q) + symbols[a - q : a].tobytes()
            if (u := max(x, a)) < (v := min(y, out)):
                yield u, v, b"same"
            for q, to in steps:
                if (u := max(x, out + q - 1)) < (v := min(y, out + to - 1)):
                    yield u, v, b"r%d,%d," % (ahead, q) + symbols[b : b + q].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None,)
        for batch in text_slices(batches, 1 << 20):
            cols: list[list] = [[] for _ in FINER]
            size = 0
            for anchor, ref, many, sd, raw, cnt, first in zip(*(batch.column(c).to_pylist() for c in ("anchor", "ref", "many", "sd", "seg", "cnt", "first")), strict=True):
                anchor &= (1 << 64) - 1
                if known[0] != anchor:
                    base = unit.symbols(ref)[0]
                    p = int(np.flatnonzero(gram_hashes(base, unit.k) == np.uint64(anchor))[0])
                    known = anchor, base[:p][::-1], base[p + unit.k :], ((1, 3), (3, 8), (8, NEVER)) if many else ((1, 3), (3, NEVER))
                symbols, how = unit.symbols(raw)
                places: dict = {}
                for a, b, name in parts(anchor, len(symbols) - unit.window + 1, symbols, *known[1:]):
                    places.setdefault((name, unit.cut(raw, how, a, b + unit.window - 1)), []).append(a)
                for (name, seg), at in places.items():
                    finer = xxhash.xxh3_64_intdigest(name, anchor)
                    signed = finer - (1 << 64) if finer >> 63 else finer
                    times = cnt * len(at)
                    for c, x in zip(cols, (signed, xxhash.xxh3_128_digest(seg), seg, times, first, sd, at, times * (2 if name == b"twice" else 1)), strict=True):
                        c.append(x)
                    size += len(seg)
                if size > 2 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, FINER.values(), strict=True)], names=list(FINER))
                    cols, size = [[] for _ in FINER], 0
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, FINER.values(), strict=True)], names=list(FINER))
        trim()

    return run


def _finer(unit: Unit):
    """Distinct segments cut by the anchors of a longer gram: the same rows, with the segment they come from and
    their places in it. Text of a short period makes equal pieces at many places, which are one row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1 << 20):
            cols: list[list] = [[] for _ in FINER]
            size = 0
            for sd, raw, cnt, first in zip(*(batch.column(c).to_pylist() for c in ("sd", "seg", "cnt", "first")), strict=True):
                symbols, how = unit.symbols(raw)
                anchors, starts, counts, grams = unit.runs(symbols)
                own, times = _twice(anchors, grams)
                often = dict(zip(own.tolist(), times.tolist(), strict=True))
                places: dict = {}
                for anchor, a, n in zip(anchors.tolist(), starts.tolist(), counts.tolist(), strict=True):
                    places.setdefault((anchor, unit.cut(raw, how, a, a + n + unit.window - 1)), []).append(a)
                for (anchor, seg), at in places.items():
                    signed = anchor - (1 << 64) if anchor >> 63 else anchor
                    for c, x in zip(cols, (signed, xxhash.xxh3_128_digest(seg), seg, cnt * len(at), first, sd, at, cnt * len(at) * often[anchor]), strict=True):
                        c.append(x)
                    size += len(seg)
                if size > 2 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, FINER.values(), strict=True)], names=list(FINER))
                    cols, size = [[] for _ in FINER], 0
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, FINER.values(), strict=True)], names=list(FINER))
        trim()

    return run


def _listed(sd: pa.Array, begin: np.ndarray, off, n, first) -> pa.RecordBatch:
    """``SPANS``: the runs of each segment, which begin at ``begin`` in the arrays, as one row."""
    runs = pa.StructArray.from_arrays([pa.array(off, pa.int32()), pa.array(n, pa.int32()), pa.array(first, pa.int64())], names=["off", "n", "first"])
    return pa.RecordBatch.from_arrays([sd, pa.ListArray.from_arrays(pa.array(np.append(begin, len(runs)), pa.int32()), runs)], names=["sd", "runs"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sd, runs) with runs that touch and have one ``first`` as one run."""
    for batch in text_slices(batches):
        runs = batch.column("runs")
        if not len(own := np.repeat(np.arange(len(runs)), runs.value_lengths())):
            continue
        off, n, first = (c.to_numpy(zero_copy_only=False) for c in runs.flatten().flatten())
        order = np.lexsort((off, own))
        own, off, end, first = own[order], off[order], (off + n)[order], first[order]
        fresh = np.concatenate([[True], (own[1:] != own[:-1]) | (off[1:] > end[:-1]) | (first[1:] != first[:-1])])
        at = np.flatnonzero(fresh)
        begin = np.flatnonzero(np.concatenate([[True], own[at[1:]] != own[at[:-1]]]))
        yield _listed(batch.column("sd").take(pa.array(own[at[begin]])), begin, off[at], np.maximum.reduceat(end, at) - off[at], first[at])
    trim()


def _shards(index: Callable, unit: Unit, most_bytes: int):
    """Cut a partition sorted by anchor into shards at anchor borders and index each."""

    def solved(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sd, off, n, first = index(unit, rows)
        if len(off):
            begin = [i for i, x in enumerate(sd) if not i or x != sd[i - 1]]
            yield _listed(pa.array([sd[i] for i in begin], pa.binary()), np.array(begin), off, n, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= most_bytes and row[0] != last:
                    yield from solved(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[2])
                last = row[0]
        if rows:
            yield from solved(rows)
        trim()

    return run


def _moved(by: Column, old: str, new: str) -> Column:
    """``runs`` whose places count from where the place ``by`` does."""
    return F.transform("runs", lambda r: F.struct((by + r[old]).alias(new), r["n"].alias("n"), r["first"].alias("first")))


def _spans(distinct: DataFrame, unit: Unit, index: Callable, shard_bytes: int, *, gram: bool = True) -> DataFrame:
    """Runs of repeated windows of the distinct segments (anchor, sd, seg, cnt, first), as ``SPANS``, stored: one row
    for a segment, whatever the number of its parts, as each of its copies is joined with all of its rows.
    ``gram``: the anchors are hashes of the unit's grams, so that a hot one's segments can be laid over each other."""
    longer, cold, spans = unit.longer, distinct, None
    if longer is not None:
        hot = materialize(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT).select("anchor"), "hot")
        if hot.take(1):
            cold = distinct.join(hot, "anchor", "left_anti")
            schema = "anchor long, sd binary, seg binary, cnt long, first long, up binary, at array<int>, times long"
            warm = distinct.join(hot, "anchor", "left_semi")
            if gram:
                # The reference is a long one, so that it has what others have; which one it is changes no result.
                widest = F.max_by("seg", F.struct(F.least(F.length("seg"), F.lit(2 * unit.window - unit.k)), "cnt", "sd")).alias("ref")
                refs = materialize(warm.groupBy("anchor").agg(widest, (F.count(F.lit(1)) > MANY).alias("many")), "references")
                cut = materialize(distinct.join(refs, "anchor").select("anchor", "ref", "many", "sd", "seg", "cnt", "first").mapInArrow(_beside(unit), schema), "finer")
            else:
                cut = materialize(warm.select("sd", "seg", "cnt", "first").mapInArrow(_finer(longer), schema), "finer")
            # Equal pieces are one row before any join; a piece of an anchor seen once has no spans, so nothing is lifted to it.
            pieces = materialize(cut.groupBy("anchor", "sd", "seg").agg(F.sum("cnt").alias("cnt"), F.min("first").alias("first"), F.sum("times").alias("times")), "pieces")
            often = pieces.groupBy("anchor").agg(F.sum("times").alias("all")).filter(F.col("all") > 1).select("anchor")
            parts = materialize(pieces.join(often.hint("merge"), "anchor", "left_semi").drop("times"), "distinct")
            discard(pieces)
            found = _spans(parts, unit if gram else longer, index, shard_bytes, gram=False)
            # Files of these tables are a hundredth of their rows in memory, so their size must not lead to a broadcast.
            lifted = cut.select("sd", "up", "at").join(found.hint("merge"), "sd")
            moved = F.flatten(F.transform("at", lambda at: _moved(at, "off", "off")))
            spans = lifted.select(F.col("up").alias("sd"), moved.alias("runs")).groupBy("sd").agg(F.flatten(F.collect_list("runs")).alias("runs")).mapInArrow(_joined, SPANS)
    solved = cold.select("anchor", "sd", "seg", "cnt", "first").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_shards(index, unit, shard_bytes), SPANS)
    return materialize(solved if spans is None else solved.unionByName(spans), "spans")


def repeated_windows(rows: DataFrame, unit: Unit, index: Callable, *, across: bool, shard_bytes: int = 1 << 20) -> DataFrame:
    """(doc_id, key, runs): runs of windows (start, n, first) that occur elsewhere, with the smallest doc_id that has them;
    one row for each segment that has any.

    ``rows`` come from ``keyed``. ``across``: only windows that another row has too; else a second place in
    the same row counts. ``index(unit, segments)`` takes (anchor, sd, seg, cnt, first) rows of whole anchors.
    """
    emitted = materialize(rows.select("doc_id", "key", "text").mapInArrow(_anchors(unit), "anchor long, doc_id long, key long, times byte"), "anchors")
    if across:
        seen = emitted.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.min("doc_id").alias("c"), F.max("doc_id").alias("d")).filter("a <> b or c <> d")
    else:
        seen = emitted.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1")
    repeated = materialize(seen.select("anchor"), "repeated")
    wanted = emitted.join(repeated, "anchor").groupBy("doc_id", "key").agg(F.collect_set("anchor").alias("wanted"))
    found = rows.join(wanted.withColumnRenamed("doc_id", "own"), (rows.key == wanted.key) & F.col("doc_id").eqNullSafe(F.col("own"))).select("doc_id", rows.key, "text", "wanted")
    segments = materialize(found.mapInArrow(_segments(unit), "anchor long, sd binary, seg binary, doc_id long, key long, start long, n int"), "segments")
    distinct = materialize(segments.groupBy("anchor", "sd", "seg").agg(F.count(F.lit(1)).alias("cnt"), F.min("doc_id").alias("first")), "distinct")
    discard(emitted, repeated)
    spans = _spans(distinct, unit, index, shard_bytes)
    discard(distinct)
    placed = segments.select("sd", "doc_id", "key", "start").join(spans.hint("merge"), "sd")
    return placed.select("doc_id", "key", _moved(F.col("start"), "off", "start").alias("runs"))


def covered(starts: np.ndarray, counts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs [a, b) of symbols covered by the windows."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(zip(starts.tolist(), counts.tolist(), strict=True)):
        b = a + n + window - 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
