"""Bounded-space online packing of token ids into fixed-length sequences.

Each partition keeps at most ``open_windows`` unfinished sequences. A document goes best-fit into the window
that it leaves fullest; when it fits in none and no more may be opened, the fullest window is topped up with
a cut of the document and emitted, so it has no padding. What a partition still has open at its end is less
than ``open_windows`` sequences; these leftovers are merged over partitions, a bounded group of them per
task and round, and the last open sequence is cut into power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.piece_encoder import encoder
from tidemark.llm.shared import doc_rows, materialize, text_slices

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long"
#: Leftovers of so many partitions meet in one task: under FAN * seq_len ids.
FAN = 128


class Packer:
    """Places documents given as little-endian uint32 ids; ``sealed`` gathers finished sequences.

    A piece is [doc_id, start, ids, doc_tokens].
    """

    def __init__(self, seq_len: int, open_windows: int):
        self.seq_len, self.most = seq_len, open_windows
        self.open: list[list] = []  # [tokens, pieces]
        self.sealed: list[list] = []

    def add(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        while len(ids) >= self.seq_len:
            self.sealed.append([[doc_id, start, ids[: self.seq_len], doc_tokens]])
            start, ids = start + self.seq_len, ids[self.seq_len :]
        while len(ids):
            fits = [w for w in self.open if w[0] + len(ids) <= self.seq_len]
            if fits:
                window = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                window = [0, []]
                self.open.append(window)
            else:
                window = max(self.open, key=lambda w: w[0])
            n = min(len(ids), self.seq_len - window[0])
            window[1].append([doc_id, start, ids[:n], doc_tokens])
            window[0] += n
            start, ids = start + n, ids[n:]
            if window[0] == self.seq_len:
                self.sealed.append(window[1])
                self.open = [w for w in self.open if w is not window]

    def merge(self) -> list:
        """Join the open windows, cutting at full sequences; returns the pieces of the one that stays open."""
        rest = Packer(self.seq_len, 1)
        for _, pieces in sorted(self.open, key=lambda w: -w[0]):
            for p in pieces:
                rest.add(*p)
        self.sealed += rest.sealed
        self.open = rest.open
        return rest.open[0][1] if rest.open else []

    def powers(self) -> None:
        """Seal what is open as sequences whose lengths are powers of two."""
        pieces, left = self.merge(), self.open[0][0] if self.open else 0
        while left:
            size = 1 << (left.bit_length() - 1)
            own, need = [], size
            while need:
                doc_id, start, ids, total = pieces[0]
                n = min(need, len(ids))
                own.append([doc_id, start, ids[:n], total])
                pieces = pieces[1:] if n == len(ids) else [[doc_id, start + n, ids[n:], total], *pieces[1:]]
                need -= n
            self.sealed.append(own)
            left -= size
        self.open = []


def _rows(sequences: list[list], first_id: int, keep_ids: bool, part: int | None = None) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(9)]
    for k, pieces in enumerate(sequences):
        offset = 0
        for doc_id, start, ids, total in pieces:
            raw = np.ascontiguousarray(ids, "<u4").tobytes()
            for c, x in zip(cols, (doc_id, start, len(ids), zlib.crc32(raw), total, None if part is not None else first_id + k, offset, raw if keep_ids or part is not None else None, part), strict=True):
                c.append(x)
            offset += len(ids)
    kinds = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PIECE.split(", ")])


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, seq_len: int = 4096, open_windows: int = 16, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if kept).

    Null and empty texts are the end id alone; repeated rows are packed each, rows with a null doc_id like others; an
    empty table gives no rows.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        part, packer, done = TaskContext.get().partitionId(), Packer(seq_len, open_windows), 0
        for batch in text_slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(enc.encode(text) + end, "<u4")
                packer.add(doc_id, 0, ids, len(ids))
            if packer.sealed:
                yield _rows(packer.sealed, (part << 32) + done, keep_ids)
                done += len(packer.sealed)
                packer.sealed = []
        rest = packer.merge()
        if packer.sealed:
            yield _rows(packer.sealed, (part << 32) + done, keep_ids)
        if rest:
            yield _rows([rest], 0, True, part)

    def merging(level: int, last: bool):
        def run(key: tuple, group: pa.Table) -> pa.Table:
            group = group.sort_by([("part", "ascending"), ("offset", "ascending")])
            packer = Packer(seq_len, 1)
            for doc_id, start, total, raw in zip(*(group.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                packer.add(doc_id, start, np.frombuffer(raw, "<u4"), total)
            rest = packer.merge()
            if last:
                packer.powers()
                rest = []
            up = key[0].as_py()
            # Above all ids of the first pass: a level and group of its own.
            first = ((1 << 62) | (level << 56)) + (up << 24)
            made = [_rows(packer.sealed, first, keep_ids)] + ([_rows([rest], 0, True, up)] if rest else [])
            return pa.Table.from_batches(made)

        return run

    placed = materialize(doc_rows(docs, id_col, text_col).mapInArrow(place, PIECE), "packed")
    out = placed.filter("sequence_id is not null")
    left, level = placed.filter("sequence_id is null"), 0
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts, level = -(-parts // FAN), level + 1
        merged = left.withColumn("up", F.floor(F.col("part") / FAN).cast("long")).groupBy("up").applyInArrow(merging(level, parts == 1), PIECE)
        merged = materialize(merged, "packed")
        out = out.unionByName(merged.filter("sequence_id is not null"))
        if parts == 1:
            break
        left = merged.filter("sequence_id is null")
    return out.drop("part") if keep_ids else out.drop("part", "ids")
