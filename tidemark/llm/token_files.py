"""Token-id output: Arrow IPC files of fixed-size-list batches.

A shard holds a contiguous range of documents in ascending doc_id. ``<shard>.seq.arrow`` has ``ids``
(fixed-size list of the smallest unsigned type that holds the vocabulary) and ``mask`` (fixed-size list of
bool, false on the padding that ends the shard); all batches but the last hold the same number of
sequences, so sequence k is row k % B of batch k // B, a view of the mapped file without a copy.
``<shard>.doc.arrow`` has each document's id, first token and token count within the shard.

Files get a unique name per task attempt, and only the names in the manifest, a Parquet table that Spark
commits, count: a retried or lost task leaves at most an unlisted file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.piece_encoder import encoder
from tidemark.llm.shared import doc_rows, filesystem, materialize, new_path, text_slices

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
MANIFEST = "shard int, file string, n_docs long, n_tokens long, n_sequences long"


class _Shard:
    """Writes one shard with a bounded buffer."""

    def __init__(self, fs, base: str, seq_len: int, per_batch: int, dtype: str):
        self.seq_len, self.per_batch, self.dtype = seq_len, per_batch, np.dtype(dtype)
        self.kind = pa.from_numpy_dtype(self.dtype)
        schema = pa.schema([("ids", pa.list_(self.kind, seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.seq_out, self.doc_out = fs.open_output_stream(f"{base}.seq.arrow"), fs.open_output_stream(f"{base}.doc.arrow")
        self.seqs, self.docs = pa.ipc.new_file(self.seq_out, schema), pa.ipc.new_file(self.doc_out, INDEX)
        self.buffer = np.empty(seq_len * per_batch, self.dtype)
        self.filled = self.total = self.n_sequences = self.n_docs = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.rows.append((doc_id, self.total, len(ids)))
        self.total += len(ids)
        self.n_docs += 1
        while len(ids):
            n = min(len(ids), len(self.buffer) - self.filled)
            self.buffer[self.filled : self.filled + n] = ids[:n]
            self.filled, ids = self.filled + n, ids[n:]
            if self.filled == len(self.buffer):
                self._flush()
        if len(self.rows) >= 65_536:
            self._index()

    def _flush(self) -> None:
        n = -(-self.filled // self.seq_len)
        values = self.buffer[: n * self.seq_len]
        values[self.filled :] = 0
        mask = np.arange(len(values)) < self.filled
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (values, mask)]
        self.seqs.write_batch(pa.record_batch(lists, schema=self.seqs_schema()))
        self.n_sequences += n
        self.filled = 0

    def seqs_schema(self) -> pa.Schema:
        return pa.schema([("ids", pa.list_(self.kind, self.seq_len)), ("mask", pa.list_(pa.bool_(), self.seq_len))])

    def _index(self) -> None:
        self.docs.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.rows, strict=True)], schema=INDEX))
        self.rows = []

    def close(self) -> None:
        if self.filled:
            self._flush()
        if self.rows:
            self._index()
        for x in (self.seqs, self.docs, self.seq_out, self.doc_out):
            x.close()


def write_token_files(docs: DataFrame, tokenizer: str, out_dir: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, seq_len: int = 2048, per_batch: int = 256) -> DataFrame:
    """Encode every text, append ``end_id``, write shards under ``out_dir``; the manifest, shards in doc_id order.

    Null texts are empty (one end id). Rows with a null doc_id come first; equal doc_ids stay together,
    ordered by text. An empty table gives an empty manifest. Extra columns are ignored.
    """
    dtype = "<u2" if max(_vocabulary(tokenizer), end_id + 1) <= 1 << 16 else "<u4"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.asarray([end_id], "<u4").tobytes()
        shard, name = TaskContext.get().partitionId(), ""
        out = None
        for batch in text_slices(batches):
            if out is None:
                fs, top = filesystem(out_dir)
                fs.create_dir(top, recursive=True)
                name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
                out = _Shard(fs, f"{top}/{name}", seq_len, per_batch, dtype)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out.add(doc_id, np.frombuffer(enc.encode(text) + end, "<u4"))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([name]), *(pa.array([x], pa.int64()) for x in (out.n_docs, out.total, out.n_sequences))], names=["shard", "file", "n_docs", "n_tokens", "n_sequences"])

    rows = doc_rows(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(rows.mapInArrow(write, MANIFEST), "token-manifest")


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)


def read_shard(out_dir: str, name: str) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
    """(doc_id, first token in the shard, views of its ids) in order; a local file is mapped, not copied."""
    fs, top = filesystem(out_dir)

    def opened(kind: str):
        path = f"{top}/{name}.{kind}.arrow"
        return pa.ipc.open_file(pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path))

    seqs, index = opened("seq"), opened("doc")
    at, batch, values = 0, -1, np.empty(0, np.uint16)
    for k in range(index.num_record_batches):
        b = index.get_batch(k)
        for doc_id, start, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            views = []
            while n:
                if at == len(values):
                    batch, at = batch + 1, 0
                    values = seqs.get_batch(batch).column(0).flatten().to_numpy(zero_copy_only=True)
                m = min(n, len(values) - at)
                views.append(values[at : at + m])
                at, n = at + m, n - m
            yield doc_id, start, views


def sequence(out_dir: str, name: str, k: int, per_batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Sequence ``k`` of a shard and its mask, by position alone."""
    fs, top = filesystem(out_dir)
    path = f"{top}/{name}.seq.arrow"
    reader = pa.ipc.open_file(pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path))
    row = reader.get_batch(k // per_batch).slice(k % per_batch, 1)
    return row.column(0).flatten().to_numpy(zero_copy_only=True), row.column(1).flatten().to_numpy(zero_copy_only=False)


def read_token_files(manifest: DataFrame, out_dir: str) -> DataFrame:
    """Per document: doc_id, start (over all shards), n_tokens, ids_crc32, shard, start_in_shard, read from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = [list(c) for c in zip(*rows, strict=True)] or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "start_in_shard"])

        for part in batches:
            for shard, name, base in zip(*(part.column(c).to_pylist() for c in ("shard", "file", "base")), strict=True):
                rows: list[tuple] = []
                for doc_id, start, views in read_shard(out_dir, name):
                    crc = 0
                    for v in views:
                        crc = zlib.crc32(np.ascontiguousarray(v, dtype="<u4"), crc)
                    rows.append((doc_id, base + start, sum(map(len, views)), crc, shard, start))
                    if len(rows) >= 4096:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    # One manifest row per shard: the running sum in a single task is over shards, not documents.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spread = manifest.select("shard", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    spread = spread.repartition(max(1, manifest.count()), "shard")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, start_in_shard long")


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write and read back: one row per document, from the files."""
    out_dir = new_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, out_dir, **options), out_dir)
