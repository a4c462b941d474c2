"""Token counts with a whole-token shortcut.

Offline, on the driver, each vocabulary string is encoded alone: those that give exactly their own token
form the whole-token set (bounded by the vocabulary). A text is cut into pre-tokens; one that is in the set
counts 1, and only the rest are merged by the library, once per distinct string and worker.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.piece_encoder import PIECES, UNSURE, encoder
from tidemark.llm.shared import doc_rows, text_slices


def whole_tokens(tokenizer: str) -> frozenset[str]:
    """Strings proven to encode alone as their own single token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer)
    ids = sorted(library.get_vocab(with_added_tokens=False).values())
    found = set()
    for at in range(0, len(ids), 4096):
        part = ids[at : at + 4096]
        texts = library.decode_batch([[i] for i in part], skip_special_tokens=False)
        for i, text, enc in zip(part, texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            if text and "�" not in text and enc.ids == [i]:
                found.add(text)
    return frozenset(found)


class _Counter(dict):
    """Pre-token -> number of tokens; starts with the whole-token set, keeps a bounded rest."""

    def __init__(self, tokenizer: str, whole: frozenset[str], most: int = 500_000):
        super().__init__(dict.fromkeys(whole, 1))
        self.encoder, self.wholes, self.most = encoder(tokenizer), whole, len(whole) + most

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(dict.fromkeys(self.wholes, 1))
        n = len(self.encoder.piece_ids(piece))
        if len(piece) <= 64:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        enc = self.encoder
        if not enc.cut or UNSURE.search(text) or any(x in text for x in enc.added):
            return len(enc.library.encode(text, add_special_tokens=False).ids)
        if len(text) > 1 << 20:
            return sum(self[m.group()] for m in PIECES.finditer(text))
        return sum(map(self.__getitem__, PIECES.findall(text)))


_COUNTERS: dict[str, _Counter] = {}


def token_counts(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row, without a shuffle.

    Null texts count 0 bytes and 0 tokens; repeated rows are counted each, rows with a null doc_id like others; an
    empty table gives no rows.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _COUNTERS:
            _COUNTERS[tokenizer] = _Counter(tokenizer, whole.value)
        counter = _COUNTERS[tokenizer]
        for batch in text_slices(batches):
            texts = batch.column(1).to_pylist()
            n = [counter.count(x) for x in texts]
            size = [len(x.encode()) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return doc_rows(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
