"""Token files, counts, packing and piece dropout against the libraries."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import packing, piece_dropout
from tidemark.llm.packing import pack
from tidemark.llm.piece_dropout import DropoutEncoder, encode_pieces
from tidemark.llm.piece_encoder import PieceEncoder
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.token_counts import _Counter, token_counts, whole_tokens
from tidemark.llm.token_files import read_shard, sequence, token_files, write_token_files

TEXTS = [None, "", "a", "Same text.\nTwo lines, really.", "Same text.\nTwo lines, really.", "don't we'll 'tis x.'s", "é naïve  café x", "<|endoftext|> in a text", "a\x1cb \r\n\t c", "Σας ΑΣ.Β", "12 345abc !!! ??", "_a b_", "x" * 5000, "word and " * 3000]
SCHEMA = "doc_id long, text string, shard string, start string, key int"


def frame(spark, rows=None):
    rows = [(i // 2 * 2, t, "s", "q", 1) for i, t in enumerate(TEXTS)] if rows is None else rows  # doc_ids repeat
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cut_pieces_give_the_library_ids(name):
    enc = PieceEncoder(tokenizer_path(name))
    assert enc.cut
    for t in TEXTS[1:]:
        assert enc.encode(t) == enc.whole(t), t


def _ids(name, text):
    return np.frombuffer(PieceEncoder(tokenizer_path(name)).whole(text or ""), "<u4")


def test_token_files(spark, tmp_path):
    path = tokenizer_path("byte_bpe_50k.json")
    got = sorted(token_files(frame(spark), path, seq_len=64, per_batch=4).collect(), key=lambda r: r["start"])
    rows = sorted(((i // 2 * 2, t or "") for i, t in enumerate(TEXTS)))
    start = 0
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = np.append(_ids("byte_bpe_50k.json", text), 2).astype("<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files(frame(spark, []), path).count() == 0


def test_sequences_and_masks_by_position(spark, tmp_path):
    path = tokenizer_path("byte_bpe_50k.json")
    shards = write_token_files(frame(spark).coalesce(1), path, str(tmp_path), seq_len=64, per_batch=4).collect()
    for s in shards:
        whole = np.concatenate([v for _, _, views in read_shard(str(tmp_path), s["file"]) for v in views])
        assert len(whole) == s["n_tokens"] and whole.dtype == np.uint16
        ids, mask = sequence(str(tmp_path), s["file"], s["n_sequences"] - 1, 4)
        last = whole[(s["n_sequences"] - 1) * 64 :]
        assert mask.sum() == len(last) and (ids[: len(last)] == last).all()


def test_token_counts(spark):
    got = token_counts(frame(spark), tokenizer_path("byte_bpe_50k.json"), limit=100).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == sorted((i // 2 * 2, len((t or "").encode()), len(_ids("byte_bpe_50k.json", t)), len(_ids("byte_bpe_50k.json", t)) > 100) for i, t in enumerate(TEXTS))
    assert token_counts(frame(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert " the" in whole_tokens(tokenizer_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("fan", [2, 128])
def test_packing(spark, monkeypatch, fan):
    monkeypatch.setattr(packing, "FAN", fan)
    docs = frame(spark).withColumn("doc_id", __import__("pyspark.sql.functions", fromlist=["x"]).monotonically_increasing_id())
    by_id = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces = pack(docs, tokenizer_path("word_bpe_49k.json"), seq_len=256, open_windows=2).collect()
    ids = {i: np.append(_ids("word_bpe_49k.json", t), 2).astype("<u4") for i, t in by_id.items()}
    seen: dict = {}
    sequences: dict = {}
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["length"] == len(part) > 0 and p["ids_crc32"] == zlib.crc32(part.tobytes()) and p["doc_tokens"] == len(ids[p["doc_id"]])
        seen.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for i, parts in seen.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[i])
    assert seen.keys() == ids.keys()
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 256 or at & (at - 1) == 0  # no padding at all
    assert pack(frame(spark, []), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_dropout_is_seeded_and_lossless(spark):
    from sentencepiece import SentencePieceProcessor

    model = tokenizer_path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=model)
    plain, dropped, other = DropoutEncoder(model, alpha=0), DropoutEncoder(model, seed=1, alpha=0.3), DropoutEncoder(model, seed=2, alpha=0.3)
    texts = [t for t in TEXTS if t is not None] + ["  two  blanks ", "中 \U0001f600"]
    for t in texts:
        assert plain.encode(t).tolist() == library.encode(t)
        assert dropped.decode(dropped.encode(t)) == t
        assert (dropped.encode(t) == DropoutEncoder(model, seed=1, alpha=0.3).encode(t)).all()
    assert dropped.decode(dropped.encode("a▁b")) == "a▁b"
    assert any(dropped.encode(t).tolist() != other.encode(t).tolist() for t in texts)
    rows = encode_pieces(frame(spark), model).collect()
    assert len(rows) == len(TEXTS) and all(r["lossless"] for r in rows)
    assert encode_pieces(frame(spark, []), model).count() == 0


def agenda(enc, text):
    """Every occurrence on its own: pop the best adjacent pair that is not skipped, skip it or merge it."""
    mask = (1 << 64) - 1
    out, place, key = [], 0, xxhash.xxh64_intdigest(text.encode(), enc.seed)
    for chunk in enc.cuts.findall("▁" + text.replace(" ", "▁")):
        place += 1
        draw = piece_dropout._mixed((place * piece_dropout.GOLDEN + key) & mask)
        wait = enc._gap(draw)
        symbols, fresh, skipped = [(c, i) for i, c in enumerate(chunk)], len(chunk), set()
        while True:
            pairs = [(enc.rank[a[0] + b[0]], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a[0] + b[0] in enc.rank and (a[1], b[1]) not in skipped]
            if not pairs:
                break
            i = min(pairs)[1]
            if wait:
                wait -= 1
                symbols[i : i + 2] = [(symbols[i][0] + symbols[i + 1][0], fresh)]
                fresh += 1
            else:
                skipped.add((symbols[i][1], symbols[i + 1][1]))
                draw = piece_dropout._mixed((draw + piece_dropout.GOLDEN) & mask)
                wait = enc._gap(draw)
        for p, _ in symbols:
            out += [enc.ids[p]] if p in enc.ids else [enc.byte[b] for b in p.encode()]
    return out


@pytest.mark.parametrize("alpha", [0.1, 0.3, 0.5])
def test_dropout_is_that_of_the_agenda(alpha):
    enc = DropoutEncoder(tokenizer_path("piece_bpe_32k.model"), seed=5, alpha=alpha)
    rng = random.Random(1)
    words = ["understanding", "the", "international", "co-operation's", "naïve", "x" * 60, "日本語", "a", "tion", "12,345.67"]
    for _ in range(2):  # the second time from the cache
        for _ in range(60):
            text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))
            assert enc.encode(text).tolist() == agenda(enc, text)


def test_dropout_keeps_outcomes_of_one_skip(monkeypatch):
    """An outcome of one skip is looked up, too, where the chunk has never come without skips."""
    enc, made = DropoutEncoder(tokenizer_path("piece_bpe_32k.model"), seed=5, alpha=0.1), []
    real = enc.chunk
    monkeypatch.setattr(enc, "chunk", lambda *a: made.append(a) or real(*a))
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("aeioulnrst") for _ in range(9)) for _ in range(600))
    wanted = agenda(enc, text)
    assert enc.encode(text).tolist() == wanted
    first = len(made)
    assert enc.encode(text).tolist() == wanted
    assert 0 < len(made) - first < first / 4
    third = " ".join(text.split()[::-1])
    assert enc.encode(third).tolist() == agenda(enc, third)


def test_dropout_runs_many_unknown_chunks_side_by_side(monkeypatch):
    """Chunks that are not cached go through no agenda of their own, whatever their skips."""
    enc, made = DropoutEncoder(tokenizer_path("piece_bpe_32k.model"), seed=5, alpha=0.3), []
    real = enc.chunk
    monkeypatch.setattr(enc, "chunk", lambda *a: made.append(a) or real(*a))
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulnrstéß") for _ in range(rng.randint(1, 20))) for _ in range(6000)]
    text = " ".join(words + ["x" * 60, "日本語"])
    wanted = agenda(enc, text)
    for _ in range(2):
        assert enc.encode(text).tolist() == wanted
    assert len(made) < 600


@pytest.mark.parametrize("alpha", [0, 0.1, 0.5, 1])
def test_dropout_of_many_texts_is_that_of_each(alpha, monkeypatch):
    model = tokenizer_path("piece_bpe_32k.model")
    alone, enc = DropoutEncoder(model, seed=5, alpha=alpha), DropoutEncoder(model, seed=5, alpha=alpha, most=3000)
    rng = random.Random(4)
    texts = [t for t in TEXTS if t is not None] + ["a▁b", "▁", "日本語 \U0001f600 " * 5]
    texts += [" ".join("".join(rng.choice("aeio'.1日tn") for _ in range(rng.randint(1, 50))) for _ in range(40)) for _ in range(40)]
    wanted = [alone.encode(t).tolist() for t in texts]  # few chunks: one after the other
    monkeypatch.setattr(piece_dropout, "TOGETHER", 8)
    monkeypatch.setattr(piece_dropout, "BLOCK", 300)  # texts share blocks and go over their borders
    for _ in range(2):
        assert [ids.tolist() for ids in enc.encode_all(texts)] == wanted
    assert enc.known and list(enc.encode_all([])) == []


def test_dropout_varies_by_occurrence():
    model = tokenizer_path("piece_bpe_32k.model")
    word, n = "understanding", 2000
    enc, plain = DropoutEncoder(model, seed=3), DropoutEncoder(model, alpha=0)

    def segmentations(ids):
        words = []
        for i in ids.tolist():
            if enc.bytes_of[i].startswith(b" "):
                words.append([])
            words[-1].append(i)
        return Counter(map(tuple, words))

    chunk = "▁" + word
    passed = plain.chunk(chunk, (1 << 30,), 0)[1]
    within = segmentations(enc.encode(" ".join([word] * n)))
    across = segmentations(np.concatenate([enc.encode(f"{word} {i}") for i in range(300)]))
    assert len(within) > 10 and sum(within.values()) == n
    assert len([w for w in across if b"".join(enc.bytes_of[i] for i in w) == b" " + word.encode()]) > 10
    assert within[tuple(plain.encode(word).tolist())] > 0.9**passed * n * 0.8
    long = "understanding" * 40
    assert enc.decode(enc.encode(long)) == long and enc.encode(long).tolist() != plain.encode(long).tolist()


def test_null_ids_are_rows_like_others(spark):
    rows = [(None, "some text", "s", "q", 1), (None, "some text", "s", "q", 1), (None, None, "s", "q", 1), (3, "some text", "s", "q", 1)]
    df, path = frame(spark, rows), tokenizer_path("byte_bpe_50k.json")
    n = len(_ids("byte_bpe_50k.json", "some text"))
    assert Counter((r["doc_id"], r["n_tokens"]) for r in token_counts(df, path).collect()) == {(None, n): 2, (None, 0): 1, (3, n): 1}
    assert Counter(r["doc_id"] for r in encode_pieces(df, tokenizer_path("piece_bpe_32k.model")).collect()) == {None: 3, 3: 1}
    pieces = pack(df, tokenizer_path("word_bpe_49k.json")).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == {None: 3, 3: 1}
    assert Counter(r["doc_id"] for r in token_files(df, path).collect()) == {None: 3, 3: 1}


def test_texts_above_a_million_letters():
    path = tokenizer_path("byte_bpe_50k.json")
    text = "word and, then 42 more\n" * 50_000
    enc = PieceEncoder(path)
    assert len(text) > 1 << 20 and enc.encode(text) == enc.whole(text)
    counter = _Counter(path, whole_tokens(path))
    assert counter.count(text) == len(enc.whole(text)) // 4
    dropping = DropoutEncoder(tokenizer_path("piece_bpe_32k.model"), seed=1)
    assert dropping.decode(dropping.encode(text)) == text
