"""Subword encoding with seeded merge-dropout, and its decoder.

The merge model of a SentencePiece file is run here with an agenda: all adjacent pairs that are pieces wait
in a heap by score, and each popped candidate is skipped with chance ``alpha``. A keyed hash of (seed, text,
occurrence of the chunk) draws how many candidates pass before the next skip, so each occurrence is segmented
on its own. A text is cut where no piece of the vocabulary reaches across, which changes no merge: before runs
of space marks and, if the vocabulary proves it, between letters and punctuation. A chunk's segmentations are
cached as a tree by the skips that lead to them; the cache decides no skip. Many chunks that are not cached go
through their agendas side by side, one candidate of each at a time. With ``alpha`` 0 the ids are those
of the library. Every segmentation decodes to the text itself.
"""

from __future__ import annotations

import gc
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, repeat
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidemark.llm.shared import doc_rows, text_slices

MARK = "▁"
LETTERS, PUNCT = "A-Za-zÀ-ÖØ-öø-ÿ", r"\n!-&(-/:-@\[-`{-~'"
#: Cuts before runs of marks; the second form also between letters and punctuation.
CHUNKS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
FINER = re.compile(f"{MARK}?[{LETTERS}]+(?=[{PUNCT}{MARK}]|\\Z)|{MARK}?[{PUNCT}]+(?=[{LETTERS}{MARK}]|\\Z)|{MARK}+[^{MARK}]*|[^{MARK}]+")
MIXED = re.compile(f"[{LETTERS}][{PUNCT}]|[{PUNCT}][{LETTERS}]")
KEPT = 48  # letters of the longest chunk that is cached
NEVER = 1 << 30
BLOCK = 1 << 18  # chunks that are gone through at once
TOGETHER = 1000  # chunks not cached from which on their agendas run side by side
WIDTHS = (0, 6, 8, 10, 12, 16, 24, KEPT)  # those of about one length
CELLS = 1 << 18  # letters that are stepped at once
PLACE = 6  # bits of a place in a chunk
LAST = np.int32(2**31 - 1)  # rank and place of what is no candidate
MASK, GOLDEN = (1 << 64) - 1, 0x9E3779B97F4A7C15


def _mixed(x):
    """SplitMix64's finish, of an int or in place of an array."""
    whole = isinstance(x, int)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> (shift if whole else np.uint64(shift))
        x = x * times & MASK if whole else np.multiply(x, np.uint64(times), out=x)
    return x ^ (x >> 31 if whole else x >> np.uint64(31))


#: Texts that show whether a model normalises, trims or joins spaces, and falls back to bytes.
PROBES = ("a", "  a  b ", "Ａ①ﬁ e\u0301", "naïve\tTab\n\nline", "\U0001f600日本語")

#: What no node has below it; never written to.
NONE: dict = {}
#: A node is [ids as little-endian uint32 bytes, candidates popped, {next gap: node}]; this one stands for an unknown chunk.
FRESH: list = [b"", 1 << 40, NONE]


class DropoutEncoder:
    def __init__(self, model: str, seed: int = 0, alpha: float = 0.1, most: int = 1_200_000):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=model)
        n = library.get_piece_size()
        plain = [i for i in range(n) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        self.ids = {library.id_to_piece(i): i for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces with an inner space mark: texts cannot be cut into chunks")
        self.ranked = sorted(self.ids, key=lambda p: -library.get_score(self.ids[p]))
        self.rank = {p: r for r, p in enumerate(self.ranked)}
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.byte = {int(library.id_to_piece(i)[1:-1], 16): i for i in range(n) if library.is_byte(i)}
        self.unknown = library.unk_id()
        self.bytes_of = [b""] * n
        for p, i in self.ids.items():
            self.bytes_of[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        self.cuts = CHUNKS if any(MIXED.search(p) for p in self.ids) else FINER
        self.seed, self.alpha = seed & MASK, alpha
        self.times = 1 / math.log1p(-alpha) if 0 < alpha < 1 else 0.0
        self.known: dict[str, list] = {}
        self.most, self.nodes = most, 0
        self._check(library)

    def _check(self, library) -> None:
        """Models that rewrite texts, add no space before them or have no byte pieces would get other ids: an error."""
        if len(self.byte) != 256:
            raise ValueError("the model has no piece for each byte")
        wanted, self.alpha = self.alpha, 0.0
        for probe in PROBES:
            if self.encode(probe).tolist() != library.encode(probe):
                raise ValueError(f"the model does not take texts as they are: {probe!r}")
        self.alpha = wanted
        self.known.clear()
        self.nodes = 0

    def chunk(self, text: str, gaps: tuple[int, ...], draw: int) -> tuple[bytes, int]:
        """Ids of one chunk, and the candidates popped. ``gaps`` has the numbers that pass before each skip, ``draw``
        gives those after them. The agenda of a short chunk is the list of its neighbours' ranks, whose least is
        popped, the leftmost of equal ones."""
        if len(text) > KEPT:
            symbols, popped = self._long(text, gaps, draw)
        else:
            rank, ranked, popped, used, skip = self.rank.get, self.ranked, 0, 1, gaps[0]
            symbols = list(text)
            last = len(symbols) - 1
            ranks = list(map(rank, map(add, text, text[1:]), repeat(NEVER)))
            ranks.append(NEVER)  # so that there always is a least one
            while (r := min(ranks)) != NEVER:
                i = ranks.index(r)
                if popped == skip:
                    ranks[i] = NEVER  # until one of its symbols changes
                    popped += 1
                    if used < len(gaps):
                        skip = popped + gaps[used]
                        used += 1
                    else:
                        draw = _mixed(draw + GOLDEN & MASK)
                        skip = popped + self._gap(draw)
                    continue
                popped += 1
                last -= 1
                del ranks[i], symbols[i]
                symbols[i] = joined = ranked[r]
                if i < last:
                    ranks[i] = rank(joined + symbols[i + 1], NEVER)
                if i:
                    ranks[i - 1] = rank(symbols[i - 1] + joined, NEVER)
        try:
            return b"".join(map(self.packed.__getitem__, symbols)), popped
        except KeyError:
            ids = self.ids
            found = ([ids[p]] if p in ids else [self.byte.get(b, self.unknown) for b in p.encode()] for p in symbols)
            return array("I", chain.from_iterable(found)).tobytes(), popped

    def _long(self, text: str, gaps: tuple[int, ...], draw: int) -> tuple[list[str], int]:
        """Symbols of a long chunk, and the candidates popped: the same agenda as a heap of (rank, left, right), each
        packed in one number, over a linked list."""
        n, used, wait = len(text), 1, gaps[0]
        symbols, after, before = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        width, rank, popped = n.bit_length(), self.rank.get, 0
        low = (1 << width) - 1
        agenda = [(r << width | i) << width | i + 1 for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            x = heappop(agenda)
            right, left, r = x & low, x >> width & low, x >> 2 * width
            a = symbols[left]
            if not a or after[left] != right or rank(joined := a + symbols[right]) != r:
                continue  # one of its symbols has changed
            popped += 1
            if not wait:
                if used < len(gaps):
                    wait = gaps[used]
                    used += 1
                else:
                    draw = _mixed(draw + GOLDEN & MASK)
                    wait = self._gap(draw)
                continue
            wait -= 1
            symbols[left], symbols[right] = joined, ""
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                if (r := rank(joined + symbols[right])) is not None:
                    heappush(agenda, (r << width | left) << width | right)
            right = before[left]
            if right >= 0 and (r := rank(symbols[right] + joined)) is not None:
                heappush(agenda, (r << width | right) << width | left)
        return [p for p in symbols if p], popped

    def _gap(self, draw: int) -> int:
        """Candidates that pass before a skip: geometric, of a 64-bit draw."""
        return min(NEVER, int(math.log(((draw >> 11) + 1) * 2.0**-53) * self.times))

    def _gaps(self, draws: np.ndarray) -> np.ndarray:
        return np.minimum(np.log(((draws >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) * self.times, NEVER).astype(np.int64)

    def _made(self, chunk: str, above: list | None, gap: int, skips: tuple[int, ...], more: int, draw: int, known: tuple[int, ...]) -> bytes:
        """Ids of an occurrence with ``skips``, then ``more``, then those ``known``, then those of ``draw``. Kept below
        the node ``above`` at ``gap`` (None: as the chunk's own) if no skip came after ``skips``. Where the chunk's own
        ids are not known yet, an outcome of one skip is kept below a node that stands for them."""
        packed, popped = self.chunk(chunk, (*skips, more, *known), draw)
        if len(chunk) > KEPT:
            return packed
        if popped <= sum(skips) + len(skips) + more:
            if self.nodes >= self.most:
                self.known.clear()
                self.nodes = 0
                if above is not None:
                    return packed
            if above is None:
                self.known[chunk] = [packed, popped, self.known.get(chunk, FRESH)[2]]
            else:
                if above[2] is NONE:
                    above[2] = {}
                above[2][gap] = [packed, popped, NONE]
            self.nodes += 1
        elif known and popped <= more + 1 + known[0] and self.nodes < self.most:
            if chunk not in self.known:
                self.known[chunk] = [*FRESH[:2], {}]
                self.nodes += 1
            self.known[chunk][2][more] = [packed, popped, NONE]
            self.nodes += 1
        return packed

    def _skipped(self, chunk: str, node: list, gap: int, more: int, draw: int) -> bytes:
        """Ids of an occurrence whose skips come after ``gap`` candidates, then ``more``, then what ``draw`` gives."""
        if node[1] == FRESH[1] and (node is FRESH or gap not in node[2]):
            return self._made(chunk, None, 0, (), gap, draw, (more,))
        above, passed = node, gap + 1
        node = above[2].get(gap)
        if node is None:
            return self._made(chunk, above, gap, (gap,), more, draw, ())
        skips, gap = (gap,), more
        while passed + gap < node[1]:
            above, name = node, gap
            skips, passed = (*skips, gap), passed + gap + 1
            draw = _mixed(draw + GOLDEN & MASK)
            gap = self._gap(draw)
            node = above[2].get(name)
            if node is None:
                return self._made(chunk, above, name, skips, gap, draw, ())
        return node[0]

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Open addressing of (left, right) pieces that make a piece: left * pieces + right (-1: free), and its rank."""
        rank, n = self.rank, len(self.rank) + 1
        made = [(rank[p[:i]] * n + rank[p[i:]], r) for p, r in rank.items() for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank]
        bits = max(8, (4 * len(made)).bit_length())
        keys, ranks = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        key, r = np.asarray(made, np.int64).reshape(-1, 2).T
        slot = self._slots(key, 64 - bits)
        while len(key):
            free, first = np.flatnonzero(keys[slot] < 0), np.zeros(len(key), bool)
            first[free[np.unique(slot[free], return_index=True)[1]]] = True
            keys[slot[first]], ranks[slot[first]] = key[first], r[first]
            key, r, slot = key[~first], r[~first], slot[~first] + 1 & len(keys) - 1
        return keys, ranks, 64 - bits

    @staticmethod
    def _slots(key: np.ndarray, shift: int) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(GOLDEN) >> np.uint64(shift)).astype(np.int64)

    @cached_property
    def _letters(self) -> np.ndarray:
        """Ranks of the pieces of one letter, by code point; others have the number of pieces."""
        found = np.full(0x110000, len(self.rank), np.int32)
        for p, r in self.rank.items():
            if len(p) == 1:
                found[ord(p)] = r
        return found

    def _candidates(self, left: np.ndarray, right: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Rank and place in one number for each pair that makes a piece, else ``LAST``."""
        keys, ranks, shift = self._pairs
        key = left.astype(np.int64) * (len(self.rank) + 1) + right
        slot = self._slots(key, shift)
        there = keys[slot]
        out = np.where(there == key, ranks[slot] << PLACE | places, LAST)
        todo = np.flatnonzero((there != key) & (there >= 0))
        while len(todo):
            slot[todo] = probe = slot[todo] + 1 & len(keys) - 1
            there = keys[probe]
            hit = there == key[todo]
            out[todo[hit]] = ranks[probe[hit]] << PLACE | places[todo[hit]]
            todo = todo[~hit & (there >= 0)]
        return out

    def _together(self, chunks: list[str], gaps: list[int], draws: np.ndarray | None = None) -> Iterator[tuple[int, bytes, int]]:
        """Place in the list, ids and candidates popped of each chunk, in any order. Its first skip comes after its gap
        (NEVER: none), the others as the draw of that gap goes on (None: no others)."""
        sizes, skips, none = np.fromiter(map(len, chunks), np.int64, len(chunks)), np.asarray(gaps, np.int64), len(self.rank)
        letters, starts = self._letters[np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")], np.cumsum(sizes) - sizes
        odd = np.add.reduceat(letters == none, starts) > 0
        for i in np.flatnonzero(odd).tolist():  # letters that go out as bytes
            yield i, *(self.chunk(chunks[i], (gaps[i], NEVER), 0) if draws is None else self.chunk(chunks[i], (gaps[i],), int(draws[i])))
        ids = np.asarray([self.ids[p] for p in self.ranked], "<u4")
        groups = [(width, np.flatnonzero((sizes > low) & (sizes <= width) & ~odd)) for low, width in zip(WIDTHS, WIDTHS[1:], strict=False)]
        for width, which in ((w, x[i : i + CELLS // w]) for w, x in groups for i in range(0, len(x), CELLS // w)):
            place = np.arange(width + 1)[:, None]
            inside = place < sizes[which]
            symbols = np.where(inside, letters[np.where(inside, starts[which] + place, 0)], np.int32(none))
            popped = self._stepped(symbols, skips[which], None if draws is None else draws[which]).tolist()
            left = symbols.T != none
            packed, ends = ids[symbols.T[left]].tobytes(), (4 * np.cumsum(left.sum(axis=1))).tolist()
            yield from zip(which.tolist(), (packed[a:b] for a, b in zip([0, *ends], ends, strict=False)), popped, strict=True)

    def _stepped(self, symbols: np.ndarray, skips: np.ndarray, draws: np.ndarray | None) -> np.ndarray:
        """Runs the agenda of ``chunk`` on each column of ``symbols`` (ranks, and the number of pieces where no symbol
        is), in place; the candidates popped. Each step pops one candidate of each agenda. The last row has no symbol:
        it is what comes before the first one."""
        none, (height, n) = len(self.rank), symbols.shape
        agenda = np.full((height, n), LAST)
        agenda[:-1] = self._candidates(symbols[:-1].ravel(), symbols[1:].ravel(), np.repeat(np.arange(height - 1, dtype=np.int32), n)).reshape(height - 1, n)
        after = np.repeat(np.arange(1, height + 1, dtype=np.int8)[:, None], n, axis=1)
        before = np.repeat(np.arange(-1, height - 1, dtype=np.int8)[:, None], n, axis=1)
        before[0] = height - 1
        whole, popped, which, count, step = symbols, np.zeros(n, np.int64), np.arange(n), np.zeros(n, np.int64), 0
        while True:
            least = agenda.min(axis=0)
            alive = least != LAST
            if 4 * np.count_nonzero(alive) <= 3 * len(which):
                popped[which] = count
                if symbols is not whole:
                    whole[:, which] = symbols
                if not alive.any():
                    return popped
                symbols, agenda, after, before = (np.compress(alive, x, axis=1) for x in (symbols, agenda, after, before))
                which, count, skips, least = which[alive], count[alive], skips[alive], least[alive]
                draws = None if draws is None else draws[alive]
                alive = np.ones(len(which), bool)
            count += alive
            n, place = len(which), least & (1 << PLACE) - 1
            skip = alive & (skips == step)
            at = np.flatnonzero(skip)
            agenda[place[at], at] = LAST  # until one of its symbols changes
            step += 1
            if draws is not None:
                draws[at] = drawn = _mixed(draws[at] + np.uint64(GOLDEN))
                skips[at] = step + self._gaps(drawn)
            at = np.flatnonzero(alive & ~skip)
            place, joined = place[at], least[at] >> PLACE
            s, g, a, b = symbols.reshape(-1), agenda.reshape(-1), after.reshape(-1), before.reshape(-1)
            here = place * np.int64(n) + at
            gone = a[here] * np.int64(n) + at
            follows, prior = a[gone], b[here]
            s[here], s[gone], g[gone] = joined, none, LAST
            a[here] = follows
            right, left = follows * np.int64(n) + at, prior * np.int64(n) + at
            b[right] = place
            g[np.concatenate([here, left])] = self._candidates(np.concatenate([joined, s[left]]), np.concatenate([s[right], joined]), np.concatenate([place, prior.astype(np.int32)]))

    def _learn(self, chunks: list[str]) -> None:
        """Caches the ids without skips of chunks that are not known, if they are many."""
        new = [c for c in set(chunks).difference(self.known) if len(c) <= KEPT]
        if len(new) < TOGETHER:
            return
        for i, packed, popped in self._together(new, [NEVER] * len(new)):
            self.known[new[i]] = [packed, popped, NONE]
        self.nodes += len(new)

    def _skipped_together(self, out: list, rest: list[int], chunks: list[str], first: list[int], second: list[int], draws: np.ndarray) -> list[int]:
        """Sets ``out`` at places of ``rest``, after the outcomes of one skip that are not known are cached. What has more
        skips is not cached. The places left: few, or of long chunks."""
        get, new = self.known.get, {}
        for i in rest:
            if (n := get(chunks[i], FRESH))[1] != FRESH[1] and first[i] not in n[2]:
                new[chunks[i], first[i]] = n
        if len(new) >= TOGETHER:
            names, nodes = list(new), list(new.values())
            for i, packed, popped in self._together([c for c, _ in names], [g for _, g in names]):
                if nodes[i][2] is NONE:
                    nodes[i][2] = {}
                nodes[i][2][names[i][1]] = [packed, popped, NONE]
            self.nodes += len(new)
        left = []
        for i in rest:
            if (g := first[i]) + second[i] + 1 >= (m := get(chunks[i], FRESH)[2].get(g, FRESH))[1]:
                out[i] = m[0]
            else:
                left.append(i)
        more = [i for i in left if len(chunks[i]) <= KEPT]
        if len(more) < TOGETHER:
            return left
        for i, packed, _ in self._together([chunks[i] for i in more], [first[i] for i in more], draws[more]):
            out[more[i]] = packed
        return [i for i in left if len(chunks[i]) > KEPT]

    def _run(self, chunks: list[str], draws: np.ndarray) -> list[bytes]:
        """Ids of each chunk, whose first gap is that of its draw."""
        if self.nodes >= self.most:
            self.known.clear()
            self.nodes = 0
        self._learn(chunks)
        get, skipped = self.known.get, self._skipped
        if not self.alpha:
            return [n[0] if (n := get(c)) else skipped(c, FRESH, NEVER, NEVER, 0) for c in chunks]
        later = _mixed(draws + np.uint64(GOLDEN))
        first, second = self._gaps(draws).tolist(), self._gaps(later).tolist()
        # No skip, or one whose outcome is known.
        out = [
            n[0] if g >= (n := get(c, FRESH))[1] else m[0] if g + h + 1 >= (m := n[2].get(g, FRESH))[1] else None
            for c, g, h in zip(chunks, first, second, strict=True)
        ]
        rest = [i for i, x in enumerate(out) if x is None]
        if len(rest) >= TOGETHER:
            rest = self._skipped_together(out, rest, chunks, first, second, draws)
        for i in rest:
            out[i] = skipped(chunks[i], get(chunks[i], FRESH), first[i], second[i], int(later[i]))
        return out

    def encode(self, text: str) -> np.ndarray:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text. A literal space mark in a text goes out as its bytes, so that it is not read back as a
        space."""
        chunks, keys, ends = [], [], []
        for text in texts:
            parts = [p.replace(" ", MARK) for p in text.split(MARK)]
            if text:
                parts[0] = MARK + parts[0]
            keys.append(xxhash.xxh64_intdigest(text.encode(), self.seed) if self.alpha else 0)
            ends.append([len(chunks)])
            for p in parts:
                chunks += self.cuts.findall(p)
                ends[-1].append(len(chunks))
            if len(chunks) >= BLOCK:
                yield from self._joined(chunks, keys, ends)
                chunks, keys, ends = [], [], []
        yield from self._joined(chunks, keys, ends)

    def _joined(self, chunks: list[str], keys: list[int], ends: list[list[int]]) -> Iterator[np.ndarray]:
        """Ids of the texts with these keys; the ends of a text's parts, its start before them."""
        sizes, starts = (np.asarray(x, np.int64) for x in ([e[-1] - e[0] for e in ends], [e[0] for e in ends]))
        places = np.arange(1, len(chunks) + 1) - np.repeat(starts, sizes)
        draws = _mixed(places.astype(np.uint64) * np.uint64(GOLDEN) + np.repeat(np.asarray(keys, np.uint64), sizes))
        packed = list(chain.from_iterable(self._run(chunks[i : i + BLOCK], draws[i : i + BLOCK]) for i in range(0, len(chunks), BLOCK)))
        literal = b"".join(self.byte[b].to_bytes(4, "little") for b in MARK.encode())
        for e in ends:
            yield np.frombuffer(literal.join(b"".join(packed[a:b]) for a, b in zip(e, e[1:], strict=False)), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=4)
def dropout_encoder(model: str, seed: int, alpha: float) -> DropoutEncoder:
    return DropoutEncoder(model, seed, alpha)


def encode_pieces(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, alpha: float = 0.1, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_crc32 (little-endian uint32 ids), lossless (and ids, if kept), without a shuffle.

    Null and empty texts have no pieces; equal texts have equal ids, whatever their doc_id, which may be null; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = dropout_encoder(model, seed, alpha)
        gc.freeze()  # nothing of the cache is garbage
        for batch in text_slices(batches):
            size, n, crc, same, kept = [], [], [], [], []
            texts = batch.column(1).to_pylist()
            for text, ids in zip(texts, enc.encode_all(texts), strict=True):
                size.append(len(text.encode()))
                n.append(len(ids))
                crc.append(zlib.crc32(ids))
                same.append(enc.decode(ids) == text)
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (size, n, crc)), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_bytes", "n_pieces", "ids_crc32", "lossless"]
            if keep_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, lossless boolean" + ", ids array<int>" * keep_ids
    return doc_rows(docs, id_col, text_col).mapInArrow(run, schema)
