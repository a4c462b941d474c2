"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant within r bits of each. Every distinct
fingerprint emits all its variants within half the radius, the shuffle brings equal variants together, and
neighbours in a variant's group (at most one fingerprint per variant bit, whatever the number of documents)
are verified and linked: all of a group lie within the radius of each other, so a chain links what all pairs
would. Copies share a fingerprint and never meet as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.components import connected_components
from tidemark.llm.shared import discard, doc_rows, materialize, text_slices, trim


def words(text: str) -> list[bytes]:
    """A-Z lower-cased, cut at bytes 09-0D and 20."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(tokens: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each space-joined shingle, repeats included; of the whole sequence when it is shorter."""
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), seed)], np.uint64)
    line, at = b" ".join(tokens), 0
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[starts[at] : stops[at + size - 1]], seed) for at in range(len(tokens) - size + 1)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint as a long; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            fps = np.array([fingerprint(shingle_hashes(words(t), shingle)) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        trim()

    return doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def flips(bits: int, half: int) -> list[int]:
    """Masks of at most ``half`` of the ``bits``, as signed longs."""
    masks = [sum(1 << i for i in c) for n in range(half + 1) for c in combinations(range(bits), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def linked(distinct: DataFrame, radius: int, bits: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` (within equal ``by``) that chain all links of at most ``radius`` bits."""
    half = -(-radius // 2)
    variants = distinct.select(*by, "fp", F.explode(F.array(*map(F.lit, flips(bits, half)))).alias("flip")).select(*by, "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    group = Window.partitionBy(*by, "variant").orderBy("fp")
    pairs = variants.withColumn("a", F.lag("fp").over(group)).filter(F.col("a").isNotNull())
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius).select(*by, "a", F.col("fp").alias("b")).distinct()


def fingerprint_pairs(rows: DataFrame, radius: int) -> DataFrame:
    """(a, b), a < b: of the rows (rid, fp) each with the least of its fingerprint, and those of linked fingerprints."""
    least = rows.groupBy("fp").agg(F.min("rid").alias("least"))
    same = rows.join(least, "fp").filter("rid <> least").select(F.col("least").alias("a"), F.col("rid").alias("b"))
    x, y = (least.select(F.col("fp").alias(c), F.col("least").alias(f"of_{c}")) for c in "ab")
    near = linked(least.select("fp"), radius).join(x, "a").join(y, "b")
    return same.unionByName(near.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row.

    Null and empty texts have fingerprint zero, linked like any other; rows with a null doc_id get their
    component but never name it; repeated rows stay; an empty table gives no rows. ``radius`` must be even:
    a chain within a variant's group then never spans more than it.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    marked = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    least = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = connected_components(linked(least.select("fp"), radius), "a", "b")
    rooted = materialize(least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(rooted.join(materialize(named, "named"), "root").select("fp", "component_id"), "named")
    return marked.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SKETCH = 256  # fewest bits of a row's sketch, which goes with each of its shingles; others have half as many as shingles
SAMPLED, HOT_SHINGLES = 10_000, 100_000
CHAINED = 4  # of a row's shared shingles so many of the rarest and of the commonest are followed before all are
BLOCK = 4096  # rows of a shingle that meet in one place
LARGE = 64  # rows of a place from which on its rows are compared one by one with all others


def parity(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of a sketch: whether each of ``bits`` (a power of two) places has an odd number of the shingles."""
    return np.packbits((np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(bool))


def _long_sketches(size: int):
    """A sketch of at least as many bits as the set has shingles, at most doubled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2 << 20):
            n, made = [], []
            for t in batch.column("text").to_pylist():
                own = np.unique(shingle_hashes(words(t), size))
                n.append(len(own))
                made.append(parity(own, max(64, 1 << (len(own) - 1).bit_length()) if len(own) else 64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(n, pa.int32()), pa.array(made, pa.binary())], names=["rid", "n", "sketch"])
        trim()

    return run


def _unlike(similarity: float):
    """Pairs (a, b, x, nx, y, ny) whose long sketches do not rule the similarity out. Of two lengths the longer sketch is
    folded: its parts together have the parity of the shorter one's places."""
    apart = (1 - similarity) / (1 + similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, nx, y, ny in zip(*(batch.column(c).to_pylist() for c in ("x", "nx", "y", "ny")), strict=True):
                short, long = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
                folded = np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)
                keep.append(int(np.bitwise_count(short ^ folded).sum()) <= apart * (nx + ny) + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return run


def _marks(hot: np.ndarray, size: int, similarity: float):
    """doc_id, the text's digest, a digest of the word sequence, the fingerprint, and of its set of shingles the size,
    the prefix and a sketch.

    The prefix is taken in one order of all shingles: those not in ``hot`` by hash, then ``hot`` from its end.
    Two sets of the asked similarity share a shingle of both prefixes. A sketch has the parity of the number
    of shingles in each of its places, so two differ in no more bits than the sets in shingles.
    """
    by_hash = np.argsort(hot)
    known = hot[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            digests, prints, sizes, prefixes, sketches = [], [], [], [], []
            for t in batch.column("text").to_pylist():
                tokens = words(t)
                digests.append(xxhash.xxh3_128_digest(b" ".join(tokens)))
                hashes = shingle_hashes(tokens, size)
                prints.append(fingerprint(hashes))
                own = np.unique(hashes)
                n = len(own)
                most = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    is_hot = known[at] == own
                    order = np.concatenate([own[~is_hot], hot[np.sort(by_hash[at[is_hot]])[::-1]]])
                else:
                    order = own
                sizes.append(n)
                prefixes.append(order[:most].view(np.int64))
                sketches.append(parity(own, max(SKETCH, 1 << (n // 2).bit_length())).tobytes())
            cols = [*(batch.column(c) for c in ("doc_id", "t1", "t2")), pa.array(digests, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "t1", "t2", "digest", "fp", "n", "prefix", "sketch"])
        trim()

    return run


def _shingle_sets(size: int, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2 << 20):
            sets = [np.unique(shingle_hashes(words(t), size)).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sets, pa.list_(pa.int64()))], names=[key, "shingles"])
        trim()

    return run


def _hot_shingles(rows: DataFrame, size: int) -> np.ndarray:
    """The commonest shingles of a sample, commonest first. They only set the order of shingles, never the result."""
    every = max(1, rows.count() // SAMPLED)
    sets = rows.filter(F.pmod(F.xxhash64("t1"), F.lit(every)) == 0).dropDuplicates(["t1"]).select("t1", "text").mapInArrow(_shingle_sets(size, "t1"), "t1 long, shingles array<long>")
    found = sets.select(F.explode("shingles").alias("s")).groupBy("s").count().filter("count >= 5").orderBy(F.desc("count"), "s").limit(HOT_SHINGLES)
    return found.select("s").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)


class _Sketches:
    """The sketches of a table's rows, by length; of two lengths the longer is folded to half or less: its parts
    together have the parity of the shorter one's places."""

    def __init__(self, column: pa.ChunkedArray):
        raw = column.to_pylist()
        sizes = np.array([len(x) // 8 for x in raw])
        self.size = sizes
        self.place, self.matrix = {}, {}
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes >= size)
            made = np.empty((len(rows), size), np.uint64)
            for other in np.unique(sizes[rows]).tolist():
                of = np.flatnonzero(sizes[rows] == other)
                own = np.frombuffer(b"".join(raw[i] for i in rows[of]), np.uint64).reshape(len(of), other // size, size)
                made[of] = np.bitwise_xor.reduce(own, axis=1)
            self.place[size] = np.cumsum(sizes >= size) - 1
            self.matrix[size] = made

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Differing bits of the rows i and j."""
        out = np.empty(len(i), np.int64)
        least = np.minimum(self.size[i], self.size[j])
        for size in np.unique(least).tolist():
            at, place, matrix = np.flatnonzero(least == size), self.place[size], self.matrix[size]
            for k in range(0, len(at), max(1, (1 << 20) // size)):
                part = at[k : k + max(1, (1 << 20) // size)]
                out[part] = np.bitwise_count(matrix[place[i[part]]] ^ matrix[place[j[part]]]).sum(1, dtype=np.int64)
        return out


def _meet(similarity: float, span: int | None, best: bool = False):
    """(a, b) of the rows (place, side, rid, n, comp, before, sketch; ordered by place) that meet at a place, lie in different
    components, and whose sizes and sketches do not rule the similarity out. ``span`` bounds the distance of two
    rows in a place's list; None takes all pairs, but where a place has rows of two sides only those across.
    ``best``: of each row's pairs only the one whose sketches are the most alike. ``before``: the token a row has before
    this one, or null. Two rows with the same one meet there, too, so a pair is given where what is before differs, and
    at its first token always."""
    most_apart = (1 - similarity) / (1 + similarity)

    def pairs(t: pa.Table) -> pa.RecordBatch:
        place, side, rid, n, comp = (t.column(c).to_numpy() for c in ("place", "side", "rid", "n", "comp"))
        before, begins = t.column("before").fill_null(0).to_numpy(), t.column("before").is_null().to_numpy()
        sketches = _Sketches(t.column("sketch"))
        found = [np.empty((0, 2), np.int64)]
        nearest, partner = np.full(len(place), 2.0), np.zeros(len(place), np.int64)

        def compare(i: np.ndarray, j: np.ndarray) -> None:
            """Takes in the pairs of rows i and j (of one place) that may be alike. i has each row once, or one row only."""
            x, y = n[i], n[j]
            fits = (comp[i] != comp[j]) & (begins[i] | begins[j] | (before[i] != before[j])) & ((side[i] != side[j]) | (side[i] == 0)) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6)
            i, j = i[fits], j[fits]
            share = sketches.apart(i, j) / (n[i] + n[j])
            near = share <= most_apart + 1e-9
            i, j, share = i[near], j[near], share[near]
            if best:
                for own, other in ((j, i), (i, j)):
                    order = np.argsort(-share, kind="stable")  # of a row that repeats the least share is written last
                    own, other, least = own[order], other[order], share[order]
                    nearer = least < nearest[own]
                    nearest[own[nearer]], partner[own[nearer]] = least[nearer], other[nearer]
            else:
                found.append(np.stack([np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])], 1))
                if len(found) > 256:
                    found[:] = [np.unique(np.concatenate(found), axis=0)]

        edges = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
        sizes = np.diff(edges)
        large = np.zeros(len(sizes), bool) if span else sizes > LARGE
        at, d = np.flatnonzero(~np.repeat(large, sizes)), 0
        while len(at) and (span is None or d < span):  # rows that are d apart, of all small places at once
            d += 1
            at = at[at < len(place) - d]
            at = at[place[at] == place[at + d]]
            compare(at, at + d)
        for k in np.flatnonzero(large):  # all rows but those of the largest component, each with all others
            rows = np.arange(edges[k], edges[k + 1])
            kinds, counts = np.unique(comp[rows], return_counts=True)
            for i in rows[comp[rows] != kinds[counts.argmax()]]:
                compare(np.full(len(rows), i), rows)
        if best:
            i = np.flatnonzero(nearest < 2)
            found.append(np.stack([np.minimum(rid[i], rid[partner[i]]), np.maximum(rid[i], rid[partner[i]])], 1))
        out = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            place = batch.column("place").to_numpy()
            start = int(np.argmax(place == place[-1]))  # the last place's rows may go on in the next batch
            if start:
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, start)]))
                held = [batch.slice(start)]
            elif held and held[-1].column("place")[-1].as_py() != place[0]:
                yield pairs(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield pairs(pa.Table.from_batches(held))
        trim()

    return run


def _places(tokens: DataFrame, all_pairs: bool) -> DataFrame:
    """``place`` and ``side`` of the rows (token, rid, c, ...; c: how many rows the token has). A token of more than
    BLOCK rows has several lists. For chains a row is in one of them, another one for each of its tokens. For
    all pairs the lists are met two by two: a row goes to all places of its list, as side 1 or 2 of two."""
    lists = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rid", "token"), lists).cast("int")
    if not all_pairs:
        return tokens.withColumn("place", F.xxhash64("token", own)).withColumn("side", F.lit(0))
    other = tokens.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), lists - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    # Both sides of two lists, and the rows of one list among themselves, have a place of their own.
    return other.withColumn("side", side).withColumn("place", F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))).drop("own", "other")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, with one row (smallest doc_id) of each group of near copies.

    A pair links if the Jaccard similarity of its sets of ``shingle``-word shingles is at least ``similarity``;
    links are followed. Ball hashing of the fingerprints gives the first pairs, those within ``radius`` bits, and each
    is verified on the whole sets. Copies farther apart than fingerprints tell are found as exactly: every pair that can
    link shares a shingle of both prefixes. Pairs in chains are verified with the first, then the most alike, at last all
    pairs that share a prefix shingle, are not yet in one group and whose sketches allow it. Texts of the same words are copies, null and empty ones among them; a null doc_id comes after
    all others; repeated rows are copies; an empty table stays empty.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    doc_id, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    marks = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]  # 128 bits tell texts of one doc_id apart
    rows = docs.select(doc_id.alias("doc_id"), *marks, text.alias("text"))
    hot = _hot_shingles(rows, shingle)
    marked = materialize(rows.mapInArrow(_marks(hot, shingle, similarity), "doc_id long, t1 long, t2 long, digest binary, fp long, n int, prefix array<long>, sketch binary"), "marks")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "t1", "t2")
    best = marked.groupBy("digest").agg(F.min(order).alias("best"))
    # Texts of the same words are one node from here on.
    distinct = materialize(best.select(F.monotonically_increasing_id().alias("rid"), F.col("best.doc_id").alias("doc_id"), F.col("best.t1").alias("t1"), F.col("best.t2").alias("t2")), "distinct")
    same = [marked.doc_id.eqNullSafe(distinct.doc_id), marked.t1 == distinct.t1, marked.t2 == distinct.t2]
    own = materialize(marked.join(distinct, same).select("rid", "fp", "n", "prefix", "sketch").dropDuplicates(["rid"]), "prefixes")
    discard(marked)
    tokens = own.select("rid", F.explode("prefix").alias("token"))
    met = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    of_row = Window.partitionBy("rid")  # a prefix is as long as a text at most
    ends = (F.row_number().over(of_row.orderBy(x, "token")) <= CHAINED for x in (F.col("c"), F.desc("c")))
    shared = materialize(tokens.join(met, "token").withColumns({"rare": next(ends), "common": next(ends)}).select("rid", "token", "c", (F.col("rare") | F.col("common")).alias("early")), "shared")

    def candidates(at: DataFrame, span: int | None, best: bool = False) -> DataFrame:
        last = F.lag("token").over(Window.partitionBy("rid").orderBy(F.desc("c"), "token")) if span is None and not best else F.lit(None).cast("long")
        full = _places(at.withColumn("before", last), span is None).join(own.select("rid", "n", "sketch"), "rid").select("place", "side", "rid", "n", "comp", "before", "sketch", F.xxhash64("rid", "place").alias("draw"))
        listed = full.repartition("place").sortWithinPartitions("place", "draw").drop("draw")
        return listed.mapInArrow(_meet(similarity, span, best), "a long, b long")

    def texts_of(pairs: DataFrame) -> DataFrame:
        """rid and text of the rows in pairs; rows of one doc_id and text may come twice."""
        asked = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct().join(distinct, "rid")
        asked = asked.select("rid", F.col("doc_id").alias("d"), F.col("t1").alias("x1"), F.col("t2").alias("x2"))
        return rows.join(asked, [F.col("doc_id").eqNullSafe(F.col("d")), F.col("t1") == F.col("x1"), F.col("t2") == F.col("x2")]).select("rid", "text")

    def paired(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
        """Pairs with the columns of both rows: the first column as x and y, others as nx and ny."""
        x, y = (of.select(F.col("rid").alias(k), *(F.col(c).alias("n" * i + v) for i, c in enumerate(columns))) for k, v in (("a", "x"), ("b", "y")))
        return pairs.join(x, "a").join(y, "b")

    def verified(found: DataFrame) -> DataFrame:
        pairs = materialize(found.distinct(), "pairs")
        sketches = materialize(texts_of(pairs).mapInArrow(_long_sketches(shingle), "rid long, n int, sketch binary").dropDuplicates(["rid"]), "sketches")
        near = materialize(paired(pairs, sketches, "sketch", "n").select("a", "b", "x", "nx", "y", "ny").mapInArrow(_unlike(similarity), "a long, b long"), "near")
        discard(pairs, sketches)
        sets = materialize(texts_of(near).mapInArrow(_shingle_sets(shingle, "rid"), "rid long, shingles array<long>").dropDuplicates(["rid"]), "shingles")
        both = F.size(F.array_intersect("x", "y"))
        links = materialize(paired(near, sets, "shingles").filter(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b"), "links")
        discard(near, sets)
        return links

    # Fingerprints that link, and chains along a few shingles first; then, as long as many more are found, of each row's pairs at one of these the
    # most alike; at last all pairs at all shingles. What is in one group is no pair any more.
    chains = candidates(shared.filter("early").withColumn("comp", F.col("rid")), 1)
    links = verified(fingerprint_pairs(own.select("rid", "fp"), radius).unionByName(chains))
    best, total = True, links.count()
    roots = connected_components(links, "a", "b")
    while True:
        placed = materialize(shared.join(roots, shared.rid == roots.node, "left").select("token", "rid", "early", F.coalesce("root", "rid").alias("comp")), "placed")
        at = placed.filter("early") if best else placed
        mixed = at.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("c")).filter("x < y").select("token", "c")
        more = verified(candidates(at.join(mixed, "token"), None, best))
        discard(placed)
        roots = connected_components(roots.toDF("a", "b").unionByName(more), "a", "b")
        if not best:
            break
        grown = more.count()
        best, total = grown * 2 > total, total + grown
    discard(shared, own)
    grouped = distinct.join(roots, distinct.rid == roots.node, "left").groupBy(F.coalesce("root", "rid").alias("root")).agg(F.min(order).alias("best"))
    kept = materialize(grouped.select(F.col("best.doc_id").alias("__d"), F.col("best.t1").alias("__t1"), F.col("best.t2").alias("__t2")), "kept")
    found = docs.withColumns({"__id": doc_id, "__x1": marks[0], "__x2": marks[1]})
    found = found.join(kept, [F.col("__id").eqNullSafe(F.col("__d")), F.col("__x1") == F.col("__t1"), F.col("__x2") == F.col("__t2")], "left_semi")
    return found.dropDuplicates(["__id", "__x1", "__x2"]).select(*(found[f"`{c}`"] for c in docs.columns))
