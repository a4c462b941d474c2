"""Duplicate operators against brute force on small corpora."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import repeats, simhash
from tidemark.llm.components import connected_components
from tidemark.llm.run_length_index import RunLengthIndex, byte_dedup, shard_repeats
from tidemark.llm.simhash import drop_near_copies, near_duplicates
from tidemark.llm.substring_dedup import SuffixAutomaton, drop_repeats, shard_firsts, substring_dedup

SCHEMA = "doc_id long, text string, key string, spans int, n_chars long"


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "d", "ee", "Fü"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [line(30), line(60)]
    docs = [None, "", "one", "a" * 900, "ab " * 400, shared[0]]
    for _ in range(25):
        parts = [line(rng.randint(1, 25)) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.6:
            parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        docs.append("\n".join(parts))
    docs += docs[8:12]
    return list(enumerate(docs))


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "k", 1, len(t or "")) for i, t in docs], SCHEMA)


def brute_words(docs, window):
    first: dict = {}
    cut = {i: (t or "").encode().split() for i, t in docs}
    for i in sorted(cut):
        for a in range(len(cut[i]) - window + 1):
            first.setdefault(tuple(cut[i][a : a + window]), i)
    out = {}
    for i, w in cut.items():
        gone = np.zeros(len(w), bool)
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


def brute_bytes(docs, window):
    seen = collections.Counter((t or "").encode()[a : a + window] for _, t in docs for a in range(len((t or "").encode()) - window + 1))
    out = {}
    for i, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - window + 1):
            if seen[raw[a : a + window]] > 1:
                gone[a : a + window] = b"\x01" * window
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("split", [500, 1])
def test_substring_dedup(spark, monkeypatch, split):
    monkeypatch.setattr(repeats, "SPLIT", split)
    docs = corpus()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(frame(spark, docs), window=20, k=6).collect()}
    assert got == brute_words(docs, 20)


@pytest.mark.parametrize("split", [500, 1])
def test_byte_dedup(spark, monkeypatch, split):
    monkeypatch.setattr(repeats, "SPLIT", split)
    docs = corpus(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in byte_dedup(frame(spark, docs), window=60, k=20).collect()}
    assert got == brute_bytes(docs, 60)


def test_odd_tables(spark):
    none = frame(spark, [])
    assert substring_dedup(none).count() == byte_dedup(none).count() == near_duplicates(none).count() == drop_near_copies(none).count() == drop_repeats(none).count() == 0
    text = "w x y z " * 30
    odd = spark.createDataFrame([(None, text, "k", 1, 0), (7, text, "k", 1, 0), (7, text, "k", 1, 0), (9, text, "k", 1, 0)], SCHEMA)
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup(odd).collect()) == [("7", 0), ("7", 0), ("9", 120), ("None", 0)]
    assert {r["n_removed"] for r in byte_dedup(odd).collect()} == {len(text)}
    assert {r["component_id"] for r in near_duplicates(odd).collect()} == {7}
    assert [r["doc_id"] for r in drop_near_copies(odd).collect()] == [7]
    left = drop_repeats(odd)
    assert left.columns == odd.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["7", "7", "None"]


def test_near_duplicates(spark):
    docs = corpus(7)
    prints = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[a : a + 3]) for a in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    part = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 2 and part[j] < part[i]:
                    part[i], changed = part[j], True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(frame(spark, docs)).collect()}
    assert got == {i: (f"{prints[i]:016x}", part[i]) for i in prints}


def stored(monkeypatch):
    """Plan and rows of all that the search for repeats stores, in order."""
    seen, real = [], repeats.materialize

    def spy(df, tag):
        plan, made = df._jdf.queryExecution().executedPlan().toString(), real(df, tag)
        seen.append((plan, made.count()))
        return made

    monkeypatch.setattr(repeats, "materialize", spy)
    return seen


def behind_one_passage(n, seed=17):
    """Texts that begin with the same 400 bytes."""
    rng = random.Random(seed)
    line = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    passage = line(60)[:400]
    return [(i, passage + line(60)) for i in range(n)]


def test_spans_of_hot_anchors_are_not_broadcast(spark, monkeypatch):
    """The files of these tables are a hundredth of what their rows take, so no size of theirs may lead to a broadcast."""
    monkeypatch.setattr(repeats, "SPLIT", 20)
    seen, docs = stored(monkeypatch), behind_one_passage(60)
    out = byte_dedup(frame(spark, docs))
    assert {r["doc_id"]: tuple(r[1:]) for r in out.collect()} == brute_bytes(docs, 200)
    plans = [*(plan for plan, _ in seen), out._jdf.queryExecution().executedPlan().toString()]
    joins = [line for plan in plans for line in plan.splitlines() if re.search(r"Join \[sd#", line)]
    assert len(joins) >= 2 and not any("Broadcast" in line for line in joins)


def test_rows_of_hot_anchors_stay_few(spark, monkeypatch):
    """Windows over the ends of a common passage are gone through in few steps, and equal pieces are one row."""
    monkeypatch.setattr(repeats, "SPLIT", 20)
    seen, docs = stored(monkeypatch), behind_one_passage(150)
    assert {r["doc_id"]: tuple(r[1:]) for r in byte_dedup(frame(spark, docs)).collect()} == brute_bytes(docs, 200)
    pieces = [n for plan, n in seen if re.search(r"Join \[anchor#\w+\], \[anchor#\w+\], LeftSemi", plan) and "MapInArrow" not in plan]
    assert 0 < sum(pieces) <= 5 * len(docs)


def test_rows_cut_from_hot_segments_grow_with_their_number(spark, monkeypatch):
    """A segment over an end of a common passage makes few rows, and twice the group makes twice the rows."""
    monkeypatch.setattr(repeats, "SPLIT", 20)
    made = []
    for n in (150, 300):
        with monkeypatch.context() as m:
            seen, docs = stored(m), behind_one_passage(n)
            assert {r["doc_id"]: tuple(r[1:]) for r in byte_dedup(frame(spark, docs)).collect()} == brute_bytes(docs, 200)
        made.append(sum(rows for plan, rows in seen if re.search(r"MapInArrow run\(.*, up#", plan)))
    assert 0 < made[0] <= 7 * 150 and made[1] <= 2.4 * made[0]


@pytest.mark.parametrize("many", [20000, 0])
@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_hot_segments_beside_a_reference(spark, monkeypatch, unit, many):
    """Passages with other texts before, behind and inside, changed places and grams that come twice, all hot."""
    monkeypatch.setattr(repeats, "SPLIT", 1)
    monkeypatch.setattr(repeats, "MANY", many)
    rng = random.Random(23)
    line = lambda n: " ".join(rng.choice(["ab", "c", "dd", "e", "fgh"]) for _ in range(n))
    base = line(60)
    docs = [None, "", base, "x " * 90, "x " * 70 + "y", "y " + "x " * 80]
    for _ in range(24):
        a, b = sorted(rng.sample(range(len(base)), 2))
        docs += [line(rng.randint(0, 9)) + " " + base[: rng.choice([a, 999])] + line(rng.randint(0, 3)) + base[b:] + " " + line(rng.randint(0, 9))]
    docs = list(enumerate(docs + docs[7:9]))
    if unit == "bytes":
        got = {r["doc_id"]: tuple(r[1:]) for r in byte_dedup(frame(spark, docs), window=60, k=20).collect()}
        assert got == brute_bytes(docs, 60)
    else:
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(frame(spark, docs), window=12, k=4).collect()}
        assert got == brute_words(docs, 12)


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_rows_of_spans_do_not_grow_with_windows(spark, monkeypatch, unit):
    """Hot text of a short period: a segment joins its copies with one row, whatever the number of its windows."""
    monkeypatch.setattr(repeats, "SPLIT", 10)
    rows, real, rng = {}, repeats.materialize, random.Random(29)

    def spy(df, tag):
        made = real(df, tag)
        rows.setdefault(tag, []).append((made.count(), made.select("sd").distinct().count() if "sd" in made.columns else 0))
        return made

    monkeypatch.setattr(repeats, "materialize", spy)
    line = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    docs = [(i, line(9) + (" is on dr" * 80)[rng.randrange(9) :][: rng.randrange(400, 700)] + line(i % 3)) for i in range(60)]
    docs += [(60 + i, t) for i, t in docs[:30]]
    if unit == "bytes":
        windows = repeats.Unit(100, 32, repeats.byte_symbols, repeats.byte_cut)
        found = repeats.repeated_windows(repeats.keyed(frame(spark, docs), "doc_id", "text"), windows, shard_repeats, across=False)
    else:
        windows = repeats.Unit(30, 10, repeats.word_symbols, repeats.word_cut)
        found = repeats.repeated_windows(repeats.keyed(frame(spark, docs), "doc_id", "text"), windows, shard_firsts, across=True)
    assert 0 < found.count() <= rows["segments"][0][0]
    assert len(rows["finer"]) >= 2 and all(n == sds for n, sds in rows["spans"])
    assert sum(n for n, _ in rows["finer"]) <= 20 * rows["distinct"][0][0]
    runs = found.selectExpr("doc_id", "inline(runs)").collect()
    begin = {(r["doc_id"], r["start"], r["first"]) for r in runs}
    assert sum((r["doc_id"], r["start"] + r["n"], r["first"]) in begin for r in runs) <= rows["segments"][0][0]
    if unit == "bytes":
        assert {r["doc_id"]: tuple(r[1:]) for r in byte_dedup(frame(spark, docs), window=100, k=32).collect()} == brute_bytes(docs, 100)
    else:
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(frame(spark, docs), window=30, k=10).collect()}
        assert got == brute_words(docs, 30)


def test_near_copies_leave_one(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    near = list(base)
    near[50] = near[120] = "changed"
    far = [w if rng.random() < 0.7 else "other" for w in base]
    docs = [(5, " ".join(base)), (3, " ".join(near)), (9, " ".join(base)), (1, " ".join(far)), (2, None), (4, "")]
    out = drop_near_copies(frame(spark, docs))
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 3]


def survivors(docs, similarity=0.8):
    """Smallest id of each group, by all pairs."""
    sets = {i: {tuple(w[a : a + 5]) for a in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in docs)}
    part = {i: i for i in sets}

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and top(i) != top(j) and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                x, y = sorted((top(i), top(j)))
                part[y] = x
    return sorted(i for i in sets if part[i] == i)


def test_near_copies_of_a_large_family(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    docs = []
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(200), 3):
            copy[at] = f"x{rng.randint(0, 10**6)}"
        docs.append((i, " ".join(copy)))
    assert sorted(r["doc_id"] for r in drop_near_copies(frame(spark, docs)).collect()) == survivors(docs)


def test_near_copies_by_contiguous_edits(spark):
    rng = random.Random(6)
    line = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    texts = []
    for _ in range(40):
        base = line(rng.randint(60, 250))
        n = len(base)
        k = int(n * rng.uniform(0.08, 0.12))
        at = rng.randint(0, n)
        cut = int(n * rng.uniform(0.15, 0.22))
        texts += [base, base[: n - k] + line(k), base[: n - cut], base[:at] + line(cut) + base[at:], base + line(cut)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert sorted(r["doc_id"] for r in drop_near_copies(frame(spark, docs)).collect()) == survivors(docs)


@pytest.mark.parametrize("block", [4096, 7])
def test_near_copies_over_one_vocabulary(spark, monkeypatch, block):
    """Few words in all texts, so that sketches and fingerprints are alike; long lists are met in parts."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(11)
    texts = []
    for i in range(150):
        base = [f"v{rng.randint(0, 59)}" for _ in range(rng.randint(80, 200))]
        texts.append(base)
        if i % 5 == 0:
            twin = list(base)
            twin[rng.randrange(len(twin))] = "v60"
            texts.append(twin)
    common = [f"c{i}" for i in range(60)]  # in a third of all, and most of some
    texts += [common + [f"v{rng.randint(0, 59)}" for _ in range(rng.randint(4, 60))] for _ in range(60)]
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = sorted(r["doc_id"] for r in drop_near_copies(frame(spark, docs)).collect())
    assert kept == survivors(docs) and len(kept) <= len(docs) - 30


def test_near_copies_go_through_ball_hashing(spark, monkeypatch):
    """The pairs of fingerprints within two bits chain all such links, and the stage finds copies by them alone."""
    from corpus_pipeline import near_copies_stage

    rng = random.Random(23)
    prints = [rng.getrandbits(63) for _ in range(12)]
    prints += [f ^ 1 << rng.randrange(62) for f in prints] + [f ^ 3 << rng.randrange(61) for f in prints] + prints[:3]
    rows = spark.createDataFrame(list(enumerate(prints)), "rid long, fp long")
    pairs = {tuple(r) for r in simhash.fingerprint_pairs(rows, 2).collect()}
    assert all(a < b and (prints[a] ^ prints[b]).bit_count() <= 2 for a, b in pairs)
    part = list(range(len(prints)))
    for a, b in sorted(pairs) * len(prints):
        part[a] = part[b] = min(part[a], part[b])
    assert all(part[i] == part[j] for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2)

    base = [[f"w{rng.randint(0, 10**6)}" for _ in range(2000)] for _ in range(5)]
    docs = [(i, " ".join(b)) for i, b in enumerate(base)] + [(10 + i, " ".join([*b, "end"])) for i, b in enumerate(base)]
    print_of = {i: simhash.fingerprint(simhash.shingle_hashes(simhash.words(t), 5)) for i, t in docs}
    within = {i for i in range(5) if (print_of[i] ^ print_of[10 + i]).bit_count() <= 2}
    monkeypatch.setattr(simhash, "_meet", lambda *_: lambda batches: (pa.RecordBatch.from_pydict({"a": [], "b": []}, pa.schema([("a", pa.int64()), ("b", pa.int64())])) for _ in batches))
    kept = {r["doc_id"] for r in near_copies_stage(spark, frame(spark, docs), "").collect()}
    assert len(within) >= 3 and kept == {*range(5)} | {10 + i for i in range(5) if i not in within}


def test_near_copies_meet_once_in_a_passage():
    """Rows that share ten tokens in a row are a pair once; a row that joins at the sixth is one with each there."""
    batches = []
    for place in range(10):
        rids = [0, 1] if place < 5 else [0, 1, 2]
        before = [None if place == 0 or r == 2 and place == 5 else place - 1 for r in rids]
        cols = {"place": [place] * len(rids), "side": [0] * len(rids), "rid": rids, "n": [100] * len(rids), "comp": rids, "before": pa.array(before, pa.int64()), "sketch": [bytes(32)] * len(rids)}
        batches.append(pa.RecordBatch.from_pydict(cols))
    got = [tuple(r.values()) for b in simhash._meet(0.8, None)(iter(batches)) for r in b.to_pylist()]
    assert sorted(got) == [(0, 1), (0, 2), (1, 2)]


def test_near_copies_keep_rows_of_one_doc_id(spark):
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(30)) for _ in range(3)]
    docs = [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[2]), (2, texts[1].upper())]
    out = drop_near_copies(frame(spark, docs)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted([("1", texts[0]), ("1", texts[1]), ("None", texts[2])])


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in connected_components(chain, "a", "b").collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}


def test_structures():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(12)]
    index = RunLengthIndex(texts, 8)
    stats = index.matching_statistics()
    suffixes = [t[i:] for t in texts for i in range(len(t))]
    for k, s in enumerate(suffixes):
        want = max(next((n for n, (x, y) in enumerate(zip(s, o, strict=False)) if x != y), min(len(s), len(o))) for j, o in enumerate(suffixes) if j != k)
        assert stats[k] == min(want, index.depth)
        pattern = s[: rng.randint(1, index.depth)]
        assert index.count(pattern) == sum(o.startswith(pattern) for o in suffixes)
    assert index.count(b"abx") == 0 and index.runs <= len(suffixes)
    automaton = SuffixAutomaton()
    for i, t in enumerate(texts):
        automaton.add(list(t), i)
    for t in texts:
        want = {a: next(i for i, o in enumerate(texts) if t[a : a + 4] in o) for a in range(len(t) - 3)}
        assert dict(automaton.windows(list(t), 4)) == want
