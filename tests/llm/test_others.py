"""Fingerprints, toxicity, vector search and the pipeline on small fixtures."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import merkle, toxicity, voronoi
from tidemark.llm.merkle import fingerprint_edits, merkle_trees
from tidemark.llm.voronoi import top_k

DOCS = "doc_id long, text string, bucket string, guest int"


def test_fingerprints(spark):
    rng = random.Random(0)
    texts = {i * 3: "\n".join(" ".join(f"w{rng.randint(0, 999)}" for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 9))) for i in range(40)}
    texts |= {500: None, 501: "", 502: texts[3], 503: "x" * 300, 504: "é\n\nü"}
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in texts.items()], DOCS)
    got = {r["doc_id"]: r for r in fingerprint_edits(df).collect()}
    assert got.keys() == texts.keys()
    order = sorted(texts, reverse=True)
    for k, i in enumerate(order):
        text, nxt = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (got[i]["fingerprint"] == got[i]["edited_fingerprint"]) == (text == edited)
        assert (got[i]["near_next"] == 1.0) == (text == nxt) or got[i]["near_next"] < 1
        assert 0 <= got[i]["near_edited"] <= 1
    assert got[3]["fingerprint"] == got[502]["fingerprint"]
    assert len({g["fingerprint"] for g in got.values()}) == len({t or "" for t in texts.values()})
    long = [g for i, g in got.items() if i < 500 and g["n_chars"] > 150]
    assert np.mean([g["near_edited"] for g in long]) > 0.5 > 0.2 > np.mean([g["near_next"] for g in long])
    assert fingerprint_edits(df.limit(0)).count() == 0
    one = fingerprint_edits(df.filter("doc_id = 3")).first()
    assert one["near_next"] == 1.0
    twice = spark.createDataFrame([(None, "a b c", "", 0), (4, "d", "", 0), (4, "d", "", 0)], DOCS)
    assert fingerprint_edits(twice).count() == 3
    assert merkle_trees(df).count() == len(texts)


def leaves_of(text):
    """The bag of a text's spans, by the rules that the docstrings state."""
    out = Counter()
    for line in text.split("\n"):
        span = ""
        for piece in re.findall(r"\S{4}(?=\S)|\S* |\S+", line):
            marked = xxhash.xxh64_intdigest(piece.encode(), 42) % 2 == 0
            span += piece
            if marked:
                for at in range(0, len(span), merkle.LONGEST):
                    out[span[at : at + merkle.LONGEST]] += 1
                span = ""
        for at in range(0, len(span), merkle.LONGEST):
            out[span[at : at + merkle.LONGEST]] += 1
    return out


def test_likeness_is_that_of_the_trees(spark):
    rng = random.Random(5)
    words = [f"{'abcdefghij'[i % 10]}{i}" * (1 + i % 3) for i in range(40)]
    texts = {i: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 5))) for i in range(60)}
    texts |= {100: "Ndnd " * 40, 101: "a", 102: "", 103: "x" * 500, 104: "\x01\x03 \x02a"}
    got = {r["doc_id"]: r for r in fingerprint_edits(spark.createDataFrame([(i, t, "b", 1) for i, t in texts.items()], DOCS)).collect()}
    order = sorted(texts, reverse=True)

    def dice(a, b):
        x, y = leaves_of(a), leaves_of(b)
        n = x.total() + y.total()
        return 1.0 if a == b else 2 * (x & y).total() / n if n else 0.0

    for k, i in enumerate(order):
        text, nxt = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(text) // 3
        if i != 104 and order[(k + 1) % len(order)] != 104:  # its control characters are written otherwise
            assert got[i]["near_edited"] == pytest.approx(dice(text, text[: len(text) - cut] + nxt[:cut]))
            assert got[i]["near_next"] == pytest.approx(dice(text, nxt))
    assert got[100]["near_edited"] > 0.5 and got[103]["near_edited"] > 0.5
    roots = {merkle_trees(spark.createDataFrame([(1, t, "", 0)], DOCS)).first()["root"] for t in ("ab\x03cd", "ab\x02ccd", "abcd", "ab\x01cd", "ab cd", "ab\ncd")}
    assert len(roots) == 6


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    plain, bad = [f"word{i}" for i in range(300)], ["horrid", "beastly", "vilest", "wretched"]
    rows, labels = [(9000, None, "x", 1), (9001, "", "x", 1)], []
    for i in range(600):
        toxic = i % 5 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(10, 60))]
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "x", 1))
        labels.append((i, 1, int(toxic)))
    docs, given = spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, given)
    assert set(bad) <= set(model.lexicon.words)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i]["predicted"], t) for i, _, t in labels if got[i]["held_out"]]
    assert len(held) > 100 and np.mean([p == t for p, t in held]) > 0.97
    assert got[9000]["score"] == got[9001]["score"] and 0 <= got[9000]["score"] < 0.3
    assert model.lexicon.near("beasty") == model.lexicon.near("beastlyy") == model.lexicon.near("beastlx") == "beastly"
    assert model.lexicon.near("beaxxly") is None
    quoted = toxicity.features('he wrote the word "horrid" there', model.lexicon)
    aimed = toxicity.features("you are horrid there today again", model.lexicon)
    assert quoted[4] == 1 and aimed[4] == 0 and aimed[5] == 1
    assert model.score("you are horrid and beastly " + "word1 " * 20) > model.score('he wrote "horrid and beastly" ' + "word1 " * 20)
    assert (np.sign(model.weights) * np.sign(toxicity.PRIOR) >= 0).all()
    plain = toxicity.learn_lexicon([f"horrid thing {i}" for i in range(50)], [f"a horrids thing {i}" for i in range(50)])
    assert plain.kind("horrids") is None and plain.kind("horridx") == toxicity.FUZZY
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 9000").count() == 2
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, given.limit(0)).score("x") == toxicity.fit(docs, given.limit(0)).score("horrid")


def test_repeated_documents_leave_both_classes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST", 8)
    rows = [(1, f"you are horrid {i}", "x", 1) for i in range(200)] + [(i, f"plain text {i}", "x", 1) for i in range(2, 60)] + [(i, f"so horrid a thing {i}", "x", 1) for i in range(60, 90)]
    labels = [(i, 1, int(i == 1 or i >= 60)) for i in range(1, 90)]
    rows += [r for r in rows if 60 <= r[0]] * 20  # one class fills any limit of rows
    docs, given = spark.createDataFrame(rows, DOCS).coalesce(1), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert "horrid" in toxicity.fit(docs, given).lexicon.words | toxicity.fit(docs, given).lexicon.stems


def test_fit_ends_at_the_least_loss():
    """Classes of very unequal shares, nearly and wholly separable, where whole Newton steps run away."""
    rng = np.random.default_rng(2)
    for n, gap, share in ((3000, 4.0, 0.01), (3000, 0.5, 0.3), (50, 9.0, 0.001)):
        y = np.repeat([0.0, 1.0], n)
        x = np.abs(rng.normal(size=(2 * n, 7))) * 0.2 + y[:, None] * gap * np.array([1, 0, 0.3, 1, 0, 0.1, 1])
        w = toxicity._logistic(x, y, share)
        assert np.isfinite(w).all() and np.abs(w).max() < 100 and (np.sign(w[:-1]) * np.sign(toxicity.PRIOR) >= 0).all()
        z = x @ w[:-1] + w[-1]
        assert z[y == 1].mean() > 0 > z[y == 0].mean()


def test_fit_is_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_BYTES", 4000)
    rows = [(i, ("you horrid " if i % 2 else "so plain ") + "w " * 200, "x", 1) for i in range(80)]
    seen = []
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda toxic, clean: seen.extend((toxic, clean)) or toxicity.Lexicon(frozenset({"horrid"}), frozenset()))
    toxicity.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int"))
    assert [0 < sum(map(len, texts)) <= 4000 for texts in seen] == [True, True], [len(t) for t in seen]


def test_rare_terms_are_found_misspelled():
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    terms = ["".join(rng.choice(letters) for _ in range(8)) for _ in range(60)]
    clean = [f"some plain text {i}" for i in range(400)]
    toxic = [f"{terms[i % 60]} and {terms[(i + 1) % 60]} number {i}" for i in range(600)]  # each in 1 of 30
    lexicon = toxicity.learn_lexicon(toxic, clean)
    assert set(terms) <= lexicon.words
    for t in terms:
        for token in (t[:3] + t[4:], t[:6] + "é" + t[7:], t + "q", "q" + t):
            assert lexicon.kind(token) == toxicity.FUZZY and lexicon.near(token)
    assert lexicon.kind(terms[0][:2] + "éé" + terms[0][4:]) is None


def test_exact_top_k(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "BLOCK", 16)
    monkeypatch.setattr(voronoi, "GROUP", 4)
    rng = np.random.default_rng(0)
    vectors = [(i, (rng.normal(size=6) + (i % 3) * 4).round(3).tolist()) for i in range(300)]
    vectors += [(i, [0.5] * 6) for i in range(300, 360)]  # ties
    odd = [(400, None), (401, [float("nan")] * 6), (402, [float("inf")] + [0.0] * 5), (403, [None] + [1.0] * 5), (404, [])]
    df = spark.createDataFrame([(i, v, "c") for i, v in vectors + odd], "vec_id long, embedding array<float>, cell string")
    got = [tuple(r) for r in top_k(df, query_every=20).orderBy("query_id", "rank").collect()]
    ids = np.array([i for i, _ in vectors])
    x = np.floor(1024 * np.array([v for _, v in vectors], np.float32).astype(float))
    want = []
    for k, i in enumerate(ids):
        if i % 20 == 0:
            s = x @ x[k]
            order = [j for j in np.lexsort((ids, -s)) if j != k][:10]
            want += [(i, n + 1, ids[j], int(s[j])) for n, j in enumerate(order)]
    assert got == want
    assert top_k(df.limit(0)).count() == 0


def test_top_k_skips_cells_that_cannot_matter(spark):
    """Far clusters are not asked; null ids, extreme components and shorter vectors are handled."""
    rng = np.random.default_rng(1)
    vectors = [(i, (rng.normal(size=4) * 0.01 + np.eye(4)[i % 4] * 5).round(4).tolist()) for i in range(400)]
    vectors += [(None, [9.0] * 4), (1000, [5.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in top_k(df, query_every=50, k=5).orderBy("query_id", "rank").collect()]
    known = [(i, np.floor(1024 * np.array([*v, 0, 0][:4]))) for i, v in vectors if i is not None]
    want = []
    for i, q in known:
        if i % 50 == 0:
            scored = sorted(((-int(q @ x), j) for j, x in known if j != i))[:5]
            want += [(i, j, -s) for s, j in scored]
    assert sorted(got) == sorted(want)
    x = np.array([v for _, v in known])
    pivots = voronoi.choose_pivots(x, 20)
    cell, gap = voronoi._nearest(x, pivots)
    norm = np.sqrt((x * x).sum(1))
    angle = np.arccos(np.clip((x * pivots[cell]).sum(1) / (norm * np.sqrt((pivots**2).sum(1))[cell]), -1, 1))
    most = lambda of: np.array([of[cell == k].max(initial=0) for k in range(len(pivots))])
    upper = voronoi._upper(x, pivots, most(gap), most(norm), most(angle))
    scores = x @ x.T
    for k in range(len(pivots)):
        if (cell == k).any():
            assert (scores[:, cell == k].max(1) <= upper[:, k]).all()
    floor = np.sort(scores, axis=1)[:, -6]
    assert (upper < floor[:, None]).mean() > 0.5
    with pytest.raises(ValueError, match="64 bits"):
        top_k(spark.createDataFrame([(0, [1e12] * 4), (1, [1.0] * 4)], "vec_id long, embedding array<double>"))


def test_top_k_of_a_repeated_query(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "BLOCK", 16)
    rng = np.random.default_rng(3)
    vectors = [(i, (rng.normal(size=4) + 1).round(3).tolist()) for i in range(1, 200) if i % 100]
    vectors += [(100, [50.0, 0.0, 0.0, 0.0])] * 30  # a cell of the query's own rows
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    got = [(r["vec_id"], r["score"]) for r in top_k(df).orderBy("rank").collect()]
    ids = np.array([i for i, _ in vectors])
    x = np.floor(1024 * np.array([v for _, v in vectors], np.float32).astype(float))
    s = x @ x[-1]
    assert got == [(ids[j], int(s[j])) for j in np.lexsort((ids, -s)) if ids[j] != 100][:10]


def test_pipeline_keeps_clean_documents(spark):
    from corpus_pipeline import STAGES, near_copies_stage, substring_stage

    assert [n for n, _ in STAGES] == ["toxicity", "near_copies", "substring_dedup", "packing"]
    rng = random.Random(9)
    docs = [(i, " ".join(f"t{rng.randint(0, 10**6)}" for _ in range(80)), "en", "s", 0) for i in range(20)]
    passage = " ".join(f"p{i}" for i in range(60))
    docs += [(30, docs[0][1], "en", "s", 0), (31, passage + " " + docs[1][1][::-1], "en", "s", 0), (32, docs[2][1][::-1] + " " + passage, "en", "s", 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    near = near_copies_stage(spark, df, "")
    assert sorted(r["doc_id"] for r in near.collect()) == [*range(20), 31, 32]
    out = {r["doc_id"]: r for r in substring_stage(spark, near, "").collect()}
    assert passage in out[31]["text"] and passage not in out[32]["text"] and out[32]["n_chars"] == len(out[32]["text"])
    assert all(out[i]["text"] == docs[i][1] for i in range(20))


def test_pipeline_end_to_end(spark, tmp_path):
    """All four stages against a plain version of each on a small folder of tables."""
    from corpus_pipeline import run

    rng = random.Random(13)
    plain, bad = [f"word{i}" for i in range(4000)], ["horrid", "beastly", "vilest", "wretched"]
    docs, labels = [], []
    for i in range(240):
        w = [rng.choice(plain) for _ in range(rng.randint(60, 120))]
        if i % 6 == 0:
            for _ in range(6):
                w[rng.randrange(len(w))] = rng.choice(bad)
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(i % 6 == 0)))
    passage = " ".join(f"p{i}" for i in range(70))
    docs += [(300, docs[1][1], "fr", "s", 0), (301, docs[2][1] + " tail", "en", "t", 0), (302, passage + " " + docs[3][1][::-1], "en", "s", 0), (303, docs[4][1][::-1] + " " + passage, "en", "s", 0), (304, None, "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pieces = run(spark, str(tmp_path)).collect()
    known = {r["doc_id"]: 0 for r in pieces}
    for r in pieces:
        known[r["doc_id"]] += r["length"]
    toxic = {i for i in range(240) if i % 6 == 0}
    assert set(known) == {i for i, *_ in docs} - toxic - {300, 301, 304} or set(known) == {i for i, *_ in docs} - toxic - {300, 301}
    from tidemark.llm.piece_encoder import PieceEncoder
    from tidemark.llm.queries import tokenizer_path

    enc = PieceEncoder(tokenizer_path("word_bpe_49k.json"))
    text = {i: t or "" for i, t, *_ in docs} | {303: docs[4][1][::-1]}
    assert all(n == len(enc.whole(text[i])) // 4 + 1 for i, n in known.items())
