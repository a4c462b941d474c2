"""Toxicity scores: a lexicon learned from labels, misspellings by Levenshtein automata, and context windows.

Fitting takes a bounded sample of labelled texts (``MOST`` of each class and ``MOST_BYTES`` of their text, by a hash
of doc_id). Terms that mark toxic texts enter the lexicon: whole words, and stems where many words share the
marking prefix. A token is looked up by walking the trie of the words with the states of a Levenshtein automaton
for the token; a branch dies as soon as no state is within reach. What clean texts use as a word of its own is
no misspelling. Every hit gets a context window: quotation marks, reporting words and address to a reader
around it separate quoting from abuse. A logistic model over the hit counts by kind and context gives the score:
its weights keep their meaning's sign, and where the sample shows nothing of a kind or a context they
stay at ``PRIOR``. Labels, language, source and doc_id are no inputs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, doc_rows, materialize, text_slices, trim

MOST, MOST_BYTES = 3000, 32 << 20  # labelled texts of each class that are fitted on, and bytes of them
TOKENS = re.compile(r"[^\W_]+|[\"“”„«»]")
QUOTES = frozenset('"“”„«»')
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes word words term dit écrit mot sagte schrieb wort dijo escribió palabra".split())
ADDRESS = frozenset("you your you're u ur vous tu toi du dich dir ihr tú usted".split())
WINDOW = 6  # tokens on either side of a hit
FUZZY_FROM = 5  # shortest term that may be misspelled

EXACT, STEM, FUZZY = 0, 1, 2
UNSEEN_TRUST, FEW_HITS = 0.7, 0.05  # trust where there are fewer misspelled hits than so many in 1000 tokens
#: Weights before anything is seen, in the order of ``features``; each fitted weight keeps its sign.
PRIOR = np.array([1.0, 1.0, 0.7, 1.0, -1.5, 0.5, 1.0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Lexicon:
    words: frozenset[str]
    stems: frozenset[str]
    plain: frozenset[str] = frozenset()  # words that clean texts use, though one edit from a term
    trust: float = UNSEEN_TRUST  # what a misspelled hit counts: the share of such hits that toxic texts have beyond clean ones
    trie: dict = field(default_factory=dict)
    known: dict[str, int | None] = field(default_factory=dict)

    def __post_init__(self):
        fuzzy = [w for w in self.words if len(w) >= FUZZY_FROM]
        for w in fuzzy:
            node = self.trie
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = w
        self.stem_sizes = sorted({len(s) for s in self.stems})
        # One edit leaves one half of a word as it is: a token that begins with no first half and ends with no second
        # of a word that is at most one letter longer or shorter is not near.
        self.heads, self.tails = {(len(w), w[: len(w) // 2]) for w in fuzzy}, {(len(w), w[len(w) // 2 :]) for w in fuzzy}
        self.sizes = {len(w) for w in fuzzy}

    def __getstate__(self):
        return (self.words, self.stems, self.plain, self.trust)

    def __setstate__(self, state):
        self.words, self.stems, self.plain, self.trust, self.trie, self.known = *state, {}, {}
        self.__post_init__()

    def near(self, token: str, most: int = 1) -> str | None:
        """A lexicon word within ``most`` edits. States: (place in the token, edits so far), closed under deletion."""
        n = len(token)
        stack = [(self.trie, frozenset((i, i) for i in range(min(most, n) + 1)))]
        while stack:
            node, states = stack.pop()
            for ch, child in node.items():
                if ch == "":
                    if len(child) >= FUZZY_FROM and any(e + n - i <= most for i, e in states):
                        return child
                    continue
                step = set()
                for i, e in states:
                    if i < n and token[i] == ch:
                        step.add((i + 1, e))
                    if e < most:
                        step.add((i, e + 1))  # a letter of the term is missing in the token
                        if i < n:
                            step.add((i + 1, e + 1))  # another letter stands for it
                            if i + 1 < n and token[i + 1] == ch:
                                step.add((i + 2, e + 1))  # the token has one letter more
                if step:
                    stack.append((child, frozenset(step)))
        return None

    def half_kept(self, token: str) -> bool:
        heads, tails, length = self.heads, self.tails, len(token)
        return any((n, token[: n // 2]) in heads or (n, token[n // 2 - n :]) in tails for n in (length - 1, length, length + 1) if n in self.sizes)

    def kind(self, token: str) -> int | None:
        if token in self.known:
            return self.known[token]
        found = None
        if token in self.words:
            found = EXACT
        elif any(token[:n] in self.stems for n in self.stem_sizes if len(token) >= n):
            found = STEM
        elif len(token) >= FUZZY_FROM - 1 and token not in self.plain and self.half_kept(token) and self.near(token):
            found = FUZZY
        if len(self.known) >= 300_000:
            self.known.clear()
        if len(token) <= 40:
            self.known[token] = found
        return found


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Hits by kind (logarithms), the share of quoting and of addressing contexts, and the density of hits."""
    tokens = TOKENS.findall(text.lower())
    get, kind = lexicon.known.get, lexicon.kind
    hits = [(i, k) for i, t in enumerate(tokens) if (k := get(t, -1)) is not None and (k >= 0 or (k := kind(t)) is not None)]
    counts, quoting, abusing, n = [0.0, 0.0, 0.0], 0.0, 0.0, 0.0
    for i, k in hits:
        worth = lexicon.trust if k == FUZZY else 1.0
        around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        quoted = QUOTES.intersection(tokens[max(0, i - WINDOW) : i]) and QUOTES.intersection(tokens[i + 1 : i + WINDOW + 1])
        reported = REPORTING.intersection(around)
        quoting += worth * bool(quoted or reported)
        abusing += worth * (bool(ADDRESS.intersection(around)) and not quoted)
        counts[k] += worth * (0.5 if quoted and reported else 1.0)
        n += worth
    shares = (quoting / n, abusing / n) if n else (0.0, 0.0)
    return [*(math.log1p(c) for c in counts), math.log1p(sum(counts)), *shares, math.log1p(100 * n / max(20, len(tokens)))]


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        z = float(np.dot(features(text, self.lexicon), self.weights)) + self.bias
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def learn_lexicon(toxic: list[str], clean: list[str]) -> Lexicon:
    """Words and stems found in at least 3 toxic texts (and 1 in 100), 20 times likelier there; copies count once."""
    toxic, clean = sorted(set(toxic)), sorted(set(clean))
    words, prefixes, tails = (Counter(), Counter()), (Counter(), Counter()), {}
    for label, texts in enumerate((clean, toxic)):
        for text in texts:
            own = {t for t in TOKENS.findall(text.lower()) if len(t) >= 3}
            heads = {t[:n] for t in own for n in range(4, min(len(t), 10) + 1)}
            words[label].update(own)
            prefixes[label].update(heads)
            if label:
                for t in own:
                    for n in range(4, min(len(t), 10) + 1):
                        tails.setdefault(t[:n], set()).add(t[n : n + 3])
    n_clean, n_toxic = max(1, len(clean)), max(1, len(toxic))

    def marks(counts: tuple[Counter, Counter], w: str, times: int = 20) -> bool:
        return counts[1][w] >= max(3, n_toxic / 100) and counts[1][w] / n_toxic >= times * (counts[0][w] + 0.25) / n_clean

    stems: set[str] = set()
    for p in sorted((p for p in prefixes[1] if marks(prefixes, p, 100)), key=len):
        if len(tails[p]) >= 4 and not any(p[:n] in stems for n in range(4, len(p))):
            longest = p
            while True:  # the longest prefix that keeps nearly all of its texts
                more = [q for q in (longest + t[0] for t in tails[longest] if t) if prefixes[1][q] >= 0.97 * prefixes[1][longest] and len(tails.get(q, ())) >= 4]
                if not more:
                    break
                longest = max(more, key=lambda q: prefixes[1][q])
            stems.add(longest)
    own = {w for w in words[1] if marks(words, w) and not any(w[:n] in stems for n in range(4, len(w) + 1))}
    found = Lexicon(frozenset(own), frozenset(stems))
    plain = {w for w, n in words[0].items() if 5 * n / n_clean >= words[1][w] / n_toxic and found.kind(w) == FUZZY}
    # Trust is measured on clean texts that had no part in what is taken for plain.
    seen = {t for text in clean[::2] for t in TOKENS.findall(text.lower())}
    half, rates = Lexicon(found.words, found.stems, frozenset(plain & seen)), []
    for texts in (clean[1::2], toxic):
        kinds = [half.kind(t) for text in texts for t in TOKENS.findall(text.lower())]
        rates.append(1000 * kinds.count(FUZZY) / max(1, len(kinds)))
    trust = UNSEEN_TRUST if sum(rates) < FEW_HITS else max(0.0, 1 - rates[0] / rates[1]) if rates[1] else 0.0
    return Lexicon(found.words, found.stems, frozenset(plain), trust)


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Weights and bias of a logistic model by Newton steps, with the classes weighted as the labels have them and a
    ridge around ``PRIOR``. A weight that would change its sign is zero."""
    n_toxic = y.sum()
    case = np.where(y == 1, prior / n_toxic, (1 - prior) / (len(y) - n_toxic)) * len(y)
    design = np.hstack([x, np.ones((len(x), 1))])
    middle, ridge = np.append(PRIOR, 0.0), np.array([0.05] * x.shape[1] + [1e-3])
    free = np.ones(len(middle), bool)

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float(case @ (np.logaddexp(0, z) - y * z) + ridge @ (w - middle) ** 2 / 2)

    while True:
        w = np.where(free, middle, 0.0)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
            grad = (design.T @ (case * (p - y)) + ridge * (w - middle))[free]
            part = design[:, free]
            step = np.zeros(len(w))
            step[free] = np.linalg.solve((part * (case * p * (1 - p))[:, None]).T @ part + np.diag(ridge[free]), grad)
            now, size = loss(w), 1.0
            while loss(w - size * step) > now and size > 1e-6:  # shorter steps where a whole one leads up
                size /= 2
            w = w - size * step
            if np.abs(size * step).max() < 1e-6:
                break
        wrong = free & (w * middle < 0)
        if not wrong.any():
            return w
        free &= ~wrong


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on the rows outside the held-out fold. Collected: at most 2 * MOST texts, chosen by doc_id alone, and of
    each class no more than MOST_BYTES, whole texts in the order of the choice (the first in any case).

    A doc_id that repeats gives its smallest text. Without labels of both classes the lexicon is empty and every
    score is the share of toxic labels.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(share.values())
    prior = (share.get(1, 0) + 0.5) / (total + 1)
    chosen = None
    for label in (0, 1):
        part = known.filter(F.col("toxic") == label).groupBy("doc_id", "toxic").agg(F.xxhash64("doc_id").alias("draw")).orderBy("draw", "doc_id").limit(MOST)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = doc_rows(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", "draw").agg(F.min("text").alias("text"))
    texts = materialize(texts.withColumn("bytes", F.octet_length("text")), "labelled")
    drawn = Window.partitionBy("toxic").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # over the chosen rows
    within = texts.withColumn("before", F.coalesce(F.sum("bytes").over(drawn), F.lit(0))).filter((F.col("before") + F.col("bytes") <= MOST_BYTES) | (F.col("before") == 0))
    rows = within.select("toxic", "text").collect()
    discard(texts)
    clean, toxic = [r["text"] for r in rows if not r["toxic"]], [r["text"] for r in rows if r["toxic"]]
    if not clean or not toxic:
        return ToxicityModel(Lexicon(frozenset(), frozenset()), np.zeros(len(PRIOR)), math.log(prior / (1 - prior)))
    lexicon = learn_lexicon(toxic, clean)
    w = _logistic(np.array([features(t, lexicon) for t in clean + toxic]), np.array([0.0] * len(clean) + [1.0] * len(toxic)), prior)
    return ToxicityModel(lexicon, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted per row, without a shuffle; null texts are empty, repeated rows each scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            got = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["doc_id", "score"])
        trim()

    scored = doc_rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``. Null and empty texts have no hits,
    repeated rows all go or stay, ids play no part, an empty table stays empty."""

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t or "") for at in range(0, len(texts), 512) for t in texts[at : at + 512].to_pylist()], pa.float64())

    return docs.filter(scores(F.col(text_col)) < threshold)
