"""Evaluation analytics as columns and aggregates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stemming import stem
from tidemark.operators.components import components
from tidemark.sources.store import stored

#: Words that answer normalisation drops.
ARTICLES = ("a", "an", "the", "and")


def normal_tokens(text: Column) -> Column:
    """Lower case, no punctuation or articles, split at spaces."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]", "")
    return F.filter(F.split(clean, r"\s+"), lambda t: (t != "") & ~t.isin(*ARTICLES))


def set_exact_match(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(normal_tokens(a)), F.array_distinct(normal_tokens(b))
    return ((F.size(F.array_except(x, y)) == 0) & (F.size(F.array_except(y, x)) == 0)).cast("int")


def contains(answer: Column, gold: Column) -> Column:
    return F.contains(F.array_join(normal_tokens(answer), " "), F.array_join(normal_tokens(gold), " ")).cast("int")


def _joined(tokens: Column) -> Column:
    """Tokens as one text for Python: a text for each row takes a tenth of the memory of an array of texts."""
    return F.array_join(tokens, " ")


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays. Tokens hold no space."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([0 if p is None or q is None else (Counter(p.split(" ")) & Counter(q.split(" "))).total() for p, q in zip(x, y, strict=True)], dtype="int32")

    some = lambda t: F.when(F.size(t) > 0, _joined(t))
    return run(some(a), some(b))


def token_f1(answer: Column, gold: Column, stem: Callable[[Column], Column] = lambda t: t) -> Column:
    """F1 of token multisets, 0 without a common token."""
    a, b = F.transform(normal_tokens(answer), stem), F.transform(normal_tokens(gold), stem)
    same = common_tokens(a, b)
    return F.when(same > 0, 2.0 * same / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def porter_f1(answer: Column, gold: Column) -> Column:
    """As ``token_f1`` over Porter stems; two empty sides agree."""

    return _stem_f1(_joined(normal_tokens(answer)), _joined(normal_tokens(gold)), F.lit(False))


def multi_answer_f1(answer: Column, gold: Column) -> Column:
    """Answers and golds are lists between commas: the mean over the golds of the best answer's stem F1."""
    return _stem_f1(_token_lists(answer), _token_lists(gold), F.lit(True))


def _token_lists(text: Column) -> Column:
    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda part: _joined(normal_tokens(F.trim(part)))), ",")


def _stem_f1(answer: Column, gold: Column, lists: Column) -> Column:
    """Of tokens between spaces, in lists between commas where ``lists``; null without an answer."""

    @F.pandas_udf("double")
    def run(answers: pd.Series, golds: pd.Series, several: pd.Series) -> pd.Series:
        out = []
        for a, g, many in zip(answers, golds, several, strict=True):
            out.append(None if a is None else _best_mean(*([x.split() for x in t.split(",")] for t in (a, g))) if many else _f1([stem(t) for t in a.split()], [stem(t) for t in g.split()]))
        return pd.Series(out, dtype=float)

    return run(answer, gold, lists)


def _f1(a: list[str], b: list[str]) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    same = (Counter(a) & Counter(b)).total()
    return 2 * same / (len(a) + len(b))


def _best_mean(answers: list, golds: list) -> float:
    said = [[stem(t) for t in a] for a in answers]
    return sum(max((_f1(a, [stem(t) for t in g]) for a in said), default=0.0) for g in golds) / max(1, len(golds))


#: What an answer to an unanswerable question says.
UNANSWERABLE = ("no information available", "not mentioned")


def category_score(answer: Column, gold: Column, category: Column) -> Column:
    """1: lists of answers; 2, 4: stem F1; 3: that of the gold's part before a semicolon; 5: says that it is not known."""
    said = F.lower(F.coalesce(answer, F.lit("")))
    unknown = (F.contains(said, F.lit(UNANSWERABLE[0])) | F.contains(said, F.lit(UNANSWERABLE[1]))).cast("double")
    first = F.when(category == 3, F.trim(F.element_at(F.split(gold, ";"), 1))).otherwise(gold)
    lists, plain = category == 1, category.isin(2, 3, 4)  # one function for both, which gets nothing of other rows
    a = F.when(lists, _token_lists(answer)).when(plain, _joined(normal_tokens(answer)))
    g = F.when(lists, _token_lists(gold)).when(plain, _joined(normal_tokens(first)))
    known = F.when(lists | plain, _stem_f1(a, g, F.coalesce(lists, F.lit(False)))).when(category == 5, unknown)
    return F.coalesce(known, F.raise_error(F.lit("unknown category")).cast("double"))


def plain_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation, the articles a, an, the, and repeated spaces."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(answer: Column, golds: Column) -> Column:
    """Whether the answer is one of an array of accepted ones, normalised."""
    return F.exists(golds, lambda g: plain_answer(g) == plain_answer(answer)).cast("int")


def substring_match(answer: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: F.contains(plain_answer(answer), plain_answer(g))).cast("int")


def parsed_answer(output: Column, prefix: str = "Answer:") -> Column:
    """The rest of the line after the prefix, whatever its case, else the first line."""
    after = F.regexp_extract(output, "(?i)" + re.escape(prefix) + r"([^\n]*)", 1)
    return F.when(F.contains(F.lower(output), F.lit(prefix.lower())), F.trim(after)).otherwise(F.trim(F.element_at(F.split(output, "\n"), 1)))


def recall_at(ranked: Column, wanted: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.slice(ranked, 1, k), wanted)) / F.size(wanted)


def summary(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Count, mean, median, 95th percentile (linear interpolation) and maximum."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.95).alias("p95"), F.max(v).alias("max"))


def usage(df: DataFrame, phase: str, prices: dict[str, float]) -> DataFrame:
    """Sums of token columns by phase and over all (``_total``), with the cost; ``prices`` are per million tokens."""
    sums = [F.sum(x).alias(x) for x in prices]
    out = df.rollup(phase).agg(F.grouping(phase).alias("__all"), F.count(F.lit(1)).alias("calls"), *sums)
    cost = sum((F.coalesce(F.col(x), F.lit(0)).cast("decimal(20,0)") * F.lit(str(p)).cast("decimal(12,6)") / F.lit(1_000_000) for x, p in prices.items()), F.lit(0).cast("decimal(1,0)"))
    return out.select(F.when(F.col("__all") == 1, "_total").otherwise(F.col(phase)).alias(phase), "calls", *prices, cost.cast("double").alias("cost"))


def paired(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Wins, ties, losses and mean difference of two runs over the same cases."""
    both = left.select(key, F.col(value).alias("a")).join(right.select(key, F.col(value).alias("b")), key)
    return both.agg(F.count_if(F.expr("a > b")).alias("wins"), F.count_if(F.expr("a = b")).alias("ties"), F.count_if(F.expr("a < b")).alias("losses"), F.avg(F.expr("a - b")).alias("mean_delta"))


def bootstrap(df: DataFrame, value: str, samples: int = 2000, seed: int = 0) -> DataFrame:
    """95 % interval of the mean by Poisson resampling. A task draws each row's weight in every sample, from a generator
    of the seed and its partition, and passes on one pair of sums for each sample."""

    def run(batches):
        from pyspark import TaskContext

        draw = np.random.Generator(np.random.Philox(key=(seed << 32) + TaskContext.get().partitionId()))
        sums, weights = np.zeros(samples), np.zeros(samples)
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(v), 1024):
                part = v[at : at + 1024]
                w = draw.poisson(1.0, (len(part), samples))
                sums += part @ w
                weights += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples)), pa.array(sums), pa.array(weights)], names=["s", "v", "w"])

    parts = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double")).mapInArrow(run, "s long, v double, w double")
    means = parts.groupBy("s").agg(F.try_divide(F.sum("v"), F.sum("w")).alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def confusion(pairs: DataFrame, said: str, truth: str) -> DataFrame:
    """TP, FP, FN, TN, precision, recall, F1 and the share of pairs not asked about."""
    s, t = F.col(said), F.col(truth)
    n = pairs.agg(F.count_if(s & t).alias("tp"), F.count_if(s & ~t).alias("fp"), F.count_if(~s & t).alias("fn"), F.count_if(~s & ~t).alias("tn"))
    n = n.withColumn("precision", F.try_divide("tp", F.expr("tp + fp"))).withColumn("recall", F.try_divide("tp", F.expr("tp + fn")))
    return n.withColumn("f1", F.try_divide(F.expr("2D * tp"), F.expr("2 * tp + fp + fn"))).withColumn("reduction", 1 - F.expr("(tp + fp) / (tp + fp + fn + tn)"))


def component_agreement(pairs: DataFrame, a: str, b: str, said: str, truth: str) -> DataFrame:
    """Of the nodes of any pair: how many have the same component under both relations."""
    roots = [components(pairs.filter(x), a, b).withColumnRenamed("root", f"root_{x}") for x in (said, truth)]
    nodes = pairs.select(F.col(a).alias("node")).unionByName(pairs.select(F.col(b).alias("node"))).distinct()
    for r in roots:
        nodes = nodes.join(r, "node", "left")
    same = F.coalesce(f"root_{said}", "node") == F.coalesce(f"root_{truth}", "node")
    return nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(same).alias("same"))


def fold_of(key: Column) -> Column:
    """60/20/20 split by hash: train, validation, test."""
    h = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(100))
    return F.when(h < 60, "train").when(h < 80, "validation").otherwise("test")


def calibrate(scored: DataFrame, score: str, truth: str) -> DataFrame:
    """The threshold with the best F1, ties to the higher one: sums by distinct score, then running sums within ranges
    of scores, each on top of the sums of the ranges above it."""
    by = scored.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(truth)).alias("pos"), F.count_if(~F.col(truth)).alias("neg"))
    ranged = stored(by.repartitionByRange(F.desc("threshold")).withColumn("__part", F.spark_partition_id()), "scores")
    above = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over ranges
    sums = ranged.groupBy("__part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    starts = sums.select("__part", *(F.coalesce(F.sum(x).over(above), F.lit(0)).alias(f"__{x}") for x in "pn"), F.sum("p").over(Window.partitionBy()).alias("all_pos"))
    down = Window.partitionBy("__part").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.join(F.broadcast(starts), "__part")  # a row for each range
    run = run.withColumns({"tp": F.sum("pos").over(down) + F.col("__p"), "fp": F.sum("neg").over(down) + F.col("__n")})
    f1 = F.expr("2D * tp / (tp + fp + all_pos)")
    return run.select("threshold", f1.alias("f1")).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def duplicate_names(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy(F.lower(F.trim(name)).alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def previous_deltas(df: DataFrame, case: str, seq: str, values: list[str]) -> DataFrame:
    """Each value less that of the case's previous event."""
    by = Window.partitionBy(case).orderBy(seq)
    return df.withColumns({f"{v}_delta": F.col(v) - F.lag(v, 1, 0).over(by) for v in values} | {"occurrence": F.row_number().over(by)})


def chunks(df: DataFrame, text: str, most_tokens: int = 64) -> DataFrame:
    """Sentences packed into chunks of at most ``most_tokens`` space-separated tokens; a longer sentence is cut."""
    import re

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            out: list[list[str]] = [[]]
            for sentence in re.split(r"(?<=[.!?])\s+", t or ""):
                words = sentence.split()
                while words:
                    if len(out[-1]) + len(words) > most_tokens and out[-1]:
                        out.append([])
                    out[-1] += words[:most_tokens]
                    words = words[most_tokens:]
            return [" ".join(x) for x in out if x]

        return texts.map(one)

    return df.select("*", F.posexplode(cut(F.col(text))).alias("chunk_no", "chunk")).drop(text)


def eligible(questions: DataFrame, question: str, evidence: str, ingested: DataFrame, event: str) -> DataFrame:
    """Questions of which all evidence is ingested."""
    need = questions.select(question, F.explode(evidence).alias(event))
    unmet = need.join(ingested.select(event).distinct(), event, "left_anti").select(question).distinct()
    return questions.join(unmet, question, "left_anti")


def anomalies(df: DataFrame, output: str) -> DataFrame:
    o = F.col(output)
    kind = F.when(o.isNull(), "missing").when(F.trim(o) == "", "empty").when(F.try_parse_json(o).isNull(), "unreadable")
    return df.withColumn("anomaly", kind).filter("anomaly is not null")


def split_recovery(calls: DataFrame, durable: DataFrame, unit: str, status: str) -> DataFrame:
    """``final`` where the call's unit is durable and it did not fail; ``recovery`` else."""
    kept = durable.select(unit).distinct().withColumn("__kept", F.lit(True))
    out = calls.join(kept, unit, "left")
    return out.withColumn("path", F.when(F.col("__kept") & (F.col(status) != "error"), "final").otherwise("recovery")).drop("__kept")


def operator_usage(calls: DataFrame) -> DataFrame:
    """By phase and operator: logical calls, batches, items per batch, retries."""
    return calls.groupBy("phase", "operator").agg(F.countDistinct("call_id").alias("calls"), F.countDistinct("batch_id").alias("batches"), F.try_divide(F.count("call_id"), F.countDistinct("batch_id")).alias("items_per_batch"), F.sum("retries").alias("retries"))


def evidence_trace(questions: DataFrame, question: str, evidence: str, stages: dict[str, DataFrame], event: str) -> DataFrame:
    """A row for each (question, evidence event) with how often each stage holds the event."""
    out = questions.select(question, F.explode(evidence).alias(event))
    for name, df in stages.items():
        out = out.join(df.groupBy(event).agg(F.count(F.lit(1)).alias(name)), event, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def latest_states(states: DataFrame, case: str, seq: str) -> DataFrame:
    """The last row of each case."""
    rest = [x for x in states.columns if x != case]
    last = states.groupBy(case).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("__last"))
    return last.select(case, *(F.col("__last").getField(x).alias(x) for x in rest))


TITLES = 10_000  # of a catalog in one array


def nearest_name(names: DataFrame, name: str, catalog: DataFrame, title: str) -> DataFrame:
    """Each distinct name with the catalog title of least edit distance, ties to the smaller title. Titles are laid out
    in arrays of about TITLES; each name meets each array once, whatever the size of either side."""
    titles = catalog.select(F.col(title).alias("t")).filter(F.col(title).isNotNull()).distinct()
    lists = -(-titles.count() // TITLES)
    titles = titles.groupBy(F.pmod(F.xxhash64("t"), F.lit(max(1, lists))).alias("__list")).agg(F.sort_array(F.collect_list("t")).alias("__titles"))
    asked = names.select(name).distinct()
    best = F.array_min(F.transform("__titles", lambda t: F.struct(F.levenshtein(F.lower(t), F.lower(F.col(name))).alias("d"), t.alias("t"))))
    found = asked.crossJoin(F.broadcast(titles) if lists <= 10 else titles).select(name, best.alias("__best"))
    found = found.groupBy(name).agg(F.min("__best").alias("__best")).select(F.col(name).alias("__name"), F.col("__best.t").alias("nearest"), F.col("__best.d").alias("distance"))
    return names.join(found, names[name] == found["__name"], "left").drop("__name")


def question_summary(graded: DataFrame, question: str, category: str, scores: list[str]) -> tuple[DataFrame, DataFrame]:
    """A row for each question with its mean scores and runs, and the means of these by category and over all
    (``_all``)."""
    each = graded.groupBy(question, category).agg(F.count(F.lit(1)).alias("runs"), *(F.avg(x).alias(x) for x in scores))
    means = each.rollup(category).agg(F.grouping(category).alias("__all"), F.count(F.lit(1)).alias("questions"), *(F.avg(x).alias(x) for x in scores))
    return each, means.select(F.when(F.col("__all") == 1, "_all").otherwise(F.col(category).cast("string")).alias(category), "questions", *scores)


def normal_calls(calls: DataFrame, prompt: str, cached: str, completion: str) -> DataFrame:
    """Provider calls with token columns ``hit``, ``miss`` and ``output``: what is missing counts zero, and no more
    is cached than was prompted."""
    p, h, o = (F.greatest(F.coalesce(F.col(x), F.lit(0)), F.lit(0)).cast("long") for x in (prompt, cached, completion))
    return calls.withColumns({"hit": F.least(h, p), "miss": p - F.least(h, p), "output": o})


def question_facts(questions: DataFrame, answers: DataFrame, grades: DataFrame, calls: DataFrame, question: str, phases: list[str]) -> DataFrame:
    """A row for each question: its answer, grade, and calls and tokens in each phase."""
    by = calls.groupBy(question).pivot("phase", phases).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))
    out = questions.join(answers, question, "left").join(grades, question, "left").join(by, question, "left")
    return out.fillna(0, [f"{p}_{x}" for p in phases for x in ("calls", "tokens")])
