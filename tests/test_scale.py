"""Work that must not grow with the square of the rows, and steps that only large inputs reach."""

import random
import re
import time

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.functions.model import RuleModel, SameKey
from tidemark.operators import nearest, semantic
from tidemark.plans import policies
from tidemark.plans.relation import Log, sem_agg
from tidemark.queries import POLICY_RULES
from tidemark.sources.store import recorded
from tidemark.streaming.engine import Dataflow, evaluate
from tidemark.workloads import GRAPH_RULES

log = Log(["k", "v"])


def bag(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_folds_of_many_levels(spark, monkeypatch):
    """A group with more leaves than one fold takes, beside small ones; in order of arrival."""
    monkeypatch.setattr(semantic, "LEAF", 2)
    monkeypatch.setattr(semantic, "FAN", 3)
    rows = [("a" if i % 7 else "b", i, i) for i in range(60)] + [("c", 60, 60)]
    frame = spark.createDataFrame(rows, "k string, v long, arrival long")
    r = log.group_by(["k"]).agg(sem_agg("join", "s", ["v"]))
    got = evaluate(r, frame, ["arrival"], RuleModel({"join": lambda v: "+".join(map(str, v["items"]))})).collect()
    assert dict(map(tuple, got)) == {x: "+".join(str(v) for k, v, _ in rows if k == x) for x in "abc"}


def counted(rule, at):
    def ask(v):
        with at.open("a") as f:
            f.write("x\n")
        return rule(v)

    return ask


def test_keys_in_place_of_pairs(spark, tmp_path):
    """A rule that is an equality of keys is asked once for each value, and gives the groups that all pairs give."""
    text, at = "same {k:left} {k:right}", tmp_path / "asked"
    rows = [(w, i, i) for i, w in enumerate(["ax", "B", "Ay", "b", "c", "az", "B", None])]
    frame = spark.createDataFrame(rows, "k string, v long, arrival long")
    first = lambda x: x and x[0].lower()
    by_key = RuleModel({text: SameKey(counted(lambda v: first(v["k"]), at))})
    by_pair = RuleModel({text: lambda v: first(v["k:left"]) == first(v["k:right"])})
    r = log.sem_groupby(["k"], text).members()
    assert bag(evaluate(r, frame, ["arrival"], by_key)) == bag(evaluate(r, frame, ["arrival"], by_pair))
    assert len(at.read_text().split()) == 7
    # Pairs of a join, too, over steps.
    pairs = log.alias("left").join(log.alias("right"), log.alias("left").col("v") < log.alias("right").col("v")).sem_filter(text)
    flows = [Dataflow(spark, log, {"p": pairs}, m) for m in (by_key, by_pair)]
    for flow in flows:
        for part in (rows[:4], rows[4:]):
            flow.apply(spark.createDataFrame([r[:2] for r in part], "k string, v long").coalesce(1))
    assert bag(flows[0].view("p")) == bag(flows[1].view("p")) == bag(evaluate(pairs, frame, ["arrival"], by_pair))
    assert flows[0].view("p").count() == 3 + 3
    assert flows[0].query(pairs).count() == 6


def test_facts_are_compared_by_text(spark, tmp_path):
    """Facts that were said often are asked about once, and those that older ones say are left out as by all pairs."""
    said = ["a one", "b two", "A three", "a one", "c", "B", "a", "b x", "C y", "d"] * 3
    frame = spark.createDataFrame([("r", x, None, i) for i, x in enumerate(said)], "role string, content string, observation_date string, at long")
    at, found = tmp_path / "asked", []
    for rule in (SameKey(counted(lambda v: v["fact"].lower(), at)), counted(lambda v: v["fact:older"].lower() == v["fact:newer"].lower(), tmp_path / "pairs")):
        policy = policies.fact_memory()
        flow = Dataflow(spark, policy.log, policy.views, RuleModel(POLICY_RULES.rules | {policies.SAME_FACT: rule}))
        for lo, hi in ((0, 4), (4, 30)):
            flow.apply(frame.filter(F.col("at").between(lo, hi - 1)).sort("at").coalesce(1).drop("at"))
        found.append(bag(flow.view("memories")))
    assert found[0] == found[1] and [eval(x)[0] for x in found[0]] == ["a", "b", "c", "d"]
    assert len(at.read_text().split()) == 7  # the texts; both sides are one frame
    assert len((tmp_path / "pairs").read_text().split()) == 7 * 6 // 2


def test_graph_asks_about_names_not_pairs(spark):
    """The graph policy with its keys agrees with the same rules asked about pairs."""
    texts = ["Ann bob", "ann Carl", "bob carl", "Ann Bob", "dora", "Dan ann"]
    opaque = {k: (lambda v, f=f: f(v)) if isinstance(f, SameKey) else f for k, f in GRAPH_RULES.rules.items()}
    found = []
    for model in (GRAPH_RULES, RuleModel(opaque)):
        policy = policies.graph_memory(communities=True)
        flow = Dataflow(spark, policy.log, {k: policy.views[k] for k in ("entities", "communities")}, model)
        flow.apply(spark.createDataFrame([("r", "s", t, str(i)) for i, t in enumerate(texts)], "role string, speaker string, content string, reference_time string").coalesce(1))
        found.append((bag(flow.view("entities").select("entity_id", "name", F.size("mentions"), "summary")), bag(flow.view("communities"))))
    assert found[0] == found[1] and len(found[0][0]) == 5 and len(found[0][1]) == 4


def test_nearest_by_blocks(spark, monkeypatch):
    """Blocks of vectors give what all pairs ranked by Spark give: copies, zero and short vectors, null keys, several blocks."""
    rng = random.Random(5)
    vectors = [[rng.gauss(0, 1) for _ in range(7)] for _ in range(40)]
    rows = []
    for i in range(150):
        v = rng.choice(vectors[:12]) if i % 3 else rng.choice(vectors)
        v = None if i == 50 else [0.0] * 7 if i % 31 == 0 else v[:5] if i % 29 == 0 else v
        rows.append((rng.choice(["a", "a", "b", None]), i, v))
    frame = spark.createDataFrame(rows, "k string, v long, vec array<float>")
    src = Log(["k", "v", "vec"])
    x, y = src.alias("x"), src.alias("y")
    differ = [x.col("k") == y.col("k"), y.col("v") != x.col("v")]
    before = [x.col("v") > y.col("v")]
    profiles = [{"k": 3}, {"k": 2, "per": "right", "threshold": 0.2}, {"k": 2, "per": "symmetric"}, {"threshold": 0.6}]
    sides = {"mode": "proxy-only", "left": "vec:x", "right": "vec:y"}

    def found():
        out = [bag(evaluate(x.sem_join(y, "", on=on)[["v:x", "v:y"]], frame, ["v"], options={"pairs": sides | p})) for on in (differ, before) for p in profiles]
        groups = src.sem_groupby(["v", "vec"], "", partition_by=["k"]).members()[["v", "__group"]]
        return [*out, bag(evaluate(groups, frame, ["v"], options={"groups": {"mode": "proxy-only", "column": "vec", "k": 1, "per": "symmetric"}}))]

    monkeypatch.setattr(nearest, "BLOCK", 20)
    plans = []
    monkeypatch.setattr(semantic, "promising", lambda *a: plans.append(1) or nearest.promising(*a))
    by_blocks = found()
    assert len(plans) == 9
    monkeypatch.setattr(semantic, "_nearest", lambda *a: None)
    assert by_blocks == found()


def test_joins_by_values(spark, monkeypatch):
    """Outer joins and shares give what a model that is asked row by row gives; equal values are asked about once."""
    rows = [(["a", "b", None][i % 3], i % 5, i) for i in range(40)]
    frame = spark.createDataFrame(rows, "k string, v long, arrival long")
    src = Log(["k", "v", "arrival"])
    model = RuleModel({"{v:left} under {v:right}?": lambda v: v["v:left"] % 3 < v["v:right"] - 2})
    yes = lambda a, b: a[1] % 3 < b[1] - 2
    pairs = {(a[2], b[2]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and yes(a, b)}
    right_alone = {(None, b[2]) for b in rows} - {(None, j) for _, j in pairs}
    left_alone = {(a[2], None) for a in rows} - {(i, None) for i, _ in pairs}
    for salt in (semantic.SALT, 10):
        monkeypatch.setattr(semantic, "SALT", salt)
        for how, want in (("inner", pairs), ("left", pairs | left_alone), ("right", pairs | right_alone), ("outer", pairs | left_alone | right_alone)):
            with recorded() as made:
                r = src.sem_join(src, "{v:left} under {v:right}?", how, on=["k"])[["arrival:left", "arrival:right"]]
                got = [tuple(x) for x in evaluate(r, frame, ["arrival"], model).collect()]
            assert len(got) == len(set(got)) and set(got) == want
            assert not [p for p in made if "/pairs-" in p]  # the pairs themselves are not stored


def test_token_scores_are_linear(spark):
    """Long texts: work by the product of both lengths would take minutes here. Only rows of its category reach Python."""
    words = " ".join(f"w{i}" for i in range(20_000))
    df = spark.createDataFrame([(words, words + " w1 w1 x", 2), ("", None, 5)], "a string, g string, c int")
    began = time.monotonic()
    got = [r[0] for r in df.select(metrics.token_f1(F.col("a"), F.col("g"))).collect()]
    assert got == [40_000 / 40_003, 0.0] and time.monotonic() - began < 30
    plan = df.select(metrics.category_score(F.col("a"), F.col("g"), F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(re.findall(r"pythonUDF\d+", plan))) == 1


def test_questions_are_made_in_slices(spark):
    """No more rows than a slice are Python objects at once, and whole numbers stay whole beside nulls."""
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    assert [p.num_rows for p in semantic.slices([batch])] == [256, 256, 256, 232]
    frame = spark.createDataFrame([("a", 5, 0), ("b", None, 1)], "k string, v long, arrival long").coalesce(1)
    r = log.sem_map(["v"], ["said"], "say {v}")[["k", "said"]]
    model = RuleModel({"say {v}": lambda v: repr(v["v"])})
    assert sorted(map(tuple, evaluate(r, frame, ["arrival"], model).collect())) == [("a", "5"), ("b", "None")]
