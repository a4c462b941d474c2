"""Text replies, sinks in a flow, steps that do nothing, streams that start again, and evaluation."""

import math
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.functions.model import ReplyError, Request, RuleModel, TextModel, ask, parse_reply, reads_ids, reads_keep, reads_label, reads_record, reads_text
from tidemark.functions.stemming import stem
from tidemark.operators.semantic import screened
from tidemark.plans.expressions import col
from tidemark.plans.relation import Log, avg, count, sem_agg, sum_
from tidemark.sources.sinks import ConflictError, GraphSink, TableDescriptor, TableSink, VectorSink
from tidemark.sources.store import recorded
from tidemark.streaming.engine import Dataflow, evaluate

SCHEMA = "k string, v long"
log = Log(["k", "v"])


def bag(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_readers_of_text():
    keep, join = reads_keep(True), reads_keep(False)
    assert [keep(x) for x in ("True", "No.", "I am not sure.", '{"keep": false}', "yes and no", '"yes"')] == [True, False, True, False, True, True]
    assert [join(x) for x in ("The answer is yes", "maybe", "1", "null")] == [True, False, False, False]
    with pytest.raises(ReplyError):
        reads_keep(None)("maybe")
    one, two = reads_record(("x",)), reads_record(("x", "y"))
    assert [one(x)["x"] for x in ("A plain summary.", '{"x": "s"}', '"t"', "[1, 2]", "7")] == ["A plain summary.", "s", "t", "[1, 2]", "7"]
    assert two('{"x": "a", "y": 2}') == {"x": "a", "y": "2"}
    with pytest.raises(ReplyError):
        two("A plain summary.")
    assert reads_text(" s ") == "s" and reads_label(("Good", "bad"))("good.") == "Good"
    with pytest.raises(ReplyError):
        reads_label(("good",))("unknown")
    assert reads_ids(4, 0, 2)('{"selected_ids": [3, 1]}') == [3, 1]
    for bad in ("[1, 1]", "[9]", "[0, 1, 2]", "[true]", "none"):
        with pytest.raises(ReplyError):
            reads_ids(4, 0, 2)(bad)
    assert parse_reply("```json\n1\n``` or ```\n1\n```") == 1
    with pytest.raises(ReplyError):
        parse_reply("```\n1\n``` or ```\n2\n```")
    assert ask(TextModel({"x": lambda v: True}), [Request("filter", "x", {})], keep) == [True]


def test_lists_are_chosen_in_rounds(spark):
    """More candidates than one prompt holds; ties, none at all, and fewer than asked for."""
    rows = [("a", i, 0) for i in range(150)] + [("b", -1, 0), ("c", 5, 0)]
    frame = spark.createDataFrame([(*r[:2], n) for n, r in enumerate(rows)], f"{SCHEMA}, arrival long")
    seen = []

    def choose(v):
        seen.append(len(v["items"]))
        assert len(v["items"]) <= 128
        return [i["id"] for i in sorted(v["items"], key=lambda i: -i["v"]) if i["v"] >= 0][: v["k"]]

    left = log[["k"]].drop_duplicates()
    r = left.sem_join(log, "best {v:right} of {k:left}", on=["k"], k=3).assign(k=col("k:left"), v=col("v:right"))[["k", "v"]]
    got = evaluate(r, frame, ["arrival"], RuleModel({"best {v:right} of {k:left}": choose})).collect()
    assert sorted(map(tuple, got)) == [("a", 147), ("a", 148), ("a", 149), ("c", 5)]


def test_symmetric_candidates(spark):
    scores = {(1, 2): 0.9, (1, 3): 0.8, (2, 3): 0.1, (3, 4): 0.7, (1, 4): 0.2}
    pairs = spark.createDataFrame([(a, b, s) for (a, b), s in scores.items()], "a long, b long, __score double")
    got = screened(pairs, {"k": 1, "per": "symmetric"}, ["a"], ["b"])
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(1, 2), (1, 3), (3, 4)]


class Breaks(TableSink):
    def swap(self, seen, manifest):
        raise OSError("disk full")


def test_sinks_all_or_none(spark, tmp_path):
    views = {"n": log.group_by(["k"]).count("n"), "rows": log}
    good, bad = TableSink(spark, str(tmp_path / "a"), ["k"]), Breaks(spark, str(tmp_path / "b"), ["k"])
    flow = Dataflow(spark, log, views, sinks={"n": good, "rows": bad})
    rows = spark.createDataFrame([("a", 1)], SCHEMA)
    with pytest.raises(OSError, match="full"):
        flow.apply(rows)
    assert good.manifest()["commit"] == 0 and flow.commit == 0 and good.rows() is None
    flow.sinks["rows"] = VectorSink(spark, str(tmp_path / "c"), ["k"])
    flow.apply(rows)
    assert good.manifest()["commit"] == 1 and bag(good.rows()) == bag(spark.createDataFrame([("a", 1)], "k string, n long"))
    # Two writers that saw the same state: one of them fails.
    staged = [TableSink(spark, str(tmp_path / "a"), ["k"]).stage(rows.toDF("k", "n"), None, 2, flow.fingerprint) for _ in range(2)]
    staged[0].publish()
    with pytest.raises(ConflictError):
        staged[1].publish()


def test_bound_sinks(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    right = TableSink(spark, str(tmp_path / "t"), TableDescriptor("table", schema, ("k",)))
    Dataflow(spark, log, {"v": log}, sinks={"v": right})
    with pytest.raises(ValueError, match="columns"):
        Dataflow(spark, log, {"v": log[["k"]]}, sinks={"v": right})
    with pytest.raises(ValueError, match="no view"):
        Dataflow(spark, log, {"v": log}, sinks={"w": right})
    graph = GraphSink(spark, str(tmp_path / "g"), "k", "k", "v")
    flow = Dataflow(spark, log, {"nodes": log[["k"]].drop_duplicates(), "edges": log}, sinks={("nodes", "edges"): graph})
    flow.apply(spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA))
    flow.apply(spark.createDataFrame([("a", 3)], SCHEMA))
    assert graph.nodes().count() == 2 and graph.edges().count() == 3
    graph.rebuild(flow.view("nodes"), flow.view("edges").limit(0), 9, "p")
    assert graph.manifest()["commit"] == 9 and graph.edges().count() == 0


def test_steps_that_nothing_reaches(spark):
    views = {"n": log.filter(col("v") > 0).group_by(["k"]).count("n"), "pairs": log.alias("a").join(log.alias("b"), ["k"])}
    flow = Dataflow(spark, log, views)
    none = spark.createDataFrame([], SCHEMA)
    flow.apply(none)
    flow.apply(spark.createDataFrame([("a", 1), ("b", 0)], SCHEMA))
    before = {k: bag(flow.view(k)) for k in views}
    with recorded() as made:
        flow.apply(none)
    assert [p.rpartition("/")[2].partition("-")[0] for p in made] == ["batch"]
    assert {k: bag(flow.view(k)) for k in views} == before and flow.commit == 3
    here = lambda: {p for group in (flow.state, flow.hidden) for s in group.values() for p in s.parts}
    old = here()
    for i in range(20):
        flow.apply(spark.createDataFrame([("a", i)], SCHEMA).coalesce(1))
    gone = [p for p in old - here() if not os.path.exists(p.removeprefix("file://"))]
    assert gone and all(os.path.exists(p.removeprefix("file://")) for p in here())
    assert {tuple(r) for r in flow.view("n").collect()} == {("a", 20)}


def test_decimal_sums_have_their_type(spark):
    rows = [("a", "12345678901234567.89"), ("a", "0.01"), ("b", None), ("b", "1.00"), ("a", "-5.50")]
    frame = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], "k string, v string, arrival long").withColumn("v", F.col("v").cast("decimal(20,2)"))
    r = log.group_by(["k"]).agg(count("n"), sum_("v", "s"), avg("v", "a"))
    flow = Dataflow(spark, log, {"v": r})
    for at in range(5):
        flow.apply(frame.filter(F.col("arrival") == at).select("k", "v"))
    once = evaluate(r, frame, ["arrival"])
    assert bag(flow.view("v")) == bag(once)
    assert flow.view("v").schema.simpleString() == once.schema.simpleString()


def test_stream_goes_on_after_a_crash(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    place = str(tmp_path / "cp")

    def run():
        flow = Dataflow(spark, log, {"n": log.group_by(["k"]).count("n")})
        flow.attach(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), place).awaitTermination(120)
        return flow

    first = run()
    shutil.rmtree(f"{place}/commits")  # the step was done, the stream's own commit was not
    again = run()
    assert again.commit == 1 and bag(again.view("n")) == bag(first.view("n"))
    spark.createDataFrame([("a", 3)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert {tuple(r) for r in run().view("n").collect()} == {("a", 2), ("b", 1)}


def test_snapshots_keep_replies(spark, tmp_path):
    seen = tmp_path / "asked"

    def same(v):
        with seen.open("a") as f:
            f.write("x\n")
        return v["k:left"] == v["k:right"]

    model = RuleModel({"same {k:left} {k:right}": same})
    r = log.sem_groupby(["k"], "same {k:left} {k:right}").count("n")
    flow = Dataflow(spark, log, {"n": r}, model)
    flow.apply(spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA).coalesce(1))
    paths = {flow.snapshot(), flow.snapshot()}
    assert len(paths) == 2
    again = Dataflow(spark, log, {"n": r}, model)
    again.restore(paths.pop())
    again.apply(spark.createDataFrame([("c", 3)], SCHEMA).coalesce(1))
    assert len(seen.read_text().split()) == 3  # a-b before, then a-c and b-c
    assert again.view("n").count() == 3


def test_several_outputs(spark):
    def fold(v):
        return {"all": "+".join(map(str, v["items"])), "n": len(v["items"])} if v.get("final") else "+".join(map(str, v["items"]))

    frame = spark.createDataFrame([("a", 1, 0), ("b", 2, 1), ("a", 3, 2)], f"{SCHEMA}, arrival long")
    r = log.group_by(["k"]).agg(sem_agg("fold", ["all", "n"], ["v"]))
    assert sorted(map(tuple, evaluate(r, frame, ["arrival"], TextModel({"fold": fold})).collect())) == [("a", "1+3", "1"), ("b", "2", "1")]
    with pytest.raises(ValueError):
        log.over((-1, 0)).sem_agg("fold", ["v"], ["k"])


def test_scores(spark):
    assert [stem(w) for w in ("caresses", "ponies", "hopping", "filing", "relational", "adjustment", "cease", "controlling")] == ["caress", "poni", "hop", "file", "relat", "adjust", "ceas", "control"]
    rows = [("running dogs", "dog runs", 2), ("x, blue cat", "blue cats, red", 1), ("Not mentioned here", "any", 5), ("a red", "red; or blue", 3), ("", "", 4)]
    df = spark.createDataFrame(rows, "a string, g string, c int")
    got = [r[0] for r in df.select(metrics.category_score(F.col("a"), F.col("g"), F.col("c"))).collect()]
    assert got == pytest.approx([1.0, 0.5, 1.0, 1.0, 1.0])
    golds = F.array(F.lit("The Red, fox"), F.lit("z"))
    said = spark.createDataFrame([("red fox!",), ("a big red fox",), ("fox",)], "a string")
    assert [tuple(r) for r in said.select(metrics.exact_match(F.col("a"), golds), metrics.substring_match(F.col("a"), golds)).collect()] == [(1, 1), (0, 1), (0, 0)]
    assert spark.range(1).select(metrics.parsed_answer(F.lit("so\nANSWER: 42 \nmore"))).first()[0] == "42"
    rng = random.Random(2)
    values = [rng.gauss(10, 3) for _ in range(500)]
    low, high = metrics.bootstrap(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    mean = sum(values) / len(values)
    error = math.sqrt(sum((v - mean) ** 2 for v in values)) / len(values)
    assert low == pytest.approx(mean - 1.96 * error, abs=0.5 * error) and high == pytest.approx(mean + 1.96 * error, abs=0.5 * error)
    names = spark.createDataFrame([("grean",), ("blu",), (None,)], "n string")
    titles = spark.createDataFrame([("Green",), ("Blue",), ("blurb",)], "t string")
    assert {(r["n"], r["nearest"]) for r in metrics.nearest_name(names, "n", titles, "t").collect()} == {("grean", "Green"), ("blu", "Blue"), (None, None)}
