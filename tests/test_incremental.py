"""What is maintained equals what is computed at once, batch after batch."""

import random

import pytest

from tidemark.functions.model import CachedModel, CascadeModel, PackedModel, PairwiseModel, ReplyError, Request, RuleModel, TextModel, ask, parse_reply, reads_keep, reads_label, reads_record
from tidemark.plans.expressions import col
from tidemark.plans.relation import Log, array_agg, avg, count, min_, sem_agg, sum_
from tidemark.streaming.engine import Dataflow, Memory, evaluate

SCHEMA = "k string, v long"
log = Log(["k", "v"])
low = log.group_by(["k"]).min("low", "v")
VIEWS = {
    "sums": log.group_by(["k"]).agg(count("n"), sum_("v", "s"), avg("v", "a")),
    "total": log.filter(col("v") > 3).agg(count("n"), sum_("v", "s")),
    "pairs": log.alias("a").join(log.filter(col("v") > 2).alias("b"), ["k"]),
    "by_low": low.group_by(["low"]).agg(count("n")),  # rows of ``low`` are retracted
    "lists": log.group_by(["k"]).array_agg(["v"], "l"),
    "set": log.union(log.filter(col("v") == 1)),
    "rest": log.subtract(log.filter(col("v") < 2)),
    "left": log[["k"]].join(low.filter(col("low") > 1), ["k"], "left"),
    "frames": log.over((-2, -1)).array_agg(["v"], "f"),
    "windows": log.count_window(3, 2).process_window(lambda w: w.sum("v", "s")),
}


def bag(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_incremental_equals_recomputed(spark):
    rng, rows = random.Random(5), []
    flow = Dataflow(spark, log, VIEWS)
    for size in (4, 0, 3):
        new = [(rng.choice("abc"), rng.choice([None, 0, 1, 2, 3, 4, 5])) for _ in range(size)]
        rows += new
        flow.apply(spark.createDataFrame(new, SCHEMA).coalesce(1))
        frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{SCHEMA}, arrival long")
        for name, relation in VIEWS.items():
            assert bag(flow.view(name)) == bag(evaluate(relation, frame, ["arrival"])), (name, rows)


def test_failed_step_publishes_nothing_and_restore(spark):
    bad = Dataflow(spark, log, {"v": log.assign(z=10 / col("v"))})
    memory = Memory(bad, every=2, schema=spark.createDataFrame([], SCHEMA).schema)
    memory.add({"k": "a", "v": 5})
    assert memory.pending_count == 1
    memory.add({"k": "a", "v": 2})
    assert memory.pending_count == 0
    memory.add({"k": "a", "v": 0})
    with pytest.raises(Exception, match="ZERO"):
        memory.flush()
    assert memory.pending_count == 1
    assert bad.view("v").count() == 2
    path = bad.snapshot()
    again = Dataflow(spark, log, {"v": log.assign(z=10 / col("v"))})
    again.restore(path)
    assert bag(again.view("v")) == bag(bad.view("v"))
    with pytest.raises(ValueError, match="another plan"):
        Dataflow(spark, log, {"v": log}).restore(path)


def test_only_new_rows_and_pairs_are_asked(spark, tmp_path):
    seen = tmp_path / "asked"

    def note(v):
        with seen.open("a") as f:
            f.write("x\n")
        return v["v:left"] < v["v:right"]

    model = RuleModel({"{v:left} before {v:right}?": note})
    pairs = log.sem_join(log, "{v:left} before {v:right}?", on=["k"])
    flow = Dataflow(spark, log, {"p": pairs}, model)
    flow.apply(spark.createDataFrame([("a", 1), ("a", 2)], SCHEMA))
    assert len(seen.read_text().split()) == 4
    flow.apply(spark.createDataFrame([("a", 3), ("b", 9)], SCHEMA))
    assert len(seen.read_text().split()) == 10  # five pairs of the new a, one of b
    assert flow.view("p").count() == 3


def test_system_columns_and_schema(spark):
    own = Log(["k"], system_columns=True)
    flow = Dataflow(spark, own, {"v": own})
    flow.apply(spark.createDataFrame([("a",), ("b",)], "k string").coalesce(1))
    flow.apply(spark.createDataFrame([("c",)], "k string"))
    assert [tuple(r) for r in flow.view("v").orderBy("_add_seq").select("k", "_add_seq").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    with pytest.raises(ValueError):
        flow.apply(spark.createDataFrame([(1,)], "z long"))
    with pytest.raises(ValueError):
        Log(["_row_id"])


def test_streaming_source(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA).write.parquet(str(tmp_path / "in"))
    flow = Dataflow(spark, log, {"n": log.group_by(["k"]).count("n")})
    flow.attach(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), str(tmp_path / "cp")).awaitTermination(120)
    assert bag(flow.view("n")) == bag(spark.createDataFrame([("a", 1), ("b", 1)], SCHEMA))


def test_semantic_groups_fold(spark):
    model = RuleModel({"same {k:left} {k:right}": lambda v: v["k:left"][0] == v["k:right"][0], "join": lambda v: "+".join(map(str, v["items"]))})
    r = log.sem_groupby(["k"], "same {k:left} {k:right}").agg(min_("k", "k"), sem_agg("join", "s", ["k"]), array_agg(["v"], "l"))
    frame = spark.createDataFrame([("ax", 1, 0), ("b", 2, 1), ("ay", 3, 2), ("az", 4, 3)], f"{SCHEMA}, arrival long")
    assert sorted((x["k"], x["s"]) for x in evaluate(r, frame, ["arrival"], model).collect()) == [("ax", "ax+ay+az"), ("b", "b")]
    with pytest.raises(ValueError):
        log.sem_groupby(["k"], "x").array_agg(["v"], "l")


def test_topk_is_listwise(spark):
    model = RuleModel({"best": lambda v: [i["id"] for i in sorted(v["items"], key=lambda i: -i["v"])][: v["k"]]})
    frame = spark.createDataFrame([(str(i), i % 50, i) for i in range(200)], f"{SCHEMA}, arrival long")
    assert [x["v"] for x in evaluate(log.sem_topk("best", 3), frame, ["arrival"], model).collect()] == [49, 49, 49]


def test_replies():
    assert parse_reply('```json\n{"a": [1, 2,],}\n```') == {"a": [1, 2]}
    assert parse_reply('{"a": "b') == {"a": "b"}
    with pytest.raises(ReplyError):
        parse_reply("no")
    replies = iter(["broken {", '{"keep": true}', "false"])

    class Flaky:
        def answer(self, requests):
            return [next(replies) for _ in requests]

    request = Request("filter", "x", {})
    assert ask(Flaky(), [request], reads_keep(None)) == [True]
    packed = PackedModel(lambda p: '{"results": [{"id": 0, "result": 1}, {"id": 1, "result": 2}]}', size=2)
    assert packed.answer([request, request]) == ["1", "2"]
    with pytest.raises(ReplyError):
        PackedModel(lambda p: '{"results": []}', size=2).answer([request])


def test_semantic_aggregates_fold_touched_groups_only(spark, tmp_path):
    seen = tmp_path / "folded"

    def fold(v):
        with seen.open("a") as f:
            f.write("x\n")
        return "+".join(map(str, v["items"]))

    def same(v):
        with (tmp_path / "pairs").open("a") as f:
            f.write("x\n")
        return v["k:left"][0] == v["k:right"][0]

    model = RuleModel({"fold": fold, "same {k:left} {k:right}": same})
    views = {"exact": log.group_by(["k"]).sem_agg("fold", "s", ["v"]), "near": log.sem_groupby(["k"], "same {k:left} {k:right}").members().group_by(["__group"]).agg(min_("k", "k"), count_rows())}
    flow = Dataflow(spark, log, views, model)
    flow.apply(spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA).coalesce(1))
    assert (len(seen.read_text().split()), len((tmp_path / "pairs").read_text().split())) == (2, 1)
    flow.apply(spark.createDataFrame([("a", 3), ("ac", 4)], SCHEMA).coalesce(1))
    assert len(seen.read_text().split()) == 4  # a and ac, not b
    assert len((tmp_path / "pairs").read_text().split()) == 3  # two new pairs
    assert bag(flow.view("exact")) == bag(spark.createDataFrame([("a", "1+3"), ("ac", "4"), ("b", "2")], "k string, s string"))
    assert sorted((r["k"], len(r["l"])) for r in flow.view("near").collect()) == [("a", 3), ("b", 1)]


def count_rows():
    from tidemark.plans.relation import collect_list

    return collect_list("v", "l")


def test_model_wrappers():
    asked = []

    class Oracle:
        def answer(self, requests):
            asked.extend(requests)
            return ["true" if r.kind != "compare" or r.values["a"]["v"] > r.values["b"]["v"] else "false" for r in requests]

    model = CascadeModel(Oracle(), lambda v: v["p"], 0.2, 0.8)
    got = model.answer([Request("filter", "x", {"p": p}) for p in (0.1, 0.5, 0.9)])
    assert got == ["false", "true", "true"] and len(asked) == 1
    items = [{"id": i, "v": v} for i, v in enumerate((3, 9, 1, 7))]
    for method in ("naive", "quick", "heap"):
        rank = Request("rank", "x", {"query": "q", "items": items, "k": 2})
        assert PairwiseModel(Oracle(), method).answer([rank]) == ["[1, 3]"]
    asked.clear()
    cached = CachedModel(Oracle())
    cached.answer([Request("filter", "x", {"p": 1})] * 3)
    cached.answer([Request("filter", "x", {"p": 1})])
    assert len(asked) == 1
