"""One-operator tests on small inline frames."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.plans.expressions import Expr, case_when, col, least, try_cast
from tidemark.plans.relation import Log, collect_list, count, min_, sum_
from tidemark.streaming.engine import evaluate


def run(spark, relation, rows, schema):
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, arrival long")
    return [tuple(r) for r in evaluate(relation, frame, ["arrival"]).collect()]


ROWS = [(1, "a"), (None, "a"), (3, None), (1, "a")]
AB = "x long, y string"
log = Log(["x", "y"])


@pytest.mark.parametrize(
    ("condition", "kept"),
    [
        (col("x") == 1, 2),
        (col("x") != 1, 2),  # null differs from 1
        (col("x") < 3, 2),
        (~(col("x") < 3), 2),  # and is not below 3
        ((col("x") == 3) | (col("y") == "a"), 4),
        (col("x").isin([3]), 1),
        (col("x").isin([3, None]), 2),
        (col("y").is_null(), 1),
        (col("y").is_not_null() & (col("x") == 1), 2),
        (col("x") == "1", 0),  # kinds differ
        (col("x") != "1", 4),
    ],
)
def test_predicates_are_two_valued(spark, condition, kept):
    assert len(run(spark, log.filter(condition), ROWS, AB)) == kept


def test_kinds_cannot_be_ordered(spark):
    with pytest.raises(TypeError):
        run(spark, log.filter(col("x") < "a"), ROWS, AB)
    with pytest.raises(TypeError):
        run(spark, log.assign(z=col("y") + 1), ROWS, AB)


def test_expressions_have_no_truth_value():
    with pytest.raises(TypeError):
        bool(col("x") == 1)
    with pytest.raises(TypeError):
        log["x"]
    e = (col("x") + 1 == 2) & ~col("y").isin(["a"])
    assert Expr.from_param(e.to_param()).to_param() == e.to_param()


def test_values(spark):
    r = log.assign(a=col("x") * 2).assign(b=least(col("a"), 3), c=try_cast(col("y")), d=case_when(col("x") == 1, "one", "other"))
    assert run(spark, r[["a", "b", "c", "d"]], [(1, "1.5"), (None, "q"), (3, None)], AB) == [(2, 2, 1.5, "one"), (None, 3, None, "other"), (6, 3, None, "other")]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        run(spark, log.assign(z=col("x") / 0), [(1, "a")], AB)


def test_aggregates_of_nothing(spark):
    none = log.filter(col("x") > 99)
    assert run(spark, none.agg(count("n"), sum_("x", "s")), ROWS, AB) == [(0, None)]
    assert run(spark, none.array_agg(["x"], "l"), ROWS, AB) == [([],)]
    assert run(spark, none.min("m", "x"), ROWS, AB) == [(None,)]
    assert run(spark, none.group_by(["y"]).count("n"), ROWS, AB) == []
    assert run(spark, log.count("n"), [], AB) == [(0,)]


def test_groups_and_lists(spark):
    assert sorted(run(spark, log.group_by(["y"]).agg(count("n"), sum_("x", "s")), ROWS, AB), key=str) == [("a", 3, 2), (None, 1, 3)]
    assert run(spark, log.group_by(["y"]).agg(collect_list("x", "l")).filter(col("y") == "a"), ROWS, AB) == [("a", [1, None, 1])]
    m = log.group_by(["y"]).agg(min_("m", columns=["x", "y"])).filter(col("y") == "a").unnest("m", {"x": "lo"})
    assert run(spark, m[["lo"]], ROWS, AB) == [(1,)]
    with pytest.raises(TypeError):
        run(spark, log.sum("y", "s"), ROWS, AB)
    with pytest.raises(ValueError, match="mix"):
        log.group_by(["y"]).agg(count("n"), collect_list("x", "l"))


def test_bags_and_sets(spark):
    assert len(run(spark, log.concat(log), ROWS, AB)) == 8
    assert len(run(spark, log.union(log), ROWS, AB)) == 3
    assert run(spark, log.subtract(log.filter(col("x").is_null())), ROWS, AB).count((1, "a")) == 2
    assert run(spark, log.subtract(log.filter(col("y").is_null())).filter(col("y").is_null()), ROWS, AB) == []
    assert sorted(run(spark, log.drop_duplicates(["y"]), ROWS, AB), key=str) == [(1, "a"), (3, None)]
    assert len(run(spark, log[["x"]].union_by_name(log[["y"]]), ROWS, AB)) == 4
    assert len(run(spark, log.limit(2), ROWS, AB)) == 2
    with pytest.raises(ValueError):
        log.limit(True)


def test_joins(spark):
    left, right = log.filter(col("x").is_not_null()).alias("l"), log.filter(col("x") == 1).alias("r")
    assert left.join(right, ["x"]).columns == ("x", "y:l", "y:r")
    assert len(run(spark, left.join(right, ["x"]), ROWS, AB)) == 4
    assert len(run(spark, left.join(right, ["x"], "left"), ROWS, AB)) == 5
    assert run(spark, left.join(right, ["x"], "left_anti"), ROWS, AB) == [(3, None)]
    assert len(run(spark, left.join(right, [left.col("x") > right.col("x")]), ROWS, AB)) == 2
    with pytest.raises(Exception, match="null in join key"):
        run(spark, log.alias("a").join(log.alias("b"), ["x"]), ROWS, AB)
    with pytest.raises(ValueError):
        left.join(right, [left.col("x") == right.col("x")], "left")


def test_arrays(spark):
    r = Log(["k", "v"])
    schema = "k long, v array<array<long>>"
    rows = [(1, [[1], None, [2, 3]]), (2, None), (3, [])]
    assert run(spark, r.flatten("v"), rows, schema) == [(1, [1, 2, 3]), (2, []), (3, [])]
    assert run(spark, r.flatten("v").explode("v", "e"), rows, schema) == [(1, 1), (1, 2), (1, 3)]
    text = Log(["o"])
    assert run(spark, text.unnest("o", {"a": "b"}), [('{"a": "q"}',)], "o string") == [("q",)]
    with pytest.raises(Exception, match="no field"):
        run(spark, text.unnest("o", {"z": "b"}), [('{"a": "q"}',)], "o string")


def test_count_windows(spark):
    r = Log(["v"])
    rows = [(i,) for i in range(7)]
    sums = lambda size, slide: sorted(x[0] for x in run(spark, r.count_window(size, slide).process_window(lambda w: w.sum("v", "s")), rows, "v long"))
    assert sums(2, 2) == [1, 5, 9]
    assert sums(3, 1) == [3, 6, 9, 12, 15]
    assert sums(2, 3) == [1, 7]
    gone = r.count_window(2, 2).process_window(lambda w: w.filter(col("v") > 3).count("n"))
    assert sorted(x[0] for x in run(spark, gone, rows, "v long")) == [0, 0, 2]
    with pytest.raises(ValueError):
        r.count_window(2).process_window(lambda w: w.concat(r))


def test_frames_are_clipped(spark):
    r = Log(["v"]).over((-2, -1)).array_agg(["v"], "f")
    assert [[x["v"] for x in f] for _, f in sorted(run(spark, r, [(i,) for i in range(4)], "v long"))] == [[], [0], [0, 1], [1, 2]]


def test_plans_are_shared_and_pruned(spark):
    assert log.filter(col("x") == 1).node == Log(["x", "y"]).filter(col("x") == 1).node
    frame = spark.range(10).select(F.col("id").alias("x"), F.lit("a").alias("y"), F.col("id").alias("arrival"))
    plan = evaluate(log.filter(col("x") == 1)[["x"]], frame, ["arrival"])._jdf.queryExecution().optimizedPlan().toString()
    assert "__occ" not in plan


def test_queries_over_whole_tables(spark, tmp_path):
    rng = random.Random(5)
    customers = [(i, f"n{i}", rng.randrange(3), float(rng.randint(-50, 50)), rng.choice(["BUILDING", "AUTOMOBILE", "MACHINERY"])) for i in range(1000, 1060)]
    orders = [(i, i, rng.choice("FOP"), 1.0, str(i % 3)) for i in range(5000, 5050)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {n: Counter(map(tuple, queries.QUERIES[n](spark, str(tmp_path)).collect())) for n in ("concat_bag", "sem_join_rule", "sem_join_outer_rule", "graph_components")}
    assert got["concat_bag"] == Counter((o[2], o[4]) for bad in "PF" for o in orders if o[2] != bad)
    left, right = [c for c in customers if c[3] < 0], [c for c in customers if c[3] >= 0]
    pairs = {(x[0], y[0]) for x in left for y in right if x[2] == y[2] and len(x[4]) > len(y[4])}
    assert pairs and got["sem_join_rule"] == Counter(pairs)
    alone = {(x[0], None) for x in left if x[0] not in {a for a, _ in pairs}} | {(None, y[0]) for y in right if y[0] not in {b for _, b in pairs}}
    assert got["sem_join_outer_rule"] == Counter(pairs | alone)
    nation, root = {c[0]: c[2] for c in customers}, {}
    for i in sorted(nation):
        if i - 7 in nation and nation[i - 7] <= nation[i]:
            root[i] = root.setdefault(i - 7, i - 7)
    assert root and got["graph_components"] == Counter(root.items())
