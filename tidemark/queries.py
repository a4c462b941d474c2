"""Queries over the test tables that exercise every operator, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.functions.model import RuleModel, SameKey
from tidemark.operators import search as s
from tidemark.operators.components import components
from tidemark.plans import policies
from tidemark.plans.expressions import case_when, col, least, try_cast
from tidemark.plans.relation import Log, Relation, array_agg, avg, collect_list, count, min_, sem_agg, sum_
from tidemark.streaming.engine import Dataflow, evaluate, evaluate_many

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The columns that give a table its order of arrival.
ORDER = {"lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "customer": ["c_custkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "conversations": ["conv_id", "turn"]}
COLUMNS = {
    "lineitem": "l_orderkey l_linenumber l_quantity l_extendedprice l_discount l_returnflag l_linestatus l_shipdate",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderpriority",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "nation": "n_nationkey n_name n_regionkey",
    "part": "p_partkey p_brand p_size p_retailprice",
    "supplier": "s_suppkey s_nationkey s_acctbal",
    "events": "event_id user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "conversations": "conv_id turn role text",
}


def log(name: str) -> Log:
    return Log(COLUMNS[name].split(), name=name)


def over(spark: SparkSession, sf_dir: str, relation: Relation, *names: str, model=None, options=None) -> DataFrame:
    frames = {n: (table(spark, sf_dir, n), ORDER[n]) for n in names}
    return evaluate_many(relation, frames, model, options)


def rounded(df: DataFrame, digits: int = 2, **names: int) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(F.round(f"`{x}`", names.get(x, digits)).alias(x) if kinds[x] in ("double", "float") else F.col(f"`{x}`") for x in df.columns))


# Projection, filters and expressions

@registered("""SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem WHERE l_discount >= 0.02 AND l_quantity < 40 GROUP BY l_returnflag""")
def flagship_revenue(spark, sf_dir):
    r = log("lineitem").filter((col("l_discount") >= 0.02) & (col("l_quantity") < 40)).assign(rev=col("l_extendedprice") * (1 - col("l_discount")))
    return rounded(over(spark, sf_dir, r.group_by(["l_returnflag"]).agg(count("n"), sum_("rev", "revenue")), "lineitem"))


@registered("SELECT c_name, c_custkey FROM customer")
def proj_select(spark, sf_dir):
    return over(spark, sf_dir, log("customer")[["c_name", "c_custkey"]], "customer")


@registered("SELECT c_custkey, a, a * 2 AS b, round(a * 2 + c_acctbal, 2) AS c_acctbal FROM (SELECT *, c_nationkey + 1::BIGINT AS a FROM customer)")
def assign_seq(spark, sf_dir):
    r = log("customer").assign(a=col("c_nationkey") + 1).assign(b=col("a") * 2, c_acctbal=col("b") + col("c_acctbal"))
    return rounded(over(spark, sf_dir, r[["c_custkey", "a", "b", "c_acctbal"]], "customer"))


def _with_nulls() -> Relation:
    """Prices of orders with open status are null."""
    return log("orders").assign(price=case_when(col("o_orderstatus") == "O", None, col("o_totalprice")))


NULLS = "(SELECT *, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_totalprice END AS price FROM orders)"


@registered(f"SELECT o_orderkey FROM {NULLS} WHERE coalesce(price <> 1000, true)")
def filter_ne_null(spark, sf_dir):
    return over(spark, sf_dir, _with_nulls().filter(col("price") != 1000)[["o_orderkey"]], "orders")


@registered(f"SELECT o_orderkey FROM {NULLS} WHERE NOT coalesce(price < 150000, false)")
def filter_not_null_pred(spark, sf_dir):
    return over(spark, sf_dir, _with_nulls().filter(~(col("price") < 150000))[["o_orderkey"]], "orders")


@registered(f"SELECT o_orderkey FROM {NULLS} WHERE coalesce(price >= 200000, false) OR o_orderpriority = '1-URGENT'")
def filter_or_null(spark, sf_dir):
    return over(spark, sf_dir, _with_nulls().filter((col("price") >= 200000) | (col("o_orderpriority") == "1-URGENT"))[["o_orderkey"]], "orders")


@registered("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def filter_isin(spark, sf_dir):
    return over(spark, sf_dir, log("customer").filter(col("c_mktsegment").isin(["BUILDING", "MACHINERY"]))[["c_custkey"]], "customer")


@registered(f"SELECT o_orderkey FROM {NULLS} WHERE price IS NULL OR price IN (0)")
def filter_isin_null(spark, sf_dir):
    return over(spark, sf_dir, _with_nulls().filter(col("price").isin([0.0, None]))[["o_orderkey"]], "orders")


@registered(f"SELECT o_orderkey, price IS NULL AS missing FROM {NULLS} WHERE price IS NULL UNION ALL SELECT o_orderkey, false FROM {NULLS} WHERE price IS NOT NULL")
def is_null(spark, sf_dir):
    r = _with_nulls()
    both = r.filter(col("price").is_null()).assign(missing=True)[["o_orderkey", "missing"]].concat(r.filter(col("price").is_not_null()).assign(missing=False)[["o_orderkey", "missing"]])
    return over(spark, sf_dir, both, "orders")


@registered("SELECT c_custkey FROM customer WHERE true")
def filter_mixed_kinds(spark, sf_dir):
    return over(spark, sf_dir, log("customer").filter((col("c_name") != 5) & ~(col("c_nationkey") == "x"))[["c_custkey"]], "customer")


@registered("SELECT o_orderkey, round(o_totalprice / 7, 4) AS q, round(100 - o_totalprice, 2) AS d FROM orders")
def arith_div(spark, sf_dir):
    return rounded(over(spark, sf_dir, log("orders").assign(q=col("o_totalprice") / 7, d=100 - col("o_totalprice"))[["o_orderkey", "q", "d"]], "orders"), q=4)


@registered(f"SELECT o_orderkey, round(least(price, 123456.5), 2) AS low FROM {NULLS}")
def least_null(spark, sf_dir):
    return rounded(over(spark, sf_dir, _with_nulls().assign(low=least(col("price"), 123456.5))[["o_orderkey", "low"]], "orders"))


@registered("SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS a, TRY_CAST(CAST(user_id AS VARCHAR) AS DOUBLE) AS b FROM events")
def try_cast_text(spark, sf_dir):
    frame = table(spark, sf_dir, "events").withColumn("user_id", F.col("user_id").cast("string"))
    r = log("events").assign(a=try_cast(col("event_type")), b=try_cast(col("user_id")))
    return evaluate(r[["event_id", "a", "b"]], frame, ["event_id"])


@registered("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS tier FROM customer")
def case_when_tier(spark, sf_dir):
    tier = case_when(col("c_acctbal") < 0, "debt", case_when(col("c_acctbal") < 5000, "low", "high"))
    return over(spark, sf_dir, log("customer").assign(tier=tier)[["c_custkey", "tier"]], "customer")


# Aggregates

@registered("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 2) AS a FROM orders")
def agg_global(spark, sf_dir):
    return rounded(over(spark, sf_dir, log("orders").agg(count("n"), sum_("o_totalprice", "s"), avg("o_totalprice", "a")), "orders"))


@registered("SELECT count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0")
def agg_global_empty(spark, sf_dir):
    return over(spark, sf_dir, log("orders").filter(col("o_orderkey") < 0).agg(count("n"), sum_("o_totalprice", "s"), avg("o_totalprice", "a")), "orders")


@registered("SELECT k, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS k, o_totalprice FROM orders) GROUP BY k")
def agg_group_nullkey(spark, sf_dir):
    r = log("orders").assign(k=case_when(col("o_orderstatus") == "F", None, col("o_orderpriority")))
    return rounded(over(spark, sf_dir, r.group_by(["k"]).agg(count("n"), sum_("o_totalprice", "s")), "orders"))


@registered("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS q FROM lineitem GROUP BY ALL HAVING count(*) > 10")
def agg_having(spark, sf_dir):
    r = log("lineitem").group_by(["l_returnflag", "l_linestatus"]).agg(avg("l_quantity", "q"), count("n")).filter(col("n") > 10)
    return rounded(over(spark, sf_dir, r[["l_returnflag", "l_linestatus", "q"]], "lineitem"), q=4)


@registered("SELECT c_nationkey, min(c_acctbal) AS low FROM customer GROUP BY c_nationkey")
def min_scalar(spark, sf_dir):
    return over(spark, sf_dir, log("customer").group_by(["c_nationkey"]).min("low", "c_acctbal"), "customer")


@registered(f"SELECT o_orderpriority, arg_min(price, (price, o_orderkey)) AS price, arg_min(o_orderkey, (price, o_orderkey)) AS o_orderkey FROM {NULLS} WHERE price IS NOT NULL GROUP BY 1")
def min_composite(spark, sf_dir):
    r = _with_nulls().group_by(["o_orderpriority"]).min("m", columns=["price", "o_orderkey"])
    return over(spark, sf_dir, r.unnest("m", {"price": "price", "o_orderkey": "o_orderkey"}), "orders")


@registered("SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY event_id) AS types FROM events GROUP BY user_id")
def array_agg_order(spark, sf_dir):
    df = over(spark, sf_dir, log("events").group_by(["user_id"]).array_agg(["event_id", "event_type"], "items"), "events")
    return df.select("user_id", F.size("items").cast("long").alias("n"), F.array_join(F.col("items.event_type"), ",").alias("types"))


@registered(f"SELECT o_custkey, count(*) AS n, count(*) FILTER (price IS NULL) AS nulls FROM {NULLS} GROUP BY o_custkey")
def collect_list_nulls(spark, sf_dir):
    df = over(spark, sf_dir, _with_nulls().group_by(["o_custkey"]).agg(collect_list("price", "p")), "orders")
    return df.select("o_custkey", F.size("p").cast("long").alias("n"), F.size(F.filter("p", lambda x: x.isNull())).cast("long").alias("nulls"))


@registered("SELECT 0::BIGINT AS n")
def array_agg_empty(spark, sf_dir):
    df = over(spark, sf_dir, log("orders").filter(col("o_orderkey") < 0).array_agg(["o_orderkey"], "items"), "orders")
    return df.select(F.size("items").cast("long").alias("n"))


@registered("SELECT (SELECT count(*) FROM nation WHERE n_regionkey = 0) + (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS n")
def array_cat_states(spark, sf_dir):
    n = log("nation")
    r = n.filter(col("n_regionkey") == 0).array_agg(["n_name"], "x").array_cat(n.filter(col("n_regionkey") == 1).array_agg(["n_name"], "x"), "x")
    return over(spark, sf_dir, r, "nation").select(F.size("x").cast("long").alias("n"))


@registered("SELECT event_id, user_id FROM events")
def flatten_roundtrip(spark, sf_dir):
    r = log("events").group_by(["user_id", "event_type"]).array_agg(["event_id"], "items").group_by(["user_id"]).agg(collect_list("items", "lists")).flatten("lists", "all").explode("all", "e").unnest("e", {"event_id": "event_id"})
    return over(spark, sf_dir, r[["event_id", "user_id"]], "events")


@registered("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_exists(props, '$.k')")
def unnest_props(spark, sf_dir):
    frame = table(spark, sf_dir, "events").filter(F.get_json_object("props", "$.k").isNotNull())
    return evaluate(log("events").unnest("props", {"k": "k"})[["event_id", "k"]], frame, ["event_id"])


# Sets

@registered("SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus <> 'F'")
def concat_bag(spark, sf_dir):
    k = ["o_orderstatus", "o_orderpriority"]
    return over(spark, sf_dir, log("orders").filter(col("o_orderstatus") != "P")[k].concat(log("orders").filter(col("o_orderstatus") != "F")[k]), "orders")


@registered("SELECT o_orderstatus, o_orderpriority FROM orders")
def concat_halves(spark, sf_dir):
    k = ["o_orderstatus", "o_orderpriority"]
    return over(spark, sf_dir, log("orders").filter(col("o_totalprice") < 100000)[k].concat(log("orders").filter(~(col("o_totalprice") < 100000))[k]), "orders")


@registered("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def union_set(spark, sf_dir):
    k = ["o_orderstatus", "o_orderpriority"]
    return over(spark, sf_dir, log("orders")[k].union(log("orders")[k]), "orders")


@registered("SELECT DISTINCT o_orderstatus, o_orderpriority FROM (SELECT o_orderstatus, NULL AS o_orderpriority FROM orders UNION ALL SELECT NULL, o_orderpriority FROM orders)")
def union_by_name_missing(spark, sf_dir):
    return over(spark, sf_dir, log("orders")[["o_orderstatus"]].union_by_name(log("orders")[["o_orderpriority"]]), "orders")


@registered("""WITH n AS (SELECT CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS st, o_orderpriority AS p, o_totalprice AS t FROM orders)
SELECT st, p FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE b.t < 5000 AND b.st IS NOT DISTINCT FROM a.st AND b.p = a.p)""")
def subtract_bag(spark, sf_dir):
    r = log("orders").assign(st=case_when(col("o_orderstatus") == "O", None, col("o_orderstatus")), p=col("o_orderpriority"))
    return over(spark, sf_dir, r[["st", "p"]].subtract(r.filter(col("o_totalprice") < 5000)[["st", "p"]]), "orders")


@registered("SELECT c_nationkey, min(c_custkey) AS c_custkey, arg_min(c_name, c_custkey) AS c_name FROM customer GROUP BY c_nationkey")
def dedup_first(spark, sf_dir):
    return over(spark, sf_dir, log("customer").drop_duplicates(["c_nationkey"])[["c_nationkey", "c_custkey", "c_name"]], "customer")


@registered("SELECT least(100, count(*))::BIGINT AS n FROM orders")
def limit_count(spark, sf_dir):
    return over(spark, sf_dir, log("orders").limit(100).count("n"), "orders")


# Joins

def _customers_of(how: str) -> Relation:
    orders = log("orders").assign(c_custkey=col("o_custkey")).filter(col("o_totalprice") > 200000)[["c_custkey", "o_orderkey"]]
    return log("customer").filter(col("c_acctbal") > 0)[["c_custkey", "c_name"]].join(orders, ["c_custkey"], how)


JOIN = "(SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0) {how} JOIN (SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE o_totalprice > 200000) USING (c_custkey)"


def _join_query(how: str, sql_how: str):
    def run(spark, sf_dir):
        return over(spark, sf_dir, _customers_of(how), "customer", "orders")

    run.__name__ = f"join_{how}"
    registered(f"SELECT c_custkey, c_name, o_orderkey FROM {JOIN.format(how=sql_how)}")(run)


for _how, _sql in (("inner", ""), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    _join_query(_how, _sql)


@registered(f"SELECT c_custkey, c_name FROM {JOIN.format(how='ANTI')}")
def join_left_anti(spark, sf_dir):
    return over(spark, sf_dir, _customers_of("left_anti"), "customer", "orders")


@registered("SELECT n.n_name AS a, m.n_name AS b, n.n_regionkey FROM nation n JOIN nation m USING (n_regionkey)")
def join_suffixes(spark, sf_dir):
    r = log("nation").alias("x").join(log("nation").alias("y"), ["n_regionkey"])
    return over(spark, sf_dir, r.assign(a=col("n_name:x"), b=col("n_name:y"))[["a", "b", "n_regionkey"]], "nation")


@registered("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type <> b.event_type AND a.event_id < b.event_id")
def join_temporal_self(spark, sf_dir):
    x, y = log("events").alias("x"), log("events").alias("y")
    r = x.join(y, [x.col("user_id") == y.col("user_id"), x.col("event_type") != y.col("event_type"), x.col("event_id") < y.col("event_id")])
    return over(spark, sf_dir, r.assign(a=col("event_id:x"), b=col("event_id:y"))[["a", "b"]], "events")


@registered("SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_acctbal < n_nationkey * 100")
def join_theta_range(spark, sf_dir):
    x, y = log("supplier").alias("x"), log("nation").assign(top=col("n_nationkey") * 100).alias("y")
    r = x.join(y, x.col("s_acctbal") < y.col("top"))
    return over(spark, sf_dir, r.assign(s_suppkey=col("s_suppkey:x"), n_nationkey=col("n_nationkey:y"))[["s_suppkey", "n_nationkey"]], "supplier", "nation")


# Windows

def _window_sql(size: int, slide: int) -> str:
    return f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS total FROM events),
w AS (SELECT unnest(range((SELECT count(*) FROM events))) AS w)
SELECT count(*) AS n, round(sum(value), 2) AS s, min(event_id) AS first FROM w JOIN e ON p >= w * {slide} AND p < w * {slide} + {size} WHERE w * {slide} + {size} <= total GROUP BY w"""


def _window(spark, sf_dir, size: int, slide: int) -> DataFrame:
    def body(w: Relation) -> Relation:
        return w.agg(count("n"), sum_("value", "s")).assign(k=1).join(w.min("first", "event_id").assign(k=1), ["k"])[["n", "s", "first"]]

    return rounded(over(spark, sf_dir, log("events").count_window(size, slide).process_window(body), "events"))


@registered(_window_sql(50, 50))
def win_tumbling(spark, sf_dir):
    return _window(spark, sf_dir, 50, 50)


@registered(_window_sql(40, 15))
def win_sliding(spark, sf_dir):
    return _window(spark, sf_dir, 40, 15)


@registered(_window_sql(30, 70))
def win_gapped(spark, sf_dir):
    return _window(spark, sf_dir, 30, 70)


@registered("SELECT event_id, coalesce(len(f), 0)::BIGINT AS n, f[1] AS oldest FROM (SELECT event_id, list(event_id) OVER (ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS f FROM events)")
def over_prev10(spark, sf_dir):
    df = over(spark, sf_dir, log("events").over((-10, -1)).array_agg(["event_id"], "f"), "events")
    return df.select("event_id", F.size("f").cast("long").alias("n"), F.get("f", F.lit(0))["event_id"].alias("oldest"))


# Incremental maintenance: the table in batches, the view at the end

def flow(spark, sf_dir, name: str, relation: Relation, source: Log, batches: int = 3, model=None, options=None) -> DataFrame:
    frame = table(spark, sf_dir, name).select(*source.declared).repartitionByRange(8, *ORDER[name]).sortWithinPartitions(*ORDER[name])
    bounds = frame.agg(F.percentile_approx(ORDER[name][0], [i / batches for i in range(1, batches)]).alias("q")).first()["q"] or []
    run = Dataflow(spark, source, {"v": relation}, model, options)
    key = F.col(ORDER[name][0])
    for lo, hi in zip([None, *bounds], [*bounds, None], strict=True):
        part = frame
        part = part.filter(key > lo) if lo is not None else part
        part = part.filter(key <= hi) if hi is not None else part
        run.apply(part)
    return run.view("v")


@registered("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 2) AS a FROM orders GROUP BY 1")
def ivm_agg(spark, sf_dir):
    src = log("orders")
    return rounded(flow(spark, sf_dir, "orders", src.group_by(["o_orderpriority"]).agg(count("n"), sum_("o_totalprice", "s"), avg("o_totalprice", "a")), src))


@registered("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type = 'purchase' AND b.event_type = 'click'")
def ivm_join(spark, sf_dir):
    src = log("events")
    x, y = src.filter(col("event_type") == "purchase").alias("x"), src.filter(col("event_type") == "click").alias("y")
    r = x.join(y, [x.col("user_id") == y.col("user_id"), x.col("event_id") < y.col("event_id")]).assign(a=col("event_id:x"), b=col("event_id:y"))[["a", "b"]]
    return flow(spark, sf_dir, "events", r, src)


@registered("SELECT low, count(*) AS n FROM (SELECT user_id, min(event_type) AS low FROM events GROUP BY user_id) GROUP BY low")
def ivm_min(spark, sf_dir):
    """The minimum of a user changes with later batches: its row is retracted below the count."""
    src = log("events")
    return flow(spark, sf_dir, "events", src.group_by(["user_id"]).min("low", "event_type").group_by(["low"]).count("n"), src)


@registered("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id")
def ivm_array(spark, sf_dir):
    src = log("events")
    df = flow(spark, sf_dir, "events", src.group_by(["user_id"]).array_agg(["event_id"], "items"), src)
    return df.select("user_id", F.array_join(F.transform("items", lambda x: x["event_id"].cast("string")), ",").alias("ids"))


@registered("SELECT event_id, least(10, row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS n FROM events")
def ivm_over(spark, sf_dir):
    src = log("events")
    return flow(spark, sf_dir, "events", src.over((-10, -1)).array_agg(["event_id"], "f"), src).select("event_id", F.size("f").cast("long").alias("n"))


@registered("SELECT DISTINCT user_id, event_type FROM events")
def ivm_distinct(spark, sf_dir):
    src = log("events")
    return flow(spark, sf_dir, "events", src[["user_id", "event_type"]].drop_duplicates(), src)


# Semantic operators with rules in place of a model

RULES = RuleModel({
    "Does {text} mention 'the'?": lambda v: " the " in f" {v['text']} ",
    "Turn {source} round": lambda v: v["source"][::-1],
    "Split {source}": lambda v: {"rows": [{"letter": x} for x in v["source"]]},
    "Which family has {lang}?": lambda v: "germanic" if v["lang"] in ("en", "de") else "romance",
    "Is {c_mktsegment:left} longer than {c_mktsegment:right}?": lambda v: len(v["c_mktsegment:left"]) > len(v["c_mktsegment:right"]),
    "Join the names": lambda v: " ".join(sorted({w for i in v["items"] for w in str(i).split(" ")})),
    "Same first letter: {n_name:left}, {n_name:right}?": lambda v: v["n_name:left"][0] == v["n_name:right"][0],
    "count": lambda v: str(len(v["items"])),
})


@registered("SELECT doc_id FROM documents WHERE contains(' ' || text || ' ', ' the ')")
def sem_filter_rule(spark, sf_dir):
    return over(spark, sf_dir, log("documents").sem_filter("Does {text} mention 'the'?")[["doc_id"]], "documents", model=RULES)


@registered("SELECT doc_id, reverse(source) AS turned FROM documents")
def sem_map_rule(spark, sf_dir):
    return over(spark, sf_dir, log("documents").sem_map(["source"], ["turned"], "Turn {source} round")[["doc_id", "turned"]], "documents", model=RULES)


@registered("SELECT doc_id, unnest(range(length(source))) AS ordinal, unnest(string_split(source, '')) AS letter FROM documents")
def sem_flat_map_rule(spark, sf_dir):
    return over(spark, sf_dir, log("documents").sem_flat_map(["source"], ["letter"], "Split {source}", "ordinal")[["doc_id", "ordinal", "letter"]], "documents", model=RULES)


@registered("SELECT CASE WHEN lang IN ('en', 'de') THEN 'germanic' ELSE 'romance' END AS family, count(*) AS n FROM documents GROUP BY 1")
def sem_labels_rule(spark, sf_dir):
    r = log("documents").sem_groupby(["lang"], "Which family has {lang}?", labels={"germanic": "", "romance": ""}, label_col="family").count("n")
    return over(spark, sf_dir, r, "documents", model=RULES)


def _sem_pairs(how: str) -> Relation:
    k = ["c_custkey", "c_nationkey", "c_mktsegment"]
    left, right = log("customer").filter(col("c_acctbal") < 0)[k], log("customer").filter(col("c_acctbal") >= 0)[k]
    r = left.sem_join(right, "Is {c_mktsegment:left} longer than {c_mktsegment:right}?", how, on=["c_nationkey"])
    return r.assign(a=col("c_custkey:left"), b=col("c_custkey:right"))[["a", "b"]]


@registered("SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y ON x.c_nationkey = y.c_nationkey AND length(x.c_mktsegment) > length(y.c_mktsegment) WHERE x.c_acctbal < 0 AND y.c_acctbal >= 0")
def sem_join_rule(spark, sf_dir):
    return over(spark, sf_dir, _sem_pairs("inner"), "customer", model=RULES)


@registered("SELECT x.c_custkey AS a, y.c_custkey AS b FROM (FROM customer WHERE c_acctbal < 0) x FULL JOIN (FROM customer WHERE c_acctbal >= 0) y ON x.c_nationkey = y.c_nationkey AND length(x.c_mktsegment) > length(y.c_mktsegment)")
def sem_join_outer_rule(spark, sf_dir):
    return over(spark, sf_dir, _sem_pairs("outer"), "customer", model=RULES)


COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@registered(f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) <= 3")
def sem_join_topk_proxy(spark, sf_dir):
    x, y = log("embeddings").alias("x"), log("embeddings").alias("y")
    r = x.sem_join(y, "never asked", on=[x.col("label") == y.col("label"), x.col("vec_id") != y.col("vec_id")], k=3)
    out = over(spark, sf_dir, r, "embeddings", options={"pairs": {"mode": "proxy-only", "left": "embedding:x", "right": "embedding:y", "k": 3}})
    return out.select(F.col("`vec_id:x`").alias("a"), F.col("`vec_id:y`").alias("b"))


@registered(f"SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {COS} >= 0.2 QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS} DESC, a.vec_id) <= 2")
def pair_search_filter(spark, sf_dir):
    x, y = log("embeddings").alias("x"), log("embeddings").alias("y")
    r = x.sem_join(y, "never asked", on=[x.col("label") == y.col("label"), x.col("vec_id") != y.col("vec_id")])
    out = over(spark, sf_dir, r, "embeddings", options={"pairs": {"mode": "proxy-only", "left": "embedding:x", "right": "embedding:y", "threshold": 0.2, "k": 2, "per": "right"}})
    return out.select(F.col("`vec_id:x`").alias("a"), F.col("`vec_id:y`").alias("b"))


@registered("SELECT min(n_name) AS n_name, count(*) AS n FROM nation GROUP BY n_name[1]")
def sem_groupby_rule(spark, sf_dir):
    m = log("nation").sem_groupby(["n_name"], "Same first letter: {n_name:left}, {n_name:right}?").members()
    r = m.group_by(["__group"]).agg(collect_list("n_name", "names"))
    df = over(spark, sf_dir, r, "nation", model=RULES)
    return df.select(F.array_min("names").alias("n_name"), F.size("names").cast("long").alias("n"))


@registered("SELECT n_regionkey, string_agg(DISTINCT w, ' ' ORDER BY w) AS names FROM (SELECT n_regionkey, unnest(string_split(n_name, ' ')) AS w FROM nation) GROUP BY n_regionkey")
def sem_agg_rule(spark, sf_dir):
    return over(spark, sf_dir, log("nation").group_by(["n_regionkey"]).sem_agg("Join the names", "names", ["n_name"]), "nation", model=RULES)


@registered("SELECT n_regionkey, string_agg(DISTINCT w, ' ' ORDER BY w) AS names, count(DISTINCT n_name) AS n FROM (SELECT n_regionkey, n_name, unnest(string_split(n_name, ' ')) AS w FROM nation) GROUP BY n_regionkey")
def sem_agg_mixed(spark, sf_dir):
    r = log("nation").group_by(["n_regionkey"]).agg(sem_agg("Join the names", "names", ["n_name"]), array_agg(["n_name"], "items"))
    return over(spark, sf_dir, r, "nation", model=RULES).select("n_regionkey", "names", F.size("items").cast("long").alias("n"))


@registered("SELECT event_id, nullif(least(2, row_number() OVER (ORDER BY event_id) - 1), 0)::VARCHAR AS n FROM events")
def sem_over_rule(spark, sf_dir):
    return over(spark, sf_dir, log("events").over((-2, -1)).sem_agg("count", "n", ["event_type"])[["event_id", "n"]], "events", model=RULES)


@registered("SELECT doc_id FROM documents WHERE contains(' ' || text || ' ', ' the ')")
def ivm_sem_filter(spark, sf_dir):
    src = log("documents")
    return flow(spark, sf_dir, "documents", src.sem_filter("Does {text} mention 'the'?")[["doc_id"]], src, model=RULES)


# Search

BM25_SQL = """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'the')) AS t0, len(list_filter(w, lambda x: x = 'with')) AS t1 FROM d),
t AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c),
s AS (SELECT doc_id, ln(1 + (n - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * dl / a)) + ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * dl / a)) AS score FROM c, t)"""


@registered(BM25_SQL + " SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0")
def search_bm25(spark, sf_dir):
    return s.bm25(table(spark, sf_dir, "documents"), "doc_id", ["text"], "the with").select(F.col("record_id").alias("doc_id"), F.round("score", 6).alias("score"))


def _first_vector(spark, sf_dir) -> tuple[float, ...]:
    return tuple(table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).collect()[0]["embedding"])


@registered(f"SELECT b.vec_id, round({COS}, 6) AS score, row_number() OVER (ORDER BY {COS} DESC, b.vec_id)::INTEGER AS rank FROM embeddings b, (FROM embeddings ORDER BY vec_id LIMIT 1) a WHERE {COS} >= -1 QUALIFY rank <= 20")
def search_cosine(spark, sf_dir):
    method = s.CosineSimilarity("embedding", _first_vector(spark, sf_dir), min_score=-1.0)
    return s.search(table(spark, sf_dir, "embeddings"), "vec_id", "", [method], limit=20).select("vec_id", F.round("score", 6).alias("score"), "rank")


@registered(f"""WITH q AS (FROM embeddings ORDER BY vec_id LIMIT 1),
r AS (SELECT b.vec_id, row_number() OVER (ORDER BY {COS} DESC, b.vec_id) AS r FROM embeddings b, q a WHERE {COS} >= 0.1 QUALIFY r <= 20),
g AS (SELECT b.vec_id, row_number() OVER (ORDER BY {COS} DESC, b.vec_id) AS r FROM embeddings b, q a WHERE {COS} > 0.6 QUALIFY r <= 20)
SELECT vec_id, round(sum(1.0 / r), 6) AS score, row_number() OVER (ORDER BY sum(1.0 / r) DESC, vec_id)::INTEGER AS rank FROM (FROM r UNION ALL FROM g) GROUP BY vec_id QUALIFY rank <= 10""")
def search_rrf(spark, sf_dir):
    v = _first_vector(spark, sf_dir)
    methods = [s.CosineSimilarity("embedding", v, min_score=0.1), s.CosineSimilarity("embedding", v)]
    return s.search(table(spark, sf_dir, "embeddings"), "vec_id", "", methods, s.RRF(), limit=10).select("vec_id", F.round("score", 6).alias("score"), "rank")


EDGES = "(SELECT n_nationkey AS s, n_nationkey + 1 AS t FROM nation WHERE n_nationkey % 6 <> 5)"


@registered(f"""WITH e AS (SELECT s, t FROM {EDGES} UNION ALL SELECT t, s FROM {EDGES}), h1 AS (SELECT DISTINCT t FROM e WHERE s = 7), h2 AS (SELECT DISTINCT e.t FROM e JOIN h1 ON e.s = h1.t)
SELECT t::BIGINT AS record_id, 1.0::DOUBLE AS score FROM (FROM h1 UNION FROM h2)""")
def search_bfs(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("source"))
    edges = n.filter("source % 6 <> 5").withColumn("target", F.col("source") + 1)
    return s.reachable(n.filter("source = 7").withColumnRenamed("source", "record_id"), edges, 2)


@registered("""WITH t AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY length(n_name) DESC, n_nationkey)::INTEGER AS rank FROM nation WHERE contains(lower(n_name), 'united') OR contains(lower(n_name), 'nation'))
SELECT n_nationkey, rank FROM t WHERE rank <= 25""")
def search_cross_encoder(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumn("words", F.regexp_replace(F.lower("n_name"), "(united|nation).*", "$1"))
    encoder = s.CrossEncoder(lambda q, texts: [float(len(t)) for t in texts], "n_name")
    methods = [s.BM25(("words",)), s.BM25(("words",))]
    return s.search(nation, "n_nationkey", "united nation", methods, encoder, limit=25).select("n_nationkey", "rank")


@registered("""WITH RECURSIVE e AS (SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 7 AND a.c_nationkey <= b.c_nationkey),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e), r AS (SELECT x AS node, x AS root FROM u UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node)
SELECT node, min(root) AS root FROM r GROUP BY node""")
def graph_components(spark, sf_dir):
    """Components over pairs of neighbours, the smallest key of each."""
    k = table(spark, sf_dir, "customer")
    a, b = k.select(F.col("c_custkey").alias("x"), F.col("c_nationkey").alias("m")), k.select(F.col("c_custkey").alias("y"), F.col("c_nationkey").alias("n"))
    return components(a.join(b, (F.col("y") == F.col("x") + 7) & (F.col("m") <= F.col("n"))), "x", "y")


# Policies over conversations, and evaluation

POLICY_RULES = RuleModel({
    policies.TOPIC: lambda v: {"rows": [{"topic": f"{len(w)} letters", "note": w} for w in str(v["message"]).split(" ") if w]},
    policies.SAME_TOPIC: lambda v: False,
    policies.SUMMARY: lambda v: " ".join(sorted({w for i in v["items"] for w in str(i).split(" ")})),
    policies.CATALOG: lambda v: f"{v['topic']}: {v['notes']}",
    policies.EXTRACT: lambda v: {"rows": [{"fact": str(v["content"]).split(" ")[0], "attributed_to": str(len(v["earlier"]))}]},
    policies.SAME_FACT: SameKey(lambda v: v["fact"]),
})


@registered("SELECT fact, min(pos) AS pos FROM (SELECT string_split(text, ' ')[1] AS fact, row_number() OVER (ORDER BY conv_id, turn) - 1 AS pos FROM conversations) GROUP BY fact")
def policy_facts(spark, sf_dir):
    """The fact policy over two batches: a fact that an earlier message gave is not kept again."""
    policy = policies.fact_memory()
    frame = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("observation_date")).repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    middle = frame.agg(F.percentile_approx("conv_id", 0.5)).first()[0]
    run = Dataflow(spark, policy.log, {**policy.views, "log": policy.log[["content", "_add_seq"]]}, POLICY_RULES)
    for part in (frame.filter(F.col("conv_id") <= middle), frame.filter(F.col("conv_id") > middle)):
        run.apply(part.select("role", "content", "observation_date"))
    first = run.view("log").groupBy(F.split("content", " ")[0].alias("fact")).agg(F.min("_add_seq").alias("pos"))
    return run.view("memories").join(first, "fact").select("fact", "pos")


@registered("SELECT source, count(n_chars) AS n, round(avg(n_chars), 4) AS mean, quantile_cont(n_chars, 0.5) AS median, round(quantile_cont(n_chars, 0.95), 4) AS p95, max(n_chars) AS max FROM documents GROUP BY source")
def metric_summary(spark, sf_dir):
    return rounded(metrics.summary(table(spark, sf_dir, "documents"), "n_chars", "source"), 4)


@registered("""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', '', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the', 'and')) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, a.w AS a, b.w AS b FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
c AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS same FROM p)
SELECT conv_id, turn, round(CASE WHEN same > 0 THEN 2.0 * same / (len(a) + len(b)) ELSE 0 END, 6) AS f1 FROM c""")
def metric_token_f1(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return t.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(metrics.token_f1(F.col("text"), F.col("gold")), 6).alias("f1"))


@registered("""SELECT count(*) FILTER (s AND t) AS tp, count(*) FILTER (s AND NOT t) AS fp, count(*) FILTER (NOT s AND t) AS fn, count(*) FILTER (NOT s AND NOT t) AS tn
FROM (SELECT n_chars > 1500 AS s, quality = 1 AS t FROM documents JOIN labels USING (doc_id))""")
def metric_confusion(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select((F.col("n_chars") > 1500).alias("s"), (F.col("quality") == 1).alias("t"))
    return metrics.confusion(d, "s", "t").select("tp", "fp", "fn", "tn")


@registered("""SELECT coalesce(event_type, '_total') AS event_type, count(*) AS calls, sum(user_id)::BIGINT AS user_id, round((sum(user_id) * 0.14::DECIMAL(12,6) / 1000000)::DOUBLE, 6) AS cost FROM events GROUP BY ROLLUP (event_type)""")
def metric_usage(spark, sf_dir):
    return rounded(metrics.usage(table(spark, sf_dir, "events"), "event_type", {"user_id": 0.14}), 6)


@registered("SELECT user_id, event_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0), 4) AS value_delta, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INTEGER AS occurrence FROM events")
def metric_deltas(spark, sf_dir):
    return rounded(metrics.previous_deltas(table(spark, sf_dir, "events"), "user_id", "event_id", ["value"]).select("user_id", "event_id", "value_delta", "occurrence"), 4)


@registered("""WITH s AS (SELECT n_chars AS threshold, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality <> 1) AS neg FROM documents JOIN labels USING (doc_id) GROUP BY 1),
r AS (SELECT threshold, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER () AS p FROM s WINDOW d AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
SELECT threshold, round(2.0 * tp / (tp + fp + p), 6) AS f1 FROM r ORDER BY 2.0 * tp / (tp + fp + p) DESC, threshold DESC LIMIT 1""")
def metric_calibrate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("n_chars", (F.col("quality") == 1).alias("t"))
    return rounded(metrics.calibrate(d, "n_chars", "t"), 6)


@registered("SELECT lower(trim(p_brand)) AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def metric_duplicate_names(spark, sf_dir):
    return metrics.duplicate_names(table(spark, sf_dir, "part"), "p_brand")


@registered("SELECT count_if(a > b)::BIGINT AS wins, count_if(a = b)::BIGINT AS ties, count_if(a < b)::BIGINT AS losses, round(avg(a - b), 6) AS mean_delta FROM (SELECT o_custkey AS k, sum(o_totalprice) AS a FROM orders GROUP BY 1) JOIN (SELECT c_custkey AS k, c_acctbal * 100 AS b FROM customer) USING (k)")
def metric_paired(spark, sf_dir):
    a = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("v"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") * 100).alias("v"))
    return rounded(metrics.paired(a, b, "k", "v"), 6)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import tidemark.workloads  # noqa: F401  registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    import tidemark.workloads  # noqa: F401

    return dict(SQL)


__all__ = ["flagship_revenue", "oracle_sql", "queries"]
