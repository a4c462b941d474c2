"""Further registered queries: text models, choices from lists, sinks, snapshots, policies and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.functions.model import RuleModel, SameKey, TextModel
from tidemark.operators import search as s
from tidemark.plans import policies
from tidemark.plans.expressions import col
from tidemark.plans.relation import Log, Relation, avg, collect_list, count, sum_
from tidemark.queries import COS, ORDER, POLICY_RULES, RULES, log, over, registered, rounded, table
from tidemark.sources import readers
from tidemark.sources.sinks import GraphSink, TableDescriptor, TableSink, VectorSink
from tidemark.sources.store import shared_dir
from tidemark.streaming.engine import Dataflow

# A model that answers in plain text

TEXT = TextModel(RULES.rules)


@registered("SELECT doc_id FROM documents WHERE contains(' ' || text || ' ', ' the ')")
def sem_filter_text(spark, sf_dir):
    return over(spark, sf_dir, log("documents").sem_filter("Does {text} mention 'the'?")[["doc_id"]], "documents", model=TEXT)


@registered("SELECT doc_id, reverse(source) AS turned FROM documents")
def sem_map_text(spark, sf_dir):
    r = log("documents").sem_map(["source"], ["turned"], "Turn {source} round")[["doc_id", "turned"]]
    return over(spark, sf_dir, r, "documents", model=TEXT)


@registered("SELECT doc_id FROM documents WHERE lang NOT IN ('fr', 'es')")
def sem_filter_unsure(spark, sf_dir):
    """What is neither yes nor no keeps a row."""
    unsure = TextModel({"Is {lang} known?": lambda v: "Certainly not: no." if v["lang"] in ("fr", "es") else "I am not sure."})
    return over(spark, sf_dir, log("documents").sem_filter("Is {lang} known?")[["doc_id"]], "documents", model=unsure)


@registered("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE a.n_regionkey <> 1")
def sem_join_unsure(spark, sf_dir):
    """What is neither yes nor no joins nothing."""
    rule = "Is {n_nationkey:left} before {n_nationkey:right} in {n_regionkey:left}?"
    unsure = TextModel({rule: lambda v: "maybe" if v["n_regionkey:left"] == 1 else v["n_nationkey:left"] < v["n_nationkey:right"]})
    r = log("nation").sem_join(log("nation"), rule, on=["n_regionkey"]).assign(a=col("n_name:left"), b=col("n_name:right"))
    return over(spark, sf_dir, r[["a", "b"]], "nation", model=unsure)


@registered("SELECT n_regionkey, string_agg(DISTINCT w, ' ' ORDER BY w) AS names FROM (SELECT n_regionkey, unnest(string_split(n_name, ' ')) AS w FROM nation) GROUP BY n_regionkey")
def sem_agg_text(spark, sf_dir):
    return over(spark, sf_dir, log("nation").group_by(["n_regionkey"]).sem_agg("Join the names", "names", ["n_name"]), "nation", model=TEXT)


def _words_and_count(v) -> object:
    words = sorted({w for i in v["items"] for w in str(i).split(" ")})
    return {"names": " ".join(words), "n": str(len(words))} if v.get("final") else " ".join(words)


SEVERAL = "Join the names and count them"


@registered("SELECT n_regionkey, string_agg(DISTINCT w, ' ' ORDER BY w) AS names, count(DISTINCT w)::VARCHAR AS n FROM (SELECT n_regionkey, unnest(string_split(n_name, ' ')) AS w FROM nation) GROUP BY n_regionkey")
def sem_agg_outputs(spark, sf_dir):
    r = log("nation").group_by(["n_regionkey"]).sem_agg(SEVERAL, ["names", "n"], ["n_name"])
    return over(spark, sf_dir, r, "nation", model=TextModel({SEVERAL: _words_and_count}))


@registered("""SELECT n_nationkey, (CASE WHEN f IS NOT NULL THEN list_aggregate(list_sort(list_distinct(flatten(list_transform(f, lambda x: string_split(x, ' '))))), 'string_agg', ' ') END) AS names,
(CASE WHEN f IS NOT NULL THEN len(list_distinct(flatten(list_transform(f, lambda x: string_split(x, ' '))))) END)::VARCHAR AS n
FROM (SELECT n_nationkey, list(n_name) OVER (ORDER BY n_nationkey ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS f FROM nation)""")
def sem_over_outputs(spark, sf_dir):
    r = log("nation").over((-3, -1)).sem_agg(SEVERAL, ["names", "n"], ["n_name"])[["n_nationkey", "names", "n"]]
    return over(spark, sf_dir, r, "nation", model=RuleModel({SEVERAL: _words_and_count}))


# Choices from lists, groups within partitions, candidates from both sides

BEST = "Which of {c_acctbal:right} are the best of {n_name:left}?"


def _richest(method: str):
    """The two customers of each nation with the highest balance, of those above zero."""

    def choose(v):
        if "items" in v:
            rich = [i for i in v["items"] if i["c_acctbal"] > 0]
            return [i["id"] for i in sorted(rich, key=lambda i: (-i["c_acctbal"], i["c_custkey"]))][: v["k"]]
        if "a" in v:
            return (-v["a"]["c_acctbal"], v["a"]["c_custkey"]) < (-v["b"]["c_acctbal"], v["b"]["c_custkey"])
        return v["c_acctbal:right"] > 0

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        right = log("customer").assign(n_nationkey=col("c_nationkey"))[["n_nationkey", "c_custkey", "c_acctbal"]]
        r = log("nation")[["n_nationkey", "n_name"]].sem_join(right, BEST, on=["n_nationkey"], k=2)
        r = r.assign(n_name=col("n_name:left"), c_custkey=col("c_custkey:right"))[["n_name", "c_custkey"]]
        return over(spark, sf_dir, r, "nation", "customer", model=RuleModel({BEST: choose}), options={"topk_method": method})

    run.__name__ = f"sem_topk_join_{method}"
    return run


RICHEST_SQL = "SELECT n_name, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal > 0 QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 2"
for _method in ("listwise", "quick", "heap"):
    registered(RICHEST_SQL)(_richest(_method))


@registered("SELECT n_regionkey, min(n_name) AS n_name, count(*) AS n FROM nation GROUP BY n_regionkey, n_name[1]")
def sem_groupby_partition(spark, sf_dir):
    m = log("nation").sem_groupby(["n_name"], "Same first letter: {n_name:left}, {n_name:right}?", partition_by=["n_regionkey"]).members()
    df = over(spark, sf_dir, m.group_by(["__group"]).agg(collect_list("n_name", "names"), collect_list("n_regionkey", "regions")), "nation", model=RULES)
    return df.select(F.element_at("regions", 1).alias("n_regionkey"), F.array_min("names").alias("n_name"), F.size("names").cast("long").alias("n"))


@registered(f"""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b, {COS} AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
e AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY e ORDER BY c DESC, a, b) AS n FROM (SELECT a, b, c, a AS e FROM p UNION ALL SELECT a, b, c, b FROM p)) WHERE n <= 1),
u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS node, x AS root FROM u UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node),
g AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT root AS first, count(*) AS n FROM g GROUP BY root""")
def pair_symmetric(spark, sf_dir):
    """Groups of vectors that are the most like one of the two, within a label."""
    m = log("embeddings").sem_groupby(["vec_id", "embedding"], "never asked", partition_by=["label"]).members().group_by(["__group"]).agg(collect_list("vec_id", "ids"))
    df = over(spark, sf_dir, m, "embeddings", options={"groups": {"mode": "proxy-only", "column": "embedding", "k": 1, "per": "symmetric"}})
    return df.select(F.array_min("ids").alias("first"), F.size("ids").cast("long").alias("n"))


@registered("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name[1] = b.n_name[1]")
def pair_oracle_only(spark, sf_dir):
    """A profile that leaves all pairs to the model."""
    r = log("nation").sem_join(log("nation"), "Same first letter: {n_name:left}, {n_name:right}?", on=["n_regionkey"])
    r = r.assign(a=col("n_name:left"), b=col("n_name:right"))[["a", "b"]]
    return over(spark, sf_dir, r, "nation", model=RULES, options={"pairs": {"mode": "oracle-only", "left": "none", "right": "none", "k": 1}})


# Expressions and positions

@registered("SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY (event_type <> 'click')::INTEGER, event_id) AS ids FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id")
def array_cat_expr(spark, sf_dir):
    e = log("events")
    sides = [e.filter(col("event_type") == kind).group_by(["user_id"]).agg(collect_list("event_id", name)) for kind, name in (("click", "x"), ("purchase", "y"))]
    both = sides[0].join(sides[1], ["user_id"], "outer").assign(ids=col("x").array_cat(col("y")))[["user_id", "ids"]]
    return over(spark, sf_dir, both, "events").select("user_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@registered("""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY side, event_id) AS p FROM (SELECT event_id, 0 AS side FROM events UNION ALL SELECT event_id, 1 FROM events WHERE event_type = 'click'))
SELECT event_id, lag(event_id) OVER (ORDER BY p) AS before, least(p - 1, 3)::BIGINT AS n FROM e""")
def over_after_concat(spark, sf_dir):
    e = log("events")[["event_id", "event_type"]]
    df = over(spark, sf_dir, e.concat(e.filter(col("event_type") == "click")).over((-3, -1)).array_agg(["event_id"], "f"), "events")
    return df.select("event_id", F.try_element_at("f", F.lit(-1))["event_id"].alias("before"), F.size("f").cast("long").alias("n"))


# Incremental steps

def batches(spark: SparkSession, sf_dir: str, name: str, columns: list[str], parts: int = 3) -> list[DataFrame]:
    """The whole table in ranges of its first order column."""
    frame, key = table(spark, sf_dir, name), F.col(ORDER[name][0])
    bounds = frame.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)]).alias("q")).first()["q"] or []
    out = []
    for lo, hi in zip([None, *bounds], [*bounds, None], strict=True):
        part = frame if lo is None else frame.filter(key > lo)
        part = part if hi is None else part.filter(key <= hi)
        out.append(part.repartitionByRange(4, *ORDER[name]).sortWithinPartitions(*ORDER[name]).select(*columns))
    return out


@registered("""SELECT o_orderpriority, count(*) AS n, sum(o_totalprice::DECIMAL(20,2))::VARCHAR AS s FROM orders GROUP BY 1""")
def ivm_decimal(spark, sf_dir):
    """Sums of decimals are exact, and of the type that they have at once."""
    src = Log(["o_orderpriority", "price"], name="orders")
    r = src.group_by(["o_orderpriority"]).agg(count("n"), sum_("price", "s"))
    run = Dataflow(spark, src, {"v": r})
    for b in batches(spark, sf_dir, "orders", ["o_orderpriority", "o_totalprice"]):
        run.apply(b.select("o_orderpriority", F.col("o_totalprice").cast("decimal(20,2)").alias("price")))
    return run.view("v").select("o_orderpriority", "n", F.col("s").cast("string").alias("s"))


STATUS = "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY 1"


def _status() -> tuple[Log, Relation]:
    src = Log(["o_orderkey", "o_orderstatus", "o_totalprice"], name="orders")
    return src, src.group_by(["o_orderstatus"]).agg(count("n"), avg("o_totalprice", "a"))


def _place(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _run(spark, sf_dir, src: Log, views: dict, sinks: dict, name: str = "orders") -> Dataflow:
    run = Dataflow(spark, src, views, sinks=sinks)
    for b in batches(spark, sf_dir, name, list(src.declared)):
        run.apply(b)
    return run


@registered(STATUS)
def sink_table(spark, sf_dir):
    """A statement: a view into a table that a descriptor fixes."""
    src, r = _status()
    schema = spark.createDataFrame([], "o_orderstatus string, n long, a double").schema
    sink = TableSink(spark, _place(spark, "sink"), TableDescriptor("table", schema, ("o_orderstatus",)))
    _run(spark, sf_dir, src, {"v": r}, {"v": sink})
    return rounded(sink.rows(), 4)


@registered(STATUS)
def sink_vector(spark, sf_dir):
    """Points as the last commit shows them."""
    src, r = _status()
    sink = VectorSink(spark, _place(spark, "points"), ["o_orderstatus"])
    _run(spark, sf_dir, src, {"v": r}, {"v": sink})
    return rounded(sink.points(), 4)


@registered("SELECT 'node' AS kind, count(DISTINCT user_id) AS n FROM events UNION ALL SELECT 'edge', count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)")
def sink_graph(spark, sf_dir):
    src = Log(["user_id", "event_type"], name="events")
    views = {"users": src[["user_id"]].drop_duplicates(), "did": src.drop_duplicates()}
    sink = GraphSink(spark, _place(spark, "graph"), "user_id", "user_id", "event_type")
    _run(spark, sf_dir, src, views, {("users", "did"): sink}, "events")
    return sink.nodes().agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "n").unionByName(sink.edges().agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "n"))


@registered(f"SELECT * FROM ({STATUS}) UNION ALL ({STATUS})")
def sink_rebuild(spark, sf_dir):
    """A table and points made anew from a view."""
    src, r = _status()
    run = _run(spark, sf_dir, src, {"v": r}, {})
    rows, points = TableSink(spark, _place(spark, "sink"), ["o_orderstatus"]), VectorSink(spark, _place(spark, "points"), ["o_orderstatus"])
    for sink in (rows, points):
        sink.rebuild(run.view("v"), run.commit, run.fingerprint)
    return rounded(rows.rows().unionByName(points.points()), 4)


@registered(STATUS)
def snapshot_restore(spark, sf_dir):
    """Steps, a snapshot, and the last step by another flow that was restored from it."""
    src, r = _status()
    parts = batches(spark, sf_dir, "orders", list(src.declared))
    first = Dataflow(spark, src, {"v": r})
    for b in parts[:-1]:
        first.apply(b)
    again = Dataflow(spark, src, {"v": r})
    again.restore(first.snapshot())
    again.apply(parts[-1])
    return rounded(again.view("v"), 4)


@registered("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS letters FROM conversations GROUP BY role")
def memory_refresh(spark, sf_dir):
    """Rows added one by one refresh the views by the hundred, the rest by a flush; here by batches of a stream."""
    src = Log(["role", "text"], name="conversations")
    place = _place(spark, "stream")
    table(spark, sf_dir, "conversations").select("role", "text").repartition(3).write.parquet(f"{place}/in")
    run = Dataflow(spark, src, {"v": src})
    stream = spark.readStream.schema("role string, text string").option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    run.attach(stream, f"{place}/checkpoint").awaitTermination()
    return run.view("v").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("letters"))


# Readers

@registered("SELECT conv_id::VARCHAR AS sample_id, count(*) AS n FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def read_session_turns(spark, sf_dir):
    """Conversations written as benchmark samples, read again."""
    turn = F.struct(F.col("role").alias("speaker"), F.concat_ws(":", "conv_id", "turn").alias("dia_id"), "text", "turn")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("t")))).alias("l"))
    sample = F.struct(F.col("l.t").alias("session_1"), F.lit("May 1").alias("session_1_date_time"))
    place = _place(spark, "samples")
    turns.select(F.col("conv_id").cast("string").alias("sample_id"), sample.alias("conversation"), F.array(F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer"))).alias("qa")).write.json(place)
    events, _ = readers.read_sessions(spark, place, lines=True)
    return events.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT role AS speaker, count(*) AS n FROM conversations GROUP BY role")
def bundle_round_trip(spark, sf_dir):
    none = F.lit(None).cast("string")
    t = table(spark, sf_dir, "conversations")
    events = t.select(F.col("conv_id").cast("string").alias("sample_id"), F.concat_ws(":", "conv_id", "turn").alias("event_id"), F.col("role").alias("speaker"), "text", none.alias("session_id"), none.alias("timestamp"), none.alias("metadata"))
    asked = spark.createDataFrame([("q", "s", "who?", "a", ["1:0"], "1", None)], readers.QUESTIONS)
    place = _place(spark, "bundle")
    readers.write_bundle(events, asked, place)
    return readers.read_bundle(spark, place)[0].groupBy("speaker").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT count(*) AS n, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')))::BIGINT AS words FROM documents")
def read_context_chunks(spark, sf_dir):
    """Contexts in chunks hold all their words."""
    place = _place(spark, "contexts")
    table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(" "), "text").alias("context"), F.array(F.lit("q")).alias("questions"), F.array(F.array(F.lit("a"))).alias("answers")).write.parquet(place)
    events, questions = readers.read_contexts(spark, place, 64)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    counted = events.agg(F.sum(words).alias("words"))
    return questions.agg(F.count(F.lit(1)).alias("n")).crossJoin(counted).select("n", (F.col("words") - F.col("n")).cast("long").alias("words"))  # a row each


# Search

BM25_TERMS = """WITH d AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS w FROM documents),
l AS (SELECT doc_id, count(*) AS dl FROM d GROUP BY doc_id), f AS (SELECT count(*) AS n, (SELECT sum(dl) FROM l) / count(*) AS a FROM documents),
t AS (SELECT doc_id, w, count(*) AS tf, count(*) OVER (PARTITION BY w) AS df FROM d WHERE w IN ('the', 'with') GROUP BY doc_id, w)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM t JOIN l USING (doc_id), f GROUP BY doc_id"""


@registered(BM25_TERMS)
def search_postings(spark, sf_dir):
    """The stored index gives the scores that a scan of the texts gives."""
    index = s.Postings.build(table(spark, sf_dir, "documents"), "doc_id", ["text"])
    return index.search("the with").select(F.col("record_id").alias("doc_id"), F.round("score", 6).alias("score"))


# Policies

def _messages(spark, sf_dir) -> list[DataFrame]:
    """All conversations in their order, in two batches."""
    frame = table(spark, sf_dir, "conversations")
    middle = frame.agg(F.percentile_approx("conv_id", 0.5)).first()[0]
    return [frame.filter(x).repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn") for x in (F.col("conv_id") <= middle, F.col("conv_id") > middle)]


WORDS = "SELECT conv_id, turn, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS w FROM conversations"


@registered(f"SELECT length(w)::VARCHAR || ' letters' AS topic, string_agg(DISTINCT w, ' ' ORDER BY w) AS notes FROM ({WORDS}) GROUP BY length(w)")
def policy_topics(spark, sf_dir):
    """The topic policy's view: what each topic's notes say, folded."""
    policy = policies.topic_memory()
    run = Dataflow(spark, policy.log, {"topics": policy.views["topics"]}, POLICY_RULES, {"max_chars": 10_000_000})
    for b in _messages(spark, sf_dir):
        run.apply(b.select(F.col("text").alias("message")))
    return run.view("topics")


@registered(f"SELECT topic, left(notes, 40) AS notes FROM (SELECT length(w)::VARCHAR || ' letters' AS topic, string_agg(DISTINCT w, ' ' ORDER BY w) AS notes FROM ({WORDS}) GROUP BY length(w)) ORDER BY topic LIMIT 5")
def policy_topics_read(spark, sf_dir):
    """Its retrieval: the five best lines of the catalog, with the topics' notes."""
    policy = policies.topic_memory()
    rules = RuleModel(POLICY_RULES.rules | {"which": lambda v: [i["id"] for i in sorted(v["items"], key=lambda i: i["topic"])][: v["k"]], policies.CATALOG: lambda v: v["topic"]})
    run = Dataflow(spark, policy.log, policy.views, rules, {"max_chars": 10_000_000})
    for b in _messages(spark, sf_dir):
        run.apply(b.select(F.col("text").alias("message")))
    return policy.retrieval["topics"](run, "which").select("topic", F.left("notes", F.lit(40)).alias("notes"))


#: Vectors that SQL can make, too: the length of a text and one.
LENGTHS = policies.Embedder(lambda text: F.array(F.length(text).cast("double"), F.lit(1.0)), lambda text: (float(len(text)), 1.0))


def _facts(spark, sf_dir, policy) -> Dataflow:
    """Facts are the first words of messages."""
    run = Dataflow(spark, policy.log, policy.views, RuleModel(POLICY_RULES.rules | {"which": lambda v: [i["id"] for i in sorted(v["items"], key=lambda i: i["fact"])][: v["k"]]}))
    for b in _messages(spark, sf_dir):
        run.apply(b.select("role", F.col("text").alias("content"), F.lit(None).cast("string").alias("observation_date")))
    return run


FACTS = "SELECT DISTINCT string_split(text, ' ')[1] AS fact FROM conversations"


@registered(f"""WITH f AS ({FACTS}), c AS (SELECT fact, (length(fact) * 3 + 1) / (sqrt(length(fact) * length(fact) + 1) * sqrt(10.0)) AS score FROM f),
r AS (SELECT fact, row_number() OVER (ORDER BY score DESC, fact) AS r FROM c WHERE score >= 0.1)
SELECT fact, r::INTEGER AS rank FROM r WHERE r <= 20""")
def policy_facts_read(spark, sf_dir):
    """The fact policy's retrieval by similarity."""
    policy = policies.fact_memory()
    return policy.retrieval["memories"](_facts(spark, sf_dir, policy), "who", LENGTHS).select("fact", "rank")


@registered(f"SELECT fact FROM ({FACTS}) ORDER BY fact LIMIT 20")
def policy_facts_ranked(spark, sf_dir):
    """The enhanced policy's retrieval: as the model ranks all facts."""
    policy = policies.fact_memory(enhanced=True)
    return policy.retrieval["memories"](_facts(spark, sf_dir, policy), "which").select("fact")


def _two_words(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in str(text).split(" ")[:2] if w))


GRAPH_RULES = RuleModel({
    policies.ENTITIES: lambda v: {"rows": [{"name": w, "summary": w} for w in _two_words(v["content"])]},
    policies.SAME_ENTITY: SameKey(lambda v: v["name"].lower()),
    policies.SUMMARY: lambda v: min(str(i) for i in v["items"]),
    policies.RELATIONS: lambda v: {"rows": [{"source": w[0], "target": w[1], "fact": " ".join(w)}] if len(w := _two_words(v["content"])) == 2 else []},
    policies.CONTRADICTS: lambda v: True,
    policies.COMMUNITY: SameKey(lambda v: v["name"][0].lower()),
})


def _graph(spark, sf_dir, communities: bool = False, *views: str) -> tuple[policies.Policy, Dataflow]:
    policy = policies.graph_memory(communities)
    kept = {k: v for k, v in policy.views.items() if not views or k in views}
    run = Dataflow(spark, policy.log, kept, GRAPH_RULES)
    place = F.lpad((F.col("conv_id") * 1000 + F.col("turn")).cast("string"), 12, "0")
    for b in _messages(spark, sf_dir):
        run.apply(b.select("role", F.col("role").alias("speaker"), F.col("text").alias("content"), place.alias("reference_time")))
    return policy, run


FIRST_TWO = """SELECT *, list_filter(list_slice(string_split(text, ' '), 1, 2), lambda x: x <> '') AS w,
lpad((conv_id * 1000 + turn)::VARCHAR, 12, '0') AS stamp, row_number() OVER (ORDER BY conv_id, turn) AS seq FROM conversations"""


@registered(f"SELECT min(name) AS name, count(*) AS mentions FROM (SELECT DISTINCT seq, unnest(w) AS name FROM ({FIRST_TWO})) GROUP BY lower(name)")
def policy_graph_entities(spark, sf_dir):
    """Entities that differ in case only are one."""
    _, run = _graph(spark, sf_dir, False, "entities")
    return run.view("entities").select("name", F.size("mentions").cast("long").alias("mentions"))


@registered(f"""WITH f AS (SELECT seq, stamp, w[1] AS a, w[2] AS b FROM ({FIRST_TWO}) WHERE len(w) = 2 AND w[1] <> w[2])
SELECT a || ' ' || b AS fact, stamp AS reference_time, (SELECT min(g.stamp) FROM f g WHERE lower(g.a) = lower(f.a) AND lower(g.b) = lower(f.b) AND g.seq > f.seq) AS invalid_at FROM f""")
def policy_graph_facts(spark, sf_dir):
    """A fact ends when a later one of the same entities says so."""
    _, run = _graph(spark, sf_dir, False, "facts")
    return run.view("facts").select("fact", "reference_time", "invalid_at")


@registered(f"SELECT lower(min(name)[1]) AS letter, count(*) AS members FROM (SELECT min(name) AS name FROM (SELECT DISTINCT seq, unnest(w) AS name FROM ({FIRST_TWO})) GROUP BY lower(name)) GROUP BY lower(name[1])")
def policy_graph_communities(spark, sf_dir):
    _, run = _graph(spark, sf_dir, True, "communities")
    return run.view("communities").select(F.lower(F.substring(F.element_at("members", 1)["name"], 1, 1)).alias("letter"), F.size("members").cast("long").alias("members"))


@registered()
def policy_graph_read(spark, sf_dir):
    """Both channels of the graph policy: fused facts, and reranked entities. Tested against a plain version."""
    policy, run = _graph(spark, sf_dir)
    facts = policy.retrieval["facts"](run, "the", LENGTHS).select(F.lit("fact").alias("kind"), F.col("fact").alias("text"), "rank")
    return facts.unionByName(policy.retrieval["entities"](run, "the", LENGTHS).select(F.lit("entity").alias("kind"), F.col("name").alias("text"), "rank"))


# Evaluation

PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
TURNS = f"SELECT a.conv_id, a.turn, {PLAIN.format('a.text')} AS x, {PLAIN.format('b.text')} AS y, {PLAIN.format('a.role')} AS z FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"


@registered(f"SELECT conv_id, turn, (x = y OR x = z)::INTEGER AS em, (contains(x, y) OR contains(x, z))::INTEGER AS sub FROM ({TURNS})")
def metric_exact_match(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    golds = F.array("gold", "role")
    return t.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", metrics.exact_match(F.col("text"), golds).alias("em"), metrics.substring_match(F.col("text"), golds).alias("sub"))


@registered("SELECT DISTINCT p_brand AS name, arg_min(t, (d, t)) AS nearest, min(d)::INTEGER AS distance FROM (SELECT p_brand, n_name AS t, levenshtein(lower(n_name), lower(p_brand)) AS d FROM (SELECT DISTINCT p_brand FROM part), nation) GROUP BY p_brand")
def metric_nearest_name(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    return metrics.nearest_name(names, "name", table(spark, sf_dir, "nation"), "n_name")


@registered("""WITH q AS (SELECT user_id, event_type, count(*) AS runs, avg(value) AS score FROM events GROUP BY ALL)
SELECT coalesce(event_type, '_all') AS category, count(*) AS questions, round(avg(score), 4) AS score FROM q GROUP BY ROLLUP (event_type)""")
def metric_question_summary(spark, sf_dir):
    graded = table(spark, sf_dir, "events").select(F.col("user_id").alias("question"), F.col("event_type").alias("category"), F.col("value").alias("score"))
    return rounded(metrics.question_summary(graded, "question", "category", ["score"])[1], 4)


@registered("""SELECT c.c_custkey AS question, c.c_acctbal AS grade, coalesce(sum((o_orderstatus = 'F')::INTEGER), 0)::BIGINT AS build_calls, coalesce(sum((o_orderstatus = 'O')::INTEGER), 0)::BIGINT AS query_calls
FROM customer c LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def metric_question_facts(spark, sf_dir):
    questions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question"))
    grades = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question"), F.col("c_acctbal").alias("grade"))
    answers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("question"), F.col("c_name").alias("answer"))
    phase = F.when(F.col("o_orderstatus") == "F", "build").when(F.col("o_orderstatus") == "O", "query")
    calls = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question"), phase.alias("phase"), F.lit(1).alias("tokens"))
    return metrics.question_facts(questions, answers, grades, calls, "question", ["build", "query"]).select("question", "grade", "build_calls", "query_calls")


@registered("""WITH q AS (SELECT o_custkey AS question, o_orderkey AS event FROM orders)
SELECT question, event, (SELECT count(*) FROM lineitem WHERE l_orderkey = event) AS ingested, (SELECT count(*) FROM lineitem WHERE l_orderkey = event AND l_returnflag = 'R') AS read FROM q""")
def metric_evidence_trace(spark, sf_dir):
    questions = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("question")).agg(F.collect_list("o_orderkey").alias("evidence"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), "l_returnflag")
    return metrics.evidence_trace(questions, "question", "evidence", {"ingested": lines.select("event"), "read": lines.filter("l_returnflag = 'R'").select("event")}, "event")


@registered("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def metric_latest_state(spark, sf_dir):
    return metrics.latest_states(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@registered("SELECT event_type AS phase, CASE WHEN value > 50 THEN 'x' ELSE 'y' END AS operator, count(DISTINCT event_id) AS calls, count(DISTINCT user_id) AS batches, round(count(event_id) / count(DISTINCT user_id), 6) AS items_per_batch FROM events GROUP BY 1, 2")
def metric_operator_usage(spark, sf_dir):
    operator = F.when(F.col("value") > 50, "x").otherwise("y")
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), operator.alias("operator"), F.col("event_id").alias("call_id"), F.col("user_id").alias("batch_id"), F.lit(0).alias("retries"))
    return rounded(metrics.operator_usage(calls).select("phase", "operator", "calls", "batches", "items_per_batch"), 6)


@registered("SELECT event_type AS phase, sum(least(user_id, event_id))::BIGINT AS hit, sum(event_id - least(user_id, event_id))::BIGINT AS miss, sum(CASE WHEN value > 50 THEN NULL ELSE user_id END)::BIGINT AS output FROM events GROUP BY 1")
def metric_normal_calls(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.col("event_id").alias("prompt"), F.col("user_id").alias("cached"), F.when(~(F.col("value") > 50), F.col("user_id")).alias("done"))
    return metrics.normal_calls(calls, "prompt", "cached", "done").groupBy("phase").agg(*(F.sum(x).alias(x) for x in ("hit", "miss", "output")))


@registered("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def metric_eligible(spark, sf_dir):
    """Questions whose evidence is all there."""
    evidence = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_list("o_orderkey").alias("need"))
    questions = table(spark, sf_dir, "customer").select("c_custkey").join(evidence, "c_custkey", "left").select("c_custkey", F.coalesce("need", F.array().cast("array<bigint>")).alias("need"))
    there = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select("o_orderkey")
    return metrics.eligible(questions, "c_custkey", "need", there, "o_orderkey").select("c_custkey")


@registered()
def metric_bootstrap(spark, sf_dir):
    """A 95 % interval of a mean; drawn, so its SQL has no counterpart. Tested against the normal approximation."""
    return metrics.bootstrap(table(spark, sf_dir, "orders"), "o_totalprice")


@registered()
def metric_category_scores(spark, sf_dir):
    """Mean score by category with stems; tested against a plain version."""
    t = table(spark, sf_dir, "conversations")
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    category = (F.col("turn") % 5 + 1).cast("int")
    return t.join(nxt, ["conv_id", "turn"]).groupBy(category.alias("category")).agg(F.round(F.avg(metrics.category_score(F.col("text"), F.col("gold"), category)), 6).alias("score"))

