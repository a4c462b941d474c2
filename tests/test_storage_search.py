import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import metrics
from tidemark.operators import search as s
from tidemark.operators.components import components
from tidemark.sources import readers
from tidemark.sources.sinks import ConflictError, GraphSink, TableDescriptor, TableSink, VectorSink, physical_id, sql_type


def test_table_and_vector_sinks(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v long")
    table, points = TableSink(spark, str(tmp_path / "t"), ["k"]), VectorSink(spark, str(tmp_path / "p"), ["k"])
    for sink in (table, points):
        sink.write(rows(("a", 1), ("b", 2)), None, 1, "plan")
        sink.write(rows(("a", 1), ("b", 2)), None, 1, "plan")  # again: nothing happens
        sink.write(rows(("a", 9)), rows(("b", 2)), 2, "plan")
        with pytest.raises(ConflictError):
            sink.write(rows(("c", 1)), None, 4, "plan")
        with pytest.raises(ConflictError):
            sink.write(rows(("c", 1)), None, 3, "other")
    assert [tuple(r) for r in table.rows().collect()] == [("a", 9)]
    assert sorted(tuple(r) for r in points.points(1).collect()) == [("a", 1), ("b", 2)]
    assert [tuple(r) for r in points.points().collect()] == [("a", 9)]
    table.rebuild(rows(("z", 0)), 7, "other")
    assert table.manifest()["commit"] == 7


def test_graph_sink(spark, tmp_path):
    g = GraphSink(spark, str(tmp_path / "g"), "id", "x", "y")
    nodes = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    edges = lambda *x: spark.createDataFrame(list(x), "x long, y long")
    g.write_changes(nodes(1, 2, 3), edges((1, 2), (2, 3)), None, None, 1, "p")
    g.write_changes(nodes(), edges(), nodes(3), edges((2, 3)), 2, "p")
    assert sorted(r[0] for r in g.nodes().collect()) == [1, 2]
    assert [tuple(r) for r in g.edges().collect()] == [(1, 2)]


def test_ids_and_types(spark):
    got = spark.range(1).select(physical_id("ns", "node", [F.lit("a"), F.lit(1)])).first()[0]
    want = uuid.uuid5(uuid.uuid5(uuid.NAMESPACE_URL, "ns"), '["node","a",1]')
    assert got == str(want)
    assert sql_type("ARRAY<ROW<a STRING, b BIGINT>>").simpleString() == "array<struct<a:string,b:bigint>>"
    with pytest.raises(ValueError):
        TableDescriptor("x", spark.range(1).schema, ("id",), {"api_key": "1"})


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fox", [1.0, 0.0]), (2, "red red dog", [0.8, 0.6]), (3, "blue", [0.0, 1.0])], "id long, text string, v array<double>")
    assert [r["id"] for r in s.search(docs, "id", "red", [s.BM25(("text",))]).orderBy("rank").collect()] == [2, 1]
    near = s.CosineSimilarity("v", (1.0, 0.0))
    assert [r["id"] for r in s.search(docs, "id", "", [near]).orderBy("rank").collect()] == [1, 2]
    met = s.CosineSimilarity("v", (1.0, 0.0), min_score=0.0)
    assert s.search(docs, "id", "", [met]).count() == 3
    fused = s.search(docs, "id", "red", [s.BM25(("text",)), near], s.RRF()).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in fused] == [(1, 1.5), (2, 1.5)]
    assert s.search(docs, "id", "  ", [s.BM25(("text",))]).count() == 0
    with pytest.raises(ValueError):
        s.search(docs, "id", "red", [near, near])
    with pytest.raises(ValueError):
        s.search(docs.withColumn("rank", F.lit(1)), "id", "red", [near])


def test_components(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 2), (5, 6), (7, 7), (4, 3)], "a long, b long")
    assert sorted(tuple(r) for r in components(pairs, "a", "b").collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)]


def test_metrics(spark):
    t = spark.createDataFrame([("The cat sat", "a cat sat!"), ("x", "y"), (None, "y")], "a string, b string")
    got = t.select(metrics.set_exact_match(F.col("a"), F.col("b")), metrics.token_f1(F.col("a"), F.col("b")), metrics.contains(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 1), (0, 0.0, 0), (0, 0.0, 0)]
    chunks = metrics.chunks(spark.createDataFrame([("One two. Three four five. Six.",)], "t string"), "t", 3)
    assert [r["chunk"] for r in chunks.orderBy("chunk_no").collect()] == ["One two.", "Three four five.", "Six."]
    v = spark.range(100).select(F.col("id").cast("double").alias("v"))
    ci = metrics.bootstrap(v, "v", samples=200).first()
    assert ci["low"] < 49.5 < ci["high"]
    calls = spark.createDataFrame([("u1", "ok"), ("u2", "ok"), ("u1", "error")], "unit string, status string")
    durable = spark.createDataFrame([("u1",)], "unit string")
    assert sorted(r["path"] for r in metrics.split_recovery(calls, durable, "unit", "status").collect()) == ["final", "recovery", "recovery"]
    q = spark.createDataFrame([("q1", ["e1"]), ("q2", ["e1", "e2"]), ("q3", [])], "q string, ev array<string>")
    have = spark.createDataFrame([("e1",)], "e string")
    assert sorted(r["q"] for r in metrics.eligible(q, "q", "ev", have, "e").collect()) == ["q1", "q3"]
    assert sorted(r["anomaly"] for r in metrics.anomalies(spark.createDataFrame([(None,), (" ",), ("{",), ("{}",)], "o string"), "o").collect()) == ["empty", "missing", "unreadable"]


def test_bundles_and_readers(spark, tmp_path):
    src = tmp_path / "s.json"
    src.write_text('[{"sample_id": "s", "conversation": {"session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hi"}, {"speaker": "B", "dia_id": "D1:2", "text": " "}], "session_1_date_time": "1 May"}, "qa": [{"question": "q", "answer": "a", "evidence": ["D1:1"], "category": "1"}]}]')
    events, questions = readers.read_sessions(spark, str(src))
    assert [(r["event_id"], r["timestamp"]) for r in events.collect()] == [("D1:1", "1 May")]
    mark = readers.write_bundle(events, questions, str(tmp_path / "b"))
    e, q = readers.read_bundle(spark, str(tmp_path / "b"))
    assert (e.count(), q.count()) == (1, 1)
    assert mark == readers.write_bundle(e, q, str(tmp_path / "c"))
    (tmp_path / "b" / "manifest.json").write_text('{"events": {"rows": 9, "sum": "0"}, "questions": {"rows": 1, "sum": "0"}}')
    with pytest.raises(ValueError):
        readers.read_bundle(spark, str(tmp_path / "b"))
