"""Readers of conversation benchmarks, and bundles of normalised events and questions."""

from __future__ import annotations

import hashlib
import json

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "sample_id string, event_id string, speaker string, text string, session_id string, timestamp string, metadata string"
QUESTIONS = "question_id string, sample_id string, question string, gold_answer string, evidence_event_ids array<string>, category string, metadata string"

SAMPLE = "sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:string,evidence:array<string>,category:string>>"
TURNS = "array<struct<speaker:string,dia_id:string,text:string>>"


HAYSTACKS = """question_id string, question string, answer string, question_type string,
haystack_dates array<string>, haystack_session_ids array<string>,
haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>"""


def _events(df: DataFrame, *more: Column, **columns: Column | str) -> DataFrame:
    """Columns of EVENTS by name, those not given null, the metadata empty; rows without text are dropped."""
    given = {"metadata": F.lit("{}")} | columns
    out = [F.col(x) if isinstance(x, str) else x for x in (given.get(n.split()[0], F.lit(None)) for n in EVENTS.split(", "))]
    named = [c.cast("string").alias(n.split()[0]) for c, n in zip(out, EVENTS.split(", "), strict=True)]
    text = F.coalesce(F.col(columns["text"]) if isinstance(columns["text"], str) else columns["text"], F.lit(""))
    return df.filter(F.trim(text) != "").select(*named, *more)


def _questions(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Columns of QUESTIONS by name, those not given null, the evidence and the metadata empty."""
    none = F.array().cast("array<string>")
    given = {"metadata": F.lit("{}"), "evidence_event_ids": none} | columns
    out = []
    for name, kind in (n.split() for n in QUESTIONS.split(", ")):
        x = given.get(name, F.lit(None))
        x = (F.col(x) if isinstance(x, str) else x).cast(kind)
        out.append((F.coalesce(x, none) if name == "evidence_event_ids" else x).alias(name))
    return df.select(*out)


def read_sessions(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, questions) of samples whose conversation has ``session_n`` turn lists and ``session_n_date_time``.
    Turns without text are dropped. ``lines``: a sample in each line, which can be read in parts."""
    raw = spark.read.schema(SAMPLE).option("multiLine", not lines).json(path)
    parts = raw.select("sample_id", "conversation", F.explode("conversation").alias("session", "said")).filter(F.col("session").rlike(r"^session_\d+$"))
    date = F.col("conversation")[F.concat("session", F.lit("_date_time"))]
    turns = parts.select("sample_id", "session", date.alias("timestamp"), F.posexplode(F.from_json("said", TURNS)).alias("n", "turn"))
    own = F.coalesce("turn.dia_id", F.concat_ws(":", "session", "n"))
    events = _events(turns, sample_id="sample_id", event_id=own, speaker="turn.speaker", text="turn.text", session_id="session", timestamp="timestamp")
    asked = raw.select("sample_id", F.posexplode("qa").alias("n", "q"))
    named = {"question_id": F.concat_ws(":", "sample_id", "n"), "sample_id": "sample_id", "question": "q.question", "gold_answer": "q.answer"}
    return events, _questions(asked, **named, evidence_event_ids="q.evidence", category="q.category")


def read_haystacks(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(events, questions) of cases with ``haystack_sessions`` (lists of turns) and one question each."""
    raw = spark.read.schema(HAYSTACKS).option("multiLine", not lines).json(path)
    sessions = raw.select("question_id", "haystack_dates", "haystack_session_ids", F.posexplode("haystack_sessions").alias("s", "turns"))
    ids, dates = F.get("haystack_session_ids", F.col("s")), F.get("haystack_dates", F.col("s"))
    turns = sessions.select("question_id", ids.alias("session_id"), dates.alias("timestamp"), F.posexplode("turns").alias("n", "t"))
    named = {"sample_id": "question_id", "event_id": F.concat_ws(":", "session_id", "n"), "speaker": "t.role", "text": "t.content"}
    events = _events(turns, F.coalesce("t.has_answer", F.lit(False)).alias("__evidence"), **named, session_id="session_id", timestamp="timestamp")
    proof = events.filter("__evidence").groupBy("sample_id").agg(F.sort_array(F.collect_list("event_id")).alias("found"))
    cases = raw.join(proof, raw.question_id == proof.sample_id, "left").drop("sample_id")
    named = {"question_id": "question_id", "sample_id": "question_id", "question": "question", "gold_answer": "answer"}
    return events.drop("__evidence"), _questions(cases, **named, evidence_event_ids="found", category="question_type")


def read_contexts(spark: SparkSession, path: str, most_tokens: int = 512) -> tuple[DataFrame, DataFrame]:
    """(events, questions) of Parquet rows with a ``context``, ``questions`` and lists of ``answers``; the
    context is cut into chunks at sentence ends."""
    from tidemark.functions.metrics import chunks

    raw = spark.read.parquet(path)
    named = raw.withColumn("sample_id", F.sha2(F.coalesce("context", F.lit("")), 256))
    parts = chunks(named.select("sample_id", "context").dropDuplicates(["sample_id"]), "context", most_tokens)
    events = _events(parts, sample_id="sample_id", event_id=F.concat_ws(":", "sample_id", "chunk_no"), speaker=F.lit("context"), text="chunk")
    asked = named.select("sample_id", "answers", F.posexplode("questions").alias("n", "question"))
    answer = F.array_join(F.get("answers", F.col("n")), " | ")
    return events, _questions(asked, question_id=F.concat_ws(":", "sample_id", "n"), sample_id="sample_id", question="question", gold_answer=answer)


def write_bundle(events: DataFrame, questions: DataFrame, path: str) -> str:
    """JSON lines and a manifest with an order-free fingerprint; returns it."""
    marks = {}
    for name, df in (("events", events), ("questions", questions)):
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
        marks[name] = _mark(events.sparkSession.read.schema(df.schema).json(f"{path}/{name}"))
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    said = json.dumps(marks, sort_keys=True)
    with fs.open_output_stream(f"{at}/manifest.json") as f:
        f.write(said.encode())
    return hashlib.sha256(said.encode()).hexdigest()


def _mark(df: DataFrame) -> dict:
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("sum")).first()
    return {"rows": r["rows"], "sum": str(r["sum"])}


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Checked against the manifest."""
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        marks = json.loads(f.read())
    out = []
    for name, schema in (("events", EVENTS), ("questions", QUESTIONS)):
        df = spark.read.schema(schema).json(f"{path}/{name}")
        if _mark(df) != marks[name]:
            raise ValueError(f"{name} differ from the bundle's manifest")
        out.append(df)
    return out[0], out[1]
