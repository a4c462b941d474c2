"""Composite views over a message log. Instructions are data: a model, or a rule for each, answers them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.search import BFS, BM25, RRF, CosineSimilarity, CrossEncoder, search
from tidemark.plans.expressions import col, least
from tidemark.plans.relation import Log, Relation, UserQuery, array_agg, min_, sem_agg

EXTRACT = "List the facts that the message {content} states, one row each, given the earlier messages {earlier}."
TOPIC = "List the topics that {message} touches, with what it says on each."
SAME_TOPIC = "Are {topic:left} and {topic:right} the same topic?"
SUMMARY = "Write down what is known."
CATALOG = "Describe the topic {topic} with the notes {notes} in one line."
SAME_FACT = "Does {fact:older} say what {fact:newer} says?"
ENTITIES = "List the persons, places and things in {content}."
SAME_ENTITY = "Are {name:left} and {name:right} one thing?"
RELATIONS = "List the facts between entities {names} that {content} states, as source, target, fact."
CONTRADICTS = "Does {fact:newer} end {fact:older}?"
COMMUNITY = "Do {name:left} and {name:right} belong together?"


@dataclass(frozen=True)
class Policy:
    log: Log
    views: dict[str, Relation]
    #: What is read for a query: by channel, a function of the flow and the query's text (and of an embedder).
    retrieval: Mapping[str, Callable[..., DataFrame]] = field(default_factory=dict)


@dataclass(frozen=True)
class Embedder:
    """The vectors of a text column, and that of a query."""

    column: Callable[[Column], Column]
    query: Callable[[str], tuple[float, ...]]


def ranked_by_model(relation: Relation, k: int, joined: Relation | None = None, on: str = "") -> Callable[..., DataFrame]:
    """The best ``k`` rows for the query by the model, with the rows of ``joined``."""
    best = relation.sem_topk(UserQuery(), k)
    best = best if joined is None else best.join(joined, [on])
    return lambda flow, query, *_: flow.query(best, query)


def topic_memory() -> Policy:
    """Topics with their notes, and a catalog of one line each."""
    log = Log(["message"])
    mentions = log.sem_flat_map(["message"], ["topic", "note"], TOPIC).select(["topic", "note"])
    topics = mentions.sem_groupby(["topic"], SAME_TOPIC).agg(min_("topic", "topic"), sem_agg(SUMMARY, "notes", ["note"])).select(["topic", "notes"])
    catalog = topics.sem_map(["topic", "notes"], ["line"], CATALOG).select(["topic", "line"])
    return Policy(log, {"topics": topics, "catalog": catalog}, {"topics": ranked_by_model(catalog, 5, topics, "topic")})


CANDIDATES, LEAST, LIMIT = 80, 0.1, 20


def _similar_facts(flow, query: str, embedder: Embedder) -> DataFrame:
    """By cosine: at least LEAST, the best CANDIDATES, of which LIMIT are read."""
    found = flow.view("memories").withColumn("vector", embedder.column(F.col("fact")))
    method = CosineSimilarity("vector", embedder.query(query), CANDIDATES, LEAST)
    return search(found, "fact", query, [method], RRF(), LIMIT).drop("vector")


def fact_memory(enhanced: bool = False) -> Policy:
    """Facts of messages in the light of the ten before, without those that an older one says already. They are read by
    similarity; ``enhanced``: as the model ranks them."""
    log = Log(["role", "content", "observation_date"], system_columns=True)
    framed = log.over((-10, -1)).array_agg(["role", "content"], "earlier")
    facts = framed.sem_flat_map(["content", "earlier"], ["fact", "attributed_to"], EXTRACT, ordinal_col="ordinal").select(["fact", "attributed_to", "_row_id", "_add_seq", "ordinal", "observation_date"])
    first = facts.drop_duplicates(["fact"])  # the others say what it says, and what says it came before the first comes before them
    newer, older = first.alias("newer"), first.alias("older")
    before = newer.join(older, newer.col("_add_seq") > older.col("_add_seq"))
    said = before.sem_filter(SAME_FACT).assign(_row_id=col("_row_id:newer"), ordinal=col("ordinal:newer")).select(["_row_id", "ordinal"]).drop_duplicates()
    fresh = first.join(said, ["_row_id", "ordinal"], "left_anti")
    memories = fresh.select(["fact", "attributed_to", "observation_date"])
    return Policy(log, {"memories": memories}, {"memories": ranked_by_model(memories, LIMIT) if enhanced else _similar_facts})


def _graph_facts(flow, query: str, embedder: Embedder) -> DataFrame:
    """Facts by keywords and by cosine, fused."""
    facts = flow.view("facts").withColumn("fact_id", F.concat_ws("|", F.to_json("source_id"), F.to_json("target_id"), "fact", "reference_time"))
    facts = facts.dropDuplicates(["fact_id"]).withColumn("vector", embedder.column(F.col("fact")))
    methods = [BM25(("fact",)), CosineSimilarity("vector", embedder.query(query))]
    return search(facts, "fact_id", query, methods, RRF(), LIMIT).drop("vector")


def _graph_entities(flow, query: str, embedder: Embedder, score: Callable | None = None) -> DataFrame:
    """Entities by keywords, by cosine, and by links from what the keywords find, reranked by a cross encoder."""
    key = lambda name: F.to_json(F.col(name))  # noqa: E731  ids are composite
    entities = flow.view("entities").withColumn("entity_key", key("entity_id")).withColumn("vector", embedder.column(F.col("name")))
    entities = entities.withColumn("text", F.concat_ws(" ", "name", "summary")).drop("mentions")
    named = search(entities, "entity_key", query, [BM25(("name",))], limit=LIMIT).select("record_id")
    edges = flow.view("facts").select(key("source_id").alias("source"), key("target_id").alias("target"))
    methods = [BM25(("name", "summary")), CosineSimilarity("vector", embedder.query(query)), BFS(named, edges, 3)]
    return search(entities, "entity_key", query, methods, CrossEncoder(score or _shared_words, "text"), LIMIT).drop("vector", "text")


def _shared_words(query: str, texts) -> list[float]:
    """A stand-in for a scoring model: the share of the query's words that a text has."""
    asked = set(query.lower().split())
    return [len(asked & set((t or "").lower().split())) / max(1, len(asked)) for t in texts]


def graph_memory(communities: bool = False) -> Policy:
    """Episodes, entities merged over messages, facts between them, and when a later fact ends an earlier one."""
    log = Log(["role", "speaker", "content", "reference_time"], system_columns=True)
    episodes = log.select(["_row_id", "_add_seq", "speaker", "content", "reference_time"])
    found = episodes.sem_flat_map(["content"], ["name", "summary"], ENTITIES, ordinal_col="ordinal")
    grouped = found.sem_groupby(["name"], SAME_ENTITY, membership="exclusive")
    entities = grouped.agg(min_("entity_id", columns=["_add_seq", "ordinal"]), min_("name", "name"), array_agg(["_row_id", "name"], "mentions"), sem_agg(SUMMARY, "summary", ["summary"]))
    bridge = entities.explode("mentions", "mention").unnest("mention", {"_row_id": "episode", "name": "said"}).select(["entity_id", "episode", "said"])
    named = bridge.assign(_row_id=col("episode")).select(["_row_id", "said"]).drop_duplicates().group_by(["_row_id"]).array_agg(["said"], "names")
    raw = episodes.join(named, ["_row_id"]).sem_flat_map(["names", "content"], ["source", "target", "fact"], RELATIONS, ordinal_col="ordinal")
    ends = []
    for side in ("source", "target"):
        ends.append(bridge.assign(**{"_row_id": col("episode"), side: col("said"), f"{side}_id": col("entity_id")}).select(["_row_id", side, f"{side}_id"]).drop_duplicates(["_row_id", side]))
    facts = raw.join(ends[0], ["_row_id", "source"]).join(ends[1], ["_row_id", "target"]).select(["_row_id", "_add_seq", "ordinal", "source_id", "target_id", "fact", "reference_time"])
    newer, older = facts.alias("newer"), facts.alias("older")
    same_ends = (newer.col("source_id") == older.col("source_id")) & (newer.col("target_id") == older.col("target_id"))
    pairs = newer.join(older, [same_ends, newer.col("_add_seq") > older.col("_add_seq")])
    ended = pairs.sem_filter(CONTRADICTS).assign(_row_id=col("_row_id:older"), ordinal=col("ordinal:older"), ended=col("reference_time:newer")).select(["_row_id", "ordinal", "ended"]).group_by(["_row_id", "ordinal"]).min("ended", "ended")
    dated = facts.join(ended, ["_row_id", "ordinal"], "left").assign(invalid_at=least(col("ended"), col("ended"))).select(["source_id", "target_id", "fact", "reference_time", "invalid_at"])
    views = {"episodes": episodes, "entities": entities, "facts": dated}
    if communities:
        ids = entities.select(["entity_id", "name", "summary"])
        views["communities"] = ids.sem_groupby(["name"], COMMUNITY).agg(min_("community_id", columns=["entity_id"]), array_agg(["entity_id", "name"], "members"), sem_agg(SUMMARY, "summary", ["summary"]))
    return Policy(log, views, {"facts": _graph_facts, "entities": _graph_entities})
