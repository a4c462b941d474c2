"""Incremental maintenance: a shared plan over all views, fed with appends.

Each distinct node is evaluated once a step (plans are hash-consed). Stored in the shared folder are the log, the
views, and what a later step reads: inputs of stateful operators, and frames that are compared with their
former selves. A step computes for each node what was inserted and retracted:

* row-local operators work on the change alone, ``concat`` passes it on;
* inner joins join the change of one side with the state of the other;
* count, sum and avg keep signed partial sums by key, one table a step, and finish touched keys only;
* semantic row operators ask about inserted rows only, semantic inner joins about new pairs only;
* windows read the tail that new rows can reach;
* first rows of what only grows (``drop_duplicates``) are those of new keys;
* everything else is computed anew from stored inputs and compared as a bag;
* where nothing reaches a node, nothing runs.

A step that fails leaves states and sinks as they were: sinks stage their tables first, are published together, and
those published are taken back if a later one fails. States are swapped at the end, and tables that no
state of the last two steps and no snapshot names are deleted.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import partial

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import tidemark.operators.semantic  # noqa: F401  registers its operators
import tidemark.operators.windows  # noqa: F401
from tidemark.functions.model import keyed
from tidemark.operators.relational import OCC, Context, apply_op, c
from tidemark.plans.relation import SYSTEM_COLUMNS, Log, Node, Relation, walk
from tidemark.plans.rewrites import keyed_joins
from tidemark.sources.store import State, delete, recorded, shared_dir, store, stored

ROW_LOCAL = ("select", "filter", "assign", "explode", "unnest", "flatten")
SEMANTIC_ROW = ("sem_filter", "sem_map", "sem_flat_map", "sem_fold", "sem_key")


def kind_of(node: Node) -> str:
    if node.op in ROW_LOCAL:
        return "row_local"
    if node.op in SEMANTIC_ROW:
        return "semantic_row"
    if node.op in ("concat", "concat_by_name"):
        return "bag"
    if node.op == "predicate_join" or (node.op == "join" and node.params["how"] == "inner"):
        return "relational_state"
    if node.op == "sem_join" and node.params["how"] == "inner" and node.params["k"] is None:
        return "semantic_binary_state"
    if node.op == "aggregate" and all(s.kind in ("count", "sum", "avg") for s in node.params["specs"]):
        return "algebraic_state"
    if node.op == "aggregate" and node.params["keys"] and "__group" not in node.params["keys"] and any(s.kind == "sem_agg" for s in node.params["specs"]):
        return "semantic_state"
    if node.op == "drop_duplicates" and in_order(node.inputs[0]):
        return "first_rows"
    return {"log": "source", "process_window": "process_window", "over": "over_window"}.get(node.op, "deterministic")


def in_order(node: Node) -> bool:
    """Whether rows of later steps come after those of earlier ones, none of which ever goes."""
    return kind_of(node) in ("source", "row_local", "semantic_row", "over_window", "first_rows") and all(map(in_order, node.inputs))


#: Kinds whose steps read stored inputs, and kinds that are compared with what they were.
READS_INPUTS = ("relational_state", "semantic_binary_state", "over_window", "process_window", "deterministic", "semantic_state")
COMPARED = ("deterministic", "algebraic_state", "semantic_state", "process_window")
MOST_PARTS = 16  # of a state; more become one


@dataclass
class Change:
    inserted: DataFrame
    retracted: DataFrame | None = None
    empty: bool = False  # known to hold nothing


def bag_difference(new: DataFrame, old: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a bag gained and lost, copies counted."""
    return new.exceptAll(old), old.exceptAll(new)


def _among(df: DataFrame, keys: tuple[str, ...], touched: DataFrame | None, how: str = "left_semi") -> DataFrame:
    """Rows whose keys are in ``touched`` (``__k0``, ...; nulls are equal), or (left_anti) are not; all rows without it."""
    if touched is None:
        return df
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & df[f"`{k}`"].eqNullSafe(touched[f"__k{i}"])
    return df.join(touched, same, how)


class Dataflow:
    """``apply`` appends a batch and brings all views up to date; ``view`` reads one."""

    def __init__(self, spark: SparkSession, source: Log, views: Mapping[str, Relation], model=None, options: dict | None = None, sinks: Mapping[str, object] | None = None):
        self.spark, self.source, self.model, self.options = spark, source, model, options or {}
        self.views = {name: self._rewritten(r) for name, r in views.items()}
        self.nodes: list[Node] = []
        for name, root in self.views.items():
            for node in walk(root):
                if node.op == "log" and node != source.node:
                    raise ValueError(f"view {name} reads another log")
                if node.op == "sem_topk":
                    raise ValueError("sem_topk answers queries; it maintains no view")
                if node not in self.nodes:
                    self.nodes.append(node)
        if source.node not in self.nodes:
            self.nodes.insert(0, source.node)
        self.sinks = dict(sinks or {})
        for names, sink in self.sinks.items():
            self._bound(names, sink)
        self.rows = self.commit = 0
        self.state: dict[str, State] = {}
        self.hidden: dict[str, State] = {}
        self.replies: dict[str, State] = {}
        self.schemas: dict[str, T.StructType] = {}
        self.batches: dict[str, int] = {}  # last batch of each stream
        self.pinned: set[str] = set()  # tables that snapshots name
        self.dead: list[tuple[int, str]] = []
        self.kept = self._kept()

    def _rewritten(self, relation: Relation) -> Node:
        return keyed_joins(relation.node, partial(keyed, self.model))

    def _bound(self, names, sink) -> None:
        """A sink with a descriptor takes a view with exactly its columns."""
        for name in (names,) if isinstance(names, str) else names:
            if name not in self.views:
                raise ValueError(f"no view {name}")
        descriptor = getattr(sink, "descriptor", None)
        if descriptor is not None and tuple(descriptor.schema.fieldNames()) != self.views[names].columns:
            raise ValueError(f"view {names} has columns {self.views[names].columns}, the sink {tuple(descriptor.schema.fieldNames())}")

    def _kept(self) -> set[str]:
        """Nodes whose frames are stored."""
        retracting: set[str] = set()
        kept = {self.source.node.fingerprint, *(n.fingerprint for n in self.views.values())}
        for node in self.nodes:  # inputs first
            kind, from_below = kind_of(node), any(n.fingerprint in retracting for n in node.inputs)
            if kind in ("deterministic", "algebraic_state", "semantic_state") or from_below:
                retracting.add(node.fingerprint)
            if kind in (*COMPARED, "first_rows") or (from_below and kind not in ("row_local", "bag")):
                kept.add(node.fingerprint)
            if kind in READS_INPUTS:
                kept |= {n.fingerprint for n in node.inputs}
        return kept

    @property
    def fingerprint(self) -> str:
        """Of the plan: a snapshot is only restored into the same one."""
        said = json.dumps({"views": {k: n.fingerprint for k, n in self.views.items()}, "nodes": [n.fingerprint for n in self.nodes]}, sort_keys=True)
        return hashlib.sha256(said.encode()).hexdigest()

    def _context(self, bound: dict[str, DataFrame] | None = None) -> Context:
        return Context(self.spark, bound or {}, self.model, options=self.options)

    # Ingest
    def _arrived(self, batch: DataFrame) -> tuple[DataFrame, int]:
        """The batch with dense positions in order of arrival. It is stored once as it comes, so that partition counts
        and positions are of the same rows."""
        if tuple(batch.columns) != self.source.declared:
            raise ValueError(f"the batch's columns must be {self.source.declared}")
        clean = batch.select(*(F.when(~F.isnan(c(f.name)), c(f.name)).alias(f.name) if isinstance(f.dataType, T.FloatType | T.DoubleType) else c(f.name) for f in batch.schema.fields))
        own = [F.uuid().alias(SYSTEM_COLUMNS[0]), F.current_timestamp().alias(SYSTEM_COLUMNS[1])] if self.source.system_columns else []
        marked = stored(clean.select("*", *own, F.monotonically_increasing_id().alias("__mid")), "batch")
        counts = marked.groupBy(F.shiftright("__mid", 33).alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()  # a row for each partition
        offsets, at = [], self.rows
        for r in counts:
            offsets += [r["__part"], at]
            at += r["n"]
        starts = F.create_map(*(F.lit(x).cast("long") for x in offsets or (0, 0)))
        seq = (starts[F.shiftright("__mid", 33)] + F.col("__mid").bitwiseAND((1 << 33) - 1)).cast("long")
        system = [*map(c, SYSTEM_COLUMNS[:2]), seq.alias(SYSTEM_COLUMNS[2])] if self.source.system_columns else []
        return marked.select(*map(c, batch.columns), *system, F.array(seq).alias(OCC)), at - self.rows

    # Steps
    def apply(self, batch: DataFrame) -> None:
        with recorded() as made:
            self._apply(batch, made)

    def _apply(self, batch: DataFrame, made: list[str]) -> None:
        states, hidden, changes = dict(self.state), dict(self.hidden), {}
        for node in self.nodes:
            key = node.fingerprint
            below = [changes[n.fingerprint] for n in node.inputs]
            if node.op == "log":
                frame, n = self._arrived(batch)
                change = Change(frame, None, not n)
            elif all(g.empty for g in below) and key in self.schemas and (key not in self.kept or key in states):
                change = Change(self.spark.createDataFrame([], self.schemas[key]), None, True)
            else:
                change = self._step(node, changes, states, hidden)
                change.empty = change.empty or (key not in self.kept and all(g.empty for g in below))
            self.schemas.setdefault(key, change.inserted.schema)
            changes[key] = self._keep(node, change, states) if key in self.kept else change
        self._publish(changes)
        before = {p for group in (self.state, self.hidden) for s in group.values() for p in s.parts}
        after = {p for group in (states, hidden, self.replies) for s in group.values() for p in s.parts}
        self.state, self.hidden = states, hidden
        self.rows, self.commit = self.rows + n, self.commit + 1
        self.dead += [(self.commit, p) for p in (before | set(made)) - after]
        gone = {p for at, p in self.dead if at < self.commit - 1} - self.pinned
        delete(self.spark, gone)
        self.dead = [x for x in self.dead if x[1] not in gone]

    def _publish(self, changes: dict[str, Change]) -> None:
        """All sinks or none."""
        staged = []
        for names, sink in self.sinks.items():
            parts = []
            for name in (names,) if isinstance(names, str) else names:
                node, change = self.views[name], changes[self.views[name].fingerprint]
                gone = change.retracted.select(*map(c, node.columns)) if change.retracted is not None else None
                parts.append((change.inserted.select(*map(c, node.columns)), gone))
            inserted, retracted = (parts[0] if isinstance(names, str) else ([p[i] for p in parts] for i in (0, 1)))
            staged.append(sink.stage(inserted, retracted, self.commit + 1, self.fingerprint))
        done = []
        try:
            for s in staged:
                if s is not None:
                    s.publish()
                    done.append(s)
        except BaseException:
            for s in reversed(done):
                s.undo()
            raise

    def _keep(self, node: Node, change: Change, states: dict[str, State]) -> Change:
        """Store a node's new state; an insert-only change is appended, an empty one leaves it."""
        old = states.get(node.fingerprint)
        if change.empty and old is not None:
            return change
        path, inserted = store(change.inserted, "inserted")
        none = change.empty or not inserted.take(1)
        if change.retracted is None:
            state = old if old and none else (old or State(inserted.schema)).plus(path)
            if len(state.parts) > MOST_PARTS:
                path, whole = store(state.frame(self.spark).coalesce(8), "compacted")
                state = State(whole.schema, [path])
            states[node.fingerprint] = state
            return Change(inserted, None, none)
        retracted = stored(change.retracted, "retracted")
        lost = bool(retracted.take(1))
        if none and not lost:
            return Change(inserted, None, True)
        if not lost:
            states[node.fingerprint] = (old or State(inserted.schema)).plus(path)
            return Change(inserted)
        before = old.frame(self.spark) if old else inserted.limit(0)
        kept = before.join(retracted.select(OCC).distinct(), OCC, "left_anti").select(*inserted.columns)
        path, whole = store(kept.unionByName(inserted), "state")
        states[node.fingerprint] = State(whole.schema, [path])
        return Change(inserted, retracted)

    def _step(self, node: Node, changes: dict[str, Change], states: dict[str, State], hidden: dict[str, State]) -> Change:
        kind = kind_of(node)
        given = [changes[n.fingerprint] for n in node.inputs]
        gone = [g for g in given if g.retracted is not None]
        old = states.get(node.fingerprint)
        ctx = self._context()
        if kind in ("row_local", "bag") or (kind == "semantic_row" and not gone):
            inserted = apply_op(node, ctx, [g.inserted for g in given])
            if not gone:
                return Change(inserted)
            return Change(inserted, apply_op(node, ctx, [g.retracted if g.retracted is not None else g.inserted.limit(0) for g in given]))
        if kind == "semantic_row":  # rows of a retracted occurrence go without a question
            before = old.frame(self.spark) if old else None
            inserted = apply_op(node, ctx, [given[0].inserted])
            if before is None:
                return Change(inserted)
            width = F.size(given[0].retracted[OCC])
            dropped = before.join(given[0].retracted.select(c(OCC).alias("__gone"), width.alias("__w")), F.slice(before[OCC], F.lit(1), F.col("__w")) == F.col("__gone"), "left_semi")
            return Change(inserted, dropped)
        if kind in ("relational_state", "semantic_binary_state") and not gone:
            new = [g.inserted for g in given]
            before = [self.state[n.fingerprint].frame(self.spark) if n.fingerprint in self.state else g.limit(0) for n, g in zip(node.inputs, new, strict=True)]
            parts = [apply_op(node, ctx, pair) for pair in ([new[0], before[1]], [before[0], new[1]], new)]
            return Change(parts[0].unionByName(parts[1]).unionByName(parts[2]))
        if kind == "semantic_binary_state":
            raise NotImplementedError("rows that a semantic join has read were retracted")
        if kind in ("process_window", "over_window") and gone:
            raise NotImplementedError("windows need an append-only input")
        if kind == "first_rows":
            first = apply_op(node, ctx, [given[0].inserted])
            if old is None:
                return Change(first)
            keys = node.params["subset"] or node.columns
            return Change(_among(first, keys, old.frame(self.spark).select(*(c(k).alias(f"__k{i}") for i, k in enumerate(keys))), "left_anti"))
        if kind == "algebraic_state":
            return self._algebraic(node, given[0], old, hidden)
        if kind == "over_window":
            return self._over(node, given[0])
        if kind == "semantic_state" and old is not None:
            return self._touched_groups(node, given[0], old, states)
        ctx.options = {**self.options, "__replies": self.replies}
        full = apply_op(node, ctx, [states[n.fingerprint].frame(self.spark) for n in node.inputs])
        if old is None:
            return Change(full)
        return self._compared(full, old)

    def _compared(self, full: DataFrame, old: State) -> Change:
        full = stored(full, "full")
        inserted, retracted = bag_difference(full, old.frame(self.spark).select(*full.columns))
        return Change(inserted, retracted)

    def _algebraic(self, node: Node, change: Change, old: State | None, hidden: dict[str, State]) -> Change:
        """Signed partial sums by key, one small table a step; only touched keys are read, finished and compared."""
        keys, specs = node.params["keys"], node.params["specs"]
        df = change.inserted.withColumn("__sign", F.lit(1).cast("long"))
        if change.retracted is not None:
            df = df.unionByName(change.retracted.withColumn("__sign", F.lit(-1).cast("long")))
        cols, kinds = [F.sum("__sign").alias("__rows"), F.min(OCC).alias(OCC)], {}
        for i, s in enumerate(specs):
            if s.kind != "count":
                kinds[i] = df.schema[s.columns[0]].dataType
                if not isinstance(kinds[i], T.NumericType):
                    raise TypeError(f"{s.columns[0]} is not numeric")
                v = c(s.columns[0]).cast(self._summed(kinds[i]))
                cols += [F.sum(F.when(c("__sign") > 0, v).otherwise(-v)).cast(self._summed(kinds[i])).alias(f"__sum{i}"), F.sum(F.when(v.isNotNull(), c("__sign"))).alias(f"__n{i}")]
        path, delta = store(df.groupBy(*map(c, keys)).agg(*cols), "partial")
        whole = hidden.get(node.fingerprint, State(delta.schema)).plus(path)
        narrow = old is not None and set(keys) <= set(node.columns)
        touched = delta.select(*(c(k).alias(f"__k{i}") for i, k in enumerate(keys))).distinct() if narrow and keys else None

        def summed(parts: DataFrame) -> DataFrame:
            of = {x.name: x.dataType for x in delta.schema.fields}
            sums = [F.sum(x).cast(of[x]).alias(x) for x in delta.columns if x not in (*keys, OCC)]
            return parts.groupBy(*map(c, keys)).agg(*sums, F.min(OCC).alias(OCC))

        if len(whole.parts) > MOST_PARTS:
            path, state = store(summed(whole.frame(self.spark)).filter(F.lit(not keys) | (F.coalesce("__rows", F.lit(0)) > 0)).select(*delta.columns), "partial")
            whole = State(state.schema, [path])
        hidden[node.fingerprint] = whole
        state = summed(_among(whole.frame(self.spark), keys, touched))
        if keys:
            state = state.filter(F.coalesce("__rows", F.lit(0)) > 0)
        out = [c(k) for k in keys]
        for i, s in enumerate(specs):
            if s.kind == "count":
                out.append(F.coalesce("__rows", F.lit(0)).cast("long").alias(s.output))
                continue
            total = F.when(c(f"__n{i}") > 0, c(f"__sum{i}"))
            if s.kind == "avg":
                total = total / c(f"__n{i}")
                if isinstance(kinds[i], T.DecimalType):  # the type that an average has at once
                    total = total.cast(T.DecimalType(min(38, kinds[i].precision + 4), min(38, kinds[i].scale + 4)))
            out.append(total.alias(s.output))
        full = state.select(*out, F.coalesce(OCC, F.array(F.lit(0).cast("long"))).alias(OCC)).select(*map(c, node.columns), OCC)
        if old is None:
            return Change(full)
        full = stored(full, "full")
        inserted, retracted = bag_difference(full, _among(old.frame(self.spark), keys, touched).select(*full.columns))
        return Change(inserted, retracted)

    @staticmethod
    def _summed(kind: T.DataType) -> T.DataType:
        """The type that a sum of ``kind`` has."""
        if isinstance(kind, T.DecimalType):
            return T.DecimalType(min(38, kind.precision + 10), kind.scale)
        return T.LongType() if isinstance(kind, T.IntegralType) else T.DoubleType()

    def _touched_groups(self, node: Node, change: Change, old: State, states: dict[str, State]) -> Change:
        """A semantic aggregate by exact keys folds again only the groups that the change touches."""
        keys = node.params["keys"]
        touched = change.inserted if change.retracted is None else change.inserted.unionByName(change.retracted)
        touched = stored(touched.select(*(c(k).alias(f"__k{i}") for i, k in enumerate(keys))).distinct(), "touched")
        rows = _among(states[node.inputs[0].fingerprint].frame(self.spark), keys, touched)
        return Change(apply_op(node, self._context(), [rows]), _among(old.frame(self.spark), keys, touched))

    def _over(self, node: Node, change: Change) -> Change:
        """New rows with the tail of old ones that their frames reach; emitted rows are the new ones."""
        source = node.inputs[0].fingerprint
        reach = -node.params["rows"][0]
        new = change.inserted
        if source not in self.state or not reach:
            return Change(apply_op(node, self._context(), [new]))
        tail = self.state[source].frame(self.spark).orderBy(F.desc(OCC)).limit(reach)
        both = tail.withColumn("__old", F.lit(True)).unionByName(new.withColumn("__old", F.lit(False)))
        framed = apply_op(node, self._context(), [both.drop("__old")])
        return Change(framed.join(new.select(OCC), OCC, "left_semi").select(*framed.columns))

    # Reading
    def view(self, name: str) -> DataFrame:
        node = self.views[name]
        found = self.state.get(node.fingerprint)
        if found is None:
            return self.spark.createDataFrame([], T.StructType([T.StructField(x, T.StringType()) for x in node.columns]))
        return found.frame(self.spark).select(*map(c, node.columns))

    def query(self, relation: Relation, text: str = "") -> DataFrame:
        """A relation over published state; stored nodes are read, not run again."""
        from tidemark.operators.relational import lower

        bound = {k: s.frame(self.spark) for k, s in self.state.items()}
        ctx = self._context(bound)
        ctx.options = {**self.options, "query": text}
        return lower(self._rewritten(relation), ctx).select(*map(c, relation.columns))

    # Snapshots
    def _said(self) -> dict:
        groups = {"state": self.state, "hidden": self.hidden, "replies": self.replies}
        said = {k: {x: s.to_json() for x, s in v.items()} for k, v in groups.items()}
        return said | {"version": 2, "plan": self.fingerprint, "model": self._model_mark(), "rows": self.rows, "commit": self.commit, "batches": self.batches, "schemas": {k: v.json() for k, v in self.schemas.items()}}

    def _model_mark(self) -> str:
        """Of the model's class and, if it has one, its ``fingerprint``: replies are only reused under the same one."""
        return f"{type(self.model).__qualname__}:{getattr(self.model, 'fingerprint', '')}"

    def _write(self, path: str) -> None:
        """In place of what was there; readers see the old manifest or the new one."""
        fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        with fs.open_output_stream(at + ".new") as f:
            f.write(json.dumps(self._said()).encode())
        fs.move(at + ".new", at)
        self.pinned |= {p for group in (self.state, self.hidden, self.replies) for s in group.values() for p in s.parts}

    def snapshot(self) -> str:
        """Writes a manifest over the stored tables, replies among them; returns its path, another one each time. The
        tables it names are not deleted by later steps."""
        path = f"{shared_dir(self.spark)}/snapshot-{self.commit}-{self.fingerprint[:12]}-{uuid.uuid4().hex[:8]}.json"
        self._write(path)
        return path

    def restore(self, path: str) -> None:
        fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        with fs.open_input_stream(at) as f:
            said = json.loads(f.read())
        if said["version"] != 2 or said["plan"] != self.fingerprint:
            raise ValueError("the snapshot is of another plan")
        self.state, self.hidden, self.replies = ({k: State.from_json(v) for k, v in said[x].items()} for x in ("state", "hidden", "replies"))
        if said["model"] != self._model_mark():
            self.replies = {}
        self.schemas = {k: T.StructType.fromJson(json.loads(v)) for k, v in said["schemas"].items()}
        self.rows, self.commit, self.batches = said["rows"], said["commit"], dict(said["batches"])
        self.pinned |= {p for group in (self.state, self.hidden, self.replies) for s in group.values() for p in s.parts}

    def attach(self, stream: DataFrame, checkpoint: str, **trigger):
        """Feed from a Structured Streaming source. A batch's number is written with the state that it led to, beside
        the stream's checkpoint: after a crash between the step and the stream's own commit, a new Dataflow that is
        attached goes on from there, and the batch that comes again is not applied again."""
        kept = f"{checkpoint.rstrip('/')}-flow.json"
        fs, at = pafs.FileSystem.from_uri(kept if "://" in kept else f"file://{kept.removeprefix('file:')}")
        if not self.commit and fs.get_file_info(at).type != pafs.FileType.NotFound:
            self.restore(kept)

        def each(batch: DataFrame, batch_id: int) -> None:
            if batch_id > self.batches.get(checkpoint, -1):
                last = set(self.pinned)
                self.apply(batch)
                self.batches[checkpoint] = batch_id
                self._write(kept)
                self.pinned -= last - {p for g in (self.state, self.hidden, self.replies) for s in g.values() for p in s.parts}

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass(frozen=True)
class Message:
    content: str
    role: str | None = None
    timestamp: str | None = None
    session_id: str | None = None
    metadata: Mapping = field(default_factory=dict)

    def row(self) -> dict:
        return {"message": self.content, "content": self.content, "role": self.role, "timestamp": self.timestamp, "session_id": self.session_id, "metadata": json.dumps(dict(self.metadata))}


class Memory:
    """Row-wise appends with count refresh: ``every`` rows make a step, ``flush`` applies the rest."""

    def __init__(self, flow: Dataflow, every: int = 1, schema: T.StructType | None = None):
        if type(every) is not int or every < 1:
            raise ValueError("every is a whole number from 1")
        self.flow, self.every = flow, every
        self.schema = schema or T.StructType([T.StructField(x, T.StringType()) for x in flow.source.declared])
        self.pending: list[dict] = []

    @property
    def pending_count(self) -> int:
        return len(self.pending)

    def add(self, message: str | Message | Mapping) -> None:
        if set(SYSTEM_COLUMNS) & set(message if isinstance(message, Mapping) else ()):
            raise ValueError("system columns are given by the log")
        row = {self.flow.source.declared[0]: message} if isinstance(message, str) else message.row() if isinstance(message, Message) else dict(message)
        self.pending.append({k: row.get(k) for k in self.flow.source.declared})
        if len(self.pending) >= self.every:
            self.flush()

    def flush(self) -> None:
        """A failed step keeps its rows pending."""
        if self.pending:
            rows = [tuple(r[f.name] for f in self.schema.fields) for r in self.pending]
            self.flow.apply(self.flow.spark.createDataFrame(rows, self.schema).coalesce(1))
            self.pending = []

    def query(self, relation: Relation, text: str = "") -> DataFrame:
        return self.flow.query(relation, text)


def evaluate(relation: Relation, frame: DataFrame, order: list[str], model=None, options: dict | None = None) -> DataFrame:
    """One-shot: ``relation`` over ``frame`` as its log, arriving in the order of long columns ``order``."""
    from tidemark.operators.relational import lower

    node = keyed_joins(relation.node, partial(keyed, model))
    log = next(n for n in walk(node) if n.op == "log")
    bound = frame.select(*map(c, log.columns), F.array(*(c(o).cast("long") for o in order)).alias(OCC))
    return lower(node, Context(frame.sparkSession, {log.fingerprint: bound}, model, options=options or {})).select(*map(c, relation.columns))


def evaluate_many(relation: Relation, frames: Mapping[str, tuple[DataFrame, list[str]]], model=None, options: dict | None = None) -> DataFrame:
    """As ``evaluate``, over several logs by name."""
    from tidemark.operators.relational import lower

    bound = {}
    spark = None
    node = keyed_joins(relation.node, partial(keyed, model))
    for n in walk(node):
        if n.op == "log":
            frame, order = frames[n.params["name"]]
            spark = frame.sparkSession
            bound[n.fingerprint] = frame.select(*map(c, n.columns), F.array(*(c(o).cast("long") for o in order)).alias(OCC))
    return lower(node, Context(spark, bound, model, options=options or {})).select(*map(c, relation.columns))
