"""Sinks for changelogs: typed table descriptors, a graph of two tables, and versioned points.

All are Parquet in the shared folder under a JSON file for each commit that is written last and created once: a
reader sees a commit whole or not at all, and of two writers one fails.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECRETS = ("password", "secret", "token", "api_key", "apikey", "credential")


class ConflictError(RuntimeError):
    """Another writer has committed."""


@dataclass(frozen=True)
class TableDescriptor:
    connector: str
    schema: T.StructType
    key: tuple[str, ...]
    options: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for name in self.options:
            if any(s in name.lower() for s in SECRETS):
                raise ValueError(f"option {name} looks like a secret")
        missing = set(self.key) - set(self.schema.fieldNames())
        if missing or not self.key:
            raise ValueError("the key must be columns of the schema")


def sql_type(said: str) -> T.DataType:
    """Spark type of a declared one: STRING, BIGINT, TIMESTAMP(6), TIMESTAMP_LTZ(6), ROW<..>, ARRAY<..>."""
    text = said.strip().replace("TIMESTAMP_LTZ(6)", "timestamp").replace("TIMESTAMP(6)", "timestamp_ntz").replace("ROW<", "struct<")
    parts = ""
    for word in text.split():  # "name TYPE" inside a struct becomes name:type
        parts += word if not parts or parts.endswith((",", "<")) else ":" + word
    return T._parse_datatype_string(parts.lower())


def physical_id(namespace: str, kind: str, values: Sequence[Column]) -> Column:
    """A version-5 UUID of (namespace, kind, values) as JSON; the same rows have the same id in every run, and 1 and
    "1" different ones."""
    space = uuid.uuid5(uuid.NAMESPACE_URL, namespace).bytes

    def said(v: Column) -> Column:
        text = F.to_json(F.array(v.cast("string")))
        quoted = F.substring(text, F.lit(2), F.length(text) - 2)
        return F.when(v.isNull(), "null").when(F.typeof(v).isin("string", "date", "timestamp", "timestamp_ntz", "binary"), quoted).otherwise(v.cast("string"))

    name = F.concat(F.lit("["), F.concat_ws(",", F.lit(json.dumps(kind)), *map(said, values)), F.lit("]"))
    digest = F.sha1(F.concat(F.lit(bytearray(space)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)


class Staged:
    """Tables that are written but not yet to be seen."""

    def __init__(self, sink: _Committed, seen: dict, manifest: dict):
        self.sink, self.seen, self.manifest = sink, seen, manifest

    def publish(self) -> None:
        self.sink.swap(self.seen, self.manifest)

    def undo(self) -> None:
        self.sink.withdraw(self.manifest["commit"])


class _Committed:
    """A folder with versions of tables, and a file for each commit that is created once and never replaced: of two
    writers of one commit the second fails. The highest commit is what readers see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs, self.at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
        self.fs.create_dir(self.at, recursive=True)

    def _commits(self) -> list[int]:
        found = self.fs.get_file_info(pafs.FileSelector(self.at))
        return sorted(int(m[1]) for x in found if (m := re.fullmatch(r"commit-(\d+)\.json", x.base_name)))

    def manifest(self) -> dict:
        commits = self._commits()
        if not commits:
            return {"commit": 0, "plan": None, "tables": {}}
        with self.fs.open_input_stream(f"{self.at}/commit-{commits[-1]}.json") as f:
            return json.loads(f.read())

    def _jvm(self, name: str):
        jvm, at = self.spark._jvm, f"{self.path}/{name}"
        where = jvm.org.apache.hadoop.fs.Path(at if "://" in at else f"file://{at}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def swap(self, seen: dict, manifest: dict) -> None:
        """Publish, if the sink is still where it was seen. The file is written under a name of its own and then moved
        to that of the commit, which fails where that is there already."""
        if self.manifest()["commit"] != seen["commit"]:
            raise ConflictError("the sink moved on meanwhile")
        mine = f"new-{uuid.uuid4().hex}.json"
        with self.fs.open_output_stream(f"{self.at}/{mine}") as f:
            f.write(json.dumps(manifest).encode())
        name = f"commit-{manifest['commit']}.json"
        fs, target = self._jvm(f"claim-{manifest['commit']}")
        try:
            fs.create(target, False).close()  # create only: one writer gets it
        except Exception as e:
            self.fs.delete_file(f"{self.at}/{mine}")
            raise ConflictError(f"commit {manifest['commit']} has another writer") from e
        self.fs.move(f"{self.at}/{mine}", f"{self.at}/{name}")

    def withdraw(self, commit: int) -> None:
        self.fs.delete_file(f"{self.at}/commit-{commit}.json")
        fs, claim = self._jvm(f"claim-{commit}")
        fs.delete(claim, False)

    def staged(self, seen: dict, commit: int, plan: str, tables: dict[str, DataFrame]) -> Staged:
        made = dict(seen["tables"])
        for name, df in tables.items():
            made[name] = {"path": f"{self.path}/{name}-{commit}-{uuid.uuid4().hex}", "schema": df.schema.json()}
            df.write.parquet(made[name]["path"])
        return Staged(self, seen, {"commit": commit, "plan": plan, "tables": made})

    def publish(self, seen: dict, commit: int, plan: str, tables: dict[str, DataFrame]) -> None:
        self.staged(seen, commit, plan, tables).publish()

    def read(self, name: str) -> DataFrame | None:
        found = self.manifest()["tables"].get(name)
        return self.spark.read.schema(T.StructType.fromJson(json.loads(found["schema"]))).parquet(found["path"]) if found else None

    def begin(self, commit: int, plan: str) -> dict | None:
        """The manifest to write after; None if this commit is there already."""
        seen = self.manifest()
        if seen["commit"] >= commit and seen["plan"] == plan:
            return None
        if seen["commit"] and (seen["plan"] != plan or seen["commit"] != commit - 1):
            raise ConflictError(f"the sink is at commit {seen['commit']}")
        return seen

    def stage(self, inserted, retracted, commit: int, plan: str) -> Staged | None:
        raise NotImplementedError

    def write(self, inserted, retracted, commit: int, plan: str) -> None:
        staged = self.stage(inserted, retracted, commit, plan)
        if staged is not None:
            staged.publish()


def _keyed(key: Sequence[str] | TableDescriptor) -> tuple[list[str], TableDescriptor | None]:
    return (list(key.key), key) if isinstance(key, TableDescriptor) else (list(key), None)


class TableSink(_Committed):
    """Rows by key: retracted keys go, inserted ones replace. A descriptor in place of the key also fixes the columns."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] | TableDescriptor):
        super().__init__(spark, path)
        self.key, self.descriptor = _keyed(key)

    def stage(self, inserted: DataFrame, retracted: DataFrame | None, commit: int, plan: str) -> Staged | None:
        seen = self.begin(commit, plan)
        if seen is None:
            return None
        old = self.read("rows")
        if old is None:
            new = inserted.dropDuplicates(self.key)
        else:
            gone = inserted.select(*self.key)
            gone = gone.unionByName(retracted.select(*self.key)) if retracted is not None else gone
            new = old.join(gone.distinct(), self.key, "left_anti").select(*inserted.columns).unionByName(inserted.dropDuplicates(self.key))
        return self.staged(seen, commit, plan, {"rows": new})

    def rebuild(self, rows: DataFrame, commit: int, plan: str) -> None:
        """Replaces everything, whatever was committed before."""
        self.publish(self.manifest(), commit, plan, {"rows": rows.dropDuplicates(self.key)})

    def rows(self) -> DataFrame | None:
        return self.read("rows")


class GraphSink(_Committed):
    """Nodes and edges: edges of retracted rows go first, then nodes and edges are upserted, then nodes go. In a flow it
    is bound to a pair of views: ``sinks={("entities", "facts"): sink}``."""

    def __init__(self, spark: SparkSession, path: str, node_key: str, source: str, target: str):
        super().__init__(spark, path)
        self.node_key, self.ends = node_key, (source, target)

    def stage(self, inserted: Sequence[DataFrame], retracted: Sequence[DataFrame | None], commit: int, plan: str) -> Staged | None:
        """``inserted`` and ``retracted``: of nodes and edges."""
        seen = self.begin(commit, plan)
        if seen is None:
            return None
        (nodes, edges), (gone_nodes, gone_edges) = inserted, retracted
        old_nodes, old_edges = self.read("nodes"), self.read("edges")
        ends = list(self.ends)
        if old_edges is not None:
            out = edges.select(*ends)
            out = out.unionByName(gone_edges.select(*ends)) if gone_edges is not None else out
            edges = old_edges.join(out.distinct(), ends, "left_anti").select(*edges.columns).unionByName(edges)
        key, new = [self.node_key], nodes
        if old_nodes is not None:
            nodes = old_nodes.join(new.select(*key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)
        if gone_nodes is not None:
            nodes = nodes.join(gone_nodes.select(*key).join(new.select(*key), key, "left_anti"), key, "left_anti")
        return self.staged(seen, commit, plan, {"nodes": nodes.dropDuplicates(key), "edges": edges.dropDuplicates(ends)})

    def write_changes(self, nodes: DataFrame, edges: DataFrame, gone_nodes: DataFrame | None, gone_edges: DataFrame | None, commit: int, plan: str) -> None:
        self.write((nodes, edges), (gone_nodes, gone_edges), commit, plan)

    def rebuild(self, nodes: DataFrame, edges: DataFrame, commit: int, plan: str) -> None:
        tables = {"nodes": nodes.dropDuplicates([self.node_key]), "edges": edges.dropDuplicates(list(self.ends))}
        self.publish(self.manifest(), commit, plan, tables)

    def nodes(self) -> DataFrame | None:
        return self.read("nodes")

    def edges(self) -> DataFrame | None:
        return self.read("edges")


FOREVER = (1 << 63) - 1


class VectorSink(_Committed):
    """Points that are visible from one commit until another; a commit shows once its file is there."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] | TableDescriptor):
        super().__init__(spark, path)
        self.key, self.descriptor = _keyed(key)

    def _new(self, rows: DataFrame, commit: int) -> DataFrame:
        return rows.dropDuplicates(self.key).withColumns({"visible_from": F.lit(commit).cast("long"), "visible_until": F.lit(FOREVER).cast("long")})

    def stage(self, inserted: DataFrame, retracted: DataFrame | None, commit: int, plan: str) -> Staged | None:
        seen = self.begin(commit, plan)
        if seen is None:
            return None
        new, old = self._new(inserted, commit), self.read("points")
        if old is not None:
            gone = inserted.select(*self.key)
            gone = gone.unionByName(retracted.select(*self.key)) if retracted is not None else gone
            gone = gone.distinct().withColumn("__gone", F.lit(True))
            until = F.when(F.col("__gone") & (F.col("visible_until") > commit), F.lit(commit)).otherwise(F.col("visible_until")).cast("long")
            new = old.join(gone, self.key, "left").withColumn("visible_until", until).drop("__gone").select(*new.columns).unionByName(new)
        return self.staged(seen, commit, plan, {"points": new})

    def rebuild(self, rows: DataFrame, commit: int, plan: str) -> None:
        self.publish(self.manifest(), commit, plan, {"points": self._new(rows, commit)})

    def points(self, commit: int | None = None) -> DataFrame | None:
        at = self.manifest()["commit"] if commit is None else commit
        found = self.read("points")
        return None if found is None else found.filter((F.col("visible_from") <= at) & (F.col("visible_until") > at)).drop("visible_from", "visible_until")
