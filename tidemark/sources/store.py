"""Tables in the shared folder: what a step wrote once is read from there by all later ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
_MADE: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths of all tables that are stored meanwhile."""
    _MADE.append([])
    try:
        yield _MADE[-1]
    finally:
        _MADE.pop()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is not set and the master is local."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidemark-state-"))


def store(df: DataFrame, tag: str = "table") -> tuple[str, DataFrame]:
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _MADE:
        made.append(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, tag: str = "table") -> DataFrame:
    return store(df, tag)[1]


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@dataclass
class State:
    """A frame as stored parts. Appends add parts; other changes replace them."""

    schema: T.StructType
    parts: list[str] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(*self.parts) if self.parts else spark.createDataFrame([], self.schema)

    def plus(self, path: str) -> State:
        return State(self.schema, [*self.parts, path])

    def to_json(self) -> dict:
        return {"schema": self.schema.json(), "parts": self.parts}

    @staticmethod
    def from_json(said: dict) -> State:
        import json

        return State(T.StructType.fromJson(json.loads(said["schema"])), said["parts"])
