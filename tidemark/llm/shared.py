"""Session helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018  other C libraries have no such call
except (OSError, AttributeError):
    _LIBC = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where that setting is absent a temporary folder is used, which only a local master can share with itself;
    on a cluster it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _OWN[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there: lineage ends, lost executors cost no rerun."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_at = path
    return made


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` gave, once all that reads them is stored itself. Spark drops the shuffle
    files of finished steps when the driver collects garbage, so that is asked for, too, and the driver's Python gives
    back what it has freed."""
    trim()
    tables[0].sparkSession._jvm.System.gc()
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system and path of a URI, for files that are not tables."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Give memory that a Python worker has freed back to the system; called at the end of a task's partition, and in the driver."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def doc_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty; other columns are left behind, whatever their names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_slices(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds few bytes, whatever the length of single texts."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        per_row = max(1, batch.nbytes // n)
        step = max(1, min(most_rows, most_bytes // per_row))
        for at in range(0, n, step):
            yield batch.slice(at, step)
