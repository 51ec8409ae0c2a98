"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolytics.sources.sinks import shuffles_freed

HELD_OUT_FOLDS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns or ["*"])


def held_out(id_col: str) -> Column:
    """True for the quarter of the rows, by crc32 of the id as text, that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % HELD_OUT_FOLDS == HELD_OUT, F.lit(False))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir, in one folder for each application.

    Where that is unset, a local folder serves a local master; a cluster is refused, since its executors couldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-convolytics-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/convolytics-{spark.conf.get('spark.app.id', 'local')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors and leaves no shuffle files."""
    path = scratch(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put(df: DataFrame, **columns: Column) -> DataFrame:
    """withColumns, where an input column of the same name is replaced."""
    return df.withColumns(columns)


def give_back() -> None:
    """Return a worker's free memory to the system: Spark keeps workers between tasks, and what they hold adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_RESIDENT: dict[tuple, object] = {}


def resident(key: tuple, build: Callable):
    """build(), kept by this worker until a task asks for another key: one model a worker, also in a chain of stages."""
    if key not in _RESIDENT:
        release()
        _RESIDENT[key] = build()
    return _RESIDENT[key]


def release() -> None:
    """Drop what this worker has kept, for tasks that need the memory and no model."""
    if _RESIDENT:
        _RESIDENT.clear()
        gc.collect()
        give_back()


class Memo(dict):
    """A memo of a function of one key. It starts again when it is full, so that its memory stays bounded."""

    def __init__(self, fill: Callable, limit: int = 600_000):
        super().__init__()
        self.fill, self.limit = fill, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.fill(key)
        return value


def n_bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def byte_blocks(texts: Iterable[str | None], limit: int) -> Iterator[list[str]]:
    """Runs of whole texts of about limit bytes (UTF-8) each; null becomes empty. A longer text is a run of its own."""
    block, size = [], 0
    for text in texts:
        text = text or ""
        more = n_bytes(text)
        if block and size + more > limit:
            yield block
            block, size = [], 0
        block.append(text)
        size += more
    if block:
        yield block
