"""Writers: tables, partitioned folds, small sorted CSV, ledgers, reports, scores aligned to wanted ids, cached tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolytics.operators.expect import exact_columns

# The columns of the ledger.
LEDGER = ["run_id", "timestamp_utc", "model", "fold_scheme", "log_loss", "roc_auc", "brier_score", "ece_10", "status"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share.

    Where that is unset, a local folder serves a local master; a cluster is refused, since its executors couldn't see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-convolytics-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is executed here leaves no shuffle files; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: computed once, without its lineage and its shuffles' files."""
    path = scratch(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet with zstd; the output committer makes a finished write visible as a whole.

    With partition columns rows are dealt by them and by a salt, so that a hot value is written by several tasks.
    """
    if partition_by:
        df = df.repartition(*partition_by, F.pmod(F.xxhash64(*[c for c in df.columns if c not in partition_by][:1] or partition_by), F.lit(8)))
    df.write.option("compression", "zstd").mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_scorecard(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A small table as one sorted CSV file with a header."""
    df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    exact_columns(rows, LEDGER)
    rows.write.mode("append").parquet(path)


def append_report(spark: SparkSession, path: str, run_id: str, settings: Mapping[str, str], folds: DataFrame, top_models: DataFrame) -> None:
    """One JSON line for a run: its settings and the rows (small tables) of its folds and of its best models."""
    one = folds.agg(F.collect_list(F.struct(*folds.columns)).alias("folds")).crossJoin(top_models.agg(F.collect_list(F.struct(*top_models.columns)).alias("top_models")))
    given = F.create_map(*[F.lit(x) for kv in settings.items() for x in kv]) if settings else F.lit(None).cast("map<string,string>")
    one.select(F.lit(run_id).alias("run_id"), F.current_timestamp().alias("created_at"), given.alias("settings"), "folds", "top_models").write.mode("append").json(path)


def aligned(wanted: DataFrame, scores: DataFrame, key: str = "response_id", value: str = "probability") -> DataFrame:
    """One row for each wanted id, with its score; a null score (an id without one) raises when the row is computed."""
    out = wanted.select(key).join(scores.select(key, value), key, "left")
    return out.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.concat(F.lit(f"no {value} for {key} "), F.col(key).cast("string"))).cast("double")).otherwise(F.col(value)))


def cached(spark: SparkSession, path: str, digest: str, version: int, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it was built from this digest and version, else built, written and read again.

    Its mark is written last, so that a table whose writing was broken off isn't taken for whole.
    """
    try:
        current = not spark.read.parquet(f"{path}_mark").where((F.col("digest") == digest) & (F.col("version") == version)).isEmpty()
    except AnalysisException:
        current = False
    if not current:
        spark.createDataFrame([("", -1)], "digest string, version int").write.mode("overwrite").parquet(f"{path}_mark")
        write_table(build(), path)
        spark.createDataFrame([(digest, version)], "digest string, version int").write.mode("overwrite").parquet(f"{path}_mark")
    return spark.read.parquet(path)
