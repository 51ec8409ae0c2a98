"""Checked readers: typed CSV, transcript folders, labels, runs of predictions; and the digest of a set of files."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolytics.operators.expect import ExpectationFailed, columns_present
from convolytics.sources import sinks

TRANSCRIPT = "session_id string, utterance_id long, role string, content string, timestamp string"
CSV = {"header": True, "multiLine": True, "escape": '"', "mode": "FAILFAST"}
#: Options to write what these readers read; an empty text is read as null, which all text functions take alike.
WRITTEN = {"header": True, "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def found(spark: SparkSession, pattern: str, wanted: int | None = 1) -> list[str]:
    """Paths that match a glob; an error if they aren't just `wanted` (None: at least one). Only names are listed."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    statuses = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(s.getPath().toString() for s in statuses or [])
    if len(names) != wanted if wanted is not None else not names:
        raise ExpectationFailed(f"{pattern}: {len(names)} files, not {wanted or 'some'}")
    return names


@contextmanager
def wide_listing(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by some tasks a core, each many folders, instead of by up to 10,000 tasks of a few."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, 4 * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a declared schema. A declared column that the header lacks is an error; others are left out.

    Only the header is read beforehand. Fields are bound by name, whatever their order in the file.
    """
    header = spark.read.options(**CSV).csv(path).columns
    declared = spark.createDataFrame([], schema).schema
    if missing := sorted({f.name for f in declared} - set(header)):
        raise ExpectationFailed(f"{path}: missing columns: {', '.join(missing)}")
    types = {f.name: f.dataType.simpleString() for f in declared}
    whole = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header)
    return spark.read.options(**CSV).schema(whole).csv(path).select(*types)


def transcripts(spark: SparkSession, source: str | Sequence[str], deep: bool = False) -> DataFrame:
    """All *.csv files of a folder (deep: and of those below it), or the files named, as utterances, each with name and path of its file."""
    reader = spark.read.options(**CSV, enforceSchema=False).schema(TRANSCRIPT)
    if deep:
        reader = reader.options(pathGlobFilter="*.csv", recursiveFileLookup=True)
    elif isinstance(source, str):
        found(spark, f"{source}/*.csv", None)
        source = f"{source}/*.csv"
    with wide_listing(spark):
        raw = reader.csv(source if isinstance(source, str) else list(source))
    return raw.select("*", F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("source_path"))


def labels(spark: SparkSession, path: str, names: Sequence[str] = ("is_correct", "correct"), key: str = "response_id") -> DataFrame:
    """key, target (tinyint): the outcome stands in just one of the columns `names`."""
    raw = spark.read.options(**CSV).csv(path)
    columns_present(raw, [key])
    there = [n for n in names if n in raw.columns]
    if len(there) != 1:
        raise ExpectationFailed(f"{path}: just one of {', '.join(names)} is needed, there are {len(there)}")
    return raw.select(key, F.col(there[0]).cast("tinyint").alias("target"))


def runs(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Prediction tables of several runs in one, with source_run_id (the folder's name); columns that a run lacks are null."""
    if not folders:
        raise ExpectationFailed("no runs given")
    out = None
    for folder in folders:
        one = spark.read.parquet(folder).withColumn("source_run_id", F.lit(folder.rstrip("/").rsplit("/", 1)[-1]))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def baseline(predictions: DataFrame, protocols: Sequence[str]) -> DataFrame:
    """Predictions of the protocols; an error if there are none."""
    kept = predictions.where(F.col("protocol").isin(*protocols))
    if kept.isEmpty():
        raise ExpectationFailed(f"no predictions of {', '.join(protocols)}")
    return kept


def listing(spark: SparkSession, path: str | Sequence[str], pattern: str = "*", *more: Column) -> DataFrame:
    """path, bytes, modified of the files below a folder, or named; contents are read only where `more` has columns of them."""
    with wide_listing(spark):
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), *more)


def manifest(spark: SparkSession, path: str, pattern: str = "*", known: DataFrame | None = None) -> DataFrame:
    """path, bytes, modified, sha256 of each file; a file whose size and time stand in the manifest `known` isn't read.

    The folder is listed once.
    """
    same = ["path", "bytes", "modified"]
    hashed = F.sha2("content", 256).alias("sha256")
    if known is None:
        return listing(spark, path, pattern, hashed)
    files = sinks.materialize(listing(spark, path, pattern), "listing")
    old = files.join(known.select(*same, "sha256"), same)
    fresh = [r.path for r in files.join(old, same, "left_anti").select("path").collect()]  # names of changed files
    return old.unionByName(listing(spark, fresh, pattern, hashed)) if fresh else old


def manifest_digest(files: DataFrame) -> DataFrame:
    """One row, digest: SHA-256 of a `path|bytes|sha256` line for each file, in order of paths."""
    line = F.concat_ws("|", "path", F.col("bytes").cast("string"), "sha256")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: F.concat(x["line"], F.lit("\n")))
    return files.agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"))


def manifest_tree_digest(files: DataFrame) -> DataFrame:
    """One row, digest, for any number of files: SHA-256 of the digests of 4,096 parts, in order of parts.

    A file's part is the start of its path's MD5; a part's digest is that of its lines in order, so no row grows with all.
    """
    part, line = F.substring(F.md5("path"), 1, 3), F.concat_ws("|", "path", F.col("bytes").cast("string"), "sha256")
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"]), "\n")
    parts = files.groupBy(part.alias("part")).agg(F.sha2(text(F.struct("path", line.alias("line"))), 256).alias("line"))
    return parts.agg(F.sha2(text(F.struct("part", "line")), 256).alias("digest"))


def with_category(files: DataFrame, categories: Mapping[str, str]) -> DataFrame:
    """files with category: the first whose pattern is found in the path; a file of none is an error when it is computed."""
    named = F.coalesce(*[F.when(F.col("path").rlike(p), F.lit(c)) for c, p in categories.items()], F.raise_error(F.concat(F.lit("no category for "), F.col("path"))).cast("string"))
    return files.withColumn("category", named)
