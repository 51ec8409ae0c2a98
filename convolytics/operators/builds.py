"""Foundation tables from transcript files, built again only for sessions whose file changed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convolytics.functions import text as T
from convolytics.operators import jobs, rules, sessions, splits
from convolytics.sources import files, sinks

#: The session is the name of its file.
FILE = r"([^/]+)\.csv$"
BY_SESSION = ("utterances", "session_features", "session_texts")
WHOLE = ("modeling_base", "response_folds")


def _last(spark: SparkSession, out: str) -> tuple[int, DataFrame | None]:
    """Number and manifest of the last finished build; 0 and None before the first."""
    try:
        builds = spark.read.parquet(f"{out}/manifest")
    except AnalysisException:
        return 0, None
    n = builds.agg(F.max("build").alias("n")).first().n
    return n, builds.where(F.col("build") == n).drop("build")


def file_rules() -> list[rules.Rule]:
    """Rules on what was read beside the files it came from: `read` and `listed`."""
    return [
        rules.unique("one file a session", "listed", ["session_id"]),
        rules.references("empty file", "listed", ["session_id"], "read", ["named"]),
        rules.rows("named by file", "read", ["named"], ~F.col("session_id").eqNullSafe(F.col("named"))),
        rules.contiguous("contiguous", "read", ["named"], "utterance_id"),
        rules.ascending("time order", "read", ["named"], "utterance_id", T.seconds(F.col("timestamp"))),
        rules.rows("time", "read", ["named"], T.seconds(F.col("timestamp")).isNull()),
    ]


def response_rules() -> list[rules.Rule]:
    return [
        rules.unique("response key", "responses", ["response_id"]),
        rules.references("sessions", "responses", ["session_id"], "listed"),
        rules.rows("target", "responses", ["response_id"], ~F.col("target").isin(0, 1)),
        rules.rows("objective", "responses", ["response_id"], F.col("objective").isNull()),
    ]


def foundation_from_files(spark: SparkSession, folder: str, responses: DataFrame, out: str, named: str = FILE, closing: float = 0.25, folds: int = 5, seed: int = 7) -> int:
    """Builds the foundation below out from the CSV files below folder; the number of the build, for `table`.

    A file of known size and time isn't read, one of known content is hashed but not parsed. Tables by session hold rows
    only of sessions that this build read; those of others stay where an earlier build put them, and a lost file's session
    leaves the manifest. The manifest is written last: a build that broke off is overwritten by the next one. Raises where
    a file is empty, not named by its session, has gaps, goes back in time or isn't alone for its session, where a response
    breaks a rule, or where there are no files. Where only some files changed, their names, nothing else, reach the driver.
    """
    files.found(spark, folder, 1)
    number, known = _last(spark, out)
    number += 1
    hashed = files.manifest(spark, folder, "*.csv", known)
    before = known.select("session_id", F.col("sha256").alias("_sha256"), F.col("built").alias("_built")) if known is not None else spark.createDataFrame([], "session_id string, _sha256 string, _built int")
    listed = hashed.withColumn("session_id", F.regexp_extract("path", named, 1)).join(before, "session_id", "left")
    listed = listed.withColumn("built", F.when(F.col("sha256") == F.col("_sha256"), F.col("_built")).otherwise(F.lit(number))).drop("_sha256", "_built")
    listed = sinks.materialize(listed, "manifest")
    if listed.isEmpty():
        raise rules.ExpectationFailed(f"{folder}: no files")
    changed = listed.where(F.col("built") == number)
    if not changed.isEmpty():
        if listed.where(F.col("built") < number).isEmpty():
            read = files.transcripts(spark, folder, deep=True)
        else:
            read = files.transcripts(spark, [r.path for r in changed.select("path").collect()])
        read = sinks.materialize(read.withColumn("named", F.regexp_extract("source_path", named, 1)), "transcripts")  # parsed once
        rules.check({"read": read, "listed": changed}, file_rules())
        sinks.write_table(read.drop("named", "source_path", "source_file"), f"{out}/utterances/build={number}")
        u = spark.read.parquet(f"{out}/utterances/build={number}")
        sinks.write_table(sessions.session_features(u), f"{out}/session_features/build={number}")
        sinks.write_table(sessions.session_texts(u, closing), f"{out}/session_texts/build={number}")
    rules.check({"responses": responses, "listed": listed}, response_rules())
    features = _current(spark.read.parquet(f"{out}/session_features"), listed)
    base = sessions.modeling_base(splits.group_folds(responses, "session_id", k=folds, seed=seed), features)
    sinks.write_table(base, f"{out}/modeling_base/build={number}")
    base = spark.read.parquet(f"{out}/modeling_base/build={number}")
    sinks.write_table(base.select("response_id", "session_id", "fold"), f"{out}/response_folds/build={number}")
    digest = files.manifest_tree_digest(listed)
    sizes = listed.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("built") == number).alias("files_read"), F.count_if(F.col("built") < number).alias("files_kept"))
    summary = base.agg(F.count("*").alias("responses"), F.avg("target").alias("positive_rate"))
    report = digest.crossJoin(sizes).crossJoin(summary)  # three rows of one each
    sinks.write_table(report.withColumn("created_at", F.current_timestamp()), f"{out}/report/build={number}")
    sinks.write_table(listed, f"{out}/manifest/build={number}")
    return number


def _current(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of sessions from the builds that the manifest names."""
    return rows.join(manifest.select("session_id", F.col("built").alias("build")), ["session_id", "build"], "left_semi")


def table(spark: SparkSession, out: str, name: str, build: int | None = None) -> DataFrame:
    """A table as a finished build left it, the last one if none is named; by session with the build that made the row."""
    manifests = spark.read.parquet(f"{out}/manifest")
    if build is None:
        build = manifests.agg(F.max("build").alias("n")).first().n
    if name in BY_SESSION:
        return _current(spark.read.parquet(f"{out}/{name}"), manifests.where(F.col("build") == build).drop("build"))
    if name not in (*WHOLE, "manifest", "report"):
        raise ValueError(f"no table {name}")
    return spark.read.parquet(f"{out}/{name}/build={build}")


def tables(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """All tables of the last build by name, as jobs.verification takes them."""
    return {name: table(spark, out, name) for name in jobs.FOUNDATION}
