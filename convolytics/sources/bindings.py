"""The driver's tables as utterances, responses, predictions and embedded responses; the same in SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Cues that occur in the synthetic text.
CUES = {"affirm": ["that", "this", "it"], "correction": ["was", "from"], "uncertainty": ["is", "be"], "reasoning": ["for", "with"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    sec = F.col("turn") * 37 + F.col("conv_id") % 60
    role = F.when(F.col("role") == "user", "student").when(F.col("role") == "assistant", "tutor").otherwise("background")
    stamp = F.format_string("%02d:%02d:%02d", F.floor(sec / 3600), F.floor(sec % 3600 / 60), sec % 60)
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("utterance_id"), role.alias("role"), F.col("text").alias("content"), stamp.alias("timestamp"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_conv = table(spark, sf_dir, "conversations").agg(F.count_distinct("conv_id").alias("n_conv"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("objective_id"), F.col("text").alias("objective"))
    n_items = items.agg(F.count("*").alias("n_items"))
    rows = table(spark, sf_dir, "labels").crossJoin(n_conv).crossJoin(n_items)  # two one-row tables
    rows = rows.select(F.col("doc_id").alias("response_id"), (F.col("doc_id") * 7 % F.col("n_conv")).alias("session_id"), (F.floor(F.col("doc_id") / 3) % F.col("n_items")).alias("objective_id"), F.col("quality").alias("target"))
    return rows.join(items, "objective_id")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def p(a: int, m: int, d: float):
        return (F.col("response_id") * a % m + 1) / F.lit(d)

    rows = responses(spark, sf_dir).drop("objective").withColumns({"v02": p(31, 97, 99.0), "semantic": p(17, 89, 91.0), "bge_base": p(43, 83, 85.0), "nbsvm": p(29, 79, 81.0)})
    return rows.withColumn("combined", (F.col("v02") + F.col("nbsvm")) / 2).withColumn("protocol", F.explode(F.array(F.lit("p0"), F.lit("p1"))))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("response_id"), F.col("label").alias("objective_id"), F.col("embedding").cast("array<double>").alias("context"), F.floor(F.col("vec_id") / 2).alias("session_id"), (F.col("vec_id") * 13 % 7 < 3).cast("int").alias("target"))


U = """utterances AS (SELECT conv_id AS session_id, turn AS utterance_id, CASE role WHEN 'user' THEN 'student' WHEN 'assistant' THEN 'tutor' ELSE 'background' END AS role,
  text AS content, turn * 37 + conv_id % 60 AS sec FROM conversations)"""
R = """responses AS (SELECT l.doc_id AS response_id, (l.doc_id * 7) % (SELECT count(DISTINCT conv_id) FROM conversations) AS session_id, b.item_id AS objective_id, l.quality AS target, b.text AS objective
  FROM labels l JOIN benchmark b ON b.item_id = (l.doc_id // 3) % (SELECT count(*) FROM benchmark))"""
P = f"""{R}, predictions AS (SELECT response_id, session_id, objective_id, target, protocol, v02, semantic, bge_base, nbsvm, (v02 + nbsvm) / 2 AS combined FROM (
  SELECT *, ((response_id * 31) % 97 + 1) / 99e0 AS v02, ((response_id * 17) % 89 + 1) / 91e0 AS semantic, ((response_id * 43) % 83 + 1) / 85e0 AS bge_base, ((response_id * 29) % 79 + 1) / 81e0 AS nbsvm FROM responses)
  CROSS JOIN (SELECT unnest(['p0', 'p1']) AS protocol))"""
E = "embedded AS (SELECT vec_id AS response_id, label AS objective_id, embedding::DOUBLE[] AS context, vec_id // 2 AS session_id, ((vec_id * 13) % 7 < 3)::INT AS target FROM embeddings)"
