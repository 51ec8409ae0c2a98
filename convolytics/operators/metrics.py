"""Exact metrics of probabilities, pooled and by slice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolytics.functions.text import clip

RANGES = 1024


def log_loss(y: Column, p: Column) -> Column:
    return F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))


def simple_metrics(df: DataFrame, by: Sequence[str], p: str = "p", target: str = "target") -> DataFrame:
    q = clip(F.col(p))
    y = F.col(target)
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(y).alias("positive_rate"), log_loss(y, q).alias("log_loss"), F.avg(F.pow(q - y, 2)).alias("brier"), F.avg(q).alias("prediction_mean"))


def auc(df: DataFrame, by: Sequence[str], p: str = "p", target: str = "target") -> DataFrame:
    """Mann-Whitney of clipped probabilities with ties counted half; null where a slice has one class only.

    Counts by distinct probability are ranked within 1,024 ranges of it; a range's start is the sum of those before.
    """
    values = df.select(*by, clip(F.col(p)).alias("_p"), F.col(target).alias("_y")).groupBy(*by, "_p").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")).withColumn("_r", F.floor(F.col("_p") * RANGES))
    before = lambda c, w: F.sum(c).over(w) - F.col(c)
    ranges = values.groupBy(*by, "_r").agg(F.sum("neg").alias("rneg"))
    ranges = ranges.withColumn("start", before("rneg", Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))).drop("rneg")
    inside = Window.partitionBy(*by, "_r").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.join(ranges, [*by, "_r"]).withColumn("below", F.col("start") + before("neg", inside))
    out = ranked.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return out.select(*by, F.when((F.col("np") > 0) & (F.col("nn") > 0), F.col("u") / (F.col("np") * F.col("nn"))).alias("auc"))


def ece(df: DataFrame, by: Sequence[str], p: str = "p", target: str = "target", bins: int = 10) -> DataFrame:
    """Expected calibration error over bins of equal width, closed on the left, the last on both sides."""
    q = clip(F.col(p))
    at = sum(((q >= i / bins).cast("int") for i in range(1, bins)), F.lit(0))
    b = df.groupBy(*by, at.alias("_bin")).agg(F.count("*").alias("n"), F.avg(target).alias("y"), F.avg(q).alias("q"))
    return b.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("y") - F.col("q"))) / F.sum("n")).alias("ece"))


def all_metrics(df: DataFrame, by: Sequence[str], p: str = "p", target: str = "target") -> DataFrame:
    by = list(by)
    return simple_metrics(df, by, p, target).join(auc(df, by, p, target), by).join(ece(df, by, p, target), by)


def pooled_and_by_fold(df: DataFrame, model: Sequence[str], fold: str = "fold", p: str = "p", target: str = "target") -> DataFrame:
    """Metrics by model, with a row for all folds (fold = -1) and one for each."""
    both = df.withColumn("_scope", F.explode(F.array(F.lit(-1), F.col(fold).cast("int")))).drop(fold).withColumnRenamed("_scope", fold)
    return all_metrics(both, [*model, fold], p, target)


def quantile_regime(df: DataFrame, value: str, out: str, by: Sequence[str] = (), q: int = 5) -> DataFrame:
    """q1 .. q5 by the average-rank percentile; counted by distinct value, so that ties cost nothing."""
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by).orderBy(value) if by else Window.orderBy(value)  # one row per distinct value
    every = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    upto = F.sum("_c").over(w)
    pct = (upto - F.col("_c") + (F.col("_c") + 1) / 2) / F.sum("_c").over(every)
    label = F.concat(F.lit("q"), (F.least(F.floor(pct * q), F.lit(q - 1)) + 1).cast("string"))
    return df.join(counts.withColumn(out, label).drop("_c"), [*by, value])


def scorecard(df: DataFrame, regimes: Sequence[str], by: Sequence[str] = ("protocol",), p: str = "p", target: str = "target") -> DataFrame:
    """Tidy metrics: overall, each fold and each value of each regime."""
    kinds = [F.struct(F.lit("overall").alias("regime"), F.lit("all").alias("value")), F.struct(F.lit("fold").alias("regime"), F.col("fold").cast("string").alias("value"))]
    kinds += [F.struct(F.lit(r).alias("regime"), F.col(r).cast("string").alias("value")) for r in regimes]
    long = df.withColumn("_s", F.explode(F.array(*kinds))).select(*by, "_s.*", F.col(p).alias("p"), F.col(target).alias("target"))
    return all_metrics(long, [*by, "regime", "value"])
