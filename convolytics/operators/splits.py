"""Group-disjoint folds, purging, priors that leave the fold out, exact stratified samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolytics.sources import sinks


def _drawn(seed: int, *cols: str):
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def group_folds(df: DataFrame, group: str, target: str = "target", k: int = 5, seed: int = 7) -> DataFrame:
    """df with fold: groups stay whole; groups alike in size and positives are dealt round, in order of a hash.

    Dealing runs within (rows, positives, first hex digit of the hash), so that no window holds all groups of a stratum.
    """
    g = df.groupBy(group).agg(F.count("*").alias("_n"), F.sum(target).alias("_pos")).withColumn("_h", _drawn(seed, group))
    w = Window.partitionBy("_n", "_pos", F.substring("_h", 1, 1)).orderBy("_h")
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", "_n", "_pos", F.substring("_h", 1, 1))), 1, 6), 16, 10).cast("long")
    g = g.withColumn("fold", ((F.row_number().over(w) + offset) % k).cast("int"))
    return df.join(g.select(group, "fold"), group)


def purged_pairs(df: DataFrame, purge: str = "session_id", k: int = 5, held: DataFrame | None = None) -> DataFrame:
    """(eval_fold, row) of all training rows, long: other folds, sessions of the fold purged. held: all rows, if df has only a part."""
    long = df.withColumn("eval_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).where("eval_fold <> fold")
    return long.join((df if held is None else held).select(F.col("fold").alias("eval_fold"), purge).distinct(), ["eval_fold", purge], "left_anti")


def fold_summary(df: DataFrame, k: int = 5, family: str | None = None) -> DataFrame:
    """Figures of each fold and of the training rows purged for it; with the families in it, if a column names them."""
    train = purged_pairs(df, k=k).groupBy(F.col("eval_fold").alias("fold")).agg(F.count("*").alias("train_rows"), F.avg("target").alias("train_prior"))
    own = df.groupBy("fold").agg(F.count("*").alias("rows"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("objective_id").alias("objectives"), F.avg("target").alias("positive_rate"), *([F.count_distinct(family).alias("families")] if family else []))
    return own.join(train, "fold", "left")


def priors_leave_fold_out(df: DataFrame, objective: str = "objective_id", alpha: float = 20.0) -> DataFrame:
    """df with global_prior and objective_prior, from all other folds: totals less those of the fold, no self-join."""
    per = df.groupBy("fold", objective).agg(F.sum("target").alias("y"), F.count("*").alias("n"))
    folds = df.groupBy("fold").agg(F.sum("target").alias("fy"), F.count("*").alias("fn"))
    totals = folds.agg(F.sum("fy").alias("ty"), F.sum("fn").alias("tn"))
    folds = folds.crossJoin(totals).select("fold", ((F.col("ty") - F.col("fy")) / (F.col("tn") - F.col("fn"))).alias("global_prior"))
    whole = per.groupBy(objective).agg(F.sum("y").alias("oy"), F.sum("n").alias("on"))
    prior = per.join(whole, objective).join(folds, "fold").select("fold", objective, "global_prior", ((F.col("oy") - F.col("y") + alpha * F.col("global_prior")) / (F.col("on") - F.col("n") + alpha)).alias("objective_prior"))
    return df.join(prior, ["fold", objective])


def objective_priors(df: DataFrame, objective: str = "objective_id", alpha: float = 20.0) -> DataFrame:
    total = df.agg(F.avg("target").alias("global_prior"))
    return df.groupBy(objective).agg(F.sum("target").alias("y"), F.count("*").alias("n")).crossJoin(total).select(objective, "n", "global_prior", ((F.col("y") + alpha * F.col("global_prior")) / (F.col("n") + alpha)).alias("prior"))


def with_prior(df: DataFrame, priors: DataFrame, objective: str, default: float, least: float = 1e-6) -> DataFrame:
    """df with probability: the objective's prior, or default; works on batches and streams alike."""
    return df.join(priors.select(objective, "prior"), objective, "left").withColumn("probability", F.least(F.greatest(F.coalesce("prior", F.lit(default)), F.lit(least)), F.lit(1 - least))).drop("prior")


def stratified_sample(df: DataFrame, strata: Sequence[str], n: int, key: str, seed: int = 7) -> DataFrame:
    """Exactly n rows (all, if fewer): quotas by largest remainder, within a stratum the least hashes."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_size"))
    total = sizes.agg(F.sum("_size").alias("_total"))
    sizes = sizes.crossJoin(total).withColumn("_exact", F.col("_size") * F.least(F.lit(n), F.col("_total")) / F.col("_total")).withColumn("_floor", F.floor("_exact"))
    left = sizes.agg((F.least(F.lit(n), F.max("_total")) - F.sum("_floor")).alias("_left"))
    by = Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), *strata)  # one row per stratum
    quota = sizes.crossJoin(left).withColumn("_quota", F.col("_floor") + (F.row_number().over(by) <= F.col("_left")).cast("long")).select(*strata, "_quota")
    own = Window.partitionBy(*strata).orderBy(_drawn(seed, key), key)
    return df.join(quota, list(strata)).withColumn("_nth", F.row_number().over(own)).where("_nth <= _quota").drop("_nth", "_quota")


# The protocols of a sweep: families, cluster seed, fold seed.
PROTOCOLS = {
    "semantic_k25_s0": (25, 20260716, 20260716),
    "semantic_k50_s0": (50, 20260716, 20260717),
    "semantic_k50_s1": (50, 20260717, 20260718),
    "semantic_k80_s0": (80, 20260716, 20260719),
}


def objective_families(objectives: DataFrame, k: int, seed: int, tries: int = 20, vector: str = "vector", objective: str = "objective_id") -> DataFrame:
    """objective_id, family: k-means on the unit vectors of objectives (one row each), the best of several tries by cost."""
    n = objectives.count()
    if k > n:
        raise ValueError(f"{k} families of {n} objectives")
    whole = objectives.select(objective, array_to_vector(vector).alias("_given"))
    rows = sinks.materialize(Normalizer(inputCol="_given", outputCol="_v").transform(whole).select(objective, "_v"), "objectives")
    fits = [KMeans(k=k, seed=seed + i, maxIter=500, featuresCol="_v", predictionCol="family").fit(rows) for i in range(tries)]
    return min(fits, key=lambda m: m.summary.trainingCost).transform(rows).select(objective, "family")


def first_fold(df: DataFrame, group: str = "family") -> DataFrame:
    """The group's first fold; folds of whole groups have no other."""
    return df.groupBy(group).agg(F.min("fold").alias("fold"))


def family_folds(df: DataFrame, objectives: DataFrame, k: int, cluster_seed: int = 7, fold_seed: int = 7, folds: int = 5, tries: int = 20) -> DataFrame:
    """df with family and fold: whole families of like objectives share a fold. Purge sessions with purged_pairs."""
    if k < folds:
        raise ValueError(f"{k} families for {folds} folds")
    return group_folds(df.join(objective_families(objectives, k, cluster_seed, tries), "objective_id"), "family", k=folds, seed=fold_seed)


def family_protocols(df: DataFrame, objectives: DataFrame, protocols: Mapping[str, tuple[int, int, int]] = PROTOCOLS, folds: int = 5, tries: int = 20) -> dict[str, DataFrame]:
    """family_folds of each protocol by name, as jobs.validation takes them."""
    return {name: family_folds(df, objectives, k, c, f, folds, tries) for name, (k, c, f) in protocols.items()}
