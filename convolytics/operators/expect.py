"""Data-quality rules: each gives (rule, violations) rows; check() raises on any violation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class ExpectationFailed(ValueError):
    pass


def columns_present(df: DataFrame, needed: Sequence[str]) -> None:
    if missing := sorted(set(needed) - set(df.columns)):
        raise ExpectationFailed(f"missing columns: {', '.join(missing)}")


def exact_columns(df: DataFrame, wanted: Sequence[str]) -> None:
    if df.columns != list(wanted):
        raise ExpectationFailed(f"columns are {df.columns}, not {list(wanted)}")


def _rule(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")


def row_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rules on single rows, in one pass; a rule's column is true for a row that breaks it."""
    one = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])).alias("r")).select("r.*")


def unique(df: DataFrame, keys: Sequence[str], name: str = "unique") -> DataFrame:
    return _rule(name, df.groupBy(*keys).count().where("count > 1"))


def same_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], name: str = "same_keys") -> DataFrame:
    left, right = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    return _rule(name, left.join(right, list(keys), "full_outer").where("_a is null or _b is null"))


def references(child: DataFrame, parent: DataFrame, keys: Sequence[str], name: str = "references") -> DataFrame:
    return _rule(name, child.join(parent.select(*keys).distinct(), list(keys), "left_anti"))


def contiguous(df: DataFrame, group: str, seq: str, name: str = "contiguous") -> DataFrame:
    g = df.groupBy(group).agg(F.min(seq).alias("lo"), F.max(seq).alias("hi"), F.count("*").alias("n"), F.count_distinct(seq).alias("d"))
    return _rule(name, g.where("not (lo = 0 and hi = n - 1 and d = n)"))


def monotone(df: DataFrame, group: str, order: Sequence[str], value: Column, name: str = "monotone") -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return _rule(name, df.withColumn("_v", value).withColumn("_p", F.lag("_v").over(w)).where("_p > _v"))


def one_value_per_group(df: DataFrame, group: str, value: str, name: str = "one_value_per_group") -> DataFrame:
    return _rule(name, df.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo <> hi"))


def disjoint(a: DataFrame, b: DataFrame, key: str, name: str = "disjoint") -> DataFrame:
    return _rule(name, a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi"))


def same_cardinality(df: DataFrame, group: str, key: str, name: str = "same_cardinality") -> DataFrame:
    n = df.groupBy(group).agg(F.count_distinct(key).alias("n")).agg(F.count_distinct("n").alias("k"))
    return n.select(F.lit(name).alias("rule"), (F.col("k") - 1).alias("violations"))


def forbidden_license(commercial: str = "commercial_use", license_col: str = "license") -> Column:
    """True for a row whose license doesn't say yes to commercial use, or has NC in it; nulls are no yes."""
    return ~F.coalesce((F.lower(commercial) == "yes") & ~F.upper(license_col).contains("NC"), F.lit(False))


def finite(vector: str) -> Column:
    """True for a row whose vector holds a null, NaN or infinite value."""
    return F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def all_of(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def check(rules: DataFrame) -> None:
    if broken := rules.where("violations > 0").collect():
        raise ExpectationFailed(", ".join(f"{r.rule}: {r.violations}" for r in broken))


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str], name: str = "aligned") -> DataFrame:
    """Both sides have the keys once each, and the same ones."""
    either = unique(a, keys).unionByName(unique(b, keys)).unionByName(same_keys(a, b, keys))
    return either.agg(F.sum("violations").alias("violations")).select(F.lit(name).alias("rule"), "violations")


def purged(pairs: DataFrame, folded: DataFrame, keys: Sequence[str], name: str = "purged") -> DataFrame:
    """Keys that stand on both sides of a fold, over all folds: pairs has the training rows by eval_fold."""
    held = folded.withColumnRenamed("fold", "eval_fold")
    both = [pairs.select("eval_fold", k).distinct().join(held.select("eval_fold", k).distinct(), ["eval_fold", k]).select(F.lit(k).alias("key")) for k in keys]
    return _rule(name, reduce(DataFrame.unionByName, both))


def row_counts(recorded: DataFrame, found: DataFrame, key: str, name: str = "row_counts") -> DataFrame:
    """Tables whose number of rows isn't the recorded one; both sides have key and rows."""
    both = recorded.select(key, F.col("rows").alias("_a")).join(found.select(key, F.col("rows").alias("_b")), key, "full_outer")
    return _rule(name, both.where("not (_a <=> _b)"))


def matches(pattern: str, text: Column) -> Column:
    """True for a row whose text isn't all of the pattern."""
    return ~F.coalesce(text.rlike(f"^(?:{pattern})$"), F.lit(False))


def identical_settings(runs: DataFrame, settings: Sequence[str], fold: str = "fold", k: int = 5, name: str = "identical_settings") -> DataFrame:
    """Runs by fold have one setting, and each fold from 0 to k - 1 once."""
    n = runs.agg(F.count_distinct(F.struct(*settings)).alias("s"), F.count_distinct(F.when(F.col(fold).between(0, k - 1), F.col(fold))).alias("f"), F.count("*").alias("n"))
    return n.select(F.lit(name).alias("rule"), (F.greatest(F.col("s") - 1, F.lit(0)) + (k - F.col("f")) + (F.col("n") - F.col("f"))).alias("violations"))


def complete(df: DataFrame, column: str, wanted: Sequence[str], name: str = "complete") -> DataFrame:
    """Values that the column should have and hasn't, or has and shouldn't."""
    have = df.agg(F.collect_set(F.col(column).cast("string")).alias("h"))
    listed = F.array(*map(F.lit, wanted))
    return have.select(F.lit(name).alias("rule"), (F.size(F.array_except(listed, "h")) + F.size(F.array_except("h", listed))).cast("long").alias("violations"))


def single_value(df: DataFrame, column: str, name: str = "single_value") -> DataFrame:
    return df.agg(F.count_distinct(column).alias("n")).select(F.lit(name).alias("rule"), F.abs(F.col("n") - 1).alias("violations"))
