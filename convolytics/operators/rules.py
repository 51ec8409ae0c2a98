"""Rules over many tables in one pass: each table is read once, and one aggregation finds the keys that break a rule.

Every row gives a small record for each rule on its table. Records of a rule and key are summed before they are shuffled,
so a hot key costs one record a task. No window and no join: a turn meets the one before it as a record at its own place.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolytics.operators.expect import ExpectationFailed


@dataclass(frozen=True)
class Rule:
    """One rule. `key` and `other_key` name columns; `seq` a whole number; `value` is a numeric expression."""

    name: str
    kind: str
    table: str
    key: tuple[str, ...]
    other_table: str | None = None
    other_key: tuple[str, ...] = ()
    seq: str | None = None
    value: Column | None = None


def rows(name: str, table: str, key: Sequence[str], broken: Column) -> Rule:
    """Rows for which `broken` is true or null; reported by their key."""
    return Rule(name, "rows", table, tuple(key), value=broken)


def unique(name: str, table: str, key: Sequence[str]) -> Rule:
    """Keys of more than one row; a null is a value like others."""
    return Rule(name, "unique", table, tuple(key))


def references(name: str, table: str, key: Sequence[str], parent: str, parent_key: Sequence[str] | None = None) -> Rule:
    """Rows whose key the parent lacks; a key with a null refers to nothing."""
    return Rule(name, "references", table, tuple(key), parent, tuple(parent_key or key))


def same_keys(name: str, table: str, key: Sequence[str], other: str, other_key: Sequence[str] | None = None) -> Rule:
    """Keys that stand on one side only."""
    return Rule(name, "same_keys", table, tuple(key), other, tuple(other_key or key))


def aligned(name: str, table: str, key: Sequence[str], other: str, other_key: Sequence[str] | None = None) -> Rule:
    """Keys that don't stand just once on either side."""
    return replace(same_keys(name, table, key, other, other_key), kind="aligned")


def disjoint(name: str, table: str, key: Sequence[str], other: str, other_key: Sequence[str] | None = None) -> Rule:
    """Keys that stand on both sides; keys with a null don't count."""
    return replace(same_keys(name, table, key, other, other_key), kind="disjoint")


def contiguous(name: str, table: str, group: Sequence[str], seq: str) -> Rule:
    """Groups whose places aren't 0 to n - 1, once each; reported with the places that repeat or follow a gap."""
    return Rule(name, "contiguous", table, tuple(group), seq=seq)


def ascending(name: str, table: str, group: Sequence[str], seq: str, value: Column) -> Rule:
    """Groups in which a value is less than that at the place before; places after a gap have none before them."""
    return Rule(name, "ascending", table, tuple(group), seq=seq, value=value)


def one_value(name: str, table: str, group: Sequence[str], value: Column) -> Rule:
    """Groups with several numbers (up to 2^53), or with a number and null."""
    return Rule(name, "one_value", table, tuple(group), value=value)


def _json(key: Sequence[str]) -> Column:
    return F.to_json(F.array(*[F.col(c).cast("string") for c in key]))


def _record(rule: Rule, key: Sequence[str], when: Column | None = None, at: Column | None = None, own: Column | int = 0, other: Column | int = 0, low: Column | None = None, high: Column | None = None) -> Column:
    long = lambda x: x.cast("long") if isinstance(x, Column) else F.lit(x).cast("long")
    number = lambda x: (F.lit(None) if x is None else x).cast("double")
    one = F.struct(
        F.lit(rule.name).alias("rule"), F.lit(rule.kind).alias("kind"), _json(key).alias("key"), (F.lit(None) if at is None else at).cast("long").alias("at"),
        long(own).alias("own"), long(other).alias("other"), number(low).alias("low"), number(high).alias("high"),
    )
    return one if when is None else F.when(when, one)


def _records(rule: Rule, table: str) -> list[Column]:
    """What a row of the table gives for the rule."""
    whole = lambda key: reduce(Column.__and__, [F.col(c).isNotNull() for c in key])
    out = []
    if table == rule.table:
        if rule.kind == "rows":
            out.append(_record(rule, rule.key, F.coalesce(rule.value, F.lit(True)), own=1))
        elif rule.kind == "contiguous":
            out.append(_record(rule, rule.key, at=F.col(rule.seq), own=1, other=F.coalesce(F.col(rule.seq) == 0, F.lit(False))))
            out.append(_record(rule, rule.key, F.col(rule.seq).isNotNull(), F.col(rule.seq) + 1, other=1))
        elif rule.kind == "ascending":
            there = F.col(rule.seq).isNotNull() & rule.value.isNotNull()
            out.append(_record(rule, rule.key, there, F.col(rule.seq), own=1, low=rule.value))
            out.append(_record(rule, rule.key, there, F.col(rule.seq) + 1, other=1, high=rule.value))
        elif rule.kind == "one_value":
            out.append(_record(rule, rule.key, own=1, other=rule.value.isNull(), low=rule.value, high=rule.value))
        else:
            out.append(_record(rule, rule.key, whole(rule.key) if rule.kind == "disjoint" else None, own=1))
    if table == rule.other_table:
        out.append(_record(rule, rule.other_key, whole(rule.other_key) if rule.kind in ("references", "disjoint") else None, other=1))
    return out


def violations(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> DataFrame:
    """rule, key (a JSON list), at (the place, for rules on sequences), rows: what breaks a rule.

    One scan for each table that a rule names, whatever the number of its rules; empty tables break nothing by themselves.
    """
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("rules need names of their own")
    if lost := sorted({t for r in rules for t in (r.table, r.other_table) if t and t not in tables}):
        raise ValueError(f"no tables: {', '.join(lost)}")
    parts = []
    for name, df in tables.items():
        if given := [c for r in rules for c in _records(r, name)]:
            parts.append(df.select(F.explode(F.array_compact(F.array(*given))).alias("r")).select("r.*"))
    sums = [F.sum("own").alias("own"), F.sum("other").alias("other"), F.min("low").alias("low"), F.max("high").alias("high")]
    met = reduce(DataFrame.unionByName, parts).groupBy("rule", "kind", "key", "at").agg(*sums)
    own, other, low, high = (F.col(c) for c in ("own", "other", "low", "high"))
    broken = {
        "rows": own > 0, "unique": own > 1, "references": (own > 0) & (other == 0), "same_keys": (own > 0) != (other > 0), "aligned": (own != 1) | (other != 1),
        "disjoint": (own > 0) & (other > 0), "contiguous": (own > 0) & ((own > 1) | (other == 0)), "ascending": (own > 0) & (high > low), "one_value": (low != high) | ((other > 0) & (other < own)),
    }
    return met.where(reduce(Column.__or__, [(F.col("kind") == k) & c for k, c in broken.items()])).select("rule", "kind", "key", "at", F.col("own").alias("rows"))


def summary(found: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, violations, example: rows for rules on rows and references, else keys; rules that hold have 0 and no example."""
    per = found.groupBy("rule", "kind").agg(F.sum("rows").alias("_rows"), F.count_distinct("key").alias("_keys"), F.min("key").alias("example"))
    counted = per.select("rule", F.when(F.col("kind").isin("rows", "references"), F.col("_rows")).otherwise(F.col("_keys")).alias("violations"), "example")
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(r.name).alias("rule")) for i, r in enumerate(rules)])).alias("r")
    every = found.sparkSession.range(1).select(named).select("r.*")
    return every.join(counted, "rule", "left").select("nth", "rule", F.coalesce("violations", F.lit(0).cast("long")).alias("violations"), "example")


def check(tables: Mapping[str, DataFrame], rules: Sequence[Rule]) -> None:
    """Raises where a rule is broken, with the violations and one key of each, in the order of the rules."""
    if bad := sorted((r.nth, r.rule, r.violations, r.example) for r in summary(violations(tables, rules), rules).where("violations > 0").collect()):
        raise ExpectationFailed(", ".join(f"{name}: {n} (as {key})" for _, name, n, key in bad))
