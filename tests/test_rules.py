"""Rules in one pass, against their meaning row by row."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from convolytics.functions import text as T
from convolytics.operators import expect, rules, sessions

A = "g string, seq int, v int, ref string"


def broken(tables, *wanted):
    return sorted((r.rule, r.key, r.at, r.rows) for r in rules.violations(tables, wanted).collect())


def brute(a, b):
    """(rule, violations) of the rules below, by Python."""
    groups = {g for g, *_ in a}
    of = lambda g: [r for r in a if r[0] == g]
    lines = lambda g: sorted((r[1] for r in of(g)), key=lambda s: (s is None, s))
    falls = lambda g: any(x[1] is not None and y[1] == x[1] + 1 and x[2] is not None and y[2] is not None and y[2] < x[2] for x in of(g) for y in of(g))
    refs, keys, places = [r[3] for r in a], [k for (k,) in b], [r[:2] for r in a]
    return {
        "unique": sum(places.count(p) > 1 for p in set(places)),
        "contiguous": sum(lines(g) != list(range(len(of(g)))) for g in groups),
        "ascending": sum(falls(g) for g in groups),
        "one_value": sum(len({r[2] for r in of(g)}) > 1 for g in groups),
        "references": sum(r is None or r not in keys for r in refs),
        "same_keys": len(set(refs) ^ set(keys)),
        "aligned": sum(refs.count(k) != 1 or keys.count(k) != 1 for k in {*refs, *keys}),
        "disjoint": len({*refs} & {*keys} - {None}),
        "rows": sum(r[2] is None or r[2] > 1 for r in a),
    }


name = st.one_of(st.none(), st.sampled_from(["x", "y", 'a","b', "a"]))
small = st.one_of(st.none(), st.integers(-1, 3))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.lists(st.tuples(name, small, small, name), max_size=8), b=st.lists(st.tuples(name), max_size=4))
def test_rules_find_what_plain_python_finds(spark, a, b):
    tables = {"a": spark.createDataFrame(a, A), "b": spark.createDataFrame(b, "k string")}
    wanted = [
        rules.unique("unique", "a", ["g", "seq"]), rules.contiguous("contiguous", "a", ["g"], "seq"), rules.ascending("ascending", "a", ["g"], "seq", F.col("v")),
        rules.one_value("one_value", "a", ["g"], F.col("v")), rules.references("references", "a", ["ref"], "b", ["k"]), rules.same_keys("same_keys", "a", ["ref"], "b", ["k"]),
        rules.aligned("aligned", "a", ["ref"], "b", ["k"]), rules.disjoint("disjoint", "a", ["ref"], "b", ["k"]), rules.rows("rows", "a", ["g"], F.col("v") > 1),
    ]
    got = {r.rule: r.violations for r in rules.summary(rules.violations(tables, wanted), wanted).collect()}
    assert got == brute(a, b)


def test_keys_and_places_are_named(spark):
    a = spark.createDataFrame([("s", 0, 5, None), ("s", 1, 4, None), ("s", 3, 9, None), ("t", 0, 1, None), ("t", 0, 1, None)], A)
    found = broken({"a": a}, rules.contiguous("turns", "a", ["g"], "seq"), rules.ascending("time", "a", ["g"], "seq", F.col("v")), rules.unique("key", "a", ["g", "seq"]))
    assert found == [("key", '["t","0"]', None, 2), ("time", '["s"]', 1, 1), ("turns", '["s"]', 3, 1), ("turns", '["t"]', 0, 2)]


def test_one_scan_a_table_and_one_shuffle(spark, tmp_path):
    spark.createDataFrame([("s", 0, 5, "k")], A).write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    wanted = [rules.unique(f"u{i}", "a", ["g", "seq"]) for i in range(5)] + [rules.contiguous("c", "a", ["g"], "seq"), rules.references("r", "a", ["ref"], "b", ["g"])]
    plan = rules.violations({"a": a, "b": a}, wanted)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_check_names_rule_count_and_a_key(spark):
    a = spark.createDataFrame([("s", 0, 5, "k"), ("s", 0, 6, "k")], A)
    with pytest.raises(expect.ExpectationFailed, match=r'key: 1 \(as \["s","0"\]\)'):
        rules.check({"a": a}, [rules.unique("key", "a", ["g", "seq"])])
    rules.check({"a": a}, [rules.rows("none", "a", ["g"], F.col("v") > 9)])


def test_rules_need_names_and_tables(spark):
    with pytest.raises(ValueError, match="names of their own"):
        rules.violations({"a": spark.range(1)}, [rules.unique("k", "a", ["id"])] * 2)
    with pytest.raises(ValueError, match="no tables: b"):
        rules.violations({"a": spark.range(1)}, [rules.references("k", "a", ["id"], "b")])


def test_licenses_are_a_rule_on_rows(spark):
    rows = [("a", "yes", "MIT"), ("b", "Yes", "CC-BY-NC-4.0"), ("c", "no", "MIT"), ("d", None, "MIT"), ("e", "yes", None)]
    tables = {"resources": spark.createDataFrame(rows, "name string, commercial_use string, license string")}
    found = broken(tables, rules.rows("licenses", "resources", ["name"], expect.forbidden_license()))
    assert [key for _, key, _, _ in found] == ['["b"]', '["c"]', '["d"]', '["e"]']


def test_replacement_of_other_rows_is_refused(spark):
    before = spark.createDataFrame([(1, "x", 5), (2, "y", 50)], "id int, v string, n int")
    after = sessions.replace_rows(before, before.withColumn("v", F.lit("new")), "id", F.col("n") > 9)
    assert {(r.id, r.v) for r in sessions.audited(before, after, F.col("n") > 9).collect()} == {(1, "x"), (2, "new")}
    with pytest.raises(expect.ExpectationFailed, match="'id': 1"):
        sessions.audited(before, after.withColumn("v", F.lit("new")), F.col("n") > 9)


def test_texts_of_queries(spark):
    t = spark.createDataFrame([(" adding \n  halves ", "head\nrest\nmore"), ("", "head"), (None, None)], "o string, c string")
    got = t.select(T.query_text("Find it", F.col("o")), T.body(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("Instruct: Find it\nQuery: adding halves", "rest\nmore"), ("Instruct: Find it\nQuery: ", ""), (None, "")]
