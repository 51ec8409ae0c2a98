"""Literal cases of the operators."""

import pytest
from pyspark.sql import functions as F

from convolytics import queries
from convolytics.functions import text as T
from convolytics.operators import ensembles, expect, metrics, ordered, retrieval, splits

SMALL = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_stemming_and_terms(spark):
    assert value(spark, T.tokens(F.lit("Learning carried dishes objects sing"))) == ["learn", "carry", "dish", "object", "sing"]
    assert value(spark, T.terms(F.lit("learning objects using halves"))) == ["object", "halv"]


def test_seconds(spark):
    s = lambda x: value(spark, T.seconds(F.lit(x)))
    assert s("30:01:02") == 108062 and s("1:60:00") is None and s("1:2") is None and s("a:0:0") is None


def test_parse_lines_and_hypothesis(spark):
    view = spark.createDataFrame([(1, "[TUTOR] Hi\n\n more \n[STUDENT] Yes")], "id int, view string")
    lines = T.view_lines(view, "id", "view").orderBy("at").collect()
    assert [(x.role, x.content) for x in lines] == [("tutor", "Hi"), ("unknown", "more"), ("student", "Yes")]
    assert value(spark, T.hypothesis(F.lit("  Adding   fractions. "))).endswith("objective: Adding fractions.")


def test_stems_of_a_whole_text_are_those_of_its_words(spark):
    words = [a + b for a in ("", "a", "ab", "abc", "abcd", "abcdi", "sing", "9x") for b in ("", "s", "es", "ed", "ied", "ing", "ings", "ies", "eds")]
    text = ", ".join(words).upper() + " e\u00e9ding x"
    rows = spark.createDataFrame([(text,)], "t string")
    by_word = F.transform(F.regexp_extract_all(F.lower("t"), F.lit(T.TOKEN), 0), T.stem)
    assert rows.where(T.tokens(F.col("t")) == by_word).count() == 1


def test_cues_count_whole_words(spark):
    assert value(spark, T.cue_count(F.lit("Great! not great? greatest; well done"), T.SESSION_CUES["affirm"])) == 3


def test_repair_features(spark):
    text = "[TUTOR] Represent one half.\n[STUDENT] maybe one\n[TUTOR] Not quite, try again.\n[STUDENT] one half is two quarters\n[TUTOR] Correct!"
    texts = spark.createDataFrame([("s", text)], "session_id string, full_text string")
    r = spark.createDataFrame([(1, "s", "Represent one half as two quarters"), (2, "none", "x")], "response_id int, session_id string, objective string")
    a, b = ordered.ordered_features(texts, r).orderBy("response_id").collect()
    assert a.ordered_repair_opportunities == a.ordered_repair_overlap_improved == a.ordered_repair_later_affirm == 1
    assert a.ordered_student_objective_delta > 0 and b.ordered_dialogue_turns == 0 and b.ordered_last_affirm_position == -1


def test_retrieval_falls_back_to_both_ends(spark):
    texts = spark.createDataFrame([("s", "\n".join(f"[TUTOR] line {i}" for i in range(50)))], "session_id string, full_text string")
    r = spark.createDataFrame([(1, "s", "calculating circumference")], "response_id int, session_id string, objective string")
    kept = retrieval.retrieve(retrieval.scored_lines(texts, r))
    assert sorted(x.idx for x in kept.collect()) == [*range(18), *range(32, 50)]


def test_better_probabilities_have_better_metrics(spark):
    df = spark.createDataFrame([(m, y, p) for m, ps in (("a", (0.1, 0.2, 0.8, 0.9)), ("b", (0.5,) * 4)) for y, p in zip((0, 0, 1, 1), ps, strict=True)], "model string, target int, p double")
    m = {r.model: r for r in metrics.all_metrics(df, ["model"]).collect()}
    assert m["a"].log_loss < m["b"].log_loss and m["a"].auc == 1 and m["b"].auc == 0.5 and m["b"].ece == 0


def test_auc_is_null_for_one_class(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.7)], "model string, target int, p double")
    assert metrics.auc(df, ["model"]).first().auc is None


def test_priors_leave_the_fold_out(spark):
    rows = [(0, "a", "x", 1), (0, "a", "y", 0), (1, "b", "x", 1), (1, "b", "y", 1), (2, "c", "x", 0), (2, "c", "z", 0)]
    df = spark.createDataFrame(rows, "fold int, session_id string, objective_id string, target int")
    out = splits.priors_leave_fold_out(df, alpha=2.0).where("fold = 0").collect()
    assert {r.global_prior for r in out} == {0.5} and all(0 <= r.objective_prior <= 1 for r in out)


def test_labels_of_a_fold_do_not_change_its_priors(spark):
    rows = [(i % 3, f"s{i}", f"o{i % 2}", i % 2) for i in range(12)]
    p = lambda rs: {(r.session_id): r.objective_prior for r in splits.priors_leave_fold_out(spark.createDataFrame(rs, "fold int, session_id string, objective_id string, target int")).where("fold = 0").collect()}
    assert p(rows) == p([(f, s, o, 1 - y if f == 0 else y) for f, s, o, y in rows])


def test_sample_is_exact_and_repeats(spark):
    df = spark.createDataFrame([(i, int(i >= 60)) for i in range(100)], "candidate int, target int")
    ids = [sorted(r.candidate for r in splits.stratified_sample(df, ["target"], 20, "candidate").collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(ids[0]) == 20 and sum(i < 60 for i in ids[0]) == 12


def test_agreement_gate(spark):
    rows = [(0.5, 0.4, 0.6, 0.7, 0.65), (0.5, 0.4, 0.6, 0.3, 0.45), (0.5, 0.6, 0.4, 0.3, 0.35), (0.5, 0.6, 0.4, 0.7, 0.55)]
    df = spark.createDataFrame(rows, "v02 double, semantic double, bge_base double, nbsvm double, combined double")
    agrees, gated = ensembles.agreement_gate()
    assert [tuple(r) for r in df.select(agrees, gated).collect()] == [(True, 0.65), (False, 0.5), (True, 0.35), (False, 0.5)]


def test_audit_sees_folds_and_regimes(spark):
    rows = [("base", r, v, n, 0.6, 0.6) for r, v, n in (("overall", "all", 900), *(("fold", str(f), 180) for f in range(5)), ("length", "q1", 100), ("length", "q2", 99), ("session_objectives", "one", 500))]
    change = {("overall", "all"): -0.01, ("fold", "0"): -0.1, ("fold", "1"): -0.1, ("length", "q1"): 0.002, ("length", "q2"): 0.3, ("session_objectives", "one"): 0.3}
    rows += [("new", r, v, n, loss + change.get((r, v), 0.001), auc) for _, r, v, n, loss, auc in rows]
    card = spark.createDataFrame([("p0", *r) for r in rows], "protocol string, model string, regime string, value string, rows long, log_loss double, auc double")
    got = ensembles.audit_scorecard(card, "base").first()
    assert (got.gain_gate, got.all_gate, got.win_gate, got.regression_gate) == (True, True, False, False)
    assert got.fold_loss_wins == pytest.approx(0.4) and got.worst_regime == pytest.approx(0.002) and got.worst_fold == pytest.approx(0.001)
    small = ensembles.audit_scorecard(card.where("rows <> 100"), "base").first()
    assert small.worst_regime is None and small.regression_gate is False


def test_queries_have_the_reference_limits(spark, monkeypatch):
    fits, real = [], splits.KMeans
    monkeypatch.setattr(splits, "KMeans", lambda **a: fits.append(a) or real(**a))
    queries.QUERIES["family_folds"](spark, SMALL)
    assert len(fits) == 20 and {a["maxIter"] for a in fits} == {500}
    got = {r.response_id: r for r in queries.QUERIES["objective_contexts"](spark, SMALL).collect()}
    assert max(r.selected for r in got.values()) > 4
    assert all(r.selected == min(r.lines, 36) for r in got.values() if r.positive_lines == 0)
    assert all(r.selected >= min(r.positive_lines, 24) for r in got.values())


def test_check_raises(spark):
    df = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(expect.ExpectationFailed, match="unique: 1"):
        expect.check(expect.unique(df, ["k"]))
    with pytest.raises(expect.ExpectationFailed, match="missing columns: z"):
        expect.columns_present(df, ["k", "z"])
