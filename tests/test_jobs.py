"""Whole jobs on small literal tables."""

import pytest
from pyspark.sql import functions as F

from convolytics.operators import expect, jobs, models, splits
from convolytics.plans import job_queries
from convolytics.sources import sinks


def made(spark, n=40):
    rows = [(i, f"s{i // 2}", f"o{i % 4}", "adding halves", i % 2, float(i % 2) + 0.1 * (i % 3), i // 2 % 5) for i in range(n)]
    return spark.createDataFrame(rows, "response_id int, session_id string, objective_id string, objective string, target int, x double, fold int")


def test_validation_fits_measures_and_blends(spark, tmp_path):
    parts = {"global_prior": jobs.global_predictions, "x": lambda n: models.numeric_logistic(["x"], n=n)}
    out = jobs.validation({"one": made(spark)}, parts, "global_prior", str(tmp_path))
    assert out["oof"].groupBy("model").count().where("count <> 40").count() == 0
    loss = {r.model: r.log_loss for r in out["metrics"].where("fold = -1").collect()}
    assert loss["x"] < loss["global_prior"] and out["metrics"].count() == 12
    assert out["deltas"].first().promoted and out["blends"].first().weight > 0.5
    assert {r.model: r.weight for r in out["shrinkage"].collect()}["x"] > 0.5


def test_validation_refuses_predictions_that_repeat(spark, tmp_path):
    twice = lambda rows: rows.union(rows).select("response_id", "fold", "target", F.lit(0.5).alias("p"))
    twice.predictions = True
    with pytest.raises(expect.ExpectationFailed, match="predictions"):
        jobs.validation({"one": made(spark)}, {"a": twice}, "a", str(tmp_path))


def test_penalties_come_from_the_rows_fitted(spark):
    seen = []

    def part(n):
        seen.append(n)
        return models.numeric_logistic(["x"], n=n)

    assert models.out_of_fold(made(spark), part).count() == 40
    assert seen == [32] * 5


def test_foundation_refuses_gaps_and_lost_sessions(spark, tmp_path):
    u = spark.createDataFrame([("s0", 0, "tutor", "hi", "0:0:1"), ("s0", 2, "student", "yes", "0:0:2")], "session_id string, utterance_id int, role string, content string, timestamp string")
    r = made(spark).drop("fold", "x")
    with pytest.raises(expect.ExpectationFailed, match="contiguous: 1.*sessions: 38"):
        jobs.foundation(u, r, str(tmp_path))


def test_foundation_refuses_turns_that_go_back_in_time(spark, tmp_path):
    u = spark.createDataFrame([("s0", 0, "tutor", "hi", "0:0:5"), ("s0", 1, "student", "yes", "0:0:2")], "session_id string, utterance_id int, role string, content string, timestamp string")
    with pytest.raises(expect.ExpectationFailed, match="time order: 1"):
        jobs.foundation(u, made(spark).drop("fold", "x"), str(tmp_path))


def test_audit_refuses_repeated_rows(spark, tmp_path):
    p = made(spark).select(F.lit("p0").alias("protocol"), "response_id", "target", "fold", F.lit(0.5).alias("a"), F.lit(0.4).alias("b"))
    with pytest.raises(expect.ExpectationFailed, match="predictions: 40"):
        jobs.candidate_audit(p.union(p), made(spark).select("response_id", F.lit("q1").alias("r")), "a", "b", 0.3, ["r"], str(tmp_path))


def test_named_jobs_name_their_models():
    names = ["baselines", "hard", "role", "retrieval", "robust", "semantic", "encoder", "multiview", "feedback", "nbsvm", "session_weight", "dense_tree"]
    parts = {n: set(job_queries.validation_parts(n, None, "")) - {"global_prior", "objective_prior"} for n in names}
    assert all(parts.values()) and parts["role"] == {"role"} and parts["retrieval"] == {"retrieval"} and parts["multiview"] == {"multiview"}
    with pytest.raises(ValueError, match="unknown job"):
        job_queries.validation_parts("none", None, "")


def test_runs_add_to_one_ledger_and_report(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    for run in ("r1", "r2"):
        out = jobs.baselines(made(spark).drop("fold"), str(tmp_path / run), ledger)
    rows = spark.read.parquet(ledger)
    assert rows.columns == sinks.LEDGER and rows.count() == 8 and out["ledger"].count() == 4
    assert {(r.run_id, r.model, r.fold_scheme, r.status) for r in rows.collect()} == {(run, m, p, "completed") for run in ("r1", "r2") for m in ("global_prior", "objective_prior") for p in ("session", "objective")}
    pooled = {(r.protocol, r.model): r.log_loss for r in out["metrics"].where("fold = -1").collect()}
    assert {(r.fold_scheme, r.model): r.log_loss for r in out["ledger"].collect()} == pooled
    report = spark.read.json(str(tmp_path / "r2" / "report")).collect()
    assert [r.run_id for r in report] == ["r2"] and report[0].settings.models == "global_prior,objective_prior"
    assert len(report[0].folds) == out["metrics"].where("fold >= 0").count()
    assert {t.protocol: t.log_loss for t in report[0].top_models} == {p: min(v for (q, _), v in pooled.items() if q == p) for p in ("session", "objective")}
    priors = {r.objective_id: (r.prior, r.global_prior) for r in out["objective_priors"].collect()}
    assert priors["o1"] == pytest.approx(((10 + 20 * 0.5) / (10 + 20), 0.5)) and len(priors) == 4


def related(spark):
    """20 objectives in four directions, whatever their length; two responses of a session for each."""
    at = {0: (1.0, 0.0), 1: (0.0, 1.0), 2: (-1.0, 0.0), 3: (0.0, -1.0)}
    objectives = [(f"o{i}", [x * (1 + 50 * (i % 3)) + 0.001 * i for x in at[i % 4]]) for i in range(20)]
    rows = [(i, f"s{i // 2}", f"o{i % 20}", i % 3 % 2) for i in range(80)]
    return spark.createDataFrame(rows, "response_id int, session_id string, objective_id string, target int"), spark.createDataFrame(objectives, "objective_id string, vector array<double>")


def test_families_are_found_by_direction_and_share_a_fold(spark):
    rows, objectives = related(spark)
    families = splits.objective_families(objectives, 4, 7, tries=5)
    assert families.groupBy("family").agg(F.collect_set(F.expr("int(substring(objective_id, 2)) % 4")).alias("of")).where("size(of) > 1").count() == 0
    folded = splits.family_folds(rows, objectives, 4, folds=4, tries=5)
    first = {r.family: r.fold for r in splits.first_fold(folded).collect()}
    assert all(first[r.family] == r.fold for r in folded.collect()) and len(first) == 4


def test_families_are_protocols_of_a_job(spark, tmp_path):
    rows, objectives = related(spark)
    protocols = splits.family_protocols(rows, objectives, {"a": (6, 1, 1), "b": (8, 2, 3)}, tries=3)
    out = jobs.validation(protocols, {"global_prior": jobs.global_predictions, "objective_prior": jobs.prior_predictions()}, "global_prior", str(tmp_path))
    assert {r.protocol for r in out["metrics"].collect()} == {"a", "b"} and out["oof"].count() == 320
    with pytest.raises(ValueError, match="3 families for 5 folds"):
        splits.family_protocols(rows, objectives, {"a": (3, 1, 1)})


def test_leakage_counts_keys_of_both_sides(spark):
    rows = [(0, "s0", "o0", 0), (1, "s1", "o1", 0), (2, "s2", "o0", 1), (3, "s3", None, 1), (4, "s4", None, 0)]
    folded = spark.createDataFrame(rows, "response_id int, session_id string, objective_id string, fold int")
    got = {r.rule: r.violations for r in jobs.leakage(folded, ["session_id", "objective_id"], folds=2).collect()}
    assert got == {"session_id leakage": 0, "objective_id leakage": 2}  # o0, for either fold; nulls are no objective


def test_pilot_tries_encoders_on_a_balanced_sample(spark, tmp_path):
    rows = made(spark, 200).select("response_id", "session_id", "target", "fold")
    told = lambda x: models.as_vector(rows.select("response_id", F.array(x.cast("double"), F.lit(1.0)).alias("v")), "v", "vector").select("response_id", "vector")
    encoders = {"old": told(F.col("response_id") % 7), "new": told(F.col("target") + F.col("response_id") % 3)}
    out = jobs.encoder_pilot(rows, encoders, "new", "old", str(tmp_path), c_values=(0.01, 1.0), n=100)
    assert {(r.fold, r.target, r["count"]) for r in out["sample"].groupBy("fold", "target").count().collect()} == {(f, t, 10) for f in range(5) for t in (0, 1)}
    assert out["oof"].groupBy("encoder", "c").count().where("count <> 100").count() == 0 and out["metrics"].count() == 4
    best = {r.encoder: r for r in out["best"].collect()}
    assert best["new"].log_loss == min(r.log_loss for r in out["metrics"].collect() if r.encoder == "new")
    decision = out["decision"].first()
    assert decision.go_on and decision.delta_log_loss == pytest.approx(best["new"].log_loss - best["old"].log_loss, abs=1e-6)
    assert jobs.ensembles.encoder_decision(out["best"], "old", "new").first().go_on is False
    with pytest.raises(expect.ExpectationFailed, match="no encoder none"):
        jobs.encoder_pilot(rows, encoders, "none", "old", str(tmp_path / "a"))
    with pytest.raises(expect.ExpectationFailed, match="vectors of old: 1"):
        jobs.encoder_pilot(rows, {**encoders, "old": encoders["old"].where("response_id <> 3")}, "new", "old", str(tmp_path / "b"), n=1000)
