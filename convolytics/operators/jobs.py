"""Whole jobs: the foundation tables, a report on them, the validation of models over protocols, a candidate's audit."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolytics.functions import text as T
from convolytics.operators import ensembles, expect, metrics, models, rules, sessions, splits
from convolytics.sources import sinks

FOUNDATION = ("utterances", "session_features", "session_texts", "modeling_base", "response_folds")


def _reread(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    sinks.write_table(df, path, partition_by)
    return df.sparkSession.read.parquet(path)


def foundation_rules() -> list[rules.Rule]:
    """What utterances and responses must keep, for rules.check or rules.violations."""
    return [
        rules.unique("utterance key", "utterances", ["session_id", "utterance_id"]),
        rules.contiguous("contiguous", "utterances", ["session_id"], "utterance_id"),
        rules.ascending("time order", "utterances", ["session_id"], "utterance_id", T.seconds(F.col("timestamp"))),
        rules.unique("response key", "responses", ["response_id"]),
        rules.references("sessions", "responses", ["session_id"], "utterances"),
        rules.rows("target", "responses", ["response_id"], ~F.col("target").isin(0, 1)),
        rules.rows("objective", "responses", ["response_id"], F.col("objective").isNull()),
    ]


def foundation(utterances: DataFrame, responses: DataFrame, folder: str, closing: float = 0.25, folds: int = 5, seed: int = 7) -> dict[str, DataFrame]:
    """The tables that all other jobs read, checked, written below folder and read again, by name.

    Raises where an utterance's key repeats, turns have gaps or go back in time, a response has no session, no objective or another target
    than 0 or 1.
    """
    rules.check({"utterances": utterances, "responses": responses}, foundation_rules())
    out = {"utterances": _reread(utterances, f"{folder}/utterances")}
    out["session_features"] = _reread(sessions.session_features(out["utterances"]), f"{folder}/session_features")
    out["session_texts"] = _reread(sessions.session_texts(out["utterances"], closing), f"{folder}/session_texts")
    base = sessions.modeling_base(splits.group_folds(responses, "session_id", k=folds, seed=seed), out["session_features"])
    out["modeling_base"] = _reread(base, f"{folder}/modeling_base", ["fold"])
    out["response_folds"] = _reread(out["modeling_base"].select("response_id", "session_id", "fold"), f"{folder}/response_folds")
    return out


def table_sizes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """name, rows of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()])


def verification(tables: Mapping[str, DataFrame], recorded: DataFrame, folds: int = 5) -> DataFrame:
    """rule, violations of the foundation's tables; recorded has name and rows as they were written."""
    base = tables["modeling_base"]
    return expect.all_of(
        expect.row_counts(recorded, table_sizes(tables), "name", "rows of tables"),
        expect.unique(base, ["response_id"], "response key"),
        expect.row_rules(base, {"target": ~F.col("target").isin(0, 1)}),
        expect.complete(base, "fold", [str(f) for f in range(folds)], "folds"),
        expect.one_value_per_group(base, "session_id", "fold", "one fold a session"),
        expect.aligned(base, tables["response_folds"], ["response_id", "fold"], "folds of responses"),
    )


def protocols(responses: DataFrame, folds: int = 5, seed: int = 7) -> dict[str, DataFrame]:
    """Folds of whole sessions, and of whole objectives, whose training rows are purged of a fold's sessions."""
    return {name: splits.group_folds(responses, f"{name}_id", k=folds, seed=seed) for name in ("session", "objective")}


def leakage(folded: DataFrame, keys: Sequence[str], folds: int = 5, purge: str = "session_id") -> DataFrame:
    """rule, violations: keys that a fold shares with the training rows purged for it, all keys in one pass."""
    given = {"train": splits.purged_pairs(folded, purge, folds), "held": folded}
    wanted = [rules.disjoint(f"{key} leakage", "train", ["eval_fold", key], "held", ["fold", key]) for key in keys]
    return rules.summary(rules.violations(given, wanted), wanted).select("rule", "violations")


def validation(protocols: Mapping[str, DataFrame], parts: Mapping[str, Callable | object], baseline: str, folder: str, blend_weights: Sequence[float] = tuple(i / 100 for i in range(101)), run_id: str | None = None, ledger: str | None = None) -> dict[str, DataFrame]:
    """Models over protocols: predictions, metrics, their deltas, blends and shrinkage, written below folder, by name.

    A finished run adds one row a protocol and model to the ledger (a table shared by runs, else one below folder) and one
    line to folder's report, with its settings, figures by fold and the best model of each protocol.

    protocols: rows with response_id, session_id, target and fold; parts: what models.out_of_fold fits, or a function
    predictions(rows) -> response_id, fold, target, p marked by `predictions = True`. Each prediction is made once, then
    all figures come from the written table. baseline names a part.
    """
    found = []
    for protocol, rows in protocols.items():
        for model, part in parts.items():
            p = part(rows) if getattr(part, "predictions", False) else models.out_of_fold(rows, part)
            found.append(p.select(F.lit(protocol).alias("protocol"), F.lit(model).alias("model"), "response_id", "fold", "target", "p"))
    oof = _reread(reduce(DataFrame.unionByName, found), f"{folder}/oof")
    expect.check(expect.all_of(expect.unique(oof, ["protocol", "model", "response_id"], "predictions"), expect.same_cardinality(oof, "model", "response_id", "responses of models")))
    whole = metrics.pooled_and_by_fold(oof, ["protocol", "model"])
    out = {"oof": oof, "metrics": _reread(whole, f"{folder}/metrics")}
    pooled = out["metrics"].where("fold = -1").drop("fold")
    changed = ensembles.deltas(pooled, baseline)
    out["deltas"] = _reread(changed.withColumn("promoted", ensembles.promoted(F.col("delta_log_loss"), F.col("delta_auc"))), f"{folder}/deltas")
    base = oof.where(F.col("model") == baseline).select("protocol", "response_id", F.col("p").alias("base"))
    beside = oof.where(F.col("model") != baseline).join(base, ["protocol", "response_id"])
    sweep = ensembles.weight_sweep(beside, "base", "p", list(blend_weights), ["protocol", "model"])
    best = ensembles.best(sweep.withColumn("log_loss", F.round("log_loss", 9)), ["protocol", "model"], ["log_loss", "weight"])
    out["blends"] = _reread(best, f"{folder}/blends")
    out["shrinkage"] = _reread(ensembles.shrink_search(_with_fold_prior(oof), "p", "prior", ["protocol", "model"]), f"{folder}/shrinkage")
    run_id = run_id or folder.rstrip("/").rsplit("/", 1)[-1]
    ledger = ledger or f"{folder}/ledger"
    sinks.append_ledger(ledger_rows(pooled, run_id), ledger)
    out["ledger"] = oof.sparkSession.read.parquet(ledger).where(F.col("run_id") == run_id)
    settings = {"baseline": baseline, "protocols": ",".join(protocols), "models": ",".join(parts)}
    top = ensembles.best(pooled, ["protocol"], ["log_loss", "model"])
    sinks.append_report(oof.sparkSession, f"{folder}/report", run_id, settings, out["metrics"].where("fold >= 0"), top)
    return out


def ledger_rows(pooled: DataFrame, run_id: str) -> DataFrame:
    """Rows of the ledger from pooled metrics by protocol and model."""
    return pooled.select(
        F.lit(run_id).alias("run_id"), F.current_timestamp().alias("timestamp_utc"), "model", F.col("protocol").alias("fold_scheme"), "log_loss",
        F.col("auc").alias("roc_auc"), F.col("brier").alias("brier_score"), F.col("ece").alias("ece_10"), F.lit("completed").alias("status"),
    )


def baselines(responses: DataFrame, folder: str, ledger: str | None = None, alpha: float = 20.0) -> dict[str, DataFrame]:
    """The validation of both priors over both protocols, and the priors of all rows, which scoring loads, by name."""
    parts = {"global_prior": global_predictions, "objective_prior": prior_predictions(alpha)}
    out = validation(protocols(responses), parts, "global_prior", folder, ledger=ledger)
    priors = splits.objective_priors(responses, alpha=alpha).select("objective_id", "prior", "global_prior")
    return out | {"objective_priors": _reread(priors, f"{folder}/objective_priors")}


def _with_fold_prior(oof: DataFrame) -> DataFrame:
    """oof with prior: the mean target of the other folds of the same protocol and model, totals less those of the fold."""
    sums = oof.groupBy("protocol", "model", "fold").agg(F.sum("target").alias("_y"), F.count("*").alias("_n"))
    total = sums.groupBy("protocol", "model").agg(F.sum("_y").alias("_ty"), F.sum("_n").alias("_tn"))
    prior = ((F.col("_ty") - F.col("_y")) / (F.col("_tn") - F.col("_n"))).alias("prior")
    return oof.join(sums.join(total, ["protocol", "model"]).select("protocol", "model", "fold", prior), ["protocol", "model", "fold"])


def prior_predictions(alpha: float = 20.0) -> Callable[[DataFrame], DataFrame]:
    """A part for validation: the objective's prior from the other folds."""

    def run(rows: DataFrame) -> DataFrame:
        return splits.priors_leave_fold_out(rows, alpha=alpha).select("response_id", "fold", "target", F.col("objective_prior").alias("p"))

    run.predictions = True
    return run


def global_predictions(rows: DataFrame) -> DataFrame:
    """A part for validation: the mean target of the other folds."""
    return splits.priors_leave_fold_out(rows).select("response_id", "fold", "target", F.col("global_prior").alias("p"))


global_predictions.predictions = True


def candidate_audit(predictions: DataFrame, regimes: DataFrame, baseline: str, candidate: str, weight: float, regime_names: Sequence[str], folder: str, digits: int = 6) -> dict[str, DataFrame]:
    """The audit of one candidate at its weight beside the baseline: blends, scorecard and gates, written below folder.

    predictions: protocol, response_id (each once a protocol), target, fold and a column for each of the two; regimes:
    response_id and the named columns. Losses and AUCs are rounded to `digits` in the scorecard, on which the gates rest.
    """
    expect.check(expect.all_of(expect.unique(predictions, ["protocol", "response_id"], "predictions"), expect.same_cardinality(predictions, "protocol", "response_id", "responses of protocols")))
    blended = predictions.withColumn("blend", ensembles.blend({baseline: 1 - weight, candidate: weight}))
    out = {"oof": _reread(blended.select("protocol", "response_id", "target", "fold", baseline, candidate, "blend"), f"{folder}/oof")}
    both = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("p")) for n, c in ((baseline, baseline), (candidate, "blend"))])
    long = out["oof"].select("protocol", "response_id", "target", "fold", F.explode(both).alias("m")).select("protocol", "response_id", "target", "fold", "m.*")
    card = metrics.scorecard(long.join(regimes, "response_id"), list(regime_names), ["protocol", "model"])
    out["scorecard"] = _reread(card.withColumns({c: F.round(c, digits) for c in ("log_loss", "auc")}), f"{folder}/scorecard")
    out["gates"] = _reread(ensembles.audit_scorecard(out["scorecard"], baseline), f"{folder}/gates")
    return out


def encoder_pilot(rows: DataFrame, encoders: Mapping[str, DataFrame] | Callable[[DataFrame], Mapping[str, DataFrame]], candidate: str, base: str, folder: str, c_values: Sequence[float] = (0.03, 0.1, 0.3), n: int = 12_000, seed: int = 7, digits: int = 6) -> dict[str, DataFrame]:
    """A small trial of encoders before all texts are encoded: is the candidate worth it? Tables below folder, by name.

    rows: response_id, session_id, target, fold; a sample of n of them (all, if fewer), balanced by fold and target, is
    what every encoder is tried on. encoders: response_id and vector (spark.ml) of at least the sampled responses, by
    name; or a function of the sample that gives them, so that other texts need not be encoded. Every encoder is fitted with each c out of fold; a run that was broken off goes on with the fits that are
    missing. Decision: the best c of the candidate against that of the base.
    """
    sample = _reread(splits.stratified_sample(rows, ["fold", "target"], n, "response_id", seed), f"{folder}/sample")
    encoders = encoders(sample) if callable(encoders) else encoders
    if missing := sorted({candidate, base} - set(encoders)):
        raise expect.ExpectationFailed(f"no encoder {', '.join(missing)}")
    # the sample's vectors are made once, then checked and fitted as written
    own = {name: _reread(sample.join(df.select("response_id", "vector"), "response_id"), f"{folder}/vectors/{name}") for name, df in encoders.items()}
    known = [rules.references(f"vectors of {name}", "sample", ["response_id"], name) for name in own]
    once = [rules.unique(f"one vector each of {name}", name, ["response_id"]) for name in own]
    rules.check({"sample": sample, **own}, known + once)
    found = []
    for name in own:
        for c in c_values:
            part = lambda size, c=c: models.embedding_logistic("vector", c, size)
            p = models.out_of_fold(own[name], part, store=f"{folder}/fits", settings=f"{name}|{c}")
            found.append(p.select(F.lit(name).alias("encoder"), F.lit(float(c)).alias("c"), "response_id", "fold", "target", "p"))
    out = {"sample": sample, "oof": _reread(reduce(DataFrame.unionByName, found), f"{folder}/oof")}
    figures = metrics.all_metrics(out["oof"], ["encoder", "c"])
    out["metrics"] = _reread(figures.withColumns({x: F.round(x, digits) for x in ("log_loss", "auc")}), f"{folder}/metrics")
    out["best"] = _reread(ensembles.best_settings(out["metrics"]), f"{folder}/best")
    out["decision"] = _reread(ensembles.encoder_decision(out["best"], candidate, base), f"{folder}/decision")
    return out
