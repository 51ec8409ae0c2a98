"""Blends of predictions, searches over weights, gates on metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolytics.functions.text import clip
from convolytics.operators import expect
from convolytics.operators.metrics import all_metrics, log_loss, pooled_and_by_fold


def blend(weights: Mapping[str, float]) -> Column:
    return sum((w * F.col(c) for c, w in weights.items()), F.lit(0.0))


def agreement_gate(combined: str = "combined", base: str = "v02", a: Sequence[str] = ("bge_base", "semantic"), b: Sequence[str] = ("nbsvm", "v02")) -> tuple[Column, Column]:
    """(agrees, gated): combined where both components moved the same way, else base; clipped."""
    agrees = (F.col(a[0]) - F.col(a[1])) * (F.col(b[0]) - F.col(b[1])) >= 0
    return agrees, clip(F.when(agrees, F.col(combined)).otherwise(F.col(base)))


def nested_blend(base: Column, nb: Column, supervised: Column, w: float = 0.3) -> Column:
    return (1 - w) * ((1 - w) * base + w * nb) + w * supervised


def weight_sweep(df: DataFrame, base: str, other: str, weights: Sequence[float], by: Sequence[str] = ("protocol",), target: str = "target") -> DataFrame:
    """Log loss of (1 - w) * base + w * other for each weight; a weight costs a column of one aggregation, no more rows."""
    y = F.col(target)
    losses = [log_loss(y, clip((1 - w) * F.col(base) + w * F.col(other))).alias(f"_{i}") for i, w in enumerate(weights)]
    wide = df.groupBy(*by).agg(*losses)
    return wide.select(*by, F.explode(F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.col(f"_{i}").alias("log_loss")) for i, w in enumerate(weights)])).alias("r")).select(*by, "r.*")


def best(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group by order."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*by, "r.*")


def deltas(metrics: DataFrame, baseline: str, by: Sequence[str] = ("protocol",), values: Sequence[str] = ("log_loss", "auc")) -> DataFrame:
    """Metrics of each other model less those of the baseline."""
    base = metrics.where(F.col("model") == baseline).select(*by, *[F.col(v).alias(f"_{v}") for v in values])
    return metrics.where(F.col("model") != baseline).join(base, list(by)).select(*by, "model", *[(F.col(v) - F.col(f"_{v}")).alias(f"delta_{v}") for v in values])


def audit(d: DataFrame) -> DataFrame:
    """Promotion gates of each model over protocols: gain, all improve, share of wins, worst regression."""
    out = d.groupBy("model").agg(F.median(-F.col("delta_log_loss")).alias("median_gain"), F.avg((F.col("delta_log_loss") < 0).cast("double")).alias("win_fraction"), F.max("delta_log_loss").alias("worst_regression"))
    return out.withColumns({"gain_gate": F.col("median_gain") >= 0.002, "all_gate": F.col("win_fraction") == 1, "win_gate": F.col("win_fraction") >= 0.7, "regression_gate": F.col("worst_regression") <= 0.001})


def audit_scorecard(card: DataFrame, baseline: str, outside: Sequence[str] = ("overall", "fold", "session_objectives"), least: int = 100) -> DataFrame:
    """Promotion gates of each model, from metrics.scorecard by protocol and model.

    Gain and consistency come from the overall rows of protocols, wins from the rows of all protocols and folds, the
    worst regression from the values of regimes not in `outside` with at least `least` rows; without any, its gate fails.
    """
    own = Window.partitionBy("protocol", "regime", "value")
    less = lambda c: F.col(c) - F.max(F.when(F.col("model") == baseline, F.col(c))).over(own)
    d = card.withColumns({"delta_log_loss": less("log_loss"), "delta_auc": less("auc")}).where(F.col("model") != baseline)
    loss, auc = F.col("delta_log_loss"), F.coalesce("delta_auc", F.lit(0.0))
    overall, fold = F.col("regime") == "overall", F.col("regime") == "fold"
    legal = ~F.col("regime").isin(*outside) & (F.col("rows") >= least)
    share = lambda of, won: F.avg(F.when(of, won.cast("double")))
    out = d.groupBy("model").agg(
        F.count_if(overall).alias("protocols"), F.count_if(overall & (loss < 0)).alias("protocol_loss_wins"), F.count_if(overall & (auc > 0)).alias("protocol_auc_wins"),
        F.median(F.when(overall, -loss)).alias("median_gain"), F.avg(F.when(overall, -loss)).alias("mean_gain"), F.avg(F.when(overall, F.col("delta_auc"))).alias("mean_auc_gain"),
        share(fold, loss < 0).alias("fold_loss_wins"), share(fold, auc > 0).alias("fold_auc_wins"), F.max(F.when(fold, loss)).alias("worst_fold"), F.max(F.when(legal, loss)).alias("worst_regime"),
    )
    return out.withColumns({"gain_gate": F.col("median_gain") >= 0.002, "all_gate": F.col("protocol_loss_wins") == F.col("protocols"), "win_gate": F.col("fold_loss_wins") >= 0.7, "regression_gate": F.coalesce(F.col("worst_regime") <= 0.001, F.lit(False))})


# The least gains for which a model is taken on.
LEAST_LOSS_GAIN, LEAST_AUC_GAIN = 0.0015, 0.005


def promoted(delta_loss: Column, delta_auc: Column) -> Column:
    return ((delta_loss <= -LEAST_LOSS_GAIN) & (delta_auc >= 0)) | ((delta_auc >= LEAST_AUC_GAIN) & (delta_loss <= 0))


def best_settings(metrics: DataFrame, encoder: str = "encoder", setting: str = "c") -> DataFrame:
    """The row of each encoder with the least log loss, then the greatest AUC, then the least setting."""
    ordered = metrics.withColumn("_auc", -F.coalesce("auc", F.lit(0.0)))
    return best(ordered, [encoder], ["log_loss", "_auc", setting]).drop("_auc")


def encoder_decision(best: DataFrame, candidate: str, base: str, encoder: str = "encoder") -> DataFrame:
    """One row: what the candidate's best setting gains over that of the base, and whether to go on with it."""
    of = lambda name, c: F.max(F.when(F.col(encoder) == name, F.col(c)))
    one = best.agg(*[F.round(of(candidate, c) - of(base, c), 6).alias(f"delta_{c}") for c in ("log_loss", "auc")])
    return one.select(F.lit(candidate).alias("candidate"), F.lit(base).alias("base"), "*", promoted(F.col("delta_log_loss"), F.col("delta_auc")).alias("go_on"))


def pair_blends(df: DataFrame, models: Sequence[str], prior: str, by: Sequence[str] = ("protocol",), first: Sequence[float] = tuple(i / 20 for i in range(21)), model: Sequence[float] = tuple(0.4 + 0.02 * i for i in range(31)), target: str = "target") -> DataFrame:
    """The best m * (f * a + (1 - f) * b) + (1 - m) * prior of each pair of models (a, b) by log loss, on a grid.

    Rows are repeated for each pair and f and summed up before the shuffle; each m is a column of the aggregation. Ties
    in log loss (to 9 digits) go to the smaller f, then to the smaller m.
    """
    pairs = [F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).alias("a"), F.col(b).alias("b")) for i, a in enumerate(models) for b in models[i + 1 :]]
    long = df.select(*by, F.col(target).alias("_y"), F.col(prior).alias("_prior"), F.explode(F.array(*pairs)).alias("p")).select("*", "p.*", F.explode(F.array(*map(F.lit, first))).alias("first_weight"))
    return _best_of_grid(long, by, model)


def _best_of_grid(long: DataFrame, by: Sequence[str], model: Sequence[float]) -> DataFrame:
    """The best weights of each pair from rows (by, first, second, a, b, first_weight, _y, _prior)."""
    mixed = F.col("first_weight") * F.col("a") + (1 - F.col("first_weight")) * F.col("b")
    columns = [log_loss(F.col("_y"), clip(m * F.col("_mix") + (1 - m) * F.col("_prior"))).alias(f"_{i}") for i, m in enumerate(model)]
    losses = long.withColumn("_mix", mixed).groupBy(*by, "first", "second", "first_weight").agg(*columns)
    each = F.explode(F.array(*[F.struct(F.lit(float(m)).alias("model_weight"), F.round(f"_{i}", 9).alias("log_loss")) for i, m in enumerate(model)]))
    grid = losses.select(*by, "first", "second", "first_weight", each.alias("r")).select(*by, "first", "second", "first_weight", "r.*")
    return best(grid, [*by, "first", "second"], ["log_loss", "first_weight", "model_weight"])


def best_models(long: DataFrame, by: Sequence[str] = ("protocol",), top: int = 8) -> DataFrame:
    """by, model of the `top` models of least log loss (to 9 digits, ties by name), from rows (by, model, target, p)."""
    losses = long.groupBy(*by, "model").agg(F.round(log_loss(F.col("target"), clip(F.col("p"))), 9).alias("_l"))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy("_l", "model"))  # a row a model
    return losses.withColumn("_nth", nth).where(F.col("_nth") <= top).select(*by, "model")


def best_pair_blends(long: DataFrame, by: Sequence[str] = ("protocol",), key: str = "response_id", top: int = 8, first: Sequence[float] = tuple(i / 20 for i in range(21)), model: Sequence[float] = tuple(0.4 + 0.02 * i for i in range(31))) -> DataFrame:
    """pair_blends of the `top` best of any number of models. long: by, key, model, target, p, prior, a row a model.

    Pairs meet by an equi-join on the key; weights of the first are summed up before the shuffle, those of the prior are
    columns of the aggregation.
    """
    kept = long.join(best_models(long, by, top), [*by, "model"])
    other = kept.select(*by, key, F.col("model").alias("second"), F.col("p").alias("b"))
    pairs = kept.select(*by, key, F.col("model").alias("first"), F.col("p").alias("a"), F.col("target").alias("_y"), F.col("prior").alias("_prior"))
    pairs = pairs.join(other, [*by, key]).where("first < second").withColumn("first_weight", F.explode(F.array(*[F.lit(float(w)) for w in first])))
    return _best_of_grid(pairs, by, model)


def gate_evaluation(df: DataFrame, by: Sequence[str] = ("protocol",), base: str = "v02", combined: str = "combined") -> DataFrame:
    """Log loss and AUC of the base, of the combined and of the gated predictions by the columns by, the rate of
    agreement and what the gate gains (negative deltas of log loss are gains)."""
    by = list(by)
    agrees, gated = agreement_gate(combined, base)
    rows = df.withColumns({"_agrees": agrees, "_gated": gated})
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("p")) for k, c in (("base", base), ("combined", combined), ("gated", "_gated"))])
    m = all_metrics(rows.select(*by, "target", F.explode(kinds).alias("k")).select(*by, "target", "k.*"), [*by, "kind"])
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}")
    wide = m.groupBy(*by).agg(*[pick(k, c) for k in ("base", "combined", "gated") for c in ("log_loss", "auc")])
    out = wide.join(rows.groupBy(*by).agg(F.avg(F.col("_agrees").cast("double")).alias("agreement_rate")), by)
    minus = lambda a, b, c: F.col(f"{a}_{c}") - F.col(f"{b}_{c}")
    return out.withColumns({f"{a}_{c}_vs_{b}": minus(a, b, c) for a, b in (("gated", "base"), ("gated", "combined"), ("combined", "base")) for c in ("log_loss", "auc")})


def continuation(overall: DataFrame, folds: DataFrame, by: Sequence[str] = ("protocol",)) -> DataFrame:
    """Whether to go on with the gate, by protocol; overall and folds come from gate_evaluation.

    Path a: it gains 0.0003 over the combined predictions and keeps 80 % of their gain in AUC. Path b: it lessens the
    worst fold's loss by 0.001 and keeps 80 % of both gains.
    """
    by = list(by)
    worst = folds.groupBy(*by).agg(F.max("combined_log_loss_vs_base").alias("combined_worst_fold"), F.max("gated_log_loss_vs_base").alias("gated_worst_fold"))
    out = overall.join(worst, by).withColumns({"gain_over_combined": -F.col("gated_log_loss_vs_combined"), "worst_fold_reduction": F.col("combined_worst_fold") - F.col("gated_worst_fold")})
    out = out.withColumn("keeps_auc", F.col("gated_auc_vs_base") >= 0.8 * F.col("combined_auc_vs_base"))
    out = out.withColumn("keeps_both", F.col("keeps_auc") & (-F.col("gated_log_loss_vs_base") >= -0.8 * F.col("combined_log_loss_vs_base")))
    out = out.withColumns({"path_a": (F.col("gain_over_combined") >= 0.0003) & F.col("keeps_auc"), "path_b": (F.col("worst_fold_reduction") >= 0.001) & F.col("keeps_both")})
    return out.select(*by, "gain_over_combined", "combined_worst_fold", "gated_worst_fold", "worst_fold_reduction", "keeps_auc", "keeps_both", "path_a", "path_b", (F.col("path_a") | F.col("path_b")).alias("continues"))


# Weights of the named recipes.
RECIPES = {
    "semantic_quarter": {"v02": 0.75, "semantic": 0.25},
    "encoder_hybrid": {"v02": 0.5, "semantic": 0.25, "bge_base": 0.25},
    "encoder_replaced": {"v02": 0.5, "bge_base": 0.5},
    "session_weighted": {"v02": 0.7, "nbsvm": 0.3},
}


def recipes(df: DataFrame, named: Mapping[str, Mapping[str, float]] = RECIPES, keep: Sequence[str] = ("protocol", "response_id", "target")) -> DataFrame:
    """keep, recipe, p: the blend of each named recipe, in one pass."""
    each = F.array(*[F.struct(F.lit(n).alias("recipe"), clip(blend(w)).alias("p")) for n, w in named.items()])
    return df.select(*keep, F.explode(each).alias("r")).select(*keep, "r.*")


def component_chain(components: Mapping[str, DataFrame], keys: Sequence[str] = ("protocol", "response_id")) -> DataFrame:
    """The components' predictions side by side, joined one to one on the keys; components that don't have just the same
    keys, each once, are refused."""
    (first, chain), *rest = [(n, df.select(*keys, F.col("p").alias(n))) for n, df in components.items()]
    expect.check(expect.all_of(*[expect.aligned(chain, df, keys, f"{first} and {n}") for n, df in rest]))
    for _, df in rest:
        chain = chain.join(df, list(keys))
    return chain


def shrink_search(df: DataFrame, p: str, prior: str, by: Sequence[str] = ("protocol",), steps: int = 100) -> DataFrame:
    """by, weight, log_loss: the weight of p against the prior, of steps + 1, with the least log loss (to 9 digits; ties
    to the smaller weight)."""
    sweep = weight_sweep(df, prior, p, [i / steps for i in range(steps + 1)], by)
    return best(sweep.withColumn("log_loss", F.round("log_loss", 9)), by, ["log_loss", "weight"])


def fold_deltas(df: DataFrame, p: str, baseline: str, by: Sequence[str] = ("protocol",), fold: str = "fold", target: str = "target") -> DataFrame:
    """by, fold (-1: all), delta_log_loss, delta_auc and wins: metrics of p less those of baseline, and in how many folds
    p has the lower log loss."""
    both = F.array(*[F.struct(F.lit(k).alias("model"), F.col(c).alias("p")) for k, c in (("own", p), ("base", baseline))])
    long = df.select(*by, fold, target, F.explode(both).alias("m")).select(*by, fold, target, "m.*")
    m = pooled_and_by_fold(long, [*by, "model"])
    d = deltas(m, "base", [*by, fold]).drop("model")
    wins = d.where(F.col(fold) >= 0).groupBy(*by).agg(F.count_if(F.col("delta_log_loss") < 0).alias("wins"))
    return d.join(wins, list(by))


def leaderboard(metrics: DataFrame, n: int) -> DataFrame:
    """The n best rows: least log loss, then greatest AUC."""
    return metrics.orderBy("log_loss", F.desc_nulls_last("auc"), *[c for c in ("protocol", "model") if c in metrics.columns]).limit(n)


def softmax(logits: Sequence[str], names: Sequence[str]) -> dict[str, Column]:
    """Probabilities of the logits and the differences of neighbours, as columns by name."""
    top = F.greatest(*logits)
    e = [F.exp(F.col(c) - top) for c in logits]
    total = sum(e[1:], e[0])
    p = {f"p_{n}": x / total for n, x in zip(names, e, strict=True)}
    pairs = [(0, len(names) - 1), (0, 1)]
    out = {**{f"logit_{n}": F.col(c) for n, c in zip(names, logits, strict=True)}, **p}
    for i, j in pairs:
        out[f"p_{names[i]}_less_{names[j]}"] = list(p.values())[i] - list(p.values())[j]
    out[f"logit_{names[0]}_less_{names[-1]}"] = F.col(logits[0]) - F.col(logits[-1])
    return out
