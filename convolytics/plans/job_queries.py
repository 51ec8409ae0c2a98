"""Queries that run whole jobs over the driver's tables, each with SQL where SQL can express it; named sets of models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolytics.functions import text as T
from convolytics.operators import builds, ensembles, jobs, metrics, models, retrieval, sessions, splits, trees, vectors
from convolytics.plans import block_queries as K
from convolytics.plans import evidence_queries as E
from convolytics.plans import feature_queries as Q
from convolytics.plans import session_queries as S
from convolytics.plans.session_queries import P, R, folds_sql, metrics_sql, rounded
from convolytics.sources import bindings as B
from convolytics.sources import files, sinks

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _foundation(spark, d):
    return jobs.foundation(B.utterances(spark, d), B.responses(spark, d), sinks.scratch(spark, "foundation"))


@query(f"""WITH {R} SELECT 'utterances' AS name, (SELECT count(*) FROM conversations) AS rows UNION ALL SELECT 'session_features', (SELECT count(DISTINCT conv_id) FROM conversations)
 UNION ALL SELECT 'session_texts', (SELECT count(DISTINCT conv_id) FROM conversations) UNION ALL SELECT 'modeling_base', (SELECT count(*) FROM responses) UNION ALL SELECT 'response_folds', (SELECT count(*) FROM responses)""")
def foundation_job(spark, d):
    """Builds the foundation's tables and counts them as written."""
    return jobs.table_sizes(_foundation(spark, d))


@query(f"""WITH {R}, {folds_sql('session_id')} SELECT 'rows of tables' AS rule, 0 AS violations UNION ALL SELECT 'response key', (SELECT count(*) FROM (SELECT 1 FROM responses GROUP BY response_id HAVING count(*) > 1))
 UNION ALL SELECT 'target', (SELECT count_if(target IS NULL OR target NOT IN (0, 1)) FROM responses) UNION ALL SELECT 'folds', (SELECT 5 - count(DISTINCT fold) FILTER (fold BETWEEN 0 AND 4) + count(DISTINCT fold) FILTER (fold NOT BETWEEN 0 AND 4) FROM folded)
 UNION ALL SELECT 'one fold a session', (SELECT count(*) FROM (SELECT 1 FROM folded GROUP BY session_id HAVING count(DISTINCT fold) > 1)) UNION ALL SELECT 'folds of responses', 0""")
def verification_job(spark, d):
    """The report on the foundation's tables, against what was to be written."""
    tables = _foundation(spark, d)
    u, r = B.utterances(spark, d), B.responses(spark, d)
    n_sessions = u.select("session_id").distinct()
    return jobs.verification(tables, jobs.table_sizes({"utterances": u, "session_features": n_sessions, "session_texts": n_sessions, "modeling_base": r, "response_folds": r}))


@query(f"SELECT *, 1 AS build FROM ({S.ORACLE_SQL['session_features']})")
def foundation_files(spark, d):
    """Conversations written as one CSV folder each and built from there, twice: the second build takes all sessions over."""
    folder, out = sinks.scratch(spark, "transcripts"), sinks.scratch(spark, "foundation")
    u = B.utterances(spark, d)
    # one task a session, whose folder then holds one file; so small that Spark would join them in one task were no number given
    n = max(spark.sparkContext.defaultParallelism, u.select("session_id").distinct().count() // 256)
    u.withColumn("of", F.col("session_id")).repartition(n, "session_id").write.partitionBy("of").options(**files.WRITTEN).csv(folder)
    r = B.responses(spark, d).withColumn("session_id", F.col("session_id").cast("string"))
    for _ in range(2):
        builds.foundation_from_files(spark, folder, r, out, r"/of=([^/]+)/")
    return builds.table(spark, out, "session_features").withColumn("session_id", F.col("session_id").cast("long"))


@query("""WITH lines AS (SELECT substr(md5(doc_id::VARCHAR), 1, 3) AS part, doc_id::VARCHAR AS path, concat(doc_id, '|', octet_length(encode(coalesce(text, ''))), '|', sha256(coalesce(text, ''))) AS line FROM documents),
 parts AS (SELECT part, sha256(string_agg(line, chr(10) ORDER BY path, line)) AS line FROM lines GROUP BY part) SELECT sha256(string_agg(line, chr(10) ORDER BY part)) AS digest FROM parts""")
def documents_digest(spark, d):
    """The digest of all documents, each taken as a file named by its id."""
    text = F.coalesce("text", F.lit(""))
    listed = B.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.octet_length(text).alias("bytes"), F.sha2(text, 256).alias("sha256"))
    return files.manifest_tree_digest(listed)


def _prior_sql(protocol, group):
    f = f"f_{protocol}"
    return f"""{folds_sql(group, f)}, g_{protocol} AS (SELECT a.fold, avg(b.target) AS g FROM (SELECT DISTINCT fold FROM {f}) a JOIN {f} b ON b.fold <> a.fold GROUP BY a.fold),
 p_{protocol} AS (SELECT a.response_id, a.fold, a.target, g.g, (coalesce(sum(b.target), 0) + 20e0 * g.g) / (count(b.target) + 20) AS o FROM {f} a JOIN g_{protocol} g USING (fold) LEFT JOIN {f} b ON b.objective_id = a.objective_id AND b.fold <> a.fold GROUP BY a.response_id, a.fold, a.target, g.g)"""


_OOF = f"""{R}, {_prior_sql('session', 'session_id')}, {_prior_sql('objective', 'objective_id')},
 oof AS ({' UNION ALL '.join(f"SELECT '{p}' AS protocol, unnest(['global_prior', 'objective_prior']) AS model, fold, target, unnest([g, o]) AS p FROM p_{p}" for p in ('session', 'objective'))}),
 scoped AS (SELECT protocol, model, fold, target, p FROM oof UNION ALL SELECT protocol, model, -1, target, p FROM oof)"""


@query(f"WITH {_OOF} {metrics_sql('scoped', ['protocol', 'model', 'fold'])}")
def baseline_job(spark, d):
    """The validation of both priors over both protocols: metrics by fold and pooled (-1), as written."""
    out = jobs.baselines(B.responses(spark, d), sinks.scratch(spark, "baselines"))
    return rounded(out["metrics"], "positive_rate", "log_loss", "brier", "prediction_mean", "auc", "ece")


@query(f"""WITH {_OOF} SELECT model, protocol AS fold_scheme, log_loss, auc AS roc_auc, brier AS brier_score, ece AS ece_10, 'completed' AS status FROM ({metrics_sql('oof', ['protocol', 'model'])})""")
def experiment_ledger(spark, d):
    """What the baseline job adds to the ledger, without run and time."""
    out = jobs.baselines(B.responses(spark, d), sinks.scratch(spark, "baselines"))
    return rounded(out["ledger"].drop("run_id", "timestamp_utc"), "log_loss", "roc_auc", "brier_score", "ece_10")


_FAMILIES = f"""{R}, related AS (SELECT *, objective_id % 25 AS family FROM responses), {folds_sql('family', source='related')},
 pairs AS (SELECT e.f AS eval_fold, a.* FROM folded a, (SELECT unnest(range(5)) AS f) e WHERE a.fold <> e.f AND NOT EXISTS (SELECT 1 FROM folded h WHERE h.fold = e.f AND h.session_id = a.session_id))"""


def _in_families(spark, d):
    """Responses in folds of whole families; here a family is a remainder of the objective's id, which SQL can say."""
    return splits.group_folds(B.responses(spark, d).withColumn("family", F.col("objective_id") % 25), "family")


@query(f"""WITH {_FAMILIES}, first AS (SELECT family, min(fold) AS fold FROM folded GROUP BY family), t AS (SELECT eval_fold AS fold, count(*) AS train_rows, round(avg(target), 6) AS train_prior FROM pairs GROUP BY eval_fold)
 SELECT fold, count(*) AS rows, count(DISTINCT session_id) AS sessions, count(DISTINCT objective_id) AS objectives, round(avg(target), 6) AS positive_rate, count(DISTINCT family) AS families, any_value(t.train_rows) AS train_rows, any_value(t.train_prior) AS train_prior,
 (SELECT count(*) FROM first WHERE first.fold = folded.fold) AS first_families FROM folded LEFT JOIN t USING (fold) GROUP BY fold""")
def family_summary(spark, d):
    """Figures of folds of whole families, and the families that a fold is the first of: all that it has."""
    f = _in_families(spark, d)
    first = splits.first_fold(f).groupBy("fold").agg(F.count("*").alias("first_families"))
    return rounded(splits.fold_summary(f, family="family"), "positive_rate", "train_prior").join(first, "fold", "left")


@query(f"""WITH {_FAMILIES} SELECT unnest(['session_id leakage', 'objective_id leakage', 'family leakage', 'target leakage']) AS rule, unnest([
 {', '.join(f"(SELECT count(*) FROM (SELECT DISTINCT p.eval_fold, p.{k} FROM pairs p JOIN folded h ON h.fold = p.eval_fold AND h.{k} = p.{k}))" for k in ('session_id', 'objective_id', 'family', 'target'))}]) AS violations""")
def family_leakage(spark, d):
    """Keys shared by a fold and its training rows: no session, objective or family; targets, of course, are shared."""
    return jobs.leakage(_in_families(spark, d), ["session_id", "objective_id", "family", "target"])


@query(f"WITH {Q.audited_sql(Q.BLENDED)} {Q.GATES} WHERE model = 'nbsvm'")
def audit_job(spark, d):
    """The audit of one candidate: blends, scorecard and gates, as written."""
    p = B.predictions(spark, d).withColumn("fold", F.abs("response_id") % 5)
    names = [*Q.REGIMES, "session_objectives"]
    out = jobs.candidate_audit(p, Q.regime_columns(spark, d), "v02", "nbsvm", Q.CANDIDATE_WEIGHT, names, sinks.scratch(spark, "audit"))
    return rounded(out["gates"], *Q.GAINS, digits=5)


_DRAWN = 200
_ENCODERS = ("v02", "semantic", "bge_base")


@query(f"""WITH {P}, pool AS (SELECT *, response_id % 5 AS fold FROM predictions WHERE protocol = 'p0'), total AS (SELECT count(*) AS t, least({_DRAWN}, count(*)) AS n FROM pool),
 e AS (SELECT fold, target, count(*) * n / t AS exact FROM pool, total GROUP BY fold, target, n, t),
 quotas AS (SELECT fold, target, floor(exact) + (row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, fold, target) <= (SELECT n FROM total) - (SELECT sum(floor(exact)) FROM e))::INT AS quota FROM e),
 drawn AS (SELECT * FROM (SELECT pool.*, quota, row_number() OVER (PARTITION BY fold, target ORDER BY md5('7|' || response_id), response_id) AS nth FROM pool JOIN quotas USING (fold, target)) WHERE nth <= quota),
 tried AS (SELECT encoder, unnest([0.3e0, 0.6e0, 1e0]) AS c, target, unnest([0.5 + 0.3e0 * (p - 0.5), 0.5 + 0.6e0 * (p - 0.5), p]) AS p FROM ({" UNION ALL ".join(f"SELECT '{x}' AS encoder, target, {x} AS p FROM drawn" for x in _ENCODERS)})),
 figures AS (SELECT * FROM ({metrics_sql('tried', ['encoder', 'c'])})), chosen AS (SELECT * FROM figures QUALIFY row_number() OVER (PARTITION BY encoder ORDER BY log_loss, auc DESC, c) = 1),
 d AS (SELECT a.encoder AS candidate, b.encoder AS base, round(a.log_loss - b.log_loss, 6) AS delta_log_loss, round(a.auc - b.auc, 6) AS delta_auc, a.c AS candidate_c, b.c AS base_c FROM chosen a, chosen b WHERE a.encoder <> b.encoder)
 SELECT *, (delta_log_loss <= -0.0015 AND delta_auc >= 0) OR (delta_auc >= 0.005 AND delta_log_loss <= 0) AS go_on FROM d""")
def encoder_decisions(spark, d):
    """The pilot's decision for each pair of given predictions, shrunk by three settings, on a balanced sample."""
    pool = B.predictions(spark, d).where("protocol = 'p0'").withColumn("fold", F.col("response_id") % 5)
    drawn = splits.stratified_sample(pool, ["fold", "target"], _DRAWN, "response_id")
    each = F.array(*[F.struct(F.lit(n).alias("encoder"), F.lit(c).alias("c"), (F.col(n) if c == 1 else 0.5 + c * (F.col(n) - 0.5)).alias("p")) for n in _ENCODERS for c in (0.3, 0.6, 1.0)])
    figures = metrics.all_metrics(drawn.select("target", F.explode(each).alias("r")).select("target", "r.*"), ["encoder", "c"])
    best = sinks.materialize(ensembles.best_settings(rounded(figures, "log_loss", "auc")), "best")
    of = lambda side: best.select(F.col("encoder").alias(side), F.col("c").alias(f"{side}_c"))
    pairs = [ensembles.encoder_decision(best, a, b) for a in _ENCODERS for b in _ENCODERS if a != b]
    return reduce(DataFrame.unionByName, pairs).join(of("candidate"), "candidate").join(of("base"), "base")


def projections(spark, d, sample) -> dict[str, DataFrame]:
    """Vectors of the sampled responses by encoder. Only their contexts are retrieved, once for both widths."""
    r = B.responses(spark, d).join(sample.select("response_id"), "response_id", "left_semi")
    r = sinks.materialize(r, "pilot-responses")
    said = B.utterances(spark, d).join(r.select("session_id"), "session_id", "left_semi")
    lines = retrieval.scored_lines(sessions.session_texts(said), r)
    contexts = sinks.materialize(retrieval.contexts(retrieval.retrieve(lines)), "pilot-contexts")
    asked, encoders = r.select("objective_id", "objective").distinct(), {}
    for width in (64, 32):
        said = vectors.projected(contexts, "response_id", T.tokens(F.col("objective_context")), width, "context")
        about = vectors.projected(asked, "objective_id", T.tokens(F.col("objective")), width, "about")
        nothing = F.array_repeat(F.lit(0.0), width)
        joined = r.select("response_id", "objective_id").join(said, "response_id", "left").join(about, "objective_id", "left")
        pair = vectors.interaction(F.coalesce("context", nothing), F.coalesce("about", nothing))
        encoders[f"projection_{width}"] = models.as_vector(joined.select("response_id", pair.alias("pair")), "pair", "vector").select("response_id", "vector")
    return encoders


@query(None)
def encoder_pilot(spark, d):
    """Two projections of contexts and objectives, 64 and 32 numbers wide, tried on a balanced sample: metrics by c."""
    rows = splits.group_folds(B.responses(spark, d), "session_id").select("response_id", "session_id", "objective_id", "target", "fold")
    out = jobs.encoder_pilot(rows.drop("objective_id"), lambda sample: projections(spark, d, sample), "projection_64", "projection_32", sinks.scratch(spark, "pilot"), c_values=(0.1,))
    return out["metrics"]


def _part(predictions):
    """predictions(rows) -> response_id, fold, target, p, marked as a part for jobs.validation."""
    predictions.predictions = True
    return predictions


def validation_parts(name: str, spark, d, numeric: list[str] = Q.NUMERIC) -> dict:
    """What a named validation job compares, by model, for jobs.validation; its rows come from validation_rows."""
    on = lambda model: _part(lambda rows: model(rows, spark, d))
    variant = lambda n: models.embedding_logistic("vector", n=n)
    hashed = {f"text_a{a:g}": (lambda n, a=a: models.hashed_text_logistic("full_text", alpha=a)) for a in (3e-5, 1e-4, 3e-4, 1e-3)}
    dense = {"text_and_dense": lambda n: models.text_and_dense_logistic("full_text", numeric)}
    pair = {"embedding": lambda n: models.embedding_logistic("vector", n=n)}
    priors = {"global_prior": jobs.global_predictions, "objective_prior": jobs.prior_predictions()}
    sets = {
        "baselines": {"metadata": lambda n: models.numeric_logistic(numeric, n=n),
                      "objective_text": _part(lambda rows: models.tf_idf_out_of_fold(rows, {"objective": Q._objective_words(30_000)}))},
        "hard": {"metadata": _part(lambda rows: models.out_of_fold(sessions.log_counts(rows, Q.COUNTS), lambda n: models.numeric_logistic(numeric, 0.3, n=n))), **hashed},
        "role": {"role": on(K.role_model)}, "retrieval": {"retrieval": on(K.context_model)}, "robust": {**hashed, **dense},
        "semantic": pair, "encoder": {"projection": variant}, "multiview": {"multiview": variant}, "feedback": {"feedback": on(K.feedback_model)},
        "nbsvm": {"nbsvm": models.NaiveBayesLogistic("prefixed")},
        "session_weight": {**dense, "weighted": models.SessionWeighted(models.text_and_dense_logistic("full_text", numeric, alpha=3e-5, weight="weight"))},
        "dense_tree": {size: _part(lambda rows, size=size, leaves=leaves: trees.trees_out_of_fold(rows, numeric, {size: leaves}).drop("model")) for size, leaves in trees.TREE_LEAVES.items()},
    }
    if name not in sets:
        raise ValueError(f"unknown job: {name}; there are {', '.join(sets)}")
    return priors | sets[name]


def validation_rows(spark, d, name: str):
    """The rows that the models of a named job read."""
    if name in ("semantic", "multiview"):
        flipped = F.reverse("context")
        blocks = {"context": F.col("context"), "objective": F.col("objective"), "student": flipped, "tutor": F.col("context"), "feedback": flipped, "trajectory": F.col("objective")}
        kind = "semantic_reference" if name == "semantic" else "multiview_interaction"
        e = Q._embedded(spark, d).withColumn("pair", vectors.variant(kind, blocks))
        return models.as_vector(e, "pair", "vector").drop("pair")
    if name == "encoder":  # the default encoder instead of given vectors: contexts and objectives by projection of their words
        said = vectors.projected(Q._contexts(spark, d), "response_id", T.tokens(F.col("objective_context")), out="context")
        asked = vectors.projected(B.responses(spark, d).select("objective_id", "objective").distinct(), "objective_id", T.tokens(F.col("objective")), out="about")
        e = B.responses(spark, d).join(said, "response_id").join(asked, "objective_id").withColumn("pair", vectors.interaction(F.col("context"), F.col("about")))
        return models.as_vector(e, "pair", "vector").drop("pair", "context", "about", "objective")
    rows = E._prefixed(spark, d) if name == "nbsvm" else Q._spoken(spark, d)
    return rows.drop("fold")


def run_validation(spark, d, name: str, folder: str | None = None, families: dict[str, tuple[int, int, int]] | None = None):
    """A named validation job over both protocols, with `families` also over folds of families of like objectives.

    families: clusters, cluster seed and fold seed by name, such as splits.PROTOCOLS; like objectives are those near each
    other in a projection of their words. Gives the tables that the job writes, by name.
    """
    rows = validation_rows(spark, d, name)
    protocols = jobs.protocols(rows)
    if families:
        about = vectors.projected(B.responses(spark, d).select("objective_id", "objective").distinct(), "objective_id", T.tokens(F.col("objective")), out="about")
        protocols |= splits.family_protocols(rows, about.withColumnRenamed("about", "vector"), families)
    return jobs.validation(protocols, validation_parts(name, spark, d), "global_prior", folder or sinks.scratch(spark, name))
