"""Queries on sessions, texts, rules, folds, priors and metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolytics.functions import text as T
from convolytics.operators import expect, metrics, rules, sessions, splits
from convolytics.sources import bindings as B
from convolytics.sources.bindings import CUES, P, R, U

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


PLACED = f"""{U}, placed AS (SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY session_id) AS n, lag(role) OVER w AS prev FROM utterances WINDOW w AS (PARTITION BY session_id ORDER BY utterance_id)),
 lines AS (SELECT *, '[' || upper(role) || '] ' || coalesce(content, '') AS line, pos >= floor(n * 0.75) AS closing, pos < greatest(1, ceil(n * 0.25)) AS opening FROM placed)"""


def _sql_cue(words):
    return "(?:^|[^a-z0-9_])(?:" + "|".join(words) + ")(?:$|[^a-z0-9_])"


def _sql_count(col, words):
    """Whole-word occurrences: the separators are doubled, so that neighbours don't share one."""
    return f"len(regexp_extract_all(regexp_replace(' ' || lower({col}) || ' ', '([^a-z0-9_])', '\\1\\1', 'g'), '[^a-z0-9_](?:{'|'.join(words)})[^a-z0-9_]'))"


@query(f"""WITH {U} SELECT session_id, count(*) AS n_utterances, max(sec) - min(sec) AS duration_seconds, sum(length(coalesce(content, ''))) AS n_chars,
 count_if(role = 'tutor') AS n_tutor, count_if(role = 'student') AS n_student, count_if(role = 'background') AS n_background, count_if(role NOT IN ('tutor', 'student', 'background')) AS n_other,
 count_if(coalesce(contains(lower(content), '[unclear]'), false)) AS n_unclear, count_if(regexp_matches(coalesce(content, ''), '^\\s*$')) AS n_empty FROM utterances GROUP BY session_id""")
def session_features(spark, d):
    return sessions.session_features(B.utterances(spark, d))


@query(f"WITH {PLACED} SELECT session_id, string_agg(line, chr(10) ORDER BY utterance_id) AS full_text, coalesce(string_agg(line, chr(10) ORDER BY utterance_id) FILTER (closing), '') AS closing_text FROM lines GROUP BY session_id")
def session_texts(spark, d):
    return sessions.session_texts(B.utterances(spark, d))


def _role_sql(expr, cond):
    return f"coalesce(string_agg({expr}, chr(10) ORDER BY utterance_id) FILTER ({cond}), '')"


@query(f"""WITH {PLACED} SELECT session_id, {_role_sql("coalesce(content, '')", "role = 'tutor'")} AS tutor_text, {_role_sql("coalesce(content, '')", "role = 'student'")} AS student_text,
 {_role_sql("coalesce(content, '')", "role = 'tutor' AND closing")} AS closing_tutor_text, {_role_sql("coalesce(content, '')", "role = 'student' AND closing")} AS closing_student_text, {_role_sql('line', 'opening')} AS opening_text FROM lines GROUP BY session_id""")
def role_texts(spark, d):
    return sessions.role_texts(B.utterances(spark, d))


def _sum(expr, cond):
    return f"coalesce(sum({expr}) FILTER ({cond}), 0)"


_W = "len(regexp_extract_all(content, '[\\p{L}\\p{N}_'']+'))"
_BEHAVIOR = f"""SELECT session_id, count_if(prev <> role) AS role_switches, {_sum(_W, "role='tutor'")} AS tutor_words, {_sum(_W, "role='student'")} AS student_words,
 {_sum("length(content) - length(replace(content, '?', ''))", "role='tutor'")} AS tutor_questions, {_sum("length(content) - length(replace(content, '?', ''))", "role='student'")} AS student_questions,
 {_sum(_sql_count('content', CUES['affirm']), "role='tutor'")} AS tutor_affirmations, {_sum(_sql_count('content', CUES['correction']), "role='tutor'")} AS tutor_corrections,
 {_sum(_sql_count('content', CUES['uncertainty']), "role='student'")} AS student_uncertainty, {_sum(_sql_count('content', CUES['reasoning']), "role='student'")} AS student_reasoning_cues,
 {_sum(_sql_count('content', CUES['reasoning']), "role='tutor'")} AS tutor_reasoning_cues,
 {_sum("len(regexp_extract_all(content, '\\b[0-9]+(?:\\.[0-9]+)?\\b'))", "role='student'")} AS student_digit_tokens, {_sum("len(regexp_extract_all(content, '\\b[0-9]+(?:\\.[0-9]+)?\\b'))", "role='tutor'")} AS tutor_digit_tokens,
 round({_sum(_W, "role='student'")} / greatest(1, count_if(role='student')), 6) AS student_mean_words, round({_sum(_W, "role='tutor'")} / greatest(1, count_if(role='tutor')), 6) AS tutor_mean_words,
 {_sum(_W, "role='student' AND closing")} AS closing_student_words, {_sum(_W, "role='tutor' AND closing")} AS closing_tutor_words FROM lines GROUP BY session_id"""


@query(f"WITH {PLACED} {_BEHAVIOR}")
def behavior(spark, d):
    return rounded(sessions.behavior(B.utterances(spark, d), CUES), "student_mean_words", "tutor_mean_words")


_RATIOS = {
    "student_tutor_words": ("student_words", "tutor_words"), "affirmation_rate": ("tutor_affirmations", "tutor_words"), "correction_rate": ("tutor_corrections", "tutor_words"),
    "uncertainty_rate": ("student_uncertainty", "student_words"), "reasoning_rate": ("student_reasoning_cues", "student_words"), "digit_rate": ("student_digit_tokens", "student_words"),
    "question_rate": ("tutor_questions", "tutor_words"), "closing_share": ("closing_student_words", "student_words"),
}


@query(f"WITH {PLACED}, b AS ({_BEHAVIOR}) SELECT session_id, {', '.join(f'round({a} / ({c} + 1), 6) AS {n}' for n, (a, c) in _RATIOS.items())} FROM b")
def behavior_ratios(spark, d):
    out = sessions.behavior_ratios(sessions.behavior(B.utterances(spark, d), CUES))
    return rounded(out.select("session_id", *_RATIOS), *_RATIOS)


@query(f"WITH {U} SELECT role, count(*) AS n_utterances, sum(length(coalesce(content, ''))) AS n_chars FROM utterances GROUP BY role")
def corpus_rollup(spark, d):
    return sessions.rollup(B.utterances(spark, d))


@query(f"""WITH {U}, {R}, f AS (SELECT session_id, count(*) AS n, count_if(role = 'student') AS s, count_if(role = 'tutor') AS t, count_if(role = 'background') AS b, count_if(coalesce(contains(lower(content), '[unclear]'), false)) AS u FROM utterances GROUP BY session_id)
 SELECT response_id, session_id, objective_id, target, n AS n_utterances, length(objective) AS objective_chars, len(list_filter(regexp_split_to_array(objective, '\\s+'), lambda x: x <> '')) AS objective_words,
 round(s / n, 6) AS student_fraction, round(t / n, 6) AS tutor_fraction, round(b / n, 6) AS background_fraction, round(u / n, 6) AS unclear_fraction FROM responses LEFT JOIN f USING (session_id)""")
def modeling_base(spark, d):
    out = sessions.modeling_base(B.responses(spark, d), sessions.session_features(B.utterances(spark, d)))
    shares = ["student_fraction", "tutor_fraction", "background_fraction", "unclear_fraction"]
    return rounded(out.select("response_id", "session_id", "objective_id", "target", "n_utterances", "objective_chars", "objective_words", *shares), *shares)


@query(f"WITH {R} SELECT count(*) AS responses, count(DISTINCT session_id) AS sessions, count(DISTINCT objective_id) AS objectives, round(avg(target), 6) AS positive_rate FROM responses")
def modeling_summary(spark, d):
    r = B.responses(spark, d)
    return r.agg(F.count("*").alias("responses"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("objective_id").alias("objectives"), F.round(F.avg("target"), 6).alias("positive_rate"))


def folds_sql(group, name="folded", source="responses", seed=7, k=5):
    return f"""{name}_g AS (SELECT {group} AS g, count(*) AS n, sum(target) AS pos, md5('{seed}|' || {group}) AS h FROM {source} GROUP BY {group}),
 {name}_f AS (SELECT g, (row_number() OVER (PARTITION BY n, pos, substr(h, 1, 1) ORDER BY h) + ('0x' || substr(md5(n || '|' || pos || '|' || substr(h, 1, 1)), 1, 6))::BIGINT) % {k} AS fold FROM {name}_g),
 {name} AS (SELECT s.*, f.fold FROM {source} s JOIN {name}_f f ON f.g = s.{group})"""


@query(f"WITH {R}, {folds_sql('session_id')} SELECT response_id, session_id, fold FROM folded")
def group_folds(spark, d):
    return splits.group_folds(B.responses(spark, d), "session_id").select("response_id", "session_id", "fold")


@query(f"""WITH {R}, {folds_sql('session_id')}, pairs AS (SELECT e.f AS eval_fold, a.* FROM folded a, (SELECT unnest(range(5)) AS f) e WHERE a.fold <> e.f AND NOT EXISTS (SELECT 1 FROM folded h WHERE h.fold = e.f AND h.session_id = a.session_id))
 SELECT fold, count(*) AS rows, count(DISTINCT session_id) AS sessions, count(DISTINCT objective_id) AS objectives, round(avg(target), 6) AS positive_rate, any_value(t.train_rows) AS train_rows, round(any_value(t.train_prior), 6) AS train_prior
 FROM folded LEFT JOIN (SELECT eval_fold, count(*) AS train_rows, avg(target) AS train_prior FROM pairs GROUP BY eval_fold) t ON t.eval_fold = fold GROUP BY fold""")
def fold_summary(spark, d):
    return rounded(splits.fold_summary(splits.group_folds(B.responses(spark, d), "session_id")), "positive_rate", "train_prior")


@query(f"""WITH {R}, {folds_sql('objective_id')}, pairs AS (SELECT e.f AS eval_fold, a.* FROM folded a, (SELECT unnest(range(5)) AS f) e WHERE a.fold <> e.f AND a.session_id NOT IN (SELECT session_id FROM folded h WHERE h.fold = e.f))
 SELECT eval_fold, count(*) AS train_rows, count(DISTINCT objective_id) AS objectives FROM pairs GROUP BY eval_fold""")
def objective_disjoint_train(spark, d):
    pairs = splits.purged_pairs(splits.group_folds(B.responses(spark, d), "objective_id"))
    return pairs.groupBy("eval_fold").agg(F.count("*").alias("train_rows"), F.count_distinct("objective_id").alias("objectives"))


PRIORS = f"""{R}, {folds_sql('session_id')}, others AS (SELECT a.fold, avg(b.target) AS g FROM (SELECT DISTINCT fold FROM folded) a JOIN folded b ON b.fold <> a.fold GROUP BY a.fold),
 priors AS (SELECT a.response_id, a.fold, a.objective_id, a.target, others.g AS global_prior, (coalesce(sum(b.target), 0) + 20e0 * others.g) / (count(b.target) + 20) AS objective_prior
 FROM folded a JOIN others USING (fold) LEFT JOIN folded b ON b.objective_id = a.objective_id AND b.fold <> a.fold GROUP BY a.response_id, a.fold, a.objective_id, a.target, others.g)"""


@query(f"WITH {PRIORS} SELECT response_id, fold, round(global_prior, 6) AS global_prior, round(objective_prior, 6) AS objective_prior FROM priors")
def objective_priors_oof(spark, d):
    out = splits.priors_leave_fold_out(splits.group_folds(B.responses(spark, d), "session_id"))
    return rounded(out.select("response_id", "fold", "global_prior", "objective_prior"), "global_prior", "objective_prior")


@query(f"WITH {R} SELECT objective_id, count(*) AS n, round((SELECT avg(target) FROM responses), 6) AS global_prior, round((sum(target) + 20e0 * (SELECT avg(target) FROM responses)) / (count(*) + 20), 6) AS prior FROM responses GROUP BY objective_id")
def objective_priors(spark, d):
    return rounded(splits.objective_priors(B.responses(spark, d)), "global_prior", "prior")


def metrics_sql(source, by, p="p"):
    """All metrics by the columns by of a relation with target and p."""
    b, same = ", ".join(by), " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in by)
    using = ", ".join(by)
    return f"""SELECT {b}, rows, positive_rate, log_loss, brier, prediction_mean, auc, ece FROM (
 SELECT {b}, count(*) AS rows, round(avg(target), 6) AS positive_rate, round(avg(-(target * ln(q) + (1 - target) * ln(1 - q))), 6) AS log_loss, round(avg((q - target) ** 2), 6) AS brier, round(avg(q), 6) AS prediction_mean FROM (SELECT *, least(greatest({p}, 1e-6), 1 - 1e-6) AS q FROM {source}) GROUP BY {b})
 JOIN (SELECT {b}, CASE WHEN np > 0 AND nn > 0 THEN round((rs - np * (np + 1) / 2) / (np * nn), 6) END AS auc FROM (SELECT {b}, sum(target) AS np, sum(1 - target) AS nn, sum(r * target) AS rs FROM (
   SELECT *, rank() OVER (PARTITION BY {b} ORDER BY q) + (count(*) OVER (PARTITION BY {b}, q) - 1) / 2 AS r FROM (SELECT *, least(greatest({p}, 1e-6), 1 - 1e-6) AS q FROM {source})) GROUP BY {b})) USING ({using})
 JOIN (SELECT {b}, round(sum(n * abs(y - q)) / sum(n), 6) AS ece FROM (SELECT {b}, bin, count(*) AS n, avg(target) AS y, avg(q) AS q FROM (SELECT *, {' + '.join(f'(q >= {i / 10})::INT' for i in range(1, 10))} AS bin FROM (SELECT *, least(greatest({p}, 1e-6), 1 - 1e-6) AS q FROM {source})) GROUP BY {b}, bin) GROUP BY {b}) USING ({using})"""


METRIC_COLUMNS = ("positive_rate", "log_loss", "brier", "prediction_mean", "auc", "ece")


@query(f"WITH {PRIORS}, scored AS (SELECT 'objective_prior' AS model, fold, target, objective_prior AS p FROM priors UNION ALL SELECT 'objective_prior', -1, target, objective_prior FROM priors) {metrics_sql('scored', ['model', 'fold'])}")
def prior_scorecard(spark, d):
    """The flagship: folds, priors that leave the fold out, exact metrics pooled (fold -1) and by fold."""
    oof = splits.priors_leave_fold_out(splits.group_folds(B.responses(spark, d), "session_id"))
    scored = oof.select(F.lit("objective_prior").alias("model"), "fold", "target", F.col("objective_prior").alias("p"))
    return rounded(metrics.pooled_and_by_fold(scored, ["model"]), *METRIC_COLUMNS)


def long_predictions(df):
    """One row per prediction and model."""
    models = ["v02", "semantic", "bge_base", "nbsvm", "combined"]
    return df.withColumn("_m", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in models]))).select("response_id", "session_id", "objective_id", "protocol", "target", "_m.*")


LONG = f"{P}, long AS (SELECT response_id, session_id, objective_id, protocol, target, unnest(['v02', 'semantic', 'bge_base', 'nbsvm', 'combined']) AS model, unnest([v02, semantic, bge_base, nbsvm, combined]) AS p FROM predictions)"


@query(f"WITH {LONG} {metrics_sql('long', ['protocol', 'model'])}")
def model_metrics(spark, d):
    return rounded(metrics.all_metrics(long_predictions(B.predictions(spark, d)), ["protocol", "model"]), *METRIC_COLUMNS)


@query(f"""WITH {P}, freq AS (SELECT *, count(*) OVER (PARTITION BY protocol, objective_id) AS frequency, count(*) OVER (PARTITION BY protocol, session_id) AS per_session, abs(response_id) % 5 AS fold FROM predictions),
 reg AS (SELECT protocol, target, v02 AS p, fold, 'q' || (least(floor((rank() OVER (PARTITION BY protocol ORDER BY frequency) + (count(*) OVER (PARTITION BY protocol, frequency) - 1) / 2) / count(*) OVER (PARTITION BY protocol) * 5), 4) + 1)::INT AS frequency_regime,
 CASE per_session WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'three_plus' END AS session_objectives FROM freq),
 tidy AS (SELECT protocol, target, p, unnest(['overall', 'fold', 'frequency_regime', 'session_objectives']) AS regime, unnest(['all', fold::VARCHAR, frequency_regime, session_objectives]) AS value FROM reg) {metrics_sql('tidy', ['protocol', 'regime', 'value'])}""")
def regime_scorecard(spark, d):
    p = B.predictions(spark, d)
    own = lambda c: F.count("*").over(Window.partitionBy("protocol", c))
    p = p.withColumns({"frequency": own("objective_id"), "_s": own("session_id"), "fold": F.abs("response_id") % 5})
    p = metrics.quantile_regime(p, "frequency", "frequency_regime", ["protocol"]).withColumn("session_objectives", F.when(F.col("_s") == 1, "one").when(F.col("_s") == 2, "two").otherwise("three_plus"))
    return rounded(metrics.scorecard(p, ["frequency_regime", "session_objectives"], p="v02"), *METRIC_COLUMNS)


@query(f"""WITH {U}, {R} SELECT 'key' AS rule, (SELECT count(*) FROM (SELECT 1 FROM utterances GROUP BY session_id, utterance_id HAVING count(*) > 1)) AS violations
 UNION ALL SELECT 'contiguous', (SELECT count(*) FROM (SELECT 1 FROM utterances GROUP BY session_id HAVING NOT (min(utterance_id) = 0 AND max(utterance_id) = count(*) - 1 AND count(DISTINCT utterance_id) = count(*))))
 UNION ALL SELECT 'sessions_exist', (SELECT count(*) FROM responses WHERE session_id NOT IN (SELECT session_id FROM utterances))
 UNION ALL SELECT 'target_domain', (SELECT count(*) FROM responses WHERE target IS NULL OR target NOT IN (0, 1)) UNION ALL SELECT 'objective_not_null', (SELECT count(*) FROM responses WHERE objective IS NULL)
 UNION ALL SELECT 'event_order', (SELECT count(*) FROM (SELECT value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p > value)
 UNION ALL SELECT 'labels_vs_documents', (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM labels) a FULL JOIN (SELECT DISTINCT doc_id FROM documents) b USING (doc_id) WHERE a.doc_id IS NULL OR b.doc_id IS NULL)
 UNION ALL SELECT 'finite_vectors', (SELECT count(*) FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0)""")
def expectations(spark, d):
    tables = {"utterances": B.utterances(spark, d), "responses": B.responses(spark, d)} | {n: B.table(spark, d, n) for n in ("labels", "documents", "embeddings")}
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    tables["events"] = B.table(spark, d, "events").withColumn("before", before)
    wanted = [
        rules.unique("key", "utterances", ["session_id", "utterance_id"]),
        rules.contiguous("contiguous", "utterances", ["session_id"], "utterance_id"),
        rules.references("sessions_exist", "responses", ["session_id"], "utterances"),
        rules.rows("target_domain", "responses", ["response_id"], ~F.col("target").isin(0, 1)),
        rules.rows("objective_not_null", "responses", ["response_id"], F.col("objective").isNull()),
        rules.rows("event_order", "events", ["event_id"], F.coalesce(F.col("before") > F.col("value"), F.lit(False))),
        rules.same_keys("labels_vs_documents", "labels", ["doc_id"], "documents"),
        rules.rows("finite_vectors", "embeddings", ["vec_id"], F.coalesce(expect.finite("embedding"), F.lit(False))),
    ]
    return rules.summary(rules.violations(tables, wanted), wanted).select("rule", "violations")


@query(f"""WITH {U}, {R}, steps AS (SELECT *, lag(sec) OVER w AS before, lag(utterance_id) OVER w AS place FROM utterances WINDOW w AS (PARTITION BY session_id ORDER BY utterance_id)),
 folds AS (SELECT *, response_id % 5 AS fold FROM responses)
 SELECT 'key' AS rule, concat('["', session_id, '","', utterance_id, '"]') AS key, NULL::BIGINT AS at, count(*) AS rows FROM utterances GROUP BY session_id, utterance_id HAVING count(*) > 1
 UNION ALL SELECT 'contiguous', concat('["', session_id, '"]'), utterance_id, 1 FROM steps WHERE coalesce(place, -1) <> utterance_id - 1
 UNION ALL SELECT 'pace', concat('["', session_id, '"]'), utterance_id, 1 FROM steps WHERE place = utterance_id - 1 AND length(content) < (SELECT max(length(b.content)) FROM utterances b WHERE b.session_id = steps.session_id AND b.utterance_id = place)
 UNION ALL SELECT 'one_fold', concat('["', session_id, '"]'), NULL, count(*) FROM folds GROUP BY session_id HAVING count(DISTINCT fold) > 1
 UNION ALL SELECT 'items_asked', concat('["', b.item_id, '"]'), NULL, 1 FROM benchmark b WHERE b.item_id NOT IN (SELECT objective_id FROM responses)
 UNION ALL SELECT 'no_overlap', concat('["', l.doc_id, '"]'), NULL, 1 FROM labels l WHERE l.doc_id IN (SELECT vec_id FROM embeddings)
 UNION ALL SELECT 'negative', concat('["', response_id, '"]'), NULL, 1 FROM responses WHERE target = 0""")
def rule_violations(spark, d):
    """The keys that break rules, some of which these tables can't keep: one scan a table, one shuffle for all rules."""
    tables = {n: B.table(spark, d, n) for n in ("benchmark", "labels", "embeddings")}
    tables["utterances"], tables["responses"] = B.utterances(spark, d), B.responses(spark, d).withColumn("fold", F.col("response_id") % 5)
    wanted = [
        rules.unique("key", "utterances", ["session_id", "utterance_id"]),
        rules.contiguous("contiguous", "utterances", ["session_id"], "utterance_id"),
        rules.ascending("pace", "utterances", ["session_id"], "utterance_id", F.length("content")),
        rules.one_value("one_fold", "responses", ["session_id"], F.col("fold")),
        rules.references("items_asked", "benchmark", ["item_id"], "responses", ["objective_id"]),
        rules.disjoint("no_overlap", "labels", ["doc_id"], "embeddings", ["vec_id"]),
        rules.rows("negative", "responses", ["response_id"], F.col("target") == 0),
    ]
    return rules.violations(tables, wanted).drop("kind")


@query(f"""WITH {R}, {folds_sql('session_id')}, d AS (SELECT protocol, count(DISTINCT response_id) AS n FROM (SELECT response_id, unnest(['p0', 'p1']) AS protocol FROM responses) GROUP BY protocol)
 SELECT 'fold_per_session' AS rule, (SELECT count(*) FROM (SELECT 1 FROM folded GROUP BY session_id HAVING count(DISTINCT fold) > 1)) AS violations UNION ALL SELECT 'fold_assigned', (SELECT count_if(fold IS NULL OR fold NOT BETWEEN 0 AND 4) FROM folded)
 UNION ALL SELECT 'no_leak', (SELECT count(*) FROM (SELECT DISTINCT a.session_id, h.fold FROM folded a JOIN folded h ON a.session_id = h.session_id AND a.fold <> h.fold)) UNION ALL SELECT 'same_cardinality', (SELECT count(DISTINCT n) - 1 FROM d)""")
def fold_expectations(spark, d):
    f = splits.group_folds(B.responses(spark, d), "session_id")
    return expect.all_of(
        expect.one_value_per_group(f, "session_id", "fold", "fold_per_session"),
        expect.row_rules(f, {"fold_assigned": ~F.col("fold").between(0, 4)}),
        expect.purged(splits.purged_pairs(f), f, ["session_id"], "no_leak"),
        expect.same_cardinality(B.predictions(spark, d), "protocol", "response_id"),
    )


@query(f"""WITH {R}, sizes AS (SELECT objective_id, target, count(*) AS size FROM responses GROUP BY ALL), e AS (SELECT *, size * least(60, (SELECT count(*) FROM responses)) / (SELECT count(*) FROM responses) AS exact FROM sizes),
 q AS (SELECT *, floor(exact) + (row_number() OVER (ORDER BY round(exact - floor(exact), 9) DESC, objective_id, target) <= least(60, (SELECT count(*) FROM responses)) - (SELECT sum(floor(exact)) FROM e))::INT AS quota FROM e)
 SELECT response_id FROM (SELECT response_id, quota, row_number() OVER (PARTITION BY objective_id, target ORDER BY md5('7|' || response_id), response_id) AS nth FROM responses JOIN q USING (objective_id, target)) WHERE nth <= quota""")
def stratified_sample(spark, d):
    return splits.stratified_sample(B.responses(spark, d), ["objective_id", "target"], 60, "response_id").select("response_id")


_STEM = "CASE WHEN w LIKE '%ing' AND length(w) > 6 THEN w[:-4] WHEN w LIKE '%ied' AND length(w) > 5 THEN w[:-4] || 'y' WHEN w LIKE '%ed' AND length(w) > 5 THEN w[:-3] WHEN w LIKE '%es' AND length(w) > 5 THEN w[:-3] WHEN w LIKE '%s' AND length(w) > 4 THEN w[:-2] ELSE w END"


def tokens_sql(col):
    return f"list_transform(regexp_extract_all(lower(coalesce({col}, '')), '[a-z0-9]+'), lambda w: {_STEM})"


STOP_SQL = "(" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + ")"


def terms_sql(col):
    return f"list_sort(list_distinct(list_filter({tokens_sql(col)}, lambda w: length(w) >= 3 AND w NOT IN {STOP_SQL})))"


@query(f"SELECT item_id, {tokens_sql('text')} AS tokens, {terms_sql('text')} AS terms, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[:5], ' ') AS compact FROM benchmark")
def objective_terms(spark, d):
    t = F.col("text")
    return B.table(spark, d, "benchmark").select("item_id", T.tokens(t).alias("tokens"), F.array_sort(T.terms(t)).alias("terms"), T.compact(t, 5).alias("compact"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_'']+')) AS words, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS space_words, length(text) - length(replace(text, ',', '')) AS commas FROM documents")
def text_counts(spark, d):
    t = F.col("text")
    return B.table(spark, d, "documents").select("doc_id", T.word_count(t).alias("words"), T.space_words(t).alias("space_words"), T.char_count(t, ",").alias("commas"))


_GRAMS = " UNION ALL ".join(f"SELECT item_id, unnest(list_transform(range(1, greatest(1, length(w) - {n} + 1) + 1), lambda i: substr(w, i, {n}))) AS term FROM padded" for n in (3, 4, 5))


@query(f"""WITH words AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS x FROM benchmark), padded AS (SELECT item_id, ' ' || x || ' ' AS w FROM words), grams AS ({_GRAMS})
 SELECT item_id, term, ('0x' || substr(md5(term), 1, 8))::BIGINT % 131072 AS bucket, count(*) AS tf FROM grams GROUP BY ALL""")
def char_ngrams(spark, d):
    g = B.table(spark, d, "benchmark").select("item_id", F.explode(T.padded_ngrams(F.col("text"), 3, 5)).alias("term"))
    return g.groupBy("item_id", "term").agg(F.count("*").alias("tf")).withColumn("bucket", T.bucket(F.col("term"), 1 << 17))
