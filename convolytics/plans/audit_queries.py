"""Queries on rules between runs, recipes, shrinkage, regimes, hashed fields and TF-IDF by fold, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convolytics.functions import text as T
from convolytics.operators import ensembles, expect, metrics, sessions, sparse, splits, vectors
from convolytics.plans.feature_queries import _AUDITED, REGIMES, _base, candidate_regime_card, regime_columns
from convolytics.plans.session_queries import METRIC_COLUMNS, PLACED, P, R, folds_sql, long_predictions, metrics_sql, rounded, tokens_sql
from convolytics.sources import bindings as B
from convolytics.sources import sinks

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


_HELD = "SELECT a.eval_fold, a.{0} AS k FROM pairs a JOIN folded h ON h.fold = a.eval_fold AND h.{0} = a.{0}"


@query(f"""WITH {P}, {folds_sql('objective_id')}, pairs AS (SELECT e.f AS eval_fold, a.* FROM folded a, (SELECT unnest(range(5)) AS f) e WHERE a.fold <> e.f AND a.session_id NOT IN (SELECT session_id FROM folded h WHERE h.fold = e.f)),
 runs AS (SELECT abs(response_id) % 5 AS fold, count(DISTINCT protocol) AS protocols FROM predictions GROUP BY ALL)
 SELECT 'purged' AS rule, (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_HELD.format('session_id')}))) + (SELECT count(*) FROM (SELECT DISTINCT * FROM ({_HELD.format('objective_id')}))) AS violations
 UNION ALL SELECT 'row_counts', (SELECT count(*) FROM (SELECT protocol, count(*) AS n FROM predictions GROUP BY protocol) WHERE n <> (SELECT count(*) FROM responses))
 UNION ALL SELECT 'digest', (SELECT count_if(NOT regexp_full_match(sha256(html), '[0-9a-f]{{64}}')) FROM pages)
 UNION ALL SELECT 'identical_settings', (SELECT greatest(count(DISTINCT protocols) - 1, 0) + 5 - count(DISTINCT fold) + count(*) - count(DISTINCT fold) FROM runs)
 UNION ALL SELECT 'complete', (SELECT count(DISTINCT protocol) FILTER (protocol NOT IN ('p0', 'p1')) + 3 - count(DISTINCT protocol) FILTER (protocol IN ('p0', 'p1')) FROM predictions)
 UNION ALL SELECT 'locked_model', 4 UNION ALL SELECT 'aligned', (SELECT count(*) FROM (SELECT DISTINCT doc_id FROM labels) a FULL JOIN documents b USING (doc_id) WHERE a.doc_id IS NULL OR b.doc_id IS NULL)""")
def run_expectations(spark, d):
    """Rules between runs; two of them are broken on purpose: a third protocol is asked for, five models are there."""
    r, p = B.responses(spark, d), B.predictions(spark, d)
    folded = splits.group_folds(r, "objective_id")
    found = p.groupBy("protocol").agg(F.count("*").alias("rows"))
    recorded = p.select("protocol").distinct().crossJoin(r.agg(F.count("*").alias("rows")))  # one row
    runs = p.groupBy((F.abs("response_id") % 5).alias("fold")).agg(F.count_distinct("protocol").alias("protocols"))
    return expect.all_of(
        expect.purged(splits.purged_pairs(folded), folded, ["session_id", "objective_id"]),
        expect.row_counts(recorded, found, "protocol"),
        expect.row_rules(B.table(spark, d, "pages"), {"digest": expect.matches("[0-9a-f]{64}", F.sha2("html", 256))}),
        expect.identical_settings(runs, ["protocols"]),
        expect.complete(p, "protocol", ["p0", "p1", "p2"]),
        expect.single_value(long_predictions(p), "model", "locked_model"),
        expect.aligned(B.table(spark, d, "labels"), B.table(spark, d, "documents"), ["doc_id"]),
    )


_RECIPES_SQL = " UNION ALL ".join(f"SELECT '{n}' AS recipe, protocol, target, {' + '.join(f'{w} * {c}' for c, w in ws.items())} AS p FROM predictions" for n, ws in ensembles.RECIPES.items())


@query(f"WITH {P}, mixed AS ({_RECIPES_SQL}) {metrics_sql('mixed', ['protocol', 'recipe'])}")
def recipe_metrics(spark, d):
    return rounded(metrics.all_metrics(ensembles.recipes(B.predictions(spark, d)), ["protocol", "recipe"]), *METRIC_COLUMNS)


@query(f"WITH {P} SELECT response_id, protocol, round(v02, 6) AS v02, round(semantic, 6) AS semantic, round(bge_base, 6) AS bge_base, round(nbsvm, 6) AS nbsvm FROM predictions")
def component_chain(spark, d):
    long = long_predictions(B.predictions(spark, d))
    parts = {m: long.where(F.col("model") == m) for m in ("v02", "semantic", "bge_base", "nbsvm")}
    return rounded(ensembles.component_chain(parts), *parts)


@query(f"""WITH {P}, fp AS (SELECT *, abs(response_id) % 5 AS fold FROM predictions), prior AS (SELECT a.fold, avg(b.target) AS prior FROM (SELECT DISTINCT fold FROM fp) a JOIN fp b ON b.fold <> a.fold GROUP BY a.fold),
 g AS (SELECT protocol, weight, round(avg(-(target * ln(q) + (1 - target) * ln(1 - q))), 9) AS log_loss FROM (SELECT protocol, target, weight, least(greatest((1 - weight) * prior + weight * v02, 1e-6), 1 - 1e-6) AS q FROM fp JOIN prior USING (fold), (SELECT unnest(range(101)) / 100e0 AS weight)) GROUP BY ALL)
 SELECT protocol, arg_min(weight, (log_loss, weight)) AS weight, round(min(log_loss), 6) AS log_loss FROM g GROUP BY protocol""")
def shrink_to_fold_prior(spark, d):
    p = B.predictions(spark, d).withColumn("fold", F.abs("response_id") % 5)
    sums = p.groupBy("fold").agg(F.sum("target").alias("y"), F.count("*").alias("n"))
    total = sums.agg(F.sum("y").alias("ty"), F.sum("n").alias("tn"))
    prior = sums.crossJoin(total).select("fold", ((F.col("ty") - F.col("y")) / (F.col("tn") - F.col("n"))).alias("prior"))  # one row
    return rounded(ensembles.shrink_search(p.join(prior, "fold"), "v02", "prior"), "log_loss")


@query(f"""WITH {P}, mixed AS (SELECT protocol, abs(response_id) % 5 AS f, target, unnest(['own', 'base']) AS model, unnest([0.7 * v02 + 0.3 * nbsvm, v02]) AS p FROM predictions), both_ AS (SELECT protocol, f AS fold, target, model, p FROM mixed UNION ALL SELECT protocol, -1, target, model, p FROM mixed),
 m AS ({metrics_sql('both_', ['protocol', 'fold', 'model'])}), dl AS (SELECT a.protocol, a.fold, a.log_loss - b.log_loss AS dl, a.auc - b.auc AS da FROM m a JOIN m b ON a.protocol = b.protocol AND a.fold = b.fold AND b.model = 'base' WHERE a.model = 'own')
 SELECT protocol, fold, round(dl, 4) AS delta_log_loss, round(da, 4) AS delta_auc, count_if(fold >= 0 AND dl < 0) OVER (PARTITION BY protocol) AS wins FROM dl""")
def locked_weight_folds(spark, d):
    """The locked blend of 0.3 over the folds' predictions, against its base."""
    p = B.predictions(spark, d).withColumns({"fold": F.abs("response_id") % 5, "own": ensembles.blend({"v02": 0.7, "nbsvm": 0.3})})
    return rounded(ensembles.fold_deltas(p, "own", "v02"), "delta_log_loss", "delta_auc", digits=4)


_LB = f"{P}, long AS (SELECT protocol, target, unnest(['v02', 'semantic', 'bge_base', 'nbsvm', 'combined']) AS model, unnest([v02, semantic, bge_base, nbsvm, combined]) AS p FROM predictions)"


@query(f"WITH {_LB}, m AS ({metrics_sql('long', ['protocol', 'model'])}) SELECT protocol, model, log_loss, auc FROM m ORDER BY log_loss, auc DESC NULLS LAST, protocol, model LIMIT 4")
def leaderboard(spark, d):
    m = rounded(metrics.all_metrics(long_predictions(B.predictions(spark, d)), ["protocol", "model"]), "log_loss", "auc")
    return ensembles.leaderboard(m, 4).select("protocol", "model", "log_loss", "auc")


@query(f"WITH {_AUDITED} SELECT protocol, model, regime, value, rows, round(dloss, 5) AS delta_log_loss, round(dauc, 5) AS delta_auc FROM dl")
def candidate_regimes(spark, d):
    """Each candidate's metrics less the baseline's, by protocol, regime and value."""
    card = candidate_regime_card(spark, d)
    base = card.where("model = 'v02'").select("protocol", "regime", "value", F.col("log_loss").alias("_l"), F.col("auc").alias("_a"))
    both = card.where("model <> 'v02'").join(base, ["protocol", "regime", "value"])
    out = both.select("protocol", "model", "regime", "value", "rows", (F.col("log_loss") - F.col("_l")).alias("delta_log_loss"), (F.col("auc") - F.col("_a")).alias("delta_auc"))
    return rounded(out, "delta_log_loss", "delta_auc", digits=5)


@query(f"""WITH {P}, z AS (SELECT response_id, v02 AS a, semantic AS b, bge_base AS c, greatest(v02, semantic, bge_base) AS m FROM predictions WHERE protocol = 'p0'), e AS (SELECT *, exp(a - m) + exp(b - m) + exp(c - m) AS s FROM z)
 SELECT response_id, round(a, 6) AS logit_entails, round(b, 6) AS logit_neutral, round(c, 6) AS logit_contradicts, round(exp(a - m) / s, 6) AS p_entails, round(exp(b - m) / s, 6) AS p_neutral, round(exp(c - m) / s, 6) AS p_contradicts,
 round((exp(a - m) - exp(c - m)) / s, 6) AS p_entails_less_contradicts, round((exp(a - m) - exp(b - m)) / s, 6) AS p_entails_less_neutral, round(a - c, 6) AS logit_entails_less_contradicts FROM e""")
def softmax_features(spark, d):
    f = ensembles.softmax(["v02", "semantic", "bge_base"], ["entails", "neutral", "contradicts"])
    p = B.predictions(spark, d).where("protocol = 'p0'")  # protocols repeat the same predictions
    return rounded(p.select("response_id", *[c.alias(n) for n, c in f.items()]), *f)


@query(f"""WITH {R}, s AS (SELECT conv_id AS session_id, count(*) AS n, sum(length(text)) AS c FROM conversations GROUP BY conv_id)
 SELECT response_id, round(ln(1 + n), 6) AS n_utterances, round(ln(1 + c), 6) AS n_chars, round(ln(1 + length(objective)), 6) AS objective_chars FROM responses JOIN s USING (session_id)""")
def log_counts(spark, d):
    names = ["n_utterances", "n_chars", "objective_chars"]
    return rounded(sessions.log_counts(_base(spark, d).select("response_id", *names), names), *names)


_N = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query(f"SELECT source, count(*) AS texts, round(avg({_N}), 6) AS mean_tokens, round(quantile_cont({_N}, 0.95), 6) AS p95_tokens, max({_N}) AS max_tokens FROM documents GROUP BY source")
def token_lengths(spark, d):
    return rounded(sessions.token_lengths(B.table(spark, d, "documents"), by=["source"]), "mean_tokens", "p95_tokens")


@query("SELECT doc_id, CASE WHEN n_chars > 2000 THEN md5(text) ELSE 'kept' END AS digest FROM documents")
def replaced_rows(spark, d):
    """Only long texts are computed anew; the audit finds that the others stayed."""
    docs = B.table(spark, d, "documents")
    stored = docs.select("doc_id", F.lit("kept").alias("digest"), "n_chars")
    out = sessions.replace_rows(stored, docs.select("doc_id", F.md5("text").alias("digest"), "n_chars"), "doc_id", F.col("n_chars") > 2000)
    return sessions.audited(stored, sinks.materialize(out, "replaced"), F.col("n_chars") > 2000).select("doc_id", "digest")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def remaining_rows(spark, d):
    return sessions.remaining(B.table(spark, d, "documents").select("doc_id"), B.table(spark, d, "labels"), ["doc_id"])


_REGIME_COLS = ", ".join(REGIMES)


@query(f"WITH {_AUDITED} SELECT response_id, {_REGIME_COLS}, session_objectives FROM regimes")
def regime_frame(spark, d):
    return regime_columns(spark, d)


_FIELDS = {"student_text": "role = 'student'", "tutor_text": "role = 'tutor'", "closing_student_text": "role = 'student' AND closing", "closing_tutor_text": "role = 'tutor' AND closing"}
_FIELD_ROWS = " UNION ALL ".join(f"SELECT session_id, '{n}' AS field, unnest({tokens_sql('content')}) AS term FROM lines WHERE {c}" for n, c in _FIELDS.items()) + f" UNION ALL SELECT session_id, 'opening_text', unnest({tokens_sql('line')}) FROM lines WHERE opening"
_BUCKET = "('0x' || substr(md5(term), 1, 8))::BIGINT % {}"


def _field_lists(spark, d):
    """session_id and, by name, (slot, n) of the words of the five role texts. Each is counted within its row."""
    names = [*_FIELDS, "opening_text"]
    texts = sessions.role_texts(B.utterances(spark, d))
    return texts.select("session_id", *[sparse.slot_counts(T.tokens(F.col(n)), 1 << 16).alias(n) for n in names]), names


def _field_terms(spark, d):
    """session_id, field, term of the five role texts."""
    names = [*_FIELDS, "opening_text"]
    texts = sessions.role_texts(B.utterances(spark, d))
    rows = texts.select("session_id", F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("text")) for n in names])).alias("f"))
    return rows.select("session_id", "f.field", F.explode(T.tokens(F.col("f.text"))).alias("term"))


@query(f"WITH {PLACED}, t AS ({_FIELD_ROWS}) SELECT session_id, field, {_BUCKET.format(65536)} AS bucket, count(*) AS tf FROM t GROUP BY ALL")
def role_field_hashes(spark, d):
    lists, names = _field_lists(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("counts")) for n in names])).alias("f")
    rows = lists.select("session_id", each).select("session_id", "f.field", F.inline("f.counts"))
    return rows.select("session_id", "field", F.col("slot").alias("bucket"), F.col("n").alias("tf"))


_UNIT = "SELECT *, tf / sqrt(sum(tf * tf) OVER (PARTITION BY {0})) AS w FROM {1}"


@query(f"""WITH {PLACED}, {R}, t AS ({_FIELD_ROWS}), h AS (SELECT session_id, field, {_BUCKET.format(65536)} AS bucket, count(*) AS tf FROM t GROUP BY ALL), f AS ({_UNIT.format('session_id, field', 'h')}),
 ot AS (SELECT objective_id, unnest({tokens_sql('objective')}) AS term FROM (SELECT DISTINCT objective_id, objective FROM responses)), oh AS (SELECT objective_id, {_BUCKET.format(65536)} AS bucket, count(*) AS tf FROM ot GROUP BY ALL), o AS ({_UNIT.format('objective_id', 'oh')})
 SELECT response_id, field, round(sum(f.w * o.w), 6) AS cosine FROM responses JOIN f USING (session_id) JOIN o ON o.objective_id = responses.objective_id AND o.bucket = f.bucket GROUP BY ALL""")
def role_alignment(spark, d):
    """Cosines of each role's words with the objective's; pairs without a common word are left out."""
    r, (lists, names) = B.responses(spark, d), _field_lists(spark, d)
    words = r.select("objective_id", "objective").distinct().select("objective_id", F.explode(T.tokens(F.col("objective"))).alias("term"))
    asked = vectors.unit_counts(vectors.hashed_counts(words, ["objective_id"], 1 << 16), ["objective_id"])
    asked = asked.groupBy("objective_id").agg(F.collect_list(F.struct("bucket", "w")).alias("asked"))  # as long as the objective
    both = r.select("response_id", "session_id", "objective_id").join(asked, "objective_id").join(lists, "session_id")

    def products(counts: Column) -> Column:
        """Of the objective's words that a role has, their weights times its weight; its words aren't made rows."""
        values = sparse.slot_values(counts)
        shared = lambda v: F.transform(F.filter("asked", lambda x: F.array_contains(v["slot"], x["bucket"])), lambda x: x["w"] * F.get(v["value"], F.array_position(v["slot"], x["bucket"]).cast("int") - 1))
        return F.get(F.transform(F.array(values), shared), F.lit(0))

    each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), products(F.col(n)).alias("p")) for n in names])).alias("f")
    near = both.select("response_id", each).select("response_id", "f.*").where(F.size("p") > 0)
    near = near.select("response_id", "field", F.aggregate("p", F.lit(0.0), lambda s, x: s + x).alias("cosine"))
    return rounded(near.groupBy("response_id", "field").agg(F.sum("cosine").alias("cosine")), "cosine")


@query(f"""WITH {R}, {folds_sql('objective_id')}, docs AS (SELECT DISTINCT fold, objective_id, objective FROM folded), bt AS (SELECT fold, objective_id, unnest({tokens_sql('objective')}) AS term FROM docs), tf AS (SELECT fold, objective_id, term, count(*) AS tf FROM bt GROUP BY ALL),
 df AS (SELECT e.f AS eval_fold, term, count(*) AS df FROM tf, (SELECT unnest(range(5)) AS f) e WHERE fold <> e.f GROUP BY ALL HAVING count(*) >= 2), n AS (SELECT e.f AS eval_fold, count(DISTINCT objective_id) AS n FROM docs, (SELECT unnest(range(5)) AS f) e WHERE fold <> e.f GROUP BY ALL),
 w AS (SELECT fold, objective_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df ON eval_fold = fold AND df.term = tf.term JOIN n ON n.eval_fold = fold) SELECT fold, objective_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY objective_id)), 6) AS weight FROM w""".replace("SELECT fold, objective_id, term, (1 + ln(tf))", "SELECT fold, objective_id, tf.term AS term, (1 + ln(tf))"))
def fold_tf_idf(spark, d):
    """TF-IDF of each fold's objectives, with the vocabulary and frequencies of the other folds' distinct objectives."""
    docs = splits.group_folds(B.responses(spark, d), "objective_id").select("fold", "objective_id", "objective").distinct()
    terms = docs.select("fold", F.col("objective_id").alias("doc"), F.explode(T.tokens(F.col("objective"))).alias("term"))
    return rounded(vectors.fold_tf_idf(terms).withColumnRenamed("doc", "objective_id"), "weight")
