"""Queries on evidence views, blends of pairs, gates, families, sparse models and scoring as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from convolytics.functions import text as T
from convolytics.operators import ensembles, models, splits, vectors, views
from convolytics.plans.feature_queries import _BT, NUMERIC, _PROTO, _TURNS, ASKED, SCORE, _base, _embedded, _spoken, _texts, part_sql, vector_facts, vector_facts_sql
from convolytics.plans.session_queries import P, R, metrics_sql, rounded, terms_sql, tokens_sql
from convolytics.sources import bindings as B
from convolytics.sources import sinks
from convolytics.sources.bindings import CUES
from convolytics.streaming.scoring import score_stream

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


_LISTED = lambda cues: "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in cues) + "]"
_HELD = lambda cues, col: f"len(list_filter({_LISTED(cues)}, lambda c: contains(lower({col}), c)))"
_SHORT = lambda col, n: f"array_to_string(list_filter(regexp_split_to_array({col}, '\\s+'), lambda x: x <> '')[:{n}], ' ')"
_SCORED = f"""{_TURNS}, {ASKED},
 sc AS (SELECT response_id, objective, at_, role, content, {SCORE} AS score,
  CASE WHEN role = 'tutor' THEN {_HELD(T.POSITIVE_FEEDBACK + T.CORRECTIVE_FEEDBACK, 'content')} ELSE 0.5e0 * {_HELD(T.STUDENT_REASONING + T.STUDENT_UNCERTAINTY, 'content')} END AS bonus FROM asked JOIN turns USING (session_id))"""


def _picked(source, top, last, line, out, named=None):
    """SQL for views.pick and the rendering of what is kept; named: as a relation of this name, which is then read."""
    if named:
        chosen, shown = _picked(source, top, last, line, out).rsplit("\n", 1)
        return f"{chosen}, {named} AS ({shown.strip()}) SELECT * FROM {named}"
    return f"""ranked AS (SELECT *, count(*) OVER g AS cnt, row_number() OVER (PARTITION BY response_id ORDER BY at_) - 1 AS pos, row_number() OVER (PARTITION BY response_id ORDER BY round(score, 9) DESC, at_ DESC) AS nth FROM {source} WINDOW g AS (PARTITION BY response_id)),
 marked AS (SELECT *, (nth <= {top} AND score > 0) OR pos >= cnt - {last} AS kept FROM ranked), filled AS (SELECT *, kept OR (sum(kept::INT) OVER (PARTITION BY response_id) < least(4, cnt) AND pos IN (0, cnt - 1, (cnt - 1) // greatest(1, least(4, cnt) - 1), CASE WHEN cnt >= 4 THEN 2 * (cnt - 1) // 3 ELSE 0 END)) AS kept2 FROM marked),
 body AS (SELECT response_id, string_agg({line}, chr(10) ORDER BY at_) AS body FROM filled WHERE kept2 GROUP BY response_id)
 SELECT response_id, '[OBJECTIVE] ' || trim(coalesce(objective, '')) || coalesce(chr(10) || body, '') AS {out} FROM responses LEFT JOIN body USING (response_id)"""


def _turns(spark, d):
    return views.scored_turns(_texts(spark, d), B.responses(spark, d))


@query(f"WITH {_SCORED}, mine AS (SELECT * FROM sc WHERE role = 'student'), {_picked('mine', 6, 4, repr('[STUDENT] ') + ' || ' + _SHORT('content', 16), 'evidence', 'shown')}")
def role_evidence(spark, d):
    return views.role_evidence(_turns(spark, d), B.responses(spark, d), "student")


_EXCHANGES = f"""{_SCORED}, led AS (SELECT response_id, at_, role, content, score + bonus AS value, lead(role) OVER o AS r2, lead(content) OVER o AS c2, lead(score + bonus) OVER o AS v2 FROM sc WINDOW o AS (PARTITION BY response_id ORDER BY at_)),
 ex AS (SELECT response_id, at_, value + v2 AS score, CASE WHEN role = 'student' THEN '[ANSWER] ' || {_SHORT('content', 14)} || chr(10) || '[FEEDBACK] ' || {_SHORT('c2', 14)} ELSE '[PROMPT] ' || {_SHORT('content', 14)} || chr(10) || '[RESPONSE] ' || {_SHORT('c2', 14)} END AS rendered FROM led WHERE role <> r2)"""


@query(f"WITH {_EXCHANGES}, {_picked('ex', 5, 2, 'rendered', 'feedback', 'shown')}")
def feedback_windows(spark, d):
    return views.feedback_windows(_turns(spark, d), B.responses(spark, d))


@query(f"WITH {_TURNS}, kept AS (SELECT session_id, string_agg('[' || upper(role) || '] ' || {_SHORT('content', 12)}, chr(10) ORDER BY at_) AS body FROM turns WHERE at_ < 5 OR (at_ >= n // 2 - 3 AND at_ < n // 2 + 3) OR at_ >= n - 8 GROUP BY session_id) SELECT session_id, '[SESSION_TRAJECTORY]' || coalesce(chr(10) || body, '') AS trajectory FROM texts LEFT JOIN kept USING (session_id)")
def session_trajectory(spark, d):
    return views.session_trajectory(_texts(spark, d))


_CUED = lambda cues, col: f"regexp_matches(' ' || lower({col}) || ' ', '[^a-z0-9_](?:{'|'.join(cues)})[^a-z0-9_]')"
_EITHER = lambda test, yes, no: f"CASE WHEN {test} THEN '{yes}' ELSE '{no}' END"
_PLACE = "CASE WHEN 3 * i < n THEN 'early' WHEN 3 * i >= 2 * n THEN 'late' ELSE 'middle' END"
_LEVEL = "CASE WHEN overlap = 0 THEN 'none' WHEN overlap >= 0.5 THEN 'high' ELSE 'some' END"
_REASONS, _DOUBTS = _EITHER(_CUED(CUES["reasoning"], "a"), "reasoning", "no_reasoning"), _EITHER(_CUED(CUES["uncertainty"], "a"), "uncertain", "certain")
_AFFIRMS, _CORRECTS = _EITHER(_CUED(CUES["affirm"], "f"), "affirm", "no_affirm"), _EITHER(_CUED(CUES["correction"], "f"), "corrective", "no_corrective")
_SYMBOLS = [
    f"'pair_position_' || {_PLACE}", f"'objective_' || {_LEVEL}", _REASONS, _DOUBTS, _EITHER("contains(a, '?')", "answer_question", "answer_statement"),
    _EITHER("regexp_matches(' ' || lower(a) || ' ', '[^a-z0-9][0-9]+[^a-z0-9]')", "answer_numeric", "answer_text"),
    _EITHER("len(list_filter(regexp_split_to_array(a, '\\s+'), lambda x: x <> '')) <= 5", "answer_short", "answer_long"),
    _AFFIRMS, _CORRECTS, _EITHER("contains(f, '?')", "feedback_question", "feedback_statement"), _EITHER(_CUED(CUES["reasoning"], "f"), "feedback_reasoning", "no_feedback_reasoning"),
    *[f"'pair_' || {x} || '_' || {y}" for x, y in ((f"'obj_' || {_LEVEL}", _AFFIRMS), (_REASONS, _AFFIRMS), (_DOUBTS, _CORRECTS), (_PLACE, _AFFIRMS), (_PLACE, _CORRECTS))],
]
_MISSING = " || ".join(f"CASE WHEN len(list_filter(ws, lambda w: starts_with(w, '{v}_'))) = 0 THEN ' {v}_missing' ELSE '' END" for v in (views.PREFIXES["answer"], views.PREFIXES["feedback"]))


@query(f"""WITH fb AS (WITH {_EXCHANGES}, {_picked('ex', 5, 2, 'rendered', 'feedback')}),
 pl AS (SELECT response_id, unnest(x) AS line, generate_subscripts(x, 1) AS at_ FROM (SELECT response_id, list_filter(list_transform(str_split(feedback, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS x FROM fb)),
 ln AS (SELECT response_id, at_, lower(regexp_extract(line, '^\\[([A-Z_]+)\\]\\s*(.*)$', 1)) AS role, regexp_extract(line, '^\\[([A-Z_]+)\\]\\s*(.*)$', 2) AS content FROM pl WHERE regexp_matches(line, '^\\[[A-Z_]+\\]')),
 wd AS (SELECT response_id, at_, list_transform(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: CASE role {' '.join(f"WHEN '{k}' THEN '{v}_'" for k, v in views.PREFIXES.items())} END || w) AS ws FROM ln WHERE role IN ({', '.join(f"'{k}'" for k in views.PREFIXES)})),
 pf AS (SELECT response_id, flatten(list(ws ORDER BY at_)) AS ws FROM wd GROUP BY response_id),
 ob AS (SELECT response_id, arg_max({terms_sql('content')}, at_) AS terms FROM ln WHERE role = 'objective' GROUP BY response_id),
 ld AS (SELECT response_id, at_, role, content AS a, lead(role) OVER o AS next_role, lead(content) OVER o AS f FROM ln WHERE role <> 'objective' WINDOW o AS (PARTITION BY response_id ORDER BY at_)),
 pr AS (SELECT response_id, a, f, row_number() OVER (PARTITION BY response_id ORDER BY at_) - 1 AS i, count(*) OVER (PARTITION BY response_id) AS n, len(list_intersect(terms, {tokens_sql('a')})) / greatest(1, len(terms)) AS overlap FROM ld JOIN ob USING (response_id) WHERE role = 'answer' AND next_role = 'feedback'),
 ev AS (SELECT response_id, string_agg(concat_ws(' ', {', '.join(_SYMBOLS)}), chr(10) ORDER BY i) AS events FROM pr GROUP BY response_id)
 SELECT response_id, trim(array_to_string(ws, ' ') || {_MISSING}) AS prefixed, coalesce(events, '{views.NO_PAIR}') AS events FROM pf LEFT JOIN ev USING (response_id)""")
def feedback_symbols(spark, d):
    """Prefixed words and symbolic events of each response's feedback windows."""
    w = views.feedback_windows(_turns(spark, d), B.responses(spark, d))
    return views.feedback_texts(w, "response_id", "feedback", CUES)


_MODELS = ["semantic", "bge_base", "nbsvm"]
_PAIRS = " UNION ALL ".join(f"SELECT protocol, target, v02, '{a}' AS first, '{b}' AS second, {a} AS a, {b} AS b FROM predictions" for i, a in enumerate(_MODELS) for b in _MODELS[i + 1 :])


@query(f"""WITH {P}, pairs AS ({_PAIRS}), fw AS (SELECT unnest(range(21)) / 20e0 AS first_weight), mw AS (SELECT 0.4e0 + 0.02e0 * unnest(range(31)) AS model_weight),
 loss AS (SELECT protocol, first, second, first_weight, model_weight, round(avg(-(target * ln(q) + (1 - target) * ln(1 - q))), 9) AS log_loss FROM (SELECT *, least(greatest(model_weight * (first_weight * a + (1 - first_weight) * b) + (1 - model_weight) * v02, 1e-6), 1 - 1e-6) AS q FROM pairs, fw, mw) GROUP BY ALL)
 SELECT protocol, first, second, round(first_weight, 6) AS first_weight, round(model_weight, 6) AS model_weight, round(log_loss, 6) AS log_loss FROM (SELECT *, row_number() OVER (PARTITION BY protocol, first, second ORDER BY log_loss, first_weight, model_weight) AS nth FROM loss) WHERE nth = 1""")
def pair_blends(spark, d):
    out = ensembles.pair_blends(B.predictions(spark, d), _MODELS, "v02")
    return rounded(out.select("protocol", "first", "second", "first_weight", "model_weight", "log_loss"), "first_weight", "model_weight", "log_loss")


_GATE = f"""{P}, g AS (SELECT protocol, abs(response_id) % 5 AS fold, target, v02, combined, (bge_base - semantic) * (nbsvm - v02) >= 0 AS agrees, least(greatest(CASE WHEN (bge_base - semantic) * (nbsvm - v02) >= 0 THEN combined ELSE v02 END, 1e-6), 1 - 1e-6) AS gated FROM predictions),
 k AS (SELECT protocol, fold, target, unnest(['base', 'combined', 'gated']) AS kind, unnest([v02, combined, gated]) AS p FROM g)"""


def _gate_sql(by):
    b = ", ".join(by)
    on = " AND ".join(f"a.{c} = c.{c} AND a.{c} = g.{c} AND a.{c} = r.{c}" for c in by)
    return f"""m_{len(by)} AS ({metrics_sql('k', [*by, 'kind'])}), e_{len(by)} AS (SELECT {', '.join('a.' + c for c in by)}, r.agreement_rate, a.log_loss AS base_log_loss, c.log_loss AS combined_log_loss, g.log_loss AS gated_log_loss, g.log_loss - a.log_loss AS gated_log_loss_vs_base, g.auc - a.auc AS gated_auc_vs_base, g.log_loss - c.log_loss AS gated_log_loss_vs_combined, c.log_loss - a.log_loss AS combined_log_loss_vs_base, c.auc - a.auc AS combined_auc_vs_base
 FROM m_{len(by)} a, m_{len(by)} c, m_{len(by)} g, (SELECT {b}, avg(agrees::INT) AS agreement_rate FROM g GROUP BY {b}) r WHERE a.kind = 'base' AND c.kind = 'combined' AND g.kind = 'gated' AND {on})"""


_GATE_COLUMNS = ["agreement_rate", "base_log_loss", "combined_log_loss", "gated_log_loss", "gated_log_loss_vs_base", "gated_auc_vs_base", "combined_log_loss_vs_base", "combined_auc_vs_base"]


@query(f"WITH {_GATE}, {_gate_sql(['protocol', 'fold'])} SELECT protocol, fold, {', '.join(f'round({c}, 4) AS {c}' for c in _GATE_COLUMNS)} FROM e_2")
def gate_folds(spark, d):
    e = ensembles.gate_evaluation(B.predictions(spark, d).withColumn("fold", F.abs("response_id") % 5), ["protocol", "fold"])
    return rounded(e.select("protocol", "fold", *_GATE_COLUMNS), *_GATE_COLUMNS, digits=4)


@query(f"""WITH {_GATE}, {_gate_sql(['protocol'])}, {_gate_sql(['protocol', 'fold'])}, w AS (SELECT protocol, max(combined_log_loss_vs_base) AS cw, max(gated_log_loss_vs_base) AS gw FROM e_2 GROUP BY protocol),
 j AS (SELECT *, -gated_log_loss_vs_combined AS gain, cw - gw AS less, gated_auc_vs_base >= 0.8 * combined_auc_vs_base AS ka, -gated_log_loss_vs_base >= -0.8 * combined_log_loss_vs_base AS kl FROM e_1 JOIN w USING (protocol))
 SELECT protocol, round(gain, 4) AS gain_over_combined, round(less, 4) AS worst_fold_reduction, ka AS keeps_auc, ka AND kl AS keeps_both, gain >= 0.0003 AND ka AS path_a, less >= 0.001 AND ka AND kl AS path_b, (gain >= 0.0003 AND ka) OR (less >= 0.001 AND ka AND kl) AS continues FROM j""")
def gate_continuation(spark, d):
    p = B.predictions(spark, d).withColumn("fold", F.abs("response_id") % 5)
    out = ensembles.continuation(ensembles.gate_evaluation(p), ensembles.gate_evaluation(p, ["protocol", "fold"]))
    return rounded(out.select("protocol", "gain_over_combined", "worst_fold_reduction", "keeps_auc", "keeps_both", "path_a", "path_b", "continues"), "gain_over_combined", "worst_fold_reduction", digits=4)


@query(f"WITH bt AS ({_BT}), tf AS (SELECT doc, ('0x' || substr(md5(term), 1, 8))::BIGINT % 1024 AS bucket, count(*) AS tf FROM bt GROUP BY ALL) SELECT a.doc, a.bucket, (a.tf * b.tf)::DOUBLE AS weight FROM tf a JOIN (SELECT doc - 1 AS doc, bucket, tf FROM tf) b ON a.doc = b.doc AND a.bucket = b.bucket")
def overlap_blocks(spark, d):
    """Products of the hashed words of each benchmark item with those of the next."""
    t = B.table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), F.explode(T.tokens(F.col("text"))).alias("term"))
    tf = t.groupBy("doc", T.bucket(F.col("term"), 1024).alias("bucket")).agg(F.count("*").cast("double").alias("weight"))
    return vectors.overlap_block(tf, tf.withColumn("doc", F.col("doc") - 1))


@query(f"WITH {R}, pri AS (SELECT objective_id, (sum(target) + 20e0 * (SELECT avg(target) FROM responses)) / (count(*) + 20) AS prior FROM responses GROUP BY objective_id) SELECT response_id, round(coalesce(prior, 0.5), 6) AS probability FROM responses LEFT JOIN pri USING (objective_id)")
def aligned_scores(spark, d):
    r = B.responses(spark, d)
    return rounded(sinks.aligned(r, splits.with_prior(r, splits.objective_priors(r), "objective_id", 0.5)), "probability")


@query("WITH pri AS (SELECT quality AS g, (count(*) + 1e0) / ((SELECT count(*) FROM labels) + 2) AS prior FROM labels GROUP BY quality) SELECT doc_id AS response_id, quality::BIGINT AS objective_id, round(coalesce(prior, 0.25), 6) AS probability FROM labels LEFT JOIN pri ON g = quality")
def stream_scores(spark, d):
    """The labels' rows, arriving as a stream, scored by a static table of priors."""
    folder = sinks.scratch(spark, "stream")
    rows = B.table(spark, d, "labels").select(F.col("doc_id").alias("response_id"), F.col("quality").cast("long").alias("objective_id"))
    rows.write.parquet(f"{folder}/in")
    total = rows.agg(F.count("*").alias("_n"))
    priors = rows.groupBy("objective_id").agg(F.count("*").alias("n")).crossJoin(total).select("objective_id", ((F.col("n") + 1.0) / (F.col("_n") + 2)).alias("prior"))
    schema = "response_id " + rows.schema["response_id"].dataType.simpleString() + ", objective_id bigint"
    return rounded(score_stream(spark, f"{folder}/in", schema, priors, 0.25, f"{folder}/out", f"{folder}/checkpoint"), "probability")


_FLIPPED = {"context": "context", "objective": "objective", "student": "flipped", "tutor": "context", "feedback": "flipped", "trajectory": "objective", "mean": "mean_"}


def _variant_sql(name):
    return f"flatten([{', '.join(part_sql(kind, _FLIPPED[block], scale) for kind, block, scale in vectors.VARIANTS[name])}])"


_ADDED = "list_transform(list_zip(flipped, context, flipped), lambda z: z[1] + z[2] + z[3])"


@query(f"""WITH {_PROTO}, f AS (SELECT response_id, context, objective, list_reverse(context) AS flipped FROM embedded JOIN protos USING (objective_id)), m AS (SELECT *, {_ADDED} AS added FROM f),
 u AS (SELECT *, list_transform(added, lambda x: x / greatest(sqrt(list_dot_product(added, added)), 1e-12)) AS mean_ FROM m), v AS (SELECT *, {', '.join(f'{_variant_sql(n)} AS {n}' for n in vectors.VARIANTS)} FROM u)
 SELECT response_id, {', '.join(vector_facts_sql(n, n) for n in vectors.VARIANTS)}, round(list_dot_product(objective, flipped), 6) AS cos_objective_student, round(list_dot_product(context, flipped), 6) AS cos_context_student, round(list_dot_product(objective, context), 6) AS cos_objective_tutor,
  round(list_dot_product(context, context), 6) AS cos_context_tutor, round(list_dot_product(flipped, context), 6) AS cos_student_tutor FROM v""")
def variant_features(spark, d):
    """Sizes and sums of all variants of evidence features and the cosines of two views, from the embeddings."""
    e = _embedded(spark, d)
    flipped = F.reverse("context")
    blocks = {"context": F.col("context"), "objective": F.col("objective"), "student": flipped, "tutor": F.col("context"), "feedback": flipped, "trajectory": F.col("objective")}
    facts = [c for n in vectors.VARIANTS for c in vector_facts(F.col(n), n)]
    cosines = vectors.view_cosines(blocks, ["student", "tutor"])
    made = e.select("response_id", *[vectors.variant(n, blocks).alias(n) for n in vectors.VARIANTS], *[F.round(c, 6).alias(n) for n, c in cosines.items()])
    return made.select("response_id", *facts, *cosines)


@query()
def family_folds(spark, d):
    """Folds of whole families of objectives that k-means finds in the objectives' mean vectors."""
    e = _embedded(spark, d)
    objectives = e.groupBy("objective_id").agg(F.min_by("objective", "response_id").alias("vector"))
    return splits.family_folds(e, objectives, 8).select("response_id", "objective_id", "session_id", "family", "fold")


def _prefixed(spark, d):
    """The base with the role-prefixed words of each response's feedback windows."""
    return _base(spark, d).join(feedback_symbols(spark, d).select("response_id", "prefixed"), "response_id", "left").fillna("", ["prefixed"])


@query()
def text_and_dense_oof(spark, d):
    return models.out_of_fold(_spoken(spark, d), lambda n=0: models.text_and_dense_logistic("full_text", NUMERIC))


@query()
def nb_logistic_oof(spark, d):
    return models.out_of_fold(_prefixed(spark, d), models.NaiveBayesLogistic("prefixed"))


@query()
def session_weighted_oof(spark, d):
    return models.out_of_fold(_spoken(spark, d), models.SessionWeighted(models.text_and_dense_logistic("full_text", NUMERIC, alpha=3e-5, weight="weight")))


@query()
def embedding_oof(spark, d):
    e = splits.group_folds(_embedded(spark, d), "session_id").withColumn("pair", vectors.interaction(F.col("context"), F.col("objective")))
    rows = models.as_vector(e, "pair", "vector").select("response_id", "session_id", "target", "fold", "vector")
    return models.out_of_fold(rows, lambda n=1000: models.embedding_logistic("vector", n=n))
