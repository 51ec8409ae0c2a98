"""Queries on turn order, retrieval, blends, gates, vectors, neighbours and models, with SQL where it can say it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convolytics.functions import text as T
from convolytics.operators import ensembles, metrics, models, ordered, retrieval, sessions, sparse, splits, trees, vectors
from convolytics.plans.session_queries import LONG, P, PLACED, R, STOP_SQL, folds_sql, long_predictions, metrics_sql, rounded, terms_sql, tokens_sql
from convolytics.sources import bindings as B
from convolytics.sources.bindings import CUES, E, U

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _texts(spark, d):
    return sessions.session_texts(B.utterances(spark, d))


def _has(cues):
    return f"regexp_matches(' ' || lower(content) || ' ', '[^a-z0-9_](?:{'|'.join(cues)})[^a-z0-9_]')"


_FULL = f"{PLACED}, {R}, texts AS (SELECT session_id, string_agg(line, chr(10) ORDER BY utterance_id) AS full_text FROM lines GROUP BY session_id)"
_TURNS = f"""{_FULL}, raw AS (SELECT session_id, unnest(list_filter(list_transform(str_split(full_text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line, generate_subscripts(list_filter(list_transform(str_split(full_text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1) AS idx FROM texts),
 said AS (SELECT session_id, idx, lower(regexp_extract(line, '^\\[([A-Z_]+)\\]\\s*(.*)$', 1)) AS role, regexp_extract(line, '^\\[([A-Z_]+)\\]\\s*(.*)$', 2) AS content FROM raw WHERE regexp_matches(line, '^\\[(TUTOR|STUDENT)\\]')),
 turns AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx) - 1 AS at_, count(*) OVER (PARTITION BY session_id) AS n, {tokens_sql('content')} AS toks, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS words,
  (role = 'tutor' AND {_has(CUES['affirm'])})::INT AS affirm, (role = 'tutor' AND {_has(CUES['correction'])})::INT AS correction, (role = 'student' AND {_has(CUES['uncertainty'])})::INT AS uncertainty, (role = 'student' AND {_has(CUES['reasoning'])})::INT AS reasoning FROM said),
 terms AS (SELECT response_id, session_id, {terms_sql('objective')} AS terms FROM responses),
 t AS (SELECT response_id, at_, n, role, words, affirm, correction, uncertainty, reasoning, len(list_intersect(terms, toks)) / greatest(1, len(terms)) AS overlap, at_ / greatest(1, n - 1) AS position FROM terms JOIN turns USING (session_id)),
 w AS (SELECT *, lead(role) OVER o AS next_role, lead(affirm) OVER o AS na, lead(correction) OVER o AS nc, lag(role) OVER o AS prev_role,
  first(CASE WHEN role = 'student' THEN overlap END IGNORE NULLS) OVER (PARTITION BY response_id ORDER BY at_ ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS later_overlap,
  max(affirm) OVER (PARTITION BY response_id ORDER BY at_ ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS later_affirm FROM t WINDOW o AS (PARTITION BY response_id ORDER BY at_)),
 a AS (SELECT response_id, count(*) AS turns, count_if(role = 'student') AS st, count_if(prev_role <> role) AS sw, sum(affirm) FILTER (position <= 1/3) AS ae, sum(reasoning) FILTER (position >= 2/3) AS rl,
  avg(overlap) FILTER (role = 'student') AS som, max(overlap) FILTER (role = 'tutor') AS tox, arg_max(overlap, at_) FILTER (role = 'student') AS sol, count_if(role = 'student' AND next_role = 'tutor') AS pairs,
  sum(na) FILTER (role = 'student' AND next_role = 'tutor') AS ap, sum(uncertainty * nc) FILTER (role = 'student' AND next_role = 'tutor') AS ucp, count_if(role = 'student' AND next_role = 'tutor' AND nc > 0) AS ro,
  count_if(role = 'student' AND next_role = 'tutor' AND nc > 0 AND later_overlap > overlap) AS ri, count_if(role = 'student' AND next_role = 'tutor' AND nc > 0 AND later_affirm > 0) AS rla,
  avg(later_overlap - overlap) FILTER (role = 'student' AND next_role = 'tutor' AND nc > 0) AS rdm, max(position) FILTER (affirm > 0) AS lap FROM w GROUP BY response_id)"""


@query(f"""WITH {_TURNS}, shown AS (SELECT response_id, coalesce(turns, 0)::DOUBLE AS ordered_dialogue_turns, coalesce(st, 0)::DOUBLE AS ordered_student_turns, coalesce(sw, 0)::DOUBLE AS ordered_role_switches, coalesce(ae, 0)::DOUBLE AS ordered_affirm_early, coalesce(rl, 0)::DOUBLE AS ordered_reasoning_late,
 round(coalesce(som, 0), 6) AS ordered_student_objective_mean, round(coalesce(tox, 0), 6) AS ordered_tutor_objective_max, round(coalesce(sol, 0), 6) AS ordered_student_objective_last, coalesce(pairs, 0)::DOUBLE AS ordered_feedback_pairs, coalesce(ap, 0)::DOUBLE AS ordered_affirm_pairs, coalesce(ucp, 0)::DOUBLE AS ordered_uncertain_correction_pairs,
 coalesce(ro, 0)::DOUBLE AS ordered_repair_opportunities, coalesce(ri, 0)::DOUBLE AS ordered_repair_overlap_improved, coalesce(rla, 0)::DOUBLE AS ordered_repair_later_affirm, round(coalesce(rdm, 0), 6) AS ordered_repair_overlap_delta_mean,
 round(CASE WHEN ro > 0 THEN (ri + rla) / (2 * ro) ELSE 0 END, 6) AS ordered_repair_success_rate, round(coalesce(lap, -1), 6) AS ordered_last_affirm_position FROM responses LEFT JOIN a USING (response_id)) SELECT * FROM shown""")
def ordered_features(spark, d):
    out = ordered.ordered_features(_texts(spark, d), B.responses(spark, d), CUES)
    names = "dialogue_turns student_turns role_switches affirm_early reasoning_late student_objective_mean tutor_objective_max student_objective_last feedback_pairs affirm_pairs uncertain_correction_pairs repair_opportunities repair_overlap_improved repair_later_affirm repair_overlap_delta_mean repair_success_rate last_affirm_position".split()
    return rounded(out.select("response_id", *[f"ordered_{n}" for n in names]), *[f"ordered_{n}" for n in names])


def _ordered_sql() -> str:
    """All features of the order of turns over the relation w."""
    student, pair = "role = 'student'", "role = 'student' AND next_role = 'tutor'"
    repair, early, late = f"{pair} AND nc > 0", "position <= 1/3", "position >= 2/3"
    one = {"dialogue_turns": "count(*)", "student_turns": f"count_if({student})", "tutor_turns": "count_if(role = 'tutor')", "role_switches": "count_if(prev_role <> role)"}
    for cue in ("affirm", "correction", "uncertainty", "reasoning"):
        one |= {f"{cue}_early": f"sum({cue}) FILTER ({early})", f"{cue}_late": f"sum({cue}) FILTER ({late})"}
    for role in ("student", "tutor"):
        own = f"role = '{role}'"
        one |= {f"{role}_objective_{k}": f"{f} FILTER ({own})" for k, f in (("mean", "avg(overlap)"), ("max", "max(overlap)"), ("first", "arg_min(overlap, at_)"), ("last", "arg_max(overlap, at_)"), ("positive_share", "avg((overlap > 0)::INT)"))}
        one |= {f"{role}_{k}_{part}": f"avg({c}) FILTER ({own} AND {when})" for k, c in (("objective", "overlap"), ("words", "words")) for part, when in (("early", early), ("late", late))}
    paired = {"affirm_pairs": "na", "correction_pairs": "nc", "objective_affirm_pairs": "na * (overlap > 0)::INT", "objective_correction_pairs": "nc * (overlap > 0)::INT", "uncertain_correction_pairs": "uncertainty * nc", "uncertain_affirm_pairs": "uncertainty * na", "reasoning_affirm_pairs": "reasoning * na"}
    one |= {"feedback_pairs": f"count_if({pair})", **{k: f"sum({x}) FILTER ({pair})" for k, x in paired.items()}}
    one |= {"repair_opportunities": f"count_if({repair})", "repair_overlap_improved": f"count_if({repair} AND later_overlap > overlap)", "repair_later_affirm": f"count_if({repair} AND later_affirm > 0)", "repair_overlap_delta_mean": f"avg(later_overlap - overlap) FILTER ({repair})"}
    one |= {f"last_{cue}_position": f"max(position) FILTER (role = 'tutor' AND {cue} > 0)" for cue in ("affirm", "correction")}
    filled = ", ".join(f"coalesce({k}, {-1 if k.startswith('last_') else 0})::DOUBLE AS {k}" for k in one)
    derived = {f"{k}_delta": f"{k}_late - {k}_early" for k in ("affirm", "correction", "uncertainty", "reasoning", "student_objective", "tutor_objective", "student_words", "tutor_words")}
    derived |= {"student_turn_share": "student_turns / greatest(1, dialogue_turns)", "repair_success_rate": "CASE WHEN repair_opportunities > 0 THEN (repair_overlap_improved + repair_later_affirm) / (2 * repair_opportunities) ELSE 0 END"}
    kept = [k for k in one if k not in ("tutor_objective_first", "tutor_objective_early", "tutor_objective_late")]
    out = ", ".join(f"round({x}, 6) AS ordered_{k}" for k, x in [*((k, k) for k in kept), *derived.items()])
    return f"""every AS (SELECT response_id, {', '.join(f'{x} AS {k}' for k, x in one.items())} FROM w GROUP BY response_id), filled AS (SELECT response_id, {filled} FROM responses LEFT JOIN every USING (response_id)) SELECT response_id, {out} FROM filled"""


@query(f"WITH {_TURNS}, {_ordered_sql()}")
def ordered_features_all(spark, d):
    out = ordered.ordered_features(_texts(spark, d), B.responses(spark, d), CUES)
    return rounded(out, *[c for c in out.columns if c != "response_id"])


def _contexts(spark, d, *limits):
    lines = retrieval.scored_lines(_texts(spark, d), B.responses(spark, d))
    stats = retrieval.statistics(lines)
    out = stats.join(retrieval.contexts(retrieval.retrieve(lines, *limits)), "response_id")
    return rounded(out, "first_match", "last_match", "mean_positive_score", "max_score", "coverage")


def pairs_sql(words):
    return f"list_transform(list_zip(({words})[:-2], ({words})[2:]), lambda z: z[1] || ' ' || z[2])"


def _telling_sql(word):
    return f"length({word}) >= 3 AND {word} NOT IN {STOP_SQL}"


ASKED = f"""asked AS (SELECT response_id, session_id, objective, {terms_sql('objective')} AS ot,
 list_distinct(list_filter({pairs_sql(tokens_sql('objective'))}, lambda b: {_telling_sql("split_part(b, ' ', 1)")} AND {_telling_sql("split_part(b, ' ', 2)")})) AS ob FROM responses)"""
SCORE = f"coalesce(list_sum(list_transform(list_intersect(ot, toks), lambda w: 1 + least(length(w), 10) / 20e0)), 0) + 1.5e0 * len(list_intersect(ob, {pairs_sql('toks')}))"


def _contexts_sql(top, radius, most, fallback):
    return f"""WITH {_FULL}, {ASKED}, cut AS (SELECT session_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS idx, len(x) AS n FROM (SELECT session_id, list_filter(str_split(full_text, chr(10)), lambda x: trim(x) <> '') AS x FROM texts)),
 heard AS (SELECT *, {tokens_sql("regexp_replace(line, '^\\[[A-Z_]+\\]\\s*', '')")} AS toks FROM cut),
 sc AS (SELECT response_id, idx, n, line, len(ot) AS n_terms, list_intersect(ot, toks) AS shared, round({SCORE}, 9) AS score FROM asked JOIN heard USING (session_id)),
 top AS (SELECT response_id, idx FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY score DESC, idx DESC) <= {top}),
 near AS (SELECT DISTINCT sc.* FROM sc JOIN top ON top.response_id = sc.response_id AND sc.idx BETWEEN top.idx - {radius} AND top.idx + {radius}),
 kept AS (SELECT response_id, idx, line FROM near QUALIFY row_number() OVER (PARTITION BY response_id ORDER BY score DESC, idx) <= {most}),
 chosen AS (SELECT * FROM kept UNION ALL SELECT response_id, idx, line FROM sc WHERE response_id NOT IN (SELECT response_id FROM top) AND (idx < {fallback} OR idx >= n - {fallback})),
 body AS (SELECT response_id, string_agg(line, chr(10) ORDER BY idx) AS objective_context, count(*) AS selected FROM chosen GROUP BY response_id),
 stats AS (SELECT response_id, count(*) AS lines, count_if(score > 0) AS positive_lines, any_value(n_terms) AS terms, len(list_distinct(flatten(list(shared)))) AS matched_terms, coalesce(min(idx / greatest(1, n - 1)) FILTER (score > 0), -1) AS first_match,
  coalesce(max(idx / greatest(1, n - 1)) FILTER (score > 0), -1) AS last_match, coalesce(avg(score) FILTER (score > 0), 0) AS mean_positive_score, max(score) AS max_score FROM sc GROUP BY response_id)
 SELECT response_id, lines, positive_lines, terms, matched_terms, round(first_match, 6) AS first_match, round(last_match, 6) AS last_match, round(mean_positive_score, 6) AS mean_positive_score, round(max_score, 6) AS max_score,
  round(matched_terms / greatest(1, terms), 6) AS coverage, objective_context, selected FROM stats JOIN body USING (response_id)"""


@query(_contexts_sql(24, 1, 72, 18))
def objective_contexts(spark, d):
    return _contexts(spark, d)


@query(_contexts_sql(2, 1, 4, 2))
def objective_contexts_small(spark, d):
    """Limits that bite on short sessions."""
    return _contexts(spark, d, 2, 1, 4, 2)


@query(f"WITH {P} SELECT response_id, protocol, round(0.25 * v02 + 0.25 * semantic + 0.5 * bge_base, 6) AS blended, (bge_base - semantic) * (nbsvm - v02) >= 0 AS agrees, round(least(greatest(CASE WHEN (bge_base - semantic) * (nbsvm - v02) >= 0 THEN combined ELSE v02 END, 1e-6), 1 - 1e-6), 6) AS gated, round(0.7 * (0.7 * v02 + 0.3 * nbsvm) + 0.3 * bge_base, 6) AS nested FROM predictions")
def blends(spark, d):
    agrees, gated = ensembles.agreement_gate()
    return B.predictions(spark, d).select("response_id", "protocol", F.round(ensembles.blend({"v02": 0.25, "semantic": 0.25, "bge_base": 0.5}), 6).alias("blended"), agrees.alias("agrees"), F.round(gated, 6).alias("gated"), F.round(ensembles.nested_blend(F.col("v02"), F.col("nbsvm"), F.col("bge_base")), 6).alias("nested"))


_SWEEP = f"""{P}, sweep AS (SELECT protocol, weight, avg(-(target * ln(q) + (1 - target) * ln(1 - q))) AS log_loss FROM (SELECT protocol, target, weight, least(greatest((1 - weight) * v02 + weight * nbsvm, 1e-6), 1 - 1e-6) AS q FROM predictions, (SELECT unnest(range(101)) / 100e0 AS weight)) GROUP BY ALL)"""


@query(f"WITH {_SWEEP} SELECT protocol, weight, round(log_loss, 6) AS log_loss FROM sweep")
def weight_sweep(spark, d):
    return rounded(ensembles.weight_sweep(B.predictions(spark, d), "v02", "nbsvm", [i / 100 for i in range(101)]), "log_loss")


@query(f"WITH {_SWEEP}, r AS (SELECT protocol, weight, round(log_loss, 9) AS log_loss FROM sweep) SELECT protocol, arg_min(weight, (log_loss, weight)) AS weight, round(min(log_loss), 6) AS log_loss FROM r GROUP BY protocol")
def best_weight(spark, d):
    sweep = rounded(ensembles.weight_sweep(B.predictions(spark, d), "v02", "nbsvm", [i / 100 for i in range(101)]), "log_loss", digits=9)
    return rounded(ensembles.best(sweep, ["protocol"], ["log_loss", "weight"]), "log_loss")


_DELTAS = f"""{LONG}, m AS ({metrics_sql('long', ['protocol', 'model'])}), dl AS (SELECT a.protocol, a.model, a.log_loss - b.log_loss AS delta_log_loss, a.auc - b.auc AS delta_auc FROM m a JOIN m b ON a.protocol = b.protocol AND b.model = 'v02' WHERE a.model <> 'v02')"""


@query(f"WITH {_DELTAS} SELECT protocol, model, round(delta_log_loss, 5) AS delta_log_loss, round(delta_auc, 5) AS delta_auc, (delta_log_loss <= -0.0015 AND delta_auc >= 0) OR (delta_auc >= 0.005 AND delta_log_loss <= 0) AS promoted FROM dl")
def candidate_deltas(spark, d):
    m = rounded(metrics.all_metrics(long_predictions(B.predictions(spark, d)), ["protocol", "model"]), "log_loss", "auc")
    out = ensembles.deltas(m, "v02").withColumn("promoted", ensembles.promoted(F.col("delta_log_loss"), F.col("delta_auc")))
    return rounded(out, "delta_log_loss", "delta_auc", digits=5)


@query(f"WITH {_DELTAS} SELECT model, round(median(-delta_log_loss), 5) AS median_gain, avg((delta_log_loss < 0)::INT) AS win_fraction, round(max(delta_log_loss), 5) AS worst_regression, median(-delta_log_loss) >= 0.002 AS gain_gate, avg((delta_log_loss < 0)::INT) = 1 AS all_gate, avg((delta_log_loss < 0)::INT) >= 0.7 AS win_gate, max(delta_log_loss) <= 0.001 AS regression_gate FROM dl GROUP BY model")
def protocol_audit(spark, d):
    """Gates over whole protocols only, of the predictions as they are."""
    m = rounded(metrics.all_metrics(long_predictions(B.predictions(spark, d)), ["protocol", "model"]), "log_loss", "auc")
    return rounded(ensembles.audit(ensembles.deltas(m, "v02")), "median_gain", "worst_regression", digits=5)


def _quantile_sql(col, out):
    return f"'q' || (least(floor((rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2) / count(*) OVER () * 5), 4) + 1)::INT AS {out}"


REGIMES = {"transcript_length": "n_utterances", "asr_uncertainty": "unclear_fraction", "background_rate": "background_fraction", "objective_frequency": "frequency", "retrieval_coverage": "coverage"}
def audited_sql(long: str = LONG) -> str:
    return f"""{PLACED}, {long}, texts AS (SELECT session_id, string_agg(line, chr(10) ORDER BY utterance_id) AS full_text FROM lines GROUP BY session_id),
 heard AS (SELECT session_id, list_distinct(flatten(list(toks))) AS heard FROM (SELECT session_id, {tokens_sql("regexp_replace(line, '^\\[[A-Z_]+\\]\\s*', '')")} AS toks FROM (SELECT session_id, unnest(str_split(full_text, chr(10))) AS line FROM texts)) GROUP BY session_id),
 spoken AS (SELECT session_id, count(*) AS n_utterances, count_if(coalesce(contains(lower(content), '[unclear]'), false)) / count(*) AS unclear_fraction, count_if(role = 'background') / count(*) AS background_fraction FROM utterances GROUP BY session_id),
 measured AS (SELECT response_id, coalesce(n_utterances, 0) AS n_utterances, coalesce(unclear_fraction, 0) AS unclear_fraction, coalesce(background_fraction, 0) AS background_fraction, count(*) OVER (PARTITION BY objective_id) AS frequency, coalesce(len(list_intersect(terms, heard)) / greatest(1, len(terms)), 0) AS coverage, count(*) OVER (PARTITION BY session_id) AS per_session
  FROM (SELECT *, {terms_sql('objective')} AS terms FROM responses) LEFT JOIN spoken USING (session_id) LEFT JOIN heard USING (session_id)),
 regimes AS (SELECT response_id, {', '.join(_quantile_sql(c, r) for r, c in REGIMES.items())}, CASE per_session WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'three_plus' END AS session_objectives FROM measured),
 tidy AS (SELECT protocol, model, target, p, unnest(['overall', 'fold', {', '.join(repr(r) for r in REGIMES)}, 'session_objectives']) AS regime, unnest(['all', (abs(response_id) % 5)::VARCHAR, {', '.join(REGIMES)}, session_objectives]) AS value FROM long JOIN regimes USING (response_id)),
 card AS ({metrics_sql('tidy', ['protocol', 'model', 'regime', 'value'])}), dl AS (SELECT a.*, a.log_loss - b.log_loss AS dloss, a.auc - b.auc AS dauc FROM card a JOIN card b ON a.protocol = b.protocol AND a.regime = b.regime AND a.value = b.value AND b.model = 'v02' WHERE a.model <> 'v02'),
 s AS (SELECT model, count_if(regime = 'overall') AS protocols, count_if(regime = 'overall' AND dloss < 0) AS protocol_loss_wins, count_if(regime = 'overall' AND coalesce(dauc, 0) > 0) AS protocol_auc_wins, median(-dloss) FILTER (regime = 'overall') AS mg, avg(-dloss) FILTER (regime = 'overall') AS ag, avg(dauc) FILTER (regime = 'overall') AS aa,
  avg((dloss < 0)::INT) FILTER (regime = 'fold') AS flw, avg((coalesce(dauc, 0) > 0)::INT) FILTER (regime = 'fold') AS faw, max(dloss) FILTER (regime = 'fold') AS wf, max(dloss) FILTER (regime NOT IN ('overall', 'fold', 'session_objectives') AND rows >= 100) AS wr FROM dl GROUP BY model)"""


_AUDITED = audited_sql()
# Fixed value: the weight of a candidate beside the baseline.
CANDIDATE_WEIGHT = 0.3
BLENDED = f"{P}, long AS (SELECT response_id, session_id, objective_id, protocol, target, unnest(['v02', 'semantic', 'bge_base', 'nbsvm', 'combined']) AS model, unnest([v02, {', '.join(f'{1 - CANDIDATE_WEIGHT}e0 * v02 + {CANDIDATE_WEIGHT}e0 * {m}' for m in ('semantic', 'bge_base', 'nbsvm', 'combined'))}]) AS p FROM predictions)"


GATES = """SELECT model, protocols, protocol_loss_wins, protocol_auc_wins, round(mg, 5) AS median_gain, round(ag, 5) AS mean_gain, round(aa, 5) AS mean_auc_gain, round(flw, 5) AS fold_loss_wins, round(faw, 5) AS fold_auc_wins, round(wf, 5) AS worst_fold, round(wr, 5) AS worst_regime,
 mg >= 0.002 AS gain_gate, protocol_loss_wins = protocols AS all_gate, flw >= 0.7 AS win_gate, coalesce(wr <= 0.001, false) AS regression_gate FROM s"""
GAINS = ["median_gain", "mean_gain", "mean_auc_gain", "fold_loss_wins", "fold_auc_wins", "worst_fold", "worst_regime"]


@query(f"WITH {_AUDITED} {GATES}")
def candidate_audit_regimes(spark, d):
    """The whole audit of the candidates as they are."""
    return rounded(ensembles.audit_scorecard(candidate_regime_card(spark, d), "v02"), *GAINS, digits=5)


@query(f"WITH {audited_sql(BLENDED)} {GATES}")
def candidate_audit(spark, d):
    """The whole audit of candidates blended into the baseline: gates over protocols, their folds and the regimes of
    responses and their sessions."""
    return rounded(ensembles.audit_scorecard(candidate_regime_card(spark, d, CANDIDATE_WEIGHT), "v02"), *GAINS, digits=5)


def regime_columns(spark, d):
    """response_id, the five quantile regimes and session_objectives."""
    r = B.responses(spark, d)
    lines = retrieval.statistics(retrieval.scored_lines(_texts(spark, d), r)).select("response_id", "coverage")
    base = sessions.modeling_base(r, sessions.session_features(B.utterances(spark, d))).join(lines, "response_id", "left")
    base = base.join(r.groupBy("objective_id").agg(F.count("*").alias("frequency")), "objective_id").join(r.groupBy("session_id").agg(F.count("*").alias("_s")), "session_id")
    values = F.array(*[F.struct(F.lit(regime).alias("regime"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("x")) for regime, c in REGIMES.items()])
    per_session = F.when(F.col("_s") == 1, "one").when(F.col("_s") == 2, "two").otherwise("three_plus").alias("session_objectives")
    long = base.select("response_id", per_session, F.explode(values).alias("v")).select("response_id", "session_objectives", "v.*")
    ranked = metrics.quantile_regime(long, "x", "q", ["regime"])
    return ranked.groupBy("response_id", "session_objectives").agg(*[F.max(F.when(F.col("regime") == regime, F.col("q"))).alias(regime) for regime in REGIMES])


def candidate_regime_card(spark, d, weight=1.0):
    """The scorecard of the baseline and of each candidate at its weight beside it."""
    p = B.predictions(spark, d)
    if weight < 1:
        p = p.withColumns({m: ensembles.blend({"v02": 1 - weight, m: weight}) for m in ("semantic", "bge_base", "nbsvm", "combined")})
    long = long_predictions(p).withColumn("fold", F.abs("response_id") % 5).join(regime_columns(spark, d), "response_id")
    return rounded(metrics.scorecard(long, [*REGIMES, "session_objectives"], ["protocol", "model"]), "log_loss", "auc")


_PROTO = f"""{E}, comp AS (SELECT objective_id, unnest(context) AS x, generate_subscripts(context, 1) AS i FROM embedded), means AS (SELECT objective_id, i, avg(x) AS m FROM comp GROUP BY ALL), vecs AS (SELECT objective_id, list(m ORDER BY i) AS v FROM means GROUP BY objective_id),
 protos AS (SELECT objective_id, list_transform(v, lambda z: z / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS objective FROM vecs)"""


def _embedded(spark, d):
    e = B.embedded(spark, d)
    return e.join(vectors.mean_vectors(e, "objective_id", "context", "objective"), "objective_id")


def vector_facts(v, name):
    """Size, sum and the sum weighted by place of a vector, which a changed order shows."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    return [F.size(v).alias(f"{name}_size"), F.round(total(v), 6).alias(f"{name}_sum"), F.round(total(F.transform(v, lambda x, i: x * (i + 1))), 5).alias(f"{name}_moment")]


def vector_facts_sql(v, name):
    return f"len({v}) AS {name}_size, round(list_sum({v}), 6) AS {name}_sum, round(list_sum(list_transform({v}, lambda x, i: x * i)), 5) AS {name}_moment"


def part_sql(kind, block, scale):
    """SQL for a part of a variant: the block itself (v), its product with the objective (x) or its difference (d)."""
    if kind == "v":
        return f"list_transform({block}, lambda x: {scale}e0 * x)"
    return f"list_transform(list_zip({block}, objective), lambda z: {scale}e0 * {'z[1] * z[2]' if kind == 'x' else 'abs(z[1] - z[2])'})"


def _pair_sql(block):
    parts = [("v", block, 0.7), ("v", "objective", 0.7), ("x", block, 6.0), ("d", block, 0.7)]
    return f"flatten([{', '.join(part_sql(*p) for p in parts)}])"


@query(f"WITH {_PROTO} SELECT response_id, round(list_dot_product(context, objective), 6) AS cosine, {vector_facts_sql('pair', 'interaction')} FROM (SELECT *, {_pair_sql('context')} AS pair FROM embedded JOIN protos USING (objective_id))")
def embedding_geometry(spark, d):
    e = _embedded(spark, d)
    facts = vector_facts(vectors.interaction(F.col("context"), F.col("objective")), "interaction")
    return e.select("response_id", F.round(vectors.dot(F.col("context"), F.col("objective")), 6).alias("cosine"), *facts)


@query(f"""WITH {_PROTO}, rows_ AS (SELECT e.*, p.objective FROM embedded e JOIN protos p USING (objective_id)), {folds_sql('session_id', source='rows_')},
 train AS (SELECT e.f AS eval_fold, a.* FROM folded a, (SELECT unnest(range(5)) AS f) e WHERE a.fold <> e.f AND a.session_id NOT IN (SELECT session_id FROM folded h WHERE h.fold = e.f)), prior AS (SELECT eval_fold, avg(target) AS prior FROM train GROUP BY eval_fold),
 near AS (SELECT eval_fold, q.objective_id, t.objective_id AS t_objective, list_dot_product(q.objective, t.objective) AS os, row_number() OVER (PARTITION BY eval_fold, q.objective_id ORDER BY round(list_dot_product(q.objective, t.objective), 9) DESC, t.objective_id) AS nth
  FROM (SELECT DISTINCT fold AS eval_fold, objective_id FROM folded) JOIN protos q USING (objective_id) JOIN (SELECT DISTINCT eval_fold, objective_id AS t_id FROM train) k USING (eval_fold) JOIN protos t ON t.objective_id = k.t_id QUALIFY nth <= 3),
 scored AS (SELECT a.response_id, t.target, t.response_id AS t_id, 0.5 * list_dot_product(a.context, t.context) + 0.5 * os AS score FROM folded a JOIN near n ON n.eval_fold = a.fold AND n.objective_id = a.objective_id JOIN train t ON t.eval_fold = a.fold AND t.objective_id = n.t_objective),
 top AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY round(score, 9) DESC, t_id) AS nth FROM scored QUALIFY nth <= 5), wt AS (SELECT *, exp(8 * (score - max(score) OVER (PARTITION BY response_id))) AS wgt FROM top), s AS (SELECT response_id, sum(wgt) AS sw, sum(wgt * target) AS swy FROM wt GROUP BY response_id)
 SELECT response_id, round(least(greatest((coalesce(swy, 0) + prior) / (coalesce(sw, 0) + 1), 1e-5), 1 - 1e-5), 6) AS prediction FROM folded JOIN prior ON eval_fold = fold LEFT JOIN s USING (response_id)""")
def knn_predictions(spark, d):
    """Limits that bite on small tables."""
    return rounded(vectors.knn_predictions(splits.group_folds(_embedded(spark, d), "session_id"), 3, 5, 0.5, 8.0, 1.0), "prediction")


def _knn_sql(m, k, w, temperature, mass):
    return f"""WITH {_PROTO}, rows_ AS (SELECT e.*, p.objective FROM embedded e JOIN protos p USING (objective_id)), {folds_sql('session_id', source='rows_')},
 train AS (SELECT e.f AS eval_fold, a.* FROM folded a, (SELECT unnest(range(5)) AS f) e WHERE a.fold <> e.f AND a.session_id NOT IN (SELECT session_id FROM folded h WHERE h.fold = e.f)), prior AS (SELECT eval_fold, avg(target) AS prior FROM train GROUP BY eval_fold),
 near AS (SELECT eval_fold, q.objective_id, t.objective_id AS t_objective, list_dot_product(q.objective, t.objective) AS os, row_number() OVER (PARTITION BY eval_fold, q.objective_id ORDER BY round(list_dot_product(q.objective, t.objective), 9) DESC, t.objective_id) AS nth
  FROM (SELECT DISTINCT fold AS eval_fold, objective_id FROM folded) JOIN protos q USING (objective_id) JOIN (SELECT DISTINCT eval_fold, objective_id AS t_id FROM train) k USING (eval_fold) JOIN protos t ON t.objective_id = k.t_id QUALIFY nth <= {m}),
 scored AS (SELECT a.response_id, t.target, t.response_id AS t_id, {1 - w} * list_dot_product(a.context, t.context) + {w} * os AS score FROM folded a JOIN near n ON n.eval_fold = a.fold AND n.objective_id = a.objective_id JOIN train t ON t.eval_fold = a.fold AND t.objective_id = n.t_objective),
 top AS (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY round(score, 9) DESC, t_id) AS nth FROM scored QUALIFY nth <= {k}), wt AS (SELECT *, exp({temperature} * (score - max(score) OVER (PARTITION BY response_id))) AS wgt FROM top), s AS (SELECT response_id, sum(wgt) AS sw, sum(wgt * target) AS swy FROM wt GROUP BY response_id)
 SELECT response_id, round(least(greatest((coalesce(swy, 0) + {mass} * prior) / (coalesce(sw, 0) + {mass}), 1e-5), 1 - 1e-5), 6) AS prediction FROM folded JOIN prior ON eval_fold = fold LEFT JOIN s USING (response_id)"""


@query(" UNION ALL ".join(f"SELECT '{name}' AS config, * FROM ({_knn_sql(*c)})" for name, c in vectors.KNN_CONFIGS.items()))
def knn_configs(spark, d):
    """Predictions of each configuration of the sweep."""
    return rounded(vectors.knn_sweep(splits.group_folds(_embedded(spark, d), "session_id"), vectors.KNN_CONFIGS), "prediction")


_BT = f"SELECT item_id AS doc, unnest({tokens_sql('text')}) AS term FROM benchmark"


@query(f"""WITH bt AS ({_BT}), tf AS (SELECT doc, term, count(*) AS tf FROM bt GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), w AS (SELECT doc, term, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT doc) FROM bt)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term))
 SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM w""")
def tf_idf(spark, d):
    t = B.table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), F.explode(T.tokens(F.col("text"))).alias("term"))
    return rounded(vectors.tf_idf(t), "weight")


@query(f"""WITH {R}, rt AS (SELECT response_id AS doc, target, unnest({tokens_sql('objective')}) AS term FROM responses), n AS (SELECT sum(target) AS p, sum(1 - target) AS n FROM (SELECT DISTINCT doc, target FROM rt))
 SELECT term, round(ln(((sum(target) + 1) / (any_value(p) + 1)) / ((sum(1 - target) + 1) / (any_value(n.n) + 1))), 6) AS ratio FROM rt, n GROUP BY term""")
def nb_ratio(spark, d):
    t = B.responses(spark, d).select(F.col("response_id").alias("doc"), "target", F.explode(T.tokens(F.col("objective"))).alias("term"))
    return rounded(vectors.nb_ratio(t), "ratio")


# The columns of the metadata models; the first 11 are counts.
COUNTS = ["n_utterances", "duration_seconds", "n_chars", "n_tutor", "n_student", "n_background", "n_other", "n_unclear", "n_empty", "objective_chars", "objective_words"]
NUMERIC = [*COUNTS, "student_fraction", "tutor_fraction", "background_fraction", "unclear_fraction"]


def _base(spark, d):
    base = sessions.modeling_base(B.responses(spark, d), sessions.session_features(B.utterances(spark, d)))
    return splits.group_folds(base, "session_id")


@query()
def logistic_oof(spark, d):
    return models.out_of_fold(_base(spark, d), lambda n=1000: models.numeric_logistic(NUMERIC, n=n))


def _spoken(spark, d):
    """The base with the session's transcript."""
    return _base(spark, d).join(_texts(spark, d), "session_id", "left").fillna("", ["full_text", "closing_text"])


@query()
def text_logistic_oof(spark, d):
    return models.out_of_fold(_spoken(spark, d), lambda n=0: models.hashed_text_logistic("full_text"))


@query()
def objective_logistic_oof(spark, d):
    return models.out_of_fold(_base(spark, d), lambda n=0: models.hashed_text_logistic("objective", 1 << 14))


@query(f"WITH {R}, {folds_sql('session_id')}, b AS (SELECT response_id, objective, session_id, fold FROM folded) SELECT fold, count(*) AS rows FROM b GROUP BY fold")
def model_rows(spark, d):
    """Rows of each fold that the models of out-of-fold queries read."""
    return _base(spark, d).groupBy("fold").agg(F.count("*").alias("rows"))


@query()
def log_metadata_oof(spark, d):
    """The metadata model on logarithms of counts, penalty C = 0.3, of rows purged of the fold's sessions."""
    return models.out_of_fold(sessions.log_counts(_base(spark, d), COUNTS), lambda n=1000: models.numeric_logistic(NUMERIC, 0.3, n=n))


def _objective_words(size):
    return sparse.word_terms(F.col("objective"), accents=False), size, 2, None


@query()
def objective_tf_idf_oof(spark, d):
    return models.tf_idf_out_of_fold(_base(spark, d), {"objective": _objective_words(30_000)})


@query()
def transcript_tf_idf_oof(spark, d):
    """Words of the transcript, fitted on distinct sessions, beside those of the objective."""
    said = sparse.word_terms(F.col("full_text"), accents=False)
    return models.tf_idf_out_of_fold(_spoken(spark, d), {"said": (said, 60_000, 3, "session_id"), "objective": _objective_words(20_000)})


@query()
def closing_tf_idf_oof(spark, d):
    """Characters of the transcript's end, fitted on distinct sessions, beside those of the objective."""
    end, objective = (sparse.char_terms(F.col(c), accents=False) for c in ("closing_text", "objective"))
    return models.tf_idf_out_of_fold(_spoken(spark, d), {"end": (end, 60_000, 4, "session_id"), "objective": (objective, 20_000, 2, None)})


_BARE_WORDS = "regexp_extract_all(strip_accents(lower({})), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
_TERM_DOCS = f"""docs AS (SELECT item_id AS doc, abs(item_id) % 5 AS fold, {_BARE_WORDS.format('text')} AS ws, text FROM benchmark),
 padded AS (SELECT doc, fold, ' ' || w || ' ' AS w FROM (SELECT doc, fold, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '\\s+'), lambda x: x <> '')) AS w FROM docs)),
 terms AS (SELECT 'words' AS kind, doc, fold, unnest(ws) AS term FROM docs UNION ALL SELECT 'words', doc, fold, unnest(list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM docs
  {' '.join(f"UNION ALL SELECT 'chars', doc, fold, unnest(list_transform(range(1, greatest(1, length(w) - {n} + 1) + 1), lambda i: substr(w, i, {n}))) FROM padded" for n in (3, 4, 5))}),
 tf AS (SELECT kind, doc, fold, term, count(*) AS tf FROM terms GROUP BY ALL), e AS (SELECT unnest(range(-1, 5)) AS eval_fold), n AS (SELECT eval_fold, count(*) AS n FROM docs, e WHERE fold <> eval_fold GROUP BY ALL),
 df AS (SELECT kind, eval_fold, term, count(*) AS df, sum(tf) AS t FROM tf, e WHERE fold <> eval_fold GROUP BY ALL HAVING count(*) >= 2),
 voc AS (SELECT kind, eval_fold, term, row_number() OVER (PARTITION BY kind, eval_fold ORDER BY t DESC, term) - 1 AS slot, ln((1 + n) / (1 + df)) + 1 AS idf FROM df JOIN n USING (eval_fold) QUALIFY slot < 2000)"""


def _vocabularies(spark, d):
    """For words with pairs and for characters: the counts of the items' terms, and a vocabulary for each fold."""
    items = B.table(spark, d, "benchmark").select(F.col("item_id").alias("doc"), (F.abs("item_id") % 5).cast("int").alias("fold"), "text")
    for kind, terms in (("words", sparse.word_terms(F.col("text"), accents=False)), ("chars", sparse.char_terms(F.col("text"), accents=False))):
        counts = sparse.counted(items, ["fold", "doc"], terms)
        yield kind, counts, sparse.vocabulary(counts, 2000)


@query(f"WITH {_TERM_DOCS} SELECT kind, eval_fold, term, slot, round(idf, 6) AS idf FROM voc")
def tf_idf_vocabulary(spark, d):
    """Each fold's vocabulary of words, pairs and characters, fitted on the other folds (-1: on all)."""
    return rounded(reduce(DataFrame.unionByName, [v.withColumn("kind", F.lit(kind)) for kind, _, v in _vocabularies(spark, d)]), "idf")


@query(f"WITH {_TERM_DOCS}, w AS (SELECT kind, eval_fold, doc, slot, (1 + ln(tf)) * idf AS w FROM tf JOIN voc USING (kind, term)) SELECT kind, eval_fold, doc, slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY kind, eval_fold, doc)), 6) AS value FROM w")
def tf_idf_weights(spark, d):
    """The rows of all items under each fold's vocabulary, at length 1."""
    return rounded(reduce(DataFrame.unionByName, [sparse.tf_idf_rows(c.drop("fold"), v, ["doc"]).withColumn("kind", F.lit(kind)) for kind, c, v in _vocabularies(spark, d)]), "value")


_RETRIEVED = ["lines", "positive_lines", "terms", "matched_terms", "coverage", "first_match", "last_match", "mean_positive_score", "max_score"]


def _dense(spark, d):
    """The base with the statistics of retrieval and the features of turn order, and the names of all numeric columns."""
    r, texts = B.responses(spark, d), _texts(spark, d)
    turns = ordered.ordered_features(texts, r, CUES)
    found = retrieval.statistics(retrieval.scored_lines(texts, r)).select("response_id", *_RETRIEVED)
    names = [*NUMERIC, *_RETRIEVED, *[c for c in turns.columns if c != "response_id"]]
    df = _base(spark, d).join(found, "response_id", "left").join(turns, "response_id", "left")
    return df.select("response_id", "session_id", "fold", "target", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names]), names


@query()
def trees_oof(spark, d):
    """Both tree sizes; model names the size."""
    return trees.trees_out_of_fold(*_dense(spark, d))


_EDGES = {"n_utterances": [2.0, 4.0, 6.0], "n_chars": [400.0, 800.0, 1600.0, 3200.0], "objective_words": [20.0, 40.0, 60.0], "student_fraction": [0.4, 0.5, 0.6]}
_EDGE_BINS = " UNION ALL ".join(f"SELECT eval_fold, target, '{c}' AS feature, {' + '.join(f'(coalesce({c}, 0) > {x}e0)::INT' for x in edges)} AS bin FROM train" for c, edges in _EDGES.items())


@query(f"""WITH {U}, {R}, f AS (SELECT session_id, count(*) AS n_utterances, sum(length(coalesce(content, ''))) AS n_chars, count_if(role = 'student') / count(*) AS student_fraction FROM utterances GROUP BY session_id),
 {folds_sql('session_id')}, rows_ AS (SELECT folded.*, n_utterances, n_chars, student_fraction, len(list_filter(regexp_split_to_array(objective, '\\s+'), lambda x: x <> '')) AS objective_words FROM folded LEFT JOIN f USING (session_id)),
 train AS (SELECT e.f AS eval_fold, a.* FROM rows_ a, (SELECT unnest(range(5)) AS f) e WHERE a.fold <> e.f AND a.session_id NOT IN (SELECT session_id FROM folded h WHERE h.fold = e.f)), mean AS (SELECT eval_fold, avg(target) AS p FROM train GROUP BY eval_fold), bins AS ({_EDGE_BINS})
 SELECT eval_fold, feature, bin, count(*) AS n, round(count(*) * any_value(p) - sum(target), 6) AS g, round(count(*) * any_value(p) * (1 - any_value(p)), 6) AS h FROM bins JOIN mean USING (eval_fold) GROUP BY ALL""")
def tree_gradient_sums(spark, d):
    """Sums of gradients of the first split of each fold's trees, by feature and bin."""
    return rounded(trees.gradient_sums(_base(spark, d), _EDGES), "g", "h")
