"""51 features of the order of turns: one join of responses with dialogue turns, one window order, one aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolytics.functions import text as T


def dialogue_turns(texts: DataFrame, text_col: str = "full_text") -> DataFrame:
    """session_id, at, n, role, content of the tutor's and student's lines of each session's marked text."""
    lines = T.view_lines(texts, "session_id", text_col).withColumnRenamed("at", "idx").where(F.col("role").isin("student", "tutor"))
    w = Window.partitionBy("session_id")
    return lines.withColumns({"at": F.row_number().over(w.orderBy("idx")) - 1, "n": F.count("*").over(w)})


def turn_overlaps(texts: DataFrame, responses: DataFrame, cues: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row per response and turn: position, overlap with the objective, words and cue flags."""
    cues = cues or T.TURN_CUES
    content = F.col("content")
    flag = lambda name, role: F.when(F.col("role") == role, T.has_cue(content, cues[name])).otherwise(0.0).alias(name)
    turns = dialogue_turns(texts).select("session_id", "at", "n", "role", T.tokens(content).alias("tokens"), T.space_words(content).cast("double").alias("words"), flag("affirm", "tutor"), flag("correction", "tutor"), flag("uncertainty", "student"), flag("reasoning", "student"))
    terms = responses.select("response_id", "session_id", T.terms(F.col("objective")).alias("terms"))
    joined = terms.join(turns, "session_id")
    return joined.withColumns({"overlap": F.size(F.array_intersect("terms", "tokens")) / F.greatest(F.lit(1), F.size("terms")), "position": F.col("at") / F.greatest(F.lit(1), F.col("n") - 1)}).drop("terms", "tokens")


def ordered_features(texts: DataFrame, responses: DataFrame, cues: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row for each response; all features are 0 (last cue positions -1) where its session has no dialogue."""
    w = Window.partitionBy("response_id").orderBy("at")
    later = w.rowsBetween(2, Window.unboundedFollowing)
    student, tutor = F.col("role") == "student", F.col("role") == "tutor"
    t = turn_overlaps(texts, responses, cues).withColumns({
        "next_role": F.lead("role").over(w), "next_affirm": F.lead("affirm").over(w), "next_correction": F.lead("correction").over(w), "prev_role": F.lag("role").over(w),
        "later_overlap": F.first(F.when(student, F.col("overlap")), ignorenulls=True).over(later), "later_affirm": F.max("affirm").over(later),
    })
    pair = student & (F.col("next_role") == "tutor")
    early, late = F.col("position") <= 1 / 3, F.col("position") >= 2 / 3
    total = lambda v, keep: F.coalesce(F.sum(F.when(keep, v)), F.lit(0.0))
    mean = lambda v, keep: F.coalesce(F.avg(F.when(keep, v)), F.lit(0.0))
    end = lambda f, keep: F.coalesce(f(F.when(keep, F.col("overlap")), F.when(keep, F.col("at"))), F.lit(0.0))
    share = lambda keep: mean((F.col("overlap") > 0).cast("double"), keep)
    ov, words = F.col("overlap"), F.col("words")
    af, co, linked = F.col("next_affirm"), F.col("next_correction"), (ov > 0).cast("double")
    repair = pair & (co > 0)
    delta = F.col("later_overlap") - ov
    f = {"dialogue_turns": F.count("*").cast("double"), "student_turns": F.count_if(student).cast("double"), "tutor_turns": F.count_if(tutor).cast("double"), "role_switches": F.count_if(F.col("prev_role") != F.col("role")).cast("double")}
    for cue in ("affirm", "correction", "uncertainty", "reasoning"):
        f |= {f"{cue}_early": total(F.col(cue), early), f"{cue}_late": total(F.col(cue), late)}
    for name, role in (("student", student), ("tutor", tutor)):
        f |= {f"{name}_objective_mean": mean(ov, role), f"{name}_objective_max": F.coalesce(F.max(F.when(role, ov)), F.lit(0.0)), f"{name}_objective_first": end(F.min_by, role), f"{name}_objective_last": end(F.max_by, role), f"{name}_objective_early": mean(ov, role & early), f"{name}_objective_late": mean(ov, role & late), f"{name}_objective_positive_share": share(role), f"{name}_words_early": mean(words, role & early), f"{name}_words_late": mean(words, role & late)}
    f |= {"feedback_pairs": F.count_if(pair).cast("double"), "affirm_pairs": total(af, pair), "correction_pairs": total(co, pair), "objective_affirm_pairs": total(af * linked, pair), "objective_correction_pairs": total(co * linked, pair), "uncertain_correction_pairs": total(F.col("uncertainty") * co, pair), "uncertain_affirm_pairs": total(F.col("uncertainty") * af, pair), "reasoning_affirm_pairs": total(F.col("reasoning") * af, pair)}
    f |= {"repair_opportunities": F.count_if(repair).cast("double"), "repair_overlap_improved": F.count_if(repair & (delta > 0)).cast("double"), "repair_later_affirm": F.count_if(repair & (F.col("later_affirm") > 0)).cast("double"), "repair_overlap_delta_mean": mean(delta, repair)}
    f |= {f"last_{cue}_position": F.coalesce(F.max(F.when(tutor & (F.col(cue) > 0), F.col("position"))), F.lit(-1.0)) for cue in ("affirm", "correction")}
    out = responses.select("response_id").join(t.groupBy("response_id").agg(*[c.alias(k) for k, c in f.items()]), "response_id", "left")
    out = out.withColumns({k: F.coalesce(k, F.lit(-1.0 if k.startswith("last_") else 0.0)) for k in f})
    difference = lambda k: F.col(f"{k}_late") - F.col(f"{k}_early")
    out = out.withColumns({f"{k}_delta": difference(k) for k in ("affirm", "correction", "uncertainty", "reasoning", "student_objective", "tutor_objective", "student_words", "tutor_words")})
    rate = F.when(F.col("repair_opportunities") > 0, (F.col("repair_overlap_improved") + F.col("repair_later_affirm")) / (2 * F.col("repair_opportunities"))).otherwise(0.0)
    out = out.withColumns({"student_turn_share": F.col("student_turns") / F.greatest(F.lit(1.0), F.col("dialogue_turns")), "repair_success_rate": rate})
    return out.drop("tutor_objective_first", "tutor_objective_early", "tutor_objective_late").withColumnsRenamed({c: f"ordered_{c}" for c in out.columns if c != "response_id"})
