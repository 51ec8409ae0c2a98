"""Session-level features and texts from utterances (session_id, utterance_id, role, content, timestamp)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolytics.functions import text as T
from convolytics.operators.expect import ExpectationFailed


def _joined(value: Column, keep: Column) -> Column:
    """Kept values of a group in order of utterance, joined by line ends."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("utterance_id", value.alias("v"))))), lambda x: x["v"]), "\n")


def session_features(u: DataFrame) -> DataFrame:
    """One row per session: turns, duration, characters, turns by role, unclear and empty turns."""
    is_role = lambda *r: F.count_if(F.col("role").isin(*r))
    sec = T.seconds(F.col("timestamp"))
    return u.groupBy("session_id").agg(
        F.count("*").alias("n_utterances"), (F.max(sec) - F.min(sec)).alias("duration_seconds"),
        F.sum(F.length(F.coalesce("content", F.lit("")))).alias("n_chars"), is_role("tutor").alias("n_tutor"), is_role("student").alias("n_student"),
        is_role("background").alias("n_background"), F.count_if(~F.col("role").isin("tutor", "student", "background")).alias("n_other"),
        F.count_if(T.is_unclear(F.col("content"))).alias("n_unclear"), F.count_if(T.is_blank(F.col("content"))).alias("n_empty"),
    )


def _placed(u: DataFrame, fraction: float) -> DataFrame:
    """u with is_closing (position >= floor(n * (1 - fraction))) and is_opening (the first max(1, ceil(n * fraction)))."""
    whole = Window.partitionBy("session_id")
    order = whole.orderBy("utterance_id")
    at, n = F.row_number().over(order) - 1, F.count("*").over(whole)
    return u.withColumns({"is_closing": at >= F.floor(n * (1 - fraction)), "is_opening": at < F.greatest(F.lit(1), F.ceil(n * fraction)), "is_switch": F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(False))})


def session_texts(u: DataFrame, fraction: float = 0.25) -> DataFrame:
    line = T.marked_line(F.col("role"), F.col("content"))
    return _placed(u, fraction).groupBy("session_id").agg(_joined(line, F.lit(True)).alias("full_text"), _joined(line, F.col("is_closing")).alias("closing_text"))


def role_texts(u: DataFrame, fraction: float = 0.25) -> DataFrame:
    content, role = F.coalesce("content", F.lit("")), F.col("role")
    return _placed(u, fraction).groupBy("session_id").agg(
        _joined(content, role == "tutor").alias("tutor_text"), _joined(content, role == "student").alias("student_text"),
        _joined(content, (role == "tutor") & F.col("is_closing")).alias("closing_tutor_text"), _joined(content, (role == "student") & F.col("is_closing")).alias("closing_student_text"),
        _joined(T.marked_line(role, F.col("content")), F.col("is_opening")).alias("opening_text"),
    )


def behavior(u: DataFrame, cues: Mapping[str, Sequence[str]] | None = None, fraction: float = 0.25) -> DataFrame:
    """16 lexical counters of a session. Counts are per utterance, then summed: no cue spans two of them."""
    cues = cues or T.SESSION_CUES
    content, role = F.col("content"), F.col("role")
    tutor, student = role == "tutor", role == "student"
    total = lambda value, keep: F.sum(F.when(keep, value).otherwise(0))
    words = T.word_count(content)
    counts = {
        "role_switches": F.count_if("is_switch"), "tutor_words": total(words, tutor), "student_words": total(words, student),
        "tutor_questions": total(T.char_count(content, "?"), tutor), "student_questions": total(T.char_count(content, "?"), student),
        "tutor_affirmations": total(T.cue_count(content, cues["affirm"]), tutor), "tutor_corrections": total(T.cue_count(content, cues["correction"]), tutor),
        "student_uncertainty": total(T.cue_count(content, cues["uncertainty"]), student), "student_reasoning_cues": total(T.cue_count(content, cues["reasoning"]), student),
        "tutor_reasoning_cues": total(T.cue_count(content, cues["reasoning"]), tutor), "student_digit_tokens": total(T.number_count(content), student), "tutor_digit_tokens": total(T.number_count(content), tutor),
        "student_mean_words": total(words, student) / F.greatest(F.lit(1), F.count_if(student)), "tutor_mean_words": total(words, tutor) / F.greatest(F.lit(1), F.count_if(tutor)),
        "closing_student_words": total(words, student & F.col("is_closing")), "closing_tutor_words": total(words, tutor & F.col("is_closing")),
    }
    return _placed(u, fraction).groupBy("session_id").agg(*[c.alias(n) for n, c in counts.items()])


def behavior_ratios(b: DataFrame) -> DataFrame:
    per = lambda a, c: F.col(a) / (F.col(c) + 1)
    return b.withColumns({"student_tutor_words": per("student_words", "tutor_words"), "affirmation_rate": per("tutor_affirmations", "tutor_words"), "correction_rate": per("tutor_corrections", "tutor_words"), "uncertainty_rate": per("student_uncertainty", "student_words"), "reasoning_rate": per("student_reasoning_cues", "student_words"), "digit_rate": per("student_digit_tokens", "student_words"), "question_rate": per("tutor_questions", "tutor_words"), "closing_share": per("closing_student_words", "student_words")})


def rollup(u: DataFrame) -> DataFrame:
    return u.groupBy("role").agg(F.count("*").alias("n_utterances"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("n_chars"))


def modeling_base(resp: DataFrame, features: DataFrame) -> DataFrame:
    """Responses with their session's features (m:1) and six derived columns."""
    share = lambda c: F.col(c) / F.col("n_utterances")
    out = resp.join(features, "session_id", "left")
    return out.withColumns({"objective_chars": F.length("objective"), "objective_words": T.space_words(F.col("objective")), "student_fraction": share("n_student"), "tutor_fraction": share("n_tutor"), "background_fraction": share("n_background"), "unclear_fraction": share("n_unclear")})


def token_lengths(df: DataFrame, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """texts, mean_tokens, p95_tokens (interpolated), max_tokens of the texts' words between blanks; null texts have none."""
    n = T.space_words(F.col(text_col))
    one = [F.count("*").alias("texts"), F.avg("_n").alias("mean_tokens"), F.percentile("_n", 0.95).alias("p95_tokens"), F.max("_n").alias("max_tokens")]
    return df.withColumn("_n", n).groupBy(*by).agg(*one)


def log_counts(df: DataFrame, counts: Sequence[str]) -> DataFrame:
    """df with each of the counts replaced by the logarithm of 1 + it; below 0 counts as 0."""
    return df.withColumns({c: F.log1p(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))) for c in counts})


def replace_rows(stored: DataFrame, computed: DataFrame, key: str, over: Column) -> DataFrame:
    """stored, but with the computed rows where `over` holds for the stored one: only those need to be computed."""
    stale = stored.where(over).select(key)
    fresh = computed.join(stale, key, "left_semi").select(*stored.columns)
    return stored.where(~F.coalesce(over, F.lit(False))).unionByName(fresh)


def changed_rows(before: DataFrame, after: DataFrame, allowed: Column) -> DataFrame:
    """Rows that differ between the two though `allowed` doesn't hold for them: the audit of replace_rows."""
    keep = ~F.coalesce(allowed, F.lit(False))
    a, b = before.where(keep), after.where(keep)
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def audited(before: DataFrame, after: DataFrame, allowed: Column) -> DataFrame:
    """after, if it differs from before only in rows for which `allowed` holds; else an error."""
    if lost := changed_rows(before, after, allowed).limit(1).collect():  # one row, for the message
        raise ExpectationFailed(f"a row that was to stay changed: {lost[0].asDict()}")
    return after


def remaining(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What isn't done yet: a run that was broken off goes on with these."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")
