"""Evidence for an objective: a session's lines, exchanges of two speakers and course, rendered as short marked texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convolytics.functions import text as T
from convolytics.operators.ordered import dialogue_turns

# What the prefixes of a view's lines are called, and the sentinels.
PREFIXES = {"objective": "learning_objective", "answer": "student_speech", "feedback": "tutor_feedback"}
NO_PAIR = "no_answer_feedback_pair"


def scored_turns(texts: DataFrame, responses: DataFrame, text_col: str = "full_text") -> DataFrame:
    """response_id, at, n, role, content, score: dialogue turns with their overlap with the response's objective."""
    asked = responses.select("response_id", "session_id", T.terms(F.col("objective")).alias("terms"), T.term_bigrams(F.col("objective")).alias("bigrams"))
    turns = dialogue_turns(texts, text_col).select("session_id", "at", "n", "role", "content", T.tokens(F.col("content")).alias("tokens"))
    score = T.token_score(F.col("terms"), F.col("bigrams"), F.col("tokens"), T.bigrams(F.col("tokens")))
    return asked.join(turns, "session_id").select("response_id", "at", "n", "role", "content", score.alias("score"))


def pick(rows: DataFrame, by: str, order: str, top: int, last: int, least: int = 4) -> DataFrame:
    """The `top` best rows of each group with a score (ties go to the later), its `last` rows, and, where these are
    fewer than `least` (or the group), as many evenly spaced ones."""
    group = Window.partitionBy(by)
    n, few = F.col("_n"), F.least(F.lit(least), F.col("_n"))
    rows = rows.withColumns({"_n": F.count("*").over(group), "_at": F.row_number().over(group.orderBy(order)) - 1, "_nth": F.row_number().over(group.orderBy(F.desc(F.round("score", 9)), F.desc(order)))})
    rows = rows.withColumn("_kept", ((F.col("_nth") <= top) & (F.col("score") > 0)) | (F.col("_at") >= n - last))
    spaced = F.exists(F.sequence(F.lit(0), few - 1), lambda i: F.floor(i * (n - 1) / F.greatest(F.lit(1), few - 1)) == F.col("_at"))
    short = F.sum(F.col("_kept").cast("int")).over(group) < few
    return rows.withColumn("_kept", F.col("_kept") | (short & spaced)).where("_kept").drop("_n", "_at", "_nth", "_kept")


def _rendered(responses: DataFrame, kept: DataFrame, line: Column, order: str, out: str) -> DataFrame:
    """response_id and the kept lines in order below the objective; the objective alone where nothing is kept."""
    lines = kept.groupBy("response_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]).alias("_lines"))
    head = F.array(F.concat(F.lit("[OBJECTIVE] "), F.trim(F.coalesce("objective", F.lit("")))))
    return responses.select("response_id", "objective").join(lines, "response_id", "left").select("response_id", F.array_join(F.concat(head, F.coalesce("_lines", F.array().cast("array<string>"))), "\n").alias(out))


def role_evidence(turns: DataFrame, responses: DataFrame, role: str, top: int = 6, last: int = 4, words: int = 16) -> DataFrame:
    """response_id, evidence: the lines of one role that bear on the objective, and its last ones."""
    kept = pick(turns.where(F.col("role") == role), "response_id", "at", top, last)
    return _rendered(responses, kept, F.concat(F.lit(f"[{role.upper()}] "), T.compact(F.col("content"), words)), "at", "evidence")


def exchanges(turns: DataFrame, words: int = 14) -> DataFrame:
    """response_id, at, score, rendered: neighbouring turns of different roles; the score adds both turns and their cues."""
    w = Window.partitionBy("response_id").orderBy("at")
    content, role = F.col("content"), F.col("role")
    bonus = T.cue_bonus(role, content, [T.POSITIVE_FEEDBACK, T.CORRECTIVE_FEEDBACK], [T.STUDENT_REASONING, T.STUDENT_UNCERTAINTY])
    both = turns.withColumn("value", F.col("score") + bonus)
    both = both.withColumns({"next_role": F.lead("role").over(w), "next_content": F.lead("content").over(w), "next_value": F.lead("value").over(w)}).where("role <> next_role")
    left, right = T.compact(content, words), T.compact(F.col("next_content"), words)
    marked = lambda a, b: F.concat(F.lit(f"[{a}] "), left, F.lit(f"\n[{b}] "), right)
    rendered = F.when(role == "student", marked("ANSWER", "FEEDBACK")).otherwise(marked("PROMPT", "RESPONSE"))
    return both.select("response_id", "at", (F.col("value") + F.col("next_value")).alias("score"), rendered.alias("rendered"))


def feedback_windows(turns: DataFrame, responses: DataFrame, top: int = 5, last: int = 2) -> DataFrame:
    """response_id, feedback: the exchanges that bear most on the objective, and the last ones."""
    return _rendered(responses, pick(exchanges(turns), "response_id", "at", top, last), F.col("rendered"), "at", "feedback")


def session_trajectory(texts: DataFrame, first: int = 5, around: int = 3, last: int = 8, words: int = 12) -> DataFrame:
    """session_id, trajectory: the first, middle and last dialogue turns of a session."""
    at, n = F.col("at"), F.col("n")
    middle = F.floor(n / 2)
    kept = dialogue_turns(texts).where((at < first) | ((at >= middle - around) & (at < middle + around)) | (at >= n - last))
    line = F.concat(F.lit("["), F.upper("role"), F.lit("] "), T.compact(F.col("content"), words))
    lines = kept.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("line")))), lambda x: x["line"]).alias("_lines"))
    return texts.select("session_id").join(lines, "session_id", "left").select("session_id", F.array_join(F.concat(F.array(F.lit("[SESSION_TRAJECTORY]")), F.coalesce("_lines", F.array().cast("array<string>"))), "\n").alias("trajectory"))


def answered_lines(df: DataFrame, key: str, view: str) -> DataFrame:
    """key, at, role, content of a view's lines, with pair: an answer that feedback follows (objective and unmarked lines
    don't count), and for it feedback, objective, i and n: what follows, what it is about, its place and their number.

    All windows are by key, so that lines are shuffled once.
    """
    whole = Window.partitionBy(key)
    said = Window.partitionBy(key, "said").orderBy("at")
    about = F.col("role") == "objective"
    lines = T.view_lines(df, key, view).withColumn("said", ~F.col("role").isin("objective", "unknown"))
    lines = lines.withColumns({
        "objective": F.coalesce(F.max_by(F.when(about, F.col("content")), F.when(about, F.col("at"))).over(whole), F.lit("")),
        "next_role": F.lead("role").over(said), "feedback": F.lead("content").over(said),
    })
    lines = lines.withColumn("pair", F.coalesce((F.col("role") == "answer") & (F.col("next_role") == "feedback"), F.lit(False)))
    pairs = F.col("pair").cast("int")
    return lines.withColumns({"i": F.sum(pairs).over(whole.orderBy("at")) - 1, "n": F.sum(pairs).over(whole), "answer": F.col("content")}).drop("said", "next_role")


def pair_symbols(cues: Mapping[str, Sequence[str]]) -> Column:
    """What a pair of answered_lines says: place, link to the objective, cues and their crossings."""
    a, f, n, i, overlap = (F.col(c) for c in ("answer", "feedback", "n", "i", "overlap"))
    either = lambda test, yes, no: F.when(test, yes).otherwise(no)
    cue = lambda text, name: T.has_cue(text, cues[name]) > 0
    place = F.when(3 * i < n, "early").when(3 * i >= 2 * n, "late").otherwise("middle")
    level = F.when(overlap == 0, "none").when(overlap >= 0.5, "high").otherwise("some")
    reasons, doubts = either(cue(a, "reasoning"), "reasoning", "no_reasoning"), either(cue(a, "uncertainty"), "uncertain", "certain")
    affirms, corrects = either(cue(f, "affirm"), "affirm", "no_affirm"), either(cue(f, "correction"), "corrective", "no_corrective")
    digits = F.lower(a).rlike("(?<![a-z0-9])[0-9]+(?![a-z0-9])")
    flags = [
        reasons, doubts, either(a.contains("?"), "answer_question", "answer_statement"), either(digits, "answer_numeric", "answer_text"),
        either(T.space_words(a) <= 5, "answer_short", "answer_long"), affirms, corrects,
        either(f.contains("?"), "feedback_question", "feedback_statement"), either(cue(f, "reasoning"), "feedback_reasoning", "no_feedback_reasoning"),
    ]
    both = ((F.concat(F.lit("obj_"), level), affirms), (reasons, affirms), (doubts, corrects), (place, affirms), (place, corrects))
    crossed = [F.concat(F.lit("pair_"), x, F.lit("_"), y) for x, y in both]
    return F.concat_ws(" ", F.concat(F.lit("pair_position_"), place), F.concat(F.lit("objective_"), level), *flags, *crossed)


def feedback_texts(df: DataFrame, key: str, view: str, cues: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """key, prefixed, events of each view; key is unique. prefixed: the words of its objective, answers and feedback, each
    with its line's prefix, sentinels for what is missing; events: each answered pair as a line of symbols, the sentinel
    where there is none. Lines are exploded once; all symbols are plain expressions of a row."""
    prefix = reduce(lambda c, kv: c.when(F.col("role") == kv[0], kv[1] + "_"), PREFIXES.items(), F)
    words = F.array_join(F.regexp_extract_all(F.lower("content"), F.lit(r"(?U)\w+"), 0), " ")
    named = F.when(F.col("role").isin(*PREFIXES) & (words != ""), F.concat(prefix, F.replace(words, F.lit(" "), F.concat(F.lit(" "), prefix))))
    lines = answered_lines(df, key, view).withColumn("overlap", F.when(F.col("pair"), T.overlap_ratio(T.terms(F.col("objective")), F.col("answer"))))
    lines = lines.select(key, "at", "role", named.alias("_named"), F.when(F.col("pair"), pair_symbols(cues or T.TURN_CUES)).alias("_said"))
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", c)))).alias(c)
    spoken = [F.max(F.col("_named").isNotNull() & (F.col("role") == r)).alias(f"_{r}") for r in ("answer", "feedback")]
    found = df.select(key).join(lines.groupBy(key).agg(listed("_named"), listed("_said"), *spoken), key, "left")
    absent = [F.when(F.coalesce(f"_{r}", F.lit(False)), F.lit(None)).otherwise(f"{PREFIXES[r]}_missing") for r in ("answer", "feedback")]
    events = F.when(F.size("_said") > 0, F.array_join(F.col("_said._said"), "\n")).otherwise(NO_PAIR)
    return found.select(key, F.concat_ws(" ", F.col("_named._named"), *absent).alias("prefixed"), events.alias("events"))


def compact_context(context: Column, last: int = 8, first: int = 4, words: int = 16) -> Column:
    """An objective's context in short: the objective, the end of its discussion and, if that is long, the beginning."""
    lines = F.filter(F.transform(F.split(F.coalesce(context, F.lit("")), T.LINE_END), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    said = F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))
    chosen = F.transform(F.when(F.size(said) <= last + first, said).otherwise(F.concat(F.slice(said, -last, last), F.slice(said, 1, first))), lambda x: T.compact(x, words))
    part = lambda title, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"{title} objective discussion: "), F.array_join(xs, " ")))
    head = F.regexp_replace(F.get(lines, F.lit(0)), r"^(.*?)\[OBJECTIVE\]", "$1Objective:")
    return F.when(F.size(lines) == 0, "").otherwise(F.concat_ws("\n", head, part("End of", F.slice(chosen, 1, last)), part("Earlier", F.slice(chosen, last + 1, last + first))))
