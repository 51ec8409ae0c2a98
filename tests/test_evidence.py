"""Literal cases of evidence views, sparse models, checked readers, writers and the scoring stream."""

import hashlib
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from convolytics import queries
from convolytics.operators import models, vectors, views
from convolytics.operators.expect import ExpectationFailed
from convolytics.sources import files, sinks
from convolytics.streaming.scoring import score_stream


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_prefixed_words(spark):
    view = "[OBJECTIVE] Add halves\n[ANSWER] One half!\n[PROMPT] skipped\nunmarked"
    rows = spark.createDataFrame([(1, view), (2, None), (3, "[FEEDBACK] ok\n[ANSWER] !")], "id int, view string")
    assert dict(views.feedback_texts(rows, "id", "view").select("id", "prefixed").collect()) == {
        1: "learning_objective_add learning_objective_halves student_speech_one student_speech_half tutor_feedback_missing",
        2: "student_speech_missing tutor_feedback_missing",
        3: "tutor_feedback_ok student_speech_missing",
    }


def test_feedback_events(spark):
    view = "[OBJECTIVE] Represent fractions\n[ANSWER] maybe 3 fractions?\n[FEEDBACK] Not quite, because\n[PROMPT] a\n[RESPONSE] b"
    rows = spark.createDataFrame([(1, view), (2, "[ANSWER] a\n[ANSWER] b"), (3, None), (4, "[OBJECTIVE] x\n[ANSWER] a\n[OBJECTIVE] y\n[FEEDBACK] b")], "id int, view string")
    got = dict(views.feedback_texts(rows, "id", "view").select("id", "events").collect())
    assert got[2] == got[3] == views.NO_PAIR and got[4].startswith("pair_position_early objective_none no_reasoning")
    assert got[1] == (
        "pair_position_early objective_high no_reasoning uncertain answer_question answer_numeric answer_short no_affirm corrective feedback_statement feedback_reasoning "
        "pair_obj_high_no_affirm pair_no_reasoning_no_affirm pair_uncertain_corrective pair_early_no_affirm pair_early_corrective"
    )


def test_compact_context(spark):
    short = value(spark, views.compact_context(F.lit("[OBJECTIVE] o\n a \n\nb")))
    assert short == "Objective: o\nEnd of objective discussion: a b"
    long = value(spark, views.compact_context(F.lit("\n".join(["[OBJECTIVE] o", *(f"l{i}" for i in range(14))]))))
    assert long == "Objective: o\nEnd of objective discussion: " + " ".join(f"l{i}" for i in range(6, 14)) + "\nEarlier objective discussion: l0 l1 l2 l3"
    assert value(spark, views.compact_context(F.lit(""))) == "" and value(spark, views.compact_context(F.lit("only"))) == "only"


def test_pick_takes_best_last_and_spaced(spark):
    rows = [("a", i, 5.0 if i in (1, 2) else 0.0) for i in range(10)] + [("b", i, 0.0) for i in range(7)] + [("c", 0, 0.0)]
    kept = views.pick(spark.createDataFrame(rows, "g string, at int, score double"), "g", "at", 1, 2).collect()
    assert {g: sorted(r.at for r in kept if r.g == g) for g in "abc"} == {"a": [0, 2, 3, 6, 8, 9], "b": [0, 2, 4, 5, 6], "c": [0]}


def test_trajectory_of_a_session_without_dialogue(spark):
    texts = spark.createDataFrame([("s", "plain"), ("t", "[TUTOR] a\n[STUDENT] b")], "session_id string, full_text string")
    assert dict(views.session_trajectory(texts).collect()) == {"s": "[SESSION_TRAJECTORY]", "t": "[SESSION_TRAJECTORY]\n[TUTOR] a\n[STUDENT] b"}


def test_session_weights_have_mean_one(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "session_id string")
    w = models.session_weights(df).collect()
    assert sum(r.weight for r in w) == pytest.approx(3) and {r.session_id: round(r.weight, 6) for r in w} == {"a": 0.75, "b": 1.5}


def test_encode_encodes_each_text_once(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "b"), (3, "aa"), (4, None)], "k int, t string")
    got = {r.k: r.v for r in vectors.encode(df, "t", lambda ts: [[3.0 * len(t), 4.0 * len(t)] for t in ts], "v").collect()}
    assert got[1] == got[3] == pytest.approx([0.6, 0.8]) and got[4] is None
    pairs = vectors.score_pairs(df, "t", "t", lambda a, b: [[float(len(x) + len(y))] for x, y in zip(a, b, strict=True)], "k")
    assert {r.k: r.outputs for r in pairs.collect()} == {1: [4.0], 2: [2.0], 3: [4.0], 4: [0.0]}


def test_readers_check_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text('session_id,utterance_id,role,content,timestamp\ns,0,tutor,"two\nlines, ""quoted""",00:00:01\n')
    assert [(r.content, r.source_file) for r in files.transcripts(spark, str(tmp_path)).collect()] == [('two\nlines, "quoted"', "t.csv")]
    assert files.read_csv(spark, str(tmp_path / "t.csv"), "role string, utterance_id int").first() == ("tutor", 0)
    with pytest.raises(ExpectationFailed, match="missing columns: other"):
        files.read_csv(spark, str(tmp_path / "t.csv"), "other string")
    with pytest.raises(ExpectationFailed):
        files.found(spark, f"{tmp_path}/*.parquet")


def test_labels_need_one_outcome(spark, tmp_path):
    (tmp_path / "one.csv").write_text("response_id,correct\na,1\n")
    (tmp_path / "two.csv").write_text("response_id,correct,is_correct\na,1,1\n")
    assert files.labels(spark, str(tmp_path / "one.csv")).collect() == [("a", 1)]
    with pytest.raises(ExpectationFailed):
        files.labels(spark, str(tmp_path / "two.csv"))


def test_manifest_hashes_only_what_changed(spark, tmp_path):
    folder, kept = tmp_path / "in", str(tmp_path / "manifest")
    folder.mkdir()
    for name in ("a", "b"):
        (folder / name).write_bytes(name.encode())
    files.manifest(spark, str(folder)).withColumn("sha256", F.when(F.col("path").endswith("/a"), F.lit("old")).otherwise(F.col("sha256"))).write.parquet(kept)
    (folder / "c").write_bytes(b"c")
    got = {os.path.basename(r.path): r.sha256 for r in files.manifest(spark, str(folder), known=spark.read.parquet(kept)).collect()}
    assert got == {"a": "old", "b": hashlib.sha256(b"b").hexdigest(), "c": hashlib.sha256(b"c").hexdigest()}
    rows = spark.createDataFrame([("y", 2, "h2"), ("x", 1, "h1")], "path string, bytes long, sha256 string")
    assert files.manifest_digest(rows).first().digest == hashlib.sha256(b"x|1|h1\ny|2|h2\n").hexdigest()


def test_runs_and_baseline(spark, tmp_path):
    spark.createDataFrame([(1, "p0")], "response_id int, protocol string").write.parquet(str(tmp_path / "r1"))
    spark.createDataFrame([(2, "p1", 0.5)], "response_id int, protocol string, p double").write.parquet(str(tmp_path / "r2"))
    both = files.runs(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")])
    assert {tuple(r) for r in both.select("response_id", "p", "source_run_id").collect()} == {(1, None, "r1"), (2, 0.5, "r2")}
    with pytest.raises(ExpectationFailed):
        files.baseline(both, ["p9"])


def test_scores_need_every_id(spark):
    wanted, scores = spark.createDataFrame([(1,), (2,)], "response_id int"), spark.createDataFrame([(1, 0.5)], "response_id int, probability double")
    assert sinks.aligned(wanted.where("response_id = 1"), scores).collect() == [(1, 0.5)]
    with pytest.raises(PySparkException, match="no probability for response_id 2"):
        sinks.aligned(wanted, scores).collect()


def test_cached_table_is_built_once_per_digest(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(len(built))
    counts = [sinks.cached(spark, str(tmp_path / "t"), digest, 1, build).count() for digest in ("a", "a", "b")]
    assert counts == [1, 1, 2]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "model string, fold int")
    sinks.write_table(df, str(tmp_path / "t"), ["fold"])
    assert spark.read.parquet(str(tmp_path / "t")).where("fold = 2").first().model == "b"
    sinks.write_scorecard(df, str(tmp_path / "c"), ["model"])
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["model,fold", "a,1", "b,2"]
    for run in ("r1", "r2"):
        sinks.append_report(spark, str(tmp_path / "r"), run, {"k": "5"}, df.select("fold"), df.select("model"))
    assert {(r.run_id, len(r.folds), r.settings.k) for r in spark.read.json(str(tmp_path / "r")).collect()} == {("r1", 2, "5"), ("r2", 2, "5")}
    with pytest.raises(ExpectationFailed):
        sinks.append_ledger(df, str(tmp_path / "l"))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    priors = spark.createDataFrame([("x", 0.7)], "objective_id string, prior double")
    schema = "response_id int, objective_id string"
    for i, objective in enumerate(("x", "y")):
        spark.createDataFrame([(i, objective)], schema).write.mode("append").parquet(source)
        got = score_stream(spark, source, schema, priors, 0.25, out, mark)
    assert sorted(tuple(r) for r in got.collect()) == [(0, "x", 0.7), (1, "y", 0.25)]


def test_class_ratio_model_learns(spark, tmp_path):
    df = spark.createDataFrame([(i, "good fine" if i % 2 else "bad poor", i % 2) for i in range(20)], "k int, t string, target int")
    fitted = models.fit_and_save(df, {"nb": models.NaiveBayesLogistic("t", 64)}, str(tmp_path))["nb"]
    assert fitted.transform(df).where("prediction <> target").count() == 0


@pytest.mark.parametrize(("name", "width", "text"), [("text_logistic_oof", 1 << 15, "full_text"), ("text_and_dense_oof", 1 << 15, "full_text"), ("session_weighted_oof", 1 << 15, "full_text"), ("nb_logistic_oof", 1 << 17, "prefixed")])
def test_text_models_read_what_was_said(spark, monkeypatch, name, width, text):
    made = []
    monkeypatch.setattr(models, "out_of_fold", lambda df, pipeline: made.append((df, pipeline() if callable(pipeline) else pipeline)) or df)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    df, p = made[0]
    stages = models.word_hashes(p.text, "_text", p.features) if isinstance(p, models.NaiveBayesLogistic) else getattr(p, "pipeline", p).getStages()
    assert {s.getNumFeatures() for s in stages if isinstance(s, HashingTF)} == {width} and stages[0].getInputCol() == text
    assert df.where(F.length(text) > 20).count() > 0
