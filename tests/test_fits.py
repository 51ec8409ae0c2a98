"""TF-IDF by fold, sparse blocks, boosted trees and fits that go on where they were broken off."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from convolytics.operators import ensembles, models, sparse, splits, trees, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_terms_of_words_and_characters(spark):
    text = F.lit("Été à l'Œuvre,  NAÏVE x_1 é")
    assert one(spark, sparse.word_terms(text, 3, accents=False)) == ["ete", "œuvre", "naive", "x_1", "ete œuvre", "œuvre naive", "naive x_1", "ete œuvre naive", "œuvre naive x_1"]
    assert one(spark, sparse.word_terms(text, 1, 1))[:3] == ["été", "à", "l"]
    assert one(spark, sparse.word_terms(F.lit(None).cast("string"))) == [] == one(spark, sparse.word_terms(F.lit("a"), 3))
    assert one(spark, sparse.char_terms(F.lit("É a"), 3, 4, accents=False)) == [" e ", " e ", " a ", " a "]


def test_vocabulary_and_weights_by_fold(spark):
    docs = {1: (0, "a b b"), 2: (0, "a c"), 3: (1, "a b"), 4: (1, "d d d")}
    rows = spark.createDataFrame([(f, i, t) for i, (f, t) in docs.items()], "fold int, doc int, text string")
    counts = sparse.counted(rows, ["fold", "doc"], F.split("text", " "))
    voc = {(r.eval_fold, r.term): (r.slot, r.idf) for r in sparse.vocabulary(counts, 2, 1, 2).collect()}
    assert {k: v[0] for k, v in voc.items()} == {(-1, "a"): 0, (-1, "b"): 1, (0, "d"): 0, (0, "a"): 1, (1, "a"): 0, (1, "b"): 1}
    assert voc[-1, "a"][1] == pytest.approx(math.log(5 / 4) + 1) and voc[1, "b"][1] == pytest.approx(math.log(3 / 2) + 1) and voc[0, "d"][1] == pytest.approx(math.log(3 / 2) + 1)
    got = sparse.tf_idf_rows(counts.drop("fold"), sparse.vocabulary(counts, 2, 1, 2), ["doc"]).where("eval_fold = -1 and doc = 1").orderBy("slot").collect()
    a, b = math.log(5 / 4) + 1, (1 + math.log(2)) * (math.log(5 / 3) + 1)
    assert [r.value for r in got] == pytest.approx([a / math.hypot(a, b), b / math.hypot(a, b)])


def test_blocks_stand_side_by_side(spark):
    rows = spark.createDataFrame([(1, "a a b", 2.0), (2, "", 0.0), (3, "c", None)], "k int, t string, x double")
    words = sparse.hashed_rows(rows, ["k"], F.filter(F.split("t", " "), lambda w: w != ""), 16)
    both = sparse.beside({"words": (words, 3.0, 16), "dense": (sparse.dense_rows(rows, ["k"], ["x"]), 4.0, 1)}, ["k"])
    got = {r.k: r.features for r in sparse.as_vectors(both, rows, ["k"], 17).collect()}
    assert {v.size for v in got.values()} == {17} and got[2].numNonzeros() == 0
    assert sorted(got[1].values) == pytest.approx(sorted([0.6 * 2 / 5**0.5, 0.6 / 5**0.5, 1.6])) and got[1][16] == pytest.approx(1.6)
    assert np.linalg.norm(got[3].values) == pytest.approx(0.6)


def responses(spark, n=120):
    rows = [(i, i // 2, i % 10 // 2, int(i % 4 < 2), "good fine" if i % 4 < 2 else "bad poor", float(i % 4)) for i in range(n)]
    return spark.createDataFrame(rows, "response_id long, session_id long, fold int, target int, text string, x double")


def test_tf_idf_models_learn(spark):
    texts = {"words": (sparse.word_terms(F.col("text"), accents=False), 100, 1, None), "sessions": (sparse.word_terms(F.col("text")), 10, 1, "session_id")}
    p = models.tf_idf_out_of_fold(responses(spark), texts).collect()
    assert len(p) == 120 and all((r.p > 0.5) == r.target for r in p)


def test_fits_go_on_where_they_were_broken_off(spark, tmp_path, monkeypatch):
    rows, fits = responses(spark), []

    class Counted:
        def fit(self, train):
            if len(fits) == 2 and not fits[0]:
                raise KeyboardInterrupt
            fits.append(len(fits) > 2)
            return models.numeric_logistic(["x"], n=100).fit(train)

    run = lambda settings: models.out_of_fold(rows, lambda n: Counted(), store=str(tmp_path), settings=settings)
    with pytest.raises(KeyboardInterrupt):
        run("a")
    assert len(fits) == 2
    fits[0] = True
    done = run("a").collect()
    assert len(fits) == 5 and len(done) == 120
    assert sorted(run("a").collect()) == sorted(done) and len(fits) == 5
    run("b")
    assert len(fits) == 10
    assert models.rows_digest(rows, "a") == models.rows_digest(rows.orderBy(F.desc("response_id")), "a") != models.rows_digest(rows.limit(9), "a")


def test_a_tree_takes_the_best_leaf_first():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 12, (400, 3)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 7)).astype(float)
    edges = [trees.bin_edges(x[:, j]) for j in range(3)]
    bins = trees.binned(x, edges)
    g, h = 0.5 - y, np.full(400, 0.25)

    def gain(rows):
        best = 0.0
        for f in range(3):
            for cut in range(12):
                left = rows[bins[rows, f] <= cut]
                right = np.setdiff1d(rows, left)
                if len(left) >= 5 and len(right) >= 5:
                    part = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1.0)
                    best = max(best, part(left) + part(right) - part(rows))
        return best

    nodes, added = trees.Grower(bins, 4, 5, 1.0).grow(g, h, 1.0)
    assert sum(n[0] < 0 for n in nodes) == 4
    where = {0: np.arange(400)}
    for i, (f, cut, left, right, _) in enumerate(nodes):
        if f >= 0:
            rows = where[i]
            where[left], where[right] = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
            assert max(gain(where[i]), 0) == pytest.approx(trees.Grower(bins, 4, 5, 1.0).best(trees.Grower(bins, 4, 5, 1.0).sums(rows, g, h))[0])
    for i, n in enumerate(nodes):
        if n[0] < 0:
            assert added[where[i]] == pytest.approx(-g[where[i]].sum() / (h[where[i]].sum() + 1.0))


def test_many_values_are_binned_by_quantiles():
    x = np.random.default_rng(1).normal(size=(5000, 1))
    counts = Counter(trees.binned(x, [trees.bin_edges(x[:, 0])])[:, 0].tolist())
    assert len(counts) == trees.BINS and max(counts.values()) < 40


def test_trees_predict_out_of_fold(spark):
    got = trees.trees_out_of_fold(responses(spark), ["x"], rounds=30, step=0.3, least=5).collect()
    assert len(got) == 240 and {r.model for r in got} == {"trees_7", "trees_15"} and all((r.p > 0.5) == r.target for r in got)
    alike = responses(spark).withColumn("target", F.lit(1))
    assert all(r.p > 0.99 for r in trees.trees_out_of_fold(alike, ["x"], rounds=5).collect())


def test_each_fit_has_a_task_of_its_own(spark):
    rows = spark.range(4000).select((F.col("id") % 10).cast("int").alias("fit"), "id").repartition(3)
    where = trees.alone(rows, "fit", 10).select("fit", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(where) == 10 == len({r.task for r in where})
    sc = spark.sparkContext
    sc.setJobGroup("trees", "fits side by side")
    try:
        got = trees.trees_out_of_fold(responses(spark), ["x"], rounds=1, least=5)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    tasks = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("trees") for s in status.getJobInfo(j).stageIds if status.getStageInfo(s)]
    assert max(tasks) >= 10 and got.count() == 240


def test_a_bounded_fit_draws_by_hash_and_purges_by_all_rows(spark):
    rows = responses(spark, 400)
    few = rows.where("response_id < 100")
    assert splits.purged_pairs(few, held=rows).count() == splits.purged_pairs(rows).where("response_id < 100").count() > 0
    odd = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 2, 1)], "response_id int, session_id int, fold int")
    part = splits.purged_pairs(odd.where("response_id <> 1"), k=2, held=odd).collect()
    assert sorted((r.eval_fold, r.response_id) for r in part) == [(0, 3)]
    got = trees.trees_out_of_fold(rows, ["x"], rounds=30, step=0.3, least=5, max_rows=100).collect()
    assert len(got) == 800 and all((r.p > 0.5) == r.target for r in got)


def test_models_on_blocks_learn(spark):
    rows = responses(spark)
    words = sparse.hashed_rows(rows, ["response_id"], sparse.word_terms(F.col("text")), 64)
    p = models.blocks_out_of_fold(rows, sparse.beside({"words": (words, 1.0, 64)}, ["response_id"]), 64, ["x"]).collect()
    assert len(p) == 120 and all((r.p > 0.5) == r.target for r in p)


def test_a_bundle_scores_as_it_did_before_it_was_saved(spark, tmp_path):
    rows = responses(spark)
    parts = {"x": models.numeric_logistic(["x"], n=100), "text": models.hashed_text_logistic("text", 64)}
    bundle = models.Bundle.fit(rows, parts, {"x": 0.25, "text": 0.75}, ["x", "text"])
    bundle.save(str(tmp_path / "b"))
    loaded = models.Bundle.load(spark, str(tmp_path / "b"))
    before, after = ({r.response_id: r.score for r in b.score(rows).collect()} for b in (bundle, loaded))
    assert before == after and len(after) == 120 and loaded.version == spark.version
    assert {r.response_id: r.score for r in loaded.score(rows.where("response_id < 7").repartition(3)).collect()} == {i: after[i] for i in range(7)}
    single = {r.response_id: r.p for r in loaded.parts["x"].transform(rows).select("response_id", models.vector_to_array("probability")[1].alias("p")).collect()}
    text = {r.response_id: r.p for r in loaded.parts["text"].transform(rows).select("response_id", models.vector_to_array("probability")[1].alias("p")).collect()}
    assert all(after[i] == pytest.approx(0.25 * single[i] + 0.75 * text[i]) for i in after)
    with pytest.raises(ValueError, match="missing columns"):
        loaded.score(rows.drop("text"))
    with pytest.raises(ValueError, match="sum to 1"):
        models.Bundle(bundle.parts, {"x": 0.5, "text": 0.6}, {}, "")


def test_pairs_of_the_best_models(spark):
    rows = [("p", i, i % 2, 0.5, m, 0.5 + (i % 2 - 0.5) * q) for i in range(40) for m, q in (("a", 0.9), ("b", 0.5), ("c", 0.1), ("d", -0.5))]
    long = spark.createDataFrame(rows, "protocol string, response_id int, target int, prior double, model string, p double")
    assert sorted(r.model for r in ensembles.best_models(long, top=3).collect()) == ["a", "b", "c"]
    best = ensembles.best_pair_blends(long, top=3, first=(0.0, 0.5, 1.0), model=(0.5, 1.0)).collect()
    assert sorted((r.first, r.second, r.first_weight, r.model_weight) for r in best) == [("a", "b", 1.0, 1.0), ("a", "c", 1.0, 1.0), ("b", "c", 1.0, 1.0)]


def test_projections_keep_angles(spark):
    texts = [(1, " ".join(f"w{i}" for i in range(60))), (2, " ".join(f"w{i}" for i in range(6, 60))), (3, " ".join(f"v{i}" for i in range(60))), (4, "")]
    rows = spark.createDataFrame(texts, "k int, t string")
    got = {r.k: np.array(r.vector) for r in vectors.projected(rows, "k", sparse.word_terms(F.col("t"), 1), 128).collect()}
    assert set(got) == {1, 2, 3} and all(np.linalg.norm(v) == pytest.approx(1) and len(v) == 128 for v in got.values())
    assert got[1] @ got[2] > 0.85 and abs(got[1] @ got[3]) < 0.4


def test_nearest_objectives_do_not_depend_on_blocks(spark):
    rng = np.random.default_rng(3)
    known = [(f, i, [float(x) for x in rng.integers(-2, 3, 4)]) for f in range(2) for i in range(40)]
    asked = [(f, i, [float(x) for x in rng.integers(-2, 3, 4)]) for f in range(2) for i in range(9)]
    a, k = spark.createDataFrame(asked, "eval_fold int, objective_id int, q array<double>"), spark.createDataFrame(known, "eval_fold int, t_objective int, p array<double>")
    want = {(f, i): sorted(range(40), key=lambda j: (-np.dot(q, known[f * 40 + j][2]), j))[:5] for f, i, q in asked}
    for blocks in (1, 7):
        got = {}
        for r in vectors.nearest_objectives(a, k, 5, blocks).orderBy(F.desc("os"), "t_objective").collect():
            got.setdefault((r.eval_fold, r.objective_id), []).append(r.t_objective)
        assert got == want
