"""Cases of reviews that the small tables don't hold."""

from __future__ import annotations

import math
import time
import weakref
from pathlib import Path

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as E
from convolytics.llm import common, phrases
from convolytics.operators import expect, jobs, models, sparse, splits, trees, vectors
from convolytics.plans import block_queries, job_queries
from convolytics.sources import bindings, sinks


def test_encoded_documents_round_ties_as_sql(spark, tmp_path):
    """Vectors of norm 320, whose values lie half way between two numbers of five digits."""
    texts = [" ".join([p] * a + [q] * b) for p, a, q, b in (("w21", 79, "w29", 8), ("w37", 79, "w58", 8), ("w5", 79, "w58", 8), ("w53", 79, "w58", 8), ("w5", 5, "w35", 102))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/p")
    (part,) = (tmp_path / "p").glob("*.parquet")
    part.rename(tmp_path / "documents.parquet")
    con = oracle.connect(str(tmp_path))
    assert oracle.compare(con, E.queries()["encoded_documents"](spark, str(tmp_path)), E.oracle_sql()["encoded_documents"]) == ""


def test_neighbours_of_all_configurations_in_one_pass(spark, monkeypatch):
    """Blocks of a few rows, ties and copies, against plain Python."""
    monkeypatch.setattr(vectors, "ASKED_ROWS", 7)
    draw = np.random.default_rng(5)
    rows = [(i, i // 2, i % 3, int(draw.integers(2)), i // 2 % 5, [float(x) for x in draw.integers(-2, 3, 4) / 2], [float(i % 3), 1.0, 0.0, 0.5]) for i in range(120)]
    rows[7] = (*rows[7][:5], None, rows[7][6])
    df = spark.createDataFrame(rows, "response_id long, session_id long, objective_id int, target int, fold int, context array<double>, objective array<double>")
    configs = {"a": (2, 5, 0.5, 3.0, 1.0), "b": (9, 40, 0.25, 2.0, 2.0)}
    swept = vectors.knn_sweep(df, configs)
    got = {(r.config, r.response_id): r.prediction for r in swept.collect()}
    protos = {o: v for _, _, o, _, _, _, v in rows}
    dot = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    for name, (m, k, w, temperature, mass) in configs.items():
        for i, _, o, _, fold, v, _ in rows:
            near = sorted(protos, key=lambda t, o=o: (-round(dot(protos[o], protos[t]), 9), t))[:m]
            train = [r for r in rows if r[4] != fold]
            pairs = [((1 - w) * dot(v, r[5]) + w * dot(protos[o], protos[r[2]]), r[0], r[3]) for r in train if v and r[5] and r[2] in near]
            top = sorted(pairs, key=lambda x: (-round(x[0], 9), x[1]))[:k]
            weight = [math.exp(temperature * (x[0] - top[0][0])) for x in top]
            prior = sum(r[3] for r in train) / len(train)
            want = (sum(a * x[2] for a, x in zip(weight, top, strict=True)) + mass * prior) / (sum(weight) + mass)
            assert got[name, i] == pytest.approx(min(max(want, 1e-5), 1 - 1e-5), abs=1e-9)


def test_nearest_in_tiles_are_those_of_all_pairs():
    draw = np.random.default_rng(6)
    asked, known, near = draw.normal(size=(20, 8)), np.repeat(draw.normal(size=(150, 8)), 2, axis=0), np.zeros(300)
    one = vectors._Nearest(asked, 1, 9, 0.3)
    for c in range(0, 300, 60):
        tile = known[c : c + 60]
        for r in range(0, 20, 6):
            one.offer(r, asked[r : r + 6] @ tile.T, 2e-9, asked.T, tile.T, np.arange(c, c + 60), near[:60], near[:60], np.ones(60, int))
        one.merge(90)
    one.merge()
    for i in range(20):
        want = sorted(range(300), key=lambda j: (-round(0.7 * float(asked[i] @ known[j]), 9), j))[:9]
        assert one.kept[1][one.kept[0] == i].tolist() == want


def test_fits_read_features_without_slot_names(spark, monkeypatch):
    """The model sees columns without metadata, and training rows are those of other folds without the fold's sessions."""
    words = ["a b", "b c", "a c d", "d d a", "c b", "a a", "b d", "c a"]
    rows = [(i, i // 3, i % 2, i % 4 if i < 20 else 4, words[i % 8], float(i % 5)) for i in range(30)]
    df = spark.createDataFrame(rows, "response_id long, session_id long, target int, fold int, text string, x double")
    pipeline = models.text_and_dense_logistic("text", ["x"], 64)
    seen, fit = [], LogisticRegression._fit
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, data: seen.append((data.schema[self.getFeaturesCol()].metadata, data.count())) or fit(self, data))
    out = {r.response_id: r.p for r in models.out_of_fold(df, pipeline).collect()}
    held = {f: {s for _, s, _, g, _, _ in rows if g == f} for f in range(5)}
    assert seen == [({}, sum(g != f and s not in held[f] for _, s, _, g, _, _ in rows)) for f in range(5)]
    monkeypatch.undo()
    train = df.where((F.col("fold") != 4) & ~F.col("session_id").isin(held[4]))
    plain = pipeline.fit(train).transform(df.where("fold = 4")).select("response_id", vector_to_array("probability")[1].alias("p")).collect()
    assert all(out[r.response_id] == pytest.approx(r.p, abs=1e-6) for r in plain) and len(plain) == 10


def test_phrase_shards_are_not_held_once_given():
    """A shard that its taker has emptied is gone before the next one is made."""
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 20, "text": [b"some words, of a text"] * 40})
    refs, shards = [], 0
    for shard in phrases._shards(iter([batch]), 200):
        assert all(r() is None for r in refs)
        shards += 1
        while shard:
            _, (words, stream) = shard.popitem()
            assert len(stream) and list(words)[:2] == [b"\n", b"some"]
            refs += [weakref.ref(words), weakref.ref(stream)]
            del words, stream
    assert shards == 4


def test_characters_of_repeated_words_count_as_often(spark):
    """Each different word of a row is cut up once; rows equal those of all characters."""
    texts = ["aa  bb aa\tAa x", "", None, "x", "İx été x x", "aa bb aa"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    want = sparse.hashed_rows(df, ["id"], sparse.char_terms(F.col("t")), 1 << 12)
    got = sparse.hashed_char_rows(df, ["id"], F.col("t"), 1 << 12)
    plain = lambda rows: sorted((r.id, r.slot, round(r.value, 12)) for r in rows.collect())
    assert plain(got) == plain(want) and got.select("id").distinct().count() == 4


def test_equal_contexts_are_hashed_once(spark):
    """The responses of a session have few different contexts."""
    named, rows = block_queries.context_bodies(spark, E.SMALL)
    assert rows.select("body_id").distinct().count() == named.select("body_id").distinct().count() < named.count()


def test_tf_idf_lists_are_the_rows(spark):
    """Lists by document hold what the long rows hold, in order of the slots, with all folds joined at once."""
    rows = spark.createDataFrame([(i % 5, i, t) for i, t in enumerate(["a b b", "a c", "a b d", "d d d", "zz", "b c a"])], "fold int, doc int, text string")
    counts = sparse.counted(rows, ["fold", "doc"], F.split("text", " "))
    words = sparse.vocabulary(counts, 3, 1, 5).where("eval_fold >= 0").localCheckpoint()
    want = {(r.eval_fold, r.doc, r.slot + 7): r.value for r in sparse.tf_idf_rows(counts.drop("fold"), words, ["doc"]).collect()}
    lists = sparse.tf_idf_lists(counts.drop("fold"), words, "doc", 7).collect()
    got = {(r.eval_fold, r.doc, e.slot): e.value for r in lists for e in r.entries}
    assert got == pytest.approx(want) and all([e.slot for e in r.entries] == sorted(e.slot for e in r.entries) for r in lists)


def test_pilot_encodes_its_sample_only(spark, tmp_path):
    """The encoders are made from the sample, with the vectors that encoding all responses gives."""
    rows = splits.group_folds(bindings.responses(spark, E.SMALL), "session_id").select("response_id", "session_id", "target", "fold")
    given = []
    stop = lambda sample: given.append({r.response_id for r in sample.collect()}) or {}
    with pytest.raises(expect.ExpectationFailed, match="no encoder a"):
        jobs.encoder_pilot(rows, stop, "a", "a", str(tmp_path), n=30)
    few = rows.where(F.col("response_id").isin(sorted(given[0])))
    plain = lambda of: {r.response_id: tuple(r.vector) for r in job_queries.projections(spark, E.SMALL, of)["projection_32"].collect()}
    every, got = plain(rows), plain(few)
    assert set(got) == given[0] and len(got) == 30 < len(every) and all(got[k] == pytest.approx(every[k], abs=1e-12) for k in got)


def test_words_are_counted_within_their_row(spark):
    """Counts by slot equal those of rows that are grouped; no list is null, none is shuffled to be made."""
    texts = ["b a b c", "", None, "a", "z y x w v u t s r q p z z z", "a a a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").withColumn("terms", F.filter(F.split(F.coalesce("t", F.lit("")), " "), lambda x: x != ""))
    lists = df.select("id", sparse.slot_counts(F.col("terms"), 5).alias("c"))
    got = lists.select("id", F.inline("c"))
    want = vectors.hashed_counts(df.select("id", F.explode("terms").alias("term")), ["id"], 5)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and lists.where("c is null").isEmpty()
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    value = {(r.id, r.slot): r.value for r in sparse.hashed_rows(df, ["id"], F.col("terms"), 5).collect()}
    moved = lists.select("id", F.inline(sparse.slot_values(F.col("c"), 0.5, 7))).collect()
    assert {(r.id, r.slot - 7): r.value / 0.5 for r in moved} == pytest.approx(value)


@pytest.mark.parametrize("name", ["role_field_hashes", "role_alignment", "view_blocks"])
def test_hashed_words_are_not_grouped_by_slot(spark, name):
    """No task sorts or aggregates a row for each word of its texts: what the objectives have is all that is grouped by bucket."""
    plan = E.queries()[name](spark, E.SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Aggregate [" in line and ("bucket" in line or "slot" in line or "md5" in line) and "objective_id" not in line for line in plan.splitlines()) == 0


def test_trees_are_fitted_on_all_training_rows(spark):
    """Whether a task fits a model or the cluster does: the same edges, sums and splits, of all rows."""
    rng = np.random.default_rng(5)
    noise, few, many = rng.normal(size=900), rng.integers(0, 9, 900), np.round(rng.normal(size=900), 2)
    rows = [(i, i // 2, i // 2 % 5, int(a + b > 3), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(noise, few, many, strict=True))]
    df = spark.createDataFrame(rows, "response_id long, session_id long, fold int, target int, a double, b double, c double")
    fits = lambda **how: sorted((r.model, r.response_id, r.p) for r in trees.trees_out_of_fold(df, ["a", "b", "c"], rounds=4, step=0.3, least=5, **how).collect())
    whole, in_step = fits(), fits(max_rows=100)
    assert in_step == whole and len(whole) == 1800
    x = np.stack([noise, few, many], axis=1)
    for fold in range(5):
        train = np.arange(900) // 2 % 5 != fold
        model = trees.fit(x[train], np.array([r[3] for r in rows], float)[train], 7, 4, 0.3, 5, 1.0)
        want = trees.predict(model, x[~train])
        assert [p for name, i, p in whole if name == "trees_7" and not train[i]] == pytest.approx(want, abs=1e-12)


def test_what_is_written_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(b.isShuffle() for b in (blocks.apply(i) for blocks in [disk.getAllBlocks()] for i in range(blocks.size())))
    for write in (common.materialize, sinks.materialize):
        df = spark.range(1000).selectExpr("id % 7 as k", "id").repartition(3, "id").groupBy("k").agg(F.max("id").alias("m"))
        before = held()
        got = write(df, "x")
        for _ in range(100):
            if held() <= before:
                break
            time.sleep(0.1)
        assert held() <= before and got.count() == 7 == df.count()


def test_tf_idf_models_write_no_vector_for_each_fold(spark):
    """Rows keep the numbers of their terms, once; a fold's weights are made where they are read."""
    said = ["a b b", "a c", "a b d", "d d d", "zz", "b c a", "a b", "c d"]
    rows = [(i, i % 8, i % 8 % 5, i % 8 % 2, said[i % 8], f"o{i % 3} a") for i in range(40)]
    df = spark.createDataFrame(rows, "response_id int, session_id int, fold int, target int, said string, asked string")
    texts = {"said": (F.split("said", " "), 4, 1, "session_id"), "asked": (F.split("asked", " "), 3, 2, None)}
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    assert models.tf_idf_out_of_fold(df, texts).count() == 40
    assert not [p for p in folder.iterdir() if p.name not in before and p.name.startswith(("vectors-", "features-"))]
    kept, places = models.tf_idf_documents(df, texts, 5, ["response_id", "fold"])
    want, offset = {}, 0
    for terms, size, least, doc in texts.values():
        docs = df.select("fold", F.col(doc or "response_id").alias("doc"), terms.alias("t")).dropDuplicates(["fold", "doc"])
        counts = sparse.counted(docs, ["fold", "doc"], F.col("t"))
        words = sparse.vocabulary(counts, size, least, 5).where("eval_fold >= 0").localCheckpoint()
        of = {(r.eval_fold, r.doc, r.slot): r.value for r in sparse.tf_idf_rows(counts.drop("fold"), words, ["doc"]).collect()}
        want |= {(f, r[0], slot + offset): v for r in rows for (f, d, slot), v in of.items() if d == r[1 if doc else 0]}
        offset += size
    got = {(f, r.response_id, int(i)): v for f in range(5) for r in sparse.weighed(kept, places, f).collect() for i, v in zip(r.features.indices, r.features.values, strict=True)}
    assert got == pytest.approx(want) and len(got) == len(want) > 300


def test_neighbours_are_merged_by_tiles_of_rows_asked(monkeypatch):
    """No merge holds more than a tile's rows, and tiles don't change what is found."""
    draw, sizes, init = np.random.default_rng(8), [], vectors._Nearest.__init__
    monkeypatch.setattr(vectors._Nearest, "__init__", lambda self, asked, *how: (sizes.append(len(asked)), init(self, asked, *how))[1])

    def batch(kind, n):
        lists = pa.array([[float(x) for x in draw.integers(-2, 3, 4)] for _ in range(n)], pa.list_(pa.float64()))
        zeros = pa.array(np.zeros(n))
        return pa.RecordBatch.from_arrays([pa.array(["b"] * n), pa.array([kind] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(draw.integers(0, 2, n).astype(float)), zeros, pa.array([1] * n, pa.int32()), lists], ["block", "kind", "id", "target", "os", "nth", "vector"])

    given = [batch(0, 30), batch(1, 70), batch(1, 50)]
    run = lambda: pa.Table.from_batches(vectors._nearest_sums({"a": (1, 9, 0.3, 2.0, 1.0), "b": (1, 4, 0.6, 2.0, 1.0)})(iter(given))).to_pylist()
    whole = run()
    sizes.clear()
    monkeypatch.setattr(vectors, "TILE_ASKED", 7)
    parts = run()
    assert max(sizes) == 7 and sum(sizes) == 60
    assert [(r["config"], r["response_id"]) for r in parts] == [(r["config"], r["response_id"]) for r in whole]
    assert [x for r in parts for x in (r["sw"], r["swy"])] == pytest.approx([x for r in whole for x in (r["sw"], r["swy"])])
