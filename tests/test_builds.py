"""Builds from files: what is read again, what is kept, what is refused."""

import os
import re

import pytest

from convolytics.operators import builds, jobs
from convolytics.operators.expect import ExpectationFailed
from convolytics.sources import files

HEADER = "session_id,utterance_id,role,content,timestamp\n"


def put(folder, name, lines, session=None):
    rows = [f'{session or name},{i},{role},"{text}",{time}\n' for i, role, text, time in lines]
    (folder / f"{name}.csv").write_text(HEADER + "".join(rows), encoding="utf-8")


def talk(*texts):
    return [(i, "tutor" if i % 2 else "student", t, f"00:00:{i:02d}") for i, t in enumerate(texts)]


@pytest.fixture
def project(spark, tmp_path):
    folder = tmp_path / "transcripts"
    folder.mkdir()
    for i in range(10):
        put(folder, f"s{i}", talk("hi", "yes, two\nlines", f"{i}"))
    rows = [(i, f"s{i % 10}", f"o{i % 3}", "adding", i % 2) for i in range(40)]
    return folder, spark.createDataFrame(rows, "response_id int, session_id string, objective_id string, objective string, target int"), str(tmp_path / "out")


def sizes(spark, out):
    return {r.session_id: (r.n_utterances, r.build) for r in builds.table(spark, out, "session_features").collect()}


def test_a_changed_file_rebuilds_one_session(spark, project):
    folder, responses, out = project
    assert builds.foundation_from_files(spark, str(folder), responses, out) == 1
    put(folder, "s3", talk("hi", "a", "b", "c"))
    os.utime(folder / "s4.csv", (1, 1))  # another time, the same content
    assert builds.foundation_from_files(spark, str(folder), responses, out) == 2
    read = spark.read.parquet(f"{out}/utterances").where("build = 2")
    assert {r.session_id for r in read.collect()} == {"s3"} and read.count() == 4
    assert sizes(spark, out) == {f"s{i}": (4, 2) if i == 3 else (3, 1) for i in range(10)}
    report = builds.table(spark, out, "report").first()
    assert (report.files, report.files_read, report.files_kept, report.responses) == (10, 1, 9, 40)
    assert builds.table(spark, out, "report", 1).first().digest != report.digest
    assert builds.table(spark, out, "modeling_base").where("session_id = 's3' and n_utterances = 4").count() == 4
    assert {r.session_id: r.full_text for r in builds.table(spark, out, "session_texts").collect()}["s3"].endswith("c")


def test_tables_pass_the_verification(spark, project):
    folder, responses, out = project
    builds.foundation_from_files(spark, str(folder), responses, out)
    tables = builds.tables(spark, out)
    assert set(tables) == set(jobs.FOUNDATION)
    assert jobs.verification(tables, jobs.table_sizes(tables)).where("violations > 0 and rule <> 'folds'").count() == 0


def test_a_lost_file_loses_its_session(spark, project):
    folder, responses, out = project
    builds.foundation_from_files(spark, str(folder), responses, out)
    (folder / "s9.csv").unlink()
    with pytest.raises(ExpectationFailed, match="sessions: 4"):
        builds.foundation_from_files(spark, str(folder), responses, out)
    assert len(sizes(spark, out)) == 10  # the refused build left nothing
    builds.foundation_from_files(spark, str(folder), responses.where("session_id <> 's9'"), out)
    assert set(sizes(spark, out)) == {f"s{i}" for i in range(9)}
    assert len(builds.table(spark, out, "utterances", 1).select("session_id").distinct().collect()) == 10


def test_a_file_is_parsed_once_in_a_build(spark, project, monkeypatch):
    folder, responses, out = project
    (folder / "deep").mkdir()
    put(folder / "deep", "s10", talk("hi"))
    transcripts, parsed = files.transcripts, spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            parsed.add(b.num_rows)
            yield b

    def read(*args, **kwargs):
        rows = transcripts(*args, **kwargs)
        return rows.mapInArrow(counted, rows.schema)

    monkeypatch.setattr(files, "transcripts", read)
    listed = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    builds.foundation_from_files(spark, str(folder), responses, out)
    assert parsed.value == 31 and sizes(spark, out)["s10"] == (1, 1)
    put(folder, "s3", talk("hi", "a"))
    builds.foundation_from_files(spark, str(folder), responses, out)
    assert parsed.value == 33
    builds.foundation_from_files(spark, str(folder), responses, out)
    assert parsed.value == 33 and sizes(spark, out)["s3"] == (2, 2)
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == listed


def test_transcripts_are_written_by_several_tasks(spark):
    from convolytics.plans import job_queries

    job_queries.QUERIES["foundation_files"](spark, "/root/testdata/sf0.001")
    written = [str(f.input_file_name) for f in spark.read.text(spark.conf.get("spark.checkpoint.dir") + "/transcripts-*/of=*/").selectExpr("input_file_name() AS input_file_name").distinct().collect()]
    assert len(written) % 20 == 0 and len({re.search(r"part-(\d+)", f)[1] for f in written}) > 1


def test_a_build_that_breaks_off_is_done_again(spark, project, monkeypatch):
    folder, responses, out = project
    builds.foundation_from_files(spark, str(folder), responses, out)
    put(folder, "s3", talk("hi"))
    with monkeypatch.context() as m:
        m.setattr(builds.sessions, "modeling_base", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            builds.foundation_from_files(spark, str(folder), responses, out)
    assert sizes(spark, out)["s3"] == (3, 1)
    put(folder, "s3", talk("hi", "a", "b"))
    put(folder, "s5", talk("a"))
    assert builds.foundation_from_files(spark, str(folder), responses, out) == 2
    assert sizes(spark, out)["s5"] == (1, 2) and sizes(spark, out)["s3"] == (3, 2)


@pytest.mark.parametrize(
    ("name", "lines", "session", "said"),
    [
        ("empty", [], None, "empty file: 1"),
        ("s1", talk("a"), "s2", "named by file: 1"),
        ("s1", talk("a", "b")[1:], None, "contiguous: 1"),
        ("s1", [(0, "tutor", "a", "00:00:09"), (1, "tutor", "b", "00:00:01")], None, "time order: 1"),
        ("s1", [(0, "tutor", "a", "later")], None, "time: 1"),
    ],
)
def test_files_that_break_a_rule_are_refused(spark, project, name, lines, session, said):
    folder, responses, out = project
    put(folder, name, lines, session)
    with pytest.raises(ExpectationFailed, match=said):
        builds.foundation_from_files(spark, str(folder), responses, out)


def test_no_files_are_refused(spark, project, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(ExpectationFailed, match="no files"):
        builds.foundation_from_files(spark, str(tmp_path / "none"), project[1], project[2])


def test_what_is_written_is_read(spark, tmp_path):
    texts = [' a "b", c ', "", None, "x\r\ny\nz", "\\", '"', "\\\"", ","]
    rows = [("s", i, "tutor", t, "00:00:01") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, files.TRANSCRIPT).coalesce(1).write.options(**files.WRITTEN).csv(str(tmp_path / "t"))
    assert [r.content for r in files.transcripts(spark, str(tmp_path / "t")).orderBy("utterance_id").collect()] == [t or None for t in texts]


def test_categories_and_the_digest_of_parts(spark):
    listed = spark.createDataFrame([("/x/labels.csv", 1, "h1"), ("/x/t/s1.csv", 2, "h2")], "path string, bytes long, sha256 string")
    kinds = {"labels": r"labels\.csv$", "transcript": r"/t/"}
    assert [r.category for r in files.with_category(listed, kinds).orderBy("path").collect()] == ["labels", "transcript"]
    with pytest.raises(Exception, match="no category for"):
        files.with_category(listed, {"labels": "labels"}).collect()
    one = files.manifest_tree_digest(listed).first().digest
    assert one == files.manifest_tree_digest(listed.orderBy("bytes")).first().digest
    assert one != files.manifest_tree_digest(listed.limit(1)).first().digest
