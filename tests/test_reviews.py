"""Intake, rosters, commit requests and scores on literal cases."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from quorum_spark.operators import detections as D
from quorum_spark.operators import intake as I
from quorum_spark.operators import ledger as L
from quorum_spark.operators import matching as M
from quorum_spark.operators import roster as R
from quorum_spark.operators import scoring as C
from quorum_spark.params import PipelineParams
from quorum_spark.sources import truth

P = PipelineParams()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def session(spark):
    make = lambda data, kind: spark.createDataFrame(data, kind)
    return {
        "sessions": make([(1, "awaiting_review", None), (2, "committed", "a"), (3, "processing", None)], "session_id int, status string, commit_request string"),
        "roster": make([(1, 10), (1, 11), (1, 12), (1, 13), (2, 20)], "session_id int, student_id int"),
        "bands": make([(1, 10, "confident", 0.9), (1, 12, "uncertain", 0.3), (1, 11, "confident", 0.8)], "session_id int, student_id int, decision string, similarity double"),
    }


def outcomes(spark, session, requests, decisions):
    asked = spark.createDataFrame(requests, "request_id string, session_id int")
    given = spark.createDataFrame(decisions, "request_id string, session_id int, student_id int, status string, source string, ordinal int")
    return R.commit_outcomes(asked, session["sessions"], session["roster"], session["bands"], given), given


def test_commit_outcomes_and_replay(spark, session):
    yes = lambda r, s, who: (r, s, who, "present", "teacher_confirmed", 1)
    requests = [("a", 2), ("b", 2), ("a", 9), ("a", 3), ("c", 1), ("d", 1), ("e", 1), ("f", 1)]
    decisions = [yes("d", 1, 12), ("d", 1, 11, "absent", "teacher_override", 1), ("d", 1, 11, "present", "teacher_override", 2), ("d", 1, 11, "absent", "teacher_override", 3), yes("e", 1, 12), yes("e", 1, 99), yes("f", 1, 12)]
    out, given = outcomes(spark, session, requests, decisions)
    assert {(r.request_id, r.session_id): r.outcome for r in out.collect()} == {
        ("a", 2): "idempotent_replay", ("b", 2): "already_committed", ("a", 9): "session_not_found", ("a", 3): "not_awaiting_review",
        ("c", 1): "needs_review_incomplete", ("d", 1): "committed", ("e", 1): "decision_for_unenrolled_student", ("f", 1): "already_committed",
    }
    made = R.committed_records(out, session["roster"], session["bands"], given)
    assert rows(made) == rows(spark.createDataFrame([("d", 1, 10, "present", "auto", 0.9), ("d", 1, 11, "absent", "teacher_override", None), ("d", 1, 12, "present", "teacher_confirmed", None), ("d", 1, 13, "absent", "auto", None)], made.schema))
    ledger = spark.createDataFrame([(1, 2, 20, "present", None), (2, 2, 20, "absent", 1)], "id int, session_id int, student_id int, status string, supersedes_id int")
    assert rows(R.replay_counts(out, ledger).select("session_id", "request_id", "total", "present", "absent")) == [(2, "a", 1, 0, 1)]


def test_automatic_decisions_are_refused(spark, session):
    out, given = outcomes(spark, session, [("d", 1)], [("d", 1, 12, "present", "auto", 1)])
    with pytest.raises(PySparkException):
        R.committed_records(out, session["roster"], session["bands"], given).collect()


def test_no_requests(spark, session):
    out, given = outcomes(spark, session, [], [])
    assert rows(out) == [] and rows(R.committed_records(out, session["roster"], session["bands"], given)) == []


def test_draft_roster_lists(spark):
    clusters = spark.createDataFrame([(1, 100, "/data/a.jpg"), (1, 101, "s3://b"), (1, 102, None)], "session_id int, cluster_id int, best_crop string")
    matches = spark.createDataFrame([(100, 10, 0.9, 0.1, "confident"), (101, 11, 0.3, None, "uncertain"), (102, None, None, None, "unmatched")], "cluster_id int, student_id int, similarity double, runner_up double, decision string")
    students = spark.createDataFrame([(k, f"n{k}", f"R{k}") for k in (10, 11, 12)], "student_id int, name string, roll_number string")
    roster = spark.createDataFrame([(1, 10), (1, 11), (1, 12)], "session_id int, student_id int")
    photos = spark.createDataFrame([(10, 0.5, "/data/x"), (10, 0.9, "/data/z"), (10, 0.9, "/data/y")], "student_id int, quality double, uri string")
    got = {(r.section, r.cluster_id): (r.student_id, r.crop_url, r.photo_url) for r in R.draft_roster(clusters, matches, students, roster, photos).collect()}
    assert got == {("confident", 100): (10, "/media/a.jpg", "/media/y"), ("needs_review", 101): (11, None, None), ("unrecognised", 102): (None, None, None), ("proposed_absent", None): (12, None, None)}


def test_courses_must_exist_and_preflight_json(spark):
    sessions, courses = spark.createDataFrame([(1, 5), (2, 6)], "session_id int, course int"), spark.createDataFrame([(5, "x")], "course int, name string")
    assert rows(R.with_course(sessions.where("course = 5"), courses).select("session_id", "name")) == [(1, "x")]
    with pytest.raises(PySparkException):
        R.with_course(sessions, courses).collect()
    jobs = spark.createDataFrame([(k, k) for k in range(5)], "job_id int, upload_id int")
    uploads = spark.createDataFrame([(0, '{"status":"pass"}'), (1, '{"status":"warn"}'), (2, "no json"), (3, None)], "upload_id int, preflight_json string")
    assert rows(R.preflight_warned(jobs, uploads)) == [(0, False), (1, True), (2, False), (3, False), (4, False)]


def test_biometric_deletion(spark):
    t = lambda data: spark.createDataFrame(data, "student_id int, x int")
    means = spark.createDataFrame([(1, [0.5]), (2, [0.6])], "student_id int, mean array<double>")
    vectors, photos, nulled, counts = R.delete_biometrics(spark.createDataFrame([(1,), (3,)], "student_id int"), t([(1, 1), (1, 2), (2, 3)]), t([(2, 1)]), means)
    assert (rows(vectors), rows(photos)) == ([(2, 3)], [(2, 1)])
    assert {r.student_id: r.mean for r in nulled.collect()} == {1: None, 2: [0.6]}
    assert rows(counts) == [(1, 2, 0), (3, 0, 0)]


def test_intake_literals(spark):
    box = lambda data: spark.createDataFrame(data, "x1 double, y1 double, x2 double, y2 double, score double, blur double, yaw double")
    got = rows(I.clipped(box([(400.0, 0.0, 500.0, 50.0, 0.9, 5.0, 1.0), (-3.7, 9.9, 10.9, 20.2, 0.9, 5.0, 1.0)]), 300, 300).select("x1", "y1", "x2", "y2", "valid", "score", "yaw"))
    assert got == [(0, 9, 10, 20, True, 0.9, 1.0), (300, 0, 300, 50, False, 0.0, 90.0)]
    names = spark.createDataFrame([("a.MP4",), ("b.mp4.exe",), ("c",), (None,)], "n string")
    assert [r[0] for r in names.select(I.allowed_extension(names.n)).collect()] == [True, False, False, False]
    v = spark.createDataFrame([(10, 9, 9), (400, 9, 9), (30, 3840, 1079), (20, 1080, 1080), (300, 1080, 4000)], "s int, w int, h int")
    assert [r[0] for r in v.select(I.video_error(v.s, v.w, v.h)).collect()] == ["video_too_short", "video_too_long", "resolution_too_low", None, None]
    chunks = spark.createDataFrame([(1, 1, 1, "b"), (1, 0, 2, "a"), (1, 1, 3, "B")], "upload_id int, chunk int, sent int, part string")
    assert rows(I.assembled(chunks)) == [(1, 2, ["a", "B"])]


def test_suppression_literal(spark):
    boxes = [(1, 1, 100.0, 100.0, 180.0, 180.0, 0.70), (1, 2, 104.0, 102.0, 183.0, 181.0, 0.91), (1, 3, 900.0, 900.0, 980.0, 980.0, 0.85), (2, 1, 5.0, 5.0, 5.0, 5.0, 0.9), (2, 2, 5.0, 5.0, 5.0, 5.0, 0.8)]
    frame = spark.createDataFrame(boxes, "frame_index int, ordinal long, x1 double, y1 double, x2 double, y2 double, score double")
    assert {r.frame_index: [k.score for k in r.kept] for r in D.suppress(frame, "frame_index", 0.4).collect()} == {1: [0.91, 0.85], 2: [0.9, 0.8]}
    assert D.suppress(frame.limit(0), "frame_index", 0.4).collect() == []


def test_empty_gallery_leaves_clusters_unmatched(spark):
    reps = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster_id int, representative array<double>")
    sims = M.similarities(reps, spark.createDataFrame([], "student_id int, mean array<double>"))
    got = M.decide(sims, sims, P, reps)
    assert rows(got) == [(0, None, None, None, "unmatched"), (1, None, None, None, "unmatched")]


def test_chains_and_scores(spark):
    records = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, None)], "id int, supersedes_id int")
    assert rows(L.chain_depths(records)) == [(4, 3), (9, 0)]
    with pytest.raises(ValueError):
        L.chain_depths(spark.createDataFrame([(1, 2), (2, 1)], "id int, supersedes_id int"))
    gallery = spark.createDataFrame([(1, 10), (1, 11)], "session_id int, student_id int")
    matches = spark.createDataFrame([(1, 10, "confident"), (1, 11, "uncertain"), (1, None, "confident")], "session_id int, student_id int, decision string")
    students = spark.createDataFrame([(10, "A"), (11, "B")], "student_id int, roll_number string")
    labels = spark.createDataFrame([(1, "A", False), (1, "B", True), (1, "Z", True)], "session_id int, roll_number string, actually_present boolean")
    scored, lost = C.mapped(C.on_truth(labels, C.predictions(gallery, matches), students))
    assert {(r.roll_number, r.kind) for r in C.failures(scored).collect()} == {("A", "FP"), ("B", "FN")}
    assert [r.roll_number for r in lost.collect()] == ["Z"]
    assert rows(C.predictions(gallery.limit(0), matches)) == []
    one = spark.createDataFrame([(3.0,), (3.0,), (None,)], "x double")
    assert [(r.bin, r.n) for r in C.range_histogram(one, "x").collect()] == [(5, 2)]


def test_files(spark, tmp_path):
    for name, x in (("a", [[1.0, 2.0], [3.0, 4.0]]), ("b", [[5.0, 6.0]])):
        np.save(tmp_path / f"{name}.npy", np.array(x, np.float32))
    got = {(r.path[-5:], r.row): list(r.v) for r in truth.read_npy(spark, f"{tmp_path}/*.npy").collect()}
    assert got == {("a.npy", 0): [1.0, 2.0], ("a.npy", 1): [3.0, 4.0], ("b.npy", 0): [5.0, 6.0]}
    assert {(r.path[-5:], r.frame_index) for r in truth.list_frames(spark, f"{tmp_path}/*.npy").collect()} == {("a.npy", 0), ("b.npy", 1)}
    (tmp_path / "labels.csv").write_text("cluster_id,roll_number\n1, R1\n2,\n")
    assert rows(truth.read_labels(spark, f"{tmp_path}/labels.csv", "cluster_id", "roll_number")) == [("1", "R1")]
    with pytest.raises(ValueError):
        truth.read_labels(spark, f"{tmp_path}/labels.csv", "det_id", "true_label")
    truth.write_sweep(spark.createDataFrame([(2, 0.5), (1, 0.7)], "threshold int, f1 double"), f"{tmp_path}/sweep", "threshold")
    assert [r.threshold for r in spark.read.csv(f"{tmp_path}/sweep", header=True).collect()] == ["1", "2"]
