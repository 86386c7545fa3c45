"""Literal cases and properties of the analytics operators."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quorum_spark.functions import geometry as G
from quorum_spark.operators import clustering as C
from quorum_spark.operators import detections as D
from quorum_spark.operators import evaluation as E
from quorum_spark.operators import ledger as L
from quorum_spark.operators import matching as M
from quorum_spark.params import PipelineParams, stage_hashes
from quorum_spark.plans import registry, scores
from quorum_spark.sources import truth


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def marks(*points):
    return [F.lit(float(x)) for x, _ in points], [F.lit(float(y)) for _, y in points]


@pytest.mark.parametrize(("nose", "eyes", "want"), [((50, 70), ((30, 50), (70, 50)), (0, 0)), ((60, 70), ((30, 50), (70, 50)), (16.25, 0)), ((50, 70), ((50, 50), (50, 50)), (90, 90))])
def test_pose(spark, nose, eyes, want):
    yaw, pitch = G.pose(*marks(*eyes, nose, (35, 90), (65, 90)))
    assert tuple(one(spark, yaw, pitch)) == pytest.approx(want)


def test_pose_bucket_and_overlap(spark):
    row = one(spark, *[G.pose_bucket(F.lit(y), 15.0).alias(f"c{i}") for i, y in enumerate((-40.0, -15.1, -14.9, 14.9, 15.1, 40.0))])
    assert list(row) == ["left", "left", "frontal", "frontal", "right", "right"]
    assert one(spark, G.shared_frames(*map(F.lit, (0, 20, 10, 30))))[0] == pytest.approx(11 / 21)


def test_first_failing_rule(spark):
    p = PipelineParams()
    f = lambda valid, s, w, b, y, pi, br: one(spark, G.reject_reason(F.lit(valid), *map(F.lit, (s, w, b, y, pi, br)), p))[0]
    assert f(True, 0.6, 50.0, 90.0, 35.0, -25.0, 215.0) is None
    assert f(False, 0.1, 1.0, 0.0, 90.0, 90.0, 0.0) == "invalid_crop"
    assert f(True, 0.59, 1.0, 0.0, 0.0, 0.0, 0.0) == "low_detector_score"
    assert f(True, 0.9, 49.0, 0.0, 0.0, 0.0, 100.0) == "too_small"
    assert f(True, 0.9, 60.0, 100.0, -36.0, 30.0, 100.0) == "yaw_too_extreme"
    assert one(spark, G.composite_quality(*map(F.lit, (150.0, 300.0, 0.0, 0.0)), p))[0] == pytest.approx(1.0)


def test_suppression(spark):
    rows = [(0, 0, 100.0, 100.0, 180.0, 180.0, 0.7), (0, 1, 104.0, 102.0, 183.0, 181.0, 0.91), (0, 2, 900.0, 900.0, 980.0, 980.0, 0.85), (0, 3, 5.0, 5.0, 5.0, 5.0, 0.1)]
    kept = D.suppress(spark.createDataFrame(rows, "f int, ordinal long, x1 double, y1 double, x2 double, y2 double, score double"), "f", 0.4).first().kept
    assert [k.score for k in kept] == [0.91, 0.85, 0.1]


def blobs(spark, n=12, dim=16):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(3):
        for k in range(n):
            v = np.eye(dim)[c] + rng.standard_normal(dim) * 0.05
            rows.append((c * 100 + k, c * 50 + k, 0.5, (v / np.linalg.norm(v)).tolist()))
    rows.append((999, 7, 0.5, np.eye(dim)[9].tolist()))
    return spark.createDataFrame(rows, "det_id long, frame_index int, quality_score double, v array<double>")


def test_clusters_of_blobs(spark):
    crops = blobs(spark)
    labels = C.dbscan(crops, 0.42, 3)
    got = {r.det_id: r.cluster_id for r in labels.collect()}
    assert got == {r.det_id: -1 if r.det_id == 999 else r.det_id // 100 for r in crops.collect()}
    summary = {r.cluster_id: r for r in C.summarize(crops, labels).collect()}
    assert {k: (r.member_count, r.first_frame, r.last_frame, r.best_det) for k, r in summary.items()} == {c: (12, c * 50, c * 50 + 11, c * 100) for c in range(3)}
    assert all(r.tightness > 0.9 and np.linalg.norm(r.representative) == pytest.approx(1) for r in summary.values())
    assert C.dbscan(crops.limit(0), 0.42, 3).collect() == []


def test_merge_and_split(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, -1)], "det_id long, cluster_id int")
    edges = spark.createDataFrame([(1, 2)], "a int, b int")
    assert {r.det_id: r.cluster_id for r in C.merged(labels, edges).collect()} == {1: 0, 2: 1, 3: 1, 4: -1}
    crops = blobs(spark).where("det_id < 200")
    whole = crops.select("det_id", F.lit(0).alias("cluster_id"))
    out = C.split(crops, whole, spark.createDataFrame([(0,)], "cluster_id int"), 0.3, 3)
    assert {(r.det_id // 100, r.cluster_id) for r in out.collect()} == {(0, 1), (1, 2)}


@pytest.mark.parametrize("shape", [(3, 3), (2, 4), (4, 2), (1, 3), (5, 5)])
def test_assignment_is_the_best(shape):
    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        m = rng.random(shape)
        pairs = M.solve(m)
        small, large = sorted(shape)
        assert len(pairs) == small == len({r for r, _ in pairs}) == len({c for _, c in pairs})
        t = m if shape[0] <= shape[1] else m.T
        best = max(sum(t[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(large), small))
        assert sum(m[r, c] for r, c in pairs) == pytest.approx(best)


@pytest.mark.parametrize(("s", "r", "want"), [(0.5, 0.375, "confident"), (0.5, 0.4375, "uncertain"), (0.25, None, "uncertain"), (0.1875, None, "unmatched")])
def test_bands(spark, s, r, want):
    p = PipelineParams(match_threshold=0.5, match_margin=0.125, match_band=0.25)
    assert one(spark, M.band(F.lit(s), F.lit(r).cast("double"), p))[0] == want


def test_session_summary(spark):
    d = spark.createDataFrame([(0, 1, 0.9, "confident"), (1, 2, 0.4, "uncertain"), (2, None, 0.1, "unmatched")], "cluster_id int, student_id int, similarity double, decision string")
    r = M.session_summary(d, spark.createDataFrame([(1,), (2,), (3,)], "student_id int"), False, PipelineParams()).first()
    assert (r.present, r.review, r.absent, r.unrecognised, r.health) == (1, 1, 1, 1, "fair")


def test_commit_and_chain(spark):
    roster = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "student_id int")
    given = spark.createDataFrame([(2, "absent", "teacher_override"), (3, "present", "teacher_confirmed")], "student_id int, status string, source string")
    sure = spark.createDataFrame([(1, 0.9), (2, 0.8)], "student_id int, similarity double")
    rows = {r.student_id: (r.status, r.source, r.confidence) for r in L.commit(roster, given, sure, 7).collect()}
    assert rows == {1: ("present", "auto", 0.9), 2: ("absent", "teacher_override", None), 3: ("present", "teacher_confirmed", None), 4: ("absent", "auto", None)}
    chain = spark.createDataFrame([(1, 1, 5, "present", None), (2, 1, 5, "absent", 1), (3, 1, 5, "present", 2), (4, 1, 5, "absent", 3)], "id long, class_session_id long, student_id long, status string, supersedes_id long")
    assert [r.id for r in L.current(chain).collect()] == [4]
    asked = spark.createDataFrame([(9, 1, 5, "present"), (10, 1, 6, "present")], "id long, class_session_id long, student_id long, status string")
    assert [(r.id, r.supersedes_id) for r in L.correct(chain, asked).collect()] == [(9, 4)]


def test_chunks(spark):
    up = spark.createDataFrame([(1, 12_000_000, 5 << 20), (2, 15_000_000, 5 << 20), (3, 0, 5)], "upload_id long, total_bytes long, chunk_bytes long")
    got = spark.createDataFrame([(2, 0), (2, 1), (2, 1)], "upload_id long, chunk long")
    assert {tuple(r) for r in L.missing_chunks(up, got).collect()} == {(1, 0), (1, 1), (1, 2), (2, 2)}


def test_metrics(spark):
    rows = spark.createDataFrame([(True, True, "a"), (True, False, "a"), (False, True, "b"), (False, False, None)], "actual boolean, predicted boolean, s string")
    r = E.metrics(rows.agg(*E.confusion(F.col("actual"), F.col("predicted")))).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.accuracy) == (1, 1, 1, 1, 0.5)
    assert {x.value: x.recall for x in E.stratified(rows, ["s"]).collect()} == {"a": 0.5, "b": 0.0}
    q = E.clustering_quality(spark.createDataFrame([(0, "R1"), (1, "R1"), (1, "R2"), (2, "R3")], "cluster_id int, person string")).first()
    assert (q.over_split_rate, q.merge_rate) == (pytest.approx(1 / 3), pytest.approx(1 / 3))


def test_truth_round_trip(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "truth.csv").write_text("roll_number,actually_present,row_number,seat_position,wears_glasses,notes\n007, Yes ,1,left,0,\n008,no,x,right,1,n\n")
    rows = {r.roll_number: r for r in truth.read_truth(spark, str(tmp_path)).collect()}
    assert (rows["007"].actually_present, rows["007"].session_id, rows["008"].row_number) == (True, "s1", None)
    v = spark.createDataFrame([([1.0, -2.5],), (None,)], "v array<float>")
    assert [r[0] for r in v.select(truth.decode_vector(truth.encode_vector("v"))).collect()] == [[1.0, -2.5], None]


def test_hashes_chain():
    a, b = stage_hashes(PipelineParams()), stage_hashes(PipelineParams(eps=0.5))
    assert [a[k] == b[k] for k in a] == [True, True, True, False, False]


def test_samples_are_spread_over_the_whole_table(spark, tmp_path):
    for n in (25_000, 100, 5, 0):
        spark.range(n).selectExpr("id * 3 + 7 as event_id", "'click' as event_type").repartition(5).write.parquet(f"{tmp_path}/{n}/events.parquet")
        got = sorted(r.event_id for r in registry.linspace_sample(spark, f"{tmp_path}/{n}").collect())
        assert got == sorted({i * (n - 1) // 17 * 3 + 7 for i in range(18)} if n else [])


def test_every_upload_and_current_record_is_asked(spark, tmp_path):
    orders = [(k, k % 7, "FPO"[k % 3], 20000.0 * (k % 4)) for k in range(1, 120)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, n) for k in range(1, 120) for n in (1, 1, 9)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(k, c) for k, *_, price in orders for c in range(int(price // 20000)) if c != 1}
    assert sorted(map(tuple, registry.missing_chunks(spark, str(tmp_path)).collect())) == sorted(want)
    last = {student: (k, status) for k, student, status, _ in orders}
    want = {(k + 10_000_000, student, k) for student, (k, status) in last.items() if status != "F"}
    assert {(r.id, r.student_id, r.supersedes_id) for r in registry.corrections(spark, str(tmp_path)).collect()} == want


def test_all_boxes_of_a_frame_are_compared(spark, tmp_path):
    rows = [(o, p, s, n, 10.0) for o, p, s, n in [(1, 5, 1, 1), (1, 5, 2, 1), (1, 5, 1, 3), (2, 5, 1, 2), (9, 5, 1, 1), (9, 6, 1, 1), (9, 605, 1, 2)]]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.frame_index, r.i, r.j): (r.l_orderkey, r.l_partkey, r.o2, r.p2, r.iou) for r in registry.iou_pairs(spark, str(tmp_path)).collect()}
    assert got == {(0, 1, 2): (1, 5, 1, 5, 1.0), (0, 1, 4): (1, 5, 2, 5, 1.0), (0, 2, 4): (1, 5, 2, 5, 1.0), (1, 1, 3): (9, 5, 9, 605, 1.0)}


def test_all_courses_are_committed(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 8), (5, 9)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(10, 1, "F", 200000.0), (11, 2, "P", 100000.0), (12, 3, "F", 100000.0), (13, 3, "P", 200000.0), (14, 5, "F", 300000.0)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    get = lambda f: {tuple(r) for r in f(spark, str(tmp_path)).collect()}
    auto, yes, no = "auto", ("present", "teacher_confirmed", None, 42), ("absent", "teacher_override", None, 42)
    assert get(registry.commit_fanout) == {(7, 1, "present", auto, 0.2, None), (7, 2, *no), (8, 3, *yes), (8, 4, "absent", auto, None, None), (9, 5, "present", auto, 0.3, None)}
    assert get(registry.commit_counts) == {(7, 2, 1, 1, 1, 0, 1), (8, 2, 1, 1, 1, 1, 0), (9, 1, 1, 0, 1, 0, 0)}
    assert get(registry.missing_review) == {(7, 1), (9, 5)}
    assert get(registry.unenrolled_decisions) == {(8, 2, "absent"), (9, 2, "absent"), (7, 3, "present"), (9, 3, "present")}
    assert get(registry.absent_list) == {(7, 2), (8, 4)}


def test_similarities_of_all_pairs_of_labels(spark, tmp_path):
    """100 labels have 4,950 pairs, and the overlap is that of all, as in the queries' SQL. Label 0 has a vector twice and its opposite, so within labels similarity goes from -1 to 1."""
    x = np.random.default_rng(9).standard_normal((100, 16))
    vectors = [*x, x[0], -x[0]]
    labels = [*range(100), 0, 0]
    data = [(k, v.tolist(), label) for k, (v, label) in enumerate(zip(vectors, labels, strict=True))]
    spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    x /= np.linalg.norm(x, axis=1)[:, None]
    i, j = np.triu_indices(100, 1)
    s = (x @ x.T)[i, j]
    (r,) = scores.similarity_overlap(spark, str(tmp_path)).collect()
    assert (r.low, r.high) == pytest.approx((s.min(), s.max()), abs=1e-6)
    got = {(r.i, r.j): r.similarity for r in scores.between_similarity(spark, str(tmp_path)).collect()}
    assert got == pytest.approx(dict(zip(zip(i.tolist(), j.tolist(), strict=True), s, strict=True)), abs=1e-6)


def test_contract():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) >= 58


def test_frames_side_by_side_keep_what_each_keeps_alone():
    from quorum_spark.operators.detections import SHORT, _kept, _kept_of_frames

    rng = np.random.default_rng(5)
    lens = np.array([0, 1, 7, SHORT + 30, 0, 33, 2, 7, 40])
    at = np.concatenate([[0], np.cumsum(lens)])
    x1, y1 = rng.integers(0, 60, (2, at[-1])).astype(float)
    x2, y2 = x1 + rng.integers(0, 40, at[-1]), y1 + rng.integers(0, 40, at[-1])
    got = _kept_of_frames(at, x1, y1, x2, y2, 0.4)
    for a, b in zip(at[:-1], at[1:]):
        assert got[a:b].tolist() == _kept(x1[a:b], y1[a:b], x2[a:b], y2[a:b], 0.4).tolist()
    assert not got.all()


def test_records_at_their_end_leave_the_rounds(spark, monkeypatch):
    """Of many short chains and one long one, only what is still open is joined and written again."""
    written, cut = [], L.Scratch.cut

    def count(self, df, *a, **k):
        out = cut(self, df, *a, **k)
        written.append(out.count())
        return out

    monkeypatch.setattr(L.Scratch, "cut", count)
    rows = [(i, None) for i in range(500)] + [(1000 + i, 999 + i if i else 0) for i in range(9)]
    got = {r.id: r.depth for r in L.chain_depths(spark.createDataFrame(rows, "id long, supersedes_id long")).collect()}
    assert got == {**{i: 0 for i in range(1, 500)}, 1008: 9}
    assert written[0] == 509 and max(written[1:]) <= 9
