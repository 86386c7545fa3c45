"""Sessions as keys, metric blocks, products, samples of pairs, stage stores, deletions in files, streams, alignment and preflight."""

import itertools
import json
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quorum_spark.operators import alignment, clustering, ledger, metric, preflight, products, scoring, sessions
from quorum_spark.operators import intake as I
from quorum_spark.operators import roster as R
from quorum_spark.operators.scratch import Scratch
from quorum_spark.params import PipelineParams
from quorum_spark.sources import stages, truth
from quorum_spark.sources.erase import ErasableTable, erase_student
from quorum_spark.streaming.requests import CommitStream

P = PipelineParams(match_threshold=0.5, match_margin=0.1, match_band=0.2)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def unit(x):
    x = np.asarray(x, float)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def crowd(n, dim=6, groups=25, noise=0.15, seed=1):
    rng = np.random.default_rng(seed)
    return unit(unit(rng.standard_normal((groups, dim)))[rng.integers(0, groups, n)] + noise * rng.standard_normal((n, dim)))


def brute_dbscan(x, eps, m):
    near = 1 - x @ x.T <= eps
    core = near.sum(1) >= m
    root = np.arange(len(x))
    while True:
        new = np.where(core, np.minimum(root, np.where(near & core, root, len(x)).min(1)), root)
        if (new == root).all():
            break
        root = new
    number = {r: k for k, r in enumerate(sorted(set(root[core])))}
    label = np.array([number[r] if c else -1 for r, c in zip(root, core, strict=True)])
    border = np.where(near & core, label, len(x)).min(1)
    return np.where(core, label, np.where(border < len(x), border, -1)), core


def test_clusters_across_tiles(spark, monkeypatch):
    """Labels are those of all pairs where many tiles share a cluster, crops are core only by neighbours of other tiles, and borders lie between tiles."""
    for name, n in (("BLOCK", 20), ("FEW", 0), ("TILE", 60), ("SIDE", 100)):
        monkeypatch.setattr(metric, name, n)
    sent = []
    monkeypatch.setattr(metric, "block_pairs", lambda *a: sent.append(a))
    for x, eps, m in ((crowd(300, groups=12), 0.03, 6), (crowd(250, noise=0.6, seed=2), 0.08, 3)):
        crops = spark.createDataFrame([(k, k % 2, v.tolist()) for k, v in enumerate(x)] + [(len(x), 0, None)], "det_id long, job int, v array<double>")
        label, core = brute_dbscan(x, eps, m)
        assert len(set(label.tolist())) > 2 and (~core & (label >= 0)).any()
        got = {r.det_id: (r.cluster_id, r.core) for r in clustering.dbscan(crops, eps, m).collect()}
        assert [got[k] for k in range(len(x))] == list(zip(label.tolist(), core.tolist(), strict=True))
        assert got[len(x)] == (-1, False)
        by_job = {r.det_id: r.cluster_id for r in clustering.dbscan(crops, eps, m, ("job",)).collect()}
        for job in range(2):
            assert [by_job[k] for k in range(job, len(x), 2)] == brute_dbscan(x[job::2], eps, m)[0].tolist()
    assert not sent  # no pair of blocks is sent


def test_vectors_are_sent_once_and_a_job_is_spread(spark, monkeypatch):
    """Where one table fits a side, the other is sent once, whatever the tasks; tiles and packs of one job aren't left to one task."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(rng.standard_normal((3000, 16)))], "det_id long, job int, v array<double>")
    scratch = Scratch(spark, "test")
    try:
        for n, x in zip(names, ("40k", "false"), strict=True):
            spark.conf.set(n, x)
        monkeypatch.setattr(metric, "BLOCK", 50)
        monkeypatch.setattr(metric, "TILE", 100)
        blocks = metric.dealt(rows, scratch, ("job",))

        def seen(a, b):
            yield pa.RecordBatch.from_arrays([pa.array([len(a.ids)]), pa.array([len(b.ids)])], names=["a", "b"])

        def where(x, tile, alone):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([len(x.ids)])], names=["task", "n"])

        sent = metric.rectangles(blocks, blocks, seen, "a long, b long", ("job",)).collect()
        assert sum(r.b for r in sent) == 3000
        tiles = metric.in_tiles(blocks, where, "task long, n long", ("job",)).collect()
        assert sum(r.n for r in tiles) == 3000 and len({r.task for r in tiles}) > 1
    finally:
        for n, x in zip(names, before, strict=True):
            spark.conf.set(n, x)


def test_links_of_many_hits():
    """Marks that hits tie are each told once, also where nearly all crops are near each other, and not with themselves."""
    rng = np.random.default_rng(3)
    for share in (0.0, 0.01, 0.9, 1.0):
        for marks in (1, 4, 60):
            hit, mine, other = rng.random((50, 70)) < share, rng.integers(0, marks, 50), rng.integers(0, marks, 70)
            got = list(zip(*(x.tolist() for x in clustering._met(hit, mine, other)), strict=True))
            assert sorted(got) == sorted({(int(mine[p]), int(other[q])) for p, q in zip(*np.nonzero(hit), strict=True)} - {(k, k) for k in range(marks)})
    assert all(len(x) == 0 for x in clustering._met(np.zeros((0, 5), bool), np.zeros(0, int), np.zeros(5, int)))
    assert all(len(x) == 0 for x in clustering._met(np.zeros((5, 0), bool), np.zeros(5, int), np.zeros(0, int)))


def test_pairs_across_sides(spark, monkeypatch):
    """All pairs of a radius, each once, within jobs or over all, and no pair of blocks is sent."""
    for name, n in (("BLOCK", 20), ("FEW", 0), ("LISTED", 80)):
        monkeypatch.setattr(metric, name, n)
    monkeypatch.setattr(metric, "between", None)
    x = crowd(300)
    crops = spark.createDataFrame([(k, k % 2, v.tolist()) for k, v in enumerate(x)], "det_id long, job int, v array<double>")
    i, j = np.nonzero(np.triu(1 - x @ x.T <= 0.03, 1))
    want = sorted(zip(i.tolist(), j.tolist(), strict=True))
    assert sorted((r.i, r.j) for r in clustering.eps_pairs(crops, 0.03).collect()) == want
    assert sorted((r.i, r.j) for r in clustering.eps_pairs(crops, 0.03, ("job",)).collect()) == [(a, b) for a, b in want if a % 2 == b % 2]


def test_extremes_of_within_pairs(spark, monkeypatch):
    """They are those of all pairs, whatever blocks and sides the vectors are dealt to; nulls and single vectors make no pair."""
    monkeypatch.setattr(metric, "BLOCK", 20)
    monkeypatch.setattr(metric, "SIDE", 50)
    x = 3 * crowd(300, noise=0.5)
    data = [(k, k % 3, v.tolist()) for k, v in enumerate(x)] + [(900, None, [1.0] * 6), (901, 1, None), (902, 8, [1.0] * 6)]
    people = spark.createDataFrame(data, "det_id long, label int, v array<double>")
    got = {r[0]: r[1:] for r in scoring.within_extremes(people, "label", "det_id").groupBy("label").agg(F.min("similarity"), F.max("similarity")).collect()}
    want = {r[0]: r[1:] for r in scoring.within_pairs(people, "label", "det_id").groupBy("label").agg(F.min("similarity"), F.max("similarity")).collect()}
    assert set(got) == {0, 1, 2} and all(got[k] == pytest.approx(want[k]) for k in got)


def test_clusters_from_balls(spark, monkeypatch):
    """Labels are those of all pairs, whatever is skipped, and balls do skip."""
    monkeypatch.setattr(metric, "BLOCK", 40)
    monkeypatch.setattr(metric, "FEW", 0)
    x = crowd(900)
    crops = spark.createDataFrame([(k, k % 3, v.tolist()) for k, v in enumerate(x)], "det_id long, job int, v array<double>")
    want, core = brute_dbscan(x, 0.02, 4)
    got = {r.det_id: (r.cluster_id, r.core) for r in clustering.dbscan(crops, 0.02, 4).collect()}
    assert got == {k: (want[k], core[k]) for k in range(900)}
    by_job = {r.det_id: r.cluster_id for r in clustering.dbscan(crops, 0.03, 4, ("job",)).collect()}
    for job in range(3):
        assert [by_job[k] for k in range(job, 900, 3)] == brute_dbscan(x[job::3], 0.03, 4)[0].tolist()
    d = 1 - x @ x.T
    pairs = {(r.i, r.j) for r in clustering.eps_pairs(crops, 0.02).collect()}
    assert pairs == {(i, j) for i, j in zip(*np.nonzero(np.triu(d <= 0.02, 1)), strict=True)}
    scratch = Scratch(spark, "test")
    told = metric.block_pairs(metric.balls(crops, scratch), 0.02).agg(F.count("*"), F.count_if(F.col("skipped"))).first()
    assert told[1] > 0.4 * told[0]


def test_clusters_of_nothing_and_of_copies(spark):
    none = spark.createDataFrame([], "det_id long, v array<double>")
    assert clustering.dbscan(none, 0.3, 2).collect() == [] and clustering.eps_pairs(none, 0.3).collect() == []
    same = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(700)], "det_id long, v array<double>")
    assert {r.cluster_id for r in clustering.dbscan(same, 0.1, 3).collect()} == {0}


def test_merge_and_split_by_session(spark):
    """Merging and splitting keep to a session, and number its clusters anew."""
    e = np.eye(8)
    rows_, frames = [], {0: 0, 1: 5}
    for job in (1, 2):
        for c in (0, 1):
            for k in range(4):
                v = unit(e[c] * (0.95 if c else 1) + (e[0] * 0.9 if c and job == 1 else 0) + 0.01 * e[4 + k])
                rows_.append((job * 1000 + c * 100 + k, job, frames[c] + k * 2, 0.5, v.tolist(), c))
    crops = spark.createDataFrame(rows_, "det_id long, job int, frame_index int, quality_score double, v array<double>, label int")
    labels = crops.select("job", "det_id", F.col("label").alias("cluster_id"))
    summary = clustering.summarize(crops, labels, ("job",))
    edges = clustering.merge_edges(summary, 0.5, 0.2, ("job",))
    assert {(r.job, r.a, r.b) for r in edges.collect()} == {(1, 0, 1)}
    one = clustering.merged(labels, edges, ("job",))
    assert {(r.job, r.det_id // 100 % 10, r.cluster_id) for r in one.collect()} == {(1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 1, 1)}
    mixed = crops.select("job", "det_id", F.lit(0).alias("cluster_id"))
    frames = crops.groupBy("job").agg((F.max("frame_index") + 1).alias("total"))
    loose = clustering.split_candidates(clustering.summarize(crops, mixed, ("job",)), frames, 0.6, 0.6, ("job",))
    assert {r.job for r in loose.collect()} == {2}
    out = clustering.split(crops, mixed, loose, 0.1, 3, ("job",))
    assert {(r.job, r.det_id // 100 % 10, r.cluster_id) for r in out.collect()} == {(1, 0, 0), (1, 1, 0), (2, 0, 1), (2, 1, 2)}


def test_sessions_are_matched_one_to_one(spark):
    rng = np.random.default_rng(3)
    reps, gallery = [], []
    sizes = {1: (4, 3), 2: (2, 5), 3: (3, 0), 5: (1, 1)}
    for job, (n, m) in sizes.items():
        reps += [(job, k, unit(rng.standard_normal(4)).tolist()) for k in range(n)]
        gallery += [(job, 10 + k, unit(rng.standard_normal(4)).tolist()) for k in range(m)]
    gallery.append((9, 10, [1.0, 0.0, 0.0, 0.0]))
    summary = spark.createDataFrame(reps, "job int, cluster_id int, representative array<double>")
    students = spark.createDataFrame(gallery, "job int, student_id long, mean array<double>")
    got = sessions.matched(summary, students, PipelineParams(match_threshold=-2.0, match_margin=-9.0, match_band=0.1), ("job",)).collect()
    assert len(got) == len(reps)
    for job, (n, m) in sizes.items():
        own = {r.cluster_id: r for r in got if r.job == job}
        used = [r.student_id for r in own.values() if r.student_id is not None]
        assert len(used) == len(set(used)) == min(n, m)
        s = np.array([r[2] for r in reps if r[0] == job]) @ np.array([g[2] for g in gallery if g[0] == job]).reshape(m, 4).T
        t = s if n <= m else s.T
        best = max((sum(t[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(t.shape[1]), t.shape[0])), default=0)
        assert sum(r.similarity for r in own.values() if r.similarity is not None) == pytest.approx(best)
        for k, r in own.items():
            if r.student_id is None:
                assert (r.similarity, r.runner_up, r.decision) == (None, None, "unmatched")
            elif m > 1:
                assert r.runner_up == pytest.approx(max(s[k, c] for c in range(m) if c + 10 != r.student_id))


def test_session_summaries(spark):
    d = spark.createDataFrame([(1, 0, 1, 0.9, "confident"), (1, 1, 2, 0.4, "uncertain"), (1, 2, None, 0.1, "unmatched"), (3, 0, None, None, "unmatched")], "job int, cluster_id int, student_id int, similarity double, decision string")
    roster = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "job int, student_id int")
    warned = spark.createDataFrame([(1, True)], "job int, warned boolean")
    got = {r.job: r for r in sessions.summaries(d, roster, PipelineParams(), ("job",), warned).collect()}
    assert [(got[1][c]) for c in ("enrolled", "present", "review", "absent", "unrecognised", "health")] == [3, 1, 1, 1, 1, "poor"]
    assert (got[2].enrolled, got[2].absent, got[2].coverage, got[2].health) == (1, 1, 0.0, "poor")
    assert (got[3].enrolled, got[3].unrecognised, got[3].mean_similarity) == (0, 1, None)
    twice = d.union(spark.createDataFrame([(1, 5, 1, 0.4, "uncertain")], d.schema))
    with pytest.raises(PySparkException):
        sessions.summaries(twice, roster, PipelineParams(), ("job",)).collect()


def vectors(spark, x, name="id"):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], f"{name} long, v array<double>")


def test_products(spark, monkeypatch):
    monkeypatch.setattr(products, "BLOCK", 30)
    x, y = crowd(150, seed=5), crowd(70, seed=6)
    x[3], y[5] = 0, 0
    a, b, s = vectors(spark, x), vectors(spark, y), x @ y.T
    mean, values = products.product_quantiles(a, b, [0, 0.05, 0.5, 0.95, 1])
    assert mean == pytest.approx(s.mean())
    assert values == pytest.approx(np.quantile(s.ravel(), [0, 0.05, 0.5, 0.95, 1]), abs=1e-12)
    got = {r.bin: r.n for r in products.product_histogram(a, b, -1.0, 1.0, 20, 9).collect()}
    n, _ = np.histogram(np.round(s.ravel(), 9), 20, (-1, 1))
    assert got == {k: v for k, v in enumerate(n) if v}
    assert products.product_quantiles(a, b.limit(0), [0.5]) == (None, [None])
    assert products.all_products(a, b).count() == 150 * 70


def test_pairs_of_many_keys(spark):
    """Every pair of 1500 keys, and samples of different ones, the same for a seed."""
    x = crowd(1500, seed=7)
    people = spark.createDataFrame([(int(k), v.tolist()) for k, v in enumerate(x)], "student int, v array<double>")
    every = scoring.between_pairs(people, "student", 2_000_000)
    assert every.agg(F.count("*"), F.count_distinct("i", "j"), F.count_if(F.expr("i >= j"))).first() == (1_124_250, 1_124_250, 0)
    some = scoring.between_pairs(people, "student", 2000, 3).collect()
    assert len({(r.i, r.j) for r in some}) == len(some) == 2000 and all(r.i < r.j for r in some)
    assert all(r.similarity == pytest.approx(x[r.i] @ x[r.j]) for r in some[:50])
    assert {(r.i, r.j) for r in some} == {(r.i, r.j) for r in scoring.between_pairs(people.repartition(7), "student", 2000, 3).collect()}
    near = {abs(r.i - r.j) for r in some}
    assert max(near) > 1200 and len(near) > 500
    assert scoring.between_pairs(people.limit(1), "student", 5).count() == 0


def test_extremes_between_keys(spark, monkeypatch):
    """They are those of all pairs of means, whatever blocks and sides these are dealt to; a vector of NaN hides no other pair, here or within keys."""
    monkeypatch.setattr(metric, "BLOCK", 20)
    monkeypatch.setattr(metric, "SIDE", 50)
    x = crowd(300, noise=0.5, seed=8)
    data = [(k % 150, k, (3 * v).tolist()) for k, v in enumerate(x)] + [(None, 900, [1.0] * 6), (200, 901, None)]
    people = spark.createDataFrame(data, "student int, det_id long, v array<double>")
    s = unit(x[:150] + x[150:])
    s = (s @ s.T)[np.triu_indices(150, 1)]
    low_high = lambda df: tuple(df.agg(F.min("similarity"), F.max("similarity")).first())
    assert low_high(scoring.between_extremes(people, "student")) == pytest.approx((s.min(), s.max()))
    assert low_high(scoring.between_pairs(people, "student")) == pytest.approx((s.min(), s.max()))
    assert scoring.between_pairs(people, "student").count() == 150 * 149 // 2
    for few in (people.limit(0), people.where("student = 1")):
        assert scoring.between_extremes(few, "student").count() == 0
    odd = people.union(spark.createDataFrame([(300, 902, [float("nan")] * 6), (0, 903, [float("nan")] * 6)], people.schema))
    low, high = low_high(scoring.between_extremes(odd.where("student <> 0"), "student"))
    assert low == pytest.approx(s[149:].min()) and np.isnan(high)  # all but the first mean's
    low, high = low_high(scoring.within_extremes(odd.where("student = 0"), "student", "det_id"))
    assert low == pytest.approx(unit(x[:1])[0] @ unit(x[150:151])[0]) and np.isnan(high)


def test_numbers_of_pairs(spark):
    t = spark.range(5000).select("id", *scoring.unranked(F.col("id"))).collect()
    assert [(r.i, r.j) for r in t] == [(i, j) for j in range(101) for i in range(j)][:5000]
    big = (10**9) * (10**9 - 1) // 2
    r = spark.range(big - 1, big + 1).select(*scoring.unranked(F.col("id"))).collect()
    assert [tuple(x) for x in r] == [(10**9 - 2, 10**9 - 1), (0, 10**9)]
    assert sorted(x.t for x in scoring.drawn(spark, 37, 37, 1).collect()) == list(range(37))


def test_stage_store(spark, tmp_path):
    store = stages.StageStore(spark, f"{tmp_path}/store")
    rows_of = lambda *r: spark.createDataFrame(r, "job_id long, x int")
    jobs = lambda *r: spark.createDataFrame(r, "job_id long, params_hash string")
    assert store.read("detect", "job_id long, x int").collect() == []
    store.write("detect", rows_of((1, 10), (1, 11), (2, 20)), jobs((1, "a"), (2, "a"), (3, "a")))
    store.write("detect", rows_of((2, 21), (4, 40)), jobs((2, "b")))
    assert rows(store.read("detect", "job_id long, x int")) == [(1, 10), (1, 11), (2, 21)]
    store.write("detect", rows_of(), jobs((1, "c")))
    assert rows(store.read("detect", "job_id long, x int")) == [(2, 21)]
    assert {(r.job_id, r.params_hash, r.item_count) for r in store.manifest().collect()} == {(1, "c", 0), (2, "b", 1), (3, "a", 0)}
    wanted = spark.createDataFrame([(k, "detect", "a") for k in (1, 2, 3, 4)], "job_id long, stage string, params_hash string")
    assert {r.job_id for r in stages.due(wanted, store.manifest()).collect()} == {1, 2, 4}
    broken = next((tmp_path / "store/manifest/stage=detect/job_id=3").glob("*.parquet"))
    broken.write_bytes(b"no parquet")
    (broken.parent / f".{broken.name}.crc").unlink(missing_ok=True)
    assert {r.job_id for r in stages.due(wanted, store.manifest()).collect()} == {1, 2, 3, 4}


def test_files_follow_rows_and_not_jobs(spark, tmp_path):
    """A run of many jobs writes a few files; later runs of few or many jobs replace theirs alone."""
    store = stages.StageStore(spark, f"{tmp_path}/store")
    jobs = lambda a, b, h: spark.range(a, b).select(F.col("id").alias("job_id"), F.lit(h).alias("params_hash"))
    items = lambda a, b, x: spark.range(2 * a, 2 * b).select(F.expr("id div 2").cast("int").alias("job_id"), F.lit(x).alias("x"))
    store.write("detect", items(0, 490, 1).repartition(8), jobs(0, 500, "a"))
    assert len(list(tmp_path.glob("store/**/*.parquet"))) < 50
    store.write("detect", items(3, 4, 2), jobs(3, 5, "b"))
    assert rows(store.read("detect", "job_id long, x int").where("job_id < 6")) == [(k, 2 if k == 3 else 1) for k in (0, 1, 2, 3, 5) for _ in range(2)]
    store.write("detect", items(0, 100, 3), jobs(0, 100, "c"))
    got = {r.job_id: (r.params_hash, r.item_count) for r in store.manifest().collect()}
    assert got == {k: ("c" if k < 100 else "a", 2 if k < 490 else 0) for k in range(500)}
    assert store.read("detect", "job_id int, x int").where("x = 3").count() == 200 and store.read("detect", "job_id long, x int").count() == 980


def test_changed_parameters_redo_what_follows(spark):
    jobs = lambda eps: spark.createDataFrame([(1, 40, 30), (2, 40, eps)], "job_id long, iou int, eps int")
    chain = {"detect": [F.col("iou")], "cluster": [F.col("eps")], "match": [F.lit(5).alias("t")]}
    before, after = stages.expected(jobs(30), chain), stages.expected(jobs(31), chain)
    assert {(r.job_id, r.stage) for r in stages.due(after, before).collect()} == {(2, "cluster"), (2, "match")}
    first = sha256(b'{"iou":40}').hexdigest()
    assert before.where("stage = 'cluster' and job_id = 1").first().params_hash == sha256(('{"eps":30}' + first).encode()).hexdigest()


def test_stage_tables_keep_other_jobs(spark, tmp_path):
    for job in (1, 2, 1):
        stages.write_stage(spark.createDataFrame([(job, job * 10)], "job_id int, x int"), f"{tmp_path}/t")
    assert rows(truth.read_stage(spark, f"{tmp_path}/t", "x int, job_id int")) == [(10, 1), (20, 2)]


def test_vectors_by_their_own_headers(spark, tmp_path):
    every = {"a": np.array([[1, 2, 3]], np.float32), "b": np.array([[5, 6], [7, 8]], np.float64), "c": np.asfortranarray([[1.5, 2], [3, 4]]), "d": np.zeros((0, 4), np.float16), "e": np.arange(9000.0).reshape(4500, 2)}
    for name, x in every.items():
        np.save(tmp_path / f"{name}.npy", x)
    got = truth.read_npy(spark, f"{tmp_path}/*.npy").collect()
    assert {(r.path[-5], r.row): list(r.v) for r in got} == {(n, k): v.tolist() for n, x in every.items() for k, v in enumerate(x)}
    np.save(tmp_path / "z.npy", np.zeros(3))
    with pytest.raises(PySparkException):
        truth.read_npy(spark, f"{tmp_path}/z.npy").collect()


def test_erased_files(spark, tmp_path):
    table = ErasableTable(spark, f"{tmp_path}/t")
    for k in range(3):
        table.append(spark.createDataFrame([(10 * k + i, i) for i in range(4)], "student_id int, x int").coalesce(1))
    before = table.files()
    gone = spark.createDataFrame([(1,), (3,), (99,)], "student_id int")
    assert rows(table.erase(gone, "student_id")) == [(1, 1), (3, 1), (99, 0)]
    after = table.files()
    assert len(set(before) & set(after)) == 2 and len(after) == 3
    assert {r.student_id for r in table.read().collect()} == {0, 2, 10, 11, 12, 13, 20, 21, 22, 23}
    version = table.version()
    assert rows(table.erase(gone, "student_id")) == [(1, 0), (3, 0), (99, 0)]
    assert table.files() == after and table.version() == version
    other = ErasableTable(spark, f"{tmp_path}/u")
    assert rows(erase_student({"t": table, "u": other}, spark.createDataFrame([(10,)], "student_id int"))) == [(10, "t", 1), (10, "u", 0)]


def test_offline_commits(spark, tmp_path):
    frame = spark.createDataFrame
    tables = {
        "sessions": frame([(1, "awaiting_review", None), (2, "awaiting_review", None), (3, "committed", "old")], "session_id long, status string, commit_request string"),
        "roster": frame([(1, 10), (1, 11), (2, 10)], "session_id long, student_id long"),
        "bands": frame([(1, 10, "confident", 0.9)], "session_id long, student_id long, decision string, similarity double"),
        "decisions": frame([("b", 2, 10, "present", "teacher_override", 1)], "request_id string, session_id long, student_id long, status string, source string, ordinal long"),
    }
    stream, inbox = CommitStream(spark, f"{tmp_path}/ledger", tables), tmp_path / "inbox"
    inbox.mkdir()
    send = lambda name, *asked: (inbox / name).write_text("".join(json.dumps({"request_id": r, "session_id": s}) + "\n" for r, s in asked))
    send("1.json", ("a", 1), ("a", 1))
    stream.run(str(inbox), 1)
    send("2.json", ("a", 1), ("b", 2), ("c", 1))
    send("3.json", ("b", 2), ("d", 3), ("d", 7))
    stream.run(str(inbox), 1)
    stream.run(str(inbox), 1)
    want = {(1, 10, "present", "auto"), (1, 11, "absent", "auto"), (2, 10, "present", "teacher_override")}
    got = [(r.session_id, r.student_id, r.status, r.source) for r in stream.records().collect()]
    assert len(got) == 3 and set(got) == want
    codes = {(r.request_id, r.session_id, r.outcome) for r in stream.outcomes().collect()}
    assert codes == {("a", 1, "committed"), ("a", 1, "idempotent_replay"), ("c", 1, "already_committed"), ("b", 2, "committed"), ("b", 2, "idempotent_replay"), ("d", 3, "already_committed"), ("d", 7, "session_not_found")}
    asked = spark.createDataFrame([("b", 2), ("d", 3), ("d", 7)], "request_id string, session_id long")
    last = max(r.batch for r in stream.outcomes().collect())
    stream.take(asked, last)  # a batch that is repeated
    assert stream.records().count() == 3


def test_corrections_with_codes(spark):
    records = spark.createDataFrame([(1, 1, 10, "present", None), (2, 1, 11, "absent", None), (3, 2, 10, "absent", None)], "id long, session_id int, student_id int, status string, supersedes_id long")
    known = spark.createDataFrame([(1, "committed"), (2, "awaiting_review")], "session_id int, status string")
    asked = [(100, 1, 10, "present"), (101, 1, 10, "absent"), (102, 1, 10, "absent"), (103, 1, 10, "present"), (104, 1, 12, "absent"), (105, 2, 10, "present"), (106, 9, 10, "present")]
    got = ledger.correction_outcomes(spark.createDataFrame(asked, "id long, session_id int, student_id int, status string"), known, records)
    assert {r.id: (r.outcome, r.supersedes_id) for r in got.collect()} == {100: ("no_change", None), 101: ("corrected", 1), 102: ("no_change", None), 103: ("corrected", 101), 104: ("attendance_not_found", None), 105: ("not_committed", None), 106: ("session_not_found", None)}


def test_commit_codes(spark):
    frame = spark.createDataFrame
    requests = frame([("r", k) for k in range(1, 5)], "request_id string, session_id int")
    known = frame([(1, "committed", "r"), (2, "committed", "r"), (3, "awaiting_review", None), (4, "awaiting_review", None)], "session_id int, status string, commit_request string")
    none = frame([], "session_id int, student_id int, decision string, similarity double")
    given = frame([], "request_id string, session_id int, student_id int")
    ids = lambda *k: frame([(x,) for x in k], "session_id int")
    got = R.commit_outcomes(requests, known, none.select("session_id", "student_id"), none, given, ids(1, 4), ids(2))
    assert {r.session_id: r.outcome for r in got.collect()} == {1: "audit_log_missing", 2: "idempotent_replay", 3: "draft_not_ready", 4: "committed"}


def test_concatenated_chunks(spark):
    chunks = [(u, k, s, f"{u}-{k}-{s};".encode()) for u in range(30) for k in range(u % 7) for s in range(2)] + [(50, 0, 1, None)]
    got = {r.upload_id: (r.n_chunks, r.n_bytes, r.sha256) for r in I.concatenated(spark.createDataFrame(chunks, "upload_id long, chunk int, sent int, data binary").repartition(5)).collect()}
    want = {50: (1, 0, sha256(b"").hexdigest())}
    for u in range(30):
        if u % 7:
            whole = b"".join(f"{u}-{k}-1;".encode() for k in range(u % 7))
            want[u] = (u % 7, len(whole), sha256(whole).hexdigest())
    assert got == want


def brute_transform(p):
    q = np.array(alignment.REFERENCE)
    best = None
    for i, j in itertools.combinations(range(5), 2):
        if (p[i] == p[j]).all():
            continue
        m = np.array([[p[i][0], -p[i][1], 1, 0], [p[i][1], p[i][0], 0, 1], [p[j][0], -p[j][1], 1, 0], [p[j][1], p[j][0], 0, 1]])
        re, im, tx, ty = np.linalg.solve(m, np.concatenate([q[i], q[j]]))
        out = np.stack([re * p[:, 0] - im * p[:, 1] + tx, im * p[:, 0] + re * p[:, 1] + ty], 1)
        e = ((out - q) ** 2).sum(1)
        if best is None or np.sort(e)[2] < best[0] - 1e-9:
            best = np.sort(e)[2], e
    near = best[1] <= max(alignment.SPREAD * np.sqrt(best[0]), alignment.LEAST) ** 2
    a = np.concatenate([[[x, -y, 1, 0], [y, x, 0, 1]] for x, y in p[near]])
    return [*np.linalg.lstsq(a, q[near].ravel(), rcond=None)[0], best[0], near.sum()]


def test_alignment(spark):
    rng = np.random.default_rng(2)
    faces = [np.array(alignment.REFERENCE) * s @ np.array([[c, -d], [d, c]]) + t for s, c, d, t in ((2, 1, 0, 5), (0.5, 0.6, 0.8, -30))]
    faces += [np.array(alignment.REFERENCE) * 1.5 + rng.normal(0, 2, (5, 2)) for _ in range(40)]
    odd = faces[2].copy()
    odd[4] += 80
    faces += [odd, np.vstack([faces[3][:4], faces[3][3]]), np.full((5, 2), 3.0)]
    table = [(k, *f[:, 0].tolist(), *f[:, 1].tolist()) for k, f in enumerate(faces)] + [(99, None, *[1.0] * 9)]
    df = spark.createDataFrame(table, "det_id long, " + ", ".join(f"l{c}{k} double" for c in "xy" for k in range(1, 6)))
    got = {r.det_id: [r[c] for c in alignment.OUT] for r in alignment.aligned(df, ["det_id"]).collect()}
    for k, f in enumerate(faces[:-1]):
        assert got[k] == pytest.approx(brute_transform(f), abs=1e-5), k
    assert got[0][:4] == pytest.approx([0.5, 0, -2.5, -2.5]) and got[42][5] == 4
    assert got[len(faces) - 1] == got[99] == [None] * 6


def test_every_preflight_check(spark):
    f = spark.createDataFrame
    uploads = f([(k, 4, 10) for k in range(9)], "upload_id int, expected int, seconds int")
    frames, faces = [], []
    base = {"sharp": 100.0, "upper": 100.0, "xs": [50, 950], "faces": 2, "light": 90.0}
    cases = {1: {"sharp": 50.0}, 2: {"faces": 0}, 3: {"xs": [400, 500]}, 4: {"xs": [300, 700]}, 5: {"xs": [0, 990] * 4}, 6: {"upper": 170.0}, 7: {}, 8: {"xs": [50]}}
    for k, change in cases.items():
        own = base | change
        for n, x in enumerate(own["xs"]):
            frames.append((k, n, 1000, own["sharp"], own["upper"]))
            faces += [(k, n, x - 5.0, x + 5.0, own["light"])] * own["faces"]
    samples = preflight.frame_samples(f(frames, "upload_id int, frame int, width int, sharpness double, upper_light double"), f(faces, "upload_id int, frame int, x1 double, x2 double, light double"))
    got = {r.upload_id: ([c.check for c in r.checks], r.status) for r in preflight.preflight(preflight.upload_samples(uploads, samples)).collect()}
    assert got == {
        0: (["unreadable_video"], "fail"), 1: (["blurry_video"], "fail"), 2: (["low_face_yield"], "fail"), 3: (["no_pan_detected"], "fail"), 4: (["partial_coverage"], "warn"),
        5: (["pan_too_fast"], "fail"), 6: (["backlit"], "fail"), 7: ([], "pass"), 8: ([], "pass"),
    }
