"""Queries of the analytics operators, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum_spark.functions import geometry as G
from quorum_spark.operators import clustering as C
from quorum_spark.operators import detections as D
from quorum_spark.operators import evaluation as E
from quorum_spark.operators import intake as I
from quorum_spark.operators import ledger as L
from quorum_spark.operators import matching as M
from quorum_spark.operators import products as X
from quorum_spark.operators import sessions as N
from quorum_spark.operators.numbering import numbered
from quorum_spark.operators.scratch import Scratch
from quorum_spark.params import PipelineParams
from quorum_spark.plans import jobs, oracles, reviews, scores
from quorum_spark.plans import stand_ins as S

P = S.PARAMS
QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def _labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    crops = S.crops(spark, d)
    return crops, Scratch(spark, "plan").cut(C.dbscan(crops, P.eps, P.min_samples), "labels")


def _summary(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    crops, labels = _labels(spark, d)
    return crops, labels, Scratch(spark, "plan").cut(C.summarize(crops, labels), "summary")


@query
def eps_pairs(spark, d):
    return C.eps_pairs(S.crops(spark, d), P.eps).select("i", "j", r6("distance", "distance"))


@query
def dbscan_labels(spark, d):
    return _labels(spark, d)[1]


@query
def cluster_summary(spark, d):
    return rounded(_summary(spark, d)[2].drop("representative", "tightness"), "mean_quality")


@query
def cluster_tightness(spark, d):
    return _summary(spark, d)[2].select("cluster_id", r6("tightness", "tightness"))


def _vector(df: DataFrame, key: str, v: str) -> DataFrame:
    return df.select(key, F.posexplode(v).alias("pos", "x")).select(key, "pos", r6("x", "x"))


@query
def weighted_representative(spark, d):
    return _vector(_summary(spark, d)[2], "cluster_id", "representative")


@query
def plain_mean_representative(spark, d):
    crops, labels = _labels(spark, d)
    return _vector(C.mean_vectors(crops.join(labels.where("cluster_id >= 0"), "det_id"), "cluster_id"), "cluster_id", "mean")


@query
def distance_to_representative(spark, d):
    crops, labels, summary = _summary(spark, d)
    return rounded(C.distances(crops, labels.drop("core"), summary), "distance")


@query
def noise_and_cluster_counts(spark, d):
    return _labels(spark, d)[1].agg(F.count_if(F.col("cluster_id") == -1).alias("noise"), F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("clusters"), F.count_if("core").alias("core"))


#: The grid of a sweep.
EPS_GRID, MIN_SAMPLES_GRID = [round(0.30 + 0.02 * k, 2) for k in range(13)], [2, 3, 4, 5]


@query
def cluster_sweep(spark, d):
    """All points of the grid in one clustering: a crop stands for itself at every point, and pairs are found once."""
    crops = S.crops(spark, d)
    pairs = Scratch(spark, "sweep").cut(C.eps_pairs(crops, max(EPS_GRID)), "pairs")
    grid = spark.createDataFrame([(k, e, m) for k, (e, m) in enumerate((e, m) for e in EPS_GRID for m in MIN_SAMPLES_GRID)], "point long, eps double, min_samples int")
    return rounded(C.sweep(crops, pairs, grid, crops.select("det_id", F.col("label").alias("true_label"))), "purity")


@query
def job_labels(spark, d):
    crops = S.crops(spark, d).withColumnRenamed("label", "job_id").where("job_id is not null")
    return C.dbscan(crops, P.eps, P.min_samples, by=("job_id",))


@query
def merged_summary(spark, d):
    crops, labels, summary = _summary(spark, d)
    new = C.merged(labels.drop("core"), C.merge_edges(summary, P.eps * P.merge_factor, P.merge_overlap))
    return rounded(C.summarize(crops, new).drop("representative"), "mean_quality", "tightness")


@query
def temporal_merge_edges(spark, d):
    return rounded(C.merge_edges(_summary(spark, d)[2], P.eps * P.merge_factor, P.merge_overlap), "distance", "overlap")


@query
def temporal_merge_labels(spark, d):
    _, labels, summary = _summary(spark, d)
    return C.merged(labels.drop("core"), C.merge_edges(summary, P.eps * P.merge_factor, P.merge_overlap))


def _frames(crops: DataFrame) -> DataFrame:
    return crops.agg((F.max("frame_index") + 1).alias("total"))


@query
def split_candidates(spark, d):
    crops, _, summary = _summary(spark, d)
    return rounded(C.split_candidates(summary, _frames(crops), P.split_span, P.split_tightness), "span", "tightness")


@query
def split_labels(spark, d):
    crops, labels, summary = _summary(spark, d)
    found = C.split_candidates(summary, _frames(crops), P.split_span, P.split_tightness)
    return C.split(crops, labels.drop("core"), found, P.split_factor * P.eps, P.min_samples)


@query
def gallery_means(spark, d):
    return _vector(S.gallery(spark, d), "student_id", "mean")


def _best_two(spark, d):
    """Each cluster's two best students, which decide it."""
    summary = _summary(spark, d)[2]
    return summary, Scratch(spark, "plan").cut(M.top_matches(summary.select("cluster_id", "representative"), S.gallery(spark, d), 2), "best")


@query
def similarity_matrix_topk(spark, d):
    return rounded(M.top_matches(_summary(spark, d)[2].select("cluster_id", "representative"), S.gallery(spark, d), 3), "similarity")


@query
def runner_up_margin(spark, d):
    t = _best_two(spark, d)[1].groupBy("cluster_id").agg(F.max("similarity").alias("best"), F.min("similarity").alias("second"))
    return t.select("cluster_id", r6(F.col("best") - F.col("second"), "margin"))


def _greedy(spark, d):
    summary, two = _best_two(spark, d)
    return M.decide(two, two.where("rank = 1").select("cluster_id", "student_id", "similarity"), P, summary)


@query
def band_decision(spark, d):
    return rounded(_greedy(spark, d), "similarity", "runner_up")


@query
def lowest_margin_topk(spark, d):
    sure = _greedy(spark, d).where("decision = 'confident'").withColumn("margin", r6(F.col("similarity") - F.col("runner_up")))
    return sure.orderBy("margin", "cluster_id").limit(10).select("cluster_id", "margin")


JOB = ("job_id",)


def _sessions(spark, d):
    """All sessions' crops, their labels after merging and splitting, and what each cluster is matched with in its session's gallery."""
    scratch, crops, p = Scratch(spark, "sessions"), S.session_crops(spark, d), S.SESSION_PARAMS
    labels = scratch.cut(C.coherent(crops, C.dbscan(crops, p.eps, p.min_samples, JOB).drop("core"), p, JOB), "labels")
    gallery = scratch.cut(S.session_gallery(spark, d), "gallery")
    return labels, gallery, scratch.cut(N.matched(C.summarize(crops, labels, JOB), gallery, p, JOB), "matched")


@query
def session_labels(spark, d):
    return _sessions(spark, d)[0]


@query
def hungarian_match(spark, d):
    """Each session's clusters and its own students, one to one; one session's gallery is empty."""
    return rounded(_sessions(spark, d)[2], "similarity", "runner_up")


@query
def session_summary(spark, d):
    _, gallery, decided = _sessions(spark, d)
    return rounded(N.summaries(decided, gallery, P, JOB, S.warned_sessions(spark, d)), "coverage", "mean_similarity")


@query
def ablations(spark, d):
    """Decisions by weighted and by plain representatives, and people that votes of crops alone find present."""
    crops, labels, summary = _summary(spark, d)
    plain = C.mean_vectors(crops.join(labels.where("cluster_id >= 0"), "det_id"), "cluster_id").withColumnRenamed("mean", "representative")
    out = M.majority_vote(crops, S.gallery(spark, d), 0.3, 3).where("present").agg(F.lit("votes").alias("variant"), F.lit("present").alias("decision"), F.count("*").alias("n"))
    for name, reps in (("weighted", summary), ("plain", plain)):
        two = Scratch(spark, "plan").cut(M.top_matches(reps.select("cluster_id", "representative"), S.gallery(spark, d), 2), "best")
        decided = M.decide(two, two.where("rank = 1").select("cluster_id", "student_id", "similarity"), P, reps)
        out = out.union(decided.groupBy(F.lit(name).alias("variant"), "decision").agg(F.count("*").alias("n")))
    return out


@query
def majority_vote(spark, d):
    return M.majority_vote(S.crops(spark, d), S.gallery(spark, d), 0.3, 3)


@query
def within_between_similarity(spark, d):
    within = C.tightness(S.crops(spark, d), "label").withColumnRenamed("tightness", "within")
    size = S.crops(spark, d).groupBy("label").count()
    return within.join(size, "label").select("label", r6("within", "within"), ((F.col("within") < 0.55) | (F.col("count") < 2)).alias("flagged"))


def _crops_and_gallery(spark, d):
    return S.crops(spark, d).select(F.col("det_id").alias("id"), "v"), S.gallery(spark, d).select(F.col("student_id").alias("id"), F.col("mean").alias("v"))


@query
def similarity_histogram(spark, d):
    return X.product_histogram(*_crops_and_gallery(spark, d), -1.0, 1.0, 20, 9)


@query
def similarity_percentiles(spark, d):
    mean, values = X.product_quantiles(*_crops_and_gallery(spark, d), [0.05, 0.5, 0.95])
    row = [None if x is None else round(x, 6) for x in (mean, *values)]
    return spark.createDataFrame([row], "mean double, p5 double, p50 double, p95 double")


def boxes(spark, d):
    """All detections, those of a frame numbered by their whole row."""
    from pyspark.sql.window import Window

    order = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "x1", "y1", "w"]
    return S.detections(spark, d).withColumn("ordinal", F.row_number().over(Window.partitionBy("frame_index").orderBy(*order)).cast("long"))


@query
def nms_boxes(spark, d):
    kept = D.suppress(boxes(spark, d), "frame_index", P.nms_iou).select("frame_index", F.posexplode("kept").alias("k", "b"))
    return kept.select("frame_index", F.concat_ws("_", F.col("frame_index").cast("string"), F.col("k").cast("string")).alias("det_id"), "b.x1", "b.y1", r6("b.score", "score")).where("score >= 0.6")


@query
def iou_pairs(spark, d):
    return D.overlapping(boxes(spark, d).withColumnRenamed("ordinal", "i"), "frame_index", ["i", "l_orderkey", "l_partkey"], 0.3).select("frame_index", "i", F.col("i2").alias("j"), "l_orderkey", "l_partkey", F.col("l_orderkey2").alias("o2"), F.col("l_partkey2").alias("p2"), "iou")


@query
def width_histogram(spark, d):
    b = (F.floor(F.col("w") / 10) * 10).cast("int")
    return S.detections(spark, d).groupBy(b.alias("low")).agg(F.count("*").alias("n")).select("low", F.concat_ws("-", F.col("low").cast("string"), (F.col("low") + 10).cast("string")).alias("bucket"), "n")


@query
def detections_per_frame(spark, d):
    found = S.detections(spark, d).groupBy("frame_index").count()
    frames = found.agg(F.max("frame_index").alias("top")).select(F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("frame_index"))
    n = F.coalesce("count", F.lit(0))
    return frames.join(found, "frame_index", "left").agg(F.count("*").alias("frames"), F.sum(n).alias("total"), r6(F.avg(n), "mean"), F.min(n).alias("least"), F.max(n).alias("most"))


Q = PipelineParams()


def _gated(spark, d):
    return D.gate(S.detections(spark, d), Q)


@query
def pose_and_quality(spark, d):
    return rounded(_gated(spark, d).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "w", "yaw", "pitch", "quality_score"), "yaw", "pitch", "quality_score")


@query
def quality_gate(spark, d):
    return _gated(spark, d).where("accepted").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "w")


@query
def reject_reasons(spark, d):
    return _gated(spark, d).groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"), r6(F.avg("quality_score"), "mean"), r6(F.min("quality_score"), "low"), r6(F.max("quality_score"), "high"))


@query
def simple_quality(spark, d):
    g = _gated(spark, d)
    return g.groupBy("l_suppkey").agg(r6(F.avg(G.simple_quality(F.col("w"), F.col("blur"), F.col("yaw"), Q.max_abs_yaw_deg)), "mean"))


@query
def pose_bucket_topk(spark, d):
    g = _gated(spark, d).where("accepted").withColumn("bucket", G.pose_bucket(F.col("yaw"), Q.pose_split_deg)).withColumn("q", r6("quality_score"))
    order = [F.desc("q"), F.col("frame_index"), F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber"), F.col("w")]
    three = L.top_rows(g, ["l_suppkey", "bucket"], order, Q.photos_per_pose).drop("rank")
    return L.top_rows(three, "l_suppkey", order, Q.max_photos).select("l_suppkey", "bucket", "l_orderkey", "l_partkey", "l_linenumber", "q", F.col("rank").cast("int").alias("rank"))


@query
def enrolment_status(spark, d):
    g = _gated(spark, d).where("accepted").withColumn("bucket", G.pose_bucket(F.col("yaw"), Q.pose_split_deg))
    p = g.groupBy("l_suppkey").pivot("bucket", ["left", "frontal", "right"]).count().fillna(0)
    total = F.col("left") + F.col("frontal") + F.col("right")
    enough = (total >= Q.min_photos) & (F.col("left") > 0) & (F.col("frontal") > 0) & (F.col("right") > 0)
    return p.select("l_suppkey", "left", "frontal", "right", total.alias("total"), enough.alias("sufficient"))


@query
def latest_consent(spark, d):
    return L.latest_consent(S.consents(spark, d))


@query
def consented_gallery(spark, d):
    valid = L.latest_consent(S.consents(spark, d)).where("state = 'valid'").select(F.col("student_id").alias("c_custkey"))
    return S.table(spark, d, "customer").join(valid, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query
def latest_job(spark, d):
    done = S.table(spark, d, "orders").where("o_orderstatus = 'F'")
    return L.top_rows(done, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query
def best_photo_topk(spark, d):
    p = S.table(spark, d, "events")
    return L.top_rows(p, "user_id", [F.desc("value"), F.col("event_id")], 4).select("user_id", "event_id", "value", F.col("rank").cast("int").alias("rank"))


@query
def first_audit(spark, d):
    return S.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"))


@query
def current_presence(spark, d):
    return L.current(S.ledger(spark, d)).select("id", "class_session_id", "student_id", "status")


@query
def correction_chain_depth(spark, d):
    records = S.ledger(spark, d)
    deep = L.chain_depths(records).join(records.select("id", "student_id"), "id")
    return deep.select("student_id", (F.col("depth") + 1).cast("long").alias("records"), F.col("depth").cast("long").alias("corrections"))


@query
def corrections(spark, d):
    tips = L.current(S.ledger(spark, d))
    asked = tips.select((F.col("id") + 10_000_000).alias("id"), "class_session_id", "student_id", F.lit("present").alias("status"))
    return L.correct(S.ledger(spark, d), asked)


@query
def roster(spark, d):
    c, n = S.table(spark, d, "customer"), S.table(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


def _review(spark, d):
    """Students of each course; decisions and confident matches from their orders."""
    r = S.table(spark, d, "customer").where("c_nationkey is not null").select(F.col("c_nationkey").alias("course"), F.col("c_custkey").alias("student_id"))
    o = S.table(spark, d, "orders").select(F.col("o_custkey").alias("student_id"), "o_orderstatus", "o_orderkey", "o_totalprice")
    status = F.when(F.col("o_totalprice") > 150000, "present").otherwise("absent")
    source = F.when(F.col("o_totalprice") > 150000, "teacher_confirmed").otherwise("teacher_override")
    given = o.where("o_orderstatus = 'P'").select("student_id", status.alias("status"), source.alias("source"), F.col("o_orderkey").alias("ordinal"))
    sure = o.where("o_orderstatus = 'F'").groupBy("student_id").agg((F.max("o_totalprice") / 1000000).alias("similarity"))
    return r, L.last_decisions(given), sure


@query
def last_decisions(spark, d):
    """Of each student's decisions the one given last."""
    return _review(spark, d)[1].select("student_id", "status", "source")


@query
def commit_fanout(spark, d):
    return rounded(L.commit(*_review(spark, d), 42, ["course"]), "confidence")


@query
def commit_counts(spark, d):
    return L.commit_counts(L.commit(*_review(spark, d), 42, ["course"]), ["course"])


@query
def missing_review(spark, d):
    r, given, sure = _review(spark, d)
    return r.join(sure, "student_id", "left_semi").join(given, "student_id", "left_anti").select("course", "student_id")


@query
def unenrolled_decisions(spark, d):
    """Decisions of students who aren't on a course's roster, for each course."""
    r, given, _ = _review(spark, d)
    every = given.crossJoin(F.broadcast(r.select("course").distinct()))
    return every.join(r, ["course", "student_id"], "left_anti").select("course", "student_id", "status")


@query
def absent_list(spark, d):
    r, _, sure = _review(spark, d)
    return r.join(sure, "student_id", "left_anti").select("course", "student_id")


@query
def reviewer_live_counts(spark, d):
    o = S.table(spark, d, "orders")
    sure, over, yes, lost = (F.col("o_orderstatus") == "F"), (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 10 == 0), (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0), (F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 20 == 0)
    n = o.groupBy((F.col("o_custkey") % 25).alias("session")).agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in {"confident": sure, "overridden": over, "confirmed": yes, "found": lost}.items()])
    present = F.col("confident") - F.col("overridden") + F.col("confirmed") + F.col("found")
    return n.select("session", "total", present.alias("present"), F.floor(100.0 * present / F.col("total") + 0.5).alias("percent"))


@query
def confusion_metrics(spark, d):
    t = S.truth(spark, d)
    return rounded(E.metrics(t.agg(*E.confusion(F.col("actual"), F.col("predicted")))), "precision", "recall", "accuracy", "f1")


@query
def stratified_metrics(spark, d):
    return rounded(E.stratified(S.truth(spark, d), ["lang", "source", "toxic"]), "precision", "recall", "accuracy", "f1")


def _sweep(spark, d):
    return E.sweep(S.truth(spark, d), "n_chars", spark.range(200, 3200, 200).select(F.col("id").alias("threshold")))


@query
def threshold_sweep(spark, d):
    return rounded(_sweep(spark, d), "precision", "recall", "accuracy", "f1")


@query
def best_f1(spark, d):
    return rounded(E.best_f1(_sweep(spark, d)), "f1")


@query
def pipeline_yield(spark, d):
    present = S.table(spark, d, "part").select(F.col("p_partkey").alias("student_id"))
    got = S.table(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("student_id")).agg(F.count("*").alias("member_count"))
    return rounded(E.crop_yield(present, got), "mean_crops", "without_share")


@query
def clustering_quality(spark, d):
    crops, labels = _labels(spark, d)
    spots = labels.where("cluster_id >= 0").join(crops, "det_id").select("cluster_id", F.col("label").alias("person"))
    return rounded(E.clustering_quality(spots), "merge_rate", "purity", "over_split_rate")


@query
def preflight_checks(spark, d):
    samples = S.table(spark, d, "events").select(F.date_trunc("HOUR", "ts").alias("hour"), "value")
    return rounded(I.preflight(samples, "hour", {"least_detections": 10, "least_sharpness": 50, "least_spread": 60}), "sharp")


@query
def pan_speed(spark, d):
    from pyspark.sql.window import Window

    e = S.table(spark, d, "events").where("value is not null")
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.select("user_id", step.alias("step")).groupBy("user_id").agg(r6(F.sum("step") / 60, "speed"))


@query
def missing_chunks(spark, d):
    o = S.table(spark, d, "orders")
    up = o.select(F.col("o_orderkey").alias("upload_id"), F.floor("o_totalprice").alias("total_bytes"), F.lit(20000).alias("chunk_bytes"))
    got = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").cast("long").alias("chunk"))
    return L.missing_chunks(up, got)


@query
def retention_expired(spark, d):
    rows = S.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"))
    return L.expired(rows, 180, F.lit("2000-01-01").cast("timestamp_ntz")).select("o_orderkey")


@query
def biometric_delete_effect(spark, d):
    gone = L.latest_consent(S.consents(spark, d)).where("state = 'revoked'").select(F.col("student_id").alias("user_id"))
    e = S.table(spark, d, "events")
    return e.join(gone, "user_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("kept"))


@query
def linspace_sample(spark, d):
    k, e = 18, S.table(spark, d, "events").where("event_id is not null")
    at = F.floor(F.col("id") * (F.col("total") - 1) / (k - 1))
    want = spark.range(k).crossJoin(e.agg(F.count("*").alias("total"))).select(at.alias("place")).distinct()
    placed = numbered(e.select("event_id"), ["event_id"], "place", Scratch(spark, "linspace")).join(F.broadcast(want), "place")
    return e.join(F.broadcast(placed), "event_id").select("event_id", "event_type")


@query
def media_urls(spark, d):
    path = F.concat(F.lit("/data/jobs/"), F.col("o_orderkey").cast("string"), F.lit("/best.jpg"))
    o = S.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, path).otherwise(F.lit("s3://x/y")).alias("uri"))
    return o.select("o_orderkey", F.when(F.col("uri").startswith("/data/"), F.concat(F.lit("/media/"), F.expr("substring(uri, 7)"))).alias("url"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return cluster_summary(spark, d)


def queries() -> dict:
    return QUERIES | reviews.QUERIES | scores.QUERIES | jobs.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | reviews.SQL | scores.SQL | jobs.SQL
