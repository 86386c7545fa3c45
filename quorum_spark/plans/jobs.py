"""Queries of uploads, stages, corrections, deletions and offline commits, each with the SQL it is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quorum_spark.functions import geometry as G
from quorum_spark.operators import alignment as A
from quorum_spark.operators import clustering as C
from quorum_spark.operators import intake as I
from quorum_spark.operators import ledger as L
from quorum_spark.operators import preflight as V
from quorum_spark.operators import roster as R
from quorum_spark.operators import sessions as N
from quorum_spark.operators.scratch import Scratch, shared_dir
from quorum_spark.plans import oracles, reviews
from quorum_spark.plans import stand_ins as S
from quorum_spark.plans.oracles import CONSENT, DET, LEDGER
from quorum_spark.sources.erase import ErasableTable, erase_student
from quorum_spark.sources.stages import StageStore, due, expected
from quorum_spark.streaming.requests import CommitStream

QUERIES, SQL = {}, {}
JOB = ("job_id",)


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


#: An order is a sampled frame of its customer's upload, its lines are the faces.
_MEASURED = """fr AS (SELECT o_custkey AS upload_id, o_orderkey AS frame, 1283 AS width, o_totalprice % 130 AS sharpness, ((o_orderkey * 37) % 256)::DOUBLE AS upper_light FROM orders),
fa AS (SELECT o_custkey AS upload_id, l_orderkey AS frame, ((l_partkey * 37) % 1200)::DOUBLE AS x1, (l_partkey * 37) % 1200 + 20.0::DOUBLE + 2 * l_quantity AS x2, CASE WHEN l_suppkey % 10 > 0 THEN ((l_suppkey * 37) % 256)::DOUBLE END AS light FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
per AS (SELECT upload_id, frame, count(*) AS faces, avg((x1 + x2) / 2) AS middle, avg(light) AS face_light FROM fa GROUP BY ALL),
s AS (SELECT upload_id, frame, sharpness, width, coalesce(faces, 0) AS faces, middle / width AS x, face_light, CASE WHEN faces > 0 THEN upper_light END AS upper_light FROM fr LEFT JOIN per USING (upload_id, frame)),
steps AS (SELECT *, abs(x - lag(x IGNORE NULLS) OVER (PARTITION BY upload_id ORDER BY frame)) * width AS moved FROM s),
agg AS (SELECT upload_id, count(*) AS frames, quantile_cont(sharpness, 0.5) AS sharpness, avg(faces) AS faces, CASE WHEN count(x) >= 2 THEN max(x) - min(x) END AS x_range, sum(moved) AS moved, avg(face_light) AS face_light, avg(upper_light) AS upper_light FROM steps GROUP BY 1),
m AS (SELECT c_custkey AS upload_id, coalesce(frames, 0) AS frames, sharpness, CASE WHEN c_custkey % 40 > 0 THEN faces / (c_custkey % 40) END AS face_yield, x_range, CASE WHEN x_range IS NOT NULL AND c_custkey % 30 > 0 THEN moved / (c_custkey % 30) END AS pan_speed, CASE WHEN face_light > 1e-6 THEN upper_light / face_light END AS light_ratio FROM customer LEFT JOIN agg ON upload_id = c_custkey)"""


def _measured(spark, d):
    o, l, c = (S.table(spark, d, t) for t in ("orders", "lineitem", "customer"))
    frames = o.select(F.col("o_custkey").alias("upload_id"), F.col("o_orderkey").alias("frame"), F.lit(1283).alias("width"), (F.col("o_totalprice") % 130).alias("sharpness"), ((F.col("o_orderkey") * 37) % 256).cast("double").alias("upper_light"))
    x1 = ((F.col("l_partkey") * 37) % 1200).cast("double")
    light = F.when(F.col("l_suppkey") % 10 > 0, ((F.col("l_suppkey") * 37) % 256).cast("double"))
    faces = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("upload_id"), F.col("l_orderkey").alias("frame"), x1.alias("x1"), (x1 + 20.0 + 2 * F.col("l_quantity")).alias("x2"), light.alias("light"))
    uploads = c.select(F.col("c_custkey").alias("upload_id"), (F.col("c_custkey") % 40).alias("expected"), (F.col("c_custkey") % 30).alias("seconds"))
    return V.upload_samples(uploads, V.frame_samples(frames, faces))


_NUMBERS = ("sharpness", "face_yield", "x_range", "pan_speed", "light_ratio")


@query(f"WITH {_MEASURED} SELECT upload_id, frames, {', '.join(f'round({c}, 9) AS {c}' for c in _NUMBERS)} FROM m")
def preflight_measures(spark, d):
    return _measured(spark, d).withColumns({c: F.round(c, 9) for c in _NUMBERS})


@query(f"""WITH {_MEASURED}, r AS (SELECT upload_id, frames, {', '.join(f'round({c}, 9) AS {c}' for c in _NUMBERS)} FROM m)
SELECT upload_id, concat_ws(',', CASE WHEN frames = 0 THEN 'unreadable_video' END, CASE WHEN sharpness < 60 THEN 'blurry_video' END, CASE WHEN face_yield < 0.15 THEN 'low_face_yield' END, CASE WHEN x_range < 0.25 THEN 'no_pan_detected' END,
  CASE WHEN x_range >= 0.25 AND x_range < 0.6 THEN 'partial_coverage' END, CASE WHEN pan_speed > 400 THEN 'pan_too_fast' END, CASE WHEN light_ratio > 1.8 THEN 'backlit' END) AS checks,
  CASE WHEN frames = 0 OR sharpness < 60 OR face_yield < 0.15 OR x_range < 0.25 OR pan_speed > 400 OR light_ratio > 1.8 THEN 'fail' WHEN x_range < 0.6 THEN 'warn' ELSE 'pass' END AS status FROM r""")
def preflight_status(spark, d):
    rows = V.preflight(_measured(spark, d).withColumns({c: F.round(c, 9) for c in _NUMBERS}))
    return rows.select("upload_id", F.array_join(F.transform("checks", lambda c: c.check), ",").alias("checks"), "status")


_FACE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "w"]
_REF = "[{'x': 38.2946, 'y': 51.6963}, {'x': 73.5318, 'y': 51.5014}, {'x': 56.0252, 'y': 71.7366}, {'x': 41.5493, 'y': 92.3655}, {'x': 70.7299, 'y': 92.2041}]"


@query(f"""WITH {DET}, marks AS (SELECT row_number() OVER () AS id, l_orderkey, l_partkey, l_suppkey, l_linenumber, w, {_REF} AS q, [{{'x': x1 + 0.3::DOUBLE * w, 'y': y1 + 0.35::DOUBLE * w}}, {{'x': x1 + 0.7::DOUBLE * w, 'y': y1 + 0.35::DOUBLE * w}},
  {{'x': x1 + (0.5::DOUBLE + a * 0.03::DOUBLE) * w, 'y': y1 + (0.55::DOUBLE + b * 0.06::DOUBLE) * w}}, {{'x': x1 + 0.35::DOUBLE * w, 'y': y1 + 0.75::DOUBLE * w}}, {{'x': x1 + 0.65::DOUBLE * w, 'y': y1 + 0.75::DOUBLE * w}}] AS p FROM det),
two AS (SELECT *, p[j].x - p[i].x AS dx, p[j].y - p[i].y AS dy, q[j].x - q[i].x AS ex, q[j].y - q[i].y AS ey FROM marks, range(1, 6) s(i), range(1, 6) t(j) WHERE i < j),
spun AS (SELECT *, (ex * dx + ey * dy) / (dx * dx + dy * dy) AS re, (ey * dx - ex * dy) / (dx * dx + dy * dy) AS im FROM two),
moved AS (SELECT *, q[i].x - (re * p[i].x - im * p[i].y) AS tx, q[i].y - (im * p[i].x + re * p[i].y) AS ty FROM spun),
missed AS (SELECT *, list_transform(range(1, 6), lambda k: (re * p[k].x - im * p[k].y + tx - q[k].x) ** 2 + (im * p[k].x + re * p[k].y + ty - q[k].y) ** 2) AS e FROM moved),
best AS (SELECT *, round(list_sort(e)[3], 9) AS median FROM missed QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(list_sort(e)[3], 9), i, j) = 1),
kept AS (SELECT *, list_filter(range(1, 6), lambda k: e[k] <= greatest({A.SPREAD!r}::DOUBLE * sqrt(median), 0.001) ** 2) AS g FROM best),
flat AS (SELECT id, any_value(median) AS median, count(*) AS n, avg(px) AS mx, avg(py) AS my, avg(qx) AS nx, avg(qy) AS ny, list({{'px': px, 'py': py, 'qx': qx, 'qy': qy}}) AS pts FROM (SELECT id, median, p[k].x AS px, p[k].y AS py, q[k].x AS qx, q[k].y AS qy FROM (SELECT *, unnest(g) AS k FROM kept)) GROUP BY id),
sums AS (SELECT *, list_sum(list_transform(pts, lambda z: (z.px - mx) ** 2 + (z.py - my) ** 2)) AS zz, list_sum(list_transform(pts, lambda z: (z.px - mx) * (z.qx - nx) + (z.py - my) * (z.qy - ny))) AS c, list_sum(list_transform(pts, lambda z: (z.px - mx) * (z.qy - ny) - (z.py - my) * (z.qx - nx))) AS s FROM flat)
SELECT {', '.join(_FACE)}, round(c / zz + 1e-9, 7) AS re, round(s / zz + 1e-9, 7) AS im, round(nx - (c / zz * mx - s / zz * my) + 1e-9, 7) AS tx, round(ny - (s / zz * mx + c / zz * my) + 1e-9, 7) AS ty, round(sums.median + 1e-9, 7) AS median, n::DOUBLE AS inliers FROM sums JOIN marks USING (id)""")
def aligned_faces(spark, d):
    """The transform of every detection's landmarks onto the reference points."""
    return A.aligned(S.detections(spark, d), _FACE).withColumns({c: F.round(F.col(c) + 1e-9, 7) for c in ("re", "im", "tx", "ty", "median")})  # no ties


def _stages():
    return {"detect": [F.col("iou")], "cluster": [F.col("eps"), F.col("least")], "match": [F.col("threshold")]}


def _expected(spark, d, changed: bool):
    """A supplier is a job; every seventh one's radius and every eleventh one's threshold has changed since."""
    k, now = F.col("s_suppkey"), F.lit(changed)
    eps = F.when(now & (k % 7 == 0), 99).otherwise(30 + 2 * (k % 13))
    threshold = F.when(now & (k % 11 == 0), 77).otherwise(25 + k % 36)
    return expected(S.table(spark, d, "supplier").select(k.alias("job_id"), (40 + k % 3).alias("iou"), eps.alias("eps"), (2 + k % 4).alias("least"), threshold.alias("threshold")), _stages())


_HASHES = """h AS (SELECT *, sha256('{"threshold":' || threshold || '}' || cluster) AS match FROM (SELECT *, sha256('{"eps":' || eps || ',"least":' || least || '}' || detect) AS cluster FROM (SELECT *, sha256('{"iou":' || iou || '}') AS detect FROM (
SELECT s_suppkey AS job_id, 40 + s_suppkey % 3 AS iou, 30 + 2 * (s_suppkey % 13) AS eps, 2 + s_suppkey % 4 AS least, 25 + s_suppkey % 36 AS threshold FROM supplier))))"""


@query(f"WITH {_HASHES} SELECT job_id, unnest(['detect', 'cluster', 'match']) AS stage, unnest([detect, cluster, match]) AS params_hash FROM h")
def params_hash(spark, d):
    return _expected(spark, d, False).drop("position")


@query("""SELECT s_suppkey AS job_id, stage FROM supplier, (VALUES ('detect', 0), ('cluster', 1), ('match', 2)) v(stage, k) WHERE s_suppkey % 5 = 0 OR (s_suppkey % 7 = 0 AND k >= 1) OR (s_suppkey % 11 = 0 AND k >= 2)""")
def stages_due(spark, d):
    """Results of four of five jobs were written with earlier parameters; what has to run now."""
    scratch = Scratch(spark, "stages-due")
    store, before = StageStore(spark, f"{scratch.root}/store"), _expected(spark, d, False).where("job_id % 5 <> 0")
    found = scratch.cut(S.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("job_id"), "l_orderkey").distinct(), "found")
    for stage in _stages():
        store.write(stage, found, before.where(F.col("stage") == stage).select("job_id", "params_hash"))
    return due(_expected(spark, d, True), store.manifest()).select("job_id", "stage")


@query("""WITH f AS (SELECT s_suppkey AS frame, (600 + s_suppkey * 37 % 3000)::INT AS w, (480 + s_suppkey * 53 % 2000)::INT AS h FROM supplier),
x AS (SELECT DISTINCT frame, w, h, unnest(list_append(range(0, greatest(w - 1280, 0) + 1, 1024), greatest(w - 1280, 0))) AS x FROM f), y AS (SELECT DISTINCT frame, unnest(list_append(range(0, greatest(h - 1280, 0) + 1, 1024), greatest(h - 1280, 0))) AS y FROM f)
SELECT frame, x::INT AS x, y::INT AS y, least(x + 1280, w)::INT AS x2, least(y + 1280, h)::INT AS y2 FROM x JOIN y USING (frame)""")
def tile_grid(spark, d):
    """Tiles of frames of many sizes; a supplier stands for a frame."""
    k = F.col("s_suppkey")
    frames = S.table(spark, d, "supplier").select(k.alias("frame"), (600 + k * 37 % 3000).cast("int").alias("w"), (480 + k * 53 % 2000).cast("int").alias("h"))
    rows = frames.select("frame", "w", "h", F.explode(G.origins(F.col("w"), 1280, 256)).alias("x")).select("*", F.explode(G.origins(F.col("h"), 1280, 256)).alias("y"))
    return rows.select("frame", "x", "y", F.least(F.col("x") + 1280, "w").alias("x2"), F.least(F.col("y") + 1280, "h").alias("y2"))


_CODES = reviews.OUTCOMES.replace("WHEN status = 'committed' AND commit_request = request_id THEN", "WHEN status = 'committed' AND commit_request = request_id AND session_id % 4 = 0 THEN 'audit_log_missing' WHEN status = 'committed' AND commit_request = request_id THEN").replace(
    "WHEN unenrolled > 0 THEN", "WHEN session_id % 6 = 1 THEN 'draft_not_ready' WHEN unenrolled > 0 THEN"
)


@query(f"WITH {reviews.SESSIONS}, {_CODES} SELECT * FROM outcomes")
def commit_codes(spark, d):
    """Commit requests where some sessions have no finished job yet and some commits are missing in the audit log."""
    t = reviews._tables(spark, d)
    ids = t["sessions"].select("session_id")
    return R.commit_outcomes(t["requests"], t["sessions"], t["roster"], t["bands"], t["decisions"], ids.where("session_id % 6 <> 1"), ids.where("session_id % 4 <> 0"))


_STATES = "CASE class_session_id % 4 WHEN 1 THEN 'awaiting_review' ELSE 'committed' END"


@query(f"""WITH {LEDGER}, st AS (SELECT DISTINCT class_session_id AS session_id, {_STATES} AS state FROM ledger WHERE class_session_id % 8 <> 6),
rq AS (SELECT 10000000 + o_orderkey AS id, (o_custkey + CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 0 END) % 25 AS session_id, o_custkey AS student_id, CASE WHEN o_orderkey % 2 = 0 THEN 'present' ELSE 'absent' END AS status FROM orders),
told AS (SELECT rq.*, state, tip.id AS tip, tip.status AS was, lag(rq.status) OVER w AS before FROM rq LEFT JOIN st USING (session_id) LEFT JOIN tip ON tip.class_session_id = rq.session_id AND tip.student_id = rq.student_id WINDOW w AS (PARTITION BY rq.session_id, rq.student_id ORDER BY rq.id)),
out AS (SELECT *, CASE WHEN state IS NULL THEN 'session_not_found' WHEN state <> 'committed' THEN 'not_committed' WHEN tip IS NULL THEN 'attendance_not_found' WHEN status = coalesce(before, was) THEN 'no_change' ELSE 'corrected' END AS outcome FROM told)
SELECT id, session_id, student_id, status, outcome, CASE WHEN outcome = 'corrected' THEN coalesce(max(CASE WHEN outcome = 'corrected' THEN id END) OVER (PARTITION BY session_id, student_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), tip) END AS supersedes_id FROM out""")
def correction_codes(spark, d):
    """A correction for every order, several for most students; some sessions aren't known or committed, some students are not in the session."""
    ledger = S.ledger(spark, d).withColumnRenamed("class_session_id", "session_id")
    sessions = ledger.select("session_id").distinct().where("session_id % 8 <> 6").select("session_id", F.when(F.col("session_id") % 4 == 1, "awaiting_review").otherwise("committed").alias("status"))
    o, k = S.table(spark, d, "orders"), F.col("o_orderkey")
    asked = o.select((k + 10_000_000).alias("id"), ((F.col("o_custkey") + F.when(k % 9 == 0, 1).otherwise(0)) % 25).alias("session_id"), F.col("o_custkey").alias("student_id"), F.when(k % 2 == 0, "present").otherwise("absent").alias("status"))
    return L.correction_outcomes(asked, sessions, ledger)


@query("WITH last AS (SELECT l_orderkey AS upload_id, l_linenumber AS chunk, arg_max(l_partkey, (l_shipdate, l_partkey)) AS part FROM lineitem GROUP BY ALL) SELECT upload_id, count(*) AS n_chunks, sum(length(part::VARCHAR || ';'))::BIGINT AS n_bytes, sha256(string_agg(part || ';', '' ORDER BY chunk)) AS sha256 FROM last GROUP BY 1")
def concatenated_uploads(spark, d):
    chunks = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").alias("chunk"), F.struct("l_shipdate", "l_partkey").alias("sent"), F.concat(F.col("l_partkey").cast("string"), F.lit(";")).cast("binary").alias("data"))
    return I.concatenated(chunks)


@query(f"""WITH {CONSENT}, gone AS (SELECT student_id FROM latest WHERE state = 'revoked')
SELECT student_id, t AS "table", count(user_id) AS removed, (SELECT count(*) FROM events WHERE event_type = t AND user_id NOT IN (FROM gone)) AS remaining FROM gone CROSS JOIN (VALUES ('view'), ('click')) v(t) LEFT JOIN events ON user_id = student_id AND event_type = t GROUP BY ALL""")
def erased_files(spark, d):
    """Events of two kinds as tables of files, from which the rows of people without consent are erased; a second run finds nothing."""
    root, e = f"{shared_dir(spark).rstrip('/')}/erased-{uuid.uuid4().hex}", S.table(spark, d, "events")
    tables = {kind: ErasableTable(spark, f"{root}/{kind}") for kind in ("view", "click")}
    for kind, table in tables.items():
        table.append(e.where(F.col("event_type") == kind).select(F.col("user_id").alias("student_id"), "event_id").repartitionByRange(8, "student_id"))
    gone = L.latest_consent(S.consents(spark, d)).where("state = 'revoked'").select("student_id")
    counts, again = erase_student(tables, gone), erase_student(tables, gone)
    left = None
    for kind, table in tables.items():
        n = table.read().agg(F.count("*").alias("remaining")).withColumn("table", F.lit(kind))
        left = n if left is None else left.union(n)
    both = counts.join(again.select("student_id", "table", F.col("removed").alias("more")), ["student_id", "table"])
    return both.join(F.broadcast(left), "table").select("student_id", "table", (F.col("removed") + F.col("more")).alias("removed"), "remaining")


@query(f"WITH {reviews.SESSIONS}, {reviews.OUTCOMES} SELECT request_id, session_id::BIGINT AS session_id, student_id, status, source, round(confidence, 6) AS confidence FROM records")
def streamed_commits(spark, d):
    """Requests that come in files, each twice in one run and again in another; every session is committed once, as in one batch."""
    root, t = f"{shared_dir(spark).rstrip('/')}/commits-{uuid.uuid4().hex}", reviews._tables(spark, d)
    asked = Scratch(spark, "requests").cut(t["requests"].select("request_id", F.col("session_id").cast("long").alias("session_id")), "requests")
    stream = CommitStream(spark, root, t)
    for _ in range(2):
        asked.union(asked).write.mode("append").json(f"{root}/inbox")
        stream.run(f"{root}/inbox")
    return stream.records().select("request_id", "session_id", "student_id", "status", "source", F.round("confidence", 6).alias("confidence"))


def _variant(name: str, match: str) -> str:
    return f"(SELECT '{name}' AS variant, job AS job_id, decision, count(*) AS n FROM ({match} SELECT * FROM banded) GROUP BY ALL)"


_REPS = oracles._means("r2", "(SELECT * FROM g2 WHERE gid IS NOT NULL)", "gid", "greatest(quality_score, 1e-6)")


@query(f"""{_variant('none', oracles.SESSION_MATCH)} UNION ALL {_variant('temporal-coherence-off', oracles.SESSION_MATCH.replace('(SELECT * FROM g2 WHERE gid IS NOT NULL)', 'g0'))}
UNION ALL {_variant('quality-weighting-off', oracles.SESSION_MATCH.replace(_REPS, oracles._means('r2', '(SELECT * FROM g2 WHERE gid IS NOT NULL)', 'gid', '1.0')))}""")
def match_variants(spark, d):
    """Decisions of each session as they are, without the passes by time, and with plain means of clusters."""
    scratch, crops, p = Scratch(spark, "variants"), S.session_crops(spark, d), S.SESSION_PARAMS
    off = scratch.cut(C.dbscan(crops, p.eps, p.min_samples, JOB).drop("core"), "off")
    on, gallery = scratch.cut(C.coherent(crops, off, p, JOB), "on"), scratch.cut(S.session_gallery(spark, d), "gallery")
    keys = ["job_id", "cluster_id"]
    plain = C.mean_vectors(crops.join(on.where("cluster_id >= 0").select("det_id", "cluster_id"), "det_id"), keys).withColumnRenamed("mean", "representative")
    reps = {"none": C.summarize(crops, on, JOB), "temporal-coherence-off": C.summarize(crops, off, JOB), "quality-weighting-off": plain}
    out = None
    for name, rows in reps.items():
        n = N.matched(rows, gallery, p, JOB).groupBy(F.lit(name).alias("variant"), "job_id", "decision").agg(F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out
