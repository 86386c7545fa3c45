"""Queries of intake, draft rosters, review and commits, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum_spark.operators import intake as I
from quorum_spark.operators import ledger as L
from quorum_spark.operators import roster as R
from quorum_spark.params import PipelineParams
from quorum_spark.plans import stand_ins as S
from quorum_spark.plans.oracles import BUCKET, CONSENT, DET, LEDGER

QUERIES, SQL = {}, {}
P = PipelineParams()
#: Stand-ins in SQL: students of sessions (one per nation), sessions, bands and decisions from orders.
SESSIONS = """students AS (SELECT c_custkey AS student_id, c_name AS name, 'R' || c_custkey AS roll_number FROM customer),
roster AS (SELECT c_nationkey AS session_id, c_custkey AS student_id FROM customer WHERE c_nationkey IS NOT NULL),
sessions AS (SELECT n_nationkey AS session_id, CASE n_regionkey % 4 WHEN 0 THEN 'committed' WHEN 3 THEN 'processing' ELSE 'awaiting_review' END AS status, CASE WHEN n_regionkey % 4 = 0 THEN 'r' || (n_nationkey % 3) END AS commit_request FROM nation),
bands AS (SELECT session_id, student_id, o_orderkey AS cluster_id, o_totalprice / 1000000 AS similarity, CASE WHEN o_totalprice > 300000 THEN 'confident' WHEN o_totalprice < 3000 THEN 'uncertain' ELSE 'unmatched' END AS decision
  FROM orders JOIN roster ON o_custkey = student_id WHERE o_orderstatus = 'F'),
requests AS (SELECT DISTINCT 'r' || (s_suppkey % 3) AS request_id, s_nationkey + CASE WHEN s_suppkey % 17 = 0 THEN 100 ELSE 0 END AS session_id FROM supplier),
decisions AS (SELECT 'r' || (o_orderkey % 3) AS request_id, session_id, student_id, CASE WHEN o_totalprice > 150000 THEN 'present' ELSE 'absent' END AS status, 'teacher_override' AS source, o_orderkey AS ordinal FROM orders JOIN roster ON o_custkey = student_id WHERE o_orderstatus = 'P'
  UNION ALL SELECT r, session_id, student_id, 'present', 'teacher_confirmed', cluster_id FROM bands, (VALUES ('r0'), ('r1')) v(r) WHERE decision = 'uncertain'
  UNION ALL SELECT 'r0', (o_custkey % 25)::INT, o_custkey, 'present', 'teacher_override', o_orderkey FROM orders WHERE o_orderkey % 997 = 0)"""
OUTCOMES = """asked AS (SELECT DISTINCT request_id, session_id, student_id FROM decisions),
un AS (SELECT request_id, session_id, count(*) AS unenrolled FROM asked ANTI JOIN roster USING (session_id, student_id) GROUP BY ALL),
unc AS (SELECT DISTINCT session_id, student_id FROM bands WHERE decision = 'uncertain'),
und AS (SELECT request_id, session_id, count(*) AS undecided FROM requests JOIN unc USING (session_id) ANTI JOIN asked USING (request_id, session_id, student_id) GROUP BY ALL),
coded AS (SELECT request_id, session_id, coalesce(unenrolled, 0) AS unenrolled, coalesce(undecided, 0) AS undecided, CASE WHEN status IS NULL THEN 'session_not_found' WHEN status = 'committed' AND commit_request = request_id THEN 'idempotent_replay' WHEN status = 'committed' THEN 'already_committed'
  WHEN status <> 'awaiting_review' THEN 'not_awaiting_review' WHEN unenrolled > 0 THEN 'decision_for_unenrolled_student' WHEN undecided > 0 THEN 'needs_review_incomplete' END AS code
  FROM requests LEFT JOIN sessions USING (session_id) LEFT JOIN un USING (request_id, session_id) LEFT JOIN und USING (request_id, session_id)),
outcomes AS (SELECT request_id, session_id, coalesce(code, CASE WHEN row_number() OVER (PARTITION BY session_id, code IS NULL ORDER BY request_id) = 1 THEN 'committed' ELSE 'already_committed' END) AS outcome, unenrolled, undecided FROM coded),
given AS (SELECT * FROM decisions QUALIFY row_number() OVER (PARTITION BY request_id, session_id, student_id ORDER BY ordinal DESC) = 1),
sure AS (SELECT session_id, student_id, max(similarity) AS similarity FROM bands WHERE decision = 'confident' GROUP BY ALL),
records AS (SELECT o.request_id, o.session_id, r.student_id, coalesce(g.status, CASE WHEN similarity IS NOT NULL THEN 'present' ELSE 'absent' END) AS status, coalesce(source, 'auto') AS source, CASE WHEN g.status IS NULL THEN similarity END AS confidence
  FROM outcomes o JOIN roster r ON o.session_id = r.session_id LEFT JOIN given g ON (g.request_id, g.session_id, g.student_id) = (o.request_id, o.session_id, r.student_id) LEFT JOIN sure s ON (s.session_id, s.student_id) = (o.session_id, r.student_id) WHERE outcome = 'committed')"""


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    c, n, o, s = (S.table(spark, d, t) for t in ("customer", "nation", "orders", "supplier"))
    roster = c.where("c_nationkey is not null").select(F.col("c_nationkey").alias("session_id"), F.col("c_custkey").alias("student_id"))
    kind = F.col("n_regionkey") % 4
    price = F.col("o_totalprice")
    own = o.join(roster, o.o_custkey == roster.student_id)
    bands = own.where("o_orderstatus = 'F'").select(
        "session_id", "student_id", F.col("o_orderkey").alias("cluster_id"), (price / 1000000).alias("similarity"), F.when(price > 300000, "confident").when(price < 3000, "uncertain").otherwise("unmatched").alias("decision")
    )
    request = lambda c: F.concat(F.lit("r"), (F.col(c) % 3).cast("string"))
    taken = own.where("o_orderstatus = 'P'").select(request("o_orderkey").alias("request_id"), "session_id", "student_id", F.when(price > 150000, "present").otherwise("absent").alias("status"), F.lit("teacher_override").alias("source"), F.col("o_orderkey").alias("ordinal"))
    yes = bands.where("decision = 'uncertain'").select(F.explode(F.array(F.lit("r0"), F.lit("r1"))).alias("request_id"), "session_id", "student_id", F.lit("present").alias("status"), F.lit("teacher_confirmed").alias("source"), F.col("cluster_id").alias("ordinal"))
    stray = o.where("o_orderkey % 997 = 0").select(F.lit("r0").alias("request_id"), (F.col("o_custkey") % 25).cast("int").alias("session_id"), F.col("o_custkey").alias("student_id"), F.lit("present").alias("status"), F.lit("teacher_override").alias("source"), F.col("o_orderkey").alias("ordinal"))
    return {
        "students": c.select(F.col("c_custkey").alias("student_id"), F.col("c_name").alias("name"), F.concat(F.lit("R"), F.col("c_custkey").cast("string")).alias("roll_number")),
        "roster": roster,
        "sessions": n.select(F.col("n_nationkey").alias("session_id"), F.when(kind == 0, "committed").when(kind == 3, "processing").otherwise("awaiting_review").alias("status"), F.when(kind == 0, request("n_nationkey")).alias("commit_request")),
        "bands": bands,
        "requests": s.select(request("s_suppkey").alias("request_id"), (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 17 == 0, 100).otherwise(0)).alias("session_id")).distinct(),
        "decisions": taken.unionByName(yes).unionByName(stray),
    }


def _outcomes(t: dict[str, DataFrame]) -> DataFrame:
    return R.commit_outcomes(t["requests"], t["sessions"], t["roster"], t["bands"], t["decisions"])


@query(f"WITH {SESSIONS}, {OUTCOMES} SELECT * FROM outcomes")
def commit_outcomes(spark, d):
    return _outcomes(_tables(spark, d))


@query(f"WITH {SESSIONS}, {OUTCOMES} SELECT * REPLACE (round(confidence, 6) AS confidence) FROM records")
def committed_records(spark, d):
    t = _tables(spark, d)
    return R.committed_records(_outcomes(t), t["roster"], t["bands"], t["decisions"]).withColumn("confidence", F.round("confidence", 6))


@query(f"""WITH {SESSIONS}, {OUTCOMES}, {LEDGER}, now AS (SELECT class_session_id AS session_id, count(*) AS total, count(*) FILTER (status = 'present') AS present, count(*) FILTER (status = 'absent') AS absent FROM tip GROUP BY 1)
SELECT request_id, session_id, coalesce(total, 0) AS total, coalesce(present, 0) AS present, coalesce(absent, 0) AS absent FROM outcomes LEFT JOIN now USING (session_id) WHERE outcome = 'idempotent_replay'""")
def replay_counts(spark, d):
    return R.replay_counts(_outcomes(_tables(spark, d)), S.ledger(spark, d).withColumnRenamed("class_session_id", "session_id"))


@query(f"""WITH {SESSIONS}, {OUTCOMES} SELECT session_id::VARCHAR AS subject_id, 'roster.commit' AS action, '{{"request_id":"' || request_id || '","counts":{{"total":' || count(*) || ',"present":' || count(*) FILTER (status = 'present') || '}},"params_hash":"' || sha256('{{"eps":0.65,"session":' || session_id || '}}') || '"}}' AS payload
FROM records GROUP BY request_id, session_id""")
def commit_audit(spark, d):
    t = _tables(spark, d)
    rows = R.committed_records(_outcomes(t), t["roster"], t["bands"], t["decisions"])
    counts = rows.groupBy("request_id", "session_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "present").alias("present"))
    params = t["sessions"].select("session_id", F.concat(F.lit('{"eps":0.65,"session":'), F.col("session_id").cast("string"), F.lit("}")).alias("params_json"))
    return R.audit_rows(counts, params)


@query(f"""WITH {SESSIONS}, photos AS (SELECT user_id AS student_id, value AS quality, '/data/photos/' || event_id AS uri FROM events WHERE value IS NOT NULL),
best AS (SELECT student_id, '/media/' || substring(uri, 7) AS photo_url FROM photos QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY quality DESC, uri) = 1),
found AS (SELECT b.session_id, CASE decision WHEN 'confident' THEN 'confident' WHEN 'uncertain' THEN 'needs_review' ELSE 'unrecognised' END AS section, cluster_id, CASE WHEN cluster_id % 2 = 0 THEN '/media/crops/' || cluster_id END AS crop_url,
  CASE WHEN decision <> 'unmatched' THEN b.student_id END AS student_id, similarity FROM bands b),
listed AS (SELECT f.*, name, roll_number FROM found f LEFT JOIN students USING (student_id) UNION ALL BY NAME
  SELECT r.session_id, 'proposed_absent' AS section, r.student_id, name, roll_number FROM roster r ANTI JOIN (SELECT session_id, student_id FROM found WHERE section <> 'unrecognised') f ON f.session_id = r.session_id AND f.student_id = r.student_id JOIN students USING (student_id))
SELECT session_id, section, cluster_id, crop_url, student_id, name, roll_number, round(similarity, 6) AS similarity, round(similarity / 2, 6) AS runner_up, photo_url FROM listed LEFT JOIN best USING (student_id)""")
def draft_roster(spark, d):
    t = _tables(spark, d)
    uri = F.concat(F.when(F.col("cluster_id") % 2 == 0, "/data/crops/").otherwise("s3://x/"), F.col("cluster_id").cast("string"))
    matches = t["bands"].select("cluster_id", F.when(F.col("decision") != "unmatched", F.col("student_id")).alias("student_id"), "similarity", (F.col("similarity") / 2).alias("runner_up"), "decision")
    photos = S.table(spark, d, "events").where("value is not null").select(F.col("user_id").alias("student_id"), F.col("value").alias("quality"), F.concat(F.lit("/data/photos/"), F.col("event_id").cast("string")).alias("uri"))
    out = R.draft_roster(t["bands"].select("session_id", "cluster_id", uri.alias("best_crop")), matches, t["students"], t["roster"], photos)
    return out.withColumns({c: F.round(c, 6) for c in ("similarity", "runner_up")})


@query(f"""WITH {SESSIONS} SELECT session_id, student_id, CASE tap WHEN 'present' THEN 'present' WHEN 'not_found' THEN 'present' ELSE 'absent' END AS status, CASE tap WHEN 'present' THEN 'teacher_confirmed' ELSE 'teacher_override' END AS source, ordinal
FROM (SELECT session_id, student_id, CASE o_orderkey % 5 WHEN 0 THEN 'present' WHEN 1 THEN 'not_them' WHEN 2 THEN 'not_found' WHEN 3 THEN 'confirmed' ELSE 'dismissed' END AS tap, o_orderkey AS ordinal FROM orders JOIN roster ON o_custkey = student_id) WHERE tap <> 'dismissed'""")
def reviewer_decisions(spark, d):
    o, k = S.table(spark, d, "orders"), F.col("o_orderkey") % 5
    roster = _tables(spark, d)["roster"]
    tap = F.when(k == 0, "present").when(k == 1, "not_them").when(k == 2, "not_found").when(k == 3, "confirmed").otherwise("dismissed")
    return R.reviewer_decisions(o.join(roster, o.o_custkey == roster.student_id).select("session_id", "student_id", tap.alias("tap"), F.col("o_orderkey").alias("ordinal")))


@query("SELECT o_orderkey AS job_id, coalesce(s <> 'pass', false) AS warned FROM (SELECT o_orderkey, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 3 < 2 THEN CASE WHEN c_acctbal > 0 THEN 'pass' ELSE 'warn' END END AS s FROM orders LEFT JOIN customer ON o_custkey = c_custkey)")
def preflight_warned(spark, d):
    c = S.table(spark, d, "customer")
    status = F.when(F.col("c_custkey") % 3 < 2, F.to_json(F.struct(F.when(F.col("c_acctbal") > 0, "pass").otherwise("warn").alias("status")))).otherwise(F.lit("not json"))
    uploads = c.where("c_custkey % 5 > 0").select(F.col("c_custkey").alias("upload_id"), status.alias("preflight_json"))
    return R.preflight_warned(S.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("upload_id")), uploads)


@query("SELECT s_suppkey AS session_id, s_nationkey AS course, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def session_courses(spark, d):
    courses = S.table(spark, d, "nation").select(F.col("n_nationkey").alias("course"), F.col("n_name").alias("name"))
    return R.with_course(S.table(spark, d, "supplier").select(F.col("s_suppkey").alias("session_id"), F.col("s_nationkey").alias("course")), courses).select("session_id", "course", "name")


def _biometrics(spark, d):
    e = S.table(spark, d, "events")
    gone = L.latest_consent(S.consents(spark, d)).where("state = 'revoked'").select("student_id")
    pick = lambda t: e.where(F.col("event_type") == t).select(F.col("user_id").alias("student_id"), "event_id")
    means = e.groupBy(F.col("user_id").alias("student_id")).agg(F.avg("value").alias("mean"))
    return R.delete_biometrics(gone, pick("view"), pick("click"), means)


@query(f"WITH {CONSENT} SELECT l.student_id, (SELECT count(*) FROM events e WHERE e.user_id = l.student_id AND e.event_type = 'view') AS vectors, (SELECT count(*) FROM events e WHERE e.user_id = l.student_id AND e.event_type = 'click') AS photos FROM latest l WHERE state = 'revoked'")
def biometric_deletion(spark, d):
    return _biometrics(spark, d)[3]


@query(f"WITH {CONSENT}, m AS (SELECT user_id AS student_id, avg(value) AS mean FROM events GROUP BY 1) SELECT student_id, CASE WHEN student_id NOT IN (SELECT student_id FROM latest WHERE state = 'revoked') THEN round(mean, 6) END AS mean FROM m")
def means_after_deletion(spark, d):
    return _biometrics(spark, d)[2].withColumn("mean", F.round("mean", 6))


@query("SELECT c_nationkey AS course, count(*) AS expected FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1")
def expected_students(spark, d):
    return S.table(spark, d, "customer").where("c_nationkey is not null").groupBy(F.col("c_nationkey").alias("course")).agg(F.count("*").alias("expected"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_upload(spark, d):
    return L.top_rows(S.table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT part, error, count(*) AS n FROM (SELECT o_orderpriority AS part, CASE WHEN o_totalprice / 1000 < 20 THEN 'video_too_short' WHEN o_totalprice / 1000 > 300 THEN 'video_too_long' WHEN least(o_custkey * 2, 4000 - o_custkey) < 1080 THEN 'resolution_too_low' END AS error FROM orders) GROUP BY ALL")
def video_errors(spark, d):
    error = I.video_error(F.col("o_totalprice") / 1000, F.col("o_custkey") * 2, 4000 - F.col("o_custkey"))
    return S.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("part"), error.alias("error")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size % 3 < 2 AS allowed FROM part")
def allowed_extensions(spark, d):
    k = F.col("p_size") % 3
    name = F.concat("p_name", F.when(k == 0, ".MP4").when(k == 1, ".old.mov").otherwise(".mp4.exe"))
    return S.table(spark, d, "part").select("p_partkey", I.allowed_extension(name).alias("allowed"))


@query("WITH last AS (SELECT l_orderkey AS upload_id, l_linenumber AS chunk, arg_max(l_partkey, (l_shipdate, l_partkey)) AS part FROM lineitem GROUP BY ALL) SELECT upload_id, count(*) AS n_chunks, string_agg(part::VARCHAR, ',' ORDER BY chunk) AS parts FROM last GROUP BY 1")
def assembled_chunks(spark, d):
    chunks = S.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").alias("chunk"), F.struct("l_shipdate", "l_partkey").alias("sent"), F.col("l_partkey").alias("part"))
    return I.assembled(chunks).withColumn("parts", F.array_join(F.transform("parts", lambda x: x.cast("string")), ","))


@query("SELECT c_custkey AS student_id, coalesce(price, c_acctbal) AS balance FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def upserted_balances(spark, d):
    old = S.table(spark, d, "customer").select(F.col("c_custkey").alias("student_id"), F.col("c_acctbal").alias("balance"))
    new = S.table(spark, d, "orders").select(F.col("o_custkey").alias("student_id"), F.col("o_totalprice").alias("balance"), F.col("o_orderkey").alias("ordinal"))
    return I.upserted(old, new, "student_id")


@query(f"""WITH {DET}, c AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, greatest(0, least(trunc(x1)::INT, 560)) AS x1, greatest(0, least(trunc(y1)::INT, 380)) AS y1, greatest(0, least(trunc(x2)::INT, 560)) AS x2, greatest(0, least(trunc(y2)::INT, 380)) AS y2, w, blur, score FROM det)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, w, x1, y1, x2, y2, x2 > x1 AND y2 > y1 AS valid, CASE WHEN x2 > x1 AND y2 > y1 THEN blur ELSE 0 END AS blur, CASE WHEN x2 > x1 AND y2 > y1 THEN round(score, 6) ELSE 0 END AS score FROM c""")
def clipped_crops(spark, d):
    return I.clipped(S.detections(spark, d), 560, 380).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "w", "x1", "y1", "x2", "y2", "valid", "blur", F.round("score", 6).alias("score"))


_ENROLLED = f"""one AS (SELECT l_orderkey AS k FROM det GROUP BY 1 HAVING count(*) = 1),
crops AS (SELECT *, {BUCKET} AS bucket, (least(w / 150, 1) + least(blur / 300, 1) + greatest(0, 1 - abs(yaw) / 35)) / 3 AS quality FROM turned WHERE l_orderkey IN (FROM one) AND w >= 50 AND abs(yaw) <= 35 AND abs(pitch) <= 25 AND blur >= 90 AND brightness BETWEEN 40 AND 215)"""


def _enrolled(spark, d):
    from quorum_spark.operators.detections import gate

    return I.enrolment_crops(gate(S.detections(spark, d), P), "l_orderkey", P)


@query(f"WITH {DET}, {_ENROLLED} SELECT l_orderkey, l_suppkey, bucket, round(quality, 6) AS quality FROM crops")
def enrolment_crops(spark, d):
    return _enrolled(spark, d).select("l_orderkey", "l_suppkey", "bucket", F.round("quality", 6).alias("quality"))


@query(f"""WITH {DET}, {_ENROLLED}, n AS (SELECT l_suppkey, count(*) FILTER (bucket = 'left') AS "left", count(*) FILTER (bucket = 'frontal') AS frontal, count(*) FILTER (bucket = 'right') AS "right", count(*) AS total FROM crops GROUP BY 1)
SELECT *, concat_ws(';', CASE WHEN total < 5 THEN 'only ' || total || ' usable crops' END, CASE WHEN "left" = 0 THEN 'no left crops' END, CASE WHEN frontal = 0 THEN 'no frontal crops' END, CASE WHEN "right" = 0 THEN 'no right crops' END) AS warnings FROM n""")
def enrolment_summary(spark, d):
    return I.enrolment_summary(_enrolled(spark, d), "l_suppkey", P).withColumn("warnings", F.array_join("warnings", ";"))


@query(f"WITH {DET}, num AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, x1, y1, w) AS o FROM det) SELECT frame_index, o AS ordinal, round(w * w, 6) AS area FROM num QUALIFY row_number() OVER (PARTITION BY frame_index ORDER BY round(w * w, 6) DESC, o) = 1")
def largest_face(spark, d):
    from quorum_spark.plans.registry import boxes

    return I.largest_face(boxes(spark, d), "frame_index", "ordinal").select("frame_index", "ordinal", F.round("area", 6).alias("area"))


@query(f"""WITH {DET}, num AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, x1, y1, w) AS o FROM det),
passes AS (SELECT frame_index, o, l_partkey % 3 = 0 AS grown, x1, y1, x2, y2, score FROM num),
fr AS (SELECT frame_index, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}} ORDER BY score DESC, grown, o) AS l FROM passes GROUP BY frame_index),
kept AS (SELECT frame_index, list_reduce(list_transform(l, lambda x: [x]), lambda acc, d: CASE WHEN len(list_filter(acc, lambda k:
  greatest(0, least(k.x2, d[1].x2) - greatest(k.x1, d[1].x1)) * greatest(0, least(k.y2, d[1].y2) - greatest(k.y1, d[1].y1))
  / ((k.x2 - k.x1) * (k.y2 - k.y1) + (d[1].x2 - d[1].x1) * (d[1].y2 - d[1].y1) - greatest(0, least(k.x2, d[1].x2) - greatest(k.x1, d[1].x1)) * greatest(0, least(k.y2, d[1].y2) - greatest(k.y1, d[1].y1))) >= 0.4)) > 0
  THEN acc ELSE list_concat(acc, d) END) AS k FROM fr),
out AS (SELECT frame_index, unnest(k) AS b, generate_subscripts(k, 1) - 1 AS k FROM kept)
SELECT frame_index, k, b.x1 AS x1, b.y1 AS y1, round(b.score, 6) AS score FROM out WHERE round(b.score, 6) >= 0.6""")
def tiled_detections(spark, d):
    """Two of three boxes as a tile's, moved by its place; the others as the whole frame's at half its size."""
    from quorum_spark.plans.registry import boxes

    rows = boxes(spark, d)
    tile = {"tile_x": ((F.col("l_suppkey") % 3) * 128).cast("double"), "tile_y": ((F.col("l_suppkey") % 2) * 64).cast("double")}
    tiles = rows.where("l_partkey % 3 <> 0").withColumns(tile).withColumns({c: F.col(c) - F.col(f"tile_{c[0]}") for c in ("x1", "y1", "x2", "y2")})
    whole = rows.where("l_partkey % 3 = 0").withColumns({c: F.col(c) * 0.5 for c in ("x1", "y1", "x2", "y2")})
    rounded = lambda t: t.withColumn("score", F.round("score", 6))
    return I.tiled(rounded(tiles), rounded(whole), 0.5, P).select("frame_index", "k", "x1", "y1", "score")
