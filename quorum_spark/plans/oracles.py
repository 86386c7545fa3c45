"""DuckDB SQL of the analytics queries, by name."""

CROPS = """crops AS (SELECT vec_id AS det_id, (vec_id % 240)::INT AS frame_index, ((vec_id * 7919) % 1000 + 1) / 1000.0::DOUBLE AS quality_score, embedding::DOUBLE[] AS v, label FROM embeddings)"""


def _dbscan(eps: float = 0.65, m: int = 3, p: str = "") -> str:
    """Density clustering as common table expressions, named with a suffix."""
    return f"""pairs{p} AS (SELECT a.det_id AS i, b.det_id AS j, 1 - list_dot_product(a.v, b.v) AS d FROM crops a JOIN crops b ON a.det_id < b.det_id WHERE 1 - list_dot_product(a.v, b.v) <= {eps}),
met{p} AS (SELECT i AS a, j AS b FROM pairs{p} UNION ALL SELECT j, i FROM pairs{p}),
core{p} AS (SELECT det_id FROM crops LEFT JOIN met{p} ON a = det_id GROUP BY det_id HAVING count(a) + 1 >= {m}),
edges{p} AS (SELECT a, b FROM met{p} WHERE a IN (FROM core{p}) AND b IN (FROM core{p})),
reach{p}(node, seen) AS (SELECT det_id, det_id FROM core{p} UNION SELECT e.b, r.seen FROM reach{p} r JOIN edges{p} e ON e.a = r.node WHERE r.seen < e.b),
root{p} AS (SELECT node, min(seen) AS root FROM reach{p} GROUP BY node),
num{p} AS (SELECT node AS det_id, (dense_rank() OVER (ORDER BY root) - 1)::INT AS cluster_id FROM root{p}),
border{p} AS (SELECT a AS det_id, min(cluster_id) AS near FROM met{p} JOIN num{p} ON b = num{p}.det_id GROUP BY a),
labels{p} AS (SELECT det_id, coalesce(cluster_id, near, -1) AS cluster_id, cluster_id IS NOT NULL AS core FROM crops LEFT JOIN num{p} USING (det_id) LEFT JOIN border{p} USING (det_id))"""


LABELS = f"WITH RECURSIVE {CROPS}, {_dbscan()}"
MEMBERS = "members AS (SELECT * FROM crops JOIN labels USING (det_id) WHERE cluster_id >= 0)"


def _means(name: str, rows: str, key: str, weight: str) -> str:
    return f"""{name}_flat AS (SELECT {key}, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos, {weight} AS w FROM {rows}),
{name}_raw AS (SELECT {key}, pos, sum(x * w) / sum(w) AS x FROM {name}_flat GROUP BY ALL),
{name} AS (SELECT {key}, pos, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY {key})), 1e-12) AS x FROM {name}_raw),
{name}_v AS (SELECT {key}, list(x ORDER BY pos) AS r FROM {name} GROUP BY {key})"""


REPS = _means("reps", "members", "cluster_id", "greatest(quality_score, 1e-6)")
GALLERY = _means("gal", "crops", "label", "1.0")
TIGHT = """tight AS (SELECT a.cluster_id, sum(list_dot_product(a.v, b.v)) / count(*) AS t FROM members a JOIN members b ON a.cluster_id = b.cluster_id AND a.det_id <> b.det_id GROUP BY a.cluster_id)"""
SUMMARY = """summary AS (SELECT cluster_id, count(*) AS member_count, avg(quality_score) AS mean_quality, min(frame_index) AS first_frame, max(frame_index) AS last_frame,
  arg_max(det_id, (quality_score, -det_id)) AS best_det FROM members GROUP BY cluster_id)"""
SIMS = "sims AS (SELECT cluster_id, label AS student_id, list_dot_product(reps_v.r, gal_v.r) AS similarity FROM reps_v CROSS JOIN gal_v)"
MATCH = f"{LABELS}, {MEMBERS}, {REPS}, {GALLERY}, {SIMS}"
MERGE = """medges AS (SELECT a.cluster_id AS a, b.cluster_id AS b, 1 - list_dot_product(ra.r, rb.r) AS distance,
  greatest(0, least(a.last_frame, b.last_frame) - greatest(a.first_frame, b.first_frame) + 1) / least(a.last_frame - a.first_frame + 1, b.last_frame - b.first_frame + 1)::DOUBLE AS overlap
  FROM summary a JOIN summary b ON a.cluster_id < b.cluster_id JOIN reps_v ra ON ra.cluster_id = a.cluster_id JOIN reps_v rb ON rb.cluster_id = b.cluster_id
  WHERE 1 - list_dot_product(ra.r, rb.r) < 0.65 * 1.1),
mfound AS (SELECT * FROM medges WHERE overlap >= 0.3)"""
GREEDY = """best AS (SELECT cluster_id, student_id AS mine, similarity AS own FROM sims QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, student_id) = 1),
dec AS (SELECT cluster_id, mine, own AS similarity, max(similarity) FILTER (student_id <> mine) AS runner_up FROM sims JOIN best USING (cluster_id) GROUP BY ALL),
banded AS (SELECT *, CASE WHEN similarity >= 0.25 AND similarity - coalesce(runner_up, 0) >= 0.05 THEN 'confident' WHEN similarity >= 0.25 - 0.05 THEN 'uncertain' ELSE 'unmatched' END AS decision FROM dec)"""
SPANS = """found AS (SELECT cluster_id, (last_frame - first_frame + 1) / (SELECT max(frame_index) + 1 FROM crops)::DOUBLE AS span, t AS tightness FROM summary JOIN tight USING (cluster_id)
  WHERE (last_frame - first_frame + 1) / (SELECT max(frame_index) + 1 FROM crops)::DOUBLE > 0.6 AND t < 0.5)"""

DET = """det0 AS (SELECT l_orderkey // 8 AS frame_index, ((l_partkey * 37) % 600)::DOUBLE AS x1, ((l_suppkey * 53) % 400)::DOUBLE AS y1, 20.0::DOUBLE + 2 * l_quantity AS w,
  0.40::DOUBLE + ((l_partkey * 13 + l_linenumber * 7) % 60) / 100.0::DOUBLE AS score, (l_partkey % 400)::DOUBLE AS blur, ((l_suppkey * 37) % 256)::DOUBLE AS brightness,
  (l_suppkey % 21) - 10 AS a, l_linenumber - 4 AS b, l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem),
det AS (SELECT *, x1 + w AS x2, y1 + w AS y2 FROM det0),
posed AS (SELECT *, x1 + 0.3::DOUBLE * w AS lx1, y1 + 0.35::DOUBLE * w AS ly1, x1 + 0.7::DOUBLE * w AS lx2, x1 + (0.5::DOUBLE + a * 0.03::DOUBLE) * w AS nx, y1 + (0.55::DOUBLE + b * 0.06::DOUBLE) * w AS ny, y1 + 0.75::DOUBLE * w AS my FROM det),
turned AS (SELECT *, least(greatest(65.0::DOUBLE * (nx - (lx1 + lx2) / 2) / (lx2 - lx1), -90.0), 90.0)::DOUBLE AS yaw, least(greatest(65.0::DOUBLE * (ny - (ly1 + my) / 2) / (lx2 - lx1), -90.0), 90.0)::DOUBLE AS pitch FROM posed),
gated AS (SELECT *, 0.4::DOUBLE * least(w / 150, 1) + 0.3::DOUBLE * least(blur / 300, 1) + 0.3::DOUBLE * (greatest(0, 1 - abs(yaw) / 35) + greatest(0, 1 - abs(pitch) / 25)) / 2 AS quality_score,
  CASE WHEN score < 0.6::DOUBLE THEN 'low_detector_score' WHEN w < 50 THEN 'too_small' WHEN blur < 90 THEN 'too_blurred' WHEN abs(yaw) > 35 THEN 'yaw_too_extreme' WHEN abs(pitch) > 25 THEN 'pitch_too_extreme'
    WHEN brightness < 40 OR brightness > 215 THEN 'bad_brightness' ELSE 'ok' END AS reason FROM turned)"""
BUCKET = "CASE WHEN yaw < -15 THEN 'left' WHEN yaw > 15 THEN 'right' ELSE 'frontal' END"
CONSENT = "consents AS (SELECT event_id AS id, user_id AS student_id, ts, event_type FROM events WHERE event_type IN ('signup', 'error')), latest AS (SELECT student_id, id, CASE WHEN event_type = 'error' THEN 'revoked' ELSE 'valid' END AS state FROM consents QUALIFY row_number() OVER (PARTITION BY student_id ORDER BY ts DESC, id DESC) = 1)"
LEDGER = "ledger AS (SELECT o_orderkey AS id, o_custkey % 25 AS class_session_id, o_custkey AS student_id, CASE WHEN o_orderstatus = 'F' THEN 'present' ELSE 'absent' END AS status, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS supersedes_id FROM orders), tip AS (SELECT * FROM ledger l WHERE NOT EXISTS (SELECT 1 FROM ledger n WHERE n.supersedes_id = l.id))"
REVIEW = """r AS (SELECT c_nationkey AS course, c_custkey AS student_id FROM customer WHERE c_nationkey IS NOT NULL),
given AS (SELECT o_custkey AS student_id, CASE WHEN o_totalprice > 150000 THEN 'present' ELSE 'absent' END AS status, CASE WHEN o_totalprice > 150000 THEN 'teacher_confirmed' ELSE 'teacher_override' END AS source
  FROM orders WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
sure AS (SELECT o_custkey AS student_id, max(o_totalprice) / 1000000 AS similarity FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
done AS (SELECT course, student_id, coalesce(status, CASE WHEN similarity IS NOT NULL THEN 'present' ELSE 'absent' END) AS status, coalesce(source, 'auto') AS source,
  CASE WHEN status IS NULL THEN similarity END AS confidence, CASE WHEN status IS NOT NULL THEN 42 END AS decided_by FROM r LEFT JOIN given USING (student_id) LEFT JOIN sure USING (student_id))"""
TRUTH = "truth AS (SELECT doc_id, quality = 1 AS actual, n_chars, lang, source, toxic, n_chars >= 1000 AS predicted FROM documents JOIN labels USING (doc_id))"


def _metrics(counts: str) -> str:
    return f"""SELECT * EXCLUDE (pr, re, ac), round(pr, 6) AS precision, round(re, 6) AS recall, round(ac, 6) AS accuracy, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM (
SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS re, (tp + tn) / (tp + fp + fn + tn) AS ac FROM ({counts}))"""


CELLS = "count(*) FILTER (actual AND {p}) AS tp, count(*) FILTER (NOT actual AND {p}) AS fp, count(*) FILTER (actual AND NOT {p}) AS fn, count(*) FILTER (NOT actual AND NOT {p}) AS tn"
SWEPT = _metrics(f"SELECT threshold, {CELLS.format(p='n_chars >= threshold')} FROM truth, (SELECT unnest(range(200, 3200, 200)) AS threshold) GROUP BY threshold")
VOTE = "s AS (SELECT det_id, gal_v.label AS student_id, list_dot_product(v, r) AS similarity FROM crops CROSS JOIN gal_v)"


GRID = "grid AS (SELECT row_number() OVER (ORDER BY e, m) - 1 AS point, e / 100.0::DOUBLE AS eps, m::INT AS min_samples FROM range(30, 55, 2) t(e), range(2, 6) u(m))"
SWEEP = f"""WITH RECURSIVE {CROPS}, {GRID}, pairs AS (SELECT a.det_id AS i, b.det_id AS j, 1 - list_dot_product(a.v, b.v) AS d FROM crops a JOIN crops b ON a.det_id < b.det_id),
met AS (SELECT point, min_samples, i AS a, j AS b FROM pairs JOIN grid ON d <= eps UNION ALL SELECT point, min_samples, j, i FROM pairs JOIN grid ON d <= eps),
core AS (SELECT point, a AS det_id FROM met GROUP BY point, min_samples, a HAVING count(*) + 1 >= min_samples),
edges AS (SELECT met.* FROM met SEMI JOIN core x ON (x.point, x.det_id) = (met.point, a) SEMI JOIN core y ON (y.point, y.det_id) = (met.point, b)),
reach(point, node, seen) AS (SELECT point, det_id, det_id FROM core UNION SELECT r.point, e.b, r.seen FROM reach r JOIN edges e ON e.point = r.point AND e.a = r.node WHERE r.seen < e.b),
root AS (SELECT point, node AS det_id, min(seen) AS root FROM reach GROUP BY ALL),
border AS (SELECT met.point, a AS det_id, min(root) AS near FROM met JOIN root ON (root.point, root.det_id) = (met.point, b) GROUP BY ALL),
labels AS (SELECT g.point, c.det_id, label, coalesce(root, near) AS cluster FROM grid g CROSS JOIN crops c LEFT JOIN root USING (point, det_id) LEFT JOIN border USING (point, det_id)),
n AS (SELECT point, count(*) FILTER (cluster IS NULL) AS noise, count(DISTINCT cluster) AS clusters FROM labels GROUP BY 1),
p AS (SELECT point, sum(best) / sum(every) AS purity FROM (SELECT point, cluster, max(c) AS best, sum(c) AS every FROM (SELECT point, cluster, label, count(*) AS c FROM labels WHERE cluster IS NOT NULL GROUP BY ALL) GROUP BY ALL) GROUP BY 1)
SELECT eps, min_samples, noise, clusters, round(purity, 6) AS purity FROM grid JOIN n USING (point) LEFT JOIN p USING (point)"""


def _jobs(eps: float) -> str:
    """Clusters within each label, as common table expressions."""
    within = _dbscan(eps).replace("ON a.det_id < b.det_id WHERE", "ON a.det_id < b.det_id AND a.label = b.label WHERE").replace("FROM root)", "FROM root JOIN crops ON crops.det_id = node)")
    return f"WITH RECURSIVE {CROPS}, {within.replace('OVER (ORDER BY root)', 'OVER (PARTITION BY label ORDER BY root)')}"


JOBS = f"""{_jobs(0.65)}
SELECT label AS job_id, det_id, cluster_id, core FROM labels JOIN crops USING (det_id) WHERE label IS NOT NULL"""
SPLIT = f"""inside AS (SELECT det_id, cluster_id FROM labels WHERE cluster_id IN (SELECT cluster_id FROM found)),
sm AS (SELECT x.det_id AS a, y.det_id AS b FROM pairs JOIN inside x ON x.det_id = i JOIN inside y ON y.det_id = j WHERE x.cluster_id = y.cluster_id AND d <= {0.95 * 0.65!r} UNION ALL SELECT y.det_id, x.det_id FROM pairs JOIN inside x ON x.det_id = i JOIN inside y ON y.det_id = j WHERE x.cluster_id = y.cluster_id AND d <= {0.95 * 0.65!r}),
score AS (SELECT a AS det_id FROM sm GROUP BY a HAVING count(*) + 1 >= 3), sedges AS (SELECT a, b FROM sm WHERE a IN (FROM score) AND b IN (FROM score)),
sreach(node, seen) AS (SELECT det_id, det_id FROM score UNION SELECT e.b, r.seen FROM sreach r JOIN sedges e ON e.a = r.node WHERE r.seen < e.b),
sroot AS (SELECT node AS det_id, min(seen) AS root FROM sreach GROUP BY node), sborder AS (SELECT a AS det_id, min(root) AS near FROM sm JOIN sroot ON b = sroot.det_id GROUP BY a),
parts AS (SELECT det_id, cluster_id, coalesce(root, near) AS part FROM inside LEFT JOIN sroot USING (det_id) LEFT JOIN sborder USING (det_id)),
several AS (SELECT cluster_id FROM parts GROUP BY 1 HAVING count(DISTINCT part) >= 2),
fresh AS (SELECT cluster_id, part, ((SELECT max(cluster_id) FROM labels) + row_number() OVER (ORDER BY cluster_id, part))::INT AS new FROM (SELECT DISTINCT cluster_id, part FROM parts WHERE part IS NOT NULL AND cluster_id IN (FROM several)))
SELECT det_id, CASE WHEN l.cluster_id IN (FROM several) THEN coalesce(new, -1) ELSE l.cluster_id END AS cluster_id FROM labels l LEFT JOIN parts USING (det_id) LEFT JOIN fresh ON fresh.cluster_id = parts.cluster_id AND fresh.part = parts.part"""
#: All sessions' clusters as whole numbers (session and cluster), merged and split within their session. A label stands for a session.
SESSION_LABELS = f"""{_jobs(0.74)},
g0 AS (SELECT det_id, label AS job, frame_index, quality_score, v, label * 1000000 + cluster_id AS gid FROM labels JOIN crops USING (det_id) WHERE cluster_id >= 0 AND label IS NOT NULL),
{_means("r0", "g0", "gid", "greatest(quality_score, 1e-6)")}, s0 AS (SELECT gid, any_value(job) AS job, min(frame_index) AS f, max(frame_index) AS l FROM g0 GROUP BY gid),
e0 AS (SELECT a.gid AS a, b.gid AS b FROM s0 a JOIN s0 b ON a.job = b.job AND a.gid < b.gid JOIN r0_v ra ON ra.gid = a.gid JOIN r0_v rb ON rb.gid = b.gid
  WHERE 1 - list_dot_product(ra.r, rb.r) < 0.74 * 1.1 AND greatest(0, least(a.l, b.l) - greatest(a.f, b.f) + 1) / least(a.l - a.f + 1, b.l - b.f + 1)::DOUBLE >= 0.3),
m0 AS (SELECT a, b FROM e0 UNION ALL SELECT b, a FROM e0),
mr(gid, seen) AS (SELECT gid, gid FROM s0 UNION SELECT m0.b, mr.seen FROM mr JOIN m0 ON m0.a = mr.gid WHERE mr.seen < m0.b),
mn AS (SELECT gid, job * 1000000 + dense_rank() OVER (PARTITION BY job ORDER BY root) - 1 AS new FROM (SELECT gid, min(seen) AS root FROM mr GROUP BY gid) JOIN s0 USING (gid)),
g1 AS (SELECT g0.* REPLACE (new AS gid) FROM g0 JOIN mn USING (gid)),
t1 AS (SELECT a.gid, sum(list_dot_product(a.v, b.v)) / count(*) AS t FROM g1 a JOIN g1 b ON a.gid = b.gid AND a.det_id <> b.det_id GROUP BY a.gid),
loose AS (SELECT gid FROM (SELECT gid, any_value(job) AS job, max(frame_index) - min(frame_index) + 1 AS span FROM g1 GROUP BY gid) JOIN t1 USING (gid)
  JOIN (SELECT label AS job, max(frame_index) + 1 AS total FROM crops GROUP BY label) USING (job) WHERE span / total > 0.6 AND t < 0.5),
inside AS (SELECT det_id, gid FROM g1 WHERE gid IN (FROM loose)),
sp AS (SELECT i, j FROM pairs JOIN inside x ON x.det_id = i JOIN inside y ON y.det_id = j WHERE x.gid = y.gid AND d <= {0.95 * 0.74!r}), sm AS (SELECT i AS a, j AS b FROM sp UNION ALL SELECT j, i FROM sp),
sc AS (SELECT a AS det_id FROM sm GROUP BY a HAVING count(*) + 1 >= 3), se AS (SELECT a, b FROM sm WHERE a IN (FROM sc) AND b IN (FROM sc)),
sr(node, seen) AS (SELECT det_id, det_id FROM sc UNION SELECT se.b, sr.seen FROM sr JOIN se ON se.a = sr.node WHERE sr.seen < se.b),
so AS (SELECT node AS det_id, min(seen) AS root FROM sr GROUP BY node), sb AS (SELECT a AS det_id, min(root) AS near FROM sm JOIN so ON b = so.det_id GROUP BY a),
parts AS (SELECT det_id, gid, coalesce(root, near) AS part FROM inside LEFT JOIN so USING (det_id) LEFT JOIN sb USING (det_id)),
several AS (SELECT gid FROM parts GROUP BY 1 HAVING count(DISTINCT part) >= 2),
fresh AS (SELECT gid, part, gid // 1000000 AS job, row_number() OVER (PARTITION BY gid // 1000000 ORDER BY gid, part) AS place FROM (SELECT DISTINCT gid, part FROM parts WHERE part IS NOT NULL AND gid IN (FROM several))),
top AS (SELECT job, max(gid) AS top FROM g1 GROUP BY job),
g2 AS (SELECT g1.det_id, g1.job, quality_score, v, CASE WHEN g1.gid IN (FROM several) THEN top + place ELSE g1.gid END AS gid FROM g1 JOIN top USING (job) LEFT JOIN parts USING (det_id) LEFT JOIN fresh ON fresh.gid = parts.gid AND fresh.part = parts.part)"""
#: The best total of each session by the sets of students that its clusters have had so far; as many clusters go without as there are too many.
SESSION_MATCH = f"""{SESSION_LABELS}, {_means("r2", "(SELECT * FROM g2 WHERE gid IS NOT NULL)", "gid", "greatest(quality_score, 1e-6)")}, {GALLERY},
own AS (SELECT gal_v.label AS student_id, r, j.label AS job, row_number() OVER (PARTITION BY j.label ORDER BY gal_v.label) - 1 AS bit FROM gal_v, (SELECT label FROM gal_v) j WHERE (gal_v.label * 3 + j.label) % 4 <> 0 AND j.label <> 9),
cl AS (SELECT gid, gid // 1000000 AS job, r, row_number() OVER (PARTITION BY gid // 1000000 ORDER BY gid) AS k, count(*) OVER (PARTITION BY gid // 1000000) AS n FROM r2_v),
sims AS (SELECT cl.job, cl.gid, cl.k, own.student_id, own.bit, list_dot_product(cl.r, own.r) AS s FROM cl JOIN own ON own.job = cl.job),
room AS (SELECT job, greatest(0, any_value(n) - (SELECT count(*) FROM own WHERE own.job = cl.job)) AS spare FROM cl GROUP BY job),
tried(job, k, used, spare, path, total) AS (SELECT job, 0::BIGINT, 0::BIGINT, spare::BIGINT, []::BIGINT[], 0.0::DOUBLE FROM room WHERE job IN (SELECT job FROM own) UNION ALL
  SELECT * FROM (SELECT t.job, t.k + 1, t.used | (1::BIGINT << s.bit) AS used, t.spare, list_append(t.path, s.student_id::BIGINT) AS path, t.total + s.s AS total FROM tried t JOIN sims s ON s.job = t.job AND s.k = t.k + 1 AND t.used & (1::BIGINT << s.bit) = 0
    UNION ALL SELECT t.job, t.k + 1, t.used, t.spare - 1, list_append(t.path, NULL), t.total FROM tried t JOIN cl ON cl.job = t.job AND cl.k = t.k + 1 WHERE t.spare > 0)
  QUALIFY row_number() OVER (PARTITION BY job, used, spare ORDER BY total DESC) = 1),
won AS (SELECT job, arg_max(path, total) AS path FROM tried JOIN (SELECT DISTINCT job, n FROM cl) USING (job) WHERE tried.k = n GROUP BY job),
mine AS (SELECT cl.job, cl.gid, cl.k, path[cl.k] AS student_id FROM cl LEFT JOIN won USING (job)),
dec AS (SELECT m.job, m.gid, m.student_id, max(s.s) FILTER (s.student_id = m.student_id) AS similarity, max(s.s) FILTER (s.student_id <> m.student_id) AS runner_up FROM mine m LEFT JOIN sims s ON s.gid = m.gid GROUP BY ALL),
banded AS (SELECT *, CASE WHEN similarity >= 0.25 AND similarity - coalesce(runner_up, 0) >= 0.05 THEN 'confident' WHEN similarity >= 0.25 - 0.05 THEN 'uncertain' ELSE 'unmatched' END AS decision FROM dec)"""
DECIDED = "SELECT cluster_id, CASE WHEN decision <> 'unmatched' THEN mine END AS student_id, round(similarity, 6) AS similarity, round(runner_up, 6) AS runner_up, decision FROM banded"
PLAIN = _means("plain", "members", "cluster_id", "1.0")


SQL = {
    "eps_pairs": f"{LABELS} SELECT i, j, round(d, 6) AS distance FROM pairs",
    "dbscan_labels": f"{LABELS} SELECT * FROM labels",
    "cluster_summary": f"{LABELS}, {MEMBERS}, {SUMMARY} SELECT * REPLACE (round(mean_quality, 6) AS mean_quality) FROM summary",
    "cluster_tightness": f"{LABELS}, {MEMBERS}, {TIGHT} SELECT cluster_id, round(coalesce(t, 1.0), 6) AS tightness FROM (SELECT DISTINCT cluster_id FROM members) LEFT JOIN tight USING (cluster_id)",
    "weighted_representative": f"{LABELS}, {MEMBERS}, {REPS} SELECT cluster_id, pos, round(x, 6) AS x FROM reps",
    "plain_mean_representative": f"{LABELS}, {MEMBERS}, {_means('plain', 'members', 'cluster_id', '1.0')} SELECT cluster_id, pos, round(x, 6) AS x FROM plain",
    "distance_to_representative": f"{LABELS}, {MEMBERS}, {REPS} SELECT det_id, cluster_id, round(1 - list_dot_product(v, r), 6) AS distance FROM crops JOIN labels USING (det_id) LEFT JOIN reps_v USING (cluster_id)",
    "noise_and_cluster_counts": f"{LABELS} SELECT count(*) FILTER (cluster_id = -1) AS noise, count(DISTINCT cluster_id) FILTER (cluster_id >= 0) AS clusters, count(*) FILTER (core) AS core FROM labels",
    "cluster_sweep": SWEEP,
    "job_labels": JOBS,
    "split_labels": f"{LABELS}, {MEMBERS}, {TIGHT}, {SUMMARY}, {SPANS}, {SPLIT}",
    "session_labels": f"{SESSION_LABELS} SELECT label AS job_id, det_id, coalesce((gid - label * 1000000)::INT, -1) AS cluster_id FROM crops LEFT JOIN g2 USING (det_id) WHERE label IS NOT NULL",
    "hungarian_match": f"{SESSION_MATCH} SELECT job AS job_id, (gid - job * 1000000)::INT AS cluster_id, CASE WHEN decision <> 'unmatched' THEN student_id END AS student_id, round(similarity, 6) AS similarity, round(runner_up, 6) AS runner_up, decision FROM banded",
    "session_summary": f"""{SESSION_MATCH}, per AS (SELECT job, student_id, bool_or(decision = 'confident') AS sure FROM banded WHERE decision <> 'unmatched' GROUP BY ALL),
n AS (SELECT job, count(*) AS enrolled, count(*) FILTER (sure) AS present, count(*) FILTER (NOT sure) AS review, count(*) FILTER (sure IS NULL) AS absent FROM own LEFT JOIN per USING (job, student_id) GROUP BY job),
o AS (SELECT job, count(*) FILTER (decision = 'unmatched') AS unrecognised, avg(similarity) FILTER (decision = 'confident') AS mean_similarity FROM banded GROUP BY job),
c AS (SELECT job, coalesce(enrolled, 0) AS enrolled, coalesce(present, 0) AS present, coalesce(review, 0) AS review, coalesce(absent, 0) AS absent, coalesce(unrecognised, 0) AS unrecognised, mean_similarity, CASE WHEN enrolled > 0 THEN 100.0::DOUBLE * (present + review) / enrolled ELSE 0 END AS coverage FROM n FULL JOIN o USING (job))
SELECT job AS job_id, enrolled, present, review, absent, unrecognised, round(mean_similarity, 6) AS mean_similarity, round(coverage, 6) AS coverage, CASE WHEN coverage < 60 OR coalesce(mean_similarity < 0.45, false) OR job % 5 = 1 THEN 'poor' WHEN coverage < 85 THEN 'fair' ELSE 'good' END AS health FROM c""",
    "ablations": f"""{MATCH}, {PLAIN}, {GREEDY}, psims AS (SELECT cluster_id, label AS student_id, list_dot_product(plain_v.r, gal_v.r) AS similarity FROM plain_v CROSS JOIN gal_v),
pbest AS (SELECT cluster_id, student_id AS mine, similarity AS own FROM psims QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, student_id) = 1),
pdec AS (SELECT cluster_id, own AS similarity, max(similarity) FILTER (student_id <> mine) AS runner_up FROM psims JOIN pbest USING (cluster_id) GROUP BY ALL),
{VOTE}, top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY similarity DESC, student_id) = 1)
SELECT 'votes' AS variant, 'present' AS decision, count(*) AS n FROM (SELECT student_id FROM top WHERE similarity >= 0.3 GROUP BY 1 HAVING count(*) >= 3) UNION ALL SELECT 'weighted', decision, count(*) FROM banded GROUP BY 2
UNION ALL SELECT 'plain', CASE WHEN similarity >= 0.25 AND similarity - coalesce(runner_up, 0) >= 0.05 THEN 'confident' WHEN similarity >= 0.25 - 0.05 THEN 'uncertain' ELSE 'unmatched' END, count(*) FROM pdec GROUP BY 2""",
    "temporal_merge_edges": f"{LABELS}, {MEMBERS}, {REPS}, {SUMMARY}, {MERGE} SELECT a, b, round(distance, 6) AS distance, round(overlap, 6) AS overlap FROM mfound",
    "temporal_merge_labels": f"""{LABELS}, {MEMBERS}, {REPS}, {SUMMARY}, {MERGE}, mboth AS (SELECT a, b FROM mfound UNION ALL SELECT b, a FROM mfound),
mreach(node, seen) AS (SELECT cluster_id, cluster_id FROM summary UNION SELECT e.b, r.seen FROM mreach r JOIN mboth e ON e.a = r.node WHERE r.seen < e.b),
mnew AS (SELECT node, (dense_rank() OVER (ORDER BY min(seen)) - 1)::INT AS n FROM mreach GROUP BY node) SELECT det_id, coalesce(n, -1) AS cluster_id FROM labels LEFT JOIN mnew ON node = cluster_id""",
    "merged_summary": f"""{LABELS}, {MEMBERS}, {REPS}, {SUMMARY}, {MERGE}, mboth AS (SELECT a, b FROM mfound UNION ALL SELECT b, a FROM mfound),
mreach(node, seen) AS (SELECT cluster_id, cluster_id FROM summary UNION SELECT e.b, r.seen FROM mreach r JOIN mboth e ON e.a = r.node WHERE r.seen < e.b),
mnew AS (SELECT node, (dense_rank() OVER (ORDER BY min(seen)) - 1)::INT AS n FROM mreach GROUP BY node), mlabels AS (SELECT det_id, n AS cluster_id FROM labels JOIN mnew ON node = cluster_id), mm AS (SELECT * FROM crops JOIN mlabels USING (det_id)),
mtight AS (SELECT a.cluster_id, sum(list_dot_product(a.v, b.v)) / count(*) AS t FROM mm a JOIN mm b ON a.cluster_id = b.cluster_id AND a.det_id <> b.det_id GROUP BY 1)
SELECT cluster_id, count(*) AS member_count, round(avg(quality_score), 6) AS mean_quality, min(frame_index) AS first_frame, max(frame_index) AS last_frame, arg_max(det_id, (quality_score, -det_id)) AS best_det, round(any_value(coalesce(t, 1.0)), 6) AS tightness FROM mm LEFT JOIN mtight USING (cluster_id) GROUP BY 1""",
    "split_candidates": f"{LABELS}, {MEMBERS}, {TIGHT}, {SUMMARY}, {SPANS} SELECT cluster_id, round(span, 6) AS span, round(tightness, 6) AS tightness FROM found",
    "gallery_means": f"WITH {CROPS}, {GALLERY} SELECT label AS student_id, pos, round(x, 6) AS x FROM gal",
    "similarity_matrix_topk": f"{MATCH} SELECT cluster_id, student_id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, student_id) AS rank FROM sims QUALIFY rank <= 3",
    "runner_up_margin": f"{MATCH}, top AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY similarity DESC, student_id) AS k FROM sims QUALIFY k <= 2) SELECT cluster_id, round(max(similarity) - min(similarity), 6) AS margin FROM top GROUP BY cluster_id",
    "band_decision": f"{MATCH}, {GREEDY} SELECT cluster_id, CASE WHEN decision <> 'unmatched' THEN mine END AS student_id, round(similarity, 6) AS similarity, round(runner_up, 6) AS runner_up, decision FROM banded",
    "lowest_margin_topk": f"{MATCH}, {GREEDY} SELECT cluster_id, round(similarity - runner_up, 6) AS margin FROM banded WHERE decision = 'confident' ORDER BY 2, 1 LIMIT 10",
    "majority_vote": f"WITH {CROPS}, {GALLERY}, {VOTE}, top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY det_id ORDER BY similarity DESC, student_id) = 1), n AS (SELECT student_id, count(*) AS c FROM top WHERE similarity >= 0.3 GROUP BY student_id) SELECT label AS student_id, coalesce(c, 0) AS votes, coalesce(c, 0) >= 3 AS present FROM gal_v LEFT JOIN n ON n.student_id = label",
    "within_between_similarity": f"WITH {CROPS} SELECT label, round(w, 6) AS within, w < 0.55 AS flagged FROM (SELECT a.label, avg(list_dot_product(a.v, b.v)) AS w FROM crops a JOIN crops b ON a.label = b.label AND a.det_id <> b.det_id GROUP BY a.label)",
    "similarity_histogram": f"WITH {CROPS}, {GALLERY}, {VOTE} SELECT least(floor((round(similarity, 9) + 1) / 0.1::DOUBLE), 19)::BIGINT AS bin, count(*) AS n FROM s GROUP BY 1",
    "similarity_percentiles": f"WITH {CROPS}, {GALLERY}, {VOTE} SELECT round(avg(similarity), 6) AS mean, round(quantile_cont(similarity, 0.05), 6) AS p5, round(quantile_cont(similarity, 0.5), 6) AS p50, round(quantile_cont(similarity, 0.95), 6) AS p95 FROM s",
    "nms_boxes": f"""WITH {DET}, num AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, x1, y1, w) AS o FROM det),
fr AS (SELECT frame_index, list({{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score}} ORDER BY score DESC, o) AS l FROM num GROUP BY frame_index),
kept AS (SELECT frame_index, list_reduce(list_transform(l, lambda x: [x]), lambda acc, d: CASE WHEN len(list_filter(acc, lambda k:
  greatest(0, least(k.x2, d[1].x2) - greatest(k.x1, d[1].x1)) * greatest(0, least(k.y2, d[1].y2) - greatest(k.y1, d[1].y1))
  / ((k.x2 - k.x1) * (k.y2 - k.y1) + (d[1].x2 - d[1].x1) * (d[1].y2 - d[1].y1) - greatest(0, least(k.x2, d[1].x2) - greatest(k.x1, d[1].x1)) * greatest(0, least(k.y2, d[1].y2) - greatest(k.y1, d[1].y1))) >= 0.4)) > 0
  THEN acc ELSE list_concat(acc, d) END) AS k FROM fr),
out AS (SELECT frame_index, unnest(k) AS b, generate_subscripts(k, 1) - 1 AS n FROM kept)
SELECT frame_index, frame_index || '_' || n AS det_id, b.x1 AS x1, b.y1 AS y1, round(b.score, 6) AS score FROM out WHERE round(b.score, 6) >= 0.6""",
    "iou_pairs": f"""WITH {DET}, num AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, x1, y1, w) AS o FROM det),
p AS (SELECT a.frame_index, a.o AS i, b.o AS j, a.l_orderkey, a.l_partkey, b.l_orderkey AS o2, b.l_partkey AS p2, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, a.w * a.w + b.w * b.w AS s
  FROM num a JOIN num b ON a.frame_index = b.frame_index AND a.o < b.o)
SELECT frame_index, i, j, l_orderkey, l_partkey, o2, p2, round(inter / (s - inter), 6) AS iou FROM p WHERE round(inter / (s - inter), 6) > 0.3""",
    "width_histogram": f"WITH {DET} SELECT low, low || '-' || (low + 10) AS bucket, count(*) AS n FROM (SELECT (floor(w / 10) * 10)::INT AS low FROM det) GROUP BY low",
    "detections_per_frame": f"WITH {DET}, c AS (SELECT frame_index, count(*) AS n FROM det GROUP BY 1), f AS (SELECT unnest(range(0, (SELECT max(frame_index) + 1 FROM c))) AS frame_index) SELECT count(*) AS frames, sum(coalesce(n, 0))::BIGINT AS total, round(avg(coalesce(n, 0)), 6) AS mean, min(coalesce(n, 0)) AS least, max(coalesce(n, 0)) AS most FROM f LEFT JOIN c USING (frame_index)",
    "pose_and_quality": f"WITH {DET} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, w, round(yaw, 6) AS yaw, round(pitch, 6) AS pitch, round(quality_score, 6) AS quality_score FROM gated",
    "quality_gate": f"WITH {DET} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, w FROM gated WHERE reason = 'ok'",
    "reject_reasons": f"WITH {DET} SELECT reason, count(*) AS n, round(avg(quality_score), 6) AS mean, round(min(quality_score), 6) AS low, round(max(quality_score), 6) AS high FROM gated GROUP BY reason",
    "simple_quality": f"WITH {DET} SELECT l_suppkey, round(avg((least(w / 150, 1) + least(blur / 300, 1) + greatest(0, 1 - abs(yaw) / 35)) / 3), 6) AS mean FROM gated GROUP BY l_suppkey",
    "pose_bucket_topk": f"""WITH {DET}, g AS (SELECT *, {BUCKET} AS bucket, round(quality_score, 6) AS q FROM gated WHERE reason = 'ok'),
three AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY l_suppkey, bucket ORDER BY q DESC, frame_index, l_orderkey, l_partkey, l_linenumber, w) <= 3)
SELECT l_suppkey, bucket, l_orderkey, l_partkey, l_linenumber, q, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, frame_index, l_orderkey, l_partkey, l_linenumber, w)::INT AS rank FROM three QUALIFY rank <= 8""",
    "enrolment_status": f"""WITH {DET}, c AS (SELECT l_suppkey, count(*) FILTER ({BUCKET} = 'left') AS "left", count(*) FILTER ({BUCKET} = 'frontal') AS frontal, count(*) FILTER ({BUCKET} = 'right') AS "right", count(*) AS total FROM gated WHERE reason = 'ok' GROUP BY l_suppkey)
SELECT *, total >= 5 AND "left" > 0 AND frontal > 0 AND "right" > 0 AS sufficient FROM c""",
    "latest_consent": f"WITH {CONSENT} SELECT * FROM latest",
    "consented_gallery": f"WITH {CONSENT} SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT student_id FROM latest WHERE state = 'valid')",
    "latest_job": "SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "best_photo_topk": "SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id)::INT AS rank FROM events QUALIFY rank <= 4",
    "first_audit": "SELECT user_id, event_type, min(ts) AS first_ts FROM events GROUP BY ALL",
    "current_presence": f"WITH {LEDGER} SELECT id, class_session_id, student_id, status FROM tip",
    "correction_chain_depth": f"WITH {LEDGER} SELECT student_id, count(*) AS records, count(supersedes_id) AS corrections FROM ledger GROUP BY student_id",
    "corrections": f"WITH {LEDGER} SELECT id + 10000000 AS id, class_session_id, student_id, 'present' AS status, id AS supersedes_id FROM tip WHERE status <> 'present'",
    "roster": "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "last_decisions": f"WITH {REVIEW} SELECT student_id, status, source FROM given",
    "commit_fanout": f"WITH {REVIEW} SELECT course, student_id, status, source, round(confidence, 6) AS confidence, decided_by FROM done",
    "commit_counts": f"WITH {REVIEW} SELECT course, count(*) AS total, count(*) FILTER (status = 'present') AS present, count(*) FILTER (status = 'absent') AS absent, count(*) FILTER (source = 'auto') AS automatic, count(*) FILTER (source = 'teacher_confirmed') AS confirmed, count(*) FILTER (source = 'teacher_override') AS overridden FROM done GROUP BY course",
    "missing_review": f"WITH {REVIEW} SELECT course, student_id FROM r WHERE student_id IN (SELECT student_id FROM sure) AND student_id NOT IN (SELECT student_id FROM given)",
    "unenrolled_decisions": f"WITH {REVIEW} SELECT course, student_id, status FROM given CROSS JOIN (SELECT DISTINCT course FROM r) ANTI JOIN r USING (course, student_id)",
    "absent_list": f"WITH {REVIEW} SELECT course, student_id FROM r WHERE student_id NOT IN (SELECT student_id FROM sure)",
    "reviewer_live_counts": """WITH n AS (SELECT o_custkey % 25 AS session, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 10 = 0) + count(*) FILTER (o_orderstatus = 'P' AND o_orderkey % 2 = 0) + count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 20 = 0) AS present FROM orders GROUP BY 1)
SELECT session, total, present, floor(100.0::DOUBLE * present / total + 0.5)::BIGINT AS percent FROM n""",
    "confusion_metrics": f"WITH {TRUTH} {_metrics(f'SELECT {CELLS.format(p="predicted")} FROM truth')}",
    "stratified_metrics": f"""WITH {TRUTH}, f AS (SELECT 'lang' AS stratum, lang AS value, actual, predicted FROM truth UNION ALL SELECT 'source', source, actual, predicted FROM truth UNION ALL SELECT 'toxic', toxic::VARCHAR, actual, predicted FROM truth)
{_metrics(f'SELECT stratum, value, {CELLS.format(p="predicted")} FROM f WHERE value IS NOT NULL GROUP BY ALL')}""",
    "threshold_sweep": f"WITH {TRUTH} {SWEPT}",
    "best_f1": f"WITH {TRUTH}, s AS ({SWEPT}) SELECT threshold, f1 FROM s ORDER BY f1 DESC, threshold LIMIT 1",
    "pipeline_yield": "WITH g AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1), p AS (SELECT coalesce(n, 0) AS n FROM (SELECT DISTINCT p_partkey FROM part) LEFT JOIN g ON l_partkey = p_partkey) SELECT count(*) AS students, round(avg(n), 6) AS mean_crops, count(*) FILTER (n = 0) AS without, round(count(*) FILTER (n = 0) / count(*), 6) AS without_share FROM p",
    "clustering_quality": f"""{LABELS}, s AS (SELECT cluster_id, label AS person FROM labels JOIN crops USING (det_id) WHERE cluster_id >= 0),
c AS (SELECT count(*) AS clusters, count(*) FILTER (n > 1) AS conflicting FROM (SELECT count(DISTINCT person) AS n FROM s GROUP BY cluster_id)), p AS (SELECT count(*) AS people, count(*) FILTER (n > 1) AS over_split FROM (SELECT count(DISTINCT cluster_id) AS n FROM s GROUP BY person))
SELECT clusters, conflicting, people, over_split, round(conflicting / clusters, 6) AS merge_rate, round(1 - conflicting / clusters, 6) AS purity, round(over_split / people, 6) AS over_split_rate FROM c CROSS JOIN p""",
    "preflight_checks": """WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, quantile_cont(value, 0.5) AS sharp, max(value) - min(value) AS spread FROM events GROUP BY 1)
SELECT hour, n, round(sharp, 6) AS sharp, (n < 10)::INT + coalesce(sharp < 50, false)::INT + coalesce(spread < 60, false)::INT AS n_checks, CASE WHEN n < 10 THEN 'fail' WHEN sharp < 50 OR spread < 60 THEN 'warn' ELSE 'pass' END AS status FROM h""",
    "pan_speed": "WITH s AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events WHERE value IS NOT NULL) SELECT user_id, round(sum(step) / 60, 6) AS speed FROM s GROUP BY user_id",
    "missing_chunks": "WITH w AS (SELECT o_orderkey AS upload_id, unnest(range(0, ceil(floor(o_totalprice) / 20000)::BIGINT)) AS chunk FROM orders WHERE floor(o_totalprice) > 0) SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = upload_id AND l_linenumber = chunk)",
    "retention_expired": "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 180 DAY < TIMESTAMP '2000-01-01'",
    "biometric_delete_effect": f"WITH {CONSENT} SELECT event_type, count(*) AS kept FROM events WHERE user_id NOT IN (SELECT student_id FROM latest WHERE state = 'revoked') GROUP BY 1",
    "linspace_sample": "WITH e AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS place, count(*) OVER () AS total FROM events WHERE event_id IS NOT NULL) SELECT event_id, event_type FROM e WHERE list_contains(list_transform(range(18), lambda i: floor(i * (total - 1) / 17)::BIGINT), place)",
    "media_urls": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '/media/jobs/' || o_orderkey || '/best.jpg' END AS url FROM orders",
}
