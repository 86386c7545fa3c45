"""Draft rosters, review, and commits of many sessions at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorum_spark.operators.intake import first_failing
from quorum_spark.operators.ledger import current, last_decisions

CONFIDENT, UNCERTAIN = "confident", "uncertain"
#: What a reviewer's tap in each list means: status and source.
TAPS = {"present": ("present", "teacher_confirmed"), "not_them": ("absent", "teacher_override"), "not_found": ("present", "teacher_override"), "confirmed": ("absent", "teacher_override")}


def media_url(path):
    """/data/... as the address it is served at, null for other places."""
    return F.when(path.startswith("/data/"), F.concat(F.lit("/media/"), path.substr(F.lit(7), F.length(path))))


def matched_clusters(clusters: DataFrame, matches: DataFrame, students: DataFrame) -> DataFrame:
    """Each cluster with its match and, where it has one, its student. clusters: session_id, cluster_id, best_crop; matches: cluster_id, student_id, similarity, runner_up, decision; students: student_id, name, roll_number."""
    return clusters.join(matches, "cluster_id").join(students, "student_id", "left")


def draft_roster(clusters: DataFrame, matches: DataFrame, students: DataFrame, roster: DataFrame, photos: DataFrame) -> DataFrame:
    """The four lists of each session's draft, one row per entry: session_id, section, cluster_id, crop_url, student_id, name, roll_number, similarity, runner_up, photo_url.

    Sections: confident, needs_review, unrecognised (no student) and proposed_absent (enrolled, in neither of the first two).
    roster: session_id, student_id. photos: student_id, quality, uri; a student's best is shown, of equal ones the first by uri.
    """
    best = photos.groupBy("student_id").agg(F.min(F.struct((-F.col("quality")).alias("worse"), "uri")).alias("b")).select("student_id", media_url(F.col("b.uri")).alias("photo_url"))
    section = F.when(F.col("decision") == CONFIDENT, "confident").when(F.col("decision") == UNCERTAIN, "needs_review").otherwise("unrecognised")
    found = matched_clusters(clusters, matches, students).select(
        "session_id", section.alias("section"), "cluster_id", media_url(F.col("best_crop")).alias("crop_url"), "student_id", "name", "roll_number", "similarity", "runner_up"
    )
    seen = found.where("section <> 'unrecognised' and student_id is not null").select("session_id", "student_id").distinct()
    absent = roster.join(seen, ["session_id", "student_id"], "left_anti").join(students, "student_id").select("session_id", F.lit("proposed_absent").alias("section"), "student_id", "name", "roll_number")
    return found.unionByName(absent, allowMissingColumns=True).join(best, "student_id", "left")


def reviewer_decisions(taps: DataFrame) -> DataFrame:
    """(session_id, student_id, status, source, ordinal) of taps (session_id, student_id, tap, ordinal); unknown taps decide nothing."""
    pick = lambda k: F.coalesce(*[F.when(F.col("tap") == t, v[k]) for t, v in TAPS.items()])
    return taps.where(F.col("tap").isin(*TAPS)).select("session_id", "student_id", pick(0).alias("status"), pick(1).alias("source"), "ordinal")


def commit_outcomes(requests: DataFrame, sessions: DataFrame, roster: DataFrame, bands: DataFrame, decisions: DataFrame, drafts: DataFrame | None = None, audits: DataFrame | None = None) -> DataFrame:
    """(request_id, session_id, outcome, unenrolled, undecided): what becomes of each commit request, the first rule that applies.

    Outcomes: session_not_found; audit_log_missing and idempotent_replay (committed by this very request); already_committed (by
    another one); not_awaiting_review; draft_not_ready; decision_for_unenrolled_student; needs_review_incomplete; committed. drafts: session_id
    of sessions with a finished job; audits: session_id of those whose commit is in the audit log; None: all of them. Of several requests of one
    session that could commit, the smallest request_id does, the others find it already committed. sessions: session_id,
    status, commit_request; roster: session_id, student_id; bands: session_id, student_id, decision; decisions: request_id,
    session_id, student_id.
    """
    asked = decisions.select("request_id", "session_id", "student_id").distinct()
    unknown = asked.join(roster, ["session_id", "student_id"], "left_anti").groupBy("request_id", "session_id").agg(F.count("*").alias("unenrolled"))
    uncertain = bands.where(F.col("decision") == UNCERTAIN).select("session_id", "student_id").distinct()
    left = requests.select("request_id", "session_id").join(uncertain, "session_id").join(asked, ["request_id", "session_id", "student_id"], "left_anti")
    left = left.groupBy("request_id", "session_id").agg(F.count("*").alias("undecided"))
    rows = requests.select("request_id", "session_id").join(sessions.select("session_id", "status", "commit_request"), "session_id", "left")
    rows = rows.join(unknown, ["request_id", "session_id"], "left").join(left, ["request_id", "session_id"], "left").fillna(0, ["unenrolled", "undecided"])
    known = lambda t: t.select("session_id").distinct()
    for name, t in (("ready", drafts), ("logged", audits)):
        rows = rows.withColumn(name, F.lit(True)) if t is None else rows.join(known(t).withColumn(name, F.lit(True)), "session_id", "left").fillna(False, [name])
    done = F.col("status") == "committed"
    code = first_failing(
        (F.col("status").isNull(), "session_not_found"),
        (done & (F.col("commit_request") == F.col("request_id")) & ~F.col("logged"), "audit_log_missing"),
        (done & (F.col("commit_request") == F.col("request_id")), "idempotent_replay"),
        (done, "already_committed"),
        (F.col("status") != "awaiting_review", "not_awaiting_review"),
        (~F.col("ready"), "draft_not_ready"),
        (F.col("unenrolled") > 0, "decision_for_unenrolled_student"),
        (F.col("undecided") > 0, "needs_review_incomplete"),
    )
    turn = F.row_number().over(Window.partitionBy("session_id", code.isNull()).orderBy("request_id"))
    outcome = F.coalesce(code, F.when(turn == 1, "committed").otherwise("already_committed"))
    return rows.select("request_id", "session_id", outcome.alias("outcome"), "unenrolled", "undecided")


def committed_records(outcomes: DataFrame, roster: DataFrame, bands: DataFrame, decisions: DataFrame) -> DataFrame:
    """The records that committed requests append: one per enrolled student of their sessions. bands: with similarity; decisions: with status, source, ordinal."""
    won = outcomes.where("outcome = 'committed'").select("request_id", "session_id")
    rows = won.join(roster.select("session_id", "student_id").distinct(), "session_id")
    given = last_decisions(decisions.withColumn("_key", F.struct("request_id", "session_id", "student_id")), "_key").select("request_id", "session_id", "student_id", F.col("status").alias("d_status"), F.col("source").alias("d_source"))
    sure = bands.where(F.col("decision") == CONFIDENT).groupBy("session_id", "student_id").agg(F.max("similarity").alias("similarity"))
    rows = rows.join(given, ["request_id", "session_id", "student_id"], "left").join(sure, ["session_id", "student_id"], "left")
    explicit = F.col("d_status").isNotNull()
    status = F.coalesce("d_status", F.when(F.col("similarity").isNotNull(), "present").otherwise("absent"))
    return rows.select("request_id", "session_id", "student_id", status.alias("status"), F.coalesce("d_source", F.lit("auto")).alias("source"), F.when(~explicit, F.col("similarity")).alias("confidence"))


def replay_counts(outcomes: DataFrame, records: DataFrame) -> DataFrame:
    """(request_id, session_id, total, present, absent) for replayed requests, counted anew from their sessions' current records. records: id, session_id, student_id, status, supersedes_id."""
    now = current(records).groupBy("session_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "present").alias("present"), F.count_if(F.col("status") == "absent").alias("absent"))
    return outcomes.where("outcome = 'idempotent_replay'").select("request_id", "session_id").join(now, "session_id", "left").fillna(0)


def audit_rows(counts: DataFrame, params: DataFrame) -> DataFrame:
    """(subject_id, action, payload): a row per commit with its counts and the hash of its parameters as JSON. counts: session_id, request_id, total, present; params: session_id, params_json."""
    rows = counts.join(params, "session_id")
    payload = F.to_json(F.struct("request_id", F.struct("total", "present").alias("counts"), F.sha2("params_json", 256).alias("params_hash")))
    return rows.select(F.col("session_id").cast("string").alias("subject_id"), F.lit("roster.commit").alias("action"), payload.alias("payload"))


def preflight_warned(jobs: DataFrame, uploads: DataFrame) -> DataFrame:
    """(job_id, warned): whether the job's upload has a preflight status, as JSON, other than pass. Without an upload or a status: false. jobs: job_id, upload_id; uploads: upload_id, preflight_json."""
    status = F.from_json("preflight_json", "status string").status
    return jobs.join(uploads, "upload_id", "left").select("job_id", F.coalesce(status != "pass", F.lit(False)).alias("warned"))


def with_course(sessions: DataFrame, courses: DataFrame) -> DataFrame:
    """sessions (session_id, course) with the course's columns; a course that isn't there is an error."""
    known = courses.withColumn("_known", F.lit(True))
    lost = F.raise_error(F.concat(F.lit("no course "), F.col("course").cast("string")))
    return sessions.join(known, "course", "left").withColumn("course", F.when(F.col("_known"), F.col("course")).otherwise(lost)).drop("_known")


def delete_biometrics(gone: DataFrame, vectors: DataFrame, photos: DataFrame, means: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What is left of vectors and photos when students (student_id) are deleted, the means with theirs nulled, and per student how many of each went. Ledger records are not touched."""
    ids = gone.select("student_id").distinct()
    count = lambda t, name: t.join(ids, "student_id", "left_semi").groupBy("student_id").agg(F.count("*").alias(name))
    counts = ids.join(count(vectors, "vectors"), "student_id", "left").join(count(photos, "photos"), "student_id", "left").fillna(0)
    flag = ids.withColumn("_gone", F.lit(True))
    nulled = means.join(flag, "student_id", "left").withColumn("mean", F.when(F.col("_gone").isNull(), F.col("mean"))).drop("_gone")
    left = [t.join(ids, "student_id", "left_anti") for t in (vectors, photos)]
    return left[0], left[1], nulled, counts
