"""The append-only ledger of who was present, consent, uploads and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quorum_spark.operators.scratch import Scratch


def top_rows(rows: DataFrame, key: str | list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key in an order."""
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def current(records: DataFrame) -> DataFrame:
    """Records that no other record supersedes."""
    newer = records.where("supersedes_id is not null").select(F.col("supersedes_id").alias("id"))
    return records.join(newer, "id", "left_anti")


def chain_depths(records: DataFrame) -> DataFrame:
    """(id, depth): how many records each current record supersedes, directly or through others. records: id, supersedes_id.

    Every round joins what each record reaches with what that reaches, so rounds follow the logarithm of the longest chain.
    Records that have reached their end leave the rounds: with nothing to look up, they would all meet in one task.
    """
    scratch = Scratch(records.sparkSession, "chains")
    state = scratch.cut(records.select("id", F.col("supersedes_id").alias("up"), F.when(F.col("supersedes_id").isNull(), 0).otherwise(1).cast("long").alias("depth")), "state")
    ended, rest = state.where("up is null"), state.where("up is not null")
    left, before = rest.count(), None
    while left:
        if left == before:  # in chains, some reach their end in every round
            raise ValueError("records supersede each other in a circle")
        further = ended.union(rest).select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        new = scratch.cut(rest.join(further, "up", "left").select("id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "state")
        ended, rest = ended.union(new.where("up is null")), new.where("up is not null")
        before, left = left, rest.count()
    state = ended
    return current(records).select("id").join(state.select("id", "depth"), "id")


def latest_consent(consents: DataFrame) -> DataFrame:
    """(student_id, id, state): the newest consent's state, valid or revoked. Students without a row have none."""
    last = top_rows(consents, "student_id", [F.desc("granted_at"), F.desc("id")])
    return last.select("student_id", "id", F.when(F.col("revoked_at").isNull(), "valid").otherwise("revoked").alias("state"))


def last_decisions(decisions: DataFrame, key: str = "student_id") -> DataFrame:
    """One decision per student or other key, the one given last. decisions: key, status, source, ordinal. Automatic ones are refused."""
    own = decisions.withColumn("source", F.when(F.col("source") != "auto", F.col("source")).otherwise(F.raise_error(F.lit("a decision cannot be automatic"))))
    return top_rows(own, key, [F.desc("ordinal")]).drop("rank")


def commit(roster: DataFrame, decisions: DataFrame, confident: DataFrame, teacher: int, by: list[str] | None = None) -> DataFrame:
    """Exactly one row per enrolled student, of each course if by names the roster's columns for it: the explicit decision, else present by a confident match, else absent."""
    d = decisions.select("student_id", F.col("status").alias("d_status"), F.col("source").alias("d_source"))
    out = roster.select(*by or [], "student_id").distinct().join(d, "student_id", "left").join(confident.select("student_id", "similarity"), "student_id", "left")
    explicit = F.col("d_status").isNotNull()
    status = F.coalesce("d_status", F.when(F.col("similarity").isNotNull(), "present").otherwise("absent"))
    return out.select(
        *by or [],
        "student_id",
        status.alias("status"),
        F.coalesce("d_source", F.lit("auto")).alias("source"),
        F.when(~explicit, F.col("similarity")).alias("confidence"),
        F.when(explicit, F.lit(teacher)).alias("decided_by"),
    )


def commit_counts(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    n = lambda c: F.count_if(c)
    s, o = F.col("status"), F.col("source")
    return rows.groupBy(*by or []).agg(
        F.count("*").alias("total"),
        n(s == "present").alias("present"),
        n(s == "absent").alias("absent"),
        n(o == "auto").alias("automatic"),
        n(o == "teacher_confirmed").alias("confirmed"),
        n(o == "teacher_override").alias("overridden"),
    )


def correct(records: DataFrame, corrections: DataFrame) -> DataFrame:
    """New records for corrections (id, class_session_id, student_id, status) that change a current status; each supersedes the current record."""
    tip = current(records).select("class_session_id", "student_id", F.col("id").alias("tip"), F.col("status").alias("was"))
    made = corrections.join(tip, ["class_session_id", "student_id"]).where("status <> was")
    return made.select("id", "class_session_id", "student_id", "status", F.col("tip").alias("supersedes_id"))


def correction_outcomes(requests: DataFrame, sessions: DataFrame, records: DataFrame) -> DataFrame:
    """(id, session_id, student_id, status, outcome, supersedes_id): what becomes of each request (id, session_id, student_id, status).

    Outcomes, the first that applies: session_not_found, not_committed, attendance_not_found, no_change, corrected. Requests of
    one student in one session are taken in order of id, each on top of those before. A corrected one is a new record, which supersedes
    the record that is current then; refused ones supersede nothing. sessions: session_id, status; records: id, session_id, student_id,
    status, supersedes_id.
    """
    tip = current(records).select("session_id", "student_id", F.col("id").alias("tip"), F.col("status").alias("was"))
    rows = requests.select("id", "session_id", "student_id", "status").join(sessions.select("session_id", F.col("status").alias("state")), "session_id", "left").join(tip, ["session_id", "student_id"], "left")
    turn = Window.partitionBy("session_id", "student_id").orderBy("id")
    outcome = F.when(F.col("state").isNull(), "session_not_found").when(F.col("state") != "committed", "not_committed").when(F.col("tip").isNull(), "attendance_not_found")
    outcome = outcome.when(F.col("status") == F.coalesce(F.lag("status").over(turn), "was"), "no_change").otherwise("corrected")
    rows = rows.withColumn("outcome", outcome)
    before = F.last(F.when(F.col("outcome") == "corrected", F.col("id")), ignorenulls=True).over(turn.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("id", "session_id", "student_id", "status", "outcome", F.when(F.col("outcome") == "corrected", F.coalesce(before, "tip")).alias("supersedes_id"))


def missing_chunks(uploads: DataFrame, received: DataFrame) -> DataFrame:
    """(upload_id, chunk) not received. uploads: upload_id, total_bytes, chunk_bytes; received: upload_id, chunk, repeats allowed."""
    n = F.ceil(F.col("total_bytes") / F.col("chunk_bytes"))
    want = uploads.where("total_bytes > 0").select("upload_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    return want.join(received.select("upload_id", "chunk").distinct(), ["upload_id", "chunk"], "left_anti")


def expired(rows: DataFrame, days: int, now: Column) -> DataFrame:
    """Rows whose created_at is more than a number of days ago."""
    return rows.where(F.col("created_at") + F.make_dt_interval(F.lit(days)) < now)
