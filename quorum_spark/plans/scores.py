"""Queries of scores, samples and similarities, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from quorum_spark.operators import evaluation as E
from quorum_spark.operators import scoring as C
from quorum_spark.operators.numbering import numbered
from quorum_spark.operators.scratch import Scratch
from quorum_spark.plans import reviews
from quorum_spark.plans import stand_ins as S
from quorum_spark.plans.oracles import CROPS, _metrics

QUERIES, SQL = {}, {}
CELLS = "count(*) FILTER (actually_present AND {p}) AS tp, count(*) FILTER (NOT actually_present AND {p}) AS fp, count(*) FILTER (actually_present AND NOT {p}) AS fn, count(*) FILTER (NOT actually_present AND NOT {p}) AS tn"
#: Truth of sessions by roll number, one in eleven of them unknown to the gallery, and predictions from confident bands.
TRUTH = f"""{reviews.SESSIONS}, truth AS (SELECT c_nationkey AS session_id, CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE 'R' END || c_custkey AS roll_number, c_acctbal > 0 AS actually_present, c_mktsegment AS segment FROM customer WHERE c_nationkey IS NOT NULL),
predicted AS (SELECT session_id, student_id, bool_or(coalesce(decision = 'confident', false)) AS predicted FROM roster LEFT JOIN bands USING (session_id, student_id) GROUP BY ALL),
scored AS (SELECT t.*, student_id, predicted FROM truth t LEFT JOIN (SELECT session_id, student_id, predicted, roll_number FROM predicted JOIN students USING (student_id)) p USING (session_id, roll_number))"""


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _truth(spark, d):
    c = S.table(spark, d, "customer").where("c_nationkey is not null")
    roll = F.concat(F.when(F.col("c_custkey") % 11 == 0, "X").otherwise("R"), F.col("c_custkey").cast("string"))
    return c.select(F.col("c_nationkey").alias("session_id"), roll.alias("roll_number"), (F.col("c_acctbal") > 0).alias("actually_present"), F.col("c_mktsegment").alias("segment"))


def _scored(spark, d):
    t = reviews._tables(spark, d)
    return C.on_truth(_truth(spark, d), C.predictions(t["roster"], t["bands"]), t["students"])


def _rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "accuracy", "f1") if c in df.columns})


@query(f"WITH {TRUTH} SELECT session_id, roll_number, actually_present, segment, student_id, predicted FROM scored")
def scored_truth(spark, d):
    return _scored(spark, d)


@query(f"WITH {TRUTH} SELECT session_id, roll_number FROM scored WHERE predicted IS NULL")
def unmapped_truth(spark, d):
    return C.mapped(_scored(spark, d))[1].select("session_id", "roll_number")


@query(f"WITH {TRUTH} SELECT session_id, student_id, roll_number, CASE WHEN actually_present THEN 'FN' ELSE 'FP' END AS kind FROM scored WHERE predicted IS NOT NULL AND actually_present <> predicted")
def failures(spark, d):
    return C.failures(C.mapped(_scored(spark, d))[0])


@query(f"WITH {TRUTH} {_metrics(f'SELECT session_id, {CELLS.format(p="predicted")} FROM scored WHERE predicted IS NOT NULL GROUP BY 1')}")
def session_metrics(spark, d):
    return _rounded(E.metrics(C.session_counts(C.mapped(_scored(spark, d))[0])))


_COUNTED = "c AS (SELECT session_id, {cells} FROM scored WHERE predicted IS NOT NULL GROUP BY 1)"


@query(f"WITH {TRUTH}, {_COUNTED.format(cells=CELLS.format(p='predicted'))} {_metrics('SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, count(DISTINCT session_id) AS sessions FROM c')}")
def summed_metrics(spark, d):
    return _rounded(C.summed(C.session_counts(C.mapped(_scored(spark, d))[0])))


@query(f"WITH {TRUTH}, {_COUNTED.format(cells=CELLS.format(p='predicted'))}, m AS ({_metrics('SELECT * FROM c')}) SELECT count(DISTINCT session_id) AS sessions, round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(f1), 5) AS f1 FROM m")
def macro_metrics(spark, d):
    per = _rounded(E.metrics(C.session_counts(C.mapped(_scored(spark, d))[0])))
    return C.macro(per, "precision", "recall", "f1").withColumns({c: F.round(c, 5) for c in ("precision", "recall", "f1")})


@query(f"""WITH {TRUTH}, best AS (SELECT session_id, student_id, max(similarity) AS similarity FROM bands GROUP BY ALL), t AS (SELECT unnest(range(25, 61)) / 100.0::DOUBLE AS threshold),
c AS (SELECT session_id, threshold, {CELLS.format(p='coalesce(similarity >= threshold, false)')} FROM scored LEFT JOIN best USING (session_id, student_id), t WHERE predicted IS NOT NULL GROUP BY ALL)
{_metrics('SELECT threshold, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, count(DISTINCT session_id) AS sessions FROM c GROUP BY threshold')}""")
def session_sweep(spark, d):
    best = reviews._tables(spark, d)["bands"].groupBy("session_id", "student_id").agg(F.max("similarity").alias("similarity"))
    thresholds = spark.range(25, 61).select((F.col("id") / 100.0).alias("threshold"))
    truth = C.mapped(_scored(spark, d))[0].select("session_id", "student_id", "actually_present")
    return _rounded(C.summed(C.session_sweep(truth, best, thresholds), "threshold"))


@query(f"WITH {TRUTH} SELECT r.session_id, r.student_id, roll_number, actually_present FROM roster r JOIN students USING (student_id) LEFT JOIN truth t USING (session_id, roll_number)")
def resumed_labels(spark, d):
    t = reviews._tables(spark, d)
    return C.resumed(t["roster"].join(t["students"].drop("name"), "student_id"), _truth(spark, d))


@query(f"WITH {TRUTH} SELECT r.session_id, r.student_id FROM roster r JOIN students USING (student_id) JOIN truth t USING (session_id, roll_number) WHERE actually_present")
def present_students(spark, d):
    t = reviews._tables(spark, d)
    return C.present_students(t["roster"].join(t["students"].drop("name"), "student_id"), _truth(spark, d)).select("session_id", "student_id")


_SIMS = f"""{CROPS}, within AS (SELECT a.label, list_cosine_similarity(a.v, b.v) AS s FROM crops a JOIN crops b ON a.label = b.label AND a.det_id < b.det_id),
flat AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM crops), mean AS (SELECT label, list(x ORDER BY k) AS m FROM (SELECT label, k, avg(x) AS x FROM flat GROUP BY ALL) GROUP BY label),
between_ AS (SELECT a.label AS i, b.label AS j, list_cosine_similarity(a.m, b.m) AS s FROM mean a JOIN mean b ON a.label < b.label)"""


@query(f"WITH {_SIMS} SELECT i, j, round(s, 6) AS similarity FROM between_")
def between_similarity(spark, d):
    return C.between_pairs(S.crops(spark, d), "label").withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_SIMS}, r AS (SELECT greatest((SELECT min(s) FROM within), (SELECT min(s) FROM between_)) AS low, least((SELECT max(s) FROM within), (SELECT max(s) FROM between_)) AS high) SELECT CASE WHEN high > low THEN round(low, 6) END AS low, CASE WHEN high > low THEN round(high, 6) END AS high FROM r")
def similarity_overlap(spark, d):
    crops = S.crops(spark, d)
    return C.overlap(C.within_extremes(crops, "label", "det_id"), C.between_extremes(crops, "label")).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT bin::BIGINT AS bin, round(lo + bin * (hi - lo) / 10, 6) AS low, count(*) AS n FROM (SELECT least(floor((value - lo) / ((hi - lo) / 10)), 9) AS bin, lo, hi FROM events, r WHERE value IS NOT NULL) GROUP BY ALL")
def value_histogram(spark, d):
    return C.range_histogram(S.table(spark, d, "events"), "value").select("bin", F.round("low", 6).alias("low"), "n")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events WHERE event_id IS NOT NULL QUALIFY place % 20 = 0")
def every_nth(spark, d):
    rows = S.table(spark, d, "events").where("event_id is not null").select("event_id")
    return C.every_nth(numbered(rows, ["event_id"], "place", Scratch(spark, "nth")), "place", 20)


@query("SELECT event_id FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 25")
def seeded_sample(spark, d):
    return C.seeded_sample(S.table(spark, d, "events").select("event_id"), "event_id", 25, 7)


@query("SELECT 'orders' AS kind, o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT 'orders', c_custkey FROM customer WHERE c_acctbal > 5000 UNION (SELECT 'none', c_custkey FROM customer EXCEPT SELECT 'none', o_custkey FROM orders)")
def id_sets(spark, d):
    c, o = S.table(spark, d, "customer"), S.table(spark, d, "orders")
    ids = lambda t, name, kind: t.select(F.lit(kind).alias("kind"), F.col(name).alias("id"))
    both = ids(o.where("o_orderstatus = 'F'"), "o_custkey", "orders").intersect(ids(c.where("c_acctbal > 5000"), "c_custkey", "orders"))
    return both.union(ids(c, "c_custkey", "none").subtract(ids(o, "o_custkey", "none"))).distinct()


@query("SELECT vec_id, len(embedding) = 64 AS fits FROM embeddings WHERE embedding IS NOT NULL")
def dimension_guard(spark, d):
    return S.table(spark, d, "embeddings").where("embedding is not null").select("vec_id", (F.size("embedding") == 64).alias("fits"))
