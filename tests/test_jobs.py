"""Jobs: keyed state of a stream, the same states from a table, envelopes."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docsieve import schemas
from docsieve.operators import jobs
from docsieve.settings import Settings
from docsieve.streaming import job_state
from docsieve.streaming import jobs as stream

LIMITS = Settings(processing_timeout_seconds=90, processing_grace_seconds=15, job_ttl_seconds=900)
T0 = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def table(spark, rows):
    return spark.createDataFrame([(j, at(t), k, e) for j, t, k, e in rows], job_state.EVENTS)


LIVES = [
    ("fine", 0, "submit", None), ("fine", 5, "start", None), ("fine", 20, "finish", None), ("fine", 30, "read", None), ("fine", 31, "read", None),
    ("bad", 0, "submit", None), ("bad", 1, "start", None), ("bad", 2, "fail", "Empty file."), ("bad", 3, "read", None),
    ("slow", 0, "submit", None), ("slow", 10, "start", None), ("slow", 104, "finish", None),
    ("stuck", 0, "submit", None), ("stuck", 10, "start", None), ("stuck", 400, "finish", None),
    ("unread", 0, "submit", None), ("unread", 1, "start", None), ("unread", 2, "finish", None), ("unread", 902, "read", None),
    ("waits", 0, "submit", None), ("waits", 7, "read", None), ("odd", 0, "finish", None), ("odd", 1, "start", None), ("runs", 940, "submit", None), ("runs", 941, "start", None),
    ("last", 1000, "submit", None)]
STATES = {"fine": "read", "bad": "expired", "slow": "failed", "stuck": "failed", "unread": "expired", "waits": "queued", "runs": "processing", "last": "queued"}
ERRORS = {"slow": jobs.ERROR_LIMIT, "stuck": jobs.ERROR_INTERNAL}


def test_states_from_a_table(spark):
    got = {r["job_id"]: r for r in jobs.lifecycle(table(spark, LIVES), settings=LIMITS).collect()}
    assert {k: r["state"] for k, r in got.items()} == STATES
    assert {k: r["error"] for k, r in got.items() if r["error"]} == ERRORS
    early = {r["job_id"]: (r["state"], r["error"]) for r in jobs.lifecycle(table(spark, LIVES), F.lit(at(101)), LIMITS).collect()}
    assert early["stuck"] == ("stopping", None) and early["bad"] == ("failed", "Empty file.") and early["unread"] == ("complete", None) and "runs" not in early
    odd = spark.createDataFrame([(None, at(0), "submit", None), ("a", None, "submit", None), ("b", at(0), "submit", None), ("b", at(0), "submit", None)], job_state.EVENTS)
    assert [r["state"] for r in jobs.lifecycle(odd, settings=LIMITS).collect()] == ["queued"]
    assert jobs.lifecycle(odd.where("false"), settings=LIMITS).count() == 0


def _run(spark, tmp_path, settings=LIMITS):
    events = job_state.track(job_state.read_events(spark, str(tmp_path / "events"), 1), settings, "0 seconds")
    job_state.keep_transitions(events, str(tmp_path / "states"), str(tmp_path / "check")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "states"))


def _arrive(spark, tmp_path, rows, number):
    table(spark, rows).coalesce(1).write.parquet(str(tmp_path / "events" / f"n={number}"))


def test_a_stream_expires_jobs_reads_once_and_repeats_nothing_after_a_restart(spark, tmp_path):
    cuts = (0, 15, 50, 200, 930, 10_000)
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        _arrive(spark, tmp_path, [r for r in LIVES if lo <= r[1] < hi], k)
        out = _run(spark, tmp_path)  # each time from the checkpoint
    rows = out.collect()
    assert len({(r["job_id"], r["at"], r["state"]) for r in rows}) == len(rows)
    of = lambda job: [r["state"] for r in sorted((r for r in rows if r["job_id"] == job), key=lambda r: r["at"])]
    assert of("fine") == ["queued", "processing", "complete", "read", "refused"]
    assert of("slow") == ["queued", "processing", "stopping", "failed"] and of("stuck") == of("slow")
    assert of("unread") == ["queued", "processing", "complete", "expired", "refused"]
    assert of("bad") == ["queued", "processing", "failed", "refused", "expired"] and of("waits") == ["queued", "refused"] and not of("odd")
    state = {r["job_id"]: (r["state"], r["error"]) for r in stream.current(out).collect()}
    assert {k: s for k, (s, _) in state.items()} == STATES and {k: e for k, (_, e) in state.items() if e} == ERRORS


def test_streams_cut_anyhow_equal_the_table(spark, tmp_path):
    rng = random.Random(8)
    small = Settings(processing_timeout_seconds=30, processing_grace_seconds=10, job_ttl_seconds=200)
    times = sorted(rng.sample(range(0, 400_000), 400))
    rows = [(f"j{rng.randrange(25)}", t / 1000, rng.choice(jobs.KINDS), f"e{t % 7}") for t in times]
    ends = sorted(rng.sample(range(1, 400), 4))
    for k, (lo, hi) in enumerate(zip([0, *ends], [*ends, 400])):
        _arrive(spark, tmp_path, rows[lo:hi], k)
    got = stream.current(_run(spark, tmp_path, small)).select("job_id", "state", "since", "error")
    want = jobs.lifecycle(table(spark, rows), settings=small).select("job_id", "state", "since", "error")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rules_of_one_job():
    us = 1_000_000
    job, out = job_state.apply(None, "submit", 0, None, LIMITS)
    assert job == ("queued", 0, None) and job_state.deadline(job, LIMITS) is None
    job, _ = job_state.apply(job, "start", 5 * us, None, LIMITS)
    assert job_state.deadline(job, LIMITS) == 95 * us
    late, out = job_state.apply(job, "finish", 95 * us, None, LIMITS)
    assert late == ("failed", 95 * us, jobs.ERROR_LIMIT) and [s for _, s, _ in out] == ["stopping", "failed"]
    late, out = job_state.apply(job, "finish", 110 * us, None, LIMITS)
    assert late == ("failed", 110 * us, jobs.ERROR_INTERNAL)
    done, _ = job_state.apply(job, "finish", us, None, LIMITS)  # out of order: counts from what the job has seen
    assert done == ("complete", 5 * us, None)
    assert job_state.advance(done, 10_000 * us, LIMITS)[0] is None
    read, _ = job_state.apply(done, "read", 6 * us, None, LIMITS)
    assert job_state.apply(read, "submit", 7 * us, None, LIMITS)[0] == read and job_state.apply(None, "read", 0, None, LIMITS) == (None, [(0, "refused", None)])


def test_files_to_results_events_reads_and_deletion(spark, tmp_path):
    for k in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k}.bin").write_bytes(b"x" * (k + 1))
    operation = lambda files: files.select(
        "doc_id", F.lit("pdf").alias("kind"), (F.octet_length("content") - 1).alias("pages_flagged"), F.lit(0.5).alias("elapsed_seconds"),
        F.when(F.octet_length("content") == 1, "Empty file.").alias("error"))
    paths = {n: str(tmp_path / n) for n in ("in", "out", "check", "events", "states", "check2")}
    for _ in range(2):  # the second run finds nothing new
        stream.run_jobs(spark, paths["in"], paths["out"], paths["check"], operation, events=paths["events"]).awaitTermination()
    out = spark.read.parquet(paths["out"])
    ids = {r["pages_flagged"]: r["job_id"] for r in out.collect()}
    assert len(ids) == 3

    def states():
        events = job_state.track(job_state.read_events(spark, paths["events"]), Settings(), "0 seconds")
        job_state.keep_transitions(events, paths["states"], paths["check2"]).awaitTermination()
        return spark.read.parquet(paths["states"])

    asked = spark.createDataFrame([(x,) for x in [*ids.values(), "unknown"]], "job_id string")
    status = schemas.job_status(asked, stream.current(states()), out.drop("doc_id").withColumnRenamed("job_id", "doc_id"))
    assert status.dtypes == spark.createDataFrame([], schemas.ENVELOPES["job_status"]).dtypes
    rows = {r["job_id"]: r for r in status.collect()}
    assert rows["unknown"]["status"] == "queued" and rows[ids[0]]["status"] == "failed" and rows[ids[0]]["error"] == "Empty file." and rows[ids[0]]["kind"] is None
    assert (rows[ids[2]]["status"], rows[ids[2]]["pages_flagged"], rows[ids[2]]["expires_in_seconds"], rows[ids[2]]["download_url"]) == (
        "complete", 2, 900, f"/api/v1/documents/{ids[2]}/download")
    assert stream.claimed(spark, paths["out"], states()).count() == 0
    job_state.request_reads(spark, paths["events"], [ids[2], ids[0], "unknown"])
    after = states()
    assert [r["pages_flagged"] for r in stream.claimed(spark, paths["out"], after).collect()] == [2]
    job_state.request_reads(spark, paths["events"], [ids[2]])
    assert states().where(F.col("job_id") == ids[2]).where("state in ('read', 'refused')").groupBy("state").count().count() == 2
    assert stream.forget(spark, paths["out"], after) == 1 and sorted(r["pages_flagged"] for r in spark.read.parquet(paths["out"]).collect()) == [0, 1]


def test_envelopes_nest_findings_and_revisions_in_order(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "job_id string")
    states = spark.createDataFrame([("a", "complete", None), ("b", "complete", None), ("c", "failed", "no")], "job_id string, state string, error string")
    rect = dict(x0=0.0, y0=0.0, x1=1.0, y1=1.0)
    found = spark.createDataFrame(
        [("a", 1, rect, "vector_fill", "clear", 0, 0, "n", 2, 5, "secret"), ("a", 0, rect, "image_overlay", "critical", 2, 9, "m", 3, 1, "secret"),
         ("a", 0, rect, "vector_fill", "clear", 0, 0, "n", 2, 7, "secret")],
        f"doc_id string, page_number int, rect {schemas.RECT}, source string, risk_level string, underlying_word_count int, underlying_char_count int, note string, source_order int, seq int, text string")
    reports = spark.createDataFrame([("a", 3, 1, 2, 0, 2, "s"), ("b", 0, 0, 0, 0, 1, "none")],
                                    "doc_id string, total_boxes_found int, critical_count int, clear_count int, unknown_count int, pages_audited int, summary string")
    out = schemas.redaction_audit(asked, states, found, reports)
    assert out.dtypes == spark.createDataFrame([], schemas.ENVELOPES["redaction_audit"]).dtypes and "text" not in str(out.schema)
    rows = {r["job_id"]: r for r in out.collect()}
    assert [(f["page_number"], f["source"]) for f in rows["a"]["findings"]] == [(0, "vector_fill"), (0, "image_overlay"), (1, "vector_fill")]
    assert rows["b"]["findings"] == [] and rows["c"]["findings"] is None and rows["c"]["error"] == "no" and rows["c"]["summary"] is None
    revs = spark.createDataFrame([("a", 2, 90, True, 1, 7, None, None, True, ""), ("a", 1, 50, False, 1, 5, None, None, True, "")],
                                 "doc_id string, revision_index int, size_bytes long, is_current boolean, page_count int, object_count int, creation_date string, mod_date string, openable boolean, note string")
    per = spark.createDataFrame([("a", 2, 1, "s", False)], "doc_id string, total_revisions_found int, pages_in_current_revision int, summary string, truncated boolean")
    rows = {r["job_id"]: r for r in schemas.revision_discovery(asked, states, revs, per).collect()}
    assert [r["revision_index"] for r in rows["a"]["revisions"]] == [1, 2] and rows["b"]["revisions"] == [] and rows["c"]["revisions"] is None
    got = {r["job_id"]: r for r in schemas.revision_extraction(asked, states, spark.createDataFrame([("a", 4)], "doc_id string, revision_index int")).collect()}
    assert got["a"]["revision_index"] == 4 and got["c"]["download_url"] is None and schemas.submitted(asked, "audit").first()["poll_url"] == "/api/v1/audit/redactions/a"


@pytest.mark.parametrize("state, want", [("stopping", "processing"), ("read", "queued"), ("expired", "queued"), ("failed", "failed"), (None, "queued")])
def test_reported_states(spark, state, want):
    assert spark.createDataFrame([(state,)], "s string").select(jobs.reported(F.col("s")).alias("x")).first()["x"] == want


def test_a_result_that_was_read_long_ago_is_not_given_again(spark, tmp_path):
    import duckdb

    from docsieve.plans.queries import ORACLES, QUERIES

    rows = [(1, "2024-01-01", 1, "purchase"), (2, "2024-01-20", 1, "view"), (3, "2024-01-02", 2, "view"), (4, "2024-01-30", 3, "purchase"), (5, "2024-01-30", 2, "click")]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").selectExpr(
        "event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = sorted(map(tuple, QUERIES["one_time_read"](spark, str(tmp_path)).select("event_id", "user_id").collect()))
    assert got == [(3, 2), (5, 2)]
    assert sorted(con.sql(ORACLES["one_time_read"]).fetchall()) == [(3, 2), (5, 2)]
