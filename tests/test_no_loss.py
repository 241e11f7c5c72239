"""Nothing that was committed is lost or doubled: run-id reuse, replays, late
files, guards, undatable messages, several answers, partial delivery."""
import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.plans import ingest as I
from tidemark.plans import run as R
from tidemark.sinks import tables as T
from tidemark.streaming.stream import ingest_stream, landed_messages

DAY = "Fri, 05 Jan 2024 10:00:00 +0000"


def mail(spark, rows):
    """Messages from (account, uid[, body[, date]])."""
    full = [(r[1], r[0], f"s{r[1]}", "x@y", r[3] if len(r) > 3 else DAY, r[2] if len(r) > 2 else f"{r[0]} {r[1]}") for r in rows]
    return spark.createDataFrame(full, S.MESSAGE)


def accounts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "account_id string")


def answers(messages, skip=()):
    from tidemark.functions.fingerprint import fingerprint
    hit = messages.select("uid", fingerprint().alias("content_hash")).filter(~F.col("uid").isin(list(skip)))
    return hit.select("content_hash", F.lit("m1").alias("model_version"), F.lit('{"priority": "Low", "summary": "x"}').alias("raw_json")).distinct()


def stored(spark, lay):
    return sorted((r.account_id, r.uid) for r in T.read_store(spark, lay).collect())


def opts(run_id, **k):
    return I.IngestOptions(run_id=run_id, model="m1", **{"init_start_date": "2024-01-01", **k})


def test_reused_run_id_keeps_both_runs(spark, tmp_root):
    lay, acc = T.Layout(tmp_root, 4), accounts(spark, "a")
    for uids in (range(1, 6), range(1, 8)):
        m = mail(spark, [("a", u) for u in uids])
        R.run_ingest(spark, lay, m, acc, opts("daily"), responses=answers(m))
    assert stored(spark, lay) == [("a", u) for u in range(1, 8)]
    assert sorted(r.id for r in T.read_store(spark, lay).collect()) == list(range(1, 8))
    m = mail(spark, [("a", 9)])
    again = R.run_ingest(spark, lay, m, acc, opts("daily", batch_id=0), responses=answers(m))
    assert again["replayed"] and len(stored(spark, lay)) == 7


def land(spark, root, name, messages):
    messages.coalesce(1).write.parquet(os.path.join(root, "landed", name))


def run_stream(spark, lay, root, acc, resp, o):
    src = landed_messages(spark, os.path.join(root, "landed", "*"), max_files=1)
    return ingest_stream(spark, src, lay, acc, o, os.path.join(root, "ck"), responses=resp)[1]


def test_late_files_are_stored(spark, tmp_root):
    lay, acc = T.Layout(os.path.join(tmp_root, "store"), 4), accounts(spark, "a")
    everything = mail(spark, [("a", u) for u in range(1, 11)])
    land(spark, tmp_root, "p1", everything.filter("uid > 5"))
    run_stream(spark, lay, tmp_root, acc, answers(everything), opts("s"))
    land(spark, tmp_root, "p2", everything.filter("uid <= 6"))
    run_stream(spark, lay, tmp_root, acc, answers(everything), opts("s"))
    assert stored(spark, lay) == [("a", u) for u in range(1, 11)]
    assert T.read_cursors(spark, lay).first()["last_uid"] == 10


def test_rejected_accounts_wait_in_the_backlog(spark, tmp_root):
    lay, acc = T.Layout(os.path.join(tmp_root, "store"), 4), accounts(spark, "a")
    m = mail(spark, [("a", 1), ("a", 2), ("b", 1)])
    land(spark, tmp_root, "p1", m)
    run_stream(spark, lay, tmp_root, acc, answers(m), opts("s", init_start_date=None))
    assert stored(spark, lay) == [] and T.read_backlog(spark, lay).count() == 3
    late = mail(spark, [("a", 3)])
    land(spark, tmp_root, "p2", late)
    run_stream(spark, lay, tmp_root, acc, answers(m.unionByName(late)), opts("s"))
    assert stored(spark, lay) == [("a", 1), ("a", 2), ("a", 3)]
    assert [(r.account_id, r.uid) for r in T.read_backlog(spark, lay).collect()] == [("b", 1)]


def test_replay_of_a_partly_pending_batch(spark, tmp_root):
    lay, acc = T.Layout(tmp_root, 4), accounts(spark, "a")
    m = mail(spark, [("a", u, "x" * 15_000 if u == 5 else f"body {u}") for u in range(1, 7)])
    first = R.run_ingest(spark, lay, m, acc, opts("s", batch_id=0), responses=answers(m, skip=[4]), keep_backlog=True)
    assert first["emitted"] == 3 and T.read_backlog(spark, lay).count() == 3
    assert T.read_backlog(spark, lay).filter("uid = 5").select(F.length("body")).first()[0] == 15_000
    again = R.run_ingest(spark, lay, m, acc, opts("s", batch_id=0), responses=answers(m), keep_backlog=True)
    assert again["replayed"] and stored(spark, lay) == [("a", u) for u in (1, 2, 3)]
    rest = T.read_backlog(spark, lay)
    R.run_ingest(spark, lay, m.unionByName(rest).dropDuplicates(["account_id", "uid"]), acc, opts("s", batch_id=1), responses=answers(m), keep_backlog=True)
    assert stored(spark, lay) == [("a", u) for u in range(1, 7)] and T.read_backlog(spark, lay).count() == 0


def test_undatable_and_zoned_messages_pass_the_date_floor(spark):
    dates = ["Fri, 05 Jan 2024 10:00:00 EST", "garbled", None, "2024-01-05", "5 Jan 2024 10:00 PDT", "31 Dec 2023 20:00 PST", "2023-12-31"]
    m = mail(spark, [("a", i, "b", d) for i, d in enumerate(dates, 1)])
    o = opts("r")
    plan = I.run_plan(accounts(spark, "a"), spark.createDataFrame([], S.CURSORS), o)
    got = {r.uid: str(r.sent_at) for r in I.fetch(m, plan, o).collect()}
    assert got == {1: "2024-01-05 15:00:00", 2: "None", 3: "None", 4: "2024-01-05 00:00:00", 5: "2024-01-05 17:00:00", 6: "2024-01-01 04:00:00"}
    landed = m.withColumn("received_date", F.when(F.col("uid") == 7, F.to_date(F.lit("2024-01-02"))).when(F.col("uid") == 1, F.to_date(F.lit("2023-12-30"))))
    assert {r.uid for r in I.fetch(landed, plan, o).collect()} == {2, 3, 4, 5, 6, 7}


def test_one_answer_per_fingerprint(spark, tmp_root):
    m = mail(spark, [("a", 1, "same"), ("a", 2, "other")]).unionByName(
        mail(spark, [("b", 1, "same")])).withColumn("subject", F.lit("s"))
    acc = accounts(spark, "a", "b")
    base = answers(m)
    two = base.unionByName(base.withColumn("model_version", F.lit("m2")))
    lay = T.Layout(os.path.join(tmp_root, "x"), 4)
    s = R.run_ingest(spark, lay, m, acc, I.IngestOptions(run_id="r", init_start_date="2024-01-01"), responses=two)
    assert s["fetched"] == s["emitted"] == 3 and len(stored(spark, lay)) == 3

    def enricher(req):                             # one answer per request: every copy under force
        return req.select("content_hash", "model_version", F.lit('{"priority": "Low", "summary": "x"}').alias("raw_json"))
    lay = T.Layout(os.path.join(tmp_root, "y"), 4)
    s = R.run_ingest(spark, lay, m, acc, opts("r", force_reprocess=True), enricher=enricher)
    assert s["fetched"] == s["emitted"] == 3 and len(stored(spark, lay)) == 3


def test_a_failed_call_is_quarantined_and_the_cursor_passes(spark, tmp_root):
    lay, m = T.Layout(tmp_root, 4), mail(spark, [("a", 1), ("a", 2), ("a", 3)])
    from tidemark.functions.fingerprint import fingerprint
    bad = m.filter("uid = 2").select(fingerprint().alias("h")).first().h
    resp = answers(m).withColumn("error", F.when(F.col("content_hash") == bad, F.lit("call failed: 503")))
    s = R.run_ingest(spark, lay, m, accounts(spark, "a"), opts("r"), responses=resp)
    assert s["errors"] == 1 and s["emitted"] == 3 and T.read_cursors(spark, lay).first()["last_uid"] == 3
    row = T.read_store(spark, lay).filter("uid = 2").first()
    assert row.priority == "Error" and "503" in row.summary


def test_one_undeliverable_account_holds_only_its_own_cursor(spark, tmp_root):
    lay, acc = T.Layout(tmp_root, 4), accounts(spark, "a", "b")
    m = mail(spark, [("a", 1), ("b", 1), ("b", 2)])
    s = R.run_ingest(spark, lay, m, acc, opts("r"), responses=answers(m), sink=lambda df, b: ["a"])
    assert s["emit_ok"] and s["failed_accounts"] == ["a"] and stored(spark, lay) == [("b", 1), ("b", 2)]
    assert {r.account_id: r.last_uid for r in T.read_cursors(spark, lay).collect()} == {"b": 2}
    assert {r.account_id: r.status for r in T.read_audit(spark, lay).collect()} == {"a": "FAIL", "b": "SUCCESS"}
    R.run_ingest(spark, lay, m, acc, opts("r"), responses=answers(m))
    assert stored(spark, lay) == [("a", 1), ("b", 1), ("b", 2)]


def test_runs_on_different_accounts_at_once(spark, tmp_root):
    lay, acc = T.Layout(tmp_root, 4), accounts(spark, "a", "b")
    m = mail(spark, [(x, u) for x in "ab" for u in range(1, 6)]).cache()

    def go(name):
        return R.run_ingest(spark, lay, m, acc, opts(f"run-{name}", target_account=name), responses=answers(m))
    with ThreadPoolExecutor(2) as pool:
        assert [s["emitted"] for s in pool.map(go, "ab")] == [5, 5]
    assert stored(spark, lay) == [(x, u) for x in "ab" for u in range(1, 6)]
    assert len({r.id for r in T.read_store(spark, lay).collect()}) == 10
    assert {r.account_id: r.last_uid for r in T.read_cursors(spark, lay).collect()} == {"a": 5, "b": 5}


def test_a_commit_leaves_the_files_of_other_writers(spark, tmp_root):
    """Of two runs that end at once, one took the other's files from under it."""
    from tidemark.sinks.cache import open_cache, upsert_cache
    lay = T.Layout(tmp_root, 4)
    other = os.path.join(lay.commits, "_temporary", "0", "task")
    os.makedirs(other)
    T.commit(spark, lay, "a", 0, 2)
    T.commit(spark, lay, "b", 0, 3)
    assert os.path.isdir(other)
    assert [(r.run_id, r.seq, r.rows) for r in T.commits(spark, lay).orderBy("seq").collect()] == [("a", 1, 2), ("b", 2, 3)]
    upsert_cache(spark, lay, spark.createDataFrame([], S.CACHE))
    assert open_cache(spark, lay).latest().count() == 0 and os.listdir(os.path.join(lay.cache, "deltas")) == ["delta=0"]


def test_files_hold_disjoint_id_ranges(spark, tmp_root):
    lay, m = T.Layout(tmp_root, 4), mail(spark, [("a", u) for u in range(1, 1001)])
    rows = I.store_rows(I.outcomes(I.fetch(m, I.run_plan(accounts(spark, "a"), spark.createDataFrame([], S.CURSORS), opts("r")), opts("r")),
                                   None, answers(m), opts("r"), staged=False)[0], opts("r"))
    from tidemark.operators.ids import assign_dense_ids
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        T.append_store(assign_dense_ids(rows, ["account_id", "uid"], num_partitions=64), lay, "r", 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.parquet(lay.emails).groupBy(F.input_file_name()).agg(F.min("position").alias("a"), F.max("position").alias("b")).orderBy("a").collect()
    assert len(files) > 1 and all(x.b < y.a for x, y in zip(files, files[1:]))
