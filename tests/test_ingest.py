"""O1/O2 run plan, guard, force/reset, enrichment outcomes, quarantine,
emit failure, replay and audit (behaviour the original left untested)."""
import pytest
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.operators.ids import assign_dense_ids
from tidemark.plans import ingest as I
from tidemark.plans import run as R
from tidemark.sinks import tables as T
from tidemark.sources import tables as TB

SF = "/root/testdata/sf0.001"


def msgs(spark, rows):
    return spark.createDataFrame(rows, S.MESSAGE)


def test_run_plan_guard_force_reset(spark):
    acc = spark.createDataFrame([("a",), ("b",)], "account_id string")
    cur = spark.createDataFrame([("a", 10, None)], S.CURSORS)

    def plan(**o):
        return {r.account_id: (r.stored_uid, r.start_uid, r.before_uid, r.guard_ok)
                for r in I.run_plan(acc, cur, I.IngestOptions(run_id="r", **o)).collect()}

    assert plan() == {"a": (10, 11, 10, True), "b": (0, 1, 0, False)}          # first run needs a date
    assert plan(init_start_date="2024-01-01")["b"] == (0, 1, 0, True)
    assert plan(force_from_uid=5) == {"a": (10, 5, 4, True), "b": (0, 5, 4, True)}
    assert plan(force_from_uid=1)["b"][3] is True and plan(force_from_uid=0)["b"][3] is True
    assert plan(reset_cursor=True) == {"a": (0, 1, 0, False), "b": (0, 1, 0, False)}
    assert plan(target_account="b") == {"b": (0, 1, 0, False)}


def test_unknown_target_account_raises(spark):
    acc = spark.createDataFrame([("a",)], "account_id string")
    try:
        I.run_plan(acc, spark.createDataFrame([], S.CURSORS), I.IngestOptions(run_id="r", target_account="zz"))
    except ValueError:
        return
    raise AssertionError("expected ValueError")


def _world(spark):
    m = msgs(spark, [
        (1, "a", "s1", "x@y", "2024-01-02", "same body"),
        (2, "a", "s2", "x@y", "2024-01-03", "bad answer"),
        (3, "a", "s3", "x@y", "2024-01-04", "no answer"),
        (4, "a", "s4", "x@y", "2024-01-05", "after pending"),
        (1, "b", "s1", "x@y", "2024-01-02", "same body"),
        (2, "b", "s2", "x@y", "2024-01-03", "bad answer"),
    ])
    hashes = {r.body: r.h for r in m.select("body", TB.fingerprint().alias("h")).collect()}
    resp = spark.createDataFrame([
        (hashes["same body"], "m1", '{"priority": "High", "summary": "ok", "key_entities": ["k"], "action_required": "yes"}', None),
        (hashes["bad answer"], "m1", '{"priority": "URGENT"}', None),
        (hashes["after pending"], "m1", '{"summary": "later"}', None),
    ], S.RESPONSES)
    return m, resp


def test_outcomes_fanout_quarantine_and_hold_back(spark):
    m, resp = _world(spark)
    acc = m.select("account_id").distinct()
    opts = I.IngestOptions(run_id="r", model="m1", init_start_date="2024-01-01")
    plan = I.run_plan(acc, spark.createDataFrame([], S.CURSORS), opts)
    batch = I.fetch(m, plan, opts)
    out, writes = I.outcomes(batch, spark.createDataFrame([], S.CACHE), resp, opts)
    got = {(r.account_id, r.uid): (r.outcome, r.held, r.result.priority if r.result else None,
                                   r.result.original_uid if r.result else None) for r in out.collect()}
    assert got[("a", 1)] == ("fresh", False, "High", 1)
    assert got[("b", 1)] == ("hit", False, "High", 1)             # copy: served by the leader's answer, own uid
    assert got[("a", 2)] == ("quarantined", False, "Error", 2)
    assert got[("b", 2)] == ("quarantined", False, "Error", 2)     # failures are not cached: each copy fails
    assert got[("a", 3)] == ("pending", True, None, None)
    assert got[("a", 4)] == ("fresh", True, "Low", 4)              # decided but held behind the pending uid
    w = {r.uid: r.result.summary for r in writes.collect()}
    assert w == {1: "ok", 4: "later"}
    stats = {r.account_id: (r.fetched, r.emitted, r.after_uid, r.advances) for r in I.account_stats(plan, out).collect()}
    assert stats == {"a": (4, 2, 2, True), "b": (2, 2, 2, True)}


def test_force_reprocess_calls_every_copy(spark):
    m, resp = _world(spark)
    acc = m.select("account_id").distinct()
    opts = I.IngestOptions(run_id="r", model="m1", init_start_date="2024-01-01", force_reprocess=True)
    plan = I.run_plan(acc, spark.createDataFrame([], S.CURSORS), opts)
    out, writes = I.outcomes(I.fetch(m, plan, opts), spark.createDataFrame([], S.CACHE), resp, opts)
    got = {(r.account_id, r.uid): r.outcome for r in out.collect()}
    assert got[("a", 1)] == got[("b", 1)] == "fresh"
    assert {r.uid: r.account_id for r in writes.collect()}[1] == "b"   # the last copy's write wins


def test_dense_ids_equal_global_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") % 7).cast("string").alias("account_id"),
                                     (F.col("id") * 13 % 5000).alias("uid"))
    got = assign_dense_ids(df, ["account_id", "uid"], 100, "id", num_partitions=6)
    rows = sorted((r.account_id, r.uid, r.id) for r in got.collect())
    assert [r[2] for r in rows] == list(range(101, 5101))


def test_dense_ids_plan_has_no_single_partition_exchange(spark):
    df = spark.range(0, 1000).select(F.col("id").cast("string").alias("account_id"), F.col("id").alias("uid"))
    got = assign_dense_ids(df, ["account_id", "uid"], 0, "id", num_partitions=4)
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_run_ingest_commit_protocol(spark, tmp_root):
    lay = T.Layout(tmp_root, 4)
    m = TB.messages(spark, SF)
    acc = TB.accounts(m)
    resp = TB.responses(spark, SF, m)
    # first run without a start date: every account is rejected, nothing written
    s0 = R.run_ingest(spark, lay, m, acc, I.IngestOptions(run_id="r0", model="m1"), responses=resp)
    assert s0["rejected"] == 20 and s0["fetched"] == 0 and T.read_cursors(spark, lay).count() == 0
    assert T.read_audit(spark, lay).count() == 0

    s1 = R.run_ingest(spark, lay, m, acc, I.IngestOptions(run_id="r1", model="m1", init_start_date="2024-01-01"),
                      responses=resp)
    store = T.read_store(spark, lay)
    n1 = store.count()
    assert n1 == s1["emitted"] > 0
    ids = sorted(r.id for r in store.collect())
    assert ids == list(range(1, n1 + 1))
    cur1 = {r.account_id: r.last_uid for r in T.read_cursors(spark, lay).collect()}
    assert len(cur1) == 20

    # emit failure: store rows of the batch are rolled back, cursors stay, FAIL audit
    def broken(df, batch_id):
        raise RuntimeError("sink down")
    s2 = R.run_ingest(spark, lay, m, acc, I.IngestOptions(run_id="r2", model="m1", force_from_uid=1),
                      responses=resp, sink=broken)
    assert s2["emit_ok"] is False and s2["llm_calls"] == 0 and s2["cache_hits"] > 0   # replay served by the cache
    assert T.read_store(spark, lay).count() == n1
    assert {r.account_id: r.last_uid for r in T.read_cursors(spark, lay).collect()} == cur1
    fails = T.read_audit(spark, lay).filter("run_id = 'r2'").collect()
    assert fails and all(r.status == "FAIL" and r.after_uid == r.before_uid for r in fails)

    # replaying a committed (run, batch) changes nothing; without a batch id the run takes its next one
    s3 = R.run_ingest(spark, lay, m, acc, I.IngestOptions(run_id="r1", batch_id=0, model="m1", init_start_date="2024-01-01",
                                                          force_from_uid=1), responses=resp)
    assert s3["replayed"] and T.read_store(spark, lay).count() == n1
    s3b = R.run_ingest(spark, lay, m, acc, I.IngestOptions(run_id="r1", model="m1", init_start_date="2024-01-01",
                                                           force_from_uid=1), responses=resp)
    st = T.read_store(spark, lay)
    assert s3b["batch_id"] == 1 and st.count() == 2 * s3b["emitted"] == 2 * n1

    # nothing new: SUCCESS audit with "No new emails"
    s4 = R.run_ingest(spark, lay, m, acc, I.IngestOptions(run_id="r4", model="m1"), responses=resp)
    assert s4["emitted"] == 0
    a4 = T.read_audit(spark, lay).filter("run_id = 'r4'").collect()
    assert any(r.error_msg == "No new emails" and r.emails_processed == 0 for r in a4)


def test_dry_run_writes_nothing(spark, tmp_root):
    lay = T.Layout(tmp_root, 4)
    m = TB.messages(spark, SF)
    seen = []
    s = R.run_ingest(spark, lay, m, TB.accounts(m),
                     I.IngestOptions(run_id="d", model="m1", mode="dry", init_start_date="2024-01-01"),
                     sink=lambda df, b: seen.append(df.count()))
    assert s["emitted"] == 200 and seen == []             # no delivery either
    assert T.read_store(spark, lay).count() == 0 and T.read_cursors(spark, lay).count() == 0


def test_hot_fingerprint_split_matches_plain_join(spark):
    m, resp = _world(spark)
    acc = m.select("account_id").distinct()
    base = dict(run_id="r", model="m1", init_start_date="2024-01-01")
    plan = I.run_plan(acc, spark.createDataFrame([], S.CURSORS), I.IngestOptions(**base))

    def run(hot):
        opts = I.IngestOptions(**base, hot_rows=hot)
        out, _ = I.outcomes(I.fetch(m, plan, opts), spark.createDataFrame([], S.CACHE), resp, opts)
        return sorted((r.account_id, r.uid, r.outcome, r.held, str(r.result)) for r in out.collect())

    assert run(2) == run(10 ** 9)                   # hashes with >= 2 copies take the broadcast path
    from tidemark.operators.joins import join_hot_split
    big = spark.createDataFrame([("h", i) for i in range(10)] + [("c", 1)], "k string, v long")
    per = spark.createDataFrame([("h", 10, "H"), ("c", 1, "C")], "k string, n long, d string")
    got = join_hot_split(big, per, "k", "n", hot_rows=5)
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.k, r.d) for r in got.collect()) == sorted([("h", "H")] * 10 + [("c", "C")])


def _crash(monkeypatch, at):
    """The next run dies where it calls ``at`` of the tables."""
    def die(*a, **k):
        raise RuntimeError("died")
    monkeypatch.setattr(T, at, die)


def test_a_crash_before_the_commit_leaves_nothing(spark, tmp_root, monkeypatch):
    lay = T.Layout(tmp_root, 4)
    m = TB.messages(spark, SF)
    acc, resp = TB.accounts(m), TB.responses(spark, SF, m)
    for at in ("write_moves", "commit"):
        with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="died"):
            _crash(patch, at)
            R.run_ingest(spark, lay, m, acc, I.IngestOptions(run_id="c1", model="m1", init_start_date="2024-01-01"), responses=resp)
        assert spark.read.parquet(lay.emails).count() > 0
        assert T.read_store(spark, lay).count() == 0 and T.read_cursors(spark, lay).count() == 0
    # other runs leave it unseen, append the batch once and number from 1
    s = R.run_ingest(spark, lay, m, acc, I.IngestOptions(run_id="c2", model="m1", init_start_date="2024-01-01"), responses=resp)
    st = T.read_store(spark, lay)
    assert sorted(r.id for r in st.collect()) == list(range(1, s["emitted"] + 1))
    assert {r.run_id for r in st.select("run_id").distinct().collect()} == {"c2"}
    T.vacuum(spark, lay, "c1")
    assert {r.run_id for r in spark.read.parquet(lay.emails).select("run_id").distinct().collect()} == {"c2"}
    # the same run with nothing new replaces what its crash left
    R.run_ingest(spark, lay, m, acc, I.IngestOptions(run_id="c1", model="m1"), responses=resp)
    assert T.read_store(spark, lay).count() == s["emitted"]


def test_a_crash_between_two_runs_of_other_accounts_loses_nothing(spark, tmp_root, monkeypatch):
    """Run b is in its sink while run a writes everything but its commit and dies."""
    lay = T.Layout(tmp_root, 4)
    m, resp = _world(spark)
    acc = m.select("account_id").distinct()
    opts = lambda run, who: I.IngestOptions(run_id=run, model="m1", init_start_date="2024-01-01", target_account=who)

    def while_b_delivers(df, b):
        with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="died"):
            _crash(patch, "commit")
            R.run_ingest(spark, lay, m, acc, opts("a1", "a"), responses=resp)
    R.run_ingest(spark, lay, m, acc, opts("b1", "b"), responses=resp, sink=while_b_delivers)
    assert {r.account_id for r in T.read_cursors(spark, lay).collect()} == {"b"}
    R.run_ingest(spark, lay, m, acc, opts("a2", "a"), responses=resp)
    want = m.join(R.T.read_cursors(spark, lay), "account_id").filter("uid <= last_uid").select("account_id", "uid")
    st = T.read_store(spark, lay)
    assert sorted(map(tuple, st.select("account_id", "uid").collect())) == sorted(map(tuple, want.collect()))
    assert sorted(r.id for r in st.collect()) == list(range(1, st.count() + 1))


def test_commits_of_one_moment_share_no_ids(spark, tmp_root):
    """Both writers saw the same last number before either committed."""
    lay = T.Layout(tmp_root, 4)
    m, resp = _world(spark)
    acc = m.select("account_id").distinct()
    for run, who in (("z", "a"), ("y", "b")):
        R.run_ingest(spark, lay, m, acc, I.IngestOptions(run_id=run, model="m1", init_start_date="2024-01-01", target_account=who), responses=resp)
    twins = T.commits(spark, lay).withColumn("seq", F.lit(1).cast("long")).select(*T.COMMITS.fieldNames()).collect()
    T.delete(spark, lay.commits)
    spark.createDataFrame(twins, T.COMMITS).write.parquet(lay.commits)
    rows = T.read_store(spark, lay).collect()
    assert sorted(r.id for r in rows) == list(range(1, len(rows) + 1)) and {r.run_id for r in rows} == {"y", "z"}
    assert T.read_store(spark, lay, 2).count() == len(rows) - 2


def test_empty_batch_skips_sink_and_run_id_format(spark, tmp_root):
    lay = T.Layout(tmp_root, 4)
    m = TB.messages(spark, SF)
    called = []
    s = R.run_ingest(spark, lay, m, TB.accounts(m), I.IngestOptions(run_id=R.new_run_id(), model="m1"),
                     sink=lambda df, b: called.append(b))     # first run without a date: nothing fetched
    assert called == [] and s["emit_ok"] is True and s["elapsed_sec"] >= 0
    rid = R.new_run_id()
    assert len(rid) == 8 and all(c in "0123456789abcdef" for c in rid)


def test_fetch_pushes_global_uid_floor_into_scan(spark, tmp_root):
    spark.range(0, 3000).selectExpr("id + 1 as uid", "concat('a', id % 3) as account_id", "'s' as subject",
                                    "'x@y' as sender", "'2024-01-05' as date", "'b' as body").write.parquet(tmp_root + "/m")
    m = spark.read.parquet(tmp_root + "/m")
    cur = spark.createDataFrame([("a0", 2000, None), ("a1", 2500, None), ("a2", 2200, None)], S.CURSORS)
    opts = I.IngestOptions(run_id="r", model="m1")
    b = I.fetch(m, I.run_plan(m.select("account_id").distinct(), cur, opts), opts)
    assert "GreaterThanOrEqual(uid,2001)" in b._jdf.queryExecution().executedPlan().toString()
    want = sum(1 for i in range(3000) if i + 1 > {0: 2000, 1: 2500, 2: 2200}[i % 3])
    assert b.count() == want


def test_batches_of_a_run_keep_their_audit_rows(spark, tmp_root):
    lay = T.Layout(tmp_root, 4)
    m = TB.messages(spark, SF)
    acc, resp = TB.accounts(m), TB.responses(spark, SF, m)
    for b in (0, 1):
        R.run_ingest(spark, lay, m, acc, I.IngestOptions(run_id="k3", model="m1", init_start_date="2024-01-01", batch_id=b), responses=resp)
    got = {r.batch_id for r in T.read_audit(spark, lay).filter("run_id = 'k3'").collect()}
    assert got == {0, 1}


def test_enricher_callable_is_called_once_per_needed_fingerprint(spark, tmp_root):
    lay = T.Layout(tmp_root, 4)
    m, _ = _world(spark)
    acc = m.select("account_id").distinct()
    seen = []

    def enricher(req):
        # a stand-in model: answers every request from its prompt text
        seen.append(req.count())
        return req.select("content_hash", "model_version", F.concat(
            F.lit('{"priority": "'), F.when(F.col("prompt").contains("bad"), F.lit("Spam")).otherwise(F.lit("Low")),
            F.lit('", "summary": "auto"}')).alias("raw_json"))

    s = R.run_ingest(spark, lay, m, acc, I.IngestOptions(run_id="e1", model="m1", init_start_date="2024-01-01"),
                     enricher=enricher)
    assert seen == [4]                      # 4 distinct fingerprints among 6 messages
    assert s["llm_calls"] == 4 and s["cache_hits"] == 2 and s["pending"] == 0
    pri = {(r.account_id, r.uid): r.priority for r in T.read_store(spark, lay).collect()}
    assert pri[("a", 2)] == pri[("b", 2)] == "Spam" and pri[("a", 1)] == "Low"
    # second run: everything is cached, the enricher gets nothing to answer
    seen.clear()
    s2 = R.run_ingest(spark, lay, m, acc, I.IngestOptions(run_id="e2", model="m1", force_from_uid=1), enricher=enricher)
    assert seen in ([], [0]) and s2["cache_hits"] == 6 and s2["llm_calls"] == 0
