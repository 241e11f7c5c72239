"""K6/K10 in two steps: commit and abort, lost tasks, accounts that fail, replays."""
import os
import subprocess
import sys
import textwrap

from pyspark.sql import functions as F

from test_ingest import _world
from tidemark import schemas as S
from tidemark.plans import ingest as I
from tidemark.plans import run as R
from tidemark.sinks import tables as T
from tidemark.sinks.delivery import FolderReceiver, Staged, TwoStepWriter, read_delivered, two_step_sink

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def results(spark, n=25):
    rows = [(a, u, (u, "Low", f"{a}{u}", [], False, False)) for a in ("a", "b", "ü/c") for u in range(1, n + 1)]
    return spark.createDataFrame(rows, f"account_id string, uid long, result {S.RESULT.simpleString()}").withColumn("run_id", F.lit("r1"))


def delivered(spark, root):
    return sorted((r.batch_id, r.account_id, r.uid) for r in read_delivered(spark, root).collect())


def receivers():
    """Made here, so that they travel to the workers by value."""
    class RefusesLate(FolderReceiver):
        """Takes the first rows of account b, not the later ones."""

        def stage(self, key, account_id, rows):
            if account_id == "b" and rows[-1]["uid"] > 20:
                raise ConnectionError("full")
            return super().stage(key, account_id, rows)

    class PublishesNoB(FolderReceiver):
        def publish(self, key, account_id, parts):
            if account_id == "b":
                raise ConnectionError("away")
            super().publish(key, account_id, parts)

    return RefusesLate, PublishesNoB


def test_an_account_that_fails_is_held_whole_and_leaves_nothing(spark, tmp_root):
    for receiver in receivers():
        root = os.path.join(tmp_root, receiver.__name__)
        assert two_step_sink(spark, receiver(root), retries=2, backoff_s=0.0, chunk=4)(results(spark), 3) == ["b"]
        assert delivered(spark, root) == [(3, a, u) for a in ("a", "ü/c") for u in range(1, 26)]
        listed = {r.p for r in spark.read.json(os.path.join(root, "published", "r1-3")).select(F.explode("parts").alias("p")).collect()}
        assert listed == set(os.listdir(os.path.join(root, "parts")))      # what b staged is gone


def test_a_replay_delivers_only_what_is_missing(spark, tmp_root):
    _, PublishesNoB = receivers()
    assert two_step_sink(spark, PublishesNoB(tmp_root), backoff_s=0.0)(results(spark), 0) == ["b"]
    assert two_step_sink(spark, FolderReceiver(tmp_root), chunk=7)(results(spark), 0) == []
    assert two_step_sink(spark, FolderReceiver(tmp_root))(results(spark), 0) == []
    assert delivered(spark, tmp_root) == [(0, a, u) for a in ("a", "b", "ü/c") for u in range(1, 26)]


def test_empty_batch_and_abort(spark, tmp_root):
    receiver = FolderReceiver(tmp_root)
    assert two_step_sink(spark, receiver)(results(spark).limit(0), 0) == []
    writer = TwoStepWriter(receiver, ("r1", 0), 1, 0.0, 10)
    parts = [("a", receiver.stage(("r1", 0), "a", [{"uid": 1}]))]
    writer.abort([None, Staged(parts, {})])                                 # a task that never reported is None
    assert os.listdir(os.path.join(tmp_root, "parts")) == [] and receiver.published(("r1", 0)) == set()
    assert delivered(spark, tmp_root) == []


def test_a_lost_task_delivers_once(spark, tmp_root):
    """A worker that dies after it has staged rows: its attempt's parts lie
    there, and none of them is read."""
    script = textwrap.dedent(f"""
        import os, sys
        sys.path[:0] = [{ROOT!r}, {os.path.join(ROOT, "tests")!r}]
        from pyspark.sql import SparkSession
        from test_delivery import results
        from tidemark.sinks.delivery import FolderReceiver, two_step_sink

        class DiesOnce(FolderReceiver):
            def stage(self, key, account_id, rows):
                name = super().stage(key, account_id, rows)
                try:
                    os.close(os.open(os.path.join(self.root, "died"), os.O_CREAT | os.O_EXCL))
                except FileExistsError:
                    return name
                os._exit(1)

        spark = (SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "2").getOrCreate())
        assert two_step_sink(spark, DiesOnce({tmp_root!r}), chunk=4)(results(spark), 0) == []
    """)
    subprocess.run([sys.executable, "-c", script], check=True, cwd=ROOT, timeout=300, env={**os.environ, "PYTHONPATH": ROOT})
    assert os.path.exists(os.path.join(tmp_root, "died"))
    assert delivered(spark, tmp_root) == [(0, a, u) for a in ("a", "b", "ü/c") for u in range(1, 26)]
    staged = spark.read.json(os.path.join(tmp_root, "parts")).count()
    assert staged > 75


def test_run_holds_the_account_and_counts_while_it_writes(spark, tmp_root):
    m, resp = _world(spark)
    acc = spark.createDataFrame([("a",), ("b",), ("none",)], "account_id string")
    lay = T.Layout(os.path.join(tmp_root, "store"))
    opts = I.IngestOptions(run_id="r1", model="m1", init_start_date="2024-01-01")
    root, (_, PublishesNoB) = os.path.join(tmp_root, "out"), receivers()
    s = R.run_ingest(spark, lay, m, acc, opts, responses=resp, sink=two_step_sink(spark, PublishesNoB(root), backoff_s=0.0))
    assert s["failed_accounts"] == ["b"] and {r.account_id for r in T.read_store(spark, lay).collect()} == {"a"}
    assert delivered(spark, root) == [(0, "a", 1), (0, "a", 2)]
    # the counters gathered by the write are those of the summary query
    plan = I.run_plan(acc, spark.createDataFrame([], S.CURSORS), opts)
    out, _ = I.outcomes(I.fetch(m, plan, opts), spark.createDataFrame([], S.CACHE), resp, opts)
    want = I.run_summary(plan, out).first().asDict()
    assert {k: s[k] for k in want} == want and want["accounts"] == 3 and want["held_back"] > 0
    for mode in ("skip", "dry"):
        o = I.IngestOptions(run_id="r2", model="m1", init_start_date="2024-01-01", mode=mode)
        s = R.run_ingest(spark, T.Layout(os.path.join(tmp_root, mode)), m, acc, o)
        assert (s["accounts"], s["fetched"], s["emitted"], s["llm_calls"]) == (3, 6, 6, 0), (mode, s)
