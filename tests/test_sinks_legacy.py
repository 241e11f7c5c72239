"""K7 JSON file sink, K8 report sink, K9 JSON text, K10 partition sink, P14 legacy decode."""
import glob
import json
import os

from pyspark.sql import functions as F

from tidemark import constants as K
from tidemark import schemas as S
from tidemark.functions.render import json_text, report_text
from tidemark.sinks.emit import json_file_sink, partition_sink, report_sink
from tidemark.sources.legacy import decode_legacy, encode_legacy


def results(spark):
    rows = [("acc1", 1, (1, "High", "Sum one", ["Order 7", "Paris"], True, False)),
            ("acc1", 2, (2, "Error", "bad", [], True, True)),
            ("acc2", 3, (3, "Spam", None, None, False, None))]
    df = spark.createDataFrame(rows, f"account_id string, uid long, result {S.RESULT.simpleString()}")
    return df.withColumn("run_id", F.lit("r1"))


def expected_block(uid, pri, summary, ents, action, trunc):
    banner = {"High": K.REPORT_BANNER_HIGH, "Medium": K.REPORT_BANNER_MEDIUM,
              "Spam": K.REPORT_BANNER_SPAM}.get(pri, K.REPORT_BANNER_OTHER)
    act = K.REPORT_ACTION if action else K.REPORT_NO_ACTION
    bullets = "".join(f"\n{K.REPORT_ENTITY_BULLET}{t}\n" for t in ents) if ents else f"\n{K.REPORT_NO_ENTITIES}\n"
    return (f"{K.REPORT_RULE}\n{K.REPORT_TITLE}{banner}]\n{K.REPORT_RULE}\n{K.REPORT_UID}{uid}\n"
            f"{K.REPORT_TRUNCATED}{'Yes' if trunc else 'No'}\n\n{K.REPORT_SUMMARY}\n{summary}\n\n"
            f"\n{act}\n\n\n{K.REPORT_ENTITIES}\n{bullets}\n{K.REPORT_RULE}")


def test_report_text_blocks(spark):
    got = {r.uid: r.t for r in results(spark).select("uid", report_text("result").alias("t")).collect()}
    assert got[1] == expected_block(1, "High", "Sum one", ["Order 7", "Paris"], True, False)
    assert got[2] == expected_block(2, "Error", "bad", [], True, True)      # Error shows the LOW banner
    assert got[3] == expected_block(3, "Spam", "None", [], False, False)


def written(out):
    files = glob.glob(os.path.join(out, "run_id=r1", "batch_id=*", "account_id=*", "*.txt"))
    return [(f.split(os.sep)[-3], f.split(os.sep)[-2], json.loads(line)["original_uid"]) for f in files for line in open(f, encoding="utf-8")]


def test_json_file_sink_keeps_batches_apart(spark, tmp_root):
    out = os.path.join(tmp_root, "json")
    json_file_sink(out)(results(spark), 0)
    first = [("batch_id=0", "account_id=acc1", 1), ("batch_id=0", "account_id=acc1", 2), ("batch_id=0", "account_id=acc2", 3)]
    assert sorted(written(out)) == first
    one = results(spark).filter("account_id = 'acc1' AND uid = 1")
    json_file_sink(out)(one, 1)                # a later batch adds to the first
    json_file_sink(out)(one, 1)                # and its replay replaces only itself
    assert sorted(written(out)) == first + [("batch_id=1", "account_id=acc1", 1)]


def test_report_sink_and_json_text(spark, tmp_root):
    out = os.path.join(tmp_root, "rep")
    report_sink(out)(results(spark), 0)
    text = "".join(open(f, encoding="utf-8").read() for f in glob.glob(os.path.join(out, "run_id=r1", "batch_id=0", "account_id=acc2", "*.txt")))
    assert K.REPORT_BANNER_SPAM in text
    j = json.loads(results(spark).filter("uid = 1").select(json_text("result")).first()[0])
    assert j == {"original_uid": 1, "priority": "High", "summary": "Sum one", "key_entities": ["Order 7", "Paris"],
                 "action_required": True, "is_truncated": False}


def test_partition_sink_names_the_accounts_that_fail(spark):
    def down_for_one(rows):
        assert len(rows) <= 1 and {"run_id", "account_id", "uid", "result_json"} <= set(rows[0])
        if rows[0]["account_id"] == "acc2":
            raise RuntimeError("endpoint down")

    assert partition_sink(down_for_one, retries=3, backoff_s=0.0, chunk=1)(results(spark).coalesce(1), 0) == ["acc2"]

    def flaky_factory():
        state = {"n": 0}

        def flaky(rows):
            state["n"] += 1
            if state["n"] < 3:              # fails twice inside the task, then delivers
                raise RuntimeError("429")
        return flaky

    assert partition_sink(flaky_factory(), retries=3, backoff_s=0.0)(results(spark).coalesce(1), 0) == []


def test_legacy_decode_roundtrip(spark):
    rows = spark.createDataFrame([('["a", "b"]', 1, 0), ("not json", 0, None), ("", None, 1), (None, 1, 1),
                                  ("[1]", 0, 0)], "key_entities string, action_required int, is_truncated int")
    got = decode_legacy(rows).collect()
    assert [(r.key_entities, r.key_entities_raw, r.action_required, r.is_truncated) for r in got] == [
        (["a", "b"], None, True, False), (None, "not json", False, None), (None, None, None, True),
        (None, None, True, True), (None, "[1]", False, False)]
    typed = spark.createDataFrame([(["x"], True, False)], "key_entities array<string>, action_required boolean, is_truncated boolean")
    back = decode_legacy(encode_legacy(typed)).first()
    assert (back.key_entities, back.action_required, back.is_truncated) == (["x"], True, False)
    assert F is not None
