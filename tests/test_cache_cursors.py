"""K2 cursors, K4/K5 cache, J1 probe, S6/A5 status (cases mirror the original tests)."""
import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.operators.enrich import probe_cache
from tidemark.plans.status import status_json, status_payload
from tidemark.sinks import tables as T

T0 = dt.datetime(2024, 1, 1)


def res(uid, pri):
    return (uid, pri, f"s{uid}", ["e"], False, False)


def cache_df(spark, rows):
    return spark.createDataFrame([(h, a, u, res(u, p), m, T0) for h, a, u, p, m in rows], S.CACHE)


def test_probe_match_mismatch_and_no_model(spark):
    cache = cache_df(spark, [("h1", "a", 1, "High", "m1"), ("h2", "a", 2, "Low", "m0")])
    keys = spark.createDataFrame([("h1",), ("h2",), ("h3",)], "content_hash string")
    hit = {r.content_hash: r.cached is not None for r in probe_cache(keys, cache, "m1").collect()}
    assert hit == {"h1": True, "h2": False, "h3": False}
    hit = {r.content_hash: r.cached is not None for r in probe_cache(keys, cache, None).collect()}
    assert hit == {"h1": True, "h2": True, "h3": False}


def test_upsert_overwrites_and_invalidate(spark, tmp_root):
    lay = T.Layout(tmp_root, 4)
    T.upsert_cache(spark, lay, cache_df(spark, [("h1", "acc1", 1, "High", "m1"), ("h2", "acc2", 2, "Low", "m1"),
                                               ("h3", "acc1", 3, "Spam", "m1")]))
    T.upsert_cache(spark, lay, cache_df(spark, [("h1", "acc2", 9, "Medium", "m2")]))
    got = {r.content_hash: (r.account_id, r.uid, r.result.priority, r.model_version) for r in T.read_cache(spark, lay).collect()}
    assert got == {"h1": ("acc2", 9, "Medium", "m2"), "h2": ("acc2", 2, "Low", "m1"), "h3": ("acc1", 3, "Spam", "m1")}
    # shared across accounts: acc1's message can hit the row acc2 wrote
    assert T.invalidate_cache(spark, lay, "acc1") == 1
    assert sorted(r.content_hash for r in T.read_cache(spark, lay).collect()) == ["h1", "h2"]
    assert T.invalidate_cache(spark, lay, "nobody") == 0
    assert T.invalidate_cache(spark, lay, None) == 2
    assert T.read_cache(spark, lay).count() == 0


def test_merge_cache_last_writer_wins(spark):
    cur = cache_df(spark, [("h1", "a", 1, "High", "m1")])
    new = cache_df(spark, [("h1", "b", 2, "Low", "m1"), ("h2", "b", 3, "Spam", "m1")])
    got = {r.content_hash: r.uid for r in T.merge_cache(cur, new).collect()}
    assert got == {"h1": 2, "h2": 3}


def test_cursor_default_advance_and_order(spark, tmp_root):
    lay = T.Layout(tmp_root)
    assert T.read_cursors(spark, lay).count() == 0
    mv = lambda a, n: spark.createDataFrame([(a, n, T0)], S.CURSORS)
    T.upsert_cursors(spark, lay, mv("acc", 100))
    assert T.read_cursors(spark, lay).first().last_uid == 100
    T.upsert_cursors(spark, lay, mv("acc", 250))
    T.upsert_cursors(spark, lay, mv("c@x", 1))
    T.upsert_cursors(spark, lay, mv("a@x", 2))
    rows = T.read_cursors(spark, lay).orderBy("account_id").collect()
    assert [(r.account_id, r.last_uid) for r in rows] == [("a@x", 2), ("acc", 250), ("c@x", 1)]


def test_status_fresh_and_populated(spark):
    empty = spark.createDataFrame([], S.CURSORS)
    doc = json.loads(status_json(empty, "/db").first()[0])
    assert doc == {"initialized": False, "accounts": [], "db_path": "/db"}
    cur = spark.createDataFrame([("b", 5, T0), ("a", 7, T0)], S.CURSORS)
    doc = json.loads(status_json(cur, "/db").first()[0])
    assert doc["initialized"] is True and list(doc) == ["initialized", "accounts", "db_path"]
    assert doc["accounts"] == [{"account_id": "a", "last_uid": 7, "updated_at": "2024-01-01T00:00:00"},
                               {"account_id": "b", "last_uid": 5, "updated_at": "2024-01-01T00:00:00"}]
    assert status_payload(cur, "/db").first().initialized is True
    assert F is not None
