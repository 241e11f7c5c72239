"""O3 query layer: F1-F7, L1, A4, L3, W2, A9, P15 (cases mirror the original tests)."""
import datetime as dt

from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions.dates import parse_sent_at
from tidemark.functions.render import TABLE_HEADER, TABLE_RULE
from tidemark.plans import query as Q


def store(spark, rows):
    """rows: (id, account_id, uid, hash, priority, date, run_id)"""
    full = []
    for i, acc, uid, h, pri, date, run in rows:
        full.append((i, run, 0, acc, uid, h, f"S{uid}", "a@x", date, None, "body", pri, "sum",
                     ["e"] if pri else None, True if pri else None, False if pri else None, "m1", None))
    df = spark.createDataFrame(full, S.EMAILS)
    return df.withColumn("sent_at", parse_sent_at("date"))


def ids(df):
    return [r.id for r in df.collect()]


def test_date_range_on_iso_dates(spark):
    s = store(spark, [(i, "box", i, f"h{i}", "Medium", f"2025-11-{d:02}", "r") for i, d in enumerate((3, 9, 14, 20, 27), 1)])
    for legacy in (False, True):
        assert ids(Q.query_page(s, since="2025-11-09", until="2025-11-21", legacy_text_dates=legacy)) == [2, 3, 4]
        assert ids(Q.query_page(s, since="2025-11-28", legacy_text_dates=legacy)) == []


def test_until_includes_the_whole_day_unless_legacy(spark):
    s = store(spark, [(1, "a", 1, "h1", "Low", "2026-04-05T10:00:00", "r")])
    assert ids(Q.query_page(s, until="2026-04-05")) == [1]
    assert ids(Q.query_page(s, until="2026-04-05", legacy_text_dates=True)) == []


def test_raw_header_dates_legacy_vs_parsed(spark):
    s = store(spark, [(1, "a", 1, "h1", "Low", "Mon, 05 Jan 2026 10:00:00 +0000", "r")])
    assert ids(Q.query_page(s, since="2026-02-01", legacy_text_dates=True)) == [1]   # letters sort after digits
    assert ids(Q.query_page(s, until="2026-12-31", legacy_text_dates=True)) == []
    assert ids(Q.query_page(s, since="2026-02-01")) == []
    assert ids(Q.query_page(s, until="2026-12-31")) == [1]


def test_combined_filters(spark):
    s = store(spark, [(i, f"box{i % 2}", 100 + i, "h", ("Spam", "Medium")[i % 3 == 0], f"2025-06-{i:02}", f"run{i // 5}") for i in range(1, 13)])
    assert ids(Q.query_page(s, account_id="box1", priority="Medium")) == [3, 9]
    assert ids(Q.query_page(s, account_id="box0", priority="Spam", since="2025-06-04", until="2025-06-09")) == [4, 8]
    assert ids(Q.query_page(s, run_id="run1", after_id=7)) == [8, 9]
    assert ids(Q.query_page(s, account_id="", priority=None, run_id="")) == list(range(1, 13))   # falsy = absent


def test_limit_and_meta(spark):
    s = store(spark, [(i, "a", i, f"h{i}", "Low", "2026-01-01", "r") for i in range(1, 6)])
    page = Q.query_page(s, limit=3)
    assert ids(page) == [1, 2, 3]
    m = Q.page_meta(page, 0, 3).first()
    assert (m["count"], m["max_id"], m["has_more"]) == (3, 3, True)
    page = Q.query_page(s, after_id=3, limit=3)
    m = Q.page_meta(page, 3, 3).first()
    assert (m["count"], m["max_id"], m["has_more"]) == (2, 5, False)
    assert ids(Q.query_page(s, limit=-1)) == [1, 2, 3, 4, 5]
    m = Q.page_meta(Q.query_page(s, limit=0), 0, 0).first()
    assert (m["count"], m["has_more"]) == (0, True)


def test_empty_store_meta_and_table(spark):
    s = store(spark, [])
    page = Q.query_page(s, after_id=0)
    meta = Q.page_meta(page, 0, 1000)
    m = meta.first()
    assert (m["count"], m["max_id"], m["has_more"]) == (0, 0, False)
    lines = [r.line for r in Q.table_lines(page, meta).orderBy("sort_key").collect()]
    assert lines == ["No results."]


def test_table_lines_format(spark):
    s = store(spark, [(7, "a", 1, "h", None, None, "r"), (123456, "a", 2, "h", "High", "2026-04-01 10:00:00 +0000", "r")])
    page = Q.query_page(s, limit=2)
    lines = [r.line for r in Q.table_lines(page, Q.page_meta(page, 0, 2)).orderBy("sort_key").collect()]
    assert lines[0] == TABLE_HEADER and lines[1] == TABLE_RULE and lines[-2] == TABLE_RULE
    assert lines[2] == f"[    7]      ? | {'':16} | {'a@x':30} | S1"
    assert lines[3] == f"[123456]   High | {'2026-04-01 10:00':16} | {'a@x':30} | S2"
    assert lines[-1] == "2 results | max_id=123456 | has_more=True"


def test_same_hash_twice_latest_wins(spark):
    s = store(spark, [(1, "a", 5, "same", "High", "2026-01-01", "r1"), (2, "a", 5, "same", "Low", "2026-01-01", "r2")])
    assert [r.priority for r in Q.query_page(s).collect()] == ["High", "Low"]
    latest = Q.latest_per_hash(s).collect()
    assert [(r.id, r.priority) for r in latest] == [(2, "Low")]


def test_priority_by_run_and_export(spark):
    s = store(spark, [(i, "a", i, f"h{i}", "Low" if i % 2 else "High", "2026-01-01", "r") for i in range(1, 8)])
    got = {(r.run_id, r.priority): r.n for r in Q.priority_by_run(s).collect()}
    assert got == {("r", "Low"): 4, ("r", "High"): 3}
    pages = {r.id: r.page_no for r in Q.export_pages(s, 2, priority="Low").collect()}
    assert pages == {1: 0, 3: 0, 5: 1, 7: 1}


def test_keyset_iteration_visits_every_row_once(spark):
    s = store(spark, [(i, "a", i, f"h{i}", "Low", "2026-01-01", "r") for i in range(1, 8)])
    seen = []
    for page, meta in Q.iterate_pages(s, limit=3):
        seen += ids(page)
    assert seen == list(range(1, 8))


def test_query_page_plan_is_top_n_with_pushed_filters(spark, tmp_root):
    s = store(spark, [(i, "a", i, f"h{i}", "Low", "2026-01-01", "r") for i in range(1, 50)])
    s.write.partitionBy("run_id", "batch_id").parquet(tmp_root + "/emails")
    t = spark.read.parquet(tmp_root + "/emails")
    plan = Q.query_page(t, after_id=10, limit=5, account_id="a", run_id="r")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,10)" in plan or "GreaterThan(id,10)" in plan
    assert "PartitionFilters: [isnotnull(run_id" in plan
    assert F is not None and dt is not None


def test_document_of_a_page(spark):
    import json

    import pytest
    rows = store(spark, [(i, "box", i, f"h{i}", "Low" if i > 1 else None, "2025-06-01", "r") for i in (3, 1, 2)])
    doc = json.loads(Q.response_document(rows, 0, 2).first()[0])
    assert [r["id"] for r in doc["results"]] == sorted(r["id"] for r in doc["results"]) and len(doc["results"]) == 2
    assert doc["meta"] == {"count": 2, "max_id": doc["results"][-1]["id"], "has_more": True}
    assert set(doc["results"][0]) == set(rows.columns)          # nulls are written out
    none = json.loads(Q.response_document(rows, 10 ** 6, 5).first()[0])
    assert none == {"results": [], "meta": {"count": 0, "max_id": 10 ** 6, "has_more": False}}
    with pytest.raises(ValueError):
        Q.response_document(rows, 0, -1)
