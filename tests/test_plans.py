"""Plan shape of every registered query (sf0.001): no window over the whole
data, no cross/nested-loop joins, no row-at-a-time Python UDFs, pruned scans."""
import re

import __spark_entry__ as E
from tidemark.plans import catalog

BANNED = ["Window", "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]


def test_registered_query_plans(spark):
    seen_arrow = []
    queries = E.queries()
    for name in catalog.QUERIES:
        fn = queries[name]
        plan = fn(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        for b in BANNED:
            assert b not in plan, (name, b)
        if "MapInArrow" in plan or "MapInPandas" in plan:
            seen_arrow.append(name)
        for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
            # documents are read for their text only where a query needs it
            if name in ("run_plan", "cursor_listing", "status"):
                assert "text" not in schema, (name, schema)
    assert sorted(seen_arrow) == ["eml_html", "eml_roundtrip"]     # the one Python step: MIME walking


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) <= set(E.oracle_sql()) and set(E.oracle_sql()) <= set(E.queries())
