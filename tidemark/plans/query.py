"""O3 store queries: F1-F7 predicates, L1 ordered page, A4 page meta,
L3 keyset paging / bulk page export, W2 latest row per fingerprint,
A9 per-run priority breakdown, P15 table lines.

The store is partitioned by ``run_id`` and files are sorted by ``id``, so the
run predicate prunes partitions and the ``id > after_id`` anchor skips row
groups by min/max; ``orderBy(id).limit(n)`` plans a TakeOrderedAndProject
(per-partition top-n, then a merge of n rows per task), never a full sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import day_start
from ..functions.render import TABLE_HEADER, TABLE_RULE, table_footer, table_line
from ..operators.ids import dense_rank_pages
from ..operators.latest import latest_per_key


def predicates(after_id: int = 0, account_id: str | None = None, run_id: str | None = None,
               priority: str | None = None, since: str | None = None, until: str | None = None,
               legacy_text_dates: bool = False) -> Column:
    """conjunction of the supplied predicates; falsy values mean absent.

    Dates: by default on the parsed send time, ``until`` inclusive of the
    whole day. ``legacy_text_dates`` compares the raw header text instead
    (raw mail-form headers then pass every ``since`` and fail every ``until``).
    """
    conds = [F.col("id") > F.lit(int(after_id or 0))]
    if account_id:
        conds.append(F.col("account_id") == account_id)
    if run_id:
        conds.append(F.col("run_id") == run_id)
    if priority:
        conds.append(F.col("priority") == priority)
    if since:
        conds.append(F.col("date") >= since if legacy_text_dates else F.col("sent_at") >= day_start(since))
    if until:
        conds.append(F.col("date") <= until if legacy_text_dates
                     else F.col("sent_at") < day_start(until) + F.expr("INTERVAL 1 DAY"))
    return reduce(lambda a, b: a & b, conds)


def query_page(store: DataFrame, after_id: int = 0, limit: int = K.DEFAULT_QUERY_LIMIT, **filters) -> DataFrame:
    """F1-F7 + L1: rows with id > after_id matching the filters, by id, at most
    ``limit`` (a negative limit means no limit)."""
    rows = store.filter(predicates(after_id, **filters)).orderBy("id")
    return rows.limit(int(limit)) if limit is not None and limit >= 0 else rows


def page_meta(page: DataFrame, after_id: int = 0, limit: int = K.DEFAULT_QUERY_LIMIT) -> DataFrame:
    """A4: count, max id (after_id when empty) and has_more (count == limit)."""
    cnt = F.count(F.lit(1))
    has_more = (cnt == F.lit(int(limit))) if limit is not None and limit >= 0 else F.lit(False)
    return page.agg(
        cnt.alias("count"),
        F.coalesce(F.max("id"), F.lit(int(after_id or 0)).cast("bigint")).alias("max_id"),
        has_more.alias("has_more"),
    )


def response_document(store: DataFrame, after_id: int = 0, limit: int = K.DEFAULT_QUERY_LIMIT, **filters) -> DataFrame:
    """O3: a page and its meta as one JSON text ``{"results": [..], "meta":
    {count, max_id, has_more}}``, rows by id, nulls written out. The document
    holds the page, so it needs a limit."""
    if limit is None or limit < 0:
        raise ValueError("a document needs a limit; export_pages has no end")
    page = query_page(store, after_id, limit, **filters)
    count, last = F.count(F.lit(1)), F.coalesce(F.max("id"), F.lit(int(after_id or 0)).cast("bigint"))
    doc = page.agg(F.sort_array(F.collect_list(F.struct("id", *[c for c in page.columns if c != "id"]))).alias("results"),
                   F.struct(count.alias("count"), last.alias("max_id"), (count == F.lit(int(limit))).alias("has_more")).alias("meta"))
    return doc.select(F.to_json(F.struct("results", "meta"), {"ignoreNullFields": "false"}).alias("document"))


def iterate_pages(store: DataFrame, limit: int = K.DEFAULT_QUERY_LIMIT, after_id: int = 0, **filters):
    """L3 consumer protocol: yield (page, meta_row) while has_more. Only the
    meta row (three numbers) reaches the driver; pages stay DataFrames."""
    while True:
        page = query_page(store, after_id, limit, **filters)
        meta = page_meta(page, after_id, limit).first()
        yield page, meta
        if not meta["has_more"] or meta["count"] == 0:
            return
        after_id = meta["max_id"]


def export_pages(store: DataFrame, page_size: int, after_id: int = 0, **filters) -> DataFrame:
    """L3 bulk form: the page number every matching row would land on."""
    rows = store.filter(predicates(after_id, **filters))
    return dense_rank_pages(rows, ["id"], page_size)


def latest_per_hash(store: DataFrame) -> DataFrame:
    """The most recent row (max id) per content_hash, as a partial
    aggregation (a hot fingerprint is pre-reduced on the map side)."""
    return latest_per_key(store, ["content_hash"], "id").select(*store.columns)


def priority_by_run(store: DataFrame) -> DataFrame:
    """Rows per (run_id, priority)."""
    return store.groupBy("run_id", "priority").agg(F.count(F.lit(1)).alias("n"))


def table_lines(page: DataFrame, meta: DataFrame) -> DataFrame:
    """P15 as rows ``(line_no, line)``: header, rule, one line per result in
    id order, rule, footer; ``No results.`` alone when the page is empty.
    Line numbers come from the (small, limit-bounded) page's ids."""
    body = page.select(F.col("id").alias("_k"),
                       table_line("id", "priority", "date", "sender", "subject").alias("line"))
    m = meta.select("count", "max_id", "has_more")
    empty = F.col("count") == 0
    head = m.select(F.explode(F.when(empty, F.array(F.struct(F.lit(0).cast("bigint").alias("_k"),
                                                                F.lit(K.TABLE_EMPTY).alias("line"))))
                              .otherwise(F.array(
                                  F.struct(F.lit(-2).cast("bigint").alias("_k"), F.lit(TABLE_HEADER).alias("line")),
                                  F.struct(F.lit(-1).cast("bigint").alias("_k"), F.lit(TABLE_RULE).alias("line"))))).alias("s"))
    tail = m.filter(~empty).select(F.explode(F.array(
        F.struct(F.lit(1 << 62).cast("bigint").alias("_k"), F.lit(TABLE_RULE).alias("line")),
        F.struct(F.lit((1 << 62) + 1).cast("bigint").alias("_k"), table_footer().alias("line")))).alias("s"))
    lines = head.select("s.*").unionByName(body).unionByName(tail.select("s.*"))
    return lines.withColumnRenamed("_k", "sort_key")
