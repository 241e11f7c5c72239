"""What the written tables read and move: pruned landing scans, the cache in
its buckets, consumers by commit, overridden streams."""
import datetime as dt
import os

from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.operators.enrich import probe_cache
from tidemark.plans import ingest as I
from tidemark.plans import run as R
from tidemark.plans.catalog_store import landed
from tidemark.sinks import cache as C
from tidemark.sinks import tables as T
from tidemark.streaming.stream import consumer_stream, ingest_stream, landed_messages

T0 = dt.datetime(2024, 1, 1)
DAY = "Fri, 05 Jan 2024 10:00:00 +0000"


def mail(spark, rows):
    return spark.createDataFrame([(u, a, f"s{u}", "x@y", DAY, f"{a} {u}") for a, u in rows], S.MESSAGE)


def answers(messages):
    from tidemark.functions.fingerprint import fingerprint
    return messages.select(fingerprint().alias("content_hash"), F.lit("m1").alias("model_version"),
                           F.lit('{"priority": "Low", "summary": "x"}').alias("raw_json")).distinct()


def opts(run_id, **k):
    return I.IngestOptions(run_id=run_id, model="m1", **{"init_start_date": "2024-01-01", **k})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, lay):
    return sorted((r.run_id, r.account_id, r.uid) for r in T.read_store(spark, lay).collect())


def test_landing_scan_is_pruned_by_day(spark, tmp_root):
    m = landed(mail(spark, [(a, u) for a in "ab" for u in range(1, 1001)]), os.path.join(tmp_root, "m"))
    acc = spark.createDataFrame([("a",), ("b",), ("c",)], "account_id string")
    cursors = spark.createDataFrame([("a", 900, T0, dt.date(2024, 1, 19)), ("b", 950, T0, dt.date(2024, 1, 20))],
                                    "account_id string, last_uid long, updated_at timestamp, landed_date date")
    batch = I.fetch(m, I.run_plan(acc, cursors, opts("r")), opts("r"))
    text = plan_of(batch)
    assert "dynamicpruningexpression(received_date" in text and "isnull(received_date" in text
    got = sorted((r.account_id, r.uid) for r in batch.collect())
    assert got == [("a", u) for u in range(901, 1001)] + [("b", u) for u in range(951, 1001)]
    days = {r[0] for r in batch.filter("received_date IS NOT NULL").select(F.input_file_name()).distinct().collect()}
    assert all(any(f"2024-01-{d}" in f for d in range(17, 22)) for f in days)
    # overridden starts and accounts without a day read everything
    again = I.fetch(m, I.run_plan(acc, cursors, opts("r", force_from_uid=1)), opts("r", force_from_uid=1))
    assert again.count() == 2000
    fresh = I.fetch(m, I.run_plan(acc, cursors.filter("account_id = 'a'"), opts("r")), opts("r"))
    assert sorted(map(tuple, fresh.groupBy("account_id").count().collect())) == [("a", 100), ("b", 1000)]


def test_a_run_keeps_the_landing_day_with_the_cursor(spark, tmp_root):
    lay = T.Layout(os.path.join(tmp_root, "s"), 4)
    rows = mail(spark, [("a", u) for u in range(1, 301)])
    m, acc = landed(rows, os.path.join(tmp_root, "m")), spark.createDataFrame([("a",)], "account_id string")
    R.run_ingest(spark, lay, m.filter("uid <= 200"), acc, opts("r"), responses=answers(rows))
    cur = T.read_cursors(spark, lay).first()
    assert (cur.last_uid, cur.landed_date) == (200, dt.date(2024, 1, 5))
    assert R.run_ingest(spark, lay, m, acc, opts("r"), responses=answers(rows))["emitted"] == 100


def cached(spark, rows):
    return spark.createDataFrame([(h, a, u, (u, "Low", "s", ["e"], False, False), "m1", T0) for h, a, u in rows], S.CACHE)


def test_a_probe_leaves_the_base_in_its_buckets(spark, tmp_root):
    lay = T.Layout(tmp_root, 4)
    C.upsert_cache(spark, lay, cached(spark, [(f"h{i:05}", "a", i) for i in range(4000)]))
    C.fold_cache(spark, lay)
    assert C.numbers_below(spark, os.path.join(lay.cache, "deltas"), "delta=") == []
    C.upsert_cache(spark, lay, cached(spark, [("h00001", "b", 7), ("new", "b", 8)]))
    keys = spark.createDataFrame([(f"h{i:05}",) for i in range(0, 3000)] + [("new",), ("none",)], "content_hash string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = probe_cache(keys, C.open_cache(spark, lay), "m1")
        text = plan_of(out)
        got = {r.content_hash: r.cached and r.cached.original_uid for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {f"h{i:05}": i for i in range(3000)} | {"h00001": 7, "new": 8, "none": None}
    base = text[text.index("tidemark_cache_") - 400:text.index("tidemark_cache_")]
    assert "Bucketed: true" in text and "Exchange" not in base


def test_few_keys_skip_row_groups_by_bloom_filter(spark, tmp_root):
    lay = T.Layout(tmp_root, 1)
    C.upsert_cache(spark, lay, cached(spark, [(f"{i * 7919 % 100003:016x}", "a", i) for i in range(20_000)]))
    C.fold_cache(spark, lay)
    cache = C.open_cache(spark, lay)
    hit = f"{5 * 7919 % 100003:016x}"
    out = cache.probe(spark.createDataFrame([(hit,), ("0" * 15 + "g",)], "content_hash string"), "m1")
    assert "PushedFilters: [In(content_hash" in plan_of(out).replace("IsNotNull(content_hash), ", "")
    assert {r.content_hash: r.cached is not None for r in out.collect()} == {hit: True, "0" * 15 + "g": False}
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(lay.cache, "base"))
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    names = [str(f) for f in _files(files, conf) if str(f).endswith(".parquet")]
    jvm = spark.sparkContext._jvm
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(
        jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(names[0]), conf))
    block = reader.getFooter().getBlocks().get(0)
    assert any(c.getPath().toDotString() == "content_hash" and c.getBloomFilterOffset() > 0 for c in block.getColumns())
    reader.close()


def _files(path, conf):
    it = path.getFileSystem(conf).listFiles(path, True)
    while it.hasNext():
        yield it.next().getPath()


def test_writes_invalidations_and_folds_in_any_order(spark, tmp_root):
    lay, read = T.Layout(tmp_root, 4), lambda: sorted((r.content_hash, r.account_id) for r in C.read_cache(spark, lay).collect())
    C.upsert_cache(spark, lay, cached(spark, [("h1", "a", 1), ("h2", "b", 2)]))
    C.fold_cache(spark, lay)
    assert C.invalidate_cache(spark, lay, "a") == 1 and read() == [("h2", "b")]
    C.upsert_cache(spark, lay, cached(spark, [("h1", "a", 3)]))             # written again after the invalidation
    assert read() == [("h1", "a"), ("h2", "b")]
    C.upsert_cache(spark, lay, cached(spark, [("h2", "a", 4)]))             # the newest writer owns the row
    assert C.invalidate_cache(spark, lay, "b") == 0
    assert C.invalidate_cache(spark, lay, "a") == 2 and read() == []        # the older row of b does not come back
    C.fold_cache(spark, lay)
    C.upsert_cache(spark, lay, cached(spark, [("h3", "c", 5)]))
    assert read() == [("h3", "c")] and C.invalidate_cache(spark, lay) == 1 and read() == []


def test_deltas_fold_by_themselves(spark, tmp_root, monkeypatch):
    monkeypatch.setattr(C, "FOLD_DELTAS", 2)
    lay = T.Layout(tmp_root, 4)
    for i in range(4):
        C.upsert_cache(spark, lay, cached(spark, [(f"h{i}", "a", i)]))
    assert len(C.numbers_below(spark, os.path.join(lay.cache, "deltas"), "delta=")) == 1
    assert C.read_cache(spark, lay).count() == 4


def test_a_consumer_beside_an_ingest_misses_nothing(spark, tmp_root):
    lay, acc = T.Layout(os.path.join(tmp_root, "s"), 4), spark.createDataFrame([("a",)], "account_id string")
    m, got = mail(spark, [("a", u) for u in range(1, 4)]), []

    def pull(*_):
        consumer_stream(spark, lay, os.path.join(tmp_root, "ck"), lambda rows, b: got.extend(r.uid for r in rows.collect()))
    pull()                                                    # before the first commit
    R.run_ingest(spark, lay, m.filter("uid = 1"), acc, opts("r"), responses=answers(m), sink=pull)
    assert got == []
    pull()
    R.run_ingest(spark, lay, m, acc, opts("r"), responses=answers(m), sink=pull)
    pull()
    pull()
    assert sorted(got) == [1, 2, 3]


def test_an_overridden_stream_stores_rows_again(spark, tmp_root):
    lay, acc = T.Layout(os.path.join(tmp_root, "s"), 4), spark.createDataFrame([("a",)], "account_id string")
    m = mail(spark, [("a", u) for u in range(1, 4)])
    m.repartition(2).write.parquet(os.path.join(tmp_root, "landed"))

    def go(run, **k):
        src = landed_messages(spark, os.path.join(tmp_root, "landed"), max_files=1)
        return ingest_stream(spark, src, lay, acc, opts(run, **k), os.path.join(tmp_root, f"ck-{run}"), responses=answers(m))[1]
    go("first")
    once = [("first", "a", u) for u in (1, 2, 3)]
    assert stored(spark, lay) == once
    go("again")                                               # the same files without an override: nothing new
    assert stored(spark, lay) == once
    go("forced", force_from_uid=2)
    assert stored(spark, lay) == once + [("forced", "a", u) for u in (2, 3)]
    go("reset", reset_cursor=True)
    assert stored(spark, lay) == once + [("forced", "a", u) for u in (2, 3)] + [("reset", "a", u) for u in (1, 2, 3)]
    assert sorted(r.id for r in T.read_store(spark, lay).collect()) == list(range(1, 9))


def test_consumer_query_makes_its_answers_once(spark, monkeypatch):
    """both runs read the same answers, which are made from every message."""
    from tidemark.plans import catalog_store as CS
    made, make = spark.sparkContext.accumulator(0), CS.World.__dict__["responses"].func

    def counted(world):
        def count(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch
        answers = make(world)
        return answers.mapInArrow(count, answers.schema)
    monkeypatch.setattr(CS.World, "responses", property(counted))
    sf = "/root/testdata/sf0.001"
    assert CS.q_consumer_commits(spark, sf).count() > 0
    assert made.value == make(CS.World(spark, sf)).count()
