"""The result cache as a bucketed base and appended deltas.

  cache/deltas/delta=N/   the writes of one batch (K4 writes O(batch))
  cache/gone/             invalidations: (N, account, or null for all) (K5)
  cache/base/v=N/         all rows up to N, one per fingerprint, in hash buckets
  cache/bases/            which base counts, and its number of buckets

A row's number orders it: the last write of a fingerprint wins, unless an
invalidation of its account came later. A probe (J1) joins the batch's
fingerprints to the base's buckets, where the base stays in place and only the
batch moves, and to the deltas since. ``upsert_cache`` folds the deltas into a
new base when they pass a quarter of it. Base files carry Bloom filters on the
fingerprint, so that the few keys of a small batch skip row groups (J2).

The cache is a memo: where two runs write at once, or one folds while another
writes, a write may be missed, which costs a model call and no result.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators.joins import broadcast_if_small
from ..session import stage_table
from .files import append_parquet, bytes_below, delete, numbers_below, read_parquet

#: Deltas below these bytes, or a quarter of the base, are left as they are; so are fewer than this many.
FOLD_BYTES, FOLD_DELTAS = 64 << 20, 50
BUCKET_BYTES = 128 << 20
#: Fingerprints of a batch that are pushed to the scan as literals.
PUSH_KEYS = 1000
GONE = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("account_id", T.StringType())])
BASES = T.StructType([T.StructField("seq", T.LongType(), False), T.StructField("buckets", T.IntegerType(), False)])
DELTA = T.StructType([*S.CACHE.fields, T.StructField("delta", T.LongType(), False)])
_ROW = S.CACHE.fieldNames()[1:]


def merge_cache(current: DataFrame, writes: DataFrame) -> DataFrame:
    """K4 as a function of two tables (INSERT OR REPLACE by fingerprint): new
    writes replace current rows; among new writes the last one wins."""
    tagged = (current.withColumn("_at", F.struct(F.lit(0).alias("w"), F.lit(0).cast("bigint").alias("uid")))
              .unionByName(writes.withColumn("_at", F.struct(F.lit(1).alias("w"), F.col("uid")))))
    latest = tagged.groupBy("content_hash").agg(F.max_by(F.struct(*_ROW), "_at").alias("r"))
    return latest.select("content_hash", "r.*")


def remaining_after_invalidate(cache: DataFrame, account_id: str | None) -> DataFrame:
    """K5 as a function: what the table holds afterwards."""
    return cache.filter(F.col("account_id") != account_id) if account_id else cache.filter(F.lit(False))


class CacheTable:
    """The cache as it stands: ``base`` has one row per fingerprint and is
    bucketed by it; ``deltas`` came later; ``gone`` are invalidations."""

    def __init__(self, base: DataFrame, deltas: DataFrame, gone: DataFrame):
        self.base, self.deltas = base, deltas
        self.every = gone.filter("account_id IS NULL").agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        gone = gone.filter("account_id IS NOT NULL").groupBy("account_id").agg(F.max("seq").alias("gone"))
        self.gone = broadcast_if_small(gone.withColumnRenamed("account_id", "gone_account"))

    def _newest_delta(self) -> DataFrame:
        latest = self.deltas.groupBy("content_hash").agg(
            F.max_by(F.struct(F.col("delta").alias("seq"), *_ROW), F.struct("delta", "uid")).alias("new"))
        return latest.select("content_hash", "new")

    def _standing(self, rows: DataFrame) -> DataFrame:
        """``rows`` (row: the newest write) and whether no invalidation came later."""
        out = rows.join(self.gone, F.col("row.account_id") == F.col("gone_account"), "left")
        return out.withColumn("stands", F.col("row.seq") > F.greatest(F.lit(self.every), F.coalesce("gone", F.lit(-1)))).drop("gone", "gone_account")

    def latest(self) -> DataFrame:
        """All rows that stand."""
        both = (self.base.select("content_hash", F.col("row").alias("old")).join(self._newest_delta(), "content_hash", "full")
                .select("content_hash", F.coalesce("new", "old").alias("row")))
        rows = self._standing(both).filter("stands").select("content_hash", "row.*")
        return rows.select(*S.CACHE.fieldNames())

    def probe(self, keys: DataFrame, model: str | None) -> DataFrame:
        """``keys`` (content_hash, ...) with ``cached``, the result that
        stands for the fingerprint (and model)."""
        base, keys = self.base, stage_table(keys, "keys")
        few = [r[0] for r in keys.select("content_hash").limit(PUSH_KEYS + 1).collect()]
        if len(few) <= PUSH_KEYS:  # the same rows; pushed down, they skip row groups by Bloom filter
            base = base.filter(F.col("content_hash").isin(few))
        found = keys.join(base.select("content_hash", F.col("row").alias("old")), "content_hash", "left")
        found = found.join(self._newest_delta(), "content_hash", "left").withColumn("row", F.coalesce("new", "old"))
        good = F.col("stands") & ((F.col("row.model_version") == model) if model else F.lit(True))
        return self._standing(found).select(*keys.columns, F.when(good, F.col("row.result")).alias("cached"))


def _folder(layout, name: str) -> str:
    return os.path.join(layout.cache, name)


def _table_name(path: str) -> str:
    return f"tidemark_cache_{hashlib.sha256(path.encode()).hexdigest()[:16]}"


def _base(spark: SparkSession, layout) -> tuple[int, DataFrame]:
    """The number of the base that counts, and its rows as (content_hash, row)."""
    last = read_parquet(spark, _folder(layout, "bases"), BASES).orderBy(F.desc("seq")).first()
    if last is None:
        return -1, _as_row(spark.createDataFrame([], S.CACHE), -1)
    path = os.path.join(_folder(layout, "base"), f"v={last['seq']}")
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in S.CACHE.fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (content_hash) "
                  f"SORTED BY (content_hash) INTO {last['buckets']} BUCKETS LOCATION '{path}'")
    return last["seq"], _as_row(spark.table(name), last["seq"])


def _as_row(rows: DataFrame, seq: int) -> DataFrame:
    return rows.select("content_hash", F.struct(F.lit(seq).cast("bigint").alias("seq"), *_ROW).alias("row"))


def open_cache(spark: SparkSession, layout) -> CacheTable:
    seq, base = _base(spark, layout)
    deltas = read_parquet(spark, _folder(layout, "deltas"), DELTA).filter(F.col("delta") > seq)
    return CacheTable(base, deltas, read_parquet(spark, _folder(layout, "gone"), GONE).filter(F.col("seq") > seq))


def read_cache(spark: SparkSession, layout) -> DataFrame:
    """The cache as a table."""
    return open_cache(spark, layout).latest()


def _next(spark: SparkSession, layout) -> int:
    last = [F.max("seq")]
    seen = [read_parquet(spark, _folder(layout, n), s).agg(*last).first()[0] for n, s in (("gone", GONE), ("bases", BASES))]
    return 1 + max([-1, *(x for x in seen if x is not None), *numbers_below(spark, _folder(layout, "deltas"), "delta=")])


def upsert_cache(spark: SparkSession, layout, writes: DataFrame) -> None:
    """K4: the batch's writes as a delta; a new base where deltas have grown."""
    seq, deltas = _next(spark, layout), _folder(layout, "deltas")
    append_parquet(writes.select(*S.CACHE.fieldNames()), os.path.join(deltas, f"delta={seq}"))
    grown = bytes_below(spark, deltas) > max(FOLD_BYTES, bytes_below(spark, _folder(layout, "base")) // 4)
    if grown or len(numbers_below(spark, deltas, "delta=")) > FOLD_DELTAS:
        fold_cache(spark, layout)


def fold_cache(spark: SparkSession, layout) -> None:
    """All that stands as a new bucketed base; its row in ``bases`` makes it
    count, and only then do the deltas go."""
    seq, deltas = _next(spark, layout) - 1, _folder(layout, "deltas")
    folded = numbers_below(spark, deltas, "delta=")
    path = os.path.join(_folder(layout, "base"), f"v={seq}")
    size = bytes_below(spark, _folder(layout, "base")) + bytes_below(spark, deltas)
    buckets = max(layout.cache_buckets, int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    (read_cache(spark, layout).repartition(buckets, "content_hash").write.mode("overwrite").format("parquet")
     .option("parquet.bloom.filter.enabled#content_hash", "true").option("path", path)
     .bucketBy(buckets, "content_hash").sortBy("content_hash").saveAsTable(_table_name(path)))
    append_parquet(spark.createDataFrame([(seq, buckets)], BASES).coalesce(1), _folder(layout, "bases"))
    for n in folded:
        delete(spark, os.path.join(deltas, f"delta={n}"))


def invalidate_cache(spark: SparkSession, layout, account_id: str | None = None) -> int:
    """K5: rows whose stored account_id matches (all rows when the account is
    falsy) stand no more; returns how many there were (A8)."""
    rows = read_cache(spark, layout)
    n = (rows.filter(F.col("account_id") == account_id) if account_id else rows).count()
    if n:
        row = spark.createDataFrame([(_next(spark, layout), account_id or None)], GONE)
        append_parquet(row.coalesce(1), _folder(layout, "gone"))
    return n
