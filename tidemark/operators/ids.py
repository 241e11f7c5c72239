"""L4 dense, gap-free id allocation without a single-partition window.

``row_number() over (order by k)`` with no partition plans an
``Exchange SinglePartition``: every row goes through one task. Here instead:

1. range-partition on the ordering key (a hot account is split across
   ranges because the key includes the uid) and sort within partitions;
2. tag each row with its partition id and in-partition position
   (``monotonically_increasing_id`` = partition << 33 | position);
3. materialise once as a table in the checkpoint folder, so the range
   bounds (which come from sampling) cannot differ between the counting and
   numbering passes, and a lost executor re-reads the table;
4. count rows per partition (one row per partition, the bound of what the
   driver sees), join the running sums back by partition, and number each
   row as base + offset + position + 1.

The result equals a global ``row_number`` over the same key plus ``base``.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, stage_table


def _num_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def assign_dense_ids(df: DataFrame, order: list[str | Column], base: int | Column = 0,
                     id_col: str = "id", num_partitions: int | None = None) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    n = num_partitions or _num_partitions(df)
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    tagged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    staged = stage_table(tagged, "ids")
    counts = staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).orderBy("_pid").collect()   # one row per partition
    offsets = df.sparkSession.createDataFrame(
        [(r["_pid"], end - r["n"]) for r, end in zip(counts, accumulate(r["n"] for r in counts))], "_pid int, _off long")
    base_col = base if isinstance(base, Column) else F.lit(int(base))
    return (staged.join(F.broadcast(offsets), "_pid")
            .withColumn(id_col, (base_col + F.col("_off") + F.col("_pos") + 1).cast("bigint")).drop("_pid", "_pos", "_off"))


def dense_rank_pages(df: DataFrame, order: list[str | Column], page_size: int,
                     page_col: str = "page_no", rn_col: str = "rn") -> DataFrame:
    """L3 bulk export: 0-based page number of each row under keyset paging."""
    numbered = assign_dense_ids(df, order, 0, rn_col)
    return numbered.withColumn(page_col, F.floor((F.col(rn_col) - 1) / F.lit(page_size)).cast("bigint"))
