"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: The white space of the contracts: ``[\x20\x09-\x0D]``.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def without_white_space(text: Column) -> Column:
    """``text`` without any character of ``WHITE_SPACE``."""
    for ch in WHITE_SPACE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def hashed_sample(df: DataFrame, key: Column, rows: int, most: int) -> DataFrame:
    """The rows of ``df`` (which has ``rows``) with the least hashes ``key``
    (64 bits): about ``most`` of them, all where there are no more."""
    if rows <= most:
        return df
    return df.where(F.shiftrightunsigned(key, 1) < F.lit(int((1 << 63) * (most / rows))))


@contextmanager
def bucketed_table(df: DataFrame, key: str, buckets: int, name: str) -> Iterator[DataFrame]:
    """``df`` as a Parquet table in the checkpoint folder, dealt to ``buckets``
    by ``key``: joins on it leave its rows where they are. Dropped at the end."""
    spark = df.sparkSession
    path, table_name = scratch_path(spark, name), f"{name}_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", path).format("parquet").saveAsTable(table_name))
    try:
        yield spark.table(table_name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table_name}")
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def keep_columns(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """``decided`` narrowed to the columns of ``docs``, in their order."""
    return decided.select(*[F.col(f"`{c}`") for c in docs.columns])


class Memo(dict):
    """A dict that computes missing values. When full, its values become the
    old generation: those asked for again move back, the rest are forgotten
    when the next generation is full, so frequent keys stay."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most // 2, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def runs(first: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs of ``rows``, which begin at ``first``, one after
    another, and which of ``rows`` each belongs to."""
    first, size = first[rows], size[rows]
    run = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(run)) - np.repeat(np.cumsum(size) - size - first, size), run


def slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[str]]]:
    """(doc_ids, texts) of neighbouring rows of at most about ``most``
    characters together; a longer text is a slice of its own."""
    for batch in batches:
        keys, texts, size = [], [], 0
        for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            keys.append(key.as_py())
            texts.append(text.as_py())
            size += len(texts[-1])
            if size >= most:
                yield keys, texts
                keys, texts, size = [], [], 0
        if keys:
            yield keys, texts
