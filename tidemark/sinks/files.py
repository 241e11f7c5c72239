"""Small file-system helpers of the tables, and raw message files."""

from __future__ import annotations

import posixpath
import uuid
from itertools import groupby
from typing import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that message files are dealt to.
MAIL_FOLDERS = 256


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.mkdirs(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def bytes_below(spark: SparkSession, path: str) -> int:
    p, fs = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def numbers_below(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers N of the folders ``<prefix>N``."""
    p, fs = _fs(spark, path)
    names = [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))


def put_text(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(text.encode())
    finally:
        out.close()


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def groups_below(spark: SparkSession, path: str, most: int) -> Iterator[list[str]]:
    """The folders (and files beside folders) below ``path``, a path or a
    pattern, in groups that hold ``most`` files at most; a folder without
    folders is not parted. A path that is missing is a group of its own, for
    the reader to say so."""
    p, fs = _fs(spark, path)
    roots = fs.globStatus(p)

    def below(at) -> Iterator[tuple[str, int]]:
        held = fs.getContentSummary(at)
        if held.getFileCount() <= most or held.getDirectoryCount() < 2:
            yield at.toString(), held.getFileCount()
            return
        inner = fs.listStatusIterator(at)
        while inner.hasNext():
            child = inner.next().getPath()
            if not _hidden(child.getName()):
                yield from below(child)

    group, files = [], 0
    for name, n in ([(path, 1)] if roots is None else (x for root in roots for x in below(root.getPath()))):
        if group and files + n > most:
            yield group
            group, files = [], 0
        if n:
            group.append(name)
            files += n
    if group:
        yield group


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table with its declared schema; a missing one reads as empty."""
    if exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def append_parquet(rows: DataFrame, path: str) -> None:
    """Adds the files of ``rows`` to the table at ``path``. Spark's writers to
    one folder share its ``_temporary``, which the first to end takes away from
    the others; here each writes beside it and moves its files in."""
    spark, coming = rows.sparkSession, posixpath.join(posixpath.dirname(path.rstrip("/")), f".coming-{uuid.uuid4().hex}")
    try:
        rows.write.parquet(coming)
        make_folder(spark, path)
        (to, fs), (made, _) = _fs(spark, path), _fs(spark, coming)
        for st in fs.listStatus(made):
            name = st.getPath().getName()
            if not _hidden(name) and not fs.rename(st.getPath(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to, name)):
                raise OSError(f"{st.getPath().toString()} was not moved to {path}")
        spark.catalog.refreshByPath(path)
    finally:
        delete(spark, coming)


def arrow_path(root: str, *names: str) -> tuple[arrow_fs.FileSystem, str]:
    """``names`` below ``root`` (a path or URI), for the tasks that write there."""
    if urlsplit(root).scheme in ("", "file"):
        system, path = arrow_fs.LocalFileSystem(), root.removeprefix("file:")
    else:
        system, path = arrow_fs.FileSystem.from_uri(root)
    return system, posixpath.join(path, *names)


def write_mail_files(raw: DataFrame, path: str) -> int:
    """``raw`` (name string, content binary) as files ``path/<folder>/<name>.eml``,
    one a name; contents of the same name follow each other in its file. Tasks
    write them one by one, since a file is too small to be a Spark partition.
    A file is moved into place whole, so a lost or repeated task does no harm.
    Returns how many files there are."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = arrow_path(path)
        made, files = set(), 0
        rows = (tuple(c.as_py() for c in row) for batch in batches for row in zip(*batch.columns, strict=True))
        for (folder, name), group in groupby(rows, lambda r: r[:2]):
            at = posixpath.join(root, f"folder={folder}")
            if folder not in made:
                system.create_dir(at, recursive=True)
                made.add(folder)
            coming = posixpath.join(at, f".{uuid.uuid4().hex}")
            with system.open_output_stream(coming) as out:
                for _, _, content in group:
                    out.write(content)
            system.move(coming, posixpath.join(at, f"{name}.eml"))
            files += 1
        yield pa.record_batch([pa.array([files], pa.int64())], ["files"])

    make_folder(raw.sparkSession, path)
    dealt = raw.select(F.pmod(F.xxhash64("name"), F.lit(MAIL_FOLDERS)).alias("folder"), F.coalesce("name", F.lit("null")).alias("name"), "content")
    done = dealt.repartition("folder", "name").sortWithinPartitions("folder", "name").mapInArrow(write, "files long")
    return done.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
