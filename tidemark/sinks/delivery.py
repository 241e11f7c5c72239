"""K6/K10 in two steps: a batch sink as a Data Source writer with commit and
abort.

``partition_sink`` hands rows to a user's function as tasks run, so a lost task
hands them over twice. Here a task only *stages* its rows with the receiver and
reports what it staged; Spark hands the reports of the attempts that counted to
the driver, which *publishes* them account by account. What a lost or beaten
attempt staged is in no report, and stays unseen.

* An account one of whose parts could not be staged, or that could not be
  published, is not delivered: what was staged for it is discarded, its cursor
  stays, and the other accounts go on.
* Where the write fails as a whole, all that was reported is discarded.
* A replayed (run, batch) leaves alone the accounts already published, so a
  crash between delivery and commit delivers nothing twice.

Defined results: an empty batch stages and publishes nothing; rows of one
account may come in several parts, in uid order within each.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections import defaultdict
from dataclasses import dataclass
from itertools import groupby, islice
from typing import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .emit import SPREAD, Sink
from .files import arrow_path

#: (run id, batch id)
Key = tuple[str, int]

ROWS = "run_id string, account_id string, uid bigint, result_json string"
PUBLISHED = "run_id string, batch_id bigint, account_id string, parts array<string>"


class Receiver:
    """What a user provides. ``stage`` runs on the executors, the rest on the
    driver; all of it may be called again after a failure."""

    def stage(self, key: Key, account_id: str, rows: list[dict]) -> str:
        """Take rows without showing them; returns a name for the part."""
        raise NotImplementedError

    def publish(self, key: Key, account_id: str, parts: list[str]) -> None:
        """Show exactly these parts of an account, all at once."""
        raise NotImplementedError

    def discard(self, key: Key, account_id: str, parts: list[str]) -> None:
        """Forget parts that will not be published."""

    def published(self, key: Key) -> set[str]:
        """The accounts that this batch has been published for."""
        raise NotImplementedError


@dataclass
class Staged(WriterCommitMessage):
    """One task's report: (account, part) and the accounts that failed."""
    parts: list[tuple[str, str]]
    failed: dict[str, str]


class TwoStepWriter(DataSourceArrowWriter):
    def __init__(self, receiver: Receiver, key: Key, retries: int, backoff_s: float, chunk: int):
        self.receiver, self.key, self.retries, self.backoff_s, self.chunk = receiver, key, retries, backoff_s, chunk

    def _stage(self, account: str, rows: list[dict]) -> tuple[str | None, str | None]:
        for n in range(self.retries):
            try:
                return self.receiver.stage(self.key, account, rows), None
            except Exception as exc:  # noqa: BLE001 - whatever the user's function raises
                error = f"{type(exc).__name__}: {exc}"
                time.sleep(self.backoff_s * (n + 1) if n + 1 < self.retries else 0)
        return None, error

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        report = Staged([], {})
        rows = (row for batch in iterator for row in batch.to_pylist())
        for account, group in groupby(rows, lambda r: r["account_id"]):
            while part := list(islice(group, self.chunk)):
                if account not in report.failed:
                    name, error = self._stage(account, part)
                    if error:
                        report.failed[account] = error
                    else:
                        report.parts.append((account, name))
        return report

    def _by_account(self, messages: Iterable[Staged | None]) -> tuple[dict[str, list[str]], set[str]]:
        parts, failed = defaultdict(list), set()
        for message in messages:
            for account, name in message.parts if message else ():
                parts[account].append(name)
            failed.update(message.failed if message else ())
        return parts, failed

    def commit(self, messages: list[Staged | None]) -> None:
        parts, failed = self._by_account(messages)
        done = self.receiver.published(self.key)
        for account, names in parts.items():
            if account not in failed and account not in done:
                try:
                    self.receiver.publish(self.key, account, names)
                    continue
                except Exception:  # noqa: BLE001 - the account is then missing from ``published``
                    pass
            self.receiver.discard(self.key, account, names)

    def abort(self, messages: list[Staged | None]) -> None:
        for account, names in self._by_account(messages)[0].items():
            self.receiver.discard(self.key, account, names)


def two_step_source(receiver: Receiver, retries: int = 3, backoff_s: float = 1.0, chunk: int = 1000) -> type[DataSource]:
    """A writable source that delivers ``ROWS``, sorted by account within each
    partition, to ``receiver``. Options: ``run_id``, ``batch_id``."""
    label = f"tidemark_delivery_{uuid.uuid4().hex[:8]}"

    class Delivery(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return ROWS

        def writer(self, schema, overwrite: bool) -> TwoStepWriter:
            key = (self.options["run_id"], int(self.options["batch_id"]))
            return TwoStepWriter(receiver, key, retries, backoff_s, chunk)

    return Delivery


def two_step_sink(spark: SparkSession, receiver: Receiver, retries: int = 3, backoff_s: float = 1.0, chunk: int = 1000) -> Sink:
    """The batch sink over ``two_step_source``; a large account is spread over
    ``SPREAD`` tasks. Returns the accounts that the receiver has not published."""
    source = two_step_source(receiver, retries, backoff_s, chunk)
    spark.dataSource.register(source)

    def sink(results: DataFrame, batch_id: int) -> list[str]:
        first = results.select("run_id").first()
        if first is None:
            return []
        rows = results.select("run_id", "account_id", "uid", F.to_json("result").alias("result_json"))
        (rows.repartition("account_id", F.pmod(F.xxhash64("uid"), F.lit(SPREAD))).sortWithinPartitions("account_id", "uid")
         .write.format(source.name()).option("run_id", first[0]).option("batch_id", str(batch_id)).mode("append").save())
        done = receiver.published((first[0], batch_id))
        asked = results.select("account_id").distinct().collect()  # at most the accounts
        return [r[0] for r in asked if r[0] not in done]
    return sink


class FolderReceiver(Receiver):
    """Results as JSON lines in a shared folder (a path or URI). Parts lie in
    ``parts``; a small file in ``published`` for each (run, batch, account),
    moved into place whole, lists those that count. ``read_delivered`` reads
    them. A part is a file: deliver with a ``chunk`` of many thousand rows."""

    def __init__(self, root: str):
        self.root = root
        for name in ("parts", "published"):
            system, folder = self._at(name)
            system.create_dir(folder, recursive=True)

    def _at(self, *names: str) -> tuple[fs.FileSystem, str]:
        return arrow_path(self.root, *names)

    def _put(self, text: str, *names: str) -> None:
        system, path = self._at(*names)
        system.create_dir(posixpath.dirname(path), recursive=True)
        with system.open_output_stream(path) as out:
            out.write(text.encode())

    def stage(self, key: Key, account_id: str, rows: list[dict]) -> str:
        name = f"{uuid.uuid4().hex}.json"
        self._put("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), "parts", name)
        return name

    def publish(self, key: Key, account_id: str, parts: list[str]) -> None:
        entry = {"run_id": key[0], "batch_id": key[1], "account_id": account_id, "parts": parts}
        name = uuid.uuid4().hex
        self._put(json.dumps(entry, ensure_ascii=False) + "\n", "coming", name)
        system, folder = self._at("published", f"{key[0]}-{key[1]}")
        system.create_dir(folder, recursive=True)
        # one name an account: it is there wholly or not at all
        system.move(self._at("coming", name)[1], posixpath.join(folder, f"{uuid.uuid5(uuid.NAMESPACE_OID, account_id).hex}.json"))

    def discard(self, key: Key, account_id: str, parts: list[str]) -> None:
        for name in parts:
            system, path = self._at("parts", name)
            if system.get_file_info(path).type == fs.FileType.File:
                system.delete_file(path)

    def published(self, key: Key) -> set[str]:
        system, folder = self._at("published", f"{key[0]}-{key[1]}")
        found = set()
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            with system.open_input_stream(info.path) as entry:
                found.add(json.loads(entry.read())["account_id"])
        return found


def read_delivered(spark: SparkSession, root: str) -> DataFrame:
    """The rows of a ``FolderReceiver`` that count: run_id, batch_id,
    account_id, uid, result_json."""
    entries = spark.read.schema(PUBLISHED).option("recursiveFileLookup", "true").json(posixpath.join(root, "published"))
    listed = entries.select("batch_id", F.explode("parts").alias("part"))
    rows = spark.read.schema(ROWS).json(posixpath.join(root, "parts")).select("*", F.col("_metadata.file_name").alias("part"))
    return rows.join(listed, "part").select("run_id", "batch_id", "account_id", "uid", "result_json")
