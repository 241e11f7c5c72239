"""Operator 11: centroid clustering over a vector-approximation file.

Vectors are scaled to integers, so that every assignment, sum and distance is
exact and runs repeat to the bit.

* **Approximation file.** Each component is stored a second time as the number
  of its cell, one byte: ``CELLS`` cells per dimension, cut at quantiles of a
  bounded sample and closed by the exact least and greatest value, so a cell's
  two ends hold for every vector. Both forms lie in one Parquet table with a
  bucket per hash of the row number; a scan of the cells reads that column alone.
* **Intervals.** Per centroid, a lookup table holds the least and the greatest
  that each cell of each dimension adds to the squared distance. (The vector's
  own square is common to all its distances and left out, which makes the
  intervals far narrower.) A vector whose nearest interval ends before all
  others begin is decided; only vectors whose intervals overlap are fetched.
* **Rounds.** Sums are carried from round to round: a round scans the cells
  under the old and the new centroids and fetches, besides the undecided, just
  the vectors that changed cluster. The row numbers to fetch are joined to the
  bucketed vectors: only those numbers are shuffled, never a vector. The driver
  sees ``k * dim`` sums a round.

The first assignment and the last one (which returns every distance) read each
vector once, next to its cells, without a join. Nothing depends on which
cluster is large: rows are dealt by row number, sums are combined per task.

Defined results: a vector with another number of components, or with a null or
non-finite one, is left out; components are clamped to +-65,536 (2^26 after
scaling), so that squares fit into 64 bits; repeated rows count each; equal
hashes are ordered by components; a null vec_id hashes as the empty text; with
fewer vectors than centroids, each vector starts one; an empty table gives an
empty one. Sums of distances end at the largest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bucketed_table, hashed_sample
from tidemark.session import stage_table

#: Cells per dimension (one byte), and the rows that their ends are fitted on, about.
CELLS, SAMPLE = 256, 20_000
#: The greatest component after scaling.
MOST = 1 << 26
#: Bytes of vectors in a bucket, about.
BUCKET_BYTES = 64 << 20
#: Vectors that are looked up together.
SLICE = 8192

_INT = np.dtype("<i4")


def _matrix(column: pa.Array, dtype: np.dtype, dim: int) -> np.ndarray:
    """A binary column of equal widths as rows of numbers, without a copy per row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim)


def integer_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v array<int>) of the vectors that take part."""
    x = lambda c: c.cast("double")
    fits = F.forall("embedding", lambda c: F.coalesce(~F.isnan(x(c)) & (F.abs(x(c)) != float("inf")), F.lit(False)))
    whole = F.transform("embedding", lambda c: F.floor(F.greatest(F.least(x(c) * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))
    return vectors.where((F.size("embedding") == dim) & fits).select("vec_id", whole.alias("v"))


def start_centroids(ints: DataFrame, k: int, seed: str) -> np.ndarray:
    """The vectors of the least hashes of ``seed`` and their vec_id."""
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["v"] for r in ints.orderBy(order, "v").limit(k).collect()], np.int64)


class Cells:
    """The cells of each dimension: ``ends[i]`` are the starts of cells 1 and up."""

    def __init__(self, least: np.ndarray, greatest: np.ndarray, sample: np.ndarray, centre: np.ndarray):
        self.dim, self.centre = len(least), centre
        share = np.arange(1, CELLS) / CELLS
        self.ends = [np.unique(np.clip(np.quantile(sample[:, i], share, method="higher").astype(np.int64), least[i] + 1, None))
                     if len(sample) else np.empty(0, np.int64) for i in range(self.dim)]
        self.low = [np.concatenate(([least[i]], self.ends[i])) for i in range(self.dim)]
        self.high = [np.concatenate((self.ends[i] - 1, [max(greatest[i], self.ends[i][-1] if len(self.ends[i]) else least[i])])) for i in range(self.dim)]

    def number(self, v: np.ndarray) -> np.ndarray:
        """The cell of each component."""
        out = np.empty(v.shape, np.uint8)
        for i in range(self.dim):
            out[:, i] = np.searchsorted(self.ends[i], v[:, i], "right")
        return out

    def lookup(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Per dimension and cell, the least and greatest share of each
        centroid's distance, side by side; the centroids' own squares."""
        c = centroids - self.centre
        table = np.zeros((self.dim, CELLS, 2 * len(c)), np.int64)
        for i in range(self.dim):
            a, b = (-2 * (end - self.centre[i])[:, None] * c[:, i] for end in (self.low[i], self.high[i]))
            table[i, :len(a), :len(c)] = np.minimum(a, b)
            table[i, :len(a), len(c):] = np.maximum(a, b)
        return table, np.tile((c * c).sum(1), 2), len(c)

    def decide(self, cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
        """The cluster of each vector whose intervals tell; -1 of the others."""
        table, own, k = tables
        ends = np.tile(own, (len(cells), 1))
        for i in range(self.dim):
            ends += table[i].take(cells[:, i], 0)
        low, high = ends[:, :k], ends[:, k:]
        best = high.argmin(1)
        alone = (low <= high[np.arange(len(best)), best][:, None]).sum(1) == 1
        return np.where(alone, best, -1).astype(np.int32)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster and squared distance of each vector; ties: smaller number."""
    d = np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)
    best = d.argmin(1)
    return best.astype(np.int32), d[np.arange(len(best)), best]


def _settle(v: np.ndarray, cells: np.ndarray, marks: Cells, tables, centroids: np.ndarray) -> np.ndarray:
    """The cluster of each vector: by intervals, else by its exact distances."""
    out = marks.decide(cells, tables)
    rest = np.flatnonzero(out < 0)
    if len(rest):
        out[rest] = nearest(v[rest], centroids)[0]
    return out


class _Sums:
    """Sums of vectors per cluster, as rows (cluster, place, value); the place
    before the first component counts the vectors."""

    schema = "cluster int, place int, value long"

    def __init__(self, k: int, dim: int):
        self.total = np.zeros((k, dim + 1), np.int64)

    def add(self, cluster: np.ndarray, v: np.ndarray, sign: int = 1) -> None:
        for c in np.unique(cluster):
            at = cluster == c
            self.total[c, 0] += sign * int(at.sum())
            self.total[c, 1:] += sign * v[at].sum(0)

    def rows(self) -> Iterator[pa.RecordBatch]:
        c, p = np.nonzero(self.total)
        yield pa.record_batch([pa.array(c.astype(np.int32)), pa.array((p - 1).astype(np.int32)), pa.array(self.total[c, p])],
                              ["cluster", "place", "value"])


def _gather(parts: DataFrame, k: int, dim: int) -> np.ndarray:
    """The sums of all tasks; at most ``k * (dim + 1)`` rows reach the driver."""
    out = np.zeros((k, dim + 1), np.int64)
    for c, p, value in parts.groupBy("cluster", "place").agg(F.sum("value").alias("value")).collect():
        out[c, p + 1] = value
    return out


def _moved(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The floor of each non-empty cluster's mean; empty ones stay."""
    count = sums[:, :1]
    return np.where(count > 0, sums[:, 1:] // np.maximum(count, 1), centroids)


def _ranges(ints: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number, least, greatest and mean of the vectors' components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total = 0, np.full(dim, MOST, np.int64), np.full(dim, -MOST, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            v = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            if len(v):
                n, low, high, total = n + len(v), np.minimum(low, v.min(0)), np.maximum(high, v.max(0)), total + v.sum(0, np.int64)
        if n:
            yield pa.record_batch([pa.array([n] * dim), pa.array(np.arange(dim)), pa.array(low), pa.array(high), pa.array(total)],
                                  ["n", "place", "low", "high", "total"])

    rows = (ints.select("v").mapInArrow(run, "n long, place long, low long, high long, total long").groupBy("place")
            .agg(F.sum("n"), F.min("low"), F.max("high"), F.sum("total")).collect())
    at = np.array(sorted(tuple(r) for r in rows), np.int64).reshape(-1, 5)
    n = int(at[0, 1]) if len(at) else 0
    return n, at[:, 2], at[:, 3], at[:, 4] // max(n, 1)


def _approximate(ints: DataFrame, marks: Cells) -> DataFrame:
    """(row, vec_id, cells, vector): the table that both scans read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                v = part.column("v").flatten().to_numpy().reshape(-1, marks.dim)
                yield pa.record_batch([part.column("row"), part.column("vec_id"), pa.array([c.tobytes() for c in marks.number(v)], pa.binary()),
                                       pa.array([x.tobytes() for x in v.astype(_INT)], pa.binary())], ["row", "vec_id", "cells", "vector"])

    tagged = ints.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), "v")
    return tagged.mapInArrow(run, "row long, vec_id long, cells binary, vector binary")


def _first_sums(table: DataFrame, marks: Cells, centroids: np.ndarray) -> DataFrame:
    tables, dim = marks.lookup(centroids), marks.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(len(centroids), dim)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                v = _matrix(part.column("vector"), _INT, dim).astype(np.int64)
                sums.add(_settle(v, _matrix(part.column("cells"), np.dtype("u1"), dim), marks, tables, centroids), v)
        yield from sums.rows()

    return table.select("cells", "vector").mapInArrow(run, _Sums.schema)


def to_fetch(table: DataFrame, marks: Cells, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """(row, before, after) of the vectors that the cells leave undecided (-1)
    under the old or the new centroids, or that changed cluster."""
    before, after, dim = marks.lookup(old), marks.lookup(new), marks.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                cells = _matrix(part.column("cells"), np.dtype("u1"), dim)
                a, b = marks.decide(cells, before), marks.decide(cells, after)
                need = np.flatnonzero((a != b) | (a < 0))
                yield pa.record_batch([part.column("row").take(pa.array(need)), pa.array(a[need]), pa.array(b[need])], ["row", "before", "after"])

    return table.select("row", "cells").mapInArrow(run, "row long, before int, after int")


def _changes(fetched: DataFrame, dim: int, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """What the fetched vectors add to and take from the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(len(old), dim)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                v = _matrix(part.column("vector"), _INT, dim).astype(np.int64)
                ends = []
                for name, centroids in (("before", old), ("after", new)):
                    c = part.column(name).to_numpy().copy()
                    rest = np.flatnonzero(c < 0)
                    c[rest] = nearest(v[rest], centroids)[0]
                    ends.append(c)
                move = np.flatnonzero(ends[0] != ends[1])
                sums.add(ends[0][move], v[move], -1)
                sums.add(ends[1][move], v[move])
        yield from sums.rows()

    return fetched.select("before", "after", "vector").mapInArrow(run, _Sums.schema)


def _assigned(table: DataFrame, marks: Cells, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    tables, dim = marks.lookup(centroids), marks.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                v = _matrix(part.column("vector"), _INT, dim).astype(np.int64)
                cluster = _settle(v, _matrix(part.column("cells"), np.dtype("u1"), dim), marks, tables, centroids)
                distance = ((v - centroids[cluster]) ** 2).sum(1)
                yield pa.record_batch([part.column("vec_id"), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return table.select("vec_id", "cells", "vector").mapInArrow(run, "vec_id long, cluster int, distance long")


def _total() -> Column:
    return F.least(F.sum(F.col("distance").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3:") -> DataFrame:
    """``vectors`` (vec_id, embedding) as vec_id, cluster, distance (squared),
    cluster_inertia, inertia, centroid (array<long>): Lloyd's rounds on integer
    vectors, from the ``k`` vectors of least hashes."""
    spark = vectors.sparkSession
    ints = integer_vectors(vectors, dim, scale)
    centroids = start_centroids(ints, k, seed)
    n, least, greatest, centre = _ranges(ints, dim)
    if not n:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    drawn = hashed_sample(ints.withColumn("row", F.monotonically_increasing_id()), F.xxhash64("row"), n, SAMPLE)
    sample = np.array([r["v"] for r in drawn.select("v").collect()], np.int64).reshape(-1, dim)
    marks = Cells(least, greatest, sample, centre)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * dim * 5 // BUCKET_BYTES))
    with bucketed_table(_approximate(ints, marks), "row", buckets, "approximations") as table:
        old, sums = centroids, None
        for step in range(rounds):
            if step == 0:
                sums = _gather(_first_sums(table, marks, centroids), len(centroids), dim)
            else:
                fetched = to_fetch(table, marks, old, centroids).join(table.select("row", "vector"), "row")
                sums = sums + _gather(_changes(fetched, dim, old, centroids), len(centroids), dim)
            old, centroids = centroids, _moved(centroids, sums)
        out = stage_table(_assigned(table, marks, centroids), "assigned")
    per_cluster = out.groupBy("cluster").agg(_total().alias("cluster_inertia"))
    model = spark.createDataFrame([(i, [int(x) for x in c]) for i, c in enumerate(centroids)], "cluster int, centroid array<long>")
    inertia = out.agg(_total()).first()[0]
    # one row per centroid
    return (out.join(F.broadcast(per_cluster), "cluster").join(F.broadcast(model), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid"))


def centroid_digest(centroid: Column) -> Column:
    """SHA-256 of a centroid's components as decimal numbers with commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)
