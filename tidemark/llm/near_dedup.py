"""Operator 3: near-duplicates by MinHash and a locality-sensitive forest.

A document's set holds the hashes of its distinct word shingles. Documents
with the same set are one *node*, so exact copies never meet again. Nodes have
numbers of their own; ids and texts that repeat do not mix them up.

* **Forest.** A node's signature of ``HASHES`` minima is read in several
  orders. In an order, the nodes whose signatures share a prefix are neighbours
  by common prefix; they form a *region*, and are candidates of each other. (A
  region is found by its prefix, which comes to the same as sorting the order
  and cutting it where the common prefix of neighbours falls below the depth.)
* **Adaptive depth.** Every node starts at depth three in ``TREES`` orders. A
  region of over ``REGION`` nodes is not compared: its nodes go deeper, in as many more orders as independent ones would need to keep the
  probability that a pair meets in none (1e-5 at 0.8, 2e-7 at 0.85). Depth
  grows only for them, along ``DEPTHS``; nodes that still crowd a region at the
  last are chained.
* **Regions to clusters.** Within a region, nodes whose signatures agree in
  enough places (five standard deviations below the threshold) are chained.
  Chaining too much costs time and never a link. Clusters are the components.
* **Links.** Only nodes in clusters have their full sets compared, exactly. In
  a cluster of more than one block each member is first compared with the
  cluster's representative; those alike hang together through it. Only members
  that differ from it are dealt into blocks and compared with all members. All
  intersections of a group are matrix products, and links leave a task as a
  spanning forest, at most one row per node. Their components are the result.

Regions and blocks are bounded, prefixes are counted before anything is
gathered, and nothing is collected to the driver.

Defined results: null or blank text has an empty set, links with nothing and
stays; texts with fewer words than a shingle are one shingle; rows alike in
doc_id and text are one document; rows of one doc_id with different texts are
documents each, though ``component_id`` and ``kept`` tell ids apart only; a
null doc_id is the smallest id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keep_columns, text_of
from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_sets
from tidemark.session import stage_table

HASHES, TREES, REGION = 64, 16, 512
#: Values of a prefix in all orders, and in crowded regions one after another.
DEPTHS = (3, 5, 8)
#: Nodes and shingles of a block, and rows of sets that enter Python at once.
BLOCK, BLOCK_SHINGLES, ROWS = 512, 500_000, 500
#: Bytes of text hashed at once.
SLICE = 1_000_000
_NULL_ID = -(1 << 63)

_RANDOM = np.random.Generator(np.random.PCG64(85))
_TIMES = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The ``HASHES`` minima of a set, 32 bits each."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 8192):
        out = np.minimum(out, (hashes[at:at + 8192, None] * _TIMES + _PLUS).min(0))
    return (out >> np.uint64(32)).astype("<u4")


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches with the shingle sets of their texts, in slices of bounded size."""
    for batch in batches:
        texts = [t.encode() for t in batch.column("text").to_pylist()]
        begin, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= SLICE or i + 1 == len(texts):
                yield batch.slice(begin, i + 1 - begin), shingle_sets(texts[begin:i + 1], width)
                begin, size = i + 1, 0


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id, h (names the text among the rows of its doc_id), text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"),
                       F.xxhash64(text_of()).alias("h"), text_of().alias("text"))


def _names(sets: list[np.ndarray]) -> list[pa.Array]:
    """The size and the 128 bits that name each set."""
    a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).astype(np.int64)
    b = np.array([np.bitwise_xor.reduce(s * _TIMES[0]) if len(s) else 0 for s in sets], np.uint64).astype(np.int64)
    return [pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(b)]


def shingled(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h, n (size of its set), a and b (128 bits that name the set), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width):
            yield pa.record_batch([batch.column("doc_id"), batch.column("h"), *_names(sets),
                                   pa.array([signature(s).tobytes() if len(s) else b"" for s in sets], pa.binary())],
                                  ["doc_id", "h", "n", "a", "b", "signature"])

    return _documents(docs).mapInArrow(run, "doc_id long, h long, n long, a long, b long, signature binary")


class _Union:
    """Union-find over 0..n-1 that lists the unions that joined something."""

    def __init__(self, n: int):
        self.parent, self.links = list(range(n)), []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def union(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


def _edges(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The runs of rows with the same keys, as slices."""
    if not batch.num_rows:
        return
    columns = [batch.column(k).to_numpy() for k in keys]
    change = np.zeros(batch.num_rows - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield tuple(int(c[lo]) for c in columns), batch.slice(lo, hi - lo)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], solve) -> Iterator[pa.RecordBatch]:
    """``solve`` on the rows of each key, which lie next to each other; it
    returns links as two arrays."""
    rows, key = [], None
    for batch in batches:
        for now, part in _edges(batch, keys):
            if now != key and rows:
                yield _links(*solve(pa.Table.from_batches(rows)))
                rows = []
            key = now
            rows.append(part)
    if rows:
        yield _links(*solve(pa.Table.from_batches(rows)))


def _links(u, v) -> pa.RecordBatch:
    return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _spanning(nodes: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of a matrix's upper triangle."""
    joined = _Union(len(nodes))
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        joined.union(i, j)
    pairs = np.array(joined.links, np.int64).reshape(-1, 2)
    return nodes[pairs[:, 0]], nodes[pairs[:, 1]]


def _region_links(agree: int):
    """Spanning links of a region's nodes whose signatures agree enough."""

    def solve(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        sig = np.frombuffer(b"".join(rows.column("signature").to_pylist()), "<u4").reshape(-1, HASHES)
        linked = np.zeros((len(sig), len(sig)), bool)
        for i in range(len(sig) - 1):
            linked[i, i + 1:] = (sig[i] == sig[i + 1:]).sum(1) >= agree
        return _spanning(rows.column("node").to_numpy(), linked)

    return lambda batches: _grouped(batches, ["region"], solve)


def orders(depth: int, share: float) -> int:
    """Orders in which pairs meet at ``depth`` as surely as in ``TREES`` at the first."""
    return math.ceil(TREES * math.log(1 - share ** DEPTHS[0]) / math.log(1 - share ** depth))


def _leaves(nodes: DataFrame, depth: int, share: float) -> DataFrame:
    """(node, region): the prefix of each node in each order. The first
    ``TREES`` orders run through parts of the signature of their own, the next
    ones stride through it."""
    tree = F.col("tree")
    lap = F.floor(tree / TREES)
    value = lambda t, i: F.substring("signature", 4 * F.pmod(HASHES // TREES * F.pmod(t, F.lit(TREES)) + lap + i * (1 + 2 * lap), F.lit(HASHES)).cast("int") + 1, F.lit(4))
    return (nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(orders(depth, share) - 1))).alias("tree"))
            .select("node", F.xxhash64(F.lit(depth), "tree", *[value(tree, i) for i in range(depth)]).alias("region")))


def clusters(nodes: DataFrame, agree: int, share: float) -> DataFrame:
    """(node, root) of the nodes that share a cluster with another;
    ``nodes``: node, signature."""
    links, now = [], nodes
    for depth in DEPTHS:
        leaves = _leaves(now, depth, share)
        # counts are staged, so that both sides of the join are plain shuffles, whose hot prefixes AQE splits
        counts = stage_table(leaves.groupBy("region").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("least")).where("c > 1"), "prefixes")
        shared = stage_table(leaves.join(counts, "region"), "leaves")
        small = shared.where(F.col("c") <= REGION).select("region", "node")
        links.append(small.join(nodes.select("node", "signature"), "node").select("region", "node", "signature")
                     .repartition("region").sortWithinPartitions("region").mapInArrow(_region_links(agree), "u long, v long"))
        crowded = shared.where(F.col("c") > REGION)
        if crowded.isEmpty():
            break
        if depth == DEPTHS[-1]:
            links.append(crowded.where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")))
        now = stage_table(crowded.select("node").distinct().join(nodes, "node"), "crowded")
    return components(reduce(DataFrame.unionByName, links), "clusters")


def _set_table(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All shingles of a table's sets one after another, whose they are, and
    the sets' sizes; the sets' bytes are not copied one by one."""
    column = rows.column("shingles").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    size = np.diff(at).astype(np.int64) // 8
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].view("<u8"), np.repeat(np.arange(len(size)), size), size


def _intersections(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all intersections of a table's sets, and of the sets."""
    shingles, row, size = _set_table(rows)
    m = len(size)
    _, column, times = np.unique(shingles, return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)
    place = np.full(len(times), -1, np.int64)
    place[common] = np.arange(len(common))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((m, m), np.int64)
    for at in range(0, len(common), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((m, min(4096, len(common) - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += (part @ part.T).astype(np.int64)  # counts up to 4096 are exact in float32
    return both, size


def _block_links(num: int, den: int):
    """Spanning links of a group's sets with similarity ``num / den`` or more."""

    def solve(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        both, size = _intersections(rows)
        return _spanning(rows.column("node").to_numpy(), np.triu(den * both >= num * (size[:, None] + size[None, :] - both), 1))

    return lambda batches: _grouped(batches, ["root", "x", "y"], solve)


def _alike(num: int, den: int):
    """(node, root) of the members whose set is like their representative's,
    which comes first in its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = None
        for batch in batches:
            for now, part in _edges(batch, ["root", "own"]):
                shingles, row, size = _set_table(pa.Table.from_batches([part]))
                if now != key:
                    key, first = now, shingles[:size[0]]
                both = np.bincount(row[np.isin(shingles, first)], minlength=len(size))
                good = den * both >= num * (size + len(first) - both)
                yield _links(part.column("node").to_numpy()[good], np.full(int(good.sum()), now[0]))

    return run


def _set_column(width: int):
    """Adds each text's set; texts of another set than the node's go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches, width):
            same = np.logical_and.reduce([x.to_numpy() == batch.column(c).to_numpy() for x, c in zip(_names(sets), "nab", strict=True)])
            yield pa.record_batch([batch.column("root"), batch.column("blocks"), batch.column("node"),
                                   pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())],
                                  ["root", "blocks", "node", "shingles"]).filter(pa.array(same))

    return run


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, rows of sets enter Python ``ROWS`` at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def links(docs: DataFrame, nodes: DataFrame, clustered: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Verified links (u, v) that span the components; ``nodes``: node, doc_id,
    h, n, a, b of a text that stands for each."""
    sizes = clustered.join(nodes.select("node", "n"), "node").groupBy("root").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = clustered.join(sizes, "root").join(nodes, "node")
    sets = stage_table(_documents(docs).join(members, ["doc_id", "h"]).select("root", "blocks", "node", "text", "n", "a", "b")
                       .mapInArrow(_set_column(width), "root long, blocks int, node long, shingles binary"), "sets")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = sets.where("blocks = 1").select("root", F.lit(0).alias("x"), F.lit(0).alias("y"), "node", "shingles")
    large = sets.where("blocks > 1")
    # a large cluster's representative meets every block
    heads = large.where("node = root").select("root", each.alias("own"), F.lit(0).alias("kind"), "node", "shingles")
    rest = large.where("node <> root").select("root", own.alias("own"), F.lit(1).alias("kind"), "node", "shingles")
    stars = stage_table(heads.unionByName(rest).repartition("root", "own").sortWithinPartitions("root", "own", "kind")
                        .mapInArrow(_alike(num, den), "u long, v long"), "stars")
    # members that differ from it meet all members, block by block
    other = stage_table(large.where("node <> root").join(stars.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
                        .select("root", own.alias("x"), "node", "blocks", "shingles"), "others")
    busy = other.select("root", "x").distinct()
    cells = other.select("root", "x", each.alias("y"), "node", "shingles").unionByName(
        large.join(busy, "root").select("root", "x", own.alias("y"), "node", "shingles"))
    pairs = (one.unionByName(cells).repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
             .mapInArrow(_block_links(num, den), "u long, v long"))
    return stage_table(pairs, "pairs").unionByName(stars)


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.
    Documents link at ``den * intersection >= num * union``; a component is
    named by its smallest doc_id, which alone is kept."""
    out = _decided(docs, width, num, den)
    real = lambda c: F.when(c != _NULL_ID, c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), real(F.col("least.doc_id")).alias("component_id"),
                      (F.col("doc_id") == F.col("least.doc_id")).alias("kept"))


def _decided(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, h, n, and ``least``: the (doc_id, h) of the component's first document."""
    share = num / den
    agree = max(1, math.floor(HASHES * (share - 5 * math.sqrt(share * (1 - share) / HASHES))))
    rows = stage_table(shingled(docs, width), "shingled")
    sets = rows.where("n > 0").groupBy("n", "a", "b").agg(F.min(F.struct("doc_id", "h")).alias("first"), F.min("signature").alias("signature"))
    nodes = stage_table(sets.select(F.monotonically_increasing_id().alias("node"), "n", "a", "b", "first.doc_id", "first.h", "signature"), "nodes")
    clustered = stage_table(clusters(nodes.select("node", "signature"), agree, share), "clustered")
    with _small_batches(docs.sparkSession):
        found = links(docs, nodes.drop("signature"), clustered, width, num, den)
        roots = stage_table(components(found, "near"), "roots")
    named = nodes.select("node", "n", "a", "b", F.struct("doc_id", "h").alias("first")).join(roots, "node").select("root", "n", "a", "b", "first")
    least = stage_table(named.groupBy("root").agg(F.min("first").alias("least")), "least")  # staged, so that hot roots can be split
    told = stage_table(nodes.select("n", "a", "b", F.struct("doc_id", "h").alias("first")).join(
        named.join(least, "root").select("n", "a", "b", "least"), ["n", "a", "b"], "left").select(
        "n", "a", "b", F.coalesce("least", "first").alias("least")), "told")
    out = rows.select("doc_id", "h", "n", "a", "b").join(told, ["n", "a", "b"], "left")
    return out.withColumn("least", F.coalesce("least", F.struct("doc_id", "h")))


def drop_near_copies(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are: one document
    of each component."""
    here = F.struct("doc_id", "h")
    gone = _decided(docs, width, num, den).where(here != F.col("least")).select(
        F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    same = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).eqNullSafe(F.col("__id")) & (F.xxhash64(text_of()) == F.col("__h"))
    return keep_columns(docs, docs.join(gone, same, "left_anti"))
